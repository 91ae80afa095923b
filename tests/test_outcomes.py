import pytest
from pyspark.sql import functions as F

from evenkeel.functions.numbers import finite, integer_like, number
from evenkeel.operators import factors, inventory, labels, outcomes, quality
from evenkeel.sources.files import RUN_SCHEMA
from evenkeel.streaming.outcomes import outcome_stream, run_stream

BASE = {"hash": "abc123", "run": "1", "submit": "100", "commit": "90", "tps": "1.0", "latency": "2.0", "energy": "3.0", "rx": "4.0", "tx": "5.0"}


def frame(spark, *overrides):
    rows = [{**BASE, **o} for o in overrides]
    return spark.createDataFrame([tuple(r[c] for c in BASE) for r in rows], ", ".join(f"{c} string" for c in BASE))


@pytest.mark.parametrize("override, expected", [
    ({}, {"outcome": "positive_commit", "tps_point_valid": True, "latency_valid": True, "network_valid": True}),
    ({"commit": "1", "tps": "0.0"}, {"outcome": "positive_commit", "tps_valid": True, "tps_censored": True, "tps_point_valid": False}),
    ({"commit": "0", "tps": "0", "latency": "0"}, {"outcome": "zero_commit", "tps_valid": False, "latency_valid": False, "energy_valid": True, "energy_valid_positive": False, "network_valid": True}),
    ({"submit": "0", "commit": "0"}, {"outcome": "no_submission", "submitted": False, "energy_valid": True}),
    ({"submit": "10", "commit": "11"}, {"outcome": "inconsistent"}),
    ({"submit": "540000.1", "commit": "10"}, {"outcome": "inconsistent"}),
    ({"submit": "0", "commit": "1"}, {"outcome": "inconsistent"}),
    *(({"submit": bad}, {"outcome": "inconsistent"}) for bad in (None, "NaN", "Infinity", "-1", "abc")),
    ({"energy": "-1", "rx": "NaN"}, {"outcome": "positive_commit", "energy_valid": False, "network_valid": False}),
])
def test_outcome_states(spark, override, expected):
    row = outcomes.derive_outcomes(frame(spark, override)).first()
    assert {k: row[k] for k in expected} == expected


def test_flags_agree_and_counts_add_up(spark):
    df = outcomes.derive_outcomes(frame(spark, {}, {"commit": "0"}, {"submit": "0", "commit": "0"}, {"submit": None}))
    assert outcomes.flag_violations(df).count() == 0
    row = outcomes.outcome_counts(df, ["hash"]).first()
    assert (row.n_observed, row.n_positive_commit, row.n_zero_commit, row.n_no_submission, row.n_inconsistent, row.service_regime) == (4, 1, 1, 1, 1, "mixed")
    assert {r.outcome: r.n_runs for r in outcomes.status_counts(df.filter("positive"), ["hash"]).collect()} == {"positive_commit": 1, "zero_commit": 0, "no_submission": 0, "inconsistent": 0}


def test_numbers(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string").select(number(F.col("v")).alias("v"))
    assert [tuple(r) for r in df.select(finite(F.col("v")), integer_like(F.col("v"))).collect()] == [(True, True), (True, False)] + [(False, False)] * 4


def test_selection_follows_recoding(spark):
    rows = [("poa", "full-mesh-l", 8), ("poa", "full-mesh-l", 4), ("other", None, 8)]
    maps = {"blockchain": {"poa": "Ethereum"}, "mode": {"full-mesh": "full mesh"}}
    named = labels.normalise(spark.createDataFrame(rows, "blockchain string, mode string, cores int"), maps, {"mode": "-l"})
    chosen = labels.select_controlled(named, {"blockchain": "Ethereum", "mode": "full mesh", "cores": 8}, maps, {"mode": "-l"}).collect()
    assert len(chosen) == 1 and chosen[0]["mode_raw"] == "full-mesh-l"
    with pytest.raises(ValueError):
        labels.of_scope(named, "mode", {"a": None}, "b")


def test_provenance(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 1, "y"), ("c", 1, None), ("c", 2, "x")], "batch string, run int, cfg string")
    assert [r.batch for r in inventory.duplicates(df, ["batch", "run"]).collect()] == ["b"]
    assert {r.batch for r in inventory.crossing_batches(df, ["cfg"], "batch").collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        quality.require_none(inventory.duplicates(df, ["batch"]), "repeated batch")
    with pytest.raises(Exception, match="not unique"):
        factors.one_to_one(df, df, ["batch"]).collect()


def test_streaming_gives_the_batch_result(spark, tmp_path):
    source = frame(spark, {}, {"commit": "0"}, {"submit": None})
    source.write.parquet(str(tmp_path / "in"))
    stream = outcome_stream(run_stream(spark, str(tmp_path / "in"), source.schema.simpleString()[7:-1].replace(":", " ")))
    q = stream.writeStream.format("memory").queryName("outcome_rows").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.table("outcome_rows")) == key(outcomes.derive_outcomes(source))
    assert "hash STRING" in RUN_SCHEMA
