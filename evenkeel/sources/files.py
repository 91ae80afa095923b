"""Readers and writers: run logs, result tables, topologies, schedules, manifests, summaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenkeel.functions.storage import materialize

#: Largest file that the manifest reads in one piece, and the bytes of a chunk of a larger one.
WHOLE, CHUNK = 64 << 20, 4 << 20
#: Fixed columns of a run log.
RUN_SCHEMA = (
    "hash STRING, workload STRING, run INT, mode STRING, dataset STRING, link_strategy STRING, cores INT, ram INT, secondaries INT, network_size INT, dynamic INT, "
    "submit_number DOUBLE, commit_number DOUBLE, abort_number DOUBLE, average_load DOUBLE, average_throughput DOUBLE, average_latency DOUBLE, median_latency DOUBLE, "
    "start_bench TIMESTAMP_NTZ, blockchain STRING, `MiB-Rx` DOUBLE, `MiB-Tx` DOUBLE, energy DOUBLE, bandwidth STRING, switch STRING, latency STRING"
)


def read_runs(spark: SparkSession, path: str, required: Sequence[str] = ("hash", "run", "workload", "mode")) -> DataFrame:
    """A run log with the declared types. The header decides which columns there are; a required one that is missing is an error."""
    header = spark.read.option("header", True).csv(path).columns
    if gone := sorted(set(required) - set(header)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    kinds = {f.name: f.dataType for f in StructType.fromDDL(RUN_SCHEMA)}
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in header))


def node_count(c: str):
    """The number in a size label."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def read_results(spark: SparkSession, path: str, required: Sequence[str], scope: str = "scope", budget: str = "bootstrap_repetitions", seed: str = "seed", scopes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A completed result table, and its scopes with their one budget and least seed. Budgets that differ in a scope are an error, and so is a table without rows or without any of the ``scopes`` that must be there."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if gone := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    found = df.groupBy(scope).agg(F.countDistinct(budget).alias("n_budgets"), F.max(budget).alias(budget), F.min(seed).alias(seed))
    there = {r[0] for r in found.select(scope).filter(F.col(scope).isin(list(scopes)) if scopes else F.lit(True)).limit(max(1, len(scopes))).collect()}
    if not there or set(scopes) - there:
        raise ValueError(f"no rows for: {', '.join(sorted(set(scopes) - there)) or 'any scope'}")
    bad = found.filter("n_budgets != 1").limit(5).collect()
    if bad:
        raise ValueError(f"scopes with several budgets: {[r[scope] for r in bad]}")
    return df, found.drop("n_budgets")


_TOPOLOGY = "bridges STRUCT<bridge: ARRAY<STRUCT<_name: STRING>>>, services STRUCT<service: ARRAY<STRUCT<_name: STRING, _image: STRING>>>, links STRUCT<link: ARRAY<STRUCT<_origin: STRING, _dest: STRING, _latency: STRING>>>"


def read_topologies(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Links, bridges and services of topology files, with graph_id from the file name.

    Each file is read and parsed once, as a row (a file must fit into a task); the three tables are taken from what that gave.
    """
    graph = F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "")
    files = spark.read.option("wholetext", True).text(path).select(graph.alias("graph_id"), F.from_xml("value", F.lit(_TOPOLOGY)).alias("x"))
    parsed = materialize(files.select("graph_id", F.col("x.links.link").alias("link"), F.col("x.bridges.bridge").alias("bridge"), F.col("x.services.service").alias("service")))
    each = lambda tag, *columns: parsed.select("graph_id", F.explode(tag).alias("e")).select("graph_id", *(F.col(f"e._{c}").alias(n) for c, n in columns))
    return {"links": each("link", ("origin", "u"), ("dest", "v"), ("latency", "latency")), "bridges": each("bridge", ("name", "v")), "services": each("service", ("name", "v"))}


def read_schedules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trace_id, second, tps) of schedule files, and the lines that are neither a step nor a key with a value."""
    lines = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.ya?ml$", "").alias("trace_id"), F.trim("value").alias("line")).filter("line != '' AND NOT startswith(line, '#')")
    step = r"^([0-9]+)\s*:\s*([0-9]+)$"
    steps = lines.filter(F.col("line").rlike(step)).select("trace_id", F.regexp_extract("line", step, 1).cast("int").alias("second"), F.regexp_extract("line", step, 2).cast("int").alias("tps"))
    return steps, lines.filter(~F.col("line").rlike(step) & ~F.col("line").rlike(r"^-?\s*[A-Za-z_&!][^:]*:.*$"))


def _streamed(path: str) -> str:
    """SHA-256 of a file that is read in chunks; a path without a host is one of the executors' own file system."""
    scheme, host, inner = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(/.*)", path, re.S).groups()
    if scheme in (None, "file"):
        opened = open(inner, "rb")
    else:
        from pyarrow import fs

        opened = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")[0].open_input_stream(f"{host}{inner}" if scheme in ("s3", "gs") else inner)
    digest = hashlib.sha256()
    with opened as f:
        while chunk := f.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def manifest(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """file, bytes and SHA-256 of all files below a folder.

    Files of up to WHOLE bytes are read by Spark, each into a row; larger ones are listed without their
    contents, dealt over the tasks by path, and streamed through the hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~name.isin(list(exclude)) if exclude else F.lit(True))
    whole = files.filter(F.col("length") <= WHOLE).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"file": rows["file"], "bytes": rows["bytes"], "sha256": rows["path"].map(_streamed)})

    large = files.filter(F.col("length") > WHOLE).select("path", name.alias("file"), F.col("length").alias("bytes"))
    return whole.unionByName(large.repartition("path").mapInPandas(hashed, "file string, bytes long, sha256 string"))


def checksum_violations(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files of expected (file, sha256) that are missing or differ."""
    found = files.select("file", F.col("sha256").alias("found"))
    return expected.join(found, "file", "left").filter(~F.col("sha256").eqNullSafe(F.col("found")))


def write_csv(df: DataFrame, path: str, decimals: int | None = None, order: Sequence[str] = ()) -> None:
    """One header a file; with decimals, doubles in fixed precision; with order, rows sorted over all files by these columns, then all others."""
    if order:
        df = df.orderBy(*order, *(c for c in df.columns if c not in order))
    kinds = dict(df.dtypes)
    fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", c)).alias(c)
    out = df.select(*(fixed(c) if decimals is not None and kinds[c] == "double" else F.col(c) for c in df.columns))
    out.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON with sorted keys; NaN becomes null, and null fields stay."""
    kinds = dict(df.dtypes)
    df.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) if kinds[c] == "double" else F.col(c) for c in sorted(df.columns))).write.option("ignoreNullFields", False).json(path)


def write_scopes(df: DataFrame, path: str, scope: str = "scope") -> None:
    """Parquet with a folder for each scope; an existing table is never overwritten."""
    df.write.partitionBy(scope).parquet(path)
