"""Bootstraps of cells of any size: a large cell is cut into ranges of its sorted values, to which its draws are dealt, so that no task holds it or its draws."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from evenkeel.functions.cells import cell_key, cell_label
from evenkeel.functions.numbers import percent
from evenkeel.functions.ranks import counted_upto
from evenkeel.functions.storage import materialize
from evenkeel.plans.model import MetricSpec

#: Members in a block of clusters, values in a range, and draws that a worker handles at once.
RANGE, VALUES, CHUNK, SLICE = 4096, 1 << 18, 1_000_000, 1 << 16
_STATS = ("s1", "s2", "low", "high")


def mixed(x: np.ndarray) -> np.ndarray:
    """32 well-mixed bits of 32 bits, in arithmetic that SQL can repeat."""
    m = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & m
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & m
    return x ^ (x >> np.uint64(16))


def _seed(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def places(seed: int, label: str, block: int, replicate: np.ndarray, draw: np.ndarray, size: int) -> np.ndarray:
    """Where each draw of a replicate falls in a range of ``size`` values."""
    m, base = np.uint64(0xFFFFFFFF), np.uint64(_seed(seed, label, block))
    own = mixed((base + replicate.astype(np.uint64) * np.uint64(0x9E3779B9)) & m)
    return (mixed((own + draw.astype(np.uint64) * np.uint64(0x85EBCA6B)) & m) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def dealt(seed: int, label: str, n: int, block: int, size: int, replicates: int) -> np.ndarray:
    """How many of a cell's n draws fall into a range, for each replicate: a draw's first number says its range, each by its size."""
    if n <= size:
        return np.full(replicates, n, np.int64)
    return np.array([shares(seed, label, n, size, r)[block] for r in range(1, replicates + 1)], np.int64)


def shares(seed: int, label: str, n: int, size: int, replicate: int) -> np.ndarray:
    """How many of a cell's n draws fall into each of its ranges, in one replicate."""
    own = _own(seed, label, "ranges", np.array([replicate]))[0]
    out = np.zeros(-(-n // size), np.int64)
    for at in _turns(own, n, n):
        out += np.bincount(at // size, minlength=len(out))
    return out


def _own(seed: int, label: str, block: int | str, replicate: np.ndarray) -> np.ndarray:
    """The number from which each replicate counts on."""
    return mixed((np.uint64(_seed(seed, label, block)) + replicate.astype(np.uint64) * np.uint64(0x9E3779B9)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _places(x: np.ndarray, size: int) -> np.ndarray:
    """As ``places``, from own + draw * 0x85EBCA6B in 32 bits, which are overwritten."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return (x.astype(np.uint64) * np.uint64(size) >> np.uint64(32)).view(np.int64)


def _turns(own: np.uint32, m: int, size: int) -> Iterator[np.ndarray]:
    """The places of a replicate's m draws, a slice at a time."""
    step = np.arange(min(m, SLICE), dtype=np.uint32) * np.uint32(0x85EBCA6B)
    for first in range(0, m, SLICE):
        shift = np.uint32((int(own) + first * 0x85EBCA6B) & 0xFFFFFFFF)
        yield _places(step[: m - first] + shift, size)


def _drawn(own: np.ndarray, m: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """How often each of size values is drawn, a row for each replicate, some replicates at a time where they are short."""
    alike = len(m) > 0 and (m == m[0]).all()
    rows = max(1, SLICE // max(int(m[0]), size, 1)) if alike else 1
    for first in range(0, len(m), rows):
        part = slice(first, first + rows)
        if rows > 1:
            x = own[part, None] + np.arange(m[0], dtype=np.uint32) * np.uint32(0x85EBCA6B)
            at = _places(x, size) + np.arange(len(x))[:, None] * size
            yield part, np.bincount(at.ravel(), minlength=len(x) * size).reshape(len(x), size)
        else:
            w = np.zeros(size, np.int64)
            for at in _turns(own[first], int(m[first]), size):
                w += np.bincount(at, minlength=size)
            yield part, w[None]


def weights(seed: int, label: str, block: int, replicate: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """How often each value of a range is drawn: a row for each replicate."""
    row = np.repeat(np.arange(len(count)), count)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = places(seed, label, block, replicate[row], turn, size)
    return np.bincount(row * size + at, minlength=len(count) * size).reshape(len(count), size)


def chunks(count: np.ndarray, size: int) -> Iterator[slice]:
    step = max(1, CHUNK // max(size, int(count.max(initial=1))))
    for first in range(0, len(count), step):
        yield slice(first, first + step)


def _at(values: np.ndarray, upto: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The values of each row at its ranks from 0 (a row of ranks each), by the row's running counts."""
    at = np.array([np.searchsorted(u, k, side="right") for u, k in zip(upto, rank)])
    return values[np.minimum(at, len(values) - 1)]


def quartiles(values: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both interpolated quartiles of each row, by the row's running counts."""
    h = (upto[:, -1:] - 1) * np.array([0.25, 0.25, 0.75, 0.75])
    rank, share = np.floor(h), h - np.floor(h)
    rank[:, 1::2] = np.ceil(h[:, 1::2])
    v = _at(values, upto, rank)
    return (1 - share[:, 0]) * v[:, 0] + share[:, 0] * v[:, 1], (1 - share[:, 2]) * v[:, 2] + share[:, 2] * v[:, 3]


def _values(piece: pa.Table) -> np.ndarray:
    """The sorted values of a range, each as often as it occurs."""
    v, c = (piece.column(x).to_numpy() for x in ("v", "c"))
    order = np.argsort(v, kind="stable")
    return np.repeat(v[order], c[order])


_NUMBERS = [*_STATS, "q25", "q75"]
_FOUND = StructType([StructField("id", LongType()), StructField("block", LongType()), StructField("replicate", LongType()), StructField("m", LongType()), *(StructField(c, DoubleType()) for c in _NUMBERS)])


def _told(piece: pa.Table, seed: int, replicate: np.ndarray, m: np.ndarray) -> pa.Table:
    """Of a range and each replicate: sums of the drawn values less the cell's mean and of their squares, and their ends; quartiles too where the range is the whole cell."""
    head = piece.slice(0, 1).to_pylist()[0]
    v = _values(piece)
    d, whole = v - head["center"], head["n"] == len(v)
    columns = {c: np.full(len(m), np.nan) for c in _NUMBERS}
    both = np.column_stack([d, d * d])
    for part, w in _drawn(_own(seed, head["label"], head["block"], replicate), m, len(v)):
        hit = w > 0
        some = hit.any(1)
        columns["s1"][part], columns["s2"][part] = (w.astype(float) @ both).T
        columns["low"][part] = np.where(some, v[hit.argmax(1)], np.nan)
        columns["high"][part] = np.where(some, v[len(v) - 1 - hit[:, ::-1].argmax(1)], np.nan)
        if whole:
            columns["q25"][part], columns["q75"][part] = quartiles(v, w.cumsum(1))
    fixed = [pa.array(np.full(len(m), head[c])) for c in ("id", "block")]
    return pa.Table.from_arrays([*fixed, pa.array(replicate), pa.array(m), *(pa.array(columns[c], from_pandas=True) for c in _NUMBERS)], names=_FOUND.names)


def _of_large(counts: DataFrame, cells: DataFrame, seed: int, replicates: int, size: int, tasks: int) -> DataFrame:
    """id, replicate, n, sums, ends and quartiles of cells of several ranges.

    A first number deals each draw to a range, in tasks that see numbers of draws only; then each range draws among its own
    values, and the ranges that hold the ranks around each quartile draw again and tell their values.
    """
    place = counted_upto(counts.select("id", F.col("v").alias("__v"), F.col("c").alias("__c")), "id")
    before = F.col("__upto") - F.col("__c")
    split = place.select("id", F.col("__v").alias("v"), before.alias("before"), F.col("__upto").alias("upto"), F.explode(F.sequence(F.floor(before / size), F.floor((F.col("__upto") - 1) / size))).alias("block"))
    held = (F.least(F.col("upto"), (F.col("block") + 1) * size) - F.greatest(F.col("before"), F.col("block") * size)).alias("c")
    pieces = materialize(split.select("id", "block", "v", held)).join(cells, "id")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = shares(seed, r["label"], r["n"], size, r["replicate"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), r["id"])), pa.array(np.arange(len(m))), pa.array(np.full(len(m), r["replicate"])), pa.array(m)], names=["id", "block", "replicate", "m"])

    each = cells.select("id", "label", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))).alias("replicate")).repartition(tasks)
    share = materialize(each.mapInArrow(deal, "id long, block long, replicate long, m long"))

    def draw(piece: pa.Table, own: pa.Table) -> pa.Table:
        return _told(piece, seed, own.column("replicate").to_numpy(), own.column("m").to_numpy())

    key = ["id", "block"]
    side = lambda df: df.repartition(tasks, *key).groupBy(*key)
    ranges = materialize(side(pieces).cogroup(side(share)).applyInArrow(draw, _FOUND).drop("q25", "q75"))
    upto, n = "sum(m) OVER (PARTITION BY id, replicate ORDER BY block)", "sum(m) OVER (PARTITION BY id, replicate)"
    spans = ranges.selectExpr("id", "block", "replicate", "m", f"{upto} - m AS before", f"{upto} AS upto", f"({n} - 1) * 0.25D AS h25", f"({n} - 1) * 0.75D AS h75")
    ranks = F.array(*(F.struct(F.lit(f"{q}{s}").alias("name"), f(F.col(f"h{q}")).cast("long").alias("rank")) for q in (25, 75) for s, f in (("a", F.floor), ("b", F.ceil))))
    asks = spans.select(*key, "replicate", "m", "before", "upto", F.explode(ranks).alias("ask")).where("ask.rank >= before AND ask.rank < upto")
    asks = asks.select(*key, "replicate", "m", F.expr("ask.name AS name"), F.expr("ask.rank - before AS rank"))  # at most four a replicate

    def tell(piece: pa.Table, asked: pa.Table) -> pa.Table:
        if not (piece.num_rows and asked.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "replicate": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "v": pa.array([], pa.float64())})
        head, v = piece.slice(0, 1).to_pylist()[0], _values(piece)
        replicate, m, rank = (asked.column(c).to_numpy() for c in ("replicate", "m", "rank"))
        one, first, back = np.unique(replicate, return_index=True, return_inverse=True)
        found = np.zeros(len(rank))
        for part, w in _drawn(_own(seed, head["label"], head["block"], one), m[first], len(v)):
            upto = w.cumsum(1)
            for i in np.flatnonzero((back >= part.start) & (back < part.stop)):
                found[i] = v[min(np.searchsorted(upto[back[i] - part.start], rank[i], side="right"), len(v) - 1)]
        return pa.table({"id": pa.array(np.full(len(rank), head["id"])), "replicate": pa.array(replicate), "name": asked.column("name"), "v": pa.array(found)})

    of = lambda name: F.max(F.when(F.col("name") == name, F.col("v"))).alias(f"v{name}")
    found = side(pieces).cogroup(side(asks)).applyInArrow(tell, "id long, replicate long, name string, v double").groupBy("id", "replicate").agg(*map(of, ("25a", "25b", "75a", "75b")))
    sums = ranges.groupBy("id", "replicate").agg(F.sum("m").alias("m"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.min("low").alias("low"), F.max("high").alias("high"))
    h = lambda q: (F.col("m") - 1) * F.lit(q / 100)
    share_ = lambda q: h(q) - F.floor(h(q))
    return sums.join(found, ["id", "replicate"]).select("id", "replicate", "m", *_STATS, *(((1 - share_(q)) * F.col(f"v{q}a") + share_(q) * F.col(f"v{q}b")).alias(f"q{q}") for q in (25, 75)))


def bootstrap(df: DataFrame, cfg: Sequence[str], row_id: str, metrics: Sequence[MetricSpec], seed: int, replicates: int = 5000, size: int = VALUES) -> DataFrame:
    """IQR % and std % of each cell's resamples with replacement, at its own number of values; undefined below two.

    Equal values are counted once, before the first shuffle. A cell of up to ``size`` values is one range; larger ones are cut into
    ranges, to which a first number deals each draw. A range draws among its own values and sends on counts, sums and ends;
    where a quartile lies is read from the counts, and the range that holds it draws again. So what is shuffled grows with distinct
    values, ranges and replicates, not with the draws, and a task holds one range. Null levels are levels; cells without a value have no row.
    """
    keys = [*cfg, "metric"]
    wide = materialize(df.select(*cfg, *(F.when(F.col(m.eligible), F.col(m.value)).cast("double").alias(f"__{i}") for i, m in enumerate(metrics))))
    pairs = F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(f"__{i}").alias("v")) for i, m in enumerate(metrics)))
    rows = wide.select(*cfg, F.explode(pairs).alias("__m")).select(*cfg, "__m.metric", "__m.v").where("v IS NOT NULL")
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("center"))
    cells = materialize(cells.select(cell_key(keys).alias("cell"), "n", "center", cell_label(keys).alias("label")).withColumn("id", F.monotonically_increasing_id()))
    numbered = rows.withColumn("cell", cell_key(keys)).join(cells.select("cell", "id"), "cell")
    known = cells.select("id", "n", "center", "label")
    counts = numbered.groupBy("id", "v").agg(F.count(F.lit(1)).alias("c"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    everyone = np.arange(1, replicates + 1)

    def draw(piece: pa.Table) -> pa.Table:
        return _told(piece, seed, everyone, np.full(replicates, piece.column("n")[0].as_py()))

    small = counts.join(known.where(F.col("n") <= size), "id").withColumn("block", F.lit(0).cast("long"))
    out = small.repartition(tasks, "id").groupBy("id").applyInArrow(draw, _FOUND).drop("block")
    large = known.where(F.col("n") > size)
    if large.limit(1).count():
        out = out.unionByName(_of_large(counts.join(large.select("id"), "id"), large, seed, replicates, size, tasks))
    stats = out.join(cells.select("id", "cell", "center"), "id")
    n, mean = F.col("m"), F.col("center") + F.col("s1") / F.col("m")
    spread = F.sqrt(F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / n) / F.when(n > 1, n - 1), F.lit(0.0)))
    std = F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(spread)
    two = n >= 2
    return stats.select("cell.*", "replicate", F.when(two, percent(F.col("q75") - F.col("q25"), mean)).alias("iqr_pct"), F.when(two, percent(std, mean)).alias("std_pct"))
