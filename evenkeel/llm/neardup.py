"""Near-duplicate documents by bottom-k sketches of one hash function, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from evenkeel.llm.components import components
from evenkeel.llm.shared import join_split, kept, materialize, scratch

SHINGLE = 5
#: Least hashes kept of each set, and how many of them are looked up in inverted lists.
SKETCH, LOOKED_UP = 64, 20
#: Standard deviations below the threshold at which an estimate still counts as near.
SLACK = 5.5
#: Rounds in which the members of each list meet one of them; lists that span several components go on.
ROUNDS = 2
#: Lists up to this length are paired in full where they span components.
SHORT_LIST = 32
#: Ratio of the sizes in one size class.
SIZE_STEP = 1.04
#: Longs of a set's bitmap, in which each value turns one bit over.
BITMAP = 8
#: Words whose hashes a worker keeps.
CACHED_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's five-word shingles; of all its words if they are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return np.empty(0, np.int64)
    n, mixed = len(h) - width + 1, np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Bits of two sets differ in at most as many places as the sets have values that only one of them holds."""
    odd = np.bincount(values & (64 * BITMAP - 1), minlength=64 * BITMAP).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").astype(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _mapped(df: DataFrame, key: str, text: str, whole: bool) -> DataFrame:
    """key, n, print and the sketch, or with whole the whole set and its bitmap."""
    schema = StructType([StructField("key", df.schema[key].dataType), StructField("n", LongType()), StructField("print", BinaryType()), StructField("values", ArrayType(LongType()))])
    if whole:
        schema = schema.add("bits", ArrayType(LongType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets if whole else [s[:SKETCH] for s in sets]), *([_lists([bitmap(s) for s in sets])] if whole else [])],
                    names=schema.names,
                )

    return df.select(F.col(key), F.col(text)).mapInArrow(rows, schema)


def _least_share(percent: int, drawn: int) -> float:
    """The share of common hashes, of so many drawn, that a pair at the threshold has but for one chance in 10 million."""
    return max(0.0, percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / drawn) ** 0.5)


def _near_enough(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (low, high) whose sizes allow a link and whose union sketch has enough common values."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("values").alias(f"v_{end}"))
    both = pairs.join(side("high"), "high").join(side("low"), "low").where(_near_enough(F.col("n_low"), F.col("n_high"), percent))
    union = F.slice(F.array_sort(F.array_union("v_low", "v_high")), 1, SKETCH)
    common = F.array_intersect(F.array_intersect(union, "v_low"), "v_high")
    return both.where(F.size(common) >= _least_share(percent, SKETCH) * F.size(union)).select("low", "high")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar. The sets of high come first: they make a hub's rows wide, so that Spark sees and splits them."""
    side = lambda end: sets.select(F.col("node").alias(end), F.col("values").alias(f"s_{end}"))
    both = pairs.join(side("high"), "high").join(side("low"), "low")
    common = F.size(F.array_intersect("s_low", "s_high"))
    return both.where(100 * common >= percent * (F.size("s_low") + F.size("s_high") - common)).select("low", "high")


def _similar(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return materialize(_verified(_estimated(pairs, nodes, percent), sets, percent))


def _long_list_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (low, high) of different roots, a superset of the similar ones: an exact prefix join of whole sets.

    sets: node, root, values (the whole set). One order holds for all values: those of a single root first, then from
    rare to frequent. The first value that a similar pair shares then lies within the first n - ceil(t n) + 1 of
    the larger set and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller, and what follows it on either side
    bounds what they share, and so do their bitmaps. Lists are dealt by value and size of the smaller set; the members of a list's most frequent
    root meet only those of other roots.
    """
    p, bits = percent, [f"bits_{i}" for i in range(BITMAP)]
    node = ["node", "root", "n", *bits]
    values = sets.select("node", "root", F.size("values").alias("n"), *(F.get("bits", F.lit(i)).alias(c) for i, c in enumerate(bits)), F.explode("values").alias("value"))
    of_root = values.groupBy("value", "root").agg(F.count(F.lit(1)).alias("__c"))
    spans = of_root.groupBy("value").agg(F.sum("__c").alias("rows"), F.max_by("root", F.struct("__c", "root")).alias("main"), F.count(F.lit(1)).alias("__roots")).where("__roots > 1").drop("__roots")
    shared = join_split(values, spans, "value", "rows")
    of_node = Window.partitionBy("node")  # at most the values of one text
    placed = shared.withColumn("place", F.col("n") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("rows", "value")))
    prefix = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * p / F.lit(100)) + 1)
    prefix = materialize(prefix.select(*node, "value", "place", (F.col("root") == F.col("main")).alias("is_main")))

    size_class = lambda size: F.floor(F.ln(size) / math.log(SIZE_STEP)).cast("int")
    small = prefix.where(F.col("place") <= F.col("n") - F.ceil(2 * p * F.col("n") / F.lit(100 + p)) + 1).withColumn("class", size_class(F.col("n")))
    small = small.select("value", "class", *(F.col(c).alias(f"{c}_a") for c in (*node, "place", "is_main")))
    largest = F.least(F.col("n"), (100 + p) * (F.col("n") - F.col("place") + 1) / F.lit(p) - F.col("n"))  # of the smaller sets that can still share enough
    large = prefix.withColumn("least", F.col("n") * p / F.lit(100)).withColumn("largest", largest).where("largest >= least")
    large = large.withColumn("class", F.explode(F.sequence(size_class(F.col("least")) - 1, size_class(F.col("largest")) + 1))).drop("least", "largest")
    left = lambda c: F.col(f"{c}_a")
    fits = (100 * left("n") >= p * F.col("n")) & ((left("n") < F.col("n")) | ((left("n") == F.col("n")) & (left("node") < F.col("node")))) & (left("root") != F.col("root"))
    fits &= (100 + p) * (F.least(left("n") - left("place"), F.col("n") - F.col("place")) + 1) >= p * (left("n") + F.col("n"))
    apart = sum((F.bit_count(left(c).bitwiseXOR(F.col(c))) for c in bits), F.lit(0))
    fits &= (100 + p) * (left("n") + F.col("n") - apart) >= 2 * p * (left("n") + F.col("n"))
    ends = F.least(left("node"), F.col("node")).alias("low"), F.greatest(left("node"), F.col("node")).alias("high")
    meet = lambda a, b: a.join(b, ["value", "class"]).where(fits).select(*ends)
    return meet(small.where("NOT is_main_a"), large).union(meet(small.where("is_main_a"), large.where("NOT is_main"))).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """One row per row of df: key, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id
    is the least key that a document reaches, kept says that it is the key itself. Equal sets form one
    class, which goes on as one node. A node whose retained values are mostly its own has no links.
    The others are looked up: in each of ROUNDS, the members of a list that spans several components meet one of them (first the
    most typical, whose lists are longest, then any), are estimated on union
    sketches and verified on whole sets, so large groups of near copies join without being paired. Lists that still span several are then paired in
    full if short; documents whose long lists alone can make a link meet by an exact prefix join of their
    whole sets, so no list is paired as its square. A pair is missed only if its
    sketches don't meet, with a probability of at most 1e-5 for a pair at the threshold.

    A text without words, or null, has no shingles and no links; so has a row without a key, whose
    component_id is null and which is kept. Repeated rows share a component. Rows of one key with different texts are
    separate nodes and may differ in component. Other columns are left out; an empty df gives no rows.
    """
    with scratch(df.sparkSession):
        return kept(_near_duplicates(df, key, text, percent))


def _near_duplicates(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    documents = materialize(_mapped(df, key, text, whole=False))
    live = documents.where("n > 0 AND key IS NOT NULL")
    classes = live.groupBy("print").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("values").alias("values"))
    nodes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))

    values = nodes.select("node", "n", F.explode(F.slice("values", 1, LOOKED_UP)).alias("value"))
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    shared = join_split(values, shared, "value", "length")
    suspects = shared.groupBy("node", "n").count().where(F.col("count") >= _least_share(percent, LOOKED_UP) * F.least("n", F.lit(LOOKED_UP))).select("node")
    suspects = materialize(nodes.join(suspects, "node", "left_semi"))
    texts = df.join(suspects.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    sets = _mapped(texts, key, text, whole=True).join(suspects.select("print", "node"), "print").groupBy("node").agg(F.first("values").alias("values"), F.first("bits").alias("bits"))
    sets = materialize(sets)

    values = suspects.select("node", F.explode(F.slice("values", 1, LOOKED_UP)).alias("value"))
    lengths = values.groupBy("value").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    lists = materialize(join_split(values, lengths, "value", "length"))
    typical = lists.groupBy("node").agg(F.sum("length").alias("shared"))
    lists = materialize(lists.join(typical, "node").withColumn("root", F.col("node")))
    rooted = None
    for turn in range(ROUNDS):
        by = F.xxhash64("node", "value", F.lit(turn)) if turn else F.struct("shared", "node")
        centers = lists.groupBy("value").agg(F.count(F.lit(1)).alias("__rows"), F.max_by(F.struct("node", "root"), by).alias("center"), F.min("root").alias("__a"), F.max("root").alias("__b")).where("__a < __b")
        met = join_split(lists, centers.drop("__a", "__b"), "value", "__rows").where("root != center.root")
        links = _similar(met.select(F.col("center.node").alias("low"), F.col("node").alias("high")).distinct(), suspects, sets, percent)
        rooted = components(links if rooted is None else rooted.select("root", "node").union(links), *(("low", "high") if rooted is None else ("root", "node")))
        lists = materialize(lists.drop("root").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")))

    long_ = lists.where(F.col("length") > SHORT_LIST)
    counts = long_.groupBy("node").agg(F.count(F.lit(1)).alias("long"))
    spans = lists.groupBy("value").agg(F.min("root").alias("__a"), F.max("root").alias("__b"), F.first("length").alias("size")).where("__a < __b")
    spanning = materialize(join_split(lists, spans.select("value", "size"), "value", "size"))
    short = spanning.where(F.col("length") <= SHORT_LIST).select("value", "node", "root")
    other = short.select("value", F.col("node").alias("node_b"), F.col("root").alias("root_b"))
    pairs = short.join(other, "value").where("node < node_b AND root != root_b").select(F.col("node").alias("low"), F.col("node_b").alias("high"))
    looked_up = suspects.select("node", F.least(F.size("values"), F.lit(LOOKED_UP)).alias("looked_up"))
    common = counts.join(looked_up, "node").where(F.col("long") >= _least_share(percent, LOOKED_UP) * F.col("looked_up")).select("node")
    common = common.join(spanning.where(F.col("length") > SHORT_LIST).select("node").distinct(), "node", "left_semi")
    common = materialize(sets.join(common, "node").join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "values", "bits"))
    last = _similar(pairs.union(_long_list_pairs(common, percent)).distinct(), suspects, sets, percent)
    rooted = components(rooted.select("root", "node").union(last), "root", "node")

    named = nodes.select("node", "print", "key").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("key").alias("component_id"))
    of_print = named.select("print", "root").join(names, "root").select("print", "component_id")
    out = live.select("key", "n", "print").join(of_print, "print").select("key", "n", "component_id")
    rest = documents.where("NOT (n > 0 AND key IS NOT NULL)").select("key", "n", F.col("key").alias("component_id"))
    return out.union(rest).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
