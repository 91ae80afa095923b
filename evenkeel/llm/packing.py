"""Packing of tokenized documents into sequences of a fixed length, by best-two-fit."""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import gapless_rank, materialize

#: The id that ends each document.
END_ID = 2
#: The added tokens of byte_bpe_50k.json, which the library finds in texts by default.
ADDED = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=2)
def encoder(ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """The byte-level BPE of a ranks file and added tokens; it gives the ids of the same vocabulary in the tokenizers library."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


#: White space as the tokenizer's pattern knows it, in runs too long for its backtracking.
_LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode(bpe, text: str) -> list[int]:
    """The ids of a text, added tokens included. A long run of white space is one piece by the pattern, but for its last character
    where something follows; it goes to the merges directly."""
    ids, at = [], 0
    for m in _LONG_BLANK.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += bpe.encode(text[at : m.start()], allowed_special="all")
        ids += bpe._encode_single_piece(text[m.start() : end])
        at = end
    return ids + bpe.encode(text[at:], allowed_special="all")


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of limit ids but the first, which takes what is left over."""
    first = n % limit or limit
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def token_pieces(df: DataFrame, key: str, text: str, limit: int, ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. Text that spells an added token gets its id. A null text is empty and has the end id alone."""
    from pyspark.sql.types import LongType, IntegerType, StructField, StructType

    kind = df.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32"))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_file, pattern, added)
        for batch in batches:
            rows, out = [], []
            for row, body in enumerate(batch.column(1)):
                ids = encode(bpe, body.as_py() or "")
                ids.append(END_ID)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                for piece, (start, length) in enumerate(cut(len(ids), limit)):
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return df.select(key, text).mapInArrow(pieces, schema)


def two_fit_plan(counts: dict[int, int], limit: int) -> list[tuple[int, Counter]]:
    """Bins as (how many, lengths in each) for so many pieces of each length up to limit.

    A bin is filled greedily with the longest pieces that fit; then its smallest piece gives way to
    the two unpacked ones that fill the widened gap best, if they fill more of it. A bin is repeated
    while all its lengths last, so the work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(limit + 1)
    plan = []
    while left.any():
        rest, gap, bin_ = left.copy(), limit, Counter()
        while gap and (fits := np.flatnonzero(rest[: gap + 1])).size:
            longest = int(fits[-1])
            n = min(int(rest[longest]), gap // longest)
            bin_[longest] += n
            rest[longest] -= n
            gap -= n * longest
        if gap:
            smallest = min(bin_)
            wide = gap + smallest
            below = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
            one = np.flatnonzero(rest[: wide + 1])
            other = below[np.minimum(one, wide - one)]
            alone = (other == one) & (rest[one] < 2)
            other = np.where(alone, below[np.maximum(one - 1, 0)], other)
            total = np.where(other > 0, one + other, 0)
            if total.size and total.max() > smallest:
                best = int(total.argmax())
                bin_ -= Counter({smallest: 1})
                bin_ += Counter([int(one[best]), int(other[best])])
        times = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= n * times
        plan.append((times, bin_))
    return plan


def places(plan: list[tuple[int, Counter]]) -> dict[int, list[tuple[int, int, int, int, list[int]]]]:
    """For each length: (first rank, rank after the last, pieces a bin, first bin, offsets in the bin)."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    bins = 0
    for times, bin_ in plan:
        offset = 0
        for length, n in sorted(bin_.items(), reverse=True):
            first = taken[length]
            taken[length] += n * times
            out.setdefault(length, []).append((first, taken[length], n, bins, [offset + length * i for i in range(n)]))
            offset += length * n
        bins += times
    return out


def pack(df: DataFrame, key: str, text: str, limit: int, ranks_file: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is tokenized, ended by id 2 and, if longer than limit, cut. Pieces of equal length
    are interchangeable, so the driver plans bins from the number of pieces of each length alone (at
    most ``limit`` numbers); a piece then finds its bin by its length and its rank within that length.
    Null texts are empty and take one id; equal rows are packed each for itself; a null key is kept as
    null; other columns are left out; an empty df gives no rows.
    """
    pieces = materialize(token_pieces(df, key, text, limit, ranks_file, pattern, added))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = list(places(two_fit_plan(counts, limit)).items())
    kind = "__length long, __uses array<struct<first:long,after:long,n:long,bin:long,offsets:array<long>>>"
    table = df.sparkSession.createDataFrame(rows, kind)
    ranked = gapless_rank(pieces, ["length"], [key, "piece", "start"], "__rank", limit)
    found = ranked.join(F.broadcast(table), F.col("length") == F.col("__length")).withColumn(  # at most limit rows
        "__use", F.get(F.filter("__uses", lambda u: (F.col("__rank") >= u["first"]) & (F.col("__rank") < u["after"])), F.lit(0))
    )
    turn = F.col("__rank") - F.col("__use.first")
    return found.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("__use.bin") + F.floor(turn / F.col("__use.n"))).cast("long").alias("sequence_id"),
        F.get(F.col("__use.offsets"), (turn % F.col("__use.n")).cast("int")).alias("offset"),
    )
