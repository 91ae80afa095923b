"""Resampling of documents towards a target distribution, by the gains of hashed word features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evenkeel.llm.shared import gapless_rank, materialize

#: Lower-cases A-Z; ASCII bytes that are neither letters nor digits part words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text whose words share a dictionary; a longer text has one of its own.
SLICE_BYTES = 2_000_000
#: The reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320


def _times(columns: list[int], v: int) -> int:
    """A 32 by 32 bit matrix, as its columns, times a vector."""
    out = 0
    for c in columns:
        if v & 1:
            out ^= c
        v >>= 1
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """Four tables of 256: what 2 ** power zero bytes do to a checksum, by its bytes."""
    columns = [POLYNOMIAL, *(1 << b for b in range(31))]  # one zero bit
    for _ in range(power + 3):
        columns = [_times(columns, c) for c in columns]
    return np.array([[_times(columns, v << shift) for v in range(256)] for shift in (0, 8, 16, 24)], np.uint32)


def combined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of joined strings, from those of their parts and the length of the second part in bytes."""
    out = first.astype(np.uint32)
    for power in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> power & 1)
        table, v = _zeros(power), out[on]
        out[on] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
    return out ^ second


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WordDictionary:
    """Distinct words between delimiters; each carries its own checksum, that of the word behind a blank, and that one's length."""

    def __init__(self, words: set[bytes]):
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()
        self.alone = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.behind = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([len(w) + 1 for w in words], np.int64)

    def scan(self, words: list[bytes]) -> np.ndarray:
        """Payload numbers in the order of the words; a match begins at the delimiter that ends the one before."""
        text = " " + b" ".join(words).decode("latin-1") + " "
        return np.fromiter((i for _, i in self.automaton.iter(text)), np.int64, len(words))


def feature_buckets(texts: list[list[bytes]], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts: runs of 1 to ``longest`` consecutive words of one text."""
    words = [w for t in texts for w in t]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = WordDictionary(set(words))
    at = known.scan(words)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    sums = known.alone[at]
    owners, found = [owner], [sums]
    for n in range(2, longest + 1):
        last = at[n - 1 :]
        sums = combined(sums[: len(last)], known.behind[last], known.length[last])
        inside = owner[: len(last)] == owner[n - 1 :]
        owners.append(owner[: len(last)][inside])
        found.append(sums[inside])
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % buckets


def _slices(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) for rows that share a dictionary."""
    first, texts, held = 0, [], 0
    for row, body in enumerate(column):
        text = body.as_py() or ""
        if texts and held + len(text) > SLICE_BYTES:
            yield first, texts
            first, texts, held = row, [], 0
        texts.append(split_words(text))
        held += len(text)
    yield first, texts


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket; tasks and then one shuffle add them up, ``buckets`` numbers reach the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                total += np.bincount(feature_buckets(texts, longest, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(text).mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's smoothed log ratio of target to corpus, in floored thousandths."""
    n, of_corpus, of_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_corpus / ((s + 1.0) * of_target))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64).reshape(n)


def weights(df: DataFrame, key: str, text: str, gain: np.ndarray, longest: int) -> DataFrame:
    """key, n_words, n_features and weight, the sum of the features' gains."""
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in _slices(batch.column(1)):
                owner, bucket = feature_buckets(texts, longest, len(gain))
                part = slice(first, first + len(texts))
                n_words[part] = [len(t) for t in texts]
                n_features[part] = np.bincount(owner, minlength=len(texts))
                np.add.at(weight[part], owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight))], names=schema.names)

    return df.select(key, text).mapInArrow(rows, schema)


def resample(df: DataFrame, key: str, text: str, target: DataFrame, target_text: str, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """One row per row of df: key, n_features, weight, score, rank.

    ``score`` is the weight with Gumbel noise of seed and key; of the N rows with ``least_words`` words or more, the
    floor(percent * N / 100) of the highest scores are drawn and numbered from 1 in ``rank``, ties to the lesser key; the rank of
    others is null. Null and empty texts have no features, weight 0 and no rank; long ones count whole; a null key takes
    the noise of an empty one and comes first among ties; repeated rows are drawn each for itself; other columns are left
    out; without a target every feature weighs as if the target were uniform; an empty df gives no rows.
    """
    gain = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = materialize(weights(df, key, text, gain, longest).withColumn("score", F.col("weight") + noise).withColumns({"__short": F.col("n_words") < least_words, "__loss": -F.col("score")}))
    drawn = percent * scored.where("NOT __short").count() // 100
    placed = gapless_rank(scored, [], ["__short", "__loss", key], "__place", 1)
    rank = F.when(~F.col("__short") & (F.col("__place") < drawn), F.col("__place") + 1)
    return placed.select(key, "n_features", "weight", "score", rank.alias("rank"))
