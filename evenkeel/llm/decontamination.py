"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from evenkeel.llm.shared import by_place, materialize

#: Bytes of item text in the index of a block, and blocks whose scans are chained after one pass for word frequencies.
BLOCK_BYTES, GROUP = 8 << 20, 4
#: Windows in a piece of an item; longer items are cut, so that no item outgrows a block.
PIECE_WINDOWS = 5000
#: Characters of document text, and candidate positions, that a worker handles at once.
SLICE_CHARS, CANDIDATES = 2_000_000, 2_000_000
#: Lower-cases A-Z; ASCII bytes that are neither letters nor digits end a word.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WindowIndex:
    """Windows of item words by their rarest word, the one prefix token that full containment needs."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], frequency: dict[bytes, int], width: int):
        self.width = width
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        rarity = np.array([frequency.get(w, 0) for w in self.vocabulary], np.int64)
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, ws in items:
            ids = [self.vocabulary[w] for w in ws]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.windows = np.full((len(owners), width), -1, np.int32)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.owners = [list(x) for x in owners.values()]
        for i, w in enumerate(owners):
            self.windows[i, : len(w)] = w
        frequencies = np.where(self.windows >= 0, rarity[self.windows] if len(rarity) else 0, np.iinfo(np.int64).max)
        #: For each window its places from the rarest word to the most frequent.
        self.places = np.argsort(frequencies, axis=1, kind="stable")
        prefix = self.windows[np.arange(len(owners)), self.places[:, 0]]
        self.by_prefix = np.argsort(prefix, kind="stable")
        counts = np.bincount(prefix, minlength=len(self.vocabulary))
        self.first, self.count = np.cumsum(counts) - counts, counts

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, windows) of all occurrences in word ids, where -1 stands for other words and between documents."""
        known = np.flatnonzero(ids >= 0)
        known = known[self.count[ids[known]] > 0]
        n = self.count[ids[known]]
        starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        cuts = np.append(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), CANDIDATES)), len(known))
        for a, b in zip(cuts, cuts[1:]):
            at, m = known[a:b], n[a:b]
            w = self.by_prefix[np.repeat(self.first[ids[at]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
            start = np.repeat(at, m) - self.places[w, 0]
            fits = (start >= 0) & (start + self.lengths[w] <= len(ids))
            start, w = start[fits], w[fits]
            for k in range(1, self.width):
                place = self.places[w, k]
                more = k < self.lengths[w]
                same = ~more | (ids[np.where(more, start + place, 0)] == self.windows[w, place])
                start, w = start[same], w[same]
            starts.append(start)
            found.append(w)
        return np.concatenate(starts), np.concatenate(found)


def _frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of the words in all documents; each task sends at most one row a word."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                total.update(filter(known.value.__contains__, words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def _pieces(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Distinct (item, body): the item's words, joined by blanks, cut so that each window is whole in one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, body in zip(batch.column(0), batch.column(1)):
                ws = words(body.as_py())
                out += [(item.as_py(), b" ".join(ws[at : at + PIECE_WINDOWS + width - 1])) for at in range(0, max(1, len(ws) - width + 1) if ws else 0, PIECE_WINDOWS)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["item", "body"])

    return items.select(F.col(key).cast("string").alias("item"), text).mapInArrow(cut, "item string, body binary").distinct()


FOUND = StructType([StructField("n_words", LongType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])


def _by_name(item: str | None) -> tuple[bool, str]:
    """Sorts items without a key last."""
    return item is None, item or ""


def _scan(df: DataFrame, index: WindowIndex, text: str, into: str) -> DataFrame:
    """df with an index's occurrences added to the struct column ``into``, which is made by the first scan."""
    sent = df.sparkSession.sparkContext.broadcast(index)
    text_at, again = df.columns.index(text), into in df.columns
    schema = df.schema if again else StructType([*df.schema, StructField(into, FOUND)])

    def found(texts: list[str | None], before: list[dict]) -> list[tuple]:
        index, out = sent.value, []
        split = [words(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in split])
        flat = np.full(sizes.sum(), -1, np.int32)
        begins = np.cumsum(sizes) - sizes
        for b, w in zip(begins, split):
            flat[b : b + len(w)] = np.fromiter(map(index.vocabulary.get, w, repeat(-1)), np.int32, len(w))
        start, window = index.occurrences(flat)
        order = np.argsort(start, kind="stable")
        start, window = start[order], window[order]
        ends = start + index.lengths[window]
        bounds = np.searchsorted(start, np.append(begins, len(flat)))
        for i, w in enumerate(split):
            a, b = bounds[i], bounds[i + 1]
            was = before[i] if before else {"starts": [], "ends": [], "items": []}
            spans = sorted([*zip(was["starts"], was["ends"]), *zip((start[a:b] - begins[i]).tolist(), (ends[a:b] - begins[i]).tolist())])
            merged: list[list[int]] = []
            for s, e in spans:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            items = {*was["items"], *(x for k in window[a:b] for x in index.owners[k])}
            out.append((len(w), [s for s, _ in merged], [e for _, e in merged], sorted(items, key=_by_name)))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars = [], 0
                for t in batch.column(text_at).slice(at):
                    texts.append(t.as_py())
                    chars += len(texts[-1] or "")
                    if chars >= SLICE_CHARS:
                        break
                part = batch.slice(at, len(texts))
                at += len(texts)
                columns = list(zip(*found(texts, part.column(part.num_columns - 1).to_pylist() if again else [])))
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
                new = pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(columns, kinds)], names=FOUND.names)
                yield pa.RecordBatch.from_arrays([*part.columns[: part.num_columns - again], new], names=schema.names)

    return by_place(df).mapInArrow(rows, schema)


def mark(docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, into: str, width: int = 10) -> DataFrame:
    """docs with the struct column ``into``, a name that docs doesn't have: n_words, starts, ends, items.

    A document word is hit if it lies inside an occurrence of ``width`` consecutive words of an item
    (of all its words, if they are fewer). starts and ends hold the hit ranges, items the keys of the items as
    strings. Windows are looked up by their rarest word over all documents and verified word by word,
    from rare to frequent. Items are sent in blocks of about BLOCK_BYTES; GROUP blocks take one pass over the documents
    for word frequencies and one for all their scans, without a shuffle.

    Null or empty texts have no words; items without words match nothing; those without a key hit
    words and are listed together as one null; equal items or rows count each for itself; no items or no
    documents are no error. Rows are handled one by one, whatever their other columns hold.
    """
    pieces = materialize(_pieces(items, item_key, item_text, width))
    total = pieces.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "body"), F.lit(blocks)))
    out = docs
    for first in range(0, blocks, GROUP):
        known: dict[int, list] = {b: [] for b in range(first, min(first + GROUP, blocks))}
        for r in pieces.where(F.col("block").isin(list(known))).collect():  # about GROUP * BLOCK_BYTES
            known[r["block"]].append((r["item"], bytes(r["body"]).split()))
        frequency = _frequencies(docs, text, {w for ps in known.values() for _, ws in ps for w in ws})
        for block in known.values():
            out = _scan(out, WindowIndex(block, frequency, width), text, into)
        if first + GROUP < blocks:
            out = materialize(out)
    return out


def n_hit(found: Column) -> Column:
    """The number of hit words of a column that ``mark`` made."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(found["ends"]) - total(found["starts"])


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, width: int = 10) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends, items; see ``mark``.

    The hash is of the keys, comma-joined; items without one count as one item. Other columns are left out.
    """
    marked = mark(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", items, item_key, item_text, "found", width)
    found = F.col("found")
    return marked.select(
        F.col("key").alias(key), found["n_words"].alias("n_words"), n_hit(found).alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"), (F.size(found["ends"]) > 0).alias("contaminated"), *(found[c].alias(c) for c in ("starts", "ends", "items")),
    )
