"""Periodic runs of words: Lyndon arrays from the first phase of Baier's suffix sorter, under both orders of the alphabet,
whose Lyndon roots are extended into runs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Least length of a run, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that a comparison looks at first; it goes on with twice as many.
STRIDE = 32
#: Rounds of cutting at rare words, and characters of output that a worker holds back.
ROUNDS, SLICE_CHARS = 8, 8_000_000

#: (start, length, period), counted in words from 0.
Run = tuple[int, int, int]
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; ASCII white space and nothing else parts them."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int]]:
    """The group of each position, and the length of each group's word.

    Two positions share a group if and only if the longest Lyndon words that begin there are equal, so the length of a
    position's group is its entry in the Lyndon array. Groups are taken from the greatest to the least. Each member of the
    group at hand points to the nearest position before it in a lower group; a position that k members point to moves
    to a group just above its own, whose word is its old one followed by k times the word at hand.
    """
    places: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        places.setdefault(s, []).append(i)
    members = [places[s] for s in sorted(places)]
    group = [0] * len(symbols)
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left = list(range(len(symbols) + 1))  # followed from i, it ends one after the nearest position before i that is in a lower group
    at = len(members) - 1
    while at >= 0:
        live = [i for i in members[at] if group[i] == at]
        for i in live:
            left[i + 1] = i
        pointers: dict[int, int] = {}
        for i in live:
            end = left[i]
            while left[end] != end:
                end = left[end]
            while left[i] != end:
                left[i], i = end, left[i]
            if end:
                pointers[end - 1] = pointers.get(end - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, k in pointers.items():
            moves.setdefault((k, group[j]), []).append(j)
        for k, old in sorted(moves, reverse=True):
            new = len(members)
            members.append(moves[k, old])
            for j in members[new]:
                group[j] = new
            length.append(length[old] + k * length[at])
            upper = above[old]
            below.append(old)
            above.append(upper)
            above[old] = new
            if upper < new:
                below[upper] = new
        at = below[at]
    return group, length


def extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b have in common at their beginnings."""
    n, at, stride = min(len(a), len(b)), 0, STRIDE
    while at < n:
        differ = a[at : at + stride][: n - at] != b[at : at + stride][: n - at]
        if differ.any():
            return at + int(differ.argmax())
        at, stride = at + stride, 2 * stride
    return n


def _runs(symbols: np.ndarray, least_words: int, least_periods: int) -> set[Run]:
    """The runs of symbols from 0 to k. Roots that follow each other are positions of one group, a word's length apart; the
    first is extended to both sides. A run of three periods or more holds two roots at least, a shorter one may hold one."""
    found: set[Run] = set()
    n, at = len(symbols), np.arange(len(symbols))
    for ordered in (symbols, int(symbols.max(initial=0)) - symbols):
        group, length = (np.array(x) for x in lyndon_groups(ordered.tolist()))
        root = length[group]
        after, before = at + root, at - root
        repeats = (after < n) & (group[np.minimum(after, n - 1)] == group)
        heads = np.flatnonzero((repeats | (least_periods < 3)) & ~((before >= 0) & (group[np.maximum(before, 0)] == group)))
        for i, p in zip(heads.tolist(), root[heads].tolist()):
            back = extension(symbols[:i][::-1], symbols[: i + p][::-1])
            total = back + p + extension(symbols[i:], symbols[i + p :])
            if total >= max(least_words, least_periods * p):
                found.add((i - back, total, p))
    return found


def stretches(ids: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, dense ids) of the stretches that can hold a run: every word of a run occurs in it as often as its period does, so
    words that occur less often in a stretch cut it. After ROUNDS cuts a stretch is taken as it is."""
    todo = [(0, len(ids), ROUNDS)]
    while todo:
        lo, hi, rounds = todo.pop()
        if hi - lo < least_words:
            continue
        _, dense, counts = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[dense] < least_periods)
        if not rare.size or not rounds:
            yield lo, dense
            continue
        ends = [-1, *rare.tolist(), hi - lo]
        todo += [(lo + a + 1, lo + b, rounds - 1) for a, b in zip(ends, ends[1:]) if b - a > least_words]


def find_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs by start, then period: stretches with a smallest period, of the least length, that no neighbouring word extends."""
    if len(words) < least_words:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = [(lo + s, n, p) for lo, dense in stretches(ids, least_words, least_periods) for s, n, p in _runs(dense, least_words, least_periods)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, n, p in runs:
        change[start + p] += 1
        change[start + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the greatest exponent; ties to the least start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(key: object, words: list[bytes]) -> list[bytes]:
    """The words with a period that the key's checksum decides: the tail of every tenth text repeats."""
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if key is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def periodic_runs(df: DataFrame, key: str, text: str, rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of df: key, n_words, runs (start, length, period by start, then period), strongest, collapsed.

    ``strongest`` is the run of the greatest exponent, null without runs; ``collapsed`` holds the words that no run contains
    after its first period, joined by one blank. ``rewrite``, where given, gets key and words and returns the words to search.
    Null and empty texts have no words, no runs and an empty ``collapsed``; long ones are searched whole, in memory and time
    that grow with their words; rows are searched one by one, so ties, repeats and other columns change nothing; a null
    key is kept; an empty df gives no rows.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)), StructField("strongest", _RUN), StructField("collapsed", StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
            counts, runs, best, rest = zip(*out) if out else ((), (), (), ())
            as_dict = lambda r: r and dict(zip(("start", "length", "period"), r))
            columns = [keys, pa.array(counts, pa.int64()), pa.array([[as_dict(r) for r in x] for x in runs], pa.list_(_ARROW_RUN)), pa.array(map(as_dict, best), _ARROW_RUN), pa.array(rest, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            out, first, chars = [], 0, 0
            for i, (k, body) in enumerate(zip(batch.column(0), batch.column(1))):
                words = words_of(body.as_py())
                if rewrite:
                    words = rewrite(k.as_py(), words)
                runs = find_runs(words, least_words, least_periods)
                out.append((len(words), runs, strongest(runs), b" ".join(collapse(words, runs)).decode("utf-8", "replace")))
                chars += len(out[-1][3])
                if chars > SLICE_CHARS:
                    yield made(batch.column(0).slice(first, len(out)), out)
                    out, first, chars = [], i + 1, 0
            yield made(batch.column(0).slice(first, len(out)), out)

    return df.select(key, text).mapInArrow(rows, schema)
