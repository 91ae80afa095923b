"""Token counts of a unigram tokenizer, by a Viterbi pass that carries counts instead of pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: The mark that replaces a blank and begins a word, and what an unknown character scores below the worst piece.
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker keeps, and the longest of them.
CACHED_WORDS, CACHED_CHARS = 600_000, 40


class UnigramCounter:
    """Counts the tokens that a unigram tokenizer with blank marks gives: best total score; of equal ones the path
    whose last piece begins first; neighbouring unknown characters are one token."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def _word(self, word: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        known = bytearray(len(word))
        for end, (n, score) in self.automaton.iter(word):
            ends[end].append((n, score))
            if n == 1:
                known[end] = 1
        best, count, unknown = [0.0], [0], [False]
        for end, matches in enumerate(ends):
            matches.sort(reverse=True)  # the earliest start first; a later one must score more
            top, start = None, -1
            for n, score in matches:
                total = score + best[end + 1 - n]
                if top is None or total > top:
                    top, start = total, end + 1 - n
            lone = not known[end] and ((total := self.unknown + best[end]) > top if top is not None else True)
            if lone:
                top, start = self.unknown + best[end], end
            best.append(top)
            count.append(count[start] + (not (lone and unknown[start])))
            unknown.append(lone)
        return count[-1]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        total, cache = 0, self.cache
        for word in marked.removeprefix(MARK).split(MARK):
            n = cache.get(word)
            if n is None:
                n = self._word(MARK + word)
                if len(word) <= CACHED_CHARS:
                    if len(cache) >= CACHED_WORDS:
                        cache.clear()
                    cache[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> tuple[tuple[str, float], ...]:
    """The pieces and scores of a public sentencepiece file, without its control, unknown and byte entries."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return tuple((m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))


@lru_cache(maxsize=2)
def counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(list(vocabulary(model_file)))


def token_counts(df: DataFrame, key: str, text: str, model_file: str) -> DataFrame:
    """One row per row of df: key, n_tokens, n_chars, for whole texts.

    Null and empty texts have no tokens. Rows are counted one by one, so ties, repeats and other
    columns change nothing; a null key is kept; an empty df gives no rows.
    """
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("n_tokens", LongType()), StructField("n_chars", LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for batch in batches:
            n = [(count(t.as_py() or ""), len(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in n], pa.int64()) for i in (0, 1))], names=schema.names)

    return df.select(key, text).mapInArrow(rows, schema)
