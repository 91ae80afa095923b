"""Quality rules: a threshold table compiled into one projection of Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.shared import bind

#: Characters that end a word, and those that count as symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Words that running text of a language is full of.
STOP_WORDS = (
    "the and of to in that is was for with are a an this from "  # English
    "der die und das den von ist im auf mit nicht ein eine zu für "  # German
    "le la les et des une est dans pour que un de du avec sur "  # French
    "el los las que y por con una para se del en lo al es"  # Spanish
).split()
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]
#: Shorter texts need not hold stop words.
STOP_LEAST_WORDS = 100
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text whose metric is outside [least, most] is rejected; a null metric passes."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", most=1_000_000),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbol_percent", most=2),
    Rule("stop_percent", least=2),
    Rule("echo_percent", most=25),
    Rule("dup_line_percent", most=50),
)


def _repeated(words: Column) -> Column:
    """How many words lie in windows of REPEAT_WINDOW words that occur twice or more.

    Windows are compared by a 64-bit hash, made of the hashes of their halves, quarters and words. Texts without an equal pair of windows
    need one hash set; only the others sort their windows.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(rows: Column) -> Column:
            same = lambda x, i: F.coalesce(x["h"] == F.get(rows, i)["h"], F.lit(False))
            twice = F.filter(rows, lambda x, i: same(x, i - 1) | same(x, i + 1))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

            def add(s: Column, i: Column) -> Column:
                end = i + REPEAT_WINDOW
                return F.struct(end.alias("end"), (s["n"] + end - F.greatest(s["end"], i)).alias("n"))

            return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), zero, add, lambda s: s["n"])

        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(rows, of_sorted))

    def paired(step: int):
        """From hashes of spans to those of spans of twice the length, where the second begins step later."""
        return lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step))), 1, F.greatest(F.size(h) - step, F.lit(0)))

    pairs = bind(F.transform(words, lambda w: F.xxhash64(w)), paired(1))
    hashes = bind(bind(pairs, paired(2)), paired(4))
    return F.when(F.size(words) <= REPEAT_WINDOW, F.lit(0)).otherwise(bind(hashes, covered))


def metrics(text: Column) -> Column:
    """A struct of the base counts of a text and of the metrics that rules name. A null text has no words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     "))) > 0)

    def of_parts(parts: Column) -> Column:
        return bind(F.array_remove(parts, ""), lambda words: of_words(words, F.char_length(text) - F.size(parts) + 1))

    def of_words(words: Column, chars: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_echo_words"),
        )

    return bind(F.split(text, SPACE), of_parts)


def _compiled(counts: Column) -> dict[str, Column]:
    share = lambda part, whole: F.try_divide(100 * part, whole)
    n = counts["n_words"]
    return {
        "n_words": n,
        "mean_word_chars": F.try_divide(counts["word_chars"], n),
        "symbol_percent": share(counts["n_symbols"], counts["word_chars"]),
        "stop_percent": F.when(n >= STOP_LEAST_WORDS, share(counts["n_stop_words"], n)),
        "echo_percent": share(counts["n_echo_words"], n),
        "dup_line_percent": share(counts["lines"]["dup"], counts["lines"]["all"]),
    }


def rejected(counts: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule of the table rejects these counts."""
    measured = _compiled(counts)
    verdict = F.lit(False)
    for rule in rules:
        value = measured[rule.metric]
        if rule.least is not None:
            verdict = verdict | F.coalesce(value < rule.least, F.lit(False))
        if rule.most is not None:
            verdict = verdict | F.coalesce(value > rule.most, F.lit(False))
    return verdict


def judge(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """Adds the struct ``into``: the base counts, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of words in repeated 8-word windows. kept: not
    base_failed, and no rule rejects. Null and empty texts have no words, so they fail. Rows are judged
    one by one, so ties, repeated rows and other columns change nothing; a column of df named
    ``into`` is replaced; an empty df stays empty.
    """
    with_counts = df.withColumn(into, metrics(F.col(text)))
    counts = F.col(into)
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    return with_counts.withColumn(
        into,
        F.struct(
            *(counts[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")),
            counts["lines"]["dup"].alias("n_dup_lines"),
            counts["n_repeat_words"].alias("n_repeat_words"),
            counts["n_stop_words"].alias("n_stop_words"),
            counts["n_echo_words"].alias("n_echo_words"),
            counts["lines"]["all"].alias("n_lines"),
            failed.alias("base_failed"),
            (~failed & ~rejected(counts, rules)).alias("kept"),
        ),
    )
