"""From documents to training sequences, in five stages that each hand on a written table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontamination, neardup, packing, quality, secretscan
from evenkeel.llm.shared import kept, materialize, scratch

SIMILAR_PERCENT, SEQUENCE = 80, 1024


def _free(docs: DataFrame, name: str) -> str:
    """The name, made longer until docs has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _all(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules reject, row by row.

    Null and empty texts have too few words and go; the longest are judged whole; ties and repeated rows are judged
    alike; nulls elsewhere and other columns, whatever their names, stay; an empty table stays empty.
    """
    into = _free(docs, "quality")
    return quality.judge(docs, "text", into=into).where(F.col(into)["kept"]).select(*_all(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that with the least doc_id, rows without one coming last.

    Of repeated rows, and of rows that tie in doc_id, any one stays. Rows are told apart by a number of their own, so
    a repeated or null doc_id takes no unrelated row along. Null and empty texts are near nothing and stay; long ones are
    compared whole; nulls elsewhere and other columns, whatever their names, stay; an empty table stays empty.
    """
    row = _free(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    keyed = numbered.select(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("key"), "text")
    gone = neardup.near_duplicates(keyed, "key", "text", SIMILAR_PERCENT).where("NOT kept").select(F.col("key.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*_all(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item (all words of a shorter one), row by row.

    Null and empty texts hold nothing and stay; long ones are searched whole; repeated rows go or stay alike; a null
    doc_id, nulls elsewhere and other columns, whatever their names, change nothing; no items or no documents are no error.
    """
    benchmark, into = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _free(docs, "contamination")
    marked = decontamination.mark(docs, "text", benchmark, "item_id", "text", into)
    return marked.where(F.size(F.col(into)["ends"]) == 0).select(*_all(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts, row by row; n_chars follows. No row goes.

    Null texts stay null, empty ones empty; long ones are read whole; a null source is no path; repeated rows are masked
    alike; nulls elsewhere and other columns, whatever their names, stay; an empty table stays empty.
    """
    into = _free(docs, "secret_scan")
    found = F.col(into)
    n_chars = F.when(found["secrets"] > 0, F.char_length(found["masked"]).cast("long")).otherwise(F.col("n_chars"))
    return secretscan.scan(docs, "text", "source", into).withColumns({"text": found["masked"], "n_chars": n_chars}).select(*_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of at most SEQUENCE ids, a row per piece.

    Null and empty texts take the end id alone; long ones are cut; ties and repeated rows are packed each for itself; a
    null doc_id is kept; other columns go; an empty table gives no rows.
    """
    return packing.pack(docs, "doc_id", "text", SEQUENCE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.ADDED)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("pack", pack)]

#: Tokens and models are no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what they write in between is removed, their result is a table of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = materialize(docs) if name != STAGES[-1][0] else kept(docs)
    return docs
