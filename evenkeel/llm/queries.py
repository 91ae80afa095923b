"""The queries opN_<name> over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontamination, importance, licenses, maintext, neardup, packing, periodic, pii, quality, secretscan, sharding, tokencount, warc

SHARDS, SEQUENCE, SIMILAR_PERCENT = 40, 1024, 85


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", SEQUENCE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.ADDED)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", SIMILAR_PERCENT)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    histories = warc.archive(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "history_place")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_findings"), "license_families")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "text", "source")
    scanned = F.col("secret_scan")
    return found.select("doc_id", scanned["candidates"].alias("secret_candidates"), scanned["secrets"].alias("secrets"), scanned["spans"].alias("secret_spans"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "text")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), "doc_id", "text", periodic.planted)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_packing, op3_pii, op4_quality, op5_near_duplicates, op6_token_counts, op7_decontamination, op8_warc, op9_licenses, op10_secrets, op11_importance, op12_main_text, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in ops}


#: Words of a text, and the text with A-Z in lower case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g2, range(8) AS x(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS dup, count(*) AS all_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(all_lines, 0) AS n_lines, len(list_filter(ws, lambda x: list_contains(STOPS, x))) AS stops,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS echoes
  FROM w LEFT JOIN rep USING (r) LEFT JOIN l USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_words > 1000000 OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 100 * n_symbols > 2 * word_chars OR (n_words >= 100 AND 100 * stops < 2 * n_words) OR 100 * echoes > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
""".replace("STOPS", "[" + ", ".join(f"'{w}'" for w in quality.STOP_FORMS) + "]")

_OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

_OP7_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP7_WORDS.format(_LOWER)} AS ws FROM documents),
b AS (SELECT item_id, {_OP7_WORDS.format(_LOWER)} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
grams AS (SELECT r, i, k, list_slice(ws, i, i + k - 1) AS g FROM (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
hit AS (SELECT r, i, k, item_id FROM grams JOIN win USING (g)),
words AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(k)) AS o FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP11 = rf"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_OP7_WORDS.format(_LOWER)} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_OP7_WORDS.format(_LOWER)}) AS w FROM benchmark),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, tab
),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((s + 1) * ((SELECT count(*) FROM bw)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
weight AS (SELECT r, sum(gain)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)
),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id NULLS FIRST) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed
"""

#: What the main text is on these tables, whose pages all have one article; the operator doesn't know that.
_OP12 = r"""
WITH p AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?h1>|</?p>') AS bs FROM pages),
b AS (SELECT page_id, url, list_transform(bs, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS bs FROM p),
u AS (SELECT page_id, url, list_transform(bs, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS bs FROM b),
t AS (SELECT page_id, url, list_filter(list_transform(bs, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS bs FROM u)
SELECT page_id, url, array_to_string(bs, chr(10) || chr(10)) AS text, length(array_to_string(bs, chr(10) || chr(10)))::BIGINT AS n_chars FROM t
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can state. Others are held against brute force in the tests: checksums and slots (1),
    tokens (2, 6), models (3, 9, 10), archives (8) and the runs of long texts (13) are no SQL."""
    return {"op4_quality": _OP4, "op5_near_duplicates": _OP5, "op7_decontamination": _OP7, "op11_importance": _OP11, "op12_main_text": _OP12}
