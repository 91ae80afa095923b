"""Near duplicates, decontamination, archives and the pipeline against brute force."""

import base64
import gzip
import hashlib
import random
import re
import subprocess
from urllib.parse import unquote, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import components, decontamination, neardup, warc
from evenkeel.llm.queries import queries


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts, percent):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("short_list", [32, 2])
def test_near_duplicates(spark, documents, monkeypatch, short_list):
    monkeypatch.setattr(neardup, "SHORT_LIST", short_list)
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = ["", None, "A b", "a  B", "one", " \n", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    texts += [" ".join([*passage, *(word() for _ in range(40))]) for _ in range(40)]
    df = documents(*texts).withColumns({"values": F.lit(1), "n": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, "doc_id", "text", 85).collect()}
    assert got == dict(enumerate(brute_components(texts, 85)))


def test_near_duplicates_around_a_passage(spark, documents):
    """20 groups: a passage, and 250 texts of it and 29 own words each, linked to the passage alone (170 of 199 shingles)."""
    rng, texts, groups = random.Random(5), [], []
    for group in range(20):
        passage = [f"g{group}p{rng.randrange(10**6)}" for _ in range(174)]
        members = [" ".join(passage)] + [" ".join([*passage, *(f"o{rng.randrange(10**12)}" for _ in range(29))]) for _ in range(250)]
        texts += members
        groups += [group] * len(members)
    order = rng.sample(range(len(texts)), len(texts))
    least = {}
    for place, i in enumerate(order):
        least.setdefault(groups[i], place)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(*(texts[i] for i in order)), "doc_id", "text", 85).collect()}
    assert got == {place: least[groups[i]] for place, i in enumerate(order)}


@pytest.mark.parametrize("percent, own", [(85, 52), (80, 73)])
def test_near_duplicates_of_one_template(spark, documents, percent, own):
    """Pages of a template with own words before and after it, linked only to the bare template, among pages that share its text and are not near it."""
    rng = random.Random(8)
    template = [f"w{rng.randint(0, 3000)}" for _ in range(300)]
    bare = neardup.shingle_set(" ".join(template))
    page = lambda n: " ".join([*(f"x{rng.randrange(10**9)}" for _ in range(n // 2)), *template, *(f"x{rng.randrange(10**9)}" for _ in range(n - n // 2))])
    texts = [page(90) for _ in range(60)] + [" ".join(template)] + [page(20) for _ in range(4)]
    while len(texts) < 73:
        text = page(own)
        if 9 <= 20 - sum(x in bare for x in neardup.shingle_set(text)[:20]) <= 11:
            texts.append(text)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(*texts), "doc_id", "text", percent).collect()}
    want = {i: c for i, (_, c) in enumerate(brute_components(texts, percent))}
    assert got == want and {want[i] for i in range(60, 73)} == {60}


def test_near_duplicates_of_odd_tables(spark, documents):
    assert neardup.near_duplicates(documents("x").limit(0), "doc_id", "text", 85).count() == 0
    twice = documents("a b c d e f g", "a b c d e f g").withColumn("doc_id", F.when(F.col("doc_id") == 1, F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    rows = neardup.near_duplicates(twice.union(twice), "doc_id", "text", 85).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows) == [("0", "0", True)] * 2 + [("None", "None", True)] * 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges, "a", "b").collect()} == {**{i: 0 for i in range(1, 31)}, 50: 40, 60: 40}
    assert components.components(edges.limit(0), "a", "b").count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for i in range(max(1, len(iw) - 9) if iw else 0):
            g = iw[i : i + 10]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(item if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block, piece", [(8 << 20, 5000), (60, 7)])
def test_decontamination(spark, documents, monkeypatch, block, piece):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "PIECE_WINDOWS", piece)
    rng = random.Random(4)
    item = lambda n: " ".join(rng.choice(["Éa", "b", "c3", "d", "e"]) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([12, 30, 3, 10, 1])] + [(9, ""), (10, None), (2, "b b"), (None, "zz yy")]
    texts = ["", None, "Zz, YY!", items[1][1].upper(), "x " + items[0][1] + " y", *(item(rng.randint(1, 60)) for _ in range(40)), "b " * 400]
    got = decontamination.contamination(documents(*texts).withColumn("items", F.lit(0)), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    twice = documents(texts[3], texts[3], None).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.contaminated for r in decontamination.contamination(twice, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()].count(True) == 2
    none = decontamination.contamination(documents("a b"), "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text").first()
    assert (none.n_words, none.contaminated) == (2, False)
    assert decontamination.contamination(documents("x").limit(0), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").count() == 0


@pytest.mark.parametrize("candidates", [1, 2, 3, 4, 100])
def test_occurrences_at_any_number_of_candidates(monkeypatch, candidates):
    monkeypatch.setattr(decontamination, "CANDIDATES", candidates)
    index = decontamination.WindowIndex([("i", [b"a", b"b"]), ("j", [b"b", b"c"])], {b"a": 5, b"b": 1, b"c": 7}, 10)
    text = [index.vocabulary.get(w, -1) for w in b"a b x a b c b c x x a b".split()]
    found = sorted(zip(*(x.tolist() for x in index.occurrences(np.array(text, np.int32)))))
    want = sorted((at, k) for k, w in enumerate(index.windows[:, :2].tolist()) for at in range(len(text) - 1) if text[at : at + 2] == w)
    assert found == want and len(found) == 5


def test_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 1500)
    monkeypatch.setattr(warc, "CHUNK", 50)
    bodies = ["", None, "<p>\r\n\r\nWARC/1.1\r\n</p>", "é" * 999, "a", "a"]
    far = 2**60 + 1  # no double is such a number
    rows = [(far + 2 * i, None if i == 3 else f"http://h{i % 3}.example.org:81/p q?x=é#{i}", bodies[i % 6]) for i in range(60)] + [(None, "x", "a"), (4 + far, "x", "a"), (77, "http://[bad", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.archive(pages, "page_id", "url", "html", folder=f"{tmp_path}/archives").orderBy("history_place").collect()
    assert [r.history_place for r in got] == list(range(len(rows)))
    keys = [warc._order(r.asDict()) for r in got]
    assert keys == sorted(keys)
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:  # an entry's offset and length are enough to read its record
        with open(unquote(urlsplit(r.file).path), "rb") as f:
            f.seek(r.offset)
            head, _ = warc.parse(gzip.decompress(f.read(r.length)))
        assert head["warc-payload-digest"] == f"sha1:{r.payload_digest}" and head["warc-record-id"] == f"<urn:page:{'' if r.page_id is None else r.page_id}>"
    assert len({r.file for r in got}) > 8  # by bytes
    files = {unquote(urlsplit(r.file).path) for r in got}
    assert all(f.endswith(".warc.gz") for f in files)
    for file in files:  # other readers take whole files
        assert subprocess.run(["gzip", "-t", file], capture_output=True).stderr == b""
        with gzip.open(file) as f:
            assert f.read().count(b"WARC-Record-ID: ") == sum(unquote(urlsplit(r.file).path) == file for r in got)
    assert warc.archive(pages.limit(0), "page_id", "url", "html").count() == 0
    times = spark.createDataFrame([(1, "u", "a", "2021-01-02 00:00:00"), (2, "u", "b", "2021-01-01 00:00:00"), (3, "u", "c", None)], "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r.page_id for r in warc.archive(times, "page_id", "url", "html", time="at").orderBy("history_place").collect()] == [3, 2, 1]


def test_archive_of_a_large_record(spark, tmp_path):
    """The size of a record over 16 MB ends its member in another byte than 0."""
    pages = spark.createDataFrame([(1, "u", "x" * (17 << 20)), (2, "u", "y"), (3, "v", "x" * (17 << 20))], "page_id long, url string, html string").coalesce(1)
    got = warc.archive(pages, "page_id", "url", "html", folder=f"{tmp_path}/archives").orderBy("page_id").collect()
    assert [(r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(17 << 20, "response", None), (1, "response", None), (17 << 20, "revisit", 1)]
    for file in {unquote(urlsplit(r.file).path) for r in got}:
        assert subprocess.run(["gzip", "-t", file], capture_output=True).stderr == b""
    before = set(tmp_path.iterdir())
    assert warc.archive(pages, "page_id", "url", "html").count() == 3 and set(tmp_path.iterdir()) == before


@pytest.mark.parametrize("runs", [[], [[1]], [[], [2, 2], [1, 3], []], [[5, 6], [1, 9], [2], [3, 4, 8]]])
def test_loser_tree(runs):
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_pipeline_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = stages["quality_rules"](spark, docs, sf)
    assert judged.schema == docs.schema
    kept = {r.doc_id for r in stages["near_dedup"](spark, judged, sf).collect()}
    rows = sorted((r.doc_id, r.text) for r in judged.select("doc_id", "text").collect())
    assert kept == {rows[i][0] for i, (_, c) in enumerate(brute_components([t for _, t in rows], 80)) if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontaminate"](spark, judged, sf).collect()}
    assert clean == {i for i, t in rows if not brute_hits(t, items)[4]}
    masked = stages["mask_secrets"](spark, judged, sf).collect()
    assert len(masked) == len(rows) and not any(re.search("AKIA[A-Z0-9]{16}", r.text) for r in masked)
    packed = {r.doc_id for r in queries()["pipeline"](spark, sf).select("doc_id").collect()}
    assert packed == kept & clean


CLASHES = ("Quality", "secret_scan", "contamination", "row", "ROW_", "n", "values", "node", "key", "found", "licences", "a.b", "back`tick", "doc_id.text")


def test_stages_act_row_by_row(spark, documents, tmp_path):
    """Null and repeated keys, null, empty and long texts, repeated rows and clashing columns, in every stage."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) if k % 3 else f"w{rng.randrange(10**6)}" for k in range(n))
    a, b, c, item = prose(80), prose(80), prose(80), prose(12)
    secret = "password=e3b3ed3cc8548923d6"
    rows = [(1, a), (1, b), (2, a), (None, c + " " + item), (None, prose(60)), (3, None), (4, ""), (5, prose(20_000)), (6, c), (6, c), (7, b + " " + secret), (None, b), (8, "short"), (9, prose(30) + " " + item)]
    docs = spark.createDataFrame([(i, t, "en", None if k % 2 else "s", len(t or "")) for k, (i, t) in enumerate(rows)], documents("").schema)
    for k, name in enumerate(CLASHES):
        docs = docs.select("*", (F.lit(k) if k % 3 else F.lit(None).cast("string")).alias(name))
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    counted = lambda got: sorted((str(r.doc_id), r.text or "", r.source or "") for r in got)
    all_rows = docs.collect()
    for name in list(stages)[:4]:
        assert run(name).schema.simpleString() == docs.schema.simpleString() and stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert counted(run("quality_rules").collect()) == counted(r for r in all_rows if len((r.text or "").split()) >= 20)
    assert counted(run("decontaminate").collect()) == counted(r for r in all_rows if item not in (r.text or ""))
    kept = run("near_dedup").collect()
    assert len([r for r in kept if r.text == c]) == 1  # of repeated rows one
    gone = [(2, a), (None, b), (6, c), (7, b + " " + secret), (None, c + " " + item)]  # the last shares 76 of 88 shingles with c
    left = list(rows)
    for x in gone:
        left.remove(x)
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted((str(i), t or "") for i, t in left)
    masked = run("mask_secrets").collect()
    assert counted(r for r in masked if "[SECRET]" not in (r.text or "")) == counted(r for r in all_rows if secret not in (r.text or ""))
    assert [(r.doc_id, r.text, r.n_chars) for r in masked if "[SECRET]" in (r.text or "")] == [(7, f"{b} password=[SECRET]", len(f"{b} password=[SECRET]"))]
    assert {tuple(r[k] for k in CLASHES) for r in masked} == {tuple(all_rows[0][k] for k in CLASHES)}
    packed = run("pack").collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(i) for i, _ in rows)
