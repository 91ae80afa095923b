"""WARC archives of web pages, and capture histories merged from their sorted indexes."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from evenkeel.llm.shared import BROADCAST_ROWS, HOT_KEYS, kept, materialize, remove, scratch, shared_folder

#: Bytes, zipped, after which a task begins a new file.
FILE_BYTES = 64 << 20
#: Index entries that one merge task gets, about.
ENTRIES_PER_RANGE = 50_000
#: Bytes that are unzipped at once.
CHUNK = 64 << 10
#: The last byte of a gzip member is that of its size over 16 MB, zero below. Spark's text sink, which has no form without
#: separators, is given members without it and puts it after each; a member that ends otherwise is followed by an empty one.
LAST = "\0"
EMPTY = gzip.compress(b"", mtime=0)
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Fixed value of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str) -> str:
    """The URL with its host reversed, without scheme and fragment, so that a site's pages sort together."""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url.strip().lower()
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page: int | None, url: str | None, payload: str, digest: str, first: int | None, length: int, seconds: int) -> bytes:
    """A record; a page that refers to a first one is a revisit and has no payload."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    date = (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe='%:/?#[]@!$&' + chr(39) + '()*+,;=~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"] if revisit else []),
        f"Content-Length: {len(http) + (0 if revisit else length)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n" + http + ("" if revisit else payload) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record; the block's length is followed, not its text."""
    head = data.index(b"\r\n\r\n")
    lines = data[:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    end = head + 4 + int(headers["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ValueError(f"the record of {headers['warc-record-id']} has no end")
    return headers, data[head + 4 : end]


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive that hold anything, each unzipped for itself."""
    view, at = memoryview(data), 0
    while at < len(data):
        unzip, content, end = zlib.decompressobj(wbits=31), [], at
        while not unzip.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            chunk = view[end : end + CHUNK]
            content.append(unzip.decompress(chunk))
            end += len(chunk) - len(unzip.unused_data)
        if whole := b"".join(content):
            yield at, end - at, whole
        at = end


def write_archives(pages: DataFrame, key: str, url: str, html: str, least_bytes: int, time: str | None = None, folder: str | None = None) -> str:
    """Writes a record per row into a new folder of WARC files (``.warc.gz``), each record a gzip member of its own, and returns the folder's path.

    A task begins a new file after FILE_BYTES. Of rows with equal payloads of at least least_bytes, those with the least key are responses, the
    others revisit it. Payload groups are counted on digests alone, and the rows of a hot payload stay where they are. Without
    a ``folder`` the files go to a new one beside the checkpoints; they stay until they are removed.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    seconds = F.coalesce(F.unix_timestamp(time) - int(EPOCH.timestamp()), F.lit(0)) if time else F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(1 << 31))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"), seconds.cast("long").alias("seconds"))
    first = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND least IS NOT NULL")
    first = materialize(first)
    is_hot = F.col("copies") > (first.agg(F.sum("copies")).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(first.where(is_hot).select("digest", "n", "least"))  # fewer than HOT_KEYS rows
    cold = first.where(~is_hot).select("digest", "n", "least")
    rows = rows.join(hot, ["digest", "n"]).unionByName(rows.join(hot, ["digest", "n"], "left_anti").join(cold, ["digest", "n"], "left"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for r in zip(*batch.columns):
                page, url_, payload, digest, n, least, seconds_ = (x.as_py() for x in r)
                content = record(page, url_, payload, base64.b32encode(bytes.fromhex(digest)).decode(), None if least == page else least, n, seconds_)
                member = gzip.compress(content, 6, mtime=0)
                if member[-1]:
                    member += EMPTY
                yield pa.RecordBatch.from_arrays([pa.array([member[:-1]], pa.binary()), pa.array([written // FILE_BYTES], pa.int64())], names=["value", "part"])
                written += len(member)

    path = folder or f"{shared_folder(pages.sparkSession)}/evenkeel-warc-{uuid.uuid4().hex}"
    zipped = rows.select("page", "url", "payload", "digest", "n", "least", "seconds").mapInArrow(records, "value binary, part long")
    zipped.select(F.col("value").cast("string").alias("value"), "part").write.partitionBy("part").option("lineSep", LAST).text(path)
    _name_files(pages.sparkSession, path)
    return path


def _name_files(spark, path: str) -> None:
    """Gives the files the names of archives: one rename for each FILE_BYTES."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in system.listStatus(root):
        if part.isDirectory():
            for file in system.listStatus(part.getPath()):
                name = file.getPath().getName()
                if name.endswith(".txt"):
                    system.rename(file.getPath(), hadoop.Path(part.getPath(), name.removesuffix(".txt") + ".warc.gz"))


INDEX = StructType([
    *(StructField(c, StringType()) for c in ("url_key", "stamp", "file")), *(StructField(c, LongType()) for c in ("place", "offset", "length", "page_id", "payload_bytes")),
    *(StructField(c, StringType()) for c in ("payload_digest", "record_type")), StructField("refers_to", LongType()),
])


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["stamp"], entry["page_id"] is None, entry["page_id"] or 0, entry["file"], entry["offset"]


def index_runs(spark, path: str) -> DataFrame:
    """An entry per record of a folder of archives; each file is a run, sorted by URL key and time, with place as the order.

    Offset and length are those of the record's gzip member, which can be read and unzipped for itself. Payloads are hashed again and must agree with their headers.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda s: int(s[10:-1]) if s != "<urn:page:>" else None
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                run = []
                for offset, length, content in members(data.as_py()):
                    head, block = parse(content)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(http.rpartition(b":")[2])
                    if head["warc-type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the payload at byte {offset} disagrees with its digest")
                    refers = head.get("warc-refers-to")
                    run.append(
                        {"url_key": url_key(head["warc-target-uri"]), "stamp": head["warc-date"], "file": name.as_py(), "offset": offset, "length": length, "page_id": page(head["warc-record-id"]),
                         "payload_bytes": n, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": page(refers) if refers else None}
                    )
                run.sort(key=_order)
                for place, entry in enumerate(run):
                    entry["place"] = place
                yield pa.RecordBatch.from_pylist(run, pa.schema([(f.name, pa.string() if f.dataType == StringType() else pa.int64()) for f in INDEX]))

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInArrow(entries, INDEX)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a new entry meets one run a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.losers = [-1] * len(runs)
        for run in range(len(runs)):
            self._play(run)

    def _head(self, run: int) -> tuple:
        """Ended runs lose against all others; a tie goes to the run with the lower number."""
        at = self.at[run]
        return (False, self.runs[run][at], run) if at < len(self.runs[run]) else (True, (), run)

    def _play(self, run: int) -> None:
        node = (run + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = run
                return
            if self._head(other) < self._head(run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.at[winner := self.losers[0]] < len(self.runs[winner]):
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self._play(winner)


def merged_histories(runs: DataFrame) -> DataFrame:
    """The entries of all runs in global order of URL key and time: range_id and history_place are added.

    Entries are dealt by ranges of the whole order, which includes time, page and place in the archive, so captures of one URL
    spread over many tasks; each merges its part of every run.
    """
    order = ["url_key", "stamp", F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), "file", "offset"]
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // ENTRIES_PER_RANGE))
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("file", "place").withColumn("range_id", F.spark_partition_id().cast("long"))

    schema = StructType([*INDEX, *(StructField(c, LongType()) for c in ("range_id", "in_range"))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        part = pa.Table.from_batches(held).combine_chunks()  # about ENTRIES_PER_RANGE entries
        columns = {c: part.column(c).to_pylist() for c in ("url_key", "stamp", "page_id", "file", "offset")}
        heads = [(k, t, p is None, p or 0, f, o, i) for i, (k, t, p, f, o) in enumerate(zip(*columns.values()))]
        files = columns["file"]
        starts = [*(i for i in range(len(files)) if not i or files[i] != files[i - 1]), len(files)]
        merged = pa.array([x[-1] for x in LoserTree([heads[a:b] for a, b in zip(starts, starts[1:])])], pa.int64())
        yield from part.take(merged).append_column("in_range", pa.array(range(len(files)), pa.int64())).to_batches()

    out = kept(dealt.mapInArrow(merge, schema))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = out.groupBy("range_id").agg(F.count(F.lit(1)).alias("rows")).select("range_id", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    shift = F.broadcast(shift) if ranges <= BROADCAST_ROWS else shift
    return out.join(shift, "range_id").select("range_id", *INDEX.names, (F.col("in_range") + F.col("before")).alias("history_place"))


def archive(pages: DataFrame, key: str, url: str, html: str, least_bytes: int = 0, time: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes pages as WARC archives, reads them back and returns their capture histories, one row per page.

    Captures are dated by the timestamp column time (EPOCH where it is null); without one, EPOCH and as many seconds as the key
    says stand for it, so the captures of a URL are in the order of their keys.
    A null html is an empty payload, a null url an empty one. Rows without a key come last and refer to
    the least key of their payload. Rows that repeat the least key of a payload are all responses. Other
    columns are not archived; no pages give no rows. Archives stay in ``folder``; without one they are removed once they are
    read back.
    """
    with scratch(pages.sparkSession):
        path = write_archives(pages, key, url, html, least_bytes, time, folder)
        index = materialize(index_runs(pages.sparkSession, path))
        if not folder:
            remove(pages.sparkSession, path)
        return merged_histories(index)
