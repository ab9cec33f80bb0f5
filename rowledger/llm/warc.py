"""WARC archives of pages, and a capture index merged from sorted runs.

Contract: one row per page with page_id, payload_bytes, payload_digest, record_type, refers_to, and the capture's URL
key, time, range and place: archive, first byte and bytes of its gzip member, which `fetch` reads alone. A null html is an empty payload; a null url has the key `-`; of pages with equal payloads
of at least `min_bytes` bytes the smallest page_id is the response and the others revisit it (rows that repeat that
page_id are responses as well); extra columns are ignored; an empty table gives an empty result.

Method. Each record is a gzip member of its own, as the format asks, and a task joins members to archives of about
ARCHIVE_BYTES, each written by Spark's writer as a file of one row whose end is an empty member; so no file grows with
the size of pages or the number of records. The next reader gets them from whatever store they lie in, follows members
one by one, whoever wrote them and with however many records in each, checks Content-Length and hashes payloads anew,
holding one member's records at a time. A file's captures sorted by URL key and time are a run; the runs are dealt by ranges of the key and
time, and each range merges what it got of every run by a tree of losers, so that ranges follow each other in order. A
range holds RANGE_ROWS index rows on average, and one URL captured very often spreads over ranges by time.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowledger.llm.common import absent, materialize, plus, scratch_dir

END = b"\r\n\r\n"
#: Compressed bytes from which on an archive ends, the level of compression, and index rows a range.
ARCHIVE_BYTES, LEVEL, RANGE_ROWS = 16 << 20, 6, 100_000
#: What every file ends in: a gzip member without content. Its bytes are those of a text in Latin-1.
NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, archive string, at long, bytes long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: four times forty bits."""
    h = F.sha1(payload.cast("binary"))
    quarters = [F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*quarters)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query: pages of a site sort together."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\d*\.|:80$|:443$", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)), F.lit("-"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x], F.lit("\r\n"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    when = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.pmod("page_id", F.lit(1 << 28)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", number(F.col("page_id")), ">"),
        F.when(revisit, F.concat(line("WARC-Refers-To: <urn:page:", number(F.col("first")), ">"), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.coalesce(line("WARC-Target-URI: ", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")), F.lit("")),
        line("WARC-Date: ", when),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(gzip.compress(x.as_buffer().to_pybytes() + END, LEVEL, mtime=0))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    # Spark's text writer writes a string's bytes as they are, and its line end, here the empty member, behind each row.
    archives = rows.select(record.cast("binary").alias("record")).mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING).option("maxRecordsPerFile", 1).text(path)


def members_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, bytes, content) of each gzip member; of data that is not gzipped, the whole."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        out, end = [], at
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            out.append(z.decompress(view[end : end + (1 << 16)]))
            end += min(1 << 16, len(data) - end)
        end -= len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def records(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(place, fields, block) of each record of one archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        end = head + 4 + int(fields[b"content-length"])
        yield at, fields, data[head + 4 : end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives, of records that are no response and no revisit none; url_key still holds the URL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                for at, size, member in members_of(content.as_py()):
                    rows += [(*capture(f, block, name.as_py()), name.as_py(), at, size) for _, f, block in records(member) if f[b"warc-type"] in (b"response", b"revisit")]
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CAPTURE.split(", ")])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CAPTURE.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(run, CAPTURE)


def capture(fields: dict[bytes, bytes], block: bytes, name: str) -> tuple:
    """page_id, payload bytes and digest, type, refers_to, URL and date of a record, its payload checked."""
    page = lambda x: int(m[1]) if x and (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x)) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)^content-length: *(\d+)", http, re.MULTILINE)
    size, kind = int(said[1]) if said else len(payload), fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().partition(":")[2] if b"warc-payload-digest" in fields else base32(payload)
    if kind == "response" and (len(payload) != size or base32(payload) != digest):
        raise ValueError(f"{name}: a payload differs from its digest")
    url = fields.get(b"warc-target-uri")
    return page(fields[b"warc-record-id"]), size, digest, kind, page(fields.get(b"warc-refers-to")), url.decode() if url is not None else None, fields[b"warc-date"].decode()


def fetch(captures: DataFrame, path: str) -> DataFrame:
    """captures (archive, at, bytes and any more columns) with `record`, the record's bytes, cut from its archive alone."""
    spark = captures.sparkSession
    (name,) = absent(captures.columns, "_content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias(name))
    wanted = captures.select("archive", F.struct(*captures.columns).alias("_row")).groupBy("archive").agg(F.collect_list("_row").alias("_rows"))  # an archive has a bounded number of records
    cut = files.join(wanted, "archive").select(name, F.explode("_rows").alias("_row")).select("_row.*", F.expr(f"substring({name}, int(_row.at) + 1, int(_row.bytes))").alias("_member"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = pa.array([zlib.decompress(m.as_py(), 31) for m in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], content], names=[*b.schema.names[:-1], "record"])

    return cut.mapInArrow(run, plus(captures.schema, record="binary"))


def base32(payload: bytes) -> str:
    import base64

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up; one path is replayed a row."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._up(i)

    def _key(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._key(i), self._key(j)
        return b is None or (a is not None and (a, i) < (b, j))

    def _up(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (key := self._key(self.tree[0])) is not None:
            yield key
            i = self.tree[0]
            self.at[i] += 1
            self._up(i)


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (url_key, captured, page_id): what comes is cut where the order breaks, and the runs are merged."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    runs: list[list[tuple]] = []
    for i, key in enumerate(zip(rows["url_key"].to_pylist(), rows["captured"].to_pylist(), ((x is not None, x or 0) for x in rows["page_id"].to_pylist()), strict=True)):
        if not runs or (key, i) < runs[-1][-1]:
            runs.append([])
        runs[-1].append((key, i))
    yield from rows.take(pa.array([i for _, i in LoserTree(runs)], pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of URL key, time and page: partitions follow each other, and each is sorted."""
    runs = captures.withColumn("url_key", url_key(F.col("url_key"))).sortWithinPartitions("archive", "url_key", "captured", "page_id")
    runs = materialize(runs, "warc-runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    return dealt.mapInArrow(merge_runs, runs.schema).withColumn("range", F.spark_partition_id())


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the scratch folder, read them back and index them."""
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    return capture_index(read_archives(pages.sparkSession, path))
