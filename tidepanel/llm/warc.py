"""WARC revisit resolution and deduplicated archives.

Only headers are shuffled, by payload digest: each digest's earliest response (by date,
then id, then URI) is its original, found by an aggregation that combines before the
shuffle, and every other capture of that digest, whether logged as a revisit or as a
response with the same payload, is joined to it. The archive then holds each payload once;
the other captures are revisit records whose fresh headers name the original. Payloads of
originals are written where they are read: the captures to leave out are few, and their
names are sent to every task; beyond ``broadcast_captures`` of them payloads are shuffled
to meet the names. Records are written by a data source of their own (``warc``), a gzip
member each behind a ``warcinfo`` record; files count once the whole write is committed,
so that lost executors and repeated tasks leave nothing behind.

Rows: a capture without id, or without payload and digest, can't be resolved and is left
out; an empty payload is a payload like any other, and a very long one is written whole;
of equal captures the first in the order above is the original; captures are told apart
by id, date, digest and URI, and repeated rows are one capture; a revisit whose original
is in no archive stays a revisit that refers to nothing; a NULL URI is written as empty, a
NULL date as ``DATE``; other columns are ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidepanel.llm.common import cut, shared_dir, spread, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Captures left out of the archive whose names are sent to every task.
BROADCAST_CAPTURES = 1_000_000
#: What tells captures apart.
CAPTURE = ["capture_id", "date", "digest", "uri"]


# == archive files
def filesystem(path: str):
    """(file system, path in it) of a path or URI as Spark writes them: file:/ with one slash, s3a://."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", path)))


def member(record: bytes) -> bytes:
    """A record with its separator, as a gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.compress(b"\r\n\r\n") + z.flush()


def info(name: str) -> bytes:
    """The warcinfo record that opens the file ``name``."""
    body = f"software: tidepanel{CRLF}format: WARC File Format 1.1{CRLF}"
    urn = uuid.UUID(hashlib.md5(name.encode()).hexdigest())
    head = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{urn}>{CRLF}WARC-Date: {DATE}{CRLF}WARC-Filename: {name}{CRLF}"
    return f"{head}Content-Type: application/warc-fields{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}{body}".encode()


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members on end, or of a file that is not compressed."""
    z, first = None, True
    for chunk in chunks:
        if first:
            z, first = (zlib.decompressobj(31) if chunk[:2] == b"\x1f\x8b" else None), False
        if z is None:
            yield chunk
            continue
        while chunk:
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; holds one record at a time."""
    data, head, need, source = bytearray(), None, 0, iter(chunks)
    while True:
        if head is None and (end := data.find(b"\r\n\r\n")) >= 0:
            head = dict(x.split(": ", 1) for x in bytes(data[:end]).decode().split(CRLF)[1:])
            del data[: end + 4]
            need = int(head["Content-Length"]) + 4
        elif head is not None and len(data) >= need:
            yield head, bytes(data[: need - 4])
            del data[:need]
            head = None
        elif (chunk := next(source, None)) is not None:
            data += chunk
        elif data or head is not None:
            raise ValueError("an archive ends inside a record")
        else:
            return


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        """A file of the batches' records under _temporary; a task without records makes none."""
        fs, base = filesystem(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for record in batch.column("record"):
                if out is None:
                    fs.create_dir(f"{base}/_temporary", recursive=True)
                    out = fs.open_output_stream(f"{base}/_temporary/{name}", compression=None)
                    out.write(member(info(name)))
                out.write(member(record.as_py()))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages):
        fs, base = filesystem(self.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{base}/_temporary/{m.name}", f"{base}/{m.name}")
        self._clear(fs, base)

    def abort(self, messages):
        self._clear(*filesystem(self.path))

    def _clear(self, fs, base):
        from pyarrow import fs as kinds

        if fs.get_file_info(f"{base}/_temporary").type == kinds.FileType.Directory:
            fs.delete_dir(f"{base}/_temporary")


class WarcReader(DataSourceReader):
    FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs as kinds

        fs, base = filesystem(self.path)
        files = fs.get_file_info(kinds.FileSelector(base, recursive=True, allow_not_found=True))
        found = [f.path for f in files if f.type == kinds.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_temporary/" not in f.path]
        return [InputPartition(p) for p in sorted(found)] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_stream(partition.value, compression=None) as f:
            for head, block in parse(inflated(iter(lambda: f.read(1 << 20), b""))):
                if head["WARC-Type"] != "warcinfo":
                    yield (*(head.get(x) for x in self.FIELDS.values()), block)


class Warc(DataSource):
    """Reads (record_type, record_id, date, uri, digest, refers_to, block); writes a binary ``record``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return ", ".join(f"{x} string" for x in WarcReader.FIELDS) + ", block binary"

    def reader(self, schema):
        return WarcReader(self.options["path"])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, date, uri, digest, refers_to, block) of the archives under ``path``."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").load(path)


def write_archive(records: DataFrame, path: str) -> None:
    """Write the binary column ``record`` as gzip WARC files under ``path``."""
    records.sparkSession.dataSource.register(Warc)
    records.select("record").write.format("warc").mode("append").save(path)


# == captures
def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures: (capture_id, kind, date, uri, digest, payload)."""
    payload = F.col("html").cast("binary")
    return pages.where("page_id is not null and html is not null").select(
        F.col("page_id").cast("long").alias("capture_id"),
        F.lit("response").alias("kind"),
        F.lit(DATE).alias("date"),
        F.coalesce("url", F.lit("")).alias("uri"),
        F.concat(F.lit("sha1:"), F.sha1(payload)).alias("digest"),
        payload.alias("payload"),
    )


def crawl_log(pages: DataFrame) -> DataFrame:
    """The pages as a crawler comes by several times: every page once, every third again a
    month later, logged as a response of the same payload, and every fifth after two
    months, logged as a revisit without payload. The pages alone hold no revisits."""
    visit = lambda kind, date: F.struct(F.lit(kind).alias("kind"), F.lit(date).alias("date"))
    visits = F.array(visit("response", DATE), F.when(F.col("capture_id") % 3 == 0, visit("response", "2024-02-01T00:00:00Z")), F.when(F.col("capture_id") % 5 == 0, visit("revisit", "2024-03-01T00:00:00Z")))
    logged = captures(pages).withColumn("visit", F.explode(F.array_compact(visits)))
    return logged.select("capture_id", "visit.kind", "visit.date", "uri", "digest", F.when(F.col("visit.kind") == "response", F.col("payload")).alias("payload"))


def named(captured: DataFrame) -> DataFrame:
    """Captures with an id and a digest, dates and URIs filled in."""
    filled = captured.withColumns({"uri": F.coalesce("uri", F.lit("")), "date": F.coalesce("date", F.lit(DATE)) if "date" in captured.columns else F.lit(DATE)})
    return filled.where("capture_id is not null and digest is not null")


def resolve(headers: DataFrame) -> DataFrame:
    """(capture_id, record_type, date, uri, digest, refers_to, refers_to_date, refers_to_uri) of each capture.

    ``headers`` has capture_id, kind ('response' or 'revisit'), date, uri and digest.
    """
    h = named(headers).groupBy(*CAPTURE).agg(F.bool_or(F.col("kind") == "response").alias("payload_logged"))
    first = F.min(F.when(F.col("payload_logged"), F.struct("date", "capture_id", "uri"))).alias("o")
    originals = h.groupBy("digest").agg(first)
    is_original = F.coalesce(F.col("payload_logged") & (F.struct("date", "capture_id", "uri") == F.col("o")), F.lit(False))
    refers = {f"refers_to{x}": F.when(~is_original, F.col(f"o.{c}")) for x, c in (("", "capture_id"), ("_date", "date"), ("_uri", "uri"))}
    return h.join(originals, "digest").select("capture_id", F.when(is_original, "response").otherwise("revisit").alias("record_type"), "date", "uri", "digest", *(c.alias(n) for n, c in refers.items()))


def record_name(capture_id: str, date: str, uri: str) -> Column:
    """The name of a capture, the same whenever the archive is written."""
    return F.md5(F.concat_ws("|", F.col(capture_id).cast("string"), F.col(date), F.col("digest"), F.col(uri)))


def urn(name: Column) -> Column:
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_headers(records: DataFrame) -> DataFrame:
    """``records`` (resolved captures with payload_bytes) plus the fresh header text."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    is_response = F.col("record_type") == "response"
    length = F.octet_length(http) + F.when(is_response, F.col("payload_bytes")).otherwise(F.lit(0))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    original = urn(record_name("refers_to", "refers_to_date", "refers_to_uri"))
    refers = F.when(
        F.col("refers_to").isNotNull(),
        F.concat(line("WARC-Refers-To", original), line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), line("WARC-Refers-To-Date", F.col("refers_to_date"))),
    ).otherwise("")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(record_name("capture_id", "date", "uri"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.col("digest")),
        F.when(is_response, "").otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), refers)),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return records.withColumns({"header": head, "http": http, "content_length": length})


def deduplicate(captured: DataFrame, path: str, broadcast_captures: int = BROADCAST_CAPTURES) -> DataFrame:
    """Write the deduplicated archive of ``captured`` to ``path``; returns its index."""
    captured = named(captured)
    headers = cut(captured.select(*CAPTURE, "kind", F.octet_length("payload").alias("payload_bytes")), "headers")
    sized = headers.groupBy("digest").agg(F.coalesce(F.max("payload_bytes"), F.lit(0)).alias("payload_bytes"))
    index = cut(with_headers(resolve(headers).join(sized, "digest")), "index")
    name = record_name("capture_id", "date", "uri")
    # what is not written where it stands: responses that are no originals, and rows that are repeated
    responses = headers.where("kind = 'response'").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    other = index.where("record_type = 'revisit'").select(name.alias("name")).join(responses.select("name"), "name", "left_semi")
    special = other.withColumn("again", F.lit(False)).unionByName(responses.where("n > 1").join(other, "name", "left_anti").select("name", F.lit(True).alias("again")))
    special = cut(special, "special")
    side = F.broadcast(special) if special.count() <= broadcast_captures else special.hint("merge")
    mine = captured.where("kind = 'response'").withColumn("name", name).join(side, "name", "left")
    once = mine.where("again is null").unionByName(mine.where("again").dropDuplicates(["name"]))
    none = {"refers_to": F.lit(None).cast("long"), "refers_to_date": F.lit(None).cast("string"), "refers_to_uri": F.lit(None).cast("string")}
    originals = with_headers(once.withColumns({"record_type": F.lit("response"), "payload_bytes": F.octet_length("payload"), **none}))
    text = F.concat("header", "http").cast("binary")
    revisits = index.where("record_type = 'revisit'").select(text.alias("record"))
    write_archive(originals.select(F.concat(text, "payload").alias("record")).unionByName(revisits), path)
    return index.select("capture_id", "record_type", "date", "uri", "digest", "refers_to", "refers_to_date", "content_length", "header")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    return deduplicate(crawl_log(spread(table(spark, sf_dir, "pages"))), path).withColumnRenamed("capture_id", "page_id")


_URN = lambda h: f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"
SQL = rf"""
with p as (select distinct page_id, coalesce(url, '') as uri, 'sha1:' || sha1(html) as digest, octet_length(encode(html)) as n from pages where page_id is not null and html is not null),
h as (select *, '{DATE}' as date, true as logged from p union all select *, '2024-02-01T00:00:00Z', true from p where page_id % 3 = 0 union all select *, '2024-03-01T00:00:00Z', false from p where page_id % 5 = 0),
o as (select digest, page_id as o_id, date as o_date, uri as o_uri from h where logged qualify row_number() over (partition by digest order by date, page_id, uri) = 1),
x as (select h.*, o_id, o_date, o_uri, logged and page_id = o_id and date = o_date and uri = o_uri as orig from h join o using (digest)),
y as (select *, 'HTTP/1.1 200 OK' || e || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || n || e || e as http,
   md5(page_id || '|' || date || '|' || digest || '|' || uri) as r, md5(o_id || '|' || o_date || '|' || digest || '|' || o_uri) as q from (select *, chr(13) || chr(10) as e from x))
select page_id, case when orig then 'response' else 'revisit' end as record_type, date, uri, digest, case when not orig then o_id end as refers_to, case when not orig then o_date end as refers_to_date,
  cast(length(http) + case when orig then n else 0 end as integer) as content_length,
  'WARC/1.1' || e || 'WARC-Type: ' || case when orig then 'response' else 'revisit' end || e || 'WARC-Record-ID: ' || {_URN('r')} || e
  || 'WARC-Date: ' || date || e || 'WARC-Target-URI: ' || uri || e || 'WARC-Payload-Digest: ' || digest || e
  || case when orig then '' else 'WARC-Profile: {PROFILE}' || e || 'WARC-Refers-To: ' || {_URN('q')} || e
     || 'WARC-Refers-To-Target-URI: ' || o_uri || e || 'WARC-Refers-To-Date: ' || o_date || e end
  || 'Content-Type: application/http; msgtype=response' || e || 'Content-Length: ' || (length(http) + case when orig then n else 0 end) || e || e as header
from y
"""
