"""A content-addressed web archive: each payload once, headers apart, joins back.

Writing names each payload by its SHA-256 digest. The record with the smallest
id among those of one payload carries it (a response); the others are revisits
that refer to it. The exact headers of every record go to a table of their
own; payloads go once into WARC/1.1 files, one gzip member a record, written
by Spark's own writer, so the store may be any that Spark reaches.

After about CHUNK_BYTES of members stands an empty member, which unpacks to
nothing. Spark splits and reads the files at these marks, so neither writing
nor reading holds more than a chunk or one record; compressed text can't hold
a mark by itself, as its bytes are no UTF-8. Archives of other writers, of one
or many members a file, are read by ``foreign``.

Reading parses records by their lengths, checks every payload against its
digest, and rebuilds original records by joining headers with payloads.

Defined results: a null payload or address is empty; payloads under the least length are
stored with each record; a null id sorts after all others and refers_to of its
revisits is null; of rows that repeat id and payload the one with the smallest
address is the response and the others revisit it; rows that repeat wholly are
records of their own, with ids of their own; an empty table makes an archive
without records. A record is held in memory whole, so a payload is limited to
about 1 GB.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import BROADCAST_ROWS
from ..scratch import Scratch
from .common import hot_join, text_of

#: Payloads under this many bytes are always stored.
LEAST = 100
#: Compressed bytes of a chunk of records, about, and chunks of one archive file, at most.
CHUNK_BYTES, FILE_CHUNKS = 1 << 20, 1024
_LINE = "\r\n"
_END = _LINE + _LINE
#: An empty gzip member: header, an empty last block, checksum and length of nothing.
MARK = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0]) + bytes(8)
_MARKED = {"lineSep": MARK.decode("latin-1"), "encoding": "ISO-8859-1"}


def _digest(payload: str) -> Column:
    return F.sha2(text_of(payload), 256)


def _place(id_: str, url: str) -> Column:
    """Order of the records of one payload: by id, nulls last, then by address."""
    return F.struct(F.col(id_).isNull().alias("late"), F.col(id_).alias("id"), F.col(url).alias("url"))


def plan(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, url, digest, bytes, copies, shared, first, first_url, leads) of the distinct records.

    ``shared``: several records have the payload, and ``first`` and ``first_url`` are
    the id and address of the one that stores it; ``leads``: it is (the first copy of) this record.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), _digest(payload_col).alias("digest"), F.octet_length(text_of(payload_col)).cast("long").alias("bytes"))
    rows = scratch.write(rows.groupBy("id", "url", "digest", "bytes").agg(F.count("*").alias("copies")), "digests")
    shared = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(_place("id", "url")).alias("lead"), F.sum("copies").alias("n")).where("n > 1")
    shared = scratch.write(shared, "shared")
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    known = hot_join(rows, shared, ["digest"], "n", total, "left")
    leads = F.col("n").isNull() | (_place("id", "url") == F.col("lead")) | (F.col("id").isNull() & F.col("lead.id").isNull() & (F.col("url") == F.col("lead.url")))
    return scratch.write(known.select("id", "url", "digest", "bytes", "copies", F.col("n").isNotNull().alias("shared"), F.col("lead.id").alias("first"), F.col("lead.url").alias("first_url"), leads.alias("leads")), "plan")


def _urn(id_: str, url: str, copy: Column) -> Column:
    """The record id, a UUID made of what tells records of one archive apart."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(F.concat(F.lit("+"), F.col(id_).cast("string")), F.lit("-")), F.col(url), F.col("digest"), copy.cast("string")), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column, when: Column | None = None) -> Column:
    line = F.concat(F.lit(f"{_LINE}{name}: "), value)
    return line if when is None else F.when(when, line).otherwise(F.lit(""))


def _header(kind: Column, copy: Column, date: str) -> Column:
    """The exact header of a record, up to its blank line."""
    again = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1"), _field("WARC-Type", kind), _field("WARC-Record-ID", _urn("id", "url", copy)), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "_")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _field("WARC-Refers-To", _urn("first", "first_url", F.lit(1)), again),
        _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), again), _field("X-Page-ID", F.col("id").cast("string"), F.col("id").isNotNull()),
        _field("X-Refers-To-Page-ID", F.col("first").cast("string"), again & F.col("first").isNotNull()), _field("X-Payload-Length", F.col("bytes").cast("string")),
        _field("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )


def _copies(rows: DataFrame) -> DataFrame:
    """A row for each record, with kind: of a shared payload one is the response."""
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.withColumn("kind", F.when(~F.col("shared") | (F.col("leads") & (F.col("copy") == 1)), "response").otherwise("revisit"))


class Archive:
    """An archive below a folder that all executors reach: ``records`` are WARC
    files with each payload once, ``headers`` is a table of every record's header."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "warc")
        self.path = path or self.scratch.path(f"archive-{uuid.uuid4().hex}")

    def write(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str | None = None) -> None:
        """date: when the records were made, as in ISO 8601; now, if not given."""
        date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        known = plan(pages, self.scratch, id_col, url_col, payload_col, least)
        heads = _copies(known).select("id", "url", "digest", "bytes", F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("first")).alias("refers_to"), _header(F.col("kind"), F.col("copy"), date).alias("header"))
        heads.write.option("compression", "zstd").parquet(f"{self.path}/headers")
        rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), text_of(payload_col).alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
        # a single payload is a response wherever it is read; only the others are looked up
        some = known.where("shared or copies > 1").select(F.col("id").alias("known_id"), F.col("url").alias("known_url"), F.col("digest").alias("known_digest"), "copies", "shared", "first", "first_url", "leads")
        some = self.scratch.write(some, "shared-plan")
        n = some.count()
        rows = rows.join(F.broadcast(some) if n <= BROADCAST_ROWS else some, rows["id"].eqNullSafe(some["known_id"]) & (rows["digest"] == some["known_digest"]) & (rows["url"] == some["known_url"]), "left")
        columns = ["id", "url", "digest", "bytes", "payload", "copies", "shared", "first", "first_url", "leads"]
        rows = rows.select(*columns[:5], F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("shared", F.lit(False)).alias("shared"), "first", "first_url", F.coalesce("leads", F.lit(True)).alias("leads"))
        kind = F.when(F.col("shared") & ~F.col("leads"), "revisit").otherwise("response")
        records = rows.where("copies = 1").select(_header(kind, F.lit(1), date).alias("header"), F.when(kind == "response", F.col("payload")).alias("payload"))
        if not some.where("copies > 1").isEmpty():
            one = _copies(rows.where("copies > 1").groupBy(*columns).agg(F.lit(1).alias("one")))
            records = records.unionByName(one.select(_header(F.col("kind"), F.col("copy"), date).alias("header"), F.when(F.col("kind") == "response", F.col("payload")).alias("payload")))
        chunks = records.mapInArrow(packed(CHUNK_BYTES), "chunk binary").select(F.col("chunk").cast("string"))
        chunks.write.options(**_MARKED).option("compression", "none").option("maxRecordsPerFile", FILE_CHUNKS).text(f"{self.path}/records")

    def read(self, with_payload: bool = True) -> DataFrame:
        """(id, record_type, refers_to, url, header, digest, bytes, payload) of every record as it stands in the files."""
        chunks = self.spark.read.options(**_MARKED).text(f"{self.path}/records").select(F.col("value").cast("binary"))
        return chunks.mapInArrow(parsed(with_payload), _RECORD)

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")

    def rebuilt(self) -> DataFrame:
        """Original records: every header with its payload, a revisit's from the response of that digest."""
        payloads = self.read().where("record_type = 'response'").groupBy("digest", "payload").agg(F.lit(1).alias("one")).drop("one")
        return self.headers().join(payloads, "digest")


_RECORD = "id string, record_type string, refers_to string, url string, header string, digest string, bytes long, payload binary"


def foreign(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of other writers' archives, compressed or not; without a payload digest it is made of the block."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parsed(with_payload), _RECORD)


def packed(most: int):
    """Rows (chunk) of rows (header, payload): one gzip member a record, about ``most`` bytes of them a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for header, payload in zip(*batch.columns, strict=True):
                member = zlib.compressobj(wbits=31)
                body = payload.as_buffer() if payload.is_valid else b""
                held += [member.compress(header.as_buffer()), member.compress(b"\r\n\r\n"), member.compress(body), member.compress(b"\r\n\r\n"), member.flush()]
                size += sum(map(len, held[-5:]))
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])

    return run


def unpacked(data, most: int = 1 << 20) -> Iterator[bytes]:
    """What the gzip members hold, one after the other, ``most`` bytes at a time; as it is if it is not compressed."""
    view = memoryview(data)
    if bytes(view[:2]) != MARK[:2]:
        yield bytes(view)
        return
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(view) and not member.unconsumed_tail:
                raise ValueError("archive ends within a record")
            some = member.unconsumed_tail or view[at : at + most]
            at += 0 if member.unconsumed_tail else len(some)
            yield member.decompress(some, most)
        at -= len(member.unused_data)


def records(data) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record in archive bytes; only the present record is held."""
    parts, room = unpacked(data), bytearray()

    def until(have) -> None:
        while (missing := have()) and (some := next(parts, None)) is not None:
            room.extend(some)
        if missing and bytes(room).strip():
            raise ValueError("archive ends within a record")

    while True:
        until(lambda: room.find(b"\r\n\r\n", 0) < 0)
        stop = room.find(b"\r\n\r\n")
        if stop < 0:
            return
        head = bytes(room[:stop]).decode()
        size = int(_fields(head)["content-length"])
        until(lambda: len(room) < stop + 8 + size)  # noqa: B023
        yield head, bytes(room[stop + 4 : stop + 4 + size])
        del room[: stop + 8 + size]


def _fields(head: str) -> dict[str, str]:
    return {name.lower(): value for name, _, value in (line.partition(": ") for line in head.split(_LINE)[1:])}


def parsed(with_payload: bool):
    """Records of archive bytes; a payload that its digest does not fit is an error."""
    names = ["id", "record_type", "refers_to", "url", "header", "digest", "bytes", "payload"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for head, block in records(content.as_buffer()):
                    fields = _fields(head)
                    kind = fields["warc-type"]
                    own, stored = hashlib.sha256(block).hexdigest(), kind != "revisit"
                    digest = fields.get("warc-payload-digest", f"sha256:{own}").removeprefix("sha256:")
                    if kind == "response" and "x-payload-length" in fields and own != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
                    refers = fields.get("x-refers-to-page-id") if kind == "revisit" else None
                    out.append((fields.get("x-page-id"), kind, refers, fields.get("warc-target-uri"), head, digest, len(block) if stored else None, block if with_payload and stored else None))
                    held += len(head) + len(block)
                    if held >= 8 * CHUNK_BYTES:
                        yield sent(out)
                        out, held = [], 0
                if out:
                    yield sent(out)

    return run


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """What is read back of each page's record; lengths of revisits come from the verified payload of their digest."""
    archive = Archive(spark)
    archive.write(pages)
    rows = archive.scratch.write(archive.read(with_payload=False).drop("payload", "header", "url"), "read")
    stored = rows.where("record_type = 'response'").groupBy("digest").agg(F.first("bytes").alias("stored"))
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"))
    stored = archive.scratch.write(stored.join(counts, "digest"), "stored")
    out = hot_join(rows, stored, ["digest"], "n", rows.count())
    kind = pages.schema["page_id"].dataType
    return out.select(F.col("id").cast(kind).alias("page_id"), F.col("stored").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
