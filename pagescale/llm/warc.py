"""WARC archives as tables of chunk rows: no record is ever held whole by the reader."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import scratch_path

CHUNK_CHARS = 1 << 20
LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def with_decisions(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """`_payload`, `_bytes`, `_digest` and `_refers` (the id of the record that a revisit repeats, else null) beside id and url.

    Smallest ids are found by a combinable aggregate; payloads meet them by a join whose hot side the engine can split.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), url.alias("_url"), payload.alias("_payload"), F.octet_length(payload).cast("long").alias("_bytes"), F.sha2(payload, 256).alias("_digest"))
    firsts = rows.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    joined = rows.join(firsts, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") >= least), "left")
    return joined.withColumn("_refers", F.when(~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first"))).drop("_d", "_first")


def chunk_rows(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", chunk_chars: int = CHUNK_CHARS, least: int = LEAST_SHARED, date: str = DATE) -> DataFrame:
    """The archive: rows (archive, record, chunk, data); the data of a record's chunks in order are its WARC bytes.

    Chunk 0 is the WARC and HTTP head, the payload follows in pieces of `chunk_chars` characters, then two line ends.
    A null payload is empty, a null id is written as `null`, repeated rows give a record each. Line ends in a url
    become spaces.
    """
    rows = with_decisions(pages, id_col, payload_col, least)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit(CRLF))
    revisit = F.col("_refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), line("Content-Length", F.col("_bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("_url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("_url", r"[\r\n]+", " "))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("_refers"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    pieces = F.when(revisit, 0).otherwise(F.ceil(F.length("_payload") / chunk_chars)).cast("int")
    rows = rows.select(F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("record"), head.alias("_head"), "_payload", pieces.alias("_pieces"))
    rows = rows.select("archive", "record", "_head", "_payload", "_pieces", F.explode(F.sequence(F.lit(0), F.col("_pieces"))).alias("chunk"))
    body = F.when(F.col("chunk") == 0, F.col("_head")).otherwise(F.substr("_payload", (F.col("chunk") - 1) * chunk_chars + 1, F.lit(chunk_chars)))
    data = F.concat(body, F.when(F.col("chunk") == F.col("_pieces"), CRLF * 2).otherwise(""))
    return rows.select("archive", "record", "chunk", F.encode(data, "UTF-8").alias("data"))


class RecordReader:
    """Reads one record from successive pieces of its bytes and keeps its head and running digest only."""

    def __init__(self) -> None:
        self.head = b""
        self.fields: dict[str, str] | None = None
        self.left = self.payload_bytes = 0
        self.http = b""
        self.in_payload = False
        self.digest = hashlib.sha256()

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            head, end, data = self.head.partition(b"\r\n\r\n")
            if not end:
                return
            lines = head.decode("utf-8").split(CRLF)
            if not lines[0].startswith("WARC/"):
                raise ValueError("a record must start with its WARC version")
            self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left, self.head = int(self.fields["content-length"]), b""
        data = data[: self.left]
        self.left -= len(data)
        if not self.in_payload:
            self.http += data
            head, end, data = self.http.partition(b"\r\n\r\n")
            if not end:
                return
            self.in_payload, self.http = True, head
        self.payload_bytes += len(data)
        self.digest.update(data)

    def row(self) -> dict:
        """The record's digest columns; raises where bytes are missing or differ from the head."""
        if self.fields is None or self.left:
            raise ValueError("a record ends early")
        number = lambda key: None if (x := self.fields[key].removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
        kind, digest = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha256:")
        told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.http.decode("utf-8").split(CRLF)[1:])}
        n_bytes = int(told["content-length"])
        if kind == "response" and (self.payload_bytes, self.digest.hexdigest()) != (n_bytes, digest):
            raise ValueError(f"payload of {self.fields['warc-record-id']} differs from its digest")
        return {"page_id": number("warc-record-id"), "url": self.fields.get("warc-target-uri"), "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to") if kind == "revisit" else None}


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    at, reader = None, None
    for batch in batches:
        out = []
        for record, data in zip(batch.column("record").to_pylist(), batch.column("data")):
            if record != at:
                if reader is not None:
                    out.append(reader.row())
                at, reader = record, RecordReader()
            reader.feed(data.as_py())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if reader is not None:
        yield pa.RecordBatch.from_pylist([reader.row()], schema=schema)


def read_records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the bytes of its chunks in order; digests run along from chunk to chunk."""
    return chunks.select("record", "chunk", "data").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_read, READ_SCHEMA)


def write_archives(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write the archives of all pages under `path` and return their chunk rows as read from there."""
    chunk_rows(pages, **options).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def export_file(chunks: DataFrame, archive: int, path: str) -> int:
    """One archive as a plain WARC file on the driver's disk, row by row; returns its bytes."""
    n = 0
    with open(path, "wb") as out:
        for row in chunks.where(F.col("archive") == archive).orderBy("record", "chunk").select("data").toLocalIterator():
            n += out.write(row.data)
    return n


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives written to the shared folder and read back."""
    return read_records(write_archives(pages, scratch_path(pages.sparkSession, "warc"), **options))
