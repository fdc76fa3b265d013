"""WARC archives as a chunked record table.

A payload travels as rows of (record, chunk number, bytes), never longer than CHUNK_BYTES in a worker's Python, both on the
way into an archive and out of it; every chunk read back carries the digest of the payload so far, and the last one the
digest of all of it.  Archives are runs of gzip members, one a record.  A task names its files anew at each attempt and
hands them over only through the manifest that Spark commits, so files of lost attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exalake.llm.text_arrays import shared_dir

CHUNK_BYTES = 1 << 20
#: A new archive is begun once one has so many compressed bytes.
ARCHIVE_BYTES = 128 << 20
GZIP_LEVEL = 3
READ_BYTES = 1 << 18
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = "record string, uri string, record_type string, refers_to string, chunk_no long, is_last boolean, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_chunks(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of records in chunks: record, uri, sha1 (hex), n_bytes, refers_to, chunk_no, payload.

    Of records with equal payloads of at least min_bytes, those with the largest id are responses; others revisit it.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("record"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("body"))
    rows = rows.select("*", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n_bytes"))
    copies = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(copies, ["sha1", "n_bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("keeper").cast("string")))
    pieces = F.when(F.col("refers_to").isNull() & (F.col("n_bytes") > 0), F.ceil(F.col("n_bytes") / chunk_bytes)).otherwise(1).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    cut = F.when(F.col("refers_to").isNull(), F.col("body").substr(F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.select("record", "uri", "sha1", "n_bytes", "refers_to", "chunk_no", cut.alias("payload"))


def _urn(record: str | None) -> str:
    return "<urn:null:>" if record is None else f"<urn:page:{quote(record, safe='')}>"


def _of_urn(urn: str) -> str | None:
    return unquote(urn[10:-1]) if urn.startswith("<urn:page:") else None


class ArchiveWriter:
    """Writes record chunks to archives of one task; a record is a gzip member."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder, self.out, self.done = folder, None, []
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.zip, self.records, self.bytes = None, 0, 0

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def begin(self, record: str | None, uri: str | None, sha1: str, n_bytes: int, refers_to: str | None) -> None:
        self.end_record()
        if self.out is not None and self.bytes >= ARCHIVE_BYTES:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.records, self.bytes = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
        block = len(http) + (0 if refers_to is not None else n_bytes)
        uri = quote(uri or "", safe="%/:=&?~#+!$,;'@()*[]")
        lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(record)}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}", "Content-Type: application/http; msgtype=response"]
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        self.zip = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        self._put(self.zip.compress("\r\n".join([*lines, f"Content-Length: {block}", "", ""]).encode() + http))
        self.records += 1

    def chunk(self, payload: bytes | None) -> None:
        if payload:
            self._put(self.zip.compress(payload))

    def end_record(self) -> None:
        if self.zip is not None:
            self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
            self.zip = None

    def close(self) -> list[tuple[str, int, int]]:
        self.end_record()
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, self.bytes))
            self.out = None
        return self.done


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write payload_chunks rows (each record's on end, in order) as archives; returns the committed manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ArchiveWriter(folder)
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in ("record", "uri", "sha1", "n_bytes", "refers_to", "chunk_no")]
            payload = batch.column(names.index("payload"))
            for i, (record, uri, sha1, n, refers, k) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
                if k == 0:
                    out.begin(record, uri, sha1, n, refers)
                out.chunk(payload[i].as_py())
        done = out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    from pyarrow import fs

    spark = chunks.sparkSession
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    chunks.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


class _Stream:
    """Bytes of all gzip members of an archive on end, a bounded piece at a time."""

    def __init__(self, source):
        self.source, self.zip, self.ready, self.raw = source, zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:  # what the decompressor still holds back
                    got = b"" if self.zip.eof else self.zip.decompress(b"", READ_BYTES)
                    self.ready += got
                    return bool(got)
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            got = self.zip.decompress(self.raw, READ_BYTES)
            self.raw = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if got:
                self.ready += got
                return True

    def head(self) -> bytes | None:
        """Up to and with the next blank line; None at the end."""
        while (at := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                if self.ready.strip():
                    raise ValueError("the archive ends within a record's head")
                return None
        out, self.ready = self.ready[: at + 4], self.ready[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        """At most n bytes, at least one."""
        if not self.ready and not self.fill():
            raise ValueError("the archive ends within a record")
        out, self.ready = self.ready[:n], self.ready[n:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def read_records(source, chunk_bytes: int = CHUNK_BYTES, keep_payload: bool = True) -> Iterator[tuple]:
    """Chunk rows of one open archive, in the order of CHUNKS."""
    stream = _Stream(source)
    while (head := stream.head()) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        warc = _fields(head)
        left, record, kind = int(warc["content-length"]), _of_urn(warc["warc-record-id"]), warc["warc-type"]
        http_head = stream.head() or b""
        left -= len(http_head)
        stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
        refers = _of_urn(warc["warc-refers-to"]) if "warc-refers-to" in warc else None
        base = (record, unquote(warc.get("warc-target-uri", "")), kind, refers)
        if kind == "revisit":
            yield (*base, 0, True, None, int(_fields(http_head).get("content-length", 0)), stated, True)
        else:
            sha, size, k = hashlib.sha1(), 0, 0
            while True:
                piece = b""
                while left and len(piece) < chunk_bytes:
                    got = stream.take(min(left, chunk_bytes - len(piece)))
                    piece += got
                    left -= len(got)
                sha.update(piece)
                size += len(piece)
                now = base32_sha1(sha.digest())
                yield (*base, k, not left, piece if keep_payload else None, size, now, now == stated if not left else None)
                k += 1
                if not left:
                    break
        if stream.head() != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_archives(manifest: DataFrame, keep_payload: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of all archives of a manifest: CHUNKS, with payload_bytes and payload_digest of the payload so far.

    A revisit is one row without payload; its bytes and digest are those its head states.
    """
    n = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for row in read_records(source, chunk_bytes, keep_payload):
                        rows.append(row)
                        size += len(row[6] or b"") + 300
                        if size >= 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                    if rows:
                        yield pack(rows)

    return manifest.select("path").repartition(max(1, n), "path").mapInArrow(read, CHUNKS)


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages to archives in folder, read them back; one row a record.

    Columns: id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to (the response's id for revisits), uri,
    digest_ok (what was read has the digest that the head states).  A null payload is an empty one; empty payloads equal
    each other.  Rows that repeat an id with the same payload are responses alike; a null id is less than any other.  An
    empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType
    chunks = read_archives(write_archives(payload_chunks(pages, id_col, url_col, payload_col, min_bytes), folder), keep_payload=False)
    return chunks.where("is_last").select(F.col("record").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri", "digest_ok")


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "warc")
