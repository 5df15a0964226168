"""WARC archives: one gzip member per record, read back sequentially with framing and digest checks."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, join_hot, ship, table
from loomgraph.scratch import delete_at_end, shared_root

#: WARC 1.1 names.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the reader asks the file for, and those that one decompression step may yield.
READ_BYTES = 1 << 18
STEP_BYTES = 1 << 18
#: Keys broadcast at most; beyond, the join is shuffled.
BROADCAST_KEYS = 1_000_000


class WarcError(ValueError):
    """A record that is cut short, framed wrongly or doesn't match its digest."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds a whole record."""
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class _Inflated:
    """The bytes of one gzip member at a time, decompressed step by step."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.out, self.ended = source, b"", bytearray(), True
        self.inflater = None

    def next_member(self) -> bool:
        """False at the end of the file."""
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
        if not self.raw:
            return False
        self.inflater, self.ended, self.out = zlib.decompressobj(31), False, bytearray()
        return True

    def _more(self) -> None:
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise WarcError("the file ends within a gzip member")
        try:
            self.out += self.inflater.decompress(self.raw, STEP_BYTES)
        except zlib.error as error:
            raise WarcError(f"damaged gzip member: {error}") from error
        if self.inflater.eof:
            self.ended, self.raw = True, self.inflater.unused_data
        else:
            self.raw = self.inflater.unconsumed_tail

    def line(self) -> bytes:
        while (at := self.out.find(b"\r\n")) < 0:
            if self.ended:
                raise WarcError("a header line is cut short")
            self._more()
        out = bytes(self.out[:at])
        del self.out[: at + 2]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.out:
                if self.ended:
                    raise WarcError("a block is shorter than its content length")
                self._more()
            out = bytes(self.out[:n])
            del self.out[: len(out)]
            n -= len(out)
            yield out

    def finish(self) -> None:
        while not self.ended:
            self._more()
        if self.out:
            raise WarcError("a gzip member holds more than one record")


def read_records(source: BinaryIO, verify: bool = True) -> Iterator[tuple[dict[str, str], bytes]]:
    """Lower-case headers and block of each record; WarcError for one that is damaged or fails its digest."""
    stream = _Inflated(source)
    while stream.next_member():
        if stream.line() != VERSION:
            raise WarcError("a record doesn't begin with the version")
        headers: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError("a record has no content length") from None
        sha1, parts = hashlib.sha1(), []
        for part in stream.exactly(length):
            sha1.update(part)
            parts.append(part)
        if b"".join(stream.exactly(4)) != b"\r\n\r\n":
            raise WarcError("a record doesn't end with two line ends")
        stream.finish()
        want = headers.get("warc-block-digest", "").removeprefix("sha1:")
        if verify and want and want != base64.b32encode(sha1.digest()).decode():
            raise WarcError("a block doesn't match its digest")
        yield headers, b"".join(parts)


# ---- Spark ------------------------------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def record_id(page_id: object, url: str | None, sha: str, copy: int) -> str:
    """Equal for equal arguments; copy numbers the records of one page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, sha, copy)))}>"


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes each page's record to archives under `folder` (a URI that all executors share); a table of the archives.

    pages: page_id, url, html; other columns, whatever their names, are not read. Of pages with equal payloads of at least
    min_revisit_bytes, that with the smallest page_id (null last), then url, is a response and the others, which carry no
    payload, revisit it; null html is an empty payload. Rows that repeat a page are revisits of it but for one. A payload of any
    size is one record. An empty table writes no archive.

    What decides is the table of distinct pages (id, url, digest) and their counts. Revisits are written from it alone, so only
    responses need their html, and no row needs a number that a lost executor might deal anew. Each task writes a file of a name
    of its own and returns that name; only names that reach the returned table count, so a task that ran twice adds nothing.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit(""))
    text = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    keyed = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).cast("long").alias("size"))
    keyed = keyed.withColumn("key", F.unhex(F.md5(F.concat_ws("\0", text("page_id"), "sha", text("url")).cast("binary"))))
    distinct = keyed.groupBy("key", "page_id", "url", "sha", "size").agg(F.count(F.lit(1)).alias("n"))
    distinct = scratch.save(distinct, "distinct")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "key")
    groups = distinct.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("c"))
    groups = scratch.save(groups.where(F.col("rows") > 1).drop("rows"), "groups")
    total = int(groups.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    copies = scratch.save(join_hot(distinct.where(F.col("size") >= min_revisit_bytes), groups, ["sha"], "c", total).withColumn("is_first", F.col("key") == F.col("first.key")), "copies")
    # rows that aren't responses, or of which one is
    dropped = copies.where(~F.col("is_first") | (F.col("n") > 1)).select("key", "n")
    least = max(200, total // 500)
    few = dropped.count() <= BROADCAST_KEYS
    kept = keyed.join(F.broadcast(dropped if few else dropped.where(F.col("n") > least)).select("key"), "key", "left_anti")
    if not few:
        kept = kept.join(dropped.where(F.col("n") <= least).select("key"), "key", "left_anti")
    repeated = copies.where(F.col("is_first") & (F.col("n") > 1)).select("key")
    once = keyed.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_KEYS else repeated, "key", "left_semi").dropDuplicates(["key"])
    columns = ["page_id", "url", "html", "sha", "size"]
    none = [F.lit(None).cast(pages.schema["page_id"].dataType).alias("first_id"), F.lit(None).cast("string").alias("first_url"), F.lit(False).alias("revisit"), F.lit(0).cast("long").alias("copy")]
    rows = kept.select(*columns, *none)
    if not repeated.isEmpty():
        rows = rows.unionByName(once.select(*columns, *none))
    again = copies.withColumn("copy", F.explode(F.expr("CASE WHEN is_first AND n = 1 THEN array() ELSE sequence(CAST(is_first AS BIGINT), n - 1) END")))
    again = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "size", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("revisit"), "copy")
    rows = rows.unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, count = None, "", 0
        filesystem, base = _file_system(folder)
        for batch in batches:
            for page_id, url, html, sha, size, first_id, first_url, revisit, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    filesystem.create_dir(base, recursive=True)
                    sink = filesystem.open_output_stream(path, compression=None)
                block = b"" if revisit else (html or "").encode()
                headers = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", record_id(page_id, url, sha, copy)),
                    ("WARC-Target-URI", " ".join((url or "").split())),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("Content-Type", "text/html; charset=utf-8"),
                    ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"),
                    ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
                    ("X-Payload-Length", str(size)),
                ]
                if page_id is not None:
                    headers.append(("X-Page-ID", str(page_id)))
                if revisit:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first_id, first_url, sha, 0)), ("WARC-Refers-To-Target-URI", " ".join((first_url or "").split()))]
                    headers.append(("X-Refers-To-Page-ID", "" if first_id is None else str(first_id)))
                sink.write(record_bytes(headers, block))
                count += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "records": pa.array([count], pa.int64())})

    archives = scratch.save(rows.mapInArrow(run, "path string, records long"), "archives")
    scratch.drop("distinct", "groups", "copies")
    return archives


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: headers as columns, the payload (null for a revisit), its length and checked digest.

    No archives give no rows. One task reads an archive from its start to its end and holds one record at a time. A damaged archive raises WarcError.
    """
    ship(archives.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = _file_system(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with filesystem.open_input_stream(path, compression=None) as source:
                    for headers, block in read_records(source):
                        kind, want = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(block) != want:
                            raise WarcError(f"{path}: a payload doesn't match its digest")
                        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((int(page) if page else None, headers.get("warc-target-uri") or None, kind, int(refers) if refers else None, int(headers["x-payload-length"]), want, block if kind == "response" else None))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `pages` written by write and read back by read; their docstrings give the results for nulls, empty and long pages, ties,
    repeats and empty tables."""
    folder = f"{shared_root(spark)}/warc-files-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    archives = write(table(spark, sf_dir, "pages"), folder)
    return read(archives, folder).drop("payload").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
