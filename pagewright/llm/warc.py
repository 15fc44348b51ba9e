"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some records, and a skippable frame at the end
with the seek table: every frame's compressed and decompressed size and checksum (the published seekable
format). Any frame can be read alone. The index maps a record's identifier to its bundle, frame and the
place within the decompressed frame.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import binaries, new_folder, spread, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 256 << 20, 3
#: Frames of a bundle that are read together.
READ = 64
#: Payloads of fewer bytes are always stored.
LEAST_PAYLOAD = 100
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "record_id string, bundle string, frame int, offset long, length long"


class BundleWriter:
    def __init__(self, stream, level: int = LEVEL):
        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=level).compress
        self.held, self.table, self.size = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and place within it."""
        if self.held and len(self.held) + len(record) > FRAME_BYTES:
            self._flush()
        at = len(self.held)
        self.held += record
        return len(self.table), at

    def _flush(self) -> None:
        frame = self.compress(bytes(self.held))
        self.stream.write(frame)
        self.table.append((len(frame), len(self.held), xxhash.xxh64_intdigest(bytes(self.held)) & 0xFFFFFFFF))
        self.size += len(frame)
        self.held = bytearray()

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    def __init__(self, file):
        self.file = file
        end = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table at the end")
        width = 12 if flags & 0x80 else 8
        table = self._at(end - 9 - n * width, n * width)
        self.frames, at = [], 0
        for k in range(n):
            compressed, size = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, compressed, size, struct.unpack_from("<I", table, k * width + 8)[0] if width == 12 else None))
            at += compressed

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        at, compressed, size, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(at, compressed), max_output_size=size)
        if len(data) != size or check is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data


def _broken(value: str) -> bool:
    return "\r" in value or "\n" in value


def _header(value: str) -> str:
    """A header's value: what would end its line is percent-encoded, and then every % too."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if _broken(value) else value


def record_id(page_id: int | None, digest: str, again: int | None = None) -> str:
    """A record's identifier; `again` tells rows with one page and payload apart."""
    return f"urn:x-page:{'' if page_id is None else page_id}:{digest}{'' if again is None else f':{again}'}"


def page_of(identifier: str) -> int | None:
    page = identifier.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit of refers_to's with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest, again)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
        if _broken(url):
            lines.append("X-Target-URI-Encoding: percent")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Profile: {_PROFILE}"]
    block = head + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Read:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Read:
    """A record by its headers and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = lambda of: {k.lower(): v for k, v in (line.split(": ", 1) for line in of)}
    headers = fields(lines)
    if headers.get("x-target-uri-encoding") == "percent":
        headers["warc-target-uri"] = unquote(headers["warc-target-uri"])
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Read(headers, fields(http.decode().split("\r\n")[1:]), payload)


def _write(folder: str):
    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        writer, name, rows, n = None, "", [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url")], binaries(batch.column("html")), [batch.column(c).to_pylist() for c in ("digest", "refers_to", "again")]
            for page_id, url, html, digest, refers_to, again in zip(*columns[0], columns[1], *columns[2]):
                if writer is None:
                    system.create_dir(path, recursive=True)
                    # A name that no other attempt at this task has; only the index tells which files count.
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(posixpath.join(path, name), compression=None))
                data = record(page_id, url, html or b"", digest, refers_to, again)
                frame, offset = writer.add(data)
                rows.append((record_id(page_id, digest, again), name, frame, offset, len(data)))
                if writer.size > BUNDLE_BYTES:
                    writer.close()
                    writer = None
                if len(rows) >= 10_000:
                    yield _rows(rows)
                    rows = []
        if writer is not None:
            writer.close()
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["record_id", "bundle", "frame", "offset", "length"])


@dataclass(frozen=True)
class Archive:
    folder: str

    def index(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(f"{self.folder}/index")


def _told_apart(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with `again`: null for the first row of a page and payload, which has the plain identifier; of those that repeat it, their place.

    Rows that repeat are written with their places before these are compared: a row counted in two branches of a plan
    may have another place in each.
    """
    repeated = told.where("n > 1").select(F.col("page_id").alias("p"), F.col("digest").alias("d"))
    none = rows.withColumn("again", F.lit(None).cast("long"))
    if repeated.isEmpty():
        return none
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    several = written(rows.hint("merge").join(repeated, same, "left_semi").withColumn("place", F.monotonically_increasing_id()), "repeats")
    plain = several.groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(F.min("place").alias("plain"))
    again = F.when(F.col("place") != F.col("plain"), F.col("place")).alias("again")
    return none.hint("merge").join(repeated, same, "left_anti").unionByName(several.hint("merge").join(plain, same).select(*rows.columns, again))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """A record for each row of pages, in bundles below folder.

    Of rows with equal payloads of LEAST_PAYLOAD bytes or more that with the smallest page_id is a response,
    and those with larger ones are revisits of it. Rows that repeat the smallest page_id are responses too,
    and so are rows without page_id unless a row with one has their payload. A null html is an empty payload,
    a null url leaves its header out; a very long payload has a frame of its own. Rows that repeat page and
    payload have identifiers of their own; one of them has the plain one, to which revisits refer. An empty table leaves an empty index; other
    columns are ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    # Only identifiers and digests meet by digest; counted first, so that one digest of very many pages is small.
    told = written(rows.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("bytes")), "told")
    first = told.where(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("pages")).where("pages > 1 AND least IS NOT NULL")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("least")), F.col("least")).alias("refers_to")
    extra = told.join(first, "digest").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), refers).where("refers_to IS NOT NULL")
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    rows = _told_apart(rows, told).hint("merge").join(extra, same, "left")
    ordered = rows.select("page_id", "url", "html", "digest", "refers_to", "again").sortWithinPartitions("page_id")
    ordered.mapInArrow(_write(f"{folder}/bundles"), _INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return Archive(folder)


def _frames(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        name, number, reader, data = None, None, None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] != name:
                    if reader is not None:
                        reader.file.close()
                    name, number = r["bundle"], None
                    reader = BundleReader(system.open_input_file(posixpath.join(path, name)))
                if r["frame"] != number:
                    number = r["frame"]
                    data = reader.frame(number)
                found = parse(data[r["offset"] : r["offset"] + r["length"]])
                identifier = found.headers["warc-record-id"][1:-1]
                if identifier != r["record_id"]:
                    raise ValueError(f"{r['record_id']} isn't where the index says")
                digest, kind = found.headers["warc-payload-digest"].removeprefix("sha256:"), found.headers["warc-type"]
                if kind == "response" and hashlib.sha256(found.payload).hexdigest() != digest:
                    raise ValueError(f"{identifier} has another payload")
                refers = found.headers.get("warc-refers-to")
                rows.append((page_of(identifier), found.headers.get("warc-target-uri"), int(found.http["content-length"]), digest, kind, page_of(refers[1:-1]) if refers else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if reader is not None:
            reader.file.close()

    return run


def read_archive(archive: Archive, spark: SparkSession) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all records, each frame read once.

    Responses' payloads are held against their digests; revisits give what their own headers say. An empty
    archive gives no rows. Frames are dealt READ at a time, so that a bundle's seek table is read for so many.
    """
    dealt = archive.index(spark).repartition("bundle", F.expr(f"frame div {READ}")).sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(_frames(f"{archive.folder}/bundles"), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archive = write_archive(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")), new_folder(spark, "warc"))
    return read_archive(archive, spark).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
