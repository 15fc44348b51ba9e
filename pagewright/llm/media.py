"""Media columns: MPEG audio streams in binary columns.

`pack` stores bytes losslessly as an MPEG-1 Layer III stream (mono, 32 kHz, 48 kbit/s, checksums on, so that
each frame is 216 bytes and carries a unit of 192): an ID3v2 tag, a frame with the seek table of the Xing
form, the frames, an ID3v1 tag. `parse` reads streams of MPEG-1, 2 and 2.5, Layers I to III: it reads tags
(ID3v2.2 to 2.4, APE and ID3v1 skipped), finds frames again after foreign bytes, verifies checksums (of Layers I
and III; what Layer II's cover depends on its allocation tables), and gives exact durations and the frames'
places. Frames of free bitrate aren't known; a frame of another version, layer or sampling rate than the first is none.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.shared import binaries, spread, struct_of, written

# Fixed values of the frame header: kbit/s by (MPEG-1, layer), sampling rates by the bits of the version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
UNIT = 192
_HEADER = bytes((0xFF, 0xFA, 0x38, 0xC0))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(8)
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table.astype(np.uint16)


_CRC = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of MPEG audio of each row of bytes: polynomial 0x8005, start 0xFFFF, over the header's last two bytes and the side information."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


@functools.lru_cache(4096)
def checksum(data: bytes) -> int:
    return int(checksums(np.frombuffer(data, np.uint8)[None])[0])


@dataclass(frozen=True)
class Kind:
    """What a frame's header says of it."""

    first: bool  # MPEG-1
    layer: int
    rate: int
    size: int
    #: Bytes behind header and checksum that the checksum covers; None if the header alone can't tell.
    covered: int | None

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and not self.first else 1152


def _covered(first: bool, layer: int, mode: int, extension: int) -> int | None:
    if layer == 3:
        return (17 if mode == 3 else 32) if first else (9 if mode == 3 else 17)
    # Layer I: four bits for each of 32 bands and each channel; joint channels share the bands above a bound.
    return {3: 16, 1: 16 + 2 * (extension + 1)}.get(mode, 32) if layer == 1 else None


@functools.lru_cache(4096)
def frame_kind(header: bytes) -> Kind | None:
    """Of the frame that begins with these four bytes; None if none does."""
    if len(header) < 4 or header[0] != 0xFF or header[1] & 0xE0 != 0xE0:
        return None
    version, layer = header[1] >> 3 & 3, 4 - (header[1] >> 1 & 3)
    bitrate, rate = header[2] >> 4, header[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < bitrate < 15 or rate == 3:
        return None
    first, hertz, padding = version == 3, RATES[version][rate], header[2] >> 1 & 1
    bits = 1000 * BITRATES[first, layer][bitrate]
    kind = Kind(first, layer, hertz, 0, _covered(first, layer, header[3] >> 6, header[3] >> 4 & 3))
    size = (12 * bits // hertz + padding) * 4 if layer == 1 else kind.samples // 8 * bits // hertz + padding
    return dataclasses.replace(kind, size=size)


def frame_size(header: bytes) -> int | None:
    kind = frame_kind(header)
    return kind and kind.size


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pack(data: bytes) -> bytes:
    """The stream that holds data, its length a positive multiple of UNIT."""
    if not data or len(data) % UNIT:
        raise ValueError(f"not a positive multiple of {UNIT} bytes: {len(data)}")
    n, side = len(data) // UNIT, bytes(17)
    head = _HEADER + struct.pack(">H", checksum(_HEADER[2:] + side)) + side
    frames = np.zeros((n, 216), np.uint8)
    frames[:, : len(head)] = np.frombuffer(head, np.uint8)
    frames[:, len(head) : len(head) + UNIT] = np.frombuffer(data, np.uint8).reshape(n, UNIT)
    size = 216 * (n + 1)
    table = bytes(min(255, 256 * 216 * (1 + n * k // 100) // size) for k in range(100))
    first = (head + b"Info" + struct.pack(">III", 7, n, size) + table).ljust(216, b"\0")
    text = b"\3payload_bytes\0" + str(len(data)).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _syncsafe(len(frame)) + frame + first + frames.tobytes() + b"TAG".ljust(127, b"\0") + b"\xff"


@dataclass
class Parsed:
    rate: int = 0
    #: Samples of a frame.
    each: int = 1152
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    crc_errors: int = 0
    #: Times that bytes had to be skipped to find a frame again.
    resyncs: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    #: Frames and bytes that the seek table names, and its 100 places; None without a table.
    table: tuple[int, int, bytes] | None = None

    @property
    def samples(self) -> int:
        return self.each * len(self.offsets)


#: By the byte that begins a text in a tag.
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _texts(body: bytes) -> list[str]:
    """The strings of a text frame; UTF-16 without a mark of its order has the one first. A byte that names no encoding gives none."""
    if not body or body[0] >= len(_ENCODINGS):
        return []
    encoding, out, order = _ENCODINGS[body[0]], [], "utf-16-be"
    wide = 2 if encoding.startswith("utf-16") else 1
    data, at = body[1:], 0
    while at < len(data):
        end = next((k for k in range(at, len(data) - wide + 1, wide) if not any(data[k : k + wide])), len(data))
        one = data[at:end]
        if encoding == "utf-16":
            marked = one[:2] in (b"\xff\xfe", b"\xfe\xff")
            order = ("utf-16-le" if one[0] == 0xFF else "utf-16-be") if marked else order
            one = one[2:] if marked else one
        out.append(one.decode(order if encoding == "utf-16" else encoding, "replace"))
        at = end + wide
    return out


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Where the tag at the start ends. Its texts go to tags, several values parted by a slash; all other frames are left alone."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, flags, size = data[3], data[5], unsafe(data[6:10])
    after = min(len(data), 10 + size + 10 * (version >= 4 and bool(flags & 0x10)))
    tag = data[10 : 10 + size]
    if flags & 0x80 and version < 4:  # of version 4 each frame says so itself
        tag = tag.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3 and len(tag) >= 4:
        at = unsafe(tag) if version >= 4 else 4 + int.from_bytes(tag[:4])
    named, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(tag) and tag[at] != 0:
        told = tag[at + named : at + 2 * named]
        length = unsafe(told) if version >= 4 else int.from_bytes(told)
        name, body, of = tag[at : at + named].decode("latin-1"), tag[at + head : at + head + length], tag[at + 9] if version >= 4 else 0
        at += head + length
        packed = tag[at - length - 1] & 0x0C if version >= 4 else tag[at - length - 1] & 0xC0 if version == 3 else 0
        if name[0] != "T" or packed:  # no text, or compressed or encrypted
            continue
        body = body[4:] if of & 1 else body
        strings = _texts(body.replace(b"\xff\0", b"\xff") if of & 2 else body)
        if name in ("TXXX", "TXX"):
            tags[f"TXXX:{strings[0] if strings else ''}"] = "/".join(strings[1:])
        elif strings:
            tags[name] = "/".join(strings)
    return after


def _ape_bytes(data: bytes, end: int) -> int:
    """Bytes of an APE tag that ends there, its header included."""
    foot = data[max(0, end - 32) : end]
    if len(foot) < 32 or foot[:8] != b"APETAGEX":
        return 0
    return min(end, int.from_bytes(foot[12:16], "little") + 32 * (foot[23] >> 7))


def _table(frame: bytes, at: int) -> tuple[int, int, bytes] | None:
    """The seek table of a Xing, Info or VBRI header that stands in the first frame."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p, n, size = int.from_bytes(frame[at + 4 : at + 8]), at + 8, 0, 0
        if flags & 1:
            n, p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 2:
            size, p = int.from_bytes(frame[p : p + 4]), p + 4
        return n, size, frame[p : p + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI":
        return int.from_bytes(frame[50:54]), int.from_bytes(frame[46:50]), b""
    return None


def _crc_errors(data: bytes, offsets: np.ndarray) -> int:
    """How many of the frames at these places have a checksum that isn't theirs."""
    whole = np.frombuffer(data, np.uint8)
    heads = whole[offsets[:, None] + np.arange(4)]
    checked = heads[:, 1] & 1 == 0
    modes = heads[:, 3] >> 4
    wrong = 0
    # A stream has one version and layer, so the mode tells what a checksum covers.
    for mode in np.unique(modes[checked]).tolist():
        alike = checked & (modes == mode)
        side = frame_kind(heads[int(alike.argmax())].tobytes()).covered
        if side is None:
            continue
        of = offsets[alike]
        of, short = of[of + 6 + side <= len(whole)], int((of + 6 + side > len(whole)).sum())
        wrong += short
        if not len(of):
            continue
        rows = whole[of[:, None] + np.arange(6 + side)]
        if (rows == rows[0]).all():  # frames that begin alike, as those of `pack` do
            first = rows[0].tobytes()
            wrong += len(of) * (checksum(first[2:4] + first[6:]) != int.from_bytes(first[4:6]))
            continue
        told = rows[:, 4].astype(np.uint16) << np.uint16(8) | rows[:, 5]
        wrong += int((checksums(np.delete(rows[:, 2:], (2, 3), axis=1)) != told).sum())
    return wrong


def parse(data: bytes) -> Parsed:
    """What the stream holds. Bytes that are no frame are skipped; a frame counts if another, a tag or the end follows."""
    out = Parsed()
    at, end = _id3v2(data, out.tags), len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    end -= _ape_bytes(data, end)
    starts: list[int] = []
    sizes: list[int] = []
    lost, run, first = False, 1, None

    def alike(head: bytes) -> Kind | None:
        kind = frame_kind(head)
        return kind if kind and (first is None or (kind.first, kind.layer, kind.rate) == (first.first, first.layer, first.rate)) else None

    while at + 4 <= end:
        head = data[at : at + 4]
        kind = alike(head)
        size = kind and kind.size
        follows = kind is not None and at + size <= end and (at + size == end or lost is False or alike(data[at + size : at + size + 4]) is not None)
        if not follows:
            out.resyncs += not lost
            lost, run = True, 1
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost, n, first = False, 1, first or kind
        # Frames that begin alike are taken together: up to twice as many as the last time, so little more is looked at than is taken.
        most = min(run, (end - at) // size)
        if most > 1:
            heads = np.frombuffer(data, np.uint8, most * size, at).reshape(most, size)[:, :4]
            differs = (heads != heads[0]).any(axis=1)
            n = int(differs.argmax()) if differs.any() else most
        run = 2 * n if n == most else 1
        starts += range(at, at + n * size, size)
        sizes += [size] * n
        at += n * size
    if starts:
        out.rate, out.each = first.rate, first.samples
        out.offsets, out.sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        out.crc_errors = _crc_errors(data, out.offsets)
        frame = data[out.offsets[0] : out.offsets[0] + out.sizes[0]]
        out.table = _table(frame, 4 + 2 * (not frame[1] & 1) + first.covered) if first.layer == 3 else None
        if out.table is not None:  # that frame holds no sound
            out.offsets, out.sizes = out.offsets[1:], out.sizes[1:]
    return out


def unpack(data: bytes, parsed: Parsed | None = None) -> bytes:
    """The bytes that `pack` stored, taken from the frames' places."""
    parsed = parsed or parse(data)
    if not len(parsed.offsets):
        return b""
    whole = np.frombuffer(data, np.uint8)
    places = parsed.offsets[:, None] + 23 + np.arange(UNIT)
    body = whole[places].tobytes()
    return body[: int(parsed.tags.get("TXXX:payload_bytes", len(body)))]


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def _stored(batches):
    for batch in batches:
        texts = binaries(batch.column("text"))
        for k in range(0, len(texts), 256):  # so that few streams are in memory at once
            part = texts[k : k + 256]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, len(part)), pa.array([len(t or b"") for t in part], pa.int64()), pa.array([pack(padded(t)) for t in part], pa.large_binary()).cast(pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def media_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with spaces, as an MPEG audio stream.

    A null text is empty; an empty one is a unit of spaces. Repeated rows are stored each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_INDEXED = struct_of("duration_us long,seek_offsets binary")


def duration(parsed: Parsed) -> int:
    """In microseconds, exact but for what is less than one."""
    return 1_000_000 * parsed.samples // parsed.rate if parsed.rate else 0


@F.arrow_udf(_INDEXED)
def indexed(media: pa.Array) -> pa.Array:
    rows = []
    for m in media.to_pylist():
        parsed = None if m is None else parse(m)
        rows.append(None if parsed is None else {"duration_us": duration(parsed), "seek_offsets": parsed.offsets.astype("<u4").tobytes()})
    return pa.array(rows, pa.struct([("duration_us", pa.int64()), ("seek_offsets", pa.binary())]))


def with_index(media: DataFrame) -> DataFrame:
    """The media table with duration_us and seek_offsets (the frames' places, little-endian u32), to be stored beside the streams.

    They are null of a null stream, 0 and empty of one without a frame.
    """
    return media.withColumn("_i", indexed("media")).select(*media.columns, "_i.duration_us", "_i.seek_offsets")


_FEATURES = struct_of("payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string")


def features(media: bytes | None, duration_us: int, seek_offsets: bytes) -> tuple | None:
    """Of a stored stream, which must be as its stored duration and offsets say; None of null."""
    if media is None:
        return None
    parsed = parse(media)
    if (duration(parsed), parsed.offsets.astype("<u4").tobytes()) != (duration_us, seek_offsets):
        raise ValueError("a stream isn't what its stored duration and offsets say")
    payload = unpack(media, parsed)
    shown = f"frames={len(parsed.offsets)};samples={parsed.samples};rate={parsed.rate};crc_errors={parsed.crc_errors};resyncs={parsed.resyncs};table={parsed.table[0] if parsed.table else 0};seek={zlib.crc32(seek_offsets)}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), shown)


@F.arrow_udf(_FEATURES)
def featured(media: pa.Array, durations: pa.Array, offsets: pa.Array) -> pa.Array:
    rows = [features(*x) for x in zip(media.to_pylist(), durations.to_pylist(), offsets.to_pylist())]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.array([None if r is None else dict(zip(_FEATURES.names, r)) for r in rows], pa.struct(list(zip(_FEATURES.names, kinds))))


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests, feature, duration_us, seek_offsets) of a table of with_index: what the streams hold.

    A null stream has null features. Very long streams are read whole, one at a time. Rows that repeat are read
    each, an empty table gives none; other columns are left out.
    """
    return media.withColumn("f", featured("media", "duration_us", "seek_offsets")).select("doc_id", "n_bytes", "f.*", "duration_us", "seek_offsets")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as streams with their durations and seek offsets; what is returned comes from what is stored."""
    media = with_index(media_table(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    return media_features(written(media, "media"))
