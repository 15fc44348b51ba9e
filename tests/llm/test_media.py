import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=1500))
def test_round_trip(data):
    payload = media.padded(data)
    stream = media.pack(payload)
    parsed = media.parse(stream)
    assert media.unpack(stream, parsed) == payload
    assert (len(parsed.offsets), parsed.crc_errors, parsed.resyncs) == (len(payload) // 192, 0, 0)
    assert parsed.table[:2] == (len(payload) // 192, 216 * (len(payload) // 192 + 1)) and len(parsed.table[2]) == 100


def test_padding():
    assert media.padded(None) == media.padded(b"") == b" " * 192
    assert media.padded(b"a" * 192) == b"a" * 192 and len(media.padded(b"a" * 193)) == 384
    with pytest.raises(ValueError):
        media.pack(b"x")


def test_resynchronisation_and_checksums():
    stream = media.pack(b"q" * 192 * 10)
    whole = media.parse(stream)
    start, size = int(whole.offsets[3]), 216
    broken = stream[:start] + b"noise \xff\xfa junk" + stream[start:]
    parsed = media.parse(broken)
    assert parsed.resyncs == 1 and len(parsed.offsets) == 10 and int(parsed.offsets[3]) == start + 13
    damaged = bytearray(stream)
    damaged[start + 8] ^= 0x40  # in the side information that the checksum covers
    assert media.parse(bytes(damaged)).crc_errors == 1
    cut = media.parse(stream[: start + size + 100])
    assert len(cut.offsets) == 4


def test_frames_of_several_sizes():
    """44.1 kHz frames with and without padding, no checksum: 417 and 418 bytes at 128 kbit/s."""
    frames = b"".join(bytes((0xFF, 0xFB, 0x90 | pad << 1, 0xC0)) + bytes((417 if not pad else 418) - 4) for pad in (0, 1, 1, 0, 1))
    parsed = media.parse(b"junk" + frames)
    assert parsed.sizes.tolist() == [417, 418, 418, 417, 418] and parsed.rate == 44_100 and parsed.offsets[0] == 4
    assert parsed.samples == 5 * 1152


#: By hand from the standard's tables: header, bytes of a frame, samples of a frame, sampling rate.
KINDS = [
    ((0xFF, 0xFF, 0x10, 0xC0), 32, 384, 44_100), ((0xFF, 0xFF, 0xE6, 0x00), 452, 384, 48_000), ((0xFF, 0xFD, 0x80, 0x00), 417, 1152, 44_100), ((0xFF, 0xFD, 0xE8, 0x00), 1728, 1152, 32_000),
    ((0xFF, 0xF3, 0x80, 0xC0), 208, 576, 22_050), ((0xFF, 0xF3, 0xE4, 0x00), 480, 576, 24_000), ((0xFF, 0xF5, 0x88, 0xC0), 576, 1152, 16_000), ((0xFF, 0xF7, 0x14, 0xC0), 64, 384, 24_000),
    ((0xFF, 0xE3, 0x10, 0xC0), 52, 576, 11_025), ((0xFF, 0xE3, 0x88, 0xC0), 576, 576, 8_000),
]


@pytest.mark.parametrize("head,size,samples,rate", KINDS)
def test_kinds_of_frames(head, size, samples, rate):
    frame = bytes(head).ljust(size, b"\0")
    parsed = media.parse(frame * 3 + b"\xff\xfa junk" + frame * 2)
    assert parsed.sizes.tolist() == [size] * 5 and (parsed.rate, parsed.samples, parsed.resyncs) == (rate, 5 * samples, 1)


def test_other_kinds_are_no_frames():
    one, other = bytes((0xFF, 0xF3, 0x80, 0xC0)).ljust(208, b"\0"), bytes((0xFF, 0xFB, 0x90, 0xC0)).ljust(417, b"\0")
    assert media.parse(one * 2 + other * 3 + one * 2).sizes.tolist() == [208] * 4
    assert not len(media.parse(b"\xff\xea\x90\xc0" + bytes(500)).offsets) and not len(media.parse(b"\xff\xf9\x90\xc0" + bytes(500)).offsets)


@pytest.mark.parametrize("head,covered", [((0xFF, 0xFE, 0xC0, 0x00), 32), ((0xFF, 0xFE, 0xC0, 0xC0), 16), ((0xFF, 0xFE, 0xC0, 0x50), 20), ((0xFF, 0xF2, 0x80, 0xC0), 9), ((0xFF, 0xF2, 0x80, 0x00), 17), ((0xFF, 0xFA, 0x90, 0x40), 32)])
def test_what_checksums_cover(head, covered):
    body = bytes(range(1, covered + 1))
    size = media.frame_size(bytes(head))
    frame = (bytes(head) + bit_by_bit(bytes(head[2:]) + body).to_bytes(2) + body).ljust(size, b"\0")
    assert media.parse(frame * 3).crc_errors == 0
    wrong = frame[: 5 + covered] + b"\0" + frame[6 + covered :]
    assert media.parse(frame + wrong + frame).crc_errors == 1


def tagged(version, frames, flags=0, before=b"", after=b""):
    body = before + b"".join(frames)
    return b"ID3" + bytes((version, 0, flags)) + bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) + body + after


def tag_frame(name, body, version=3, of=0):
    size = bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0)) if version == 4 else len(body).to_bytes(3 if version == 2 else 4)
    return name + size + (b"" if version == 2 else bytes((0, of))) + body


@pytest.mark.parametrize("body", [b"\0caf\xe9", b"\1\xff\xfec\0a\0f\0\xe9\0", b"\1\xfe\xff\0c\0a\0f\0\xe9\0\0", b"\2\0c\0a\0f\0\xe9", "\3café\0".encode(), b"\1\0c\0a\0f\0\xe9"])
def test_encodings_of_tags(body):
    sound = bytes((0xFF, 0xFB, 0x90, 0xC0)).ljust(417, b"\0")
    for version in (2, 3, 4):
        name = b"TT2" if version == 2 else b"TIT2"
        picture = tag_frame(b"PIC" if version == 2 else b"APIC", b"\0binary", version)
        parsed = media.parse(tagged(version, [picture, tag_frame(name, body, version)]) + sound * 2)
        assert parsed.tags == {name.decode(): "café"} and len(parsed.offsets) == 2 and parsed.resyncs == 0


def test_tags_with_more_about_them():
    sound = bytes((0xFF, 0xFB, 0x90, 0xC0)).ljust(417, b"\0")
    title = tag_frame(b"TIT2", b"\0x")
    third = tagged(3, [title, bytes(20)], 0x40, b"\0\0\0\6" + bytes(6))
    fourth = tagged(4, [tag_frame(b"TIT2", b"\3x\0y", 4)], 0x50, b"\0\0\0\6\1\0", after=b"3DI" + bytes(7))
    synced = tagged(3, [tag_frame(b"TIT2", b"\1\xff\xfex\0")[:-4] + b"\xff\0\xfex\0"], 0x80)
    frame = tagged(4, [tag_frame(b"TIT2", b"\0\0\0\5\1\xff\0\xfex\0", 4, 3)])
    hidden = tagged(3, [tag_frame(b"TIT2", b"\0x", 3, 0x80), tag_frame(b"TXXX", b"\1\xff\xfek\0\0\0\xff\xfev\0")])
    for tag, told in ((third, {"TIT2": "x"}), (fourth, {"TIT2": "x/y"}), (synced, {"TIT2": "x"}), (frame, {"TIT2": "x"}), (hidden, {"TXXX:k": "v"}), (tagged(4, [tag_frame(b"TIT2", b"\7x", 4), tag_frame(b"TPE1", b"", 4)]), {})):
        parsed = media.parse(tag + sound * 2)
        assert (parsed.tags, len(parsed.offsets), parsed.resyncs) == (told, 2, 0)


def test_tags_at_the_end():
    sound = bytes((0xFF, 0xFB, 0x90, 0xC0)).ljust(417, b"\0")
    foot = lambda flags: b"APETAGEX" + (2000).to_bytes(4, "little") + (42).to_bytes(4, "little") + (1).to_bytes(4, "little") + flags.to_bytes(4, "little") + bytes(8)
    for ape in (foot(0xA0 << 24) + bytes(10) + foot(1 << 31), bytes(10) + foot(0)):
        parsed = media.parse(sound * 2 + ape + b"TAG".ljust(128, b"\0"))
        assert len(parsed.offsets) == 2 and parsed.resyncs == 0


def test_many_frames_of_alternating_size():
    import time

    frames = b"".join(bytes((0xFF, 0xFA, 0x90 | pad << 1, 0xC0)) + bytes((417 if not pad else 418) - 4) for pad in (0, 1)) * 50_000
    start = time.perf_counter()
    parsed = media.parse(frames)
    assert time.perf_counter() - start < 2
    assert len(parsed.offsets) == 100_000 and parsed.crc_errors == 100_000 and media.duration(parsed) == 1_000_000 * 1152 * 100_000 // 44_100
    assert parsed.offsets.tolist() == [k // 2 * 835 + k % 2 * 417 for k in range(100_000)]


def bit_by_bit(data):
    """The checksum as the standard has it, one bit after the other."""
    register = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in data):
        carry = register >> 15 ^ int(bit)
        register = register << 1 & 0xFFFF ^ (0x8005 if carry else 0)
    return register


@given(st.binary(min_size=1, max_size=34))
def test_checksum(data):
    assert media.checksum(data) == bit_by_bit(data)


def test_seeking_by_the_stored_offsets(spark):
    texts = ["a" * 1000, "short", None]
    stored = media.with_index(media.media_table(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    for r, text in zip(sorted(stored, key=lambda r: r.doc_id), texts):
        offsets = [int.from_bytes(r.seek_offsets[k : k + 4], "little") for k in range(0, len(r.seek_offsets), 4)]
        units = b"".join(bytes(r.media[o + 23 : o + 23 + 192]) for o in offsets)
        assert units == media.padded((text or "").encode()) and all(r.media[o : o + 2] == b"\xff\xfa" for o in offsets)
        assert r.duration_us == len(offsets) * 36_000


def test_a_stream_that_its_index_does_not_fit(spark):
    rows = media.with_index(media.media_table(spark.createDataFrame([(1, "text")], "doc_id int, text string"))).selectExpr("doc_id", "n_bytes", "media", "duration_us + 1 AS duration_us", "seek_offsets")
    with pytest.raises(Exception, match="stored duration"):
        media.media_features(rows).collect()


def test_nothing_to_parse():
    for data in (b"", b"ID3", b"\xff" * 50, b"TAG" + bytes(125)):
        assert not len(media.parse(data).offsets)


def check(spark, path_rows, df):
    want = sorted((i, len((t or "").encode()), hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-16:])) for i, t in path_rows if i is not None)
    rows = df.collect()
    assert sorted((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows if r.doc_id is not None) == want
    return rows


def test_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = check(spark, docs, media.op10_media_columns(spark, "/root/testdata/sf0.001"))
    assert all("crc_errors=0;resyncs=0" in r.feature and f"samples={r.payload_bytes // 192 * 1152};" in r.feature for r in rows)


def test_awkward_rows(spark, awkward, nothing):
    from .conftest import AWKWARD

    rows = check(spark, AWKWARD, media.media_features(media.with_index(media.media_table(awkward))))
    assert len(rows) == len(AWKWARD) and all(r.duration_us == r.payload_bytes // 192 * 36_000 for r in rows)
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id == 1}) == 1
    assert media.media_features(media.with_index(media.media_table(nothing))).count() == 0
