import hashlib
import io

import pytest
import zstandard
from pyarrow import fs

from pagewright.llm import warc
from pagewright.storage import spread
from pagewright.llm.shared import new_folder


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, payload in data:
        same = [j for j, other in data if other == payload and j is not None]
        first = min(same, default=None)
        again = len(payload) >= warc.LEAST_PAYLOAD and first is not None and i != first
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    long, same = "<p>" + "words " * 60_000, "é" * 50
    return [
        (5, "http://a/5", same), (3, None, same), (9, "http://a/9\r\nX: y", same), (3, "http://a/3", "other"), (None, "http://a/n", same), (None, None, "z" * 200),
        (1, "http://a/1", None), (2, "http://a/2", ""), (4, "http://a/4", "x" * 99), (6, "http://a/6", "x" * 99), (7, "http://a/7", long), (8, "http://a/8", long),
        (10, "u", "WARC/1.1\r\n\r\n" * 20), (11, "u", "y" * 150), (11, "u", "y" * 150),
    ]


def test_round_trip(spark, rows, monkeypatch):
    pages = spark.createDataFrame([(*r, "d", "r") for r in rows], "page_id long, url string, html string, digest string, refers_to string")
    archive = warc.write_archive(pages, new_folder(spark, "t"))
    read = warc.read_archive(archive, spark)
    assert result(read) == expected(rows)
    assert {r.url for r in read.where("page_id = 9").collect()} == {"http://a/9\r\nX: y"}
    # Every row has an identifier of its own, those that repeat too.
    ids = [r.record_id for r in archive.index(spark).collect()]
    assert len(ids) == len(set(ids)) == len(rows)


def test_addresses_with_line_breaks_come_back():
    for url in ("http://a/\r\nb", "http://a/%0D%0Ab", "http://a/%\nb%25", "http://a/100%"):
        assert warc.parse(warc.record(1, url, b"x", "d", None)).headers["warc-target-uri"] == url


def test_empty_table(spark):
    archive = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), new_folder(spark, "t"))
    assert warc.read_archive(archive, spark).count() == 0


def test_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert result(warc.op8_warc_bundles(spark, "/root/testdata/sf0.001")) == expected(rows)


def test_frames_can_be_read_alone(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    path = str(tmp_path / "x.warc.zst")
    writer = warc.BundleWriter(fs.LocalFileSystem().open_output_stream(path, compression=None))
    records = [warc.record(k, "u", bytes([65 + k]) * 120 * k, hashlib.sha256(bytes([65 + k]) * 120 * k).hexdigest(), None) for k in range(6)]
    places = [writer.add(r) for r in records]
    writer.close()
    assert places[-1][0] > 2
    data = open(path, "rb").read()
    reader = warc.BundleReader(fs.LocalFileSystem().open_input_file(path))
    for r, (frame, at) in reversed(list(zip(records, places))):
        assert reader.frame(frame)[at : at + len(r)] == r
    # Any Zstandard reader takes the whole; the seek table is skipped.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read(1 << 20)
    assert whole == b"".join(records)
    broken = bytearray(data)
    broken[-9 - 12 * len(reader.frames) + 8] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.BundleReader(_file(tmp_path, broken)).frame(0)


def _file(folder, data):
    (folder / "broken").write_bytes(data)
    return fs.LocalFileSystem().open_input_file(str(folder / "broken"))


def test_references_are_to_records(spark, tmp_path):
    """Repeated rows, revisits among them, from a file and dealt out anew: one plain identifier a page and payload, and each reference is in the index."""
    from pyspark.sql import functions as F

    body = "<p>" + "same words " * 20
    rows = [(k, f"/{k}/", f"{body}{k // 4}") for k in range(40)] * 2 + [(3, "/other/", body + "0"), (None, None, body + "1"), (None, None, body + "1"), (7, "/7/", None), (7, "/7/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    pages = spread(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    archive = warc.write_archive(pages, str(tmp_path / "archive"))
    listed = archive.index(spark).collect()
    names = [r.record_id for r in listed]
    assert len(names) == len(set(names)) == len(rows)
    assert len([n for n in names if n.count(":") == 3]) == len({(i, h) for i, _, h in rows})
    referred, bundles = set(), {}
    for r in listed:
        at = f"{tmp_path}/archive/bundles/{r.bundle}"
        reader = bundles.setdefault(r.bundle, warc.BundleReader(fs.LocalFileSystem().open_input_file(at)))
        found = warc.parse(reader.frame(r.frame)[r.offset : r.offset + r.length])
        assert found.headers["warc-record-id"] == f"<{r.record_id}>"
        if "warc-refers-to" in found.headers:
            referred.add(found.headers["warc-refers-to"][1:-1])
    assert len(referred) == 10 and referred <= set(names)
    back = warc.read_archive(archive, spark)
    assert back.count() == len(rows) and back.where("record_type = 'revisit'").count() == 2 * 30 + 3
    assert back.where(F.col("refers_to").isNotNull()).select("refers_to").distinct().count() == 10
