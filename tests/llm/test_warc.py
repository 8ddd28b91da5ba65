import hashlib
import struct

import pytest
import zstandard

from roadlens.llm.warc import archived_pages, frame_end, parse_record, read_archives, read_frames, record, write_archives

SCHEMA = "page_id long, url string, html string, key string, n long"


def test_round_trip(spark):
    big = "<p>é</p>" * 400
    pages = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (7, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "again", big)]
    pages += [(100 + i, f"http://c/{i}", f"<html>{i}" + "x y " * 300) for i in range(40)] + [(9007199254740993, "u", big + "!")]
    df = spark.createDataFrame([(*p, "k", 0) for p in pages], SCHEMA)
    got = archived_pages(df).collect()
    assert len(got) == len(pages)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        revisit = html == big and i != 7
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert archived_pages(df, broadcast_rows=0).count() == len(pages)
    assert archived_pages(df.limit(0)).count() == 0
    assert len(archived_pages(df, archive_bytes=5000, longest=10).collect()) == len(pages)
    folder = write_archives(df, archive_bytes=5000)
    assert 10 < spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).count() and read_archives(spark, folder).where("error is not null").count() == 0


def test_one_large_partition_among_small_ones(spark):
    """The large one holds more than an archive may, all others together far less: what counts is the largest, not the average."""
    html = lambda i: " ".join(str((i * 7919 + j * j) % 10007) for j in range(250))
    df = spark.createDataFrame([(i, "u", html(i), "k", 0) for i in range(60)], SCHEMA).coalesce(1)
    for i in range(30):
        df = df.unionByName(spark.createDataFrame([(1000 + i, "u", "small", "k", 0)], SCHEMA).coalesce(1))
    folder = write_archives(df, archive_bytes=20_000, longest=10)
    by = read_archives(spark, folder).groupBy("archive").agg({"payload_bytes": "sum", "page_id": "count"}).collect()
    assert sum(r["count(page_id)"] for r in by) == 90 and max(r["sum(payload_bytes)"] for r in by) <= 40_000


def test_a_broken_archive_ends_the_job(spark, tmp_path, monkeypatch):
    from roadlens.llm import warc

    data = record(1, "u", b"payload", None, False, "1970-01-01T00:00:00Z").replace(b"payload", b"pAyload")
    (tmp_path / "part-0").write_bytes(zstandard.ZstdCompressor().compress(data))
    monkeypatch.setattr(warc, "write_archives", lambda pages: str(tmp_path))
    with pytest.raises(Exception, match="payload digest differs"):
        archived_pages(spark.createDataFrame([], SCHEMA)).collect()


def test_archive_is_plain_zstandard(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 200, "", 0) for i in range(50)], SCHEMA).coalesce(1)
    folder = write_archives(df)
    content = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).first()["content"])
    size = struct.unpack_from("<I", content, 4)[0]
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    whole = b"".join(decoder.decompressobj(read_across_frames=True).decompress(content[8 + size :]) for _ in [0])
    assert whole == b"".join(read_frames(content)) and whole.count(b"WARC/1.1\r\n") == 50
    with pytest.raises(ValueError):
        list(read_frames(content[:-9]))
    with pytest.raises(ValueError):
        frame_end(memoryview(b"not a frame at all"), 0)


def test_broken_records_are_told():
    good = record(1, "u", b"payload", None, False, "1970-01-01T00:00:00Z")
    assert parse_record(good)["error"] is None
    for bad in (b"", b"HTTP/1.1 200 OK\r\n\r\n", good[:-1], good.replace(b"payload", b"pAyload"), good.replace(b"WARC-Date", b"Date"), good.replace(b"sha1:", b"md5:"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        assert parse_record(bad)["error"]
