import base64
import hashlib

from nodeloom.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        key = html or ""
        if len(key.encode()) >= least and page is not None:
            first[key] = min(first.get(key, page), page)
    out = []
    for page, _, html in rows:
        key = html or ""
        f = first.get(key, page) if len(key.encode()) >= least else page
        out.append((page, len(key.encode()), digest(key), "response" if f == page else "revisit", None if f == page else f))
    return sorted(out, key=str)


ROWS = [(5, "http://a", "x\r\n\r\ny"), (3, None, "x\r\n\r\ny"), (9, "http://b\r\nX: 1", "WARC/1.0\r\nContent-Length: 3\r\n\r\n"), (1, "u", None), (2, "u", ""), (7, "u", "é" * 9000), (7, "u", "é" * 9000), (8, "v", "é" * 9000), (10, "v", "z")]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumnRenamed("none", "none")
    for least in (0, 1, 10):
        got = warc.archive(pages, str(tmp_path / f"w{least}"), least)
        assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS, least)


def test_extra_columns_nulls_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "q", "d"), (4, "u", "q", "d"), (None, None, "w", "d")], "page_id long, url string, html string, digest string")
    got = warc.archive(pages, str(tmp_path / "n"))
    assert sorted(map(tuple, got.select("page_id", "record_type", "refers_to").collect()), key=str) == sorted([(None, "revisit", 4), (4, "response", None), (None, "response", None)], key=str)
    assert warc.archive(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_gzip_and_foreign_records():
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    assert [bytes(b) for _, b in warc.parse(gzip.compress(one + one))] == [block, block]
    assert [bytes(b) for _, b in warc.parse(gzip.compress(one) * 3 + b"\0")] == [block] * 3


def test_damaged_archives():
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    without = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nlost\r\n\r\n"
    count = lambda x: len(list(warc.parse(x)))
    assert count(one + one[:-6]) == 1 and count(one + one[:20]) == 1 and count(without + one) == 1 and count(b"") == 0 and count(b"no archive") == 0
    assert count(one.replace(b"4", b"four") + one) == 1
    packed = gzip.compress(one) * 2
    assert count(packed[:-8]) == 2 and count(packed[: len(packed) // 2 + 5]) == 1 and count(gzip.compress(one) + b"\x1f\x8bgarbage") == 1


def test_payloads():
    get = lambda block, **h: bytes(warc.payload_of({k.replace("_", "-"): v for k, v in h.items()}, block))
    assert get(b"HTTP/1.1 200 OK\r\nX: " + b"h" * 5000 + b"\r\n\r\nbody") == b"body"
    assert get(b"HTTP/1.1 200 OK\r\nX: 1") == b"" and get(b"plain\r\n\r\ntext") == b"plain\r\n\r\ntext" and get(b"\r\n\r\nx", content_type="application/http; msgtype=response") == b"x"


def test_one_id_with_several_payloads(spark, tmp_path):
    rows = [(1, "u", "first"), (1, "u", "other"), (2, "v", "other"), (2, "v", "first"), (3, "w", "third")]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "i"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_files_by_bytes_with_a_member_per_record(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(200)] + [(999, "long", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.with_revisits(pages).coalesce(1), str(tmp_path / "f"), file_bytes=4000)
    files = sorted((tmp_path / "f").glob("part-*"))
    assert len(files) > 5 and all(f.stat().st_size < 8000 for f in files)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 201
    assert sum(sum(1 for _ in warc.unpacked(f.read_bytes())) for f in files) == 201
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, str(tmp_path / "f")).collect()} == {i: len(t.encode()) for i, _, t in rows}
