import gzip
import io
import random

from idlattice.llm import warc

from ..conftest import SMALL

LARGE, PDF = "<p>" + "x" * 120, "é" * 60
ROWS = [
    (5, "http://a/", LARGE), (3, "http://b/", LARGE), (9, None, LARGE), (1, "http://c/", "small"), (2, "http://c/", "small"), (4, "", None), (6, "http://d/ e\r\nf", ""), (7, "u", PDF), (8, "u", PDF),
    (10, "u", "<html>" + "".join(chr(random.Random(1).randrange(32, 1000)) for _ in range(300_000))), (3, "http://b/", LARGE), (None, "n", LARGE), (11, "g", "\x1f\x8b\x08 WARC/1.1 \r\n\r\n" * 20),
]


def pages(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, first int")


def expected():
    first = {}
    for k, _, h in ROWS:
        h = (h or "").encode()
        if len(h) >= 100 and k is not None:
            first[h] = min(k, first.get(h, k))
    out = []
    for k, _, h in ROWS:
        h = (h or "").encode()
        original = first.get(h)
        again = k is not None and original is not None and original < k
        out.append((k, len(h), warc.hashlib.sha256(h).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    assert sorted((tuple(r) for r in warc.round_trip(pages(spark)).collect()), key=str) == expected()
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_any_cut_gives_each_record_once(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.plan(pages(spark).coalesce(1)), path)
    whole = sorted(map(str, warc.read(spark, path).drop("payload").collect()))
    assert len(whole) == len(ROWS)
    for size in (37, 1000, 65_536):
        got = warc.read(spark, path, size) if size > 1000 else None
        if got is not None:
            assert sorted(map(str, got.drop("payload").collect())) == whole
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    for size in (37, 1000):
        n = sum(len(list(warc.records_in(io.BytesIO(data), k, min(k + size, len(data))))) for k in range(0, min(len(data), 20_000), size))
        n += len(list(warc.records_in(io.BytesIO(data), -(-min(len(data), 20_000) // size) * size, len(data))))
        assert n == len(ROWS)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(ROWS)


def test_payloads_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.plan(spark.read.parquet(f"{SMALL}/pages.parquet")), path)
    html = {f"urn:idlattice:page:{r.page_id}": r.html.encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = warc.read(spark, path).where("record_type = 'response'").collect()
    assert rows and all(bytes(r.payload) == html[r.record_id] for r in rows)


def test_shuffled_plan_agrees(spark, monkeypatch):
    few = sorted(map(str, warc.plan(pages(spark)).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.plan(pages(spark)).collect())) == few


def found(data, size):
    return [(h["WARC-Record-ID"], b) for k in range(0, len(data), size) for h, b in warc.records_in(io.BytesIO(data), k, min(k + size, len(data)))]


def one(key, payload):
    return warc.record(key, "u", payload, "d", len(payload), None, "2024-01-01T00:00:00Z")


BAD = [b"WARC/1.1\r\nno colon here\r\nContent-Length: 1\r\n\r\nx", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", b"WARC/1.1\r\nA: \xff\xfe\r\nContent-Length: 1\r\n\r\nx", b"WARC/1.1\r\nContent-Length: many\r\n\r\nx", b"WARC/1.1 without an end"]


def test_bad_headers_are_no_records():
    good = [gzip.compress(one(k, b"p" * k)) for k in range(3)]
    data = good[0] + b"".join(map(gzip.compress, BAD)) + good[1] + warc.EMPTY_MEMBER + b"junk" + warc.MAGIC + b"junk" + good[2]
    for size in (50, 10_000):
        assert [len(b) for _, b in found(data, size)] == [0, 1, 2]
    data = b"".join([good[0], *map(gzip.compress, BAD), good[1], good[2]])
    assert [len(b) for _, b in found(data, 60)] == [0, 1, 2]


def test_several_records_in_a_member_and_a_broken_one():
    data = gzip.compress(b"".join(one(k, b"p" * k) for k in range(4)))
    assert [len(b) for _, b in found(data, 7)] == [0, 1, 2, 3]
    noise = random.Random(1).randbytes(9000)
    whole = gzip.compress(one(7, noise))
    assert [(k, b and len(b)) for k, b in found(data + whole[:5000], 300)][4:] == [("<urn:idlattice:page:7>", None)]


def test_a_member_inside_a_payload_is_no_record():
    inner = gzip.compress(one(1, b"inner" * 9))
    noise = random.Random(2).randbytes(3000)
    packer = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)  # stored: the payload's bytes appear as they are
    outer = packer.compress(one(2, noise + inner + noise)) + packer.flush()
    data = outer + gzip.compress(one(3, b"after"))
    assert inner in data
    for size in (40, 500, 3000, 100_000):
        assert [k[-2] for k, _ in found(data, size)] == ["2", "3"]


def test_ranges_grow_with_the_archives(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    warc.write(warc.plan(pages(spark).coalesce(1)), path)
    monkeypatch.setattr(warc, "RANGE", 10)
    monkeypatch.setattr(warc, "MOST_RANGES", 7)
    assert warc.ranges(spark, path).count() <= 7 and warc.read(spark, path).where("complete").count() == len(ROWS)
