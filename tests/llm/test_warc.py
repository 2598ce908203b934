"""Archives: round trips, records split by their own payload, damaged files, and the report against brute force."""

import gzip
import hashlib

from cutline.llm import warc

PAGES = [(1, "http://a.example/x?y=1#z", "<p>é " + "x" * 200), (2, "http://b.example", "<p>é " + "x" * 200), (0, None, "<p>é " + "x" * 200), (3, "nothing", None),
         (4, "http://c.example/a\r\nSet: 1", ""), (5, "http://d.example/", "short"), (6, "http://d.example/", "short"),
         (7, "http://e.example/", "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9),
         (7, "http://e.example/", "one\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n" * 9),
         (8, "http://f.example/", "日本 🙂 \x00 " * 5000), (None, "http://g.example/", "y" * 150), (None, "http://g.example/", "y" * 150), (9, "http://g.example/", "y" * 150)]


def expected(pages):
    first = {}
    for p, _, html in pages:
        if p is not None and len((html or "").encode()) >= 100:
            first[html] = min(p, first.get(html, p))
    out, done = [], set()
    for p, _, html in pages:
        data = (html or "").encode()
        again = p is not None and len(data) >= 100 and (first[html] != p or (p, html) in done)
        done.add((p, html))
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


def report(captures):
    return sorted(((r["metadata"]["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_page"]) for r in captures.collect()), key=repr)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int").repartition(3)
    warc.write(pages, str(tmp_path / "a"), per_file=5)
    found = warc.captures(warc.read(spark, str(tmp_path / "a")))
    assert report(found) == expected(PAGES)
    rows = found.collect()
    assert {(r["metadata"]["page_id"], bytes(r["payload"]).decode()) for r in rows} == {(p, h or "") for p, _, h in PAGES}
    byid = {r["metadata"]["page_id"]: r for r in rows}
    assert byid[1]["request"]["http_head"] == "GET /x?y=1 HTTP/1.1\r\nHost: a.example"
    assert byid[4]["target_uri"] == "http://c.example/a%0D%0ASet: 1" and byid[0]["target_uri"] is None
    assert byid[5]["response"]["head"].startswith("HTTP/1.1 200 OK\r\n")


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert warc.captures(warc.read(spark, str(tmp_path / "a"))).count() == 0


def test_damaged_and_foreign_files(spark, tmp_path):
    whole = b"WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <1>\r\nX: a\r\n b\r\nContent-Type: application/http\r\nContent-Length: 9\r\n\r\nH\r\n\r\n\xff\xfe\x00a\r\n\r\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 90\r\n\r\nfew"))
    (tmp_path / "f" / "2.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"))
    rows = warc.read(spark, str(tmp_path / "f")).collect()
    assert sorted(r["type"] for r in rows) == ["damaged", "damaged", "response"]
    (good,) = [r for r in rows if r["type"] == "response"]
    assert bytes(good["payload"]) == b"\xff\xfe\x00a" and good["record_id"] == "<1>" and good["http_head"] == "H"
    assert warc.captures(warc.read(spark, str(tmp_path / "f")), payloads=False).count() == 1
