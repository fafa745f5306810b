import gzip
import hashlib

import pytest
from marketprose.llm import warc


def http(payload: bytes, *lines: str) -> bytes:
    return "\r\n".join(["HTTP/1.1 200 OK", *lines, "", ""]).encode() + payload


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    bodies = [("http://a/", "text/html", http(b"x\n\ny")), ("http://b/%20", "text/plain", b""), ("dns:b", "text/dns", b"20200101\nb. 1 IN A 1.2.3.4\n")]
    content = warc.arc_file(version, "f.arc", "20200102030405", bodies)
    for stored in (content, gzip.decompress(content)):
        got = list(warc.arc_records(stored))
        assert got[0][1]["url"] == "filedesc://f.arc" and got[0][1]["version"] == str(version)
        assert [(f["url"], f["content_type"], b) for _, f, b in got[1:]] == bodies
        plain = gzip.decompress(content)
        assert all(plain[o:].startswith(f["url"].encode()) for o, f, _ in got)


def test_arc_with_blanks_in_the_url_and_a_version_block_of_either_kind():
    block = b"2 0 x\nURL IP-address ...\n\n"
    head = f"filedesc://y 0.0.0.0 19970101000000 text/plain {len(block)}\n".encode()
    record = b"http://a/b c 1.2.3.4 19970102030405 text/html 200 - - 99 y 3\nabc\n"
    got = list(warc.arc_records(head + block + record))
    assert got[1][1]["url"] == "http://a/b c" and got[1][1]["result"] == "200" and got[1][2] == b"abc"


@pytest.mark.parametrize("content", [b"hello\n", b"filedesc://x 0 0 text/plain 4\n9 0\n", b"filedesc://x 0.0.0.0 1 text/plain 900\n1 0 x\n"])
def test_bad_arc(content):
    with pytest.raises(ValueError):
        list(warc.arc_records(content))


def test_dates():
    assert warc.warc_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert warc.warc_date("199713") == warc.warc_date("-") == "1970-01-01T00:00:00Z"


def test_converted_records():
    fields = {"url": "http://a/", "ip": "1.2.3.4", "date": "20200101000000", "content_type": "text/html"}
    body = http(b"payload", "X-Page-Id: 4")
    whole = list(warc.warc_records(warc.converted("f.arc", 10, fields, body, None)))
    again = list(warc.warc_records(warc.converted("f.arc", 99, fields, body, whole[0][0]["warc-record-id"])))
    (head, block), (revisit, rest) = whole[0], again[0]
    assert head["warc-type"] == "response" and block == body and head["warc-ip-address"] == "1.2.3.4"
    assert head["warc-payload-digest"] == revisit["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"payload").hexdigest()
    assert revisit["warc-type"] == "revisit" and body.startswith(rest) and b"payload" not in rest
    assert revisit["warc-refers-to"] == head["warc-record-id"] != revisit["warc-record-id"]
    plain = next(warc.warc_records(warc.converted("f.arc", 5, fields | {"url": "dns:a"}, b"1.2.3.4", None)))
    assert plain[0]["warc-type"] == "resource"


def test_tables(spark):
    long = "é" * 60 + "x" * 50
    rows = [(5, "u", long), (3, "v", long), (9, "w w", long), (1, None, None), (2, "", ""), (4, "x", "short"), (6, "x", "short"), (7, "y", "a" * 99),
            (8, "y", "a" * 99), (10, "z", "b" * 100), (11, "z", "b" * 100), (3, "v", long), (None, "n", long), (12, "big", "c" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS path")
    arcs = warc.write_arc(pages.repartition(3), file_bytes=500)
    records = warc.read_warc(warc.arc_to_warc(arcs))
    got = warc.with_targets(records.drop("payload")).collect()
    assert len(got) == len(rows)
    for page, _, text in rows:
        payload = (text or "").encode()
        same = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        mine = [r for r in got if r.page_id == page]
        for r in mine:
            assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
            assert r.record_type == "response" if r.refers_to is None else r.refers_to == min(same)
        first = len(payload) < 100 or page == min(same)
        assert sum(r.record_type == "response" for r in mine) == (1 if page == 3 or first else 0)
    kept = {r.page_id: bytes(r.payload).decode() for r in records.filter("record_type = 'response'").collect()}
    assert kept[3] == long and kept[1] == "" and len(kept[12]) == 3_000_000
    empty = warc.with_targets(warc.read_warc(warc.arc_to_warc(warc.write_arc(pages.limit(0)))).drop("payload"))
    assert empty.count() == 0
