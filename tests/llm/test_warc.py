import gzip
import hashlib
import random
import re
from collections import Counter

import pytest

from corpuslens.llm import warc as W


def brute(rows):
    head = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= W.LEAST:
            head[html] = max(i, head.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        h = head.get(html, i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if h == i else "revisit", None if h == i else h))
    return Counter(out)


def rows():
    rng = random.Random(8)
    bodies = ["é" * 499, "é" * 500, "é" * 501, "x" * 1000, "same" * 400, "\r\n\r\nWARC/1.1\r\n" * 100, "", None, "small", "<p>" * 60000]
    urls = ["http://b.a.example.com/x?q=1#f", "https://A.Example.com:443/", "example.com", "", None, "http://u@h.example.org:8080/a b\tc", "ftp://x"]
    out = [(i, rng.choice(urls), rng.choice(bodies) if rng.random() < 0.7 else f"own {i} " + "y" * rng.randrange(2000)) for i in range(300)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "k") for r in data], "page_id long, url string, html string, key string").repartition(3)


@pytest.mark.parametrize("lines", [3, 512])
def test_records_come_back(spark, monkeypatch, lines):
    monkeypatch.setattr(W, "BLOCK_LINES", lines)
    data = rows()
    df = frame(spark, data)
    archives = W.write(df)
    got = W.read_records(archives, W.lookup(spark, archives, df), payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(data)
    html = {i: (h or "").encode() for i, _, h in data}
    assert all((bytes(r.payload) == html[r.page_id]) if r.record_type == "response" else r.payload is None for r in got)
    some = spark.createDataFrame([(data[5][1], 5), ("http://nowhere.example/", 5), (data[9][1], 9), (data[9][1], 9)], "url string, page_id long")
    assert sorted(r.id for r in W.lookup(spark, archives, some).collect()) == [5, 9]
    files = archives.captures.select("file").distinct().collect()
    whole = b"".join(gzip.decompress(open(f"{archives.folder.removeprefix('file://')}/{r.file}", "rb").read()) for r in files)
    assert whole.count(b"X-Page-ID") == len(data) and whole.count(b"WARC-Type: warcinfo") == len(files)
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>", whole)
    assert len(ids) == len(set(ids)) == len(data) + len(files)


def test_repeated_and_missing_ids_and_no_rows(spark):
    body = "z" * 1500
    df = frame(spark, [(3, "http://a.com/", body), (3, "http://a.com/", body), (1, None, body), (None, "http://b.com/", body), (None, None, None)])
    archives = W.write(df)
    got = W.read_records(archives, W.lookup(spark, archives, df)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "response", None), (-1, "revisit", 3), (1, "revisit", 3), (3, "response", None), (3, "response", None)]
    none = W.write(df.limit(0))
    assert W.read_records(none, W.lookup(spark, none, df)).count() == 0


def test_keys():
    assert W.reversed_key("HTTP://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert W.reversed_key("https://u:p@h.example.org:8080?x y") == "org,example,h:8080)?x%20y"
    assert W.reversed_key(None) == ")/"


def test_a_damaged_payload_is_an_error():
    record = W._record(7, "http://a/", b"abc", hashlib.sha1(b"abc").digest(), 3, None)
    assert W.parse(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        W.parse(record.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_the_smallest_id_is_not_a_missing_one(spark):
    least, body = -(1 << 63), "z" * 1500
    df = frame(spark, [(least, "http://a.com/", body), (None, "http://a.com/", "small"), (None, "http://a.com/", body), (4, "u v", "w" * 2000), (least, "u v", "w" * 2000)])
    archives = W.write(df)
    got = W.read_records(archives, W.lookup(spark, archives, df)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter([(least, 1500, "response", None), (None, 5, "response", None), (None, 1500, "response", None), (4, 2000, "response", None), (least, 2000, "revisit", 4)])


def test_many_copies_and_several_read_tasks(spark):
    df = frame(spark, [(i, f"http://h{i % 7}.com/", "z" * 1500) for i in range(300)])
    archives = W.write(df)
    records = W.read_records(archives, W.lookup(spark, archives, df))
    assert Counter((r.record_type, r.refers_to) for r in records.collect()) == {("response", None): 1, ("revisit", 299): 299}
    assert records.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
