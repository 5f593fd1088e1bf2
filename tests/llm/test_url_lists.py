import datetime as dt
import random
from collections import Counter

from corpuslens.llm import url_lists as U

DAY = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]


def brute(captures, entries):
    def host_path(url):
        rest = (url or "").split("://", 1)[-1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
        return rest[:cut].rpartition("@")[2].lower().split(":")[0].rstrip("."), path.split("?")[0].split("#")[0].lower()

    def active(kind, pattern, day):
        own = [(d, y) for k, p, d, y in entries if None not in (k, p, d, y) and (k, p.lower()) == (kind, pattern) and d <= day]
        if not own:
            return None
        days = {}
        for d, y in own:
            days[d] = max(y, days.get(d, False))
        since = None
        for d in sorted(days):
            since = (since or d) if days[d] else None
        return since

    out = Counter()
    for i, url, day in captures:
        host, path = host_path(url)
        labels, steps = host.split("."), [s for s in path.split("/") if s]
        names = {("host", host)} | {("domain", ".".join(labels[k:])) for k in range(len(labels))} | {("prefix", "/".join([host, *steps[:k]])) for k in range(len(steps) + 1)}
        hits = sorted((f"{k}:{p}", since) for k, p in names if day and (since := active(k, p, day)))
        out[i, host, day, len(hits), *(hits[0] if hits else (None, None)), bool(hits)] += 1
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    urls = ["http://a.b.Example.com/X/y?q", "https://b.example.com:8443", "u@c.org/x", "c.org/x/y/z/", "http://c.org./x/y#f", "", None, "http://d.net?x/y"]
    patterns = [("host", "b.example.com"), ("domain", "example.com"), ("domain", "COM"), ("prefix", "c.org/x/y"), ("prefix", "c.org"), ("host", ""), ("prefix", "a.b.example.com/x")]
    captures = [(i, rng.choice(urls), rng.choice(DAY)) for i in range(300)] + [(None, urls[0], DAY[9]), (7, urls[0], None), (8, urls[2], DAY[20]), (8, urls[2], DAY[20])]
    entries = [(*rng.choice(patterns), rng.choice(DAY), rng.random() < 0.6) for _ in range(60)] + [(None, "x", DAY[0], True), ("host", None, DAY[0], True), ("host", "c.org", None, True), ("host", "c.org", DAY[0], None)]
    a = spark.createDataFrame([(*c, "t", 1) for c in captures], "page_id long, url string, fetched date, kind string, part int").repartition(3)
    b = spark.createDataFrame([(*e, "n") for e in entries], "kind string, pattern string, dated date, listed boolean, page_id string")
    got = Counter((r.page_id, r.host, r.fetched, r.n_rules, r.rule, r.rule_since, r.blocked) for r in U.verdicts(a, b).collect())
    assert got == brute(captures, entries)
    assert U.verdicts(a.limit(0), b).count() == 0
    assert {r.blocked for r in U.verdicts(a, b.limit(0)).collect()} == {False}
