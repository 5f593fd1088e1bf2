import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import divergence as X


def brute(rows):
    upper = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(upper))) for _, text, lang, source in rows]
    out = set()
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        seen = Counter(t for *_, w in own for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        count = defaultdict(Counter)
        for _, s, w in own:
            count[s].update(t for t in w if seen[t] >= 3)
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            parts = {"pair": [(sum(f(p(count[s], t), p(count[o], t)) for t in kept), o) for o in count if o != s], "term": [(f(p(count[s], t), p(whole, t)), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= 200}
    return out


def corpus(n=150):
    rng = random.Random(4)
    words = ["the", "The", "naïve", "東京", "É", "éa", "x1y", "it's", "\U0001f642", "a[b", "ſ", "K"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words[: rng.choice([12, 60, 312])], k=rng.randrange(60))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "é", "Z", None, "f"])) for i in range(n)]
    rows += [(1, None, "en", "empty"), (2, "", "solo", "one"), (None, "lone words", "xx", "p"), (None, "!!", "xx", "q"), (3, "the " * 5000, "en", "a"), (3, "the " * 5000, "en", "a")]
    return rows


@pytest.mark.parametrize("size", [1 << 28, 1])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(X, "CIRCULATING", size)  # all rounds at once, or two by two
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, lang string, source string, block int, `a.b` string").repartition(5)
    got = [tuple(r) for r in X.source_divergence(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_few_rows(spark):
    kind = "doc_id long, text string, lang string, source string"
    assert X.source_divergence(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, None, None, None), (1, "a a", "en", "x"), (2, "a", "en", "x"), (3, "a b", "en", "x")]
    assert {tuple(r) for r in X.source_divergence(spark.createDataFrame(rows, kind)).collect()} == brute(rows)


def test_each_two_meet_once_and_are_spread(spark):
    for sources in (1, 2, 3, 4, 9, 20):
        seats = sources + sources % 2
        own = spark.range(sources).selectExpr("id as seat", f"{sources}L as sources", f"{seats}L as seats")
        met, hosts = Counter(), Counter()
        for turn in range(seats - 1):
            pairs = [(r.seat, r.host) for r in own.withColumn("host", F.explode(X._guests(turn, turn + 1))).collect()]
            assert len({x for p in pairs for x in p}) == 2 * len(pairs) == sources - sources % 2  # each is in one meeting of a round
            met.update((min(p), max(p)) for p in pairs)
            hosts.update(h for _, h in pairs)
        assert set(met.values()) <= {1} and len(met) == sources * (sources - 1) // 2
        assert max(hosts.values(), default=0) <= seats / 2 + 1


def test_probabilities_of_huge_counts_are_exact():
    counts = np.array([0, 1, 10**9, 10**14, 3 * 10**15])
    got = X.probabilities(counts, 4 * 10**15, 10**9)
    assert got.tolist() == [1 + 10**9 * (int(c) + 1) // (4 * 10**15 + 10**9) for c in counts]
