import hashlib
import random
import re

import pytest
from test_minhash import thue_morse

from corpuslens.llm import substring as S


def brute(rows):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = set(), {}
    for i in sorted(words, key=lambda k: (k is None, k)):
        w = words[i]
        gone = [False] * len(w)
        for k in range(len(w) - S.WINDOW + 1):
            x = tuple(w[k : k + S.WINDOW])
            if x in seen:
                gone[k : k + S.WINDOW] = [True] * S.WINDOW
            seen.add(x)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def rows():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(rng.choice([19, 20, 21, 27, 60])) for _ in range(8)]
    out = []
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += fresh(rng.randrange(0, 30)) + (rng.choice(passages) if rng.random() < 0.6 else [])
        if out and rng.random() < 0.2:
            w = list(rng.choice(out))
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "edit"
        out.append(w)
    texts = [rng.choice([" ", "\n", " \t "]).join(w) for w in out]
    texts += [None, "", "  ", "a " * 19, "a " * 500, "b " * 20, "b " * 20, "ä ö " * 45, "ä ö " * 45]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True)) + [(None, texts[3])]


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("gathered", [50, 1 << 21])
def test_against_brute_force(spark, monkeypatch, gathered):
    monkeypatch.setattr(S, "GATHERED", gathered)
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in data], "doc_id long, text string, id int, class string").repartition(3)
    assert got(S.repeated_windows(df)) == brute(data)


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (4, "x " + text), (4, "x " + text), (7, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.repeated_windows(df).collect()) == [(1, 0), (1, 0), (4, 50), (4, 50), (7, 50)]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in S.repeated_windows(df).collect()}
    assert spans == {1: [], 4: [(1, 51)], 7: [(0, 50)]}
    assert S.repeated_windows(df.limit(0)).count() == 0


def test_the_largest_id_is_not_a_missing_one(spark):
    text = " ".join(map(str, range(30)))
    big = (1 << 63) - 1
    df = spark.createDataFrame([(big, text), (3, text), (None, "x " + text), (big, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.repeated_windows(df).collect()) == [(0, 31, 30), (3, 30, 0), (big, 1, 0), (big, 30, 30)]


def test_small_buckets_and_many_copies(spark, monkeypatch):
    """Buckets by the number of entries: thousands of them give what a few do."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 200)
    data = rows()[:60] + [(10**7 + i, rows()[2][1]) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert got(S.repeated_windows(df)) == brute(data)


def test_any_two_places_share_a_cover_place():
    for i in range(S.PERIOD):
        for j in range(S.PERIOD):
            assert any(S.COVERED[(i + d) % S.PERIOD] and S.COVERED[(j + d) % S.PERIOD] for d in range(S.PERIOD))


@pytest.mark.parametrize("n", [16, 64, 1024, 2048])
def test_structured_words_are_told_apart(spark, n):
    a, b = thue_morse(n)
    side = [f"l{i}" for i in range(15)], [f"r{i}" for i in range(15)]
    data = [(i, " ".join([*side[0], w, *side[1]])) for i, w in enumerate((a, b))] + [(5, " ".join([a] * 25)), (6, " ".join([b] * 25)), (7, " ".join([a, b] * 15)), (8, " ".join([b, a] * 15))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(S.repeated_windows(df)) == brute(data)


def test_missing_ids_come_after_the_largest_one(spark):
    text = " ".join(map(str, range(30)))
    big = (1 << 63) - 1
    for ids in ([big, None], [big, big - 1, big - 3, None]):
        data = [(i, text) for i in reversed(ids)]
        df = spark.createDataFrame(data, "doc_id long, text string")
        first = min(i for i in ids if i is not None)
        assert {r.doc_id: r.n_removed for r in S.repeated_windows(df).collect()} == {i: 0 if i == first else 30 for i in ids}
