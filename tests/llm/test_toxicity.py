import math
import random
import zlib

import numpy as np
import pytest

from corpuslens.llm import toxicity as X

CLEAN, RUDE = [f"word{i}" for i in range(60)], ["blockhead", "numbskull", "dimwit"]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.choice([10, 40, 150]))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * max(1, len(words) // 10)):
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = made(900, 1)
    docs = spark.createDataFrame([(i, t, 0.5, "en") for i, t, _ in rows] + [(900, None, 0.1, "en"), (901, "", 0.1, "en"), (None, "blockhead", 0.2, None), (3, rows[3][1], 0.3, "x")], "doc_id long, text string, score double, lang string").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5000, 1, 0), (8, None, 0)], "doc_id long, toxic int, quality int")
    return rows, X.score(docs, X.train(docs, labels)).collect()


def test_held_out_accuracy(scored):
    rows, got = scored
    truth = {i: y for i, _, y in rows}
    apart = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(apart) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in apart]) > 0.97


def test_rows_and_columns(scored):
    rows, got = scored
    assert len(got) == len(rows) + 4
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert by[900][0].score == by[901][0].score
    assert by[None][0].held_out is None
    assert len(by[3]) == 2 and by[3][0].score == by[3][1].score


def test_few_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, labels)
    assert [r.score for r in X.score(docs, model).collect()] == [0.5, 0.5]
    assert X.score(docs.limit(0), model).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["abcdefgh ijkl", "x", "", "é東🙂 q" * 50]
    for t, own in zip(texts, X.features(texts), strict=True):
        assert own.tolist() == X.features([t])[0].tolist()


def number(gram):
    """A feature's number, by whole numbers without wrapping arrays."""
    whole = 1 << 64

    def mix(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % whole
        return h ^ h >> 32

    h = sum(mix(ord(c) + 1) * pow(X.ROLL.base, i, whole) for i, c in enumerate(gram)) % whole
    return mix((h + len(gram)) % whole) >> 64 - X.BITS


def grams(text):
    whole = f" {(text or '').lower()} "
    return {number(whole[i : i + n]) for n in X.LENGTHS for i in range(len(whole) - n + 1)}


def plain_fit(rows, counts=None):
    """rows: (text, toxic, apart), all that is told. -> the score of a text, by counts, log-count ratios and a plain descent. counts: clean and toxic
    documents there are, if rows are only some of them."""
    own = [(grams(t), float(y), a) for t, y, a in rows]
    part = [(g, y) for g, y, a in own if not a]
    seen = {f for g, _ in part for f in g}
    ones = {f: sum(f in g for g, y in part if y) for f in seen}
    rest = {f: sum(f in g for g, y in part if not y) for f in seen}
    p, q = (sum(n.values()) + X.SMOOTH * 2**X.BITS for n in (ones, rest))
    ratio = {f: math.log((ones[f] + X.SMOOTH) / p) - math.log((rest[f] + X.SMOOTH) / q) for f in seen if ones[f] + rest[f] >= X.LEAST_ROWS}
    chosen = sorted(ratio, key=lambda f: (-abs(ratio[f]) * math.sqrt(ones[f] + rest[f]), f))[: X.KEPT]
    r = np.array([ratio[f] for f in chosen])

    def matrix(sets):
        return np.array([[(f in g) / math.sqrt(max(1, len(g))) for f in chosen] for g in sets])

    def descend(gradient, x, steps, rate):
        m, v = np.zeros(len(x)), np.zeros(len(x))
        for t in range(1, steps + 1):
            g = gradient(x)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x - rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return x

    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    a, y = matrix([g for g, _ in part]) * r, np.array([y for _, y in part])
    step = lambda w: np.append(a.T @ (sigmoid(a @ w[:-1] + w[-1]) - y) / len(y) + X.PENALTY * w[:-1], (sigmoid(a @ w[:-1] + w[-1]) - y).mean())
    w = descend(step, np.zeros(len(r) + 1), X.STEPS, X.RATE)[:-1] * r
    z, t = matrix([g for g, _, b in own if b]) @ w, np.array([y for _, y, b in own if b])
    centre, unit = z.mean(), z.std()
    z = (z - centre) / unit
    taken = len(own) - sum(y for _, y, _ in own), sum(y for _, y, _ in own)
    counts = counts or taken
    share = (counts[1] + 0.5) / (sum(counts) + 1)
    weight = np.array([counts[int(y)] / taken[int(y)] for y in t])  # a row stands for so many of its label
    weight /= weight.mean()
    error = lambda x: (sigmoid(x[0] * z + x[1]) - t) * weight
    slope, bias = descend(lambda x: np.array([(error(x) * z).mean() + 1e-3 * x[0], error(x).mean()]), np.array([1.0, math.log(share / (1 - share))]), 600, 0.1)
    return lambda text: float(sigmoid(slope * ((matrix([grams(text)])[0] @ w - centre) / unit) + bias))


def test_against_plain_counts_ratios_and_descent(spark):
    rows = made(220, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, "blockhead word1"), (501, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in X.score(docs, X.train(docs, labels)).collect()}
    told = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    apart = {r.id: r.a for r in spark.createDataFrame([(i,) for i, _, _ in told], "id long").selectExpr("id", f"pmod(xxhash64('apart', id), {X.CALIBRATION}) = 0 as a").collect()}
    score = plain_fit([(t, y, apart[i]) for i, t, y in told])
    for i, t in [*[(i, t) for i, t, _ in rows[:60]], (500, "blockhead word1"), (501, None)]:
        assert got[i] == pytest.approx(score(t), abs=2e-4)


def test_foreign_labels_take_no_places(spark):
    """Labels of documents that aren't there change no score, however many there are."""
    rows = made(300, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    own = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    foreign = spark.range(1000, 50_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    want = {r.doc_id: r.score for r in X.score(docs, X.train(docs, own)).collect()}
    got = {r.doc_id: r.score for r in X.score(docs, X.train(docs, own.unionByName(foreign))).collect()}
    assert got == want and len(set(got.values())) > 1


def test_the_bound_holds_for_documents_and_either_label(spark):
    assert X.bounded((10, 5), 100) == (10, 5)
    assert X.bounded((1000, 5), 100) == (95, 5)
    assert X.bounded((5, 1000), 100) == (5, 95)
    assert X.bounded((1000, 1000), 100) == (50, 50)
    rows = made(400, 8)
    # Each text is there four times, and some ids with other texts too: still one row for each document.
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 4 + [(i, "other " + t) for i, t, _ in rows[:50]], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    held = []
    fit = X.fit
    try:
        X.fit = lambda *a: held.append(a) or fit(*a)
        X.train(docs, labels, 100)
    finally:
        X.fit = fit
    told = [y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(held[0][0]) == 100 and held[0][2].sum() == 50 and held[0][6] == (len(told) - sum(told), sum(told))


def test_a_bound_that_bites_against_plain_counts(spark):
    """Of 400 documents 120 are taken, half of either label; a clean one stands for more than a toxic one."""
    rows = made(400, 9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in X.score(docs, X.train(docs, labels, 120)).collect()}
    told = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    facts = {r.id: r for r in spark.createDataFrame([(i,) for i, _, _ in told], "id long").selectExpr("id", "xxhash64(id) as h", f"pmod(xxhash64('apart', id), {X.CALIBRATION}) = 0 as a").collect()}
    counts = sum(1 - y for *_, y in told), sum(y for *_, y in told)
    assert counts[0] > 60 < counts[1] and counts[0] != counts[1]
    taken = [x for side in (0, 1) for x in sorted((r for r in told if r[2] == side), key=lambda r: (facts[r[0]].h, r[0]))[:60]]
    score = plain_fit([(t, y, facts[i].a) for i, t, y in taken], counts)
    assert all(got[i] == pytest.approx(score(t), abs=5e-4) for i, t, _ in rows[:60])
