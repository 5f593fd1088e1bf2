import random
import re
from collections import Counter
from itertools import permutations

import pytest

from corpuslens.llm import filter_audit as X


def failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        out.append((i, lang or "", f + "E" * (t in first and (i is None or first[t] < i))))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    told, out = failures(rows), {}
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == letter for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    rng = random.Random(9)
    texts = [None, "", " \t\n", "Short one", "word " * 300, "WORD " * 250, "a # b", "long " + " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)), " ".join(f"v{k}" for k in range(220)) + " 5%", "é" * 40 + " A", "x" * 100_000]
    rows = [(i, rng.choice(texts) if rng.random() < 0.7 else f"own {i} " * rng.randrange(1, 200), rng.choice(["en", "de", None, ""])) for i in range(400)]
    rows += [(5, "twice", "en"), (5, "twice", "en"), (5, "twice", "fr"), (6, "twice", "en"), (None, "twice", "en"), (None, "nameless", "fr"), (None, "nameless", "fr"), (2**63 - 1, "nameless", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 400, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_against_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, A int, digest string, `a.b` string").repartition(5)
    marks = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in X.filter_audit(docs, marks).collect()]
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {r[:3]: r[3:] for r in got} == want
    assert X.filter_audit(docs.limit(0), marks).count() == 0
    none = {r[:3]: r[3:] for r in map(tuple, X.filter_audit(docs, marks.limit(0)).collect())}
    assert none == brute(rows, [])


def test_transforms(spark):
    rng = random.Random(2)
    exact = [rng.randrange(50) for _ in range(X.SETS)]
    joint = [sum(exact[t] for t in range(X.SETS) if t & s == s) for s in range(X.SETS)]
    df = spark.createDataFrame([tuple(joint)], [f"j{s}" for s in range(X.SETS)])
    of = lambda s: df[f"j{s}"]
    got = df.select(*[X.survivors(of, s) for s in range(X.SETS)], *[X.only(of, i) for i in range(5)], *[X.shapley_over_orders(of, i) for i in range(5)]).first()
    assert list(got[: X.SETS]) == [sum(exact[t] for t in range(X.SETS) if not t & s) for s in range(X.SETS)]
    assert list(got[X.SETS : X.SETS + 5]) == [exact[1 << i] for i in range(5)]
    gone = lambda s: sum(exact[t] for t in range(X.SETS) if t & s)
    by_order = [sum(gone(sum(1 << k for k in o[: o.index(i) + 1])) - gone(sum(1 << k for k in o[: o.index(i)])) for o in permutations(range(5))) for i in range(5)]
    assert list(got[-5:]) == by_order


@pytest.mark.parametrize("rows", [[(1, "A" * 5, None)], [(None, None, None), (None, None, None)]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r[:3]: r[3:] for r in map(tuple, X.filter_audit(docs, marks).collect())} == brute(rows, [])
