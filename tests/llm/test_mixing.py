import math
import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from corpuslens.llm import mixing as M


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(900):
        s = rng.choice(["big"] * 12 + ["mid"] * 4 + ["small", None, "none"])
        n = 0 if s == "none" else rng.choice([0, 3, 10, 50])
        out.append((i, " ".join(["w"] * n) if n or rng.random() < 0.5 else None, s))
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, s, "e", 0.5) for i, t, s in data], "doc_id long, text string, source string, mix_block string, tokens double").repartition(3)


@pytest.mark.parametrize("options", [{}, {"entropy": 0.9, "repetition": 3.0}, {"entropy": 0.95, "repetition": 100.0, "budget": 5000.0}, {"entropy": 0.0}])
def test_weights_and_budgets(spark, options):
    data = rows()
    got = M.mixture(frame(spark, data), **options).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(data)
    tokens, weight, passed, longest = Counter(), {}, Counter(), Counter()
    for r in got:
        s = r.source or ""
        assert r.mix_tokens == len((r.text or "").split())
        tokens[s] += r.mix_tokens
        weight[s] = r.mix_weight
        passed[s] += r.mix_tokens * r.mix_copies
        longest[s] = max(longest[s], r.mix_tokens)
        if s == "none":
            assert (r.mix_weight, r.mix_copies) == (0, 1)
    full = [s for s in tokens if tokens[s]]
    total = sum(tokens.values())
    assert sum(weight.values()) == pytest.approx(1)
    budget = options.get("budget") or max(tokens[s] / weight[s] for s in full)
    for s in full:
        assert weight[s] * budget - 1 <= passed[s] <= weight[s] * budget + longest[s]
    if not options.get("budget"):
        assert all(r.mix_copies >= 1 for r in got)
    exponents = {s: (math.log(weight[s]) - math.log(weight["big"])) / (math.log(tokens[s] / tokens["big"]) or 1) for s in full if s != "big"}
    e = next(iter(exponents.values()))
    assert all(x == pytest.approx(e) for x in exponents.values()) and -1e-9 <= e <= 1 + 1e-9
    entropy = -sum(weight[s] * math.log(weight[s]) for s in full)
    most = max(budget * weight[s] / tokens[s] for s in full)
    natural = -sum(tokens[s] / total * math.log(tokens[s] / total) for s in full)
    target, limit = options.get("entropy", 0.998) * math.log(len(full)), options.get("repetition", 1.5)
    if natural >= target:
        assert e == pytest.approx(1)
    else:
        assert entropy == pytest.approx(target) or most == pytest.approx(limit)
        assert most <= limit * (1 + 1e-6) or budget > limit * total


def test_realised_rows_keep_columns(spark):
    data = rows()
    df = frame(spark, data).drop("mix_block")
    want = {r.doc_id: r.mix_copies for r in M.mixture(df).collect()}
    out = M.realised(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in want.items() if n})


def test_the_sql_gives_the_same(spark, tmp_path):
    data = rows(5)
    pd.DataFrame(data, columns=["doc_id", "text", "source"]).to_parquet(tmp_path / "documents.parquet")
    got = Counter(tuple(r) for r in M.op9_source_mixing(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert got == Counter(con.execute(M.SQL).fetchall())


def test_repeated_rows_one_source_and_no_rows(spark):
    df = frame(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, None, None), (None, "x", "s")])
    by = defaultdict(list)
    for r in M.mixture(df).collect():
        by[r.doc_id, r.source].append(r.mix_copies)
    assert by == {(1, "s"): [1, 1], (None, None): [1], (None, "s"): [1]}
    assert M.mixture(df.limit(0)).count() == 0
    assert M.realised(df.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ("__source", "__hash", "__turn", "mix_note", "hash", "tag", "tokens", "row", "state", "a.b", "mix_block")
    df = spark.createDataFrame([(i, "a b c", "s", *[f"{c}{i}" for c in names]) for i in range(5)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = M.mixture(df)
    assert out.columns == ["doc_id", "text", "source", *names[:-1], "mix_tokens", "mix_weight", "mix_block", "mix_copies"]
    assert {r.doc_id: tuple(r[c] for c in names[:-1]) for r in out.collect()} == {i: tuple(f"{c}{i}" for c in names[:-1]) for i in range(5)}
    back = M.realised(df)
    assert back.columns == df.columns and {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("ids", [(7, 7), (None, None), (7, None)])
def test_rows_of_one_id_are_decided_one_by_one(spark, ids):
    """A budget of 100 tokens ends among 50 equal rows of 11 tokens, or among different texts of one id."""
    equal = [(ids[0], "w " * 11, "s")] * 50
    for data in (equal + [(i, "w " * 11, "s") for i in range(100, 150)], [(ids[1], f"{k} " * 11, "s") for k in range(50)] + equal):
        df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
        got = M.mixture(df, budget=100.0).collect()
        assert len(got) == 100 and sum(r.mix_copies for r in got) == 10  # ten of eleven tokens begin before 100


def test_equal_rows_of_several_sources(spark):
    data = [(1, "w " * 5, s) for s in "abc" for _ in range(40)] + [(2, "w " * 3, "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = M.mixture(df, budget=150.0)
    used = {r.source: r.n for r in got.groupBy("source").agg({"mix_copies": "sum"}).toDF("source", "n").collect()}
    assert got.count() == 121 and used["b"] == used["c"] == 10


def test_rows_without_ids_are_spread(spark):
    data = [(None, f"{k} " * 3, "ab"[k % 2]) for k in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = M.mixture(df, budget=3001.0, entropy=0.0)
    blocks = Counter(r.mix_block for r in got.collect())
    assert len(blocks) > 1000 and max(blocks.values()) < 20
    used = {r.source: r.n for r in got.groupBy("source").agg({"mix_copies": "sum"}).toDF("source", "n").collect()}
    assert all(500 <= n <= 501 for n in used.values())


def test_many_texts_of_one_id_go_by_parts(spark):
    """The order by parts of a hash is the order by the whole hash: as many rows pass as begin before the budget's end."""
    rng = random.Random(3)
    data = [(7, " ".join([str(k)] * rng.randrange(0, 9)), "s") for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    rows = df.selectExpr("xxhash64(text) as tag", "size(filter(split(text, ' '), x -> x != '')) as n").orderBy("tag", "n").collect()
    for budget in (0.0, 1.0, 777.0, 5000.0, float(sum(r.n for r in rows) - 1)):
        start, want = 0, 0
        for r in rows:
            want += start < budget
            start += r.n
        got = M.mixture(df, budget=budget).agg({"mix_copies": "sum"}).first()[0]
        assert got == want
