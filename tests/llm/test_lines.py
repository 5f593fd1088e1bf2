import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd

from corpuslens.llm import lines as L


def brute(rows):
    """rows: (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        own = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in own]
        chunks, now = [], []
        for k, line in enumerate(own):
            now.append(line)
            if (h[k] + L.STEP * (h[k - 1] if k else 0)) % L.CHUNK_LINES == 0:
                chunks.append(now)
                now = []
        chunks += [now] if now else []
        kept, gone = [], 0
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
            if len(c) > 1:
                seen.add(tuple(c))
        out[i] = (None if text is None else "\n".join(kept), len(own), gone)
    return out


def rows():
    rng = random.Random(4)
    fresh = lambda n: [f"line {rng.randrange(10**6)} é" for _ in range(n)]
    shared = [fresh(rng.randrange(2, 25)) for _ in range(6)]
    out = []
    for _ in range(120):
        own = fresh(rng.randrange(0, 6))
        for _ in range(rng.randrange(3)):
            own += rng.choice(shared) + fresh(rng.randrange(0, 4))
        out.append("\n".join(own))
    out += [None, "", "\n", "\n" * 50, "same\n" * 40, "same\n" * 40, "one line", "one line", out[5], out[5], "x\r\ny", "long " * 20000 + "\n" + out[7]]
    return list(zip(rng.sample(range(10**6), len(out)), out, strict=True)) + [(None, out[3])]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "k", 1, "own") for i, t in data], "doc_id long, text string, tag string, lines_removed int, lines string").repartition(3)
    got = L.line_dedup(df)
    assert got.columns == ["doc_id", "text", "tag", "lines", "lines_before", "lines_removed"]
    assert {r.doc_id: (r.text, r.lines_before, r.lines_removed) for r in got.collect()} == brute(data)


def test_the_sql_gives_the_same(spark, tmp_path):
    data = [(i, t) for i, t in rows() if i is not None and t is not None]
    pd.DataFrame(data, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    got = Counter(tuple(r) for r in L.op10_line_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert got == Counter(con.execute(L.SQL).fetchall())


def test_repeated_rows_and_no_rows(spark):
    text = "\n".join(f"l{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lines_removed) for r in L.line_dedup(df).collect())
    assert got[0] == got[1] == (1, 0) and got[2] == got[3] and got[2][1] > 20
    assert L.line_dedup(df.limit(0)).count() == 0


def test_clashing_columns_and_missing_ids(spark):
    text = "\n".join(f"l{i}" for i in range(30))
    names = ("__lines", "__spans", "__id", "__tag", "id", "tag", "row", "spans", "lines", "a.b", "lines_before")
    kinds = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names)
    big = (1 << 63) - 1
    df = spark.createDataFrame([(i, t, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate([(1, text), (None, "x\n" + text), (None, "y\n" + text), (big, "z\n" + text)])], kinds)
    out = L.line_dedup(df)
    assert out.columns == ["doc_id", "text", *names[:-1], "lines_before", "lines_removed"]
    got = sorted(out.collect(), key=lambda r: r.row)
    assert [r.doc_id for r in got] == [1, None, None, big]
    assert [tuple(r[c] for c in names[:-1]) for r in got] == [tuple(f"{c}{k}" for c in names[:-1]) for k in range(4)]
    assert got[0].lines_removed == 0 and all(r.lines_removed > 20 for r in got[1:])


def test_bytes_are_compared_where_digests_are_equal(spark, monkeypatch):
    """With digests of a few bits, chunks of other bytes share most of them; results are the same."""
    monkeypatch.setattr(L, "_digest", lambda chunk: L.F.unhex(L.F.substring(L.F.sha2(chunk, 256), 1, 2)))
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.text, r.lines_before, r.lines_removed) for r in L.line_dedup(df).collect()} == brute(data)


def test_a_chunk_of_many_documents(spark):
    """More rows than a group may have in the shuffle: it is broadcast to its uses."""
    text = "\n".join(f"l{i}" for i in range(30))
    df = spark.createDataFrame([(i, f"own {i}\n{text}") for i in range(200)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.lines_before, r.lines_removed) for r in L.line_dedup(df).collect()}
    assert got == brute([(i, f"own {i}\n{text}") for i in range(200)])


def test_missing_ids_come_after_the_largest_one(spark):
    text = "\n".join(f"l{i}" for i in range(30))
    big = (1 << 63) - 1
    for ids in ([None, big], [None, big - 2, big, big - 1]):
        data = [(i, f"{text}\nown {i}") for i in ids]
        df = spark.createDataFrame(data, "doc_id long, text string")
        assert {r.doc_id: (r.text, r.lines_before, r.lines_removed) for r in L.line_dedup(df).collect()} == brute(data)


def test_places_of_ids(spark):
    from corpuslens.llm import shared

    top = (1 << 63) - 1
    for ids in ([1, None, 5], [None, top, -top - 1, 0], [*range(top - 1500, top + 1), None, 7]):
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        got = {r.doc_id: r.p for r in df.select("doc_id", shared.id_places(df).alias("p")).collect()}
        order = sorted(got, key=lambda i: (i is None, i or 0))
        assert [got[i] for i in order] == sorted(set(got.values())) and len(set(got.values())) == len(ids)
