import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import test_lines
import test_minhash
import test_toxicity
import tiktoken

import corpus_pipeline
from corpuslens.llm import minhash, mixing, toxicity


def made():
    rng = random.Random(12)
    rows = []
    base = test_toxicity.made(300, 3)
    shared = "\n".join(f"shared line number {i}" for i in range(12))
    for i, text, _ in base:
        if i % 7 == 0:
            text = f"{text}\n{shared}\nend {i}"
        if i % 11 == 0 and i:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text)))
    rows += [(1000, None, None, "a", None), (1001, "", "en", "c", 0)]
    return rows, [(i, y, 1) for i, _, y in base]


def brute(spark, rows, labels):
    """The first three stages by plain counts, loops and sets."""
    of = {r[0]: r[1] or "" for r in rows}
    told = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5]
    apart = {r.id: r.a for r in spark.createDataFrame([(i,) for i, _ in told], "id long").selectExpr("id", f"pmod(xxhash64('apart', id), {toxicity.CALIBRATION}) = 0 as a").collect()}
    score = test_toxicity.plain_fit([(of[i], y, apart[i]) for i, y in told])
    scores = [score(r[1] or "") for r in rows]
    assert min(abs(s - 0.5) for s in scores) > 0.001  # beyond what the two fits differ by
    kept = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    assert 0 < len(kept) < len(rows)
    lines = test_lines.brute([(r[0], r[1]) for r in kept])
    kept = [(r[0], lines[r[0]][0], *r[2:]) for r in kept]
    same = test_minhash.brute([(r[0], r[1]) for r in kept], 5)
    return [r for r in kept if same[r[0]][2]]


def test_against_brute_force(spark, tmp_path):
    """The mixture by its SQL and the ids by the library: nothing here is what the pipeline calls."""
    rows, labels = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute(spark, rows, labels)
    documents = pd.DataFrame([(r[0], r[1], r[3]) for r in want], columns=["doc_id", "text", "source"])  # noqa: F841  the SQL reads it
    copies = {i: n for i, n in duckdb.sql(f"SELECT doc_id, mix_copies FROM ({mixing.SQL})").fetchall()}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for r in want:
        ids = np.array(peer.encode_ordinary(r[1] or ""), "<u4")
        out[r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += copies[r[0]]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == out


def test_stages_keep_columns_and_take_no_rows(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(*r, "t", 1.5, "x", "y", 2) for r in rows[:40]], "doc_id long, text string, lang string, source string, n_chars long, tag string, score double, key string, `x.y` string, `a b` int")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert name == "byte_bpe" or out.columns == df.columns
            n = out.count()
            assert n == 0 if docs is not df else n > 0


def test_near_duplicates_are_one_by_one(spark):
    assert minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g")], "doc_id long, text string")).where("kept").count() == 1
