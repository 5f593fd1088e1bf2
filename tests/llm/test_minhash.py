import random
import re
from itertools import combinations

from corpuslens.llm import minhash as M


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        out.append(text)
        for _ in range(12):  # chains of small and larger edits
            text = list(rng.choice(out[-3:]))
            for _ in range(rng.choice([0, 1, 1, 2, 4, len(text) // 30])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(text)
    texts = [" ".join(t) for t in out]
    texts += [None, "", " \n\t", "One two", "one\ttwo", "one two three four", "ONE two Three four", "ünï Ünï", "a " * 30000]
    return list(enumerate(texts))


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, keys string, n_shingles int").repartition(3)
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, width).collect()}
        assert got == brute(data, width)


def test_no_rows_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert M.near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(tuple, M.near_duplicates(df).collect())) == [(1, 2, 1, True), (2, 0, 2, True)]


def test_shared_and_missing_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (None, a), (5, a)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in M.near_duplicates(df).collect())
    assert got == [(-1, None, None), (1, 1, True), (5, 1, False), (5, 1, False), (5, 1, False), (7, 1, False)]


def test_pairs_within_the_distance_share_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, (1 << M.BITS) - 1, (500, M.SYMBOLS))
    b = a.copy()
    for row in b:
        row[rng.choice(M.SYMBOLS, M.GUARANTEED, replace=False)] += 1
    assert all(set(x) & set(y) for x, y in zip(M.lookup_keys(a).tolist(), M.lookup_keys(b).tolist(), strict=True))


def test_differing_symbols_are_counted(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a = rng.integers(0, (1 << M.BITS) - 1, (200, M.SYMBOLS))
    b = a.copy()
    for i, row in enumerate(b):
        row[rng.choice(M.SYMBOLS, i % 32, replace=False)] += 1
    df = spark.createDataFrame(list(zip(range(200), M.packed(a).tolist(), M.packed(b).tolist(), strict=True)), "i int, x array<long>, y array<long>")
    assert {(r.i, r.d) for r in df.select("i", M._differing("x", "y").alias("d")).collect()} == {(i, i % 32) for i in range(200)}


def test_the_filter_drops_no_more_than_the_index():
    from math import comb

    tail = lambda p, k: sum(comb(M.SYMBOLS, i) * p**i * (1 - p) ** (M.SYMBOLS - i) for i in range(k + 1, M.SYMBOLS + 1))
    lost = (1 - 0.8**M.CHUNK - M.CHUNK * 0.2 * 0.8 ** (M.CHUNK - 1)) ** (M.SYMBOLS // M.CHUNK)
    assert M.GUARANTEED == 2 * M.SYMBOLS // M.CHUNK - 1 < M.DISTANCE
    assert tail(0.2, M.DISTANCE) < lost < 2e-12


def test_measured_loss_of_pairs_at_the_limit():
    """Of 20,000 pairs of sets at a similarity of just 0.8, all share a key and lie within the distance."""
    import numpy as np

    rng = np.random.default_rng(4)
    n, common, own = 20_000, 80, 10
    both = rng.integers(0, 1 << 63, (n, common + 2 * own), np.uint64) * np.uint64(2)
    signs = []
    for columns in (slice(0, common + own), [*range(common), *range(common + own, common + 2 * own)]):
        x = both[:, columns]
        signs.append(M.signatures(np.ascontiguousarray(x).ravel(), np.arange(n + 1) * (common + own)))
    differ = signs[0] != signs[1]
    assert 0.19 < differ.mean() < 0.21
    assert (differ.reshape(n, -1, M.CHUNK).sum(2).min(1) <= 1).all()
    assert differ.sum(1).max() <= M.DISTANCE


def test_keys_are_shared_where_a_chunk_differs_once(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, (1 << M.BITS) - 1, (300, M.SYMBOLS))
    b = a.copy()
    for row in b:
        row[rng.choice(M.SYMBOLS, rng.integers(20, 60), replace=False)] += 1
    want = {i: bool(set(x) & set(y)) for i, (x, y) in enumerate(zip(M.lookup_keys(a).tolist(), M.lookup_keys(b).tolist(), strict=True))}
    df = spark.createDataFrame(list(zip(range(300), M.packed(a).tolist(), M.packed(b).tolist(), strict=True)), "i int, x array<long>, y array<long>")
    assert {r.i: r.m for r in df.select("i", M._meets("x", "y").alias("m")).collect()} == want and len(set(want.values())) == 2


def thue_morse(n):
    """Two words of n letters that collide under polynomials of any odd base modulo 2**64, if n is 1,024 or more."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_structured_words_are_told_apart(spark):
    import numpy as np

    from corpuslens.llm import shared

    data = []
    for k, n in enumerate((8, 16, 17, 32, 64, 1024, 2048, 4096)):
        for j, w in enumerate(thue_morse(n)):
            data += [(10 * k + j, f"x {w} y"), (100 + 10 * k + j, f"{w}"), (200 + 10 * k + j, f"one two {w} three four five six seven {w.upper()}")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, 4).collect()}
    assert got == brute(data, 4) and sum(k for *_, k in got.values()) == len(data)
    words = [w.encode() for n in range(1, 200) for w in thue_morse(n)] + [bytes([c]) * n for c in (0, 1, 97, 255) for n in range(1, 40)]
    flat = np.frombuffer(b" ".join(words), np.uint8)
    first, end, _ = shared.word_places(flat, np.array([0, len(flat)]))
    assert len(first) == len(words) and len(set(shared.word_hashes(flat, first, end).tolist())) == len(set(words))
