from collections import Counter

import numpy as np

from corpuslens.llm import vectors as V


def brute(rows, cosine=0.98):
    def sound(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if sound(a) and sound(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    p, q = sorted((top(a[0]), top(b[0])))
                    up[q] = p
    return Counter((r[0], k, None if r[0] is None else top(r[0]), None if r[0] is None else top(r[0]) == r[0]) for r, k in zip(rows, n, strict=True))


def rows():
    rng = np.random.default_rng(3)
    out = []
    for g in range(40):
        base = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 12))):
            base = base + rng.standard_normal(32) * rng.choice([0, 0.05, 0.1, 0.2])
            out.append((base * rng.choice([1, 3])).tolist())
    data = [(i, v, int(i % 2)) for i, v in enumerate(out)]
    data += [(1000, [0.0] * 32, 1), (1001, None, 1), (1002, [], 1), (1003, [None] + [1.0] * 31, 0), (1004, [float("nan")] + [1.0] * 31, 0), (1005, [float("inf")] + [1.0] * 31, 0)]
    data += [(1006, out[0], None), (1007, out[0][:8], 0), (1008, out[0][:8], 0), (1009, [-0.0, 1.0], 0), (1010, [0.0, 1.0], 0), (1011, [2.0], 0), (1012, [5.0], 0), (1013, [-5.0], 0)]
    return data


def run(spark, data):
    df = spark.createDataFrame([(*r, "f", 1) for r in data], "vec_id long, embedding array<float>, label int, filter string, class int").repartition(3)
    return Counter(tuple(r) for r in V.near_duplicates(df).collect())


def test_against_brute_force(spark):
    assert run(spark, rows()) == brute(rows())
    fixed = [r for r in rows() if r[1] and len(r[1]) == 32]
    assert run(spark, fixed) == brute(fixed)


def test_null_and_shared_ids_and_no_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    data = [(None, v, 1), (4, v, 1), (4, w, 1), (9, w, 1), (9, None, 1), (7, v, 2)]
    assert run(spark, data) == Counter({(None, 0, None, None): 1, (4, 0, 4, True): 1, (4, 1, 4, True): 1, (9, 1, 4, False): 1, (9, 0, 4, False): 1, (7, 0, 7, True): 1})
    assert not run(spark, [])


def test_tiny_and_huge_components(spark):
    """Components whose squares vanish or overflow, of doubles: linked by their direction like any others."""
    rng = np.random.default_rng(6)
    data, want = [], {}
    for k, size in enumerate((5e-324, 1e-300, 1e-170, 1e-90, 1.0, 1e90, 1e200, 1e308)):
        v = rng.uniform(0.2, 1, 5) if size > 5e-324 else np.array([1.0, 1, 1, 0, 1])
        far = np.array([-1.0, 1, -1, 0, 1])
        data += [(10 * k, (v * size).tolist(), k), (10 * k + 1, (v * size * 0.5 if size > 5e-324 else v * 1e-322).tolist(), k), (10 * k + 2, (far * size).tolist(), k)]
        want |= {10 * k: (1, 10 * k), 10 * k + 1: (1, 10 * k), 10 * k + 2: (0, 10 * k + 2)}
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(df).collect()} == want


def test_many_copies_of_a_vector(spark):
    v, w = [0.6, 0.8, 0.0], [0.0, 0.6, 0.8]
    data = [(i, v, 1) for i in range(300)] + [(i, w, 1) for i in range(300, 303)] + [(400, v, 2)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)).collect()}
    assert got == {i: (299, 0) for i in range(300)} | {i: (2, 300) for i in range(300, 303)} | {400: (0, 400)}


def test_recall_of_pairs_at_the_limit():
    """By dimension and number of rows, for which the codes are made."""
    rng = np.random.default_rng(1)
    for dim, sizes in {2: (500, 5_000_000), 4: (500, 5_000_000), 7: (500, 5_000_000), 8: (500, 500_000_000), 12: (50_000, 500_000_000), 16: (500, 500_000_000), 64: (500, 5_000_000, 500_000_000), 768: (5_000_000,)}.items():
        a = rng.standard_normal((100, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((100, dim))
        b -= (b * a).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
        for rows in sizes:
            hit = np.zeros(len(a), bool)
            for k in range(V.SETS):
                c = V.codes(rows, dim, k)
                hit |= [len(np.intersect1d(x, y)) > 0 for x, y in zip(V.decode(a, *c), V.decode(b, *c), strict=True)]
            print(dim, rows, len(c[1]), len(c[2]), round(c[3], 3), hit.mean())
            assert hit.mean() > 0.98
