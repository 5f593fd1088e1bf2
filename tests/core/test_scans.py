"""Running values and quantiles of long keys, cut into pieces, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import quantiles as Q
from corpuslens.functions import scans as S
from corpuslens.operators import fidelity, structure


def rows(seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for key, n in (("long", 3000), ("short", 7), (None, 900), ("one", 1), ("nulls", 40)):
        steps = np.sort(rng.choice(10**9, n, replace=False)) - 5 * 10**8
        for s in steps:
            out.append((key, int(s), None if key == "nulls" or rng.random() < 0.1 else float(rng.normal())))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "key string, step long, x double").repartition(6)


@pytest.mark.parametrize("size", [10, 100, 5000])
def test_running_sums_and_minima(spark, size):
    data = rows()
    values = {"n": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col("x")), "least": ("min", F.col("x"))}
    for past in (False, True):
        got = {(r.key, r.step): r for r in S.running(frame(spark, data), ["key"], "step", values, past, size).collect()}
        assert len(got) == len(data)
        for key in {k for k, *_ in data}:
            own = sorted((s, x) for k, s, x in data if k == key)
            for i, (s, _) in enumerate(own):
                seen = [x for _, x in own[: i + (not past)]]
                some = [x for x in seen if x is not None]
                r = got[key, s]
                assert r.n == (len(seen) or None) and r.least == min(some, default=None)
                assert r.total == (pytest.approx(sum(some), abs=1e-9) if some else None)


@pytest.mark.parametrize("size", [10, 5000])
def test_averages_by_pieces_and_running_best(spark, size):
    data = rows(6)
    got = {(r.key, r.step): r.ema for r in fidelity.ema(frame(spark, data), 0.9, size).collect()}
    best = {(r.run, r.step): r.best for r in structure.best_so_far(frame(spark, data).select(F.col("key").alias("run"), "step", F.col("x").alias("value")), size).collect()}
    assert len(got) == len(best) == len(data)
    for key in {k for k, *_ in data}:
        now, least = None, None
        for s, x in sorted((s, x) for k, s, x in data if k == key):
            assert best[key, s] == (True if least is None or x is None and least is None else None if x is None else x < least) or (x is None and best[key, s] is True)
            if x is not None:
                now = x if now is None else now * 0.9 + x * 0.1
                least = x if least is None else min(least, x)
            assert got[key, s] == (None if now is None else pytest.approx(now, abs=1e-12))


def test_a_long_key_is_several_tasks(spark):
    cut = S.pieces(spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("step")), ["key"], "step", 1000)
    sizes = [r["count"] for r in cut.groupBy("piece").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500
    ends = cut.groupBy("piece").agg(F.min("step").alias("a"), F.max("step").alias("b")).orderBy("piece").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


def test_many_cuts_are_found_in_runs(spark):
    cut = S.pieces(spark.range(30_000).select(F.lit(1).alias("key"), (F.col("id") * 7 % 30_000).alias("step")), ["key"], "step", 100)
    sizes = [r["count"] for r in cut.groupBy("piece").count().collect()]
    assert len(sizes) == 300 and max(sizes) <= 200


def test_empty_tables(spark):
    none = frame(spark, rows()).limit(0)
    assert S.running(none, ["key"], "step", {"n": ("sum", F.lit(1))}).count() == 0
    assert fidelity.ema(none).count() == 0


@pytest.mark.parametrize("held", [50, 1 << 16])
def test_quantiles_of_long_and_short_keys_agree(spark, monkeypatch, held):
    monkeypatch.setattr(Q, "HELD", held)
    rng = np.random.default_rng(8)
    own = {"normal": rng.normal(size=2000), "ties": rng.integers(0, 4, 1500).astype(float), "wide": rng.normal(size=400) * 10.0 ** rng.integers(-200, 200, 400), "few": rng.normal(size=9), None: rng.exponential(size=300)}
    df = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v], "k string, x double").repartition(5)
    for first, step, count in ((0.0, 1 / 511, 512), (0.5, 1.0, 1), (0.01, 0.49, 3)):
        got = {(r.k, r.i): r.q for r in Q.quantiles(df, first, step, count, "k").collect()}
        assert len(got) == len(own) * count
        for k, v in own.items():
            np.testing.assert_allclose([got[k, i] for i in range(count)], np.quantile(v, [min(1.0, first + i * step) for i in range(count)]), rtol=1e-9, atol=1e-12)


def test_logistic_regression_against_numpy_and_ranks_with_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.3] + 0.5)))).astype(float)
    df = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(y, x, strict=True)], "y double, x array<double>").repartition(4)
    w = structure.logistic(df)
    z = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (p - y) + w * [1, 1, 1, 0]).max() < 1e-7  # the slope of the penalised loss
    apart = spark.createDataFrame([(float(v > 0), [float(v)]) for v in x[:, 0]], "y double, x array<double>")
    w = structure.logistic(apart)
    z = np.column_stack([x[:, 0], np.ones(len(x))])
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - (x[:, 0] > 0)) + w * [1, 0]).max() < 1e-6
    score = np.round(x[:, 0], 1)
    got = structure.auc(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, score, strict=True)], "y double, score double"))
    ones, zeros = score[y == 1], score[y == 0]
    assert got == pytest.approx(np.mean((ones[:, None] > zeros) + (ones[:, None] == zeros) / 2), abs=1e-12)
    assert structure.auc(spark.createDataFrame([(1.0, 2.0)], "y double, score double")) is None


def test_neighbours_in_a_grid_of_blocks(spark, monkeypatch):
    """As broadcast targets give them, with ties, copies and a few rows a block."""
    from corpuslens.operators import difficulty
    from corpuslens.operators import knn as K

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((60, 4)), np.eye(4), np.eye(4), np.zeros((12, 4)), rng.integers(0, 2, (60, 4))])
    df = spark.createDataFrame([(i * 7, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    other = df.where("vec_id % 2 = 0")
    for size in (1 << 10, 1 << 20):
        monkeypatch.setattr(K, "BLOCK_BYTES", size)
        for k, metric, targets in ((1, "l2", None), (5, "l2", None), (200, "l2", None), (4, "cosine", other), (9, "l2", other)):
            want = {(r.q, r.rk): (r.t, r.d) for r in K.knn(df, k, metric, targets).collect()}
            got = {(r.q, r.rk): (r.t, r.d) for r in K.knn(df, k, metric, targets, most=0).collect()}
            assert got == want
        assert {r.q: round(r["mean"], 12) for r in difficulty.mean_distances(df, other, 0).collect()} == {r.q: round(r["mean"], 12) for r in difficulty.mean_distances(df, other).collect()}
        assert fidelity.mmd_rbf(df, other, most=0) == pytest.approx(fidelity.mmd_rbf(df, other), abs=1e-12)
        assert {r.bin: (round(r.real, 9), round(r.synth, 9)) for r in fidelity.pairwise_hist_l1(df, other, 20, 0).collect()} == {r.bin: (round(r.real, 9), round(r.synth, 9)) for r in fidelity.pairwise_hist_l1(df, other, 20).collect()}
        a, b = (fidelity.pdist(df, m).first() for m in (0, None))
        assert a.pdist_mean == pytest.approx(b.pdist_mean) and a.pdist_min == b.pdist_min
    with pytest.raises(ValueError):
        K.knn(df.limit(1), 3, most=0)
    assert K.knn(df, 3, targets=df.limit(0).union(other.limit(1)), most=0).count() == df.count()


def test_cells_against_a_plain_loop(spark):
    import hashlib

    from corpuslens.operators import difficulty

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5)) * 10
    x = centres[rng.integers(0, 6, 2500)] + rng.normal(size=(2500, 5))
    ids = rng.permutation(10**6)[:2500]

    def loop(start):
        order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"7:{start}:{ids[i]}".encode()).digest(), ids[i]))
        rows, draw = x[order], np.random.default_rng([7, start])
        pool, c = rows[: 3 * 1024], [rows[0]]
        while len(c) < 6:
            d = np.array([min(((r - a) ** 2).sum() for a in c) for r in pool])
            c.append(pool[np.searchsorted(np.cumsum(d), draw.random() * d.sum())])
        c, given = np.array(c), np.zeros(6)
        for _ in range(10):
            for i in range(0, len(rows), 1024):
                batch = rows[i : i + 1024]
                own = [((r - c) ** 2).sum(1).argmin() for r in batch]
                for j in range(6):
                    if hits := [r for r, o in zip(batch, own, strict=True) if o == j]:
                        given[j] += len(hits)
                        c[j] = c[j] + (np.sum(hits, 0) - len(hits) * c[j]) / given[j]
        return c, np.mean([((r - c) ** 2).sum(1).min() for r in rows])

    for start in (0, 1, 2):
        c, far = difficulty.fit_cells(ids, x, 6, 7, start)
        want, want_far = loop(start)
        assert np.allclose(c, want) and far == pytest.approx(want_far)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>").repartition(4)
    best = min((loop(s) for s in (0, 1, 2)), key=lambda f: f[1])[0]
    own = np.bincount([((r - best) ** 2).sum(1).argmin() for r in x], minlength=6)
    got = {r.cell: r.n for r in difficulty.kmeans_occupancy(df, 6, 7).collect()}
    assert sorted(got) == list(range(6)) and sorted(got.values()) == sorted(own.tolist())  # starts that end alike may number the cells otherwise
    few = df.where(df.vec_id.isin([int(i) for i in ids[:5]]))
    assert difficulty.kmeans_occupancy(few, 100).count() == 2  # as many cells as half of the rows
    with pytest.raises(ValueError):
        difficulty.kmeans_occupancy(df.where("false"), 100)


def test_cells_of_equal_rows(spark):
    from corpuslens.operators import difficulty

    df = spark.range(20).selectExpr("id as vec_id", "array(1D, 2D) as v")
    assert sorted(r.n for r in difficulty.kmeans_occupancy(df, 4).collect()) == [0, 0, 0, 20]


def test_small_singular_values_stay(spark):
    """Of a matrix whose condition is 10^9, also those that a covariance would lose."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(600, 8)))
    x = q @ np.diag(10.0 ** -np.linspace(0, 9, 8)) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]
    rows = [("a", v.tolist()) for v in x] + [("b", v.tolist()) for v in x[:5] + 3]
    df = spark.createDataFrame(rows, "series string, v array<double>").repartition(7)
    for centred in (False, True):
        got = structure.eigenvalues(df, centred)
        for s, own in (("a", x), ("b", x[:5] + 3)):
            want = np.linalg.svd(own - own.mean(0) * centred, compute_uv=False)
            mine = np.sqrt(got[s] * len(own))
            assert len(mine) == 8 and np.abs(mine[: len(want)] - want).max() < 1e-13 * want[0] and (mine[len(want) :] == 0).all()
    assert np.sqrt(structure.eigenvalues(df, False)["a"] * 600)[-1] == pytest.approx(1e-9, rel=1e-5)


def test_wide_correlations_stay_on_the_executors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) + 1e4
    x[:, 7] = 2.5
    df = spark.createDataFrame([("a" if i % 3 else "b", v.tolist()) for i, v in enumerate(x)], "series string, v array<double>").repartition(5)
    monkeypatch.setattr(fidelity, "covariances", None)  # the driver asks for no matrix
    got = {(r.series, r.i, r.j): r.r for r in structure.correlation(df).collect()}
    for s, own in (("a", x[np.arange(300) % 3 > 0]), ("b", x[::3])):
        with np.errstate(all="ignore"):
            want = np.corrcoef(own.T)
        for i in range(40):
            for j in range(40):
                assert got[s, i, j] is None if 7 in (i, j) else got[s, i, j] == pytest.approx(want[i, j], abs=1e-9)
    assert structure.correlation(df.limit(0)).count() == 0
