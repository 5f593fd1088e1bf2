import numpy as np
import pyarrow as pa
import pytest

from corpuslens.operators import knn as K
from corpuslens.operators import structure


def brute(x, ids, y, tids, k, own):
    out = {}
    order = np.argsort(tids)
    y, tids = y[order], tids[order]
    for q, v in zip(ids, x, strict=True):
        d = np.sqrt(((v - y) ** 2).sum(1))
        d[np.full(len(d), own) & (tids == q)] = np.inf
        at = np.lexsort((tids, d))[:k]
        out[q] = [(int(tids[i]), float(d[i])) for i in at if np.isfinite(d[i])]
    return out


def clouds():
    rng = np.random.default_rng(21)
    mixed = np.concatenate([rng.standard_normal((300, 3)), rng.integers(0, 3, (300, 3)), np.zeros((300, 3)), [[0.0, -0.0, 0.0]] * 5, 1e6 + rng.standard_normal((100, 3)), [[np.inf, 0, 0], [np.nan, 1, 1]]])
    norms = np.stack([rng.integers(0, 4000, 900) / 100, rng.integers(0, 25, 900), 1e5 + rng.integers(0, 7, 900)], 1)
    return {"mixed": mixed, "norms": np.repeat(norms, 2, 0), "line": rng.integers(0, 500, (900, 1)).astype(float), "equal": np.ones((900, 2))}


@pytest.mark.parametrize("name", ["mixed", "norms", "line", "equal"])
def test_neighbours_in_cells_of_space(spark, monkeypatch, name):
    """many rows of few dimensions meet cell by cell, with ties, copies, borders and other targets, as all pairs give them."""
    monkeypatch.setattr(K, "CELL_ROWS", 16)
    used = []
    monkeypatch.setattr(K, "in_cells", lambda *a, f=K.in_cells: used.append(a[2:]) or f(*a))
    x = clouds()[name]
    ids = np.random.default_rng(22).permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>").repartition(3)
    other = df.where("vec_id % 2 = 0")
    for k, targets, most in ((1, None, None), (3, None, 0), (4, other, 0)):
        got = {}
        for r in K.knn(df, k, targets=targets, most=most).orderBy("q", "rk").collect():
            got.setdefault(r.q, []).append((r.rk, r.t, r.d))
        own, even = targets is None, ids % 2 == 0
        want = brute(x, ids, x if own else x[even], ids if own else ids[even], k, own)
        assert {q: [(i + 1, t, d) for i, (t, d) in enumerate(v)] for q, v in want.items() if v} == got
    assert used == [(1, True), (3, True), (4, False)]


def test_rows_visit_few_cells():
    """Customers at 60 times the size meet one cell and a part of its neighbours instead of all targets."""
    rng = np.random.default_rng(23)
    x = np.stack([rng.integers(0, 1_100_000, 60_000) / 100, rng.integers(0, 25, 60_000), 1e5 + rng.integers(0, 7, 60_000)], 1)
    cells = K.Cells(x[:8000], 60)
    home = cells.of(x)
    sizes = np.bincount(home, minlength=len(cells.low))
    assert len(sizes) == 60 and sizes.min() > 500 and sizes.max() < 2000
    visits = sum(len(cells.within(x[home == c], np.full(sizes[c], 8.0), c)[0]) for c in range(60))
    assert visits < len(x)
    assert all((cells.low[home] <= x).all(1)) and all((x <= cells.high[home]).all(1))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("width", [3, 64])
def test_single_precision_loses_no_neighbour(metric, width):
    """Equal to double precision over all targets, where ties, copies and norms leave it to that."""
    rng = np.random.default_rng(24)
    for v in (rng.standard_normal((3000, width)), rng.integers(0, 3, (3000, width)) + 0.0, 1e5 + 1e-3 * rng.integers(-40, 40, (3000, width)), np.repeat(rng.standard_normal((30, width)), 100, 0), 1 + 1e-9 * rng.standard_normal((3000, width))):
        block = K.Block(pa.array(np.arange(3000)), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), width))
        q, rk, t, d = K._nearest(10, metric, True)(np.arange(40), v[:40], block)
        for i in range(40):
            exact = K._exact(metric, v[i][None], v[None])[0]
            exact[i] = np.inf
            assert t[q == i].tolist() == np.lexsort((np.arange(3000), exact))[:10].tolist()
            assert np.array_equal(d[q == i], np.sort(exact)[:10])


def test_a_search_holds_few_scores():
    """F4 to F8: 200 queries among 20,000 rows within 40 MB (with all their distances at once it was 68)."""
    import tracemalloc

    v = np.random.default_rng(25).standard_normal((20_000, 64))
    block = K.Block(pa.array(np.arange(len(v))), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64))
    run = K._nearest(100, "l2", True)
    tracemalloc.start()
    run(np.arange(200), v[:200], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


@pytest.mark.parametrize("most", [None, 0])
@pytest.mark.parametrize("name", ["unit", "norms", "copies", "odd"])
def test_both_metrics_from_one_pass(spark, monkeypatch, name, most):
    """the rows of two searches, whatever the norms, with ties, copies and rows that aren't numbers, broadcast or in blocks."""
    monkeypatch.setattr(K, "BLOCK_BYTES", 1 << 14)
    rng = np.random.default_rng(26)
    x = rng.standard_normal((400, 6))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x = {"unit": x, "norms": x * rng.uniform(0.1, 40, (400, 1)), "copies": np.repeat(x[:20], 20, 0), "odd": np.concatenate([x, np.zeros((3, 6)), np.full((1, 6), np.nan)])}[name]
    df = spark.createDataFrame([(i * 3, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    found = K.both(df, 7, most)
    a, b = K.knn(df, 7), K.knn(df, 7, "cosine")
    for column, want in (("l2", a), ("cosine", b)):
        assert sorted(K.rows_of(found, column).collect()) == sorted(want.collect())
    assert sorted(structure.overlap(found, 7).collect()) == sorted(structure.agreement(a, b, 7).collect())
