"""The queries that SQL can't express, against numpy on the smallest tables."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpuslens.operators import sampling
from corpuslens.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def table():
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, label = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
    return ids, np.array(t.column("embedding").to_pylist(), float), label < 5


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def values(x, ddof=1):
    return np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / (len(x) - ddof)


def test_spectra(spark, table):
    _, x, real = table
    of = {"real": x[real], "synth": x[~real]}
    spectrum = {s: values(v) for s, v in of.items()}
    for r in run(spark, "pca_spectrum"):
        share = spectrum[r.series] / spectrum[r.series].sum()
        assert r.ratio == pytest.approx(share[r.comp - 1], abs=1e-6) and r.cum == pytest.approx(share[: r.comp].sum(), abs=1e-6)
    for r in run(spark, "effective_rank"):
        p = spectrum[r.series] / spectrum[r.series].sum()
        assert r.effective_rank == pytest.approx(np.exp(-(p * np.log(p + 1e-12)).sum()), abs=1e-5)
    (r,) = run(spark, "spectrum_distance")
    a, b = (np.sort(v) / v.sum() for v in spectrum.values())
    assert r.spectrum_distance == pytest.approx(np.abs(a - b).mean(), abs=1e-6)
    for r in run(spark, "spectrum_facts"):
        v = spectrum[r.series]
        share = np.cumsum(v) / v.sum()
        assert [r.components_90, r.components_95, r.components_99] == [np.searchsorted(share, p) + 1 for p in (0.9, 0.95, 0.99)]
        assert r.participation == pytest.approx(v.sum() ** 2 / (v**2).sum(), abs=1e-5) and r.top_share == pytest.approx(share[0], abs=1e-6)


def test_residual_correlation(spark, table):
    _, x, _ = table
    c = np.corrcoef(x.T)
    w, u = np.linalg.eigh(c)
    rest = c - w[-1] * np.outer(u[:, -1], u[:, -1])
    for r in run(spark, "residual_correlation"):
        assert r.residual == pytest.approx(np.mean([rest[i, i + r.gap] for i in range(len(c) - r.gap)]), abs=2e-6)
        assert r["mass"] == (pytest.approx(np.sort(w)[::-1][: r.gap].sum() / len(c), abs=2e-6) if r.gap in (1, 2, 4, 8) else None)


def test_scatter(spark, table):
    ids, x, _ = table
    y = x - x.mean(0)
    axes = np.linalg.svd(y, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    want = dict(zip(ids.tolist(), y @ axes.T, strict=True))
    got = run(spark, "scatter")
    assert len(got) == len(ids)
    for r in got:
        assert [r.x, r.y] == pytest.approx(want[r.vec_id].tolist(), abs=2e-6)


def test_whitening(spark, table):
    ids, x, _ = table
    split = {r.vec_id: r.is_holdout for r in sampling.holdout_split(registry.corpus(spark, SF), 0.2, 42).collect()}
    held = np.array([split[i] for i in ids.tolist()])
    cov, mean = np.cov(x[~held].T), x[~held].mean(0)
    u, s, _ = np.linalg.svd(cov + 1e-8 * np.eye(len(cov)), hermitian=True)
    white = (x - mean) @ (u @ np.diag(1 / np.sqrt(s + 1e-8)) @ u.T)
    for r in run(spark, "whiten"):
        own = white[held if r.series == "held" else ~held][:, r.dim]
        assert r["mean"] == pytest.approx(own.mean(), abs=2e-6) and r["var"] == pytest.approx(own.var(ddof=1), abs=2e-5)


def test_separability(spark, table):
    import hashlib

    ids, x, real = table
    order = sorted(ids[real].tolist(), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    pool = np.isin(ids, order[: real.sum() // 3])
    d = np.sqrt(((x[~pool][:, None] - x[pool][None]) ** 2).sum(2))
    f, y = np.log1p(np.sort(d, 1)[:, :10]), real[~pool].astype(float)
    first = np.array([int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:4], 16) % 2 == 0 for i in ids[~pool].tolist()])
    z = (f - f[first].mean(0)) / (f[first].std(0) + 1e-9)
    z = np.column_stack([z, np.ones(len(z))])
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(10), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z[first] @ w))
        w -= np.linalg.solve(z[first].T @ (z[first] * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-12), z[first].T @ (p - y[first]) + ridge * w)
    score, own = (z @ w)[~first], y[~first]
    ones, zeros = score[own == 1], score[own == 0]
    want = np.mean((ones[:, None] > zeros) + (ones[:, None] == zeros) / 2)
    assert run(spark, "separability_auc")[0].auc == pytest.approx(want, abs=2e-5)


def test_summary_of_orders(spark):
    import hashlib

    t = pq.read_table(f"{SF}/orders.parquet").to_pandas()
    ids = t.o_orderkey.tolist()
    x = np.column_stack([t.o_totalprice / 1000, t.o_custkey % 1000, t.o_orderdate.dt.dayofyear, t.o_orderdate.dt.year * 10.0]).astype(float)
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"42:{ids[i]}".encode()).hexdigest(), ids[i]))
    n, place = len(ids), np.argsort(np.argsort(ids))
    lid, contrast, hubs, cells, left = [], [], np.zeros(n, int), np.zeros(256, int), 0
    targets, centroids = x[order[:2000]], x[order[:256]]
    names = np.array([ids[i] for i in order[:256]])
    for i in range(n):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        near = np.lexsort((place, d))[:100]
        hubs[near[:10]] += 1
        r = d[near]
        to = np.sqrt(((centroids - x[i]) ** 2).sum(1))
        cells[np.lexsort((names, to))[0]] += 1
        if 0 < r[0] < r[-1]:
            lid.append(-1 / np.log(np.clip(r / r[-1], 1e-12, 1)).mean())
            contrast.append(np.sqrt(((targets - x[i]) ** 2).sum(1)).mean() / r[0])
        else:
            left += 1
    (got,) = run(spark, "ann_summary_orders")
    assert got.lid_median == pytest.approx(np.median(lid), abs=1e-5) and got.relative_contrast_median == pytest.approx(np.median(contrast), rel=1e-6)
    assert got.hubness_skew == pytest.approx(((hubs - hubs.mean()) ** 3).mean() / hubs.std() ** 3, abs=1e-5)
    sizes = np.sort(cells)
    assert got.ivf_gini == pytest.approx(2 * (np.arange(1, 257) * sizes).sum() / (256 * sizes.sum()) - 257 / 256, abs=1e-6)
    assert (got.lid_discarded_queries, got.ann_measured_rows, got.ann_k, got.ann_nlist) == (left, n, 100, 256)
