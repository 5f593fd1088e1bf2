"""Statistics of all rows against all rows, on more of them than the samples that were taken before."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpuslens.operators import difficulty
from corpuslens.operators import knn as K
from corpuslens.plans import registry


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")


def brute(x, k):
    """Mean distance to all rows, and the k first distances to others."""
    mean, near = np.empty(len(x)), np.empty((len(x), k))
    for i in range(0, len(x), 256):
        d = np.sqrt(sum((x[i : i + 256, j, None] - x[:, j]) ** 2 for j in range(x.shape[1])))
        mean[i : i + 256] = d.mean(1)
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        near[i : i + 256] = np.sort(np.partition(d, k, axis=1)[:, :k], axis=1)
    return mean, near


def test_the_summary_measures_every_row(spark):
    x = np.random.default_rng(3).standard_normal((20_400, 2))
    s = difficulty.summary(frame(spark, x), k=4, k_hub=2, nlist=8).first()
    mean, near = brute(x, 4)
    assert (s.ann_measured_rows, s.ann_k, s.ann_nlist, s.lid_discarded_queries) == (len(x), 4, 8, 0)
    assert s.relative_contrast_median == pytest.approx(np.median(mean / near[:, 0]), rel=1e-9)
    assert s.lid_median == pytest.approx(np.median(-1 / np.log(near / near[:, -1:]).mean(1)), rel=1e-9)
    some = difficulty.summary(frame(spark, x[:300]), k=4, max_rows=200, targets=50).first()
    assert some.ann_measured_rows == 200  # a sample for those that ask for one


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """More vectors than a sample of targets has."""
    x = np.random.default_rng(4).standard_normal((2300, 6)).astype(np.float32)
    x[:700] *= 3
    path = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"vec_id": range(len(x)), "embedding": x.tolist(), "label": pa.array([i % 10 for i in range(len(x))], pa.int32())}), path / "embeddings.parquet")
    return str(path), x.astype(float)


@pytest.mark.parametrize("name", ["ann_summary", "gate_on_corpus"])
def test_contrast_is_against_every_row(spark, table, name):
    sf, x = table
    rows = [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.execute(registry.SQL[name]).df().astype(object).to_dict("records")
    key = lambda r: str(r.get("statistic"))
    for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        assert {k: v for k, v in a.items() if v is not None} == pytest.approx({k: v for k, v in b.items() if v is not None and v == v}, abs=1e-9)
    mean, near = brute(x, 100)
    got = rows[0].get("relative_contrast_median") or next(r["value"] for r in rows if r.get("statistic") == "relative_contrast_median")
    assert got == pytest.approx(np.median(mean / near[:, 0]), abs=1e-6)


def test_copies_beyond_the_neighbours(spark):
    """Their last distance is 0, by which nothing is divided."""
    x = np.concatenate([np.zeros((12, 3)), np.random.default_rng(7).standard_normal((40, 3))])
    s = difficulty.summary(frame(spark, x), k=5).first()
    _, near = brute(x, 5)
    kept = (near[:, 0] > 0) & (near[:, 0] < near[:, -1])
    assert (s.lid_discarded_queries, s.ann_measured_rows) == (52 - kept.sum(), 52) and 0 < kept.sum() <= 40
    assert s.lid_median == pytest.approx(np.median(-1 / np.log(near[kept] / near[kept, -1:]).mean(1)))


def test_sums_of_distances(monkeypatch):
    """Copies, near copies, rows far from the origin and rows that aren't finite."""
    monkeypatch.setattr(difficulty, "SUM_TARGETS", 64)
    x = np.random.default_rng(5).standard_normal((300, 5))
    x = np.concatenate([x, x[:60], x[:60] + 1e-9, x[:60] + 1e-5, np.zeros((9, 5))])
    for v in (x, x + 1e6, np.concatenate([x, [[np.inf] * 5]])):
        block = K.Block(pa.array(range(len(v))), pa.array(v.tolist()))
        at = np.where(np.arange(len(v)) % 2, np.arange(len(v)), -1)
        with np.errstate(invalid="ignore"):
            got, d = difficulty.distance_sums(v, block, at), np.sqrt(((v[:, None] - v) ** 2).sum(2))
        d[range(len(v)), range(len(v))] = 0
        assert np.isfinite(got[:400]).all() == np.isfinite(v).all()
        assert np.allclose(got, d.sum(1), rtol=1e-10) or not np.isfinite(v).all()


def test_lists_have_what_rows_have(spark, monkeypatch):
    x = np.random.default_rng(6).integers(0, 4, (900, 3)).astype(float)
    for cells in (4096, 16):  # met whole, and in cells of space
        monkeypatch.setattr(K, "CELL_ROWS", cells)
        df = frame(spark, x)
        assert sorted(K.rows_of(K.knn_lists(df, 7), "best").collect()) == sorted(K.knn(df, 7).collect())
