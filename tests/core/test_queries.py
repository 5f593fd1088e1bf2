"""Every query against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from corpuslens.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(x):
        if x is None or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 9) if isinstance(x, float) else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_the_sql_gives_the_same(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_the_others_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_samples_have_the_reference_sizes(spark, monkeypatch):
    """Clamped only by the rows there are: 500 vectors make 10 draws of 50."""
    seen = {}
    note = lambda name, fn: monkeypatch.setattr(*name, lambda *a, **k: seen.setdefault(name[1], a[1:3]) and fn(*a, **k))
    for name in ((registry.structure, "draw_statistics"), (registry.structure, "pair_values"), (registry.panels, "pairwise")):
        note(name, getattr(*name))
    for q in ("draw_noise_floor", "pairwise_cosine", "pairwise_hist"):
        registry.QUERIES[q](spark, SF)
    spark.catalog.clearCache()
    assert seen == {"draw_statistics": (10, 50), "pair_values": (200_000, 42), "pairwise": (200_000, 42)}
    # Each query's distances to all real vectors but itself: more than the 200 targets of before.
    assert registry.QUERIES["distance_cdf"](spark, SF).count() == registry.real(spark, SF).count() - 1 > 200


def test_separability_uses_every_row(spark, monkeypatch):
    seen = {}

    def note(points, pool, k):
        seen.update(points={(r.vec_id, r.series) for r in points.collect()}, pool={(r.vec_id, r.series) for r in pool.collect()})
        return 0.5

    monkeypatch.setattr(registry.structure, "separability", note)
    registry.QUERIES["separability_auc"](spark, SF)
    every = {(r.vec_id, r.series) for r in registry.corpus(spark, SF).collect()}
    assert seen["points"] | seen["pool"] == every and not seen["points"] & seen["pool"]
    assert {s for _, s in seen["pool"]} == {"real"}
