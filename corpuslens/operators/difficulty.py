"""How hard a corpus is to search: intrinsic dimension, contrast, hubness and partition balance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators import knn as K
from corpuslens.operators import sampling

#: Queries and targets whose distances are held at once to be added up.
SUM_ROWS, SUM_TARGETS = 1024, 256
#: The targets of relative contrast where it is asked for on a sample, as the original tool does.
CONTRAST_TARGETS = 2000
#: The k-means cells: starts, rows of a batch, passes over the sample that they are fitted to, and its rows at most.
STARTS, BATCH, PASSES, FIT_ROWS = 3, 1024, 10, 20_000


def survivors(knn: DataFrame) -> DataFrame:
    """knn rows with r1 and rmax, of queries whose first distance is above 0 and below their last."""
    own = Window.partitionBy("q")
    return knn.withColumn("r1", F.min("d").over(own)).withColumn("rmax", F.max("d").over(own)).where("r1 > 0 and r1 < rmax")


def ratio(d, rmax):
    return F.greatest(F.least(d / rmax, F.lit(1.0)), F.lit(1e-12))


def lid(knn: DataFrame) -> DataFrame:
    """q, lid: the maximum-likelihood local intrinsic dimension of each surviving query."""
    return survivors(knn).groupBy("q").agg((F.lit(-1.0) / F.avg(F.ln(ratio(F.col("d"), F.col("rmax"))))).alias("lid"))


def lid_of_lists(near: DataFrame, k_hub: int) -> DataFrame:
    """q, best, r1, lid of near(q, best), which has arrays of (d, t) in order: the first k_hub neighbours, and of surviving queries the first distance and
    lid(); null of others."""
    d = F.col("best.d")
    own = near.select("q", F.slice("best", 1, k_hub).alias("best"), d.alias("d"), F.array_min(d).alias("r1"), F.array_max(d).alias("rmax"))
    logs = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.ln(ratio(x, F.col("rmax"))))
    kept = lambda x: F.when((F.col("r1") > 0) & (F.col("r1") < F.col("rmax")), x)
    return own.select("q", "best", kept(F.col("r1")).alias("r1"), kept(-F.size("d") / logs).alias("lid"))


def distance_sums(x: np.ndarray, block: K.Block, at: np.ndarray) -> np.ndarray:
    """Of each row's distances to all targets: by one product that expands squares around the targets' centre, and where rounding would show, anew from
    the differences. at: where a row is among the targets, which counts 0, or -1."""
    total, whole = np.zeros(len(x)), block.sound and K.sound(x)
    if whole:
        own = x - block.centre
        a = (own * own).sum(1)
        left = np.column_stack([-2 * own, a, np.ones(len(x))])
    for i in range(0, len(block.ids), SUM_TARGETS):
        y = block.v[i : i + SUM_TARGETS]
        same = np.flatnonzero((at >= i) & (at < i + len(y)))
        if whole:
            near = y - block.centre
            b = (near * near).sum(1)
            d = left @ np.column_stack([near, np.ones(len(y)), b]).T
            rough = 4e6 * np.finfo(float).eps * (x.shape[1] + 8) * (a + b.max())
            for r in np.flatnonzero(d.min(1) <= rough):
                few = np.flatnonzero(d[r] <= rough[r])
                d[r, few] = ((x[r] - y[few]) ** 2).sum(1)
            np.sqrt(d, out=d)
        else:
            d = K.distances(x, y)
        d[same, at[same] - i] = 0
        total += d.sum(1)
    return total


def mean_distances(points: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """q, mean: of the distances to all targets; a query that is a target counts itself with 0."""

    def run(ids, x, block):
        at = np.minimum(np.searchsorted(block.ids, ids), len(block.ids) - 1)
        return ids, distance_sums(x, block, np.where(block.ids[at] == ids, at, -1)), np.full(len(ids), len(block.ids))

    run.rows = SUM_ROWS
    sums = K.blocks(points, K.Targets(targets, most=most), run, "q long, s double, n long")
    return sums.groupBy("q").agg((F.sum("s") / F.sum("n")).alias("mean"))


def relative_contrast(points: DataFrame, knn: DataFrame, seed=42, targets: int = 0) -> DataFrame:
    """q, contrast: mean distance to all points (or to a sample of `targets` of them) over the first distance, of surviving queries."""
    return contrasts(points, survivors(knn).where("rk = 1").select("q", "r1"), seed, targets).select("q", "contrast")


def contrasts(points: DataFrame, first: DataFrame, seed=42, targets: int = 0) -> DataFrame:
    """first(q, r1, ...) with contrast: mean distance to all points (or to a sample of `targets` of them) over r1."""
    return first.join(mean_distances(points, sampling.sample(points, targets, seed)), "q").withColumn("contrast", F.col("mean") / F.col("r1")).drop("mean")


def k_occurrence(points: DataFrame, knn: DataFrame, k_hub: int) -> DataFrame:
    """vec_id, n: in how many first k_hub neighbours each point is; 0 for points in none."""
    n = knn.where(F.col("rk") <= k_hub).groupBy(F.col("t").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    return points.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def skew(column: str):
    """Population skewness, 0 without spread."""
    return F.coalesce(F.skewness(column), F.lit(0.0))


def lists_of(n: int, nlist: int) -> int:
    return max(2, min(nlist, n // 2))


def ivf_occupancy(points: DataFrame, nlist: int, seed=42) -> DataFrame:
    """cell, n: points by their nearest centroid (ties to the smaller id); centroids are rows drawn by hash; empty cells count 0."""
    centroids = sampling.sample(points, lists_of(points.count(), nlist), seed)
    nearest = K.knn(points, 1, targets=centroids).groupBy(F.col("t").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return centroids.select(F.col("vec_id").alias("cell")).join(nearest, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fit_cells(ids: np.ndarray, x: np.ndarray, k: int, seed: int, start: int) -> tuple[np.ndarray, float]:
    """k centroids of rows by mini-batch k-means, and the rows' mean squared distance to them. Rows go in the order of their ids' hashes. The first
    centroids are drawn among the first rows in proportion to the squared distance to those drawn before. Each batch moves a centroid to the mean of all
    rows that it has been given so far."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"{seed}:{start}:{ids[i]}".encode()).digest(), ids[i]))
    x = x[order]
    squares = lambda rows, c: np.maximum((rows * rows).sum(1)[:, None] + (c * c).sum(1) - 2 * rows @ c.T, 0)
    rng, pool = np.random.default_rng([seed, start]), x[: 3 * max(BATCH, k)]
    centroids = [pool[0]]
    left = squares(pool, pool[:1])[:, 0]
    for _ in range(1, k):
        at = int(np.searchsorted(np.cumsum(left), rng.random() * left.sum())) if left.sum() > 0 else len(centroids)
        centroids.append(pool[min(at, len(pool) - 1)])
        left = np.minimum(left, squares(pool, centroids[-1][None])[:, 0])
    c, given = np.array(centroids), np.zeros(k)
    for _ in range(PASSES):
        for i in range(0, len(x), BATCH):
            rows = x[i : i + BATCH]
            own = squares(rows, c).argmin(1)
            n, sums = np.bincount(own, minlength=k), np.zeros_like(c)
            np.add.at(sums, own, rows)
            hit = n > 0
            given[hit] += n[hit]
            c[hit] += (sums[hit] - n[hit, None] * c[hit]) / given[hit, None]
    far = [squares(x[i : i + BATCH], c).min(1).sum() for i in range(0, len(x), BATCH)]
    return c, float(sum(far) / max(1, len(x)))


def cells_of(points: DataFrame, nlist: int, seed: int = 42) -> DataFrame:
    """vec_id (the cell's number), v: the centroids of the best of STARTS fits to a sample of FIT_ROWS rows at most."""
    k = lists_of(points.count(), nlist)

    def fit(table: pa.Table) -> pa.Table:
        start = table.column("start")[0].as_py()
        c, far = fit_cells(np.asarray(table.column("vec_id"), np.int64), K.matrix(table.column("v").combine_chunks()), k, seed, start)
        return pa.table([pa.array([start] * k, pa.int32()), pa.array(range(k), pa.int64()), pa.array(c.tolist(), pa.list_(pa.float64())), pa.array([far] * k)], ["start", "vec_id", "v", "far"])

    drawn = sampling.sample(points.select("vec_id", "v"), FIT_ROWS, seed).withColumn("start", F.explode(F.array(*map(F.lit, range(STARTS)))))
    fits = drawn.groupBy("start").applyInArrow(fit, "start int, vec_id long, v array<double>, far double").collect()  # a few centroids for each start
    if not fits:
        raise ValueError("cells need points")
    best = min((r.far, r.start) for r in fits)[1]
    return points.sparkSession.createDataFrame([(r.vec_id, r.v) for r in fits if r.start == best], "vec_id long, v array<double>")


def kmeans_occupancy(points: DataFrame, nlist: int, seed: int = 42) -> DataFrame:
    """cell, n: all points by the nearest centroid (ties to the smaller number) of a mini-batch k-means; empty cells count 0."""
    cells = cells_of(points, nlist, seed)
    found = K.knn(points, 1, targets=cells).groupBy(F.col("t").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select(F.col("vec_id").alias("cell")).join(found, "cell", "left").select(F.col("cell").cast("int").alias("cell"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gini(cells: DataFrame, column: str = "n") -> DataFrame:
    """gini of one row for each cell (a bounded number): 0 where nothing is held."""
    own = cells.select(F.col(column).cast("double").alias("x")).withColumn("i", F.row_number().over(Window.orderBy("x")))
    n, s = F.count(F.lit(1)), F.sum("x")
    return own.agg(F.when(s > 0, 2 * F.sum(F.col("i") * F.col("x")) / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))


def lorenz(cells: DataFrame) -> DataFrame:
    """i, share_cells, share_points: cumulated over cells by size."""
    order = Window.orderBy("n", "cell")
    own = cells.withColumn("i", F.row_number().over(order)).withColumn("c", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy()
    total = F.sum("n").over(whole)
    return own.select(F.col("i").cast("long").alias("i"), (F.col("i") / F.count(F.lit(1)).over(whole)).alias("share_cells"), F.when(total > 0, F.col("c") / total).otherwise(0.0).alias("share_points"))


def summary(points: DataFrame, k: int = 100, k_hub: int = 10, nlist: int = 256, max_rows: int = 0, seed=42, targets: int = 0) -> DataFrame:
    """One row: the four gate statistics (null where they can't be measured), the discarded queries and the conditions after clamping. All points are
    measured against all; with max_rows a sample of so many, with `targets` their contrast against a sample of so many.
    One pass of neighbours serves all; what is needed of it is held while the row is computed, here, and released then."""
    spark = points.sparkSession
    points = sampling.sample(points, max_rows, seed).persist()
    n = points.count()
    k_eff = min(k, n - 1)
    near = lid_of_lists(K.knn_lists(points, k), min(k_hub, k_eff)).persist()
    near.count()  # once: the parts below run side by side, and each would search
    half = lambda name: F.percentile(name, F.lit(0.5))
    lids = near.agg(half("lid").alias("lid_median"), F.count("lid").alias("kept"))
    contrast = contrasts(points, near.select("q", "r1"), seed, targets).agg(half("contrast").alias("relative_contrast_median"))
    hubs = k_occurrence(points, K.rows_of(near, "best"), k_hub).agg(skew("n").alias("hubness_skew"))
    balance = gini(ivf_occupancy(points, nlist, seed)).withColumnRenamed("gini", "ivf_gini")
    out = lids.join(contrast).join(hubs).join(balance)  # single rows
    out = out.select("lid_median", "relative_contrast_median", "hubness_skew", "ivf_gini", (F.lit(n) - F.col("kept")).cast("long").alias("lid_discarded_queries"), F.lit(n).cast("long").alias("ann_measured_rows"), F.lit(k_eff).cast("long").alias("ann_k"), F.lit(lists_of(n, nlist)).cast("long").alias("ann_nlist"))
    row = out.collect()
    near.unpersist()
    points.unpersist()
    return spark.createDataFrame(row, out.schema)
