"""Facts about the shape of a cloud of vectors, and how far its statistics move between draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import scans
from corpuslens.functions.quantiles import quantile
from corpuslens.functions.vectors import dot, exploded, norm
from corpuslens.operators import difficulty, fidelity, sampling
from corpuslens.operators import knn as K


def norm_facts(points: DataFrame) -> DataFrame:
    own = points.select(norm(F.col("v")).alias("n"))
    return own.agg(F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.max(F.abs(F.col("n") - 1)).alias("max_deviation"))


def unit_norm(points: DataFrame, atol: float = 1e-4) -> DataFrame:
    """rows, off (neither of unit norm within atol and 1e-5 of 1, nor exactly 0), norm_min, norm_max."""
    own = points.select(norm(F.col("v")).alias("n"))
    off = (F.abs(F.col("n") - 1) > atol + 1e-5) & (F.col("n") != 0)
    return own.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("off"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"))


def require_unit_norm(points: DataFrame, atol: float = 1e-4) -> None:
    r = unit_norm(points, atol).first()
    if r.off:
        raise ValueError(f"{r.off} of {r.rows} rows are not of unit norm (norms from {r.norm_min:.6g} to {r.norm_max:.6g})")


def mean_vector(points: DataFrame) -> DataFrame:
    """One row: mean, as an array."""
    m = exploded(points, "vec_id").groupBy("dim").agg(F.avg("x").alias("m"))
    return m.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))  # as many rows as dimensions


def anisotropy(points: DataFrame) -> DataFrame:
    mean = mean_vector(points).withColumn("size", norm(F.col("mean")))
    own = points.join(F.broadcast(mean)).select("size", (dot(F.col("v"), F.col("mean")) / F.greatest("size", F.lit(1e-12))).alias("c"))  # the mean is one row
    ends = own.agg(F.max("size").alias("mean_norm"), F.min("c").alias("cos_min"))
    return ends.join(quantile(own.select(F.col("c").alias("x")), 0.5)).select("mean_norm", F.col("q").alias("cos_median"), "cos_min")  # single rows


def pair_values(points: DataFrame, pairs: int, seed, value) -> DataFrame:
    """x: value(v of a, v of b) of random pairs."""
    drawn = sampling.random_pairs(points, pairs, seed)
    left = points.select(F.col("vec_id").alias("a"), F.col("v").alias("va"))
    right = points.select(F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return drawn.join(left, "a").join(right, "b").select("pair", value(F.col("va"), F.col("vb")).alias("x"))


def cosine(a, b):
    return dot(a, b) / (norm(a) * norm(b))


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Into so many groups a series' triangles go before they are folded into one.
FOLDS = 64


def triangles(df: DataFrame, centred: bool = True) -> dict[str, tuple[np.ndarray, int]]:
    """series -> (R, rows): the triangle of a QR decomposition of its rows (less their mean), so that nothing is squared and small singular values stay.
    Each task folds its rows into a triangle, groups of triangles are folded into one each, and these into the last; the driver gets one for each series."""
    import pyarrow as pa

    mean_of = fidelity.means(df)
    sent = df.sparkSession.sparkContext.broadcast({s: m if centred else 0 * m for s, (_, m) in mean_of.items()})
    kind = "series string, part int, x array<double>"

    def folded(batches, rows):
        held: dict = {}
        for batch in batches:
            for key, x in rows(batch):
                old = held.get(key)
                held[key] = np.linalg.qr(x if old is None else np.vstack([old, x]), mode="r")
        for (series, part), r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([series] * len(r), pa.string()), pa.array([part] * len(r), pa.int32()), pa.array(r.tolist(), pa.list_(pa.float64()))], ["series", "part", "x"])

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % FOLDS
        yield from folded(batches, lambda b: [((s, part), x - sent.value[s]) for s, x in fidelity._by_series(b)])

    def again(last: bool):
        def rows(batch):
            series, parts, x = np.asarray(batch.column(0).to_pylist(), object), np.asarray(batch.column(1)), K.matrix(batch.column(2))
            for key in sorted(set(zip(series.tolist(), parts.tolist(), strict=True))):
                yield (key[0], 0 if last else key[1]), x[(series == key[0]) & (parts == key[1])]

        return lambda batches: folded(batches, rows)

    own = df.select("series", "v").mapInArrow(first, kind)
    own = own.repartition("series", "part").mapInArrow(again(False), kind)
    held: dict = {}
    for r in own.repartition("series").mapInArrow(again(True), kind).toLocalIterator():
        held.setdefault(r.series, []).append(r.x)
    return {s: (np.array(held[s]), n) for s, (n, _) in sorted(mean_of.items())}


def eigenvalues(df: DataFrame, centred: bool = True, ddof: int = 0) -> dict[str, np.ndarray]:
    """series -> eigenvalues of its D x D covariance (or Gram) matrix, descending: squares of its rows' singular values."""
    out = {}
    for s, (r, n) in triangles(df, centred).items():
        values = np.linalg.svd(r, compute_uv=False) ** 2 / (n - ddof)
        out[s] = np.concatenate([values, np.zeros(r.shape[1] - len(values))])
    return out


def participation(values: np.ndarray) -> float:
    return float(values.sum() ** 2 / (values**2).sum())


def gram_participation(df: DataFrame, centred: bool) -> dict[str, float]:
    """(trace)^2 over the squared norm of the matrix: no eigenvalues are needed."""
    return {s: float(np.trace(c) ** 2 / (c * c).sum()) for s, (c, _, _) in fidelity.covariances(df, 0, centred).items()}


def spectrum_facts(values: np.ndarray) -> dict[str, float]:
    share = np.cumsum(values) / values.sum()
    return {f"components_{p}": int(np.searchsorted(share, p / 100)) + 1 for p in (90, 95, 99)} | {"participation": participation(values), "top_share": float(values[0] / values.sum())}


def effective_rank(values: np.ndarray, rows: int) -> float:
    p = values[: min(rows, len(values))] / values.sum()
    return float(np.exp(-(p * np.log(p + 1e-12)).sum()))


def spectrum_distance(real: np.ndarray, synth: np.ndarray) -> float:
    a, b = (np.sort(v) / v.sum() for v in (real, synth))
    return float(np.abs(a - b).mean())


def two_nn(points: DataFrame) -> DataFrame:
    """dimension: from the ratio of the second distance to the first, where both tell something."""
    near = K.knn(points, 2).groupBy("q").agg(F.min("d").alias("r1"), F.max("d").alias("r2")).where("r1 > 0 and r2 > r1")
    return near.agg((F.lit(1.0) / F.avg(F.ln(F.col("r2") / F.col("r1")))).alias("dimension"))


def draw_statistics(points: DataFrame, draws: int, rows: int, k: int, k_hub: int, nlist: int, seed=42) -> DataFrame:
    """draw, and its four statistics."""
    drawn = sampling.disjoint_draws(points, draws, rows, seed).persist()
    out = None
    for d in range(draws):
        own = difficulty.summary(drawn.where(F.col("draw") == d), k, k_hub, nlist, rows, seed, difficulty.CONTRAST_TARGETS).withColumn("draw", F.lit(d))
        out = own if out is None else out.unionByName(own)
    drawn.unpersist()
    return out


STATISTICS = ("lid_median", "relative_contrast_median", "hubness_skew", "ivf_gini")


def long_statistics(wide: DataFrame, *keys: str) -> DataFrame:
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("value")) for s in STATISTICS])))


def draw_floor(stats: DataFrame) -> DataFrame:
    """statistic, low, middle, high, spread, and spread in percent of the median. A draw in which a statistic couldn't be measured is an error."""
    lacking = stats.where(F.col("value").isNull() | F.isnan("value")).select("statistic").distinct().collect()  # four names at most
    if lacking:
        raise ValueError(f"not measured in every draw: {', '.join(sorted(r.statistic for r in lacking))}")
    g = stats.groupBy("statistic").agg(F.min("value").alias("low"), F.percentile("value", F.lit(0.5)).alias("middle"), F.max("value").alias("high"))
    return g.withColumn("spread", F.col("high") - F.col("low")).withColumn("spread_pct", 100 * F.col("spread") / F.nullif(F.abs("middle"), F.lit(0.0)))


def spread(values: DataFrame) -> DataFrame:
    """values(statistic, value) -> mean, std (ddof 1), low, high, range_pct, cv_pct; null percentages of a mean of 0. Single values have no spread and no row."""
    g = values.groupBy("statistic").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    size = F.nullif(F.abs("mean"), F.lit(0.0))
    return g.withColumn("range_pct", 100 * (F.col("high") - F.col("low")) / size).withColumn("cv_pct", 100 * F.col("std") / size)


def floor(values: DataFrame, real: DataFrame) -> DataFrame:
    """The spread of seeds, the signed gap of their mean to real(statistic, real), and that gap in spreads (null without a spread)."""
    own = spread(values).join(real, "statistic").withColumn("gap", F.col("mean") - F.col("real"))
    return own.withColumn("distance_in_spreads", F.abs("gap") / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """q, overlap: the share of neighbours that two searches have in common."""
    both = a.select("q", "t").join(b.select("q", "t", F.lit(1).alias("hit")), ["q", "t"], "left")
    return both.groupBy("q").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("overlap"))


def overlap(found: DataFrame, k: int) -> DataFrame:
    """agreement() of the two searches of K.both()."""
    return found.where(F.size("l2") > 0).select("q", (F.size(F.array_intersect("l2.t", "cosine.t")) / k).alias("overlap"))


def angular_vs_l2(points: DataFrame, k: int) -> DataFrame:
    found = K.both(points, k).persist()
    found.count()  # once: the parts below run side by side, and each would search
    parts = overlap(found, k).agg(F.avg("overlap").alias("agreement"))
    for name, near in (("l2", K.rows_of(found, "l2")), ("cosine", K.rows_of(found, "cosine"))):
        lid = difficulty.lid(near).agg(F.percentile("lid", F.lit(0.5)).alias(f"lid_{name}"))
        hub = difficulty.k_occurrence(points, near, k).agg(difficulty.skew("n").alias(f"hubness_{name}"))
        parts = parts.join(lid).join(hub)  # single rows
    row = parts.collect()
    found.unpersist()
    return points.sparkSession.createDataFrame(row, parts.schema)


def correlation(df: DataFrame) -> DataFrame:
    """series, i, j, r: correlations of components, null where one doesn't vary."""
    return fidelity.correlations(df)


def residual_correlation(r: np.ndarray) -> np.ndarray:
    """A correlation matrix without its first eigenvector's part."""
    w, u = np.linalg.eigh(r)
    return r - w[-1] * np.outer(u[:, -1], u[:, -1])


def rank_mass(r: np.ndarray, ranks=(1, 2, 4, 8)) -> dict[int, float]:
    w = np.sort(np.linalg.eigvalsh(r))[::-1]
    return {k: float(w[:k].sum() / np.trace(r)) for k in ranks}


def zero_probe(df: DataFrame) -> DataFrame:
    """series: the share of zeros, mean and deviation of components that aren't zero in a row, and the deviation that independent zeros of these rates would give."""
    nnz = df.select("series", F.aggregate("v", F.lit(0), lambda s, x: s + F.when(x != 0, 1).otherwise(0)).alias("nnz"))
    a = nnz.groupBy("series").agg(F.avg("nnz").alias("nnz_mean"), F.stddev_pop("nnz").alias("nnz_std"))
    z = fidelity.moments(df).groupBy("series").agg(F.avg("zero").alias("zero_rate"), F.sqrt(F.sum(F.col("zero") * (1 - F.col("zero")))).alias("independent_std"))
    return a.join(z, "series")


def buffer_stability(points: DataFrame, first: DataFrame, second: DataFrame, k: int = 20) -> DataFrame:
    """Distances of the same queries to two pools: the relative root mean square change, and correlations at ranks 1 and 5."""
    a, b = (K.knn(points, k, targets=t).select("q", "rk", F.col("d").alias(n)) for t, n in ((first, "x"), (second, "y")))
    own = a.join(b, ["q", "rk"])
    at = lambda r: F.corr(F.when(F.col("rk") == r, F.col("x")), F.when(F.col("rk") == r, F.col("y")))
    return own.agg((F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2))) / F.sqrt(F.avg(F.pow("x", F.lit(2))))).alias("change"), at(1).alias("corr_r1"), at(5).alias("corr_r5"))


def _sums(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of df(y, x) of fn(y, X), a vector of numbers; each task adds up its own rows."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fn(np.asarray(batch.column(0), float), K.matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = df.select("y", "x").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    return np.array([r.s for r in parts.orderBy("i").collect()])


def logistic(df: DataFrame, penalty: float = 1.0, steps: int = 25, enough: float = 1e-10) -> np.ndarray:
    """The weights of df(y 0 or 1, x array) and the intercept, which is the last: the least sum of losses and penalty / 2 of the squared weights without
    the intercept. By Newton steps, whose gradients and curvatures are sums over rows; the driver solves for one number a column."""
    wide = df.select(F.size("x").alias("d")).first()
    d = wide.d + 1
    w = np.zeros(d)
    ridge = np.full(d, penalty)
    ridge[-1] = 0

    def loss(y, x, at):
        z = x @ at[:-1] + at[-1]
        return np.array([(np.logaddexp(0, z) - y * z).sum()])

    def slopes(y, x):
        x = np.column_stack([x, np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        return np.concatenate([x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])

    cost = lambda at: float(_sums(df, lambda y, x: loss(y, x, at), 1)[0] + (ridge * at * at).sum() / 2)
    now = cost(w)
    for _ in range(steps):
        got = _sums(df, slopes, d + d * d)
        gradient, curvature = got[:d] + ridge * w, got[d:].reshape(d, d) + np.diag(ridge + 1e-12)
        move, size = np.linalg.solve(curvature, gradient), 1.0
        while (then := cost(w - size * move)) > now + 1e-9 * abs(now) and size > 1e-6:  # a step that overshoots is halved
            size /= 2
        w, now = w - size * move, then
        if np.abs(size * move).max() <= enough * (1 + np.abs(w).max()):
            break
    return w


def auc(scored: DataFrame) -> float | None:
    """scored(y 0 or 1, score): the share of pairs of a 1 and a 0 in which the 1 scores higher; ties are half. None without such pairs."""
    counts = scored.groupBy("score").agg(F.sum("y").cast("double").alias("ones"), F.sum(1 - F.col("y")).cast("double").alias("zeros"))
    placed = scans.running(counts.withColumn("all", F.lit(0)), ["all"], "score", {"below": ("sum", F.col("zeros"))}, True)
    r = placed.agg(F.sum(F.col("ones") * (F.coalesce("below", F.lit(0.0)) + F.col("zeros") / 2)).alias("won"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).first()
    return r.won / (r.ones * r.zeros) if r.ones and r.zeros else None


def separability(points: DataFrame, real: DataFrame, k: int, seed: int = 42) -> float | None:
    """Area under the curve of a logistic regression that tells points(label) apart by logarithms of distances to real, on a held-out half: the rows
    whose hash is odd. Features are standardised by the other half, on which it is fitted."""
    near = K.knn(points, k, targets=real).groupBy("q").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: F.log1p(x)).alias("x"))
    own = near.join(points.select(F.col("vec_id").alias("q"), F.col("label").cast("double").alias("y")), "q")
    half = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("q").cast("string"))), 1, 4), 16, 10).cast("int") % 2
    own = own.select("y", "x", half.alias("half")).persist()
    try:
        fit = own.where("half = 0")
        facts = exploded(fit, "y", column="x").groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).orderBy("dim").collect()  # k rows
        if not facts:
            return None
        mean, std = (F.array(*[F.lit(float(r[c])) for r in facts]) for c in ("mean", "std"))
        even = F.transform(F.arrays_zip(F.col("x").alias("x"), mean.alias("m"), std.alias("s")), lambda z: (z["x"] - z["m"]) / (z["s"] + 1e-9))
        w = logistic(fit.select("y", even.alias("x")))
        score = dot(F.col("x"), F.array(*[F.lit(float(v)) for v in w[:-1]])) + float(w[-1])
        return auc(own.where("half = 1").select("y", even.alias("x")).select("y", score.alias("score")))
    finally:
        own.unpersist()


def best_so_far(df: DataFrame, piece_rows: int = scans.PIECE_ROWS) -> DataFrame:
    """df(run, step, value, ...) with best: whether the value is below all before it. Steps of a run differ. A null value is no best, unless nothing came before it."""
    out = scans.running(df, ["run"], "step", {"least_before": ("min", F.col("value"))}, True, piece_rows)
    return out.withColumn("best", F.coalesce(F.col("value") < F.col("least_before"), F.lit(True))).drop("least_before")


def empty_cells(df: DataFrame) -> DataFrame:
    """One row for 128-wide rows: the share of 4 x 4 cells whose eight bins are all zero, and the share that independent zeros of the bins' rates would give."""
    from corpuslens.functions.vectors import cell_of

    row, col, _ = cell_of(F.col("dim"))
    x = exploded(df, "vec_id").select("vec_id", "dim", row.alias("row"), col.alias("col"), (F.col("x") == 0).cast("int").alias("zero"))
    seen = x.groupBy("vec_id", "row", "col").agg(F.min("zero").alias("empty")).agg(F.avg("empty").alias("empty_share"))
    rates = x.groupBy("dim", "row", "col").agg(F.avg("zero").alias("rate")).groupBy("row", "col").agg(F.product("rate").alias("p")).agg(F.avg("p").alias("independent_share"))
    return seen.join(rates)  # single rows


def group_correlations(r: np.ndarray) -> list[tuple[str, float]]:
    """Mean correlations of the components of 128-wide rows: within a cell by how far apart their orientations are on the circle, and between
    cells that touch and that don't, at the same orientation."""
    d = np.arange(len(r))
    row, col, bin_ = d // 32, d // 8 % 4, d % 8
    same = (row[:, None] == row) & (col[:, None] == col)
    gap = np.minimum((bin_[:, None] - bin_) % 8, (bin_ - bin_[:, None]) % 8)
    steps = np.maximum(np.abs(row[:, None] - row), np.abs(col[:, None] - col))
    out = [(f"cell_gap_{g}", same & (gap == g)) for g in range(1, 5)]
    out += [("touching_cells", ~same & (gap == 0) & (steps == 1)), ("apart_cells", (gap == 0) & (steps > 1))]
    return [(name, float(r[mask].mean())) for name, mask in out]


def _batch_profile(x: np.ndarray, k: int) -> np.ndarray | None:
    """The mean logarithm of each neighbour's distance over the last, within one batch; None where it can't be measured."""
    k = min(k, len(x) - 1)
    if k < 2:
        return None
    d = K.distances(x, x)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, :k]
    r = r[(r[:, 0] > 0) & (r[:, 0] < r[:, -1])]
    return np.log(np.clip(r[:, :-1] / r[:, -1:], 1e-12, 1.0)).mean(0) if len(r) else None


def batch_knn(points: DataFrame, k: int) -> DataFrame:
    """points(batch, vec_id, v) -> batch, q, rk, t, d: the k nearest others of the same batch, ties by id. A batch is held by one worker, as in training."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        ids, x = part["vec_id"].to_numpy(), np.array(part["v"].tolist(), float)
        d = np.array([np.sqrt(((x - row) ** 2).sum(1)) for row in x])  # from differences, so equal rows tie
        np.fill_diagonal(d, np.inf)
        n = min(k, len(x) - 1)
        at = np.argsort(d, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"batch": part["batch"].iloc[0], "q": np.repeat(ids, n), "rk": np.tile(np.arange(1, n + 1), len(ids)), "t": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    return points.select("batch", "vec_id", "v").groupBy("batch").applyInPandas(run, "batch long, q long, rk long, t long, d double")


def _penalties(trials, decay: float) -> np.ndarray:
    """trials of (real, other) profiles -> the penalty of each against the moving average of the real ones so far. One that can't be measured is 0 and leaves the average alone."""
    now, out = None, []
    for real, other in trials:
        if real is None or other is None or len(real) != len(other):
            out.append(0.0)
            continue
        real, other = np.asarray(real), np.asarray(other)
        now = real if now is None or len(now) != len(real) else now * decay + real * (1 - decay)
        out.append(float(np.abs(other - now).sum()))
    return np.array(out)


def penalty_scale(points: DataFrame, batch: int = 512, trials: int = 80, k: int = 20, max_points: int = 256, seed=42, decay: float = 0.99, adv_loss: float | None = None, fraction: float = 0.05) -> DataFrame:
    """floor: the mean and deviation of the log-ratio penalty of batches of the real series against the moving average of other real batches'
    profiles; signal: of batches of the other series. The first trials (a quarter, 20 at most) are left out, as the average still settles.
    suggested_alpha is the weight at which the signal is `fraction` of adv_loss; null without one. Batches are clamped to the rows there are,
    and max_points rows of a batch are measured (0: all)."""
    import pandas as pd

    n = {r.series: r["count"] for r in points.groupBy("series").count().collect()}
    rows = min(batch, n.get("real", 0) // 2, n.get("synth", 0))
    # A trial draws its first rows by hash from a window of the rows' own hashes, which holds enough by far; so a row is copied for the few trials
    # whose windows it lies in. On small tables that is all of them.
    share = F.when(F.col("series") == "real", min(1.0, (8 * rows + 200) / max(1, n.get("real", 0)))).otherwise(min(1.0, (4 * rows + 200) / max(1, n.get("synth", 0))))
    digits = lambda h: F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)
    place = digits(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("window"), F.col("vec_id").cast("string"))))
    own = points.select("vec_id", "v", "series", place.alias("place"), share.alias("share"))
    last = F.floor(F.col("place") * trials)
    first = F.when(F.col("share") >= 1, last - trials + 1).otherwise(F.floor((F.col("place") - F.col("share")) * trials) + 1)
    own = own.withColumn("trial", F.explode(F.when(first <= last, F.sequence(first, last)))).select("vec_id", "v", "series", F.pmod("trial", F.lit(trials)).cast("int").alias("trial"))
    own = own.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col("vec_id").cast("string"))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        ids, x = part["vec_id"].to_numpy(), np.array(part["v"].tolist(), float)
        d = np.array([np.sqrt(((x - row) ** 2).sum(1)) for row in x])  # from differences, so equal rows tie
        np.fill_diagonal(d, np.inf)
        n = min(k, len(x) - 1)
        at = np.argsort(d, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"batch": part["batch"].iloc[0], "q": np.repeat(ids, n), "rk": np.tile(np.arange(1, n + 1), len(ids)), "t": ids[at].ravel(), "d": np.take_along_axis(d, at, 1).ravel()})

    return points.select("batch", "vec_id", "v").groupBy("batch").applyInPandas(run, "batch long, q long, rk long, t long, d double")


def _penalties(trials, decay: float) -> np.ndarray:
    """trials of (real, other) profiles -> the penalty of each against the moving average of the real ones so far. One that can't be measured is 0 and leaves the average alone."""
    now, out = None, []
    for real, other in trials:
        if real is None or other is None or len(real) != len(other):
            out.append(0.0)
            continue
        real, other = np.asarray(real), np.asarray(other)
        now = real if now is None or len(now) != len(real) else now * decay + real * (1 - decay)
        out.append(float(np.abs(other - now).sum()))
    return np.array(out)


def penalty_scale(points: DataFrame, batch: int = 512, trials: int = 80, k: int = 20, max_points: int = 256, seed=42, decay: float = 0.99, adv_loss: float | None = None, fraction: float = 0.05) -> DataFrame:
    """floor: the mean and deviation of the log-ratio penalty of batches of the real series against the moving average of other real batches'
    profiles; signal: of batches of the other series. The first trials (a quarter, 20 at most) are left out, as the average still settles.
    suggested_alpha is the weight at which the signal is `fraction` of adv_loss; null without one. Batches are clamped to the rows there are,
    and max_points rows of a batch are measured (0: all)."""
    import pandas as pd

    n = {r.series: r["count"] for r in points.groupBy("series").count().collect()}
    rows = min(batch, n.get("real", 0) // 2, n.get("synth", 0))
    # Enough rows by far, so that a trial's first ones by hash are among them.
    share = F.when(F.col("series") == "real", (8 * rows + 200) / max(1, n.get("real", 0))).otherwise((4 * rows + 200) / max(1, n.get("synth", 0)))
    own = points.select("vec_id", "v", "series", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    own = own.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("trial").cast("string"), F.col("vec_id").cast("string"))))
    own = own.where(F.conv(F.substring("h", 1, 12), 16, 10).cast("double") < share * float(16**12))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "vec_id"])
        real, synth = (np.array(part.loc[part["series"] == s, "v"].tolist(), float) for s in ("real", "synth"))
        held = [x[: max_points or None] for x in (real[:rows], real[rows : 2 * rows], synth[:rows])]
        return pd.DataFrame([(part["trial"].iloc[0], *(_batch_profile(x, k) for x in held))], columns=["trial", "a", "b", "c"])

    got = sorted(own.groupBy("trial").applyInPandas(run, "trial int, a array<double>, b array<double>, c array<double>").collect(), key=lambda r: r.trial)  # a few numbers a trial
    warm = min(20, trials // 4)
    floor_, signal = (_penalties(((r.a, r[c]) for r in got), decay)[warm:] for c in "bc")
    alpha = None if adv_loss is None else fraction * abs(adv_loss) / max(float(signal.mean()), 1e-9)
    out = (len(floor_), float(floor_.mean()), float(floor_.std()), float(signal.mean()), float(signal.std()), float(signal.mean() / floor_.mean()) if floor_.mean() else None, alpha)
    return points.sparkSession.createDataFrame([out], "trials int, floor_mean double, floor_std double, signal_mean double, signal_std double, ratio double, suggested_alpha double")
