"""How far a synthetic series is from a real one."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import scans
from corpuslens.functions.quantiles import quantiles
from corpuslens.functions.vectors import exploded
from corpuslens.operators import knn as K


def moments(df: DataFrame) -> DataFrame:
    """series, dim, mean, var (population), std, zero: of each component."""
    x = exploded(df, "series")
    return x.groupBy("series", "dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.stddev_pop("x").alias("std"), F.avg((F.col("x") == 0).cast("double")).alias("zero"), F.count(F.lit(1)).alias("n"))


def _pair(df: DataFrame, *columns: str) -> DataFrame:
    """Both series side by side, by dim."""
    sides = [df.where(F.col("series") == s).select("dim", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in ("real", "synth")]
    return sides[0].join(sides[1], "dim")


def mean_var_l2(df: DataFrame) -> DataFrame:
    own = _pair(moments(df), "mean", "var")
    far = lambda c: F.sqrt(F.sum(F.pow(F.col(f"{c}_real") - F.col(f"{c}_synth"), 2)))
    return own.agg(far("mean").alias("mean_l2"), far("var").alias("var_l2"))


def _sums(batches, add):
    """add(batch) gives (series, part, count, numbers); a row for each series and part, added up."""
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        for series, part, n, x in add(batch):
            old = held.get((series, part))
            held[series, part] = (n, x) if old is None else (old[0] + n, old[1] + x)
    rows = list(held.items())
    yield pa.RecordBatch.from_arrays([pa.array([s for (s, _), _ in rows], pa.string()), pa.array([p for (_, p), _ in rows], pa.int32()), pa.array([n for _, (n, _) in rows], pa.int64()), pa.array([x.tolist() for _, (_, x) in rows], pa.list_(pa.float64()))], ["series", "part", "n", "x"])


SUMS = "series string, part int, n long, x array<double>"


def _added(parts: DataFrame) -> DataFrame:
    """A row for each series and part: the sum of all tasks' rows, added up as they come in, each part in one task."""

    def run(batches):
        rows = lambda b: zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (np.asarray(x, float) for x in b.column(3).to_pylist()), strict=True)
        yield from _sums(batches, rows)

    return parts.repartition("series", "part").mapInArrow(run, SUMS)


def _by_series(batch):
    names, v = np.asarray(batch.column(0).to_pylist(), object), K.matrix(batch.column(1))
    for s in sorted(set(names.tolist())):
        yield s, v[names == s]


def means(df: DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """series -> (rows, mean)."""

    def totals(batches):
        yield from _sums(batches, lambda b: [(s, 0, len(x), x.sum(0)) for s, x in _by_series(b)])

    return {r.series: (r.n, np.array(r.x) / r.n) for r in _added(df.select("series", "v").mapInArrow(totals, SUMS)).collect()}  # one vector for each series


def _products(df: DataFrame, shift: dict[str, np.ndarray], scale: dict[str, np.ndarray] | None = None) -> DataFrame:
    """series, part, x: the rows of the outer products' sum of what differs from shift (over scale), added up on the executors; the last part holds the plain sum."""
    import pyarrow as pa

    sent = df.sparkSession.sparkContext.broadcast((shift, scale))

    def run(batches):
        held: dict = {}
        shift, scale = sent.value
        for batch in batches:
            for s, x in _by_series(batch):
                y = x - shift[s] if scale is None else (x - shift[s]) / scale[s]
                g, t = held.get(s, (0.0, 0.0))
                held[s] = g + y.T @ y, t + y.sum(0)
        for s, (g, t) in held.items():
            parts = [*g, t]
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([0] * len(parts), pa.int64()), pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))], ["series", "part", "n", "x"])

    return _added(df.select("series", "v").mapInArrow(run, SUMS))


def covariances(df: DataFrame, ddof: int = 1, centred: bool = True) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """series -> (covariance, mean, rows): the means first, then outer products of what differs from them, against cancellation. Each task
    adds up its own; rows of these matrices meet on the executors, and the driver gets one D x D matrix of each series."""
    mean_of = means(df)
    rows: dict = {s: {} for s in mean_of}
    for r in _products(df, {s: m for s, (_, m) in mean_of.items()}).toLocalIterator():
        rows[r.series][r.part] = np.array(r.x)
    out = {}
    for s in sorted(mean_of):
        n, mean = mean_of[s]
        rest = rows[s].pop(len(mean)) / n  # what rounding of the mean leaves
        gram = np.array([rows[s][i] for i in range(len(mean))]) - n * np.outer(rest, rest)
        mean = mean + rest
        out[s] = ((gram if centred else gram + n * np.outer(mean, mean)) / (n - ddof), mean, n)
    return out


def correlations(df: DataFrame) -> DataFrame:
    """series, i, j, r: correlations of components; null where one doesn't vary. Means and deviations come first, a vector for each series; the products of what
    they leave stay on the executors, a row of the matrix at a time."""
    mean_of = means(df)
    if not mean_of:
        return df.sparkSession.createDataFrame([], "series string, i int, j int, r double")
    sent = df.sparkSession.sparkContext.broadcast({s: m for s, (_, m) in mean_of.items()})

    def squares(batches):
        parts = lambda b: [x for s, v in _by_series(b) for y in [v - sent.value[s]] for x in ((s, 0, 0, (y * y).sum(0)), (s, 1, 0, y.sum(0)))]
        yield from _sums(batches, parts)

    found = {(r.series, r.part): np.array(r.x) for r in _added(df.select("series", "v").mapInArrow(squares, SUMS)).collect()}  # two vectors for each series
    shift, scale = {}, {}
    for s, (n, mean) in mean_of.items():
        rest = found[s, 1] / n
        std = np.sqrt(np.maximum(found[s, 0] / n - rest * rest, 0))
        shift[s], scale[s] = mean + rest, np.where(std > 1e-14 * np.abs(mean), std, np.nan)
    rows = F.broadcast(df.sparkSession.createDataFrame([(s, n) for s, (n, _) in mean_of.items()], "series string, rows long"))  # a row for each series
    flat = _products(df, shift, scale).where(F.col("part") < F.size("x")).join(rows, "series").select("series", F.col("part").alias("i"), "rows", F.posexplode("x").alias("j", "x"))
    return flat.select("series", "i", "j", F.when(F.isnan("x"), None).otherwise(F.col("x") / F.col("rows")).alias("r"))


def covariance_fro(df: DataFrame) -> float:
    c = covariances(df)
    return float(np.linalg.norm(c["real"][0] - c["synth"][0]))


def _mean_of(a: DataFrame, b: DataFrame, fn, most: int | None = None) -> float:
    """The mean of fn over all pairs of distances; sums of blocks are added up by the cluster."""
    run = lambda ids, x, block: (ids[:1], [fn(K.distances(x, block.v)).sum()], [len(ids) * len(block.ids)])
    got = K.blocks(a, K.Targets(b, most=most), run, "q long, s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return got.s / got.n


def mmd_rbf(real: DataFrame, synth: DataFrame, gamma: float = 1.0, most: int | None = None) -> float:
    """The squared discrepancy, biased: pairs of a row with itself count."""
    kernel = lambda d: np.exp(-gamma * d * d)
    return _mean_of(real, real, kernel, most) + _mean_of(synth, synth, kernel, most) - 2 * _mean_of(real, synth, kernel, most)


def pairwise_hist_l1(real: DataFrame, synth: DataFrame, bins: int = 50, most: int | None = None) -> DataFrame:
    """bin, real, synth: densities of distances within real (a row with itself too) and from real to synth, over edges that the norms bound."""
    from corpuslens.functions.vectors import norm

    top = [float(df.agg(F.max(norm(F.col("v")))).first()[0]) for df in (real, synth)]
    high = max(2 * top[0], top[0] + top[1], 1e-6)
    edges = np.linspace(0, high, bins + 1)

    def counts(b: DataFrame) -> DataFrame:
        def run(ids, x, block):
            return np.arange(bins), np.histogram(K.distances(x, block.v), edges)[0].astype(np.int64)

        got = K.blocks(real, K.Targets(b, most=most), run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy())
        return got.select("bin", F.when(total > 0, F.col("n") / (total * F.lit(high / bins))).otherwise(0.0).alias("density"))

    return counts(real).withColumnRenamed("density", "real").join(counts(synth).withColumnRenamed("density", "synth"), "bin")


def knn_recall(queries: DataFrame, train: DataFrame, synth: DataFrame, k: int = 10) -> DataFrame:
    """The share of queries whose first synthetic neighbour is no farther than their k-th real one."""
    k = min(k, max(1, train.count() - 1))
    real = K.knn(queries, k, targets=train).groupBy("q").agg(F.max("d").alias("r"))
    fake = K.knn(queries, 1, targets=synth).select("q", F.col("d").alias("f"))
    return real.join(fake, "q").agg(F.avg((F.col("f") <= F.col("r")).cast("double")).alias("knn_recall"))


def ann_proxy_recall(queries: DataFrame, train: DataFrame, synth: DataFrame, k: int = 10) -> DataFrame:
    mean = lambda t, name: K.knn(queries, min(k, t.count()), targets=t).groupBy("q").agg(F.avg("d").alias(name))
    ratio = F.least(F.greatest(F.col("f") / (F.col("r") + 1e-8), F.lit(0.0)), F.lit(10.0))
    out = mean(train, "r").join(mean(synth, "f"), "q").agg(F.avg(ratio).alias("ratio"))
    return out.select(F.exp(-F.abs(F.col("ratio") - 1)).alias("ann_proxy_recall"))


def wasserstein(df: DataFrame, levels: int = 512) -> DataFrame:
    """series, dim, w1: for each series but the real one, the mean difference of its quantiles to the real series' at evenly spaced levels, interpolated."""
    q = quantiles(exploded(df, "series"), 0.0, 1 / (levels - 1), levels, "series", "dim")
    real = q.where("series = 'real'").select("dim", "i", F.col("q").alias("r"))
    gaps = q.where("series <> 'real'").join(real, ["dim", "i"]).select("series", "dim", F.abs(F.col("q") - F.col("r")).alias("gap"))
    return gaps.groupBy("series", "dim").agg(F.avg("gap").alias("w1"))


def wasserstein_by_dim(df: DataFrame, levels: int = 512) -> DataFrame:
    """dim, w1 of the series synth against the series real."""
    return wasserstein(df.where(F.col("series").isin("real", "synth")), levels).select("dim", "w1")


def divergences(df: DataFrame, top: int = 16) -> DataFrame:
    """series, dim, w1, ord: the dimensions that differ most from the real series in any other, in one order for all: by the worst of all series, ties by dim."""
    w1 = wasserstein(df)
    order = w1.groupBy("dim").agg(F.max("w1").alias("worst"))  # a row for each dimension
    order = order.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("worst"), "dim")).cast("long")).where(F.col("ord") <= top)
    return w1.join(order, "dim").select("series", "dim", "w1", "ord")


def dimension_divergence(df: DataFrame, top: int = 16) -> DataFrame:
    """dim, w1, ord of the series synth against the series real."""
    return divergences(df.where(F.col("series").isin("real", "synth")), top).drop("series")


def tensor_stats(df: DataFrame) -> dict[str, float]:
    m = _pair(moments(df), "mean", "var", "zero").agg(
        F.sqrt(F.sum(F.pow(F.col("mean_real") - F.col("mean_synth"), 2))).alias("mean_l2"),
        F.sqrt(F.sum(F.pow(F.col("var_real") - F.col("var_synth"), 2))).alias("var_l2"),
        F.avg(F.abs(F.col("zero_real") - F.col("zero_synth"))).alias("per_dim_zero_rate_l1"),
        F.abs(F.avg("zero_real") - F.avg("zero_synth")).alias("zero_fraction_gap"),
    ).first()
    rows = df.select("series", F.aggregate("v", F.lit(0), lambda s, x: s + F.when(x != 0, 1).otherwise(0)).alias("nnz"), F.aggregate("v", F.lit(0), lambda s, x: s + F.when(x < 0, 1).otherwise(0)).alias("neg"), F.size("v").alias("d"))
    s = {r.series: r for r in rows.groupBy("series").agg(F.stddev_pop("nnz").alias("std"), (F.sum("neg") / F.sum("d")).alias("neg")).collect()}
    return m.asDict() | {"cov_fro": covariance_fro(df), "negative_fraction": s["synth"].neg, "nnz_std_gap": abs(s["real"].std - s["synth"].std)}


def pdist(df: DataFrame, most: int | None = None) -> DataFrame:
    """pdist_mean, pdist_min over pairs of different rows (0 with fewer than two), std_mean: the mean deviation of a component."""

    def run(ids, x, block):
        d, pair = K.distances(x, block.v), block.ids[None, :] > ids[:, None]
        return ids[:1], [d[pair].sum()], [pair.sum()], [d[pair].min(initial=np.inf)]

    got = K.blocks(df, K.Targets(df, most=most), run, "q long, s double, n long, low double").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("low").alias("low"))
    std = exploded(df, "vec_id").groupBy("dim").agg(F.stddev_pop("x").alias("std")).agg(F.avg("std").alias("std_mean"))
    some = F.col("n") > 0
    return got.join(std).select(F.when(some, F.col("s") / F.col("n")).otherwise(0.0).alias("pdist_mean"), F.when(some, F.col("low")).otherwise(0.0).alias("pdist_min"), "std_mean")


def log_ratio_profile(knn: DataFrame) -> DataFrame:
    """rk, profile: the mean logarithm of each neighbour's distance over the last, over surviving queries; the last rank is left out."""
    from corpuslens.operators.difficulty import survivors

    ratio = F.greatest(F.least(F.col("d") / F.col("rmax"), F.lit(1.0)), F.lit(1e-12))
    own = survivors(knn).withColumn("k", F.max("rk").over(Window.partitionBy("q"))).where("rk < k")
    return own.groupBy("rk").agg(F.avg(F.ln(ratio)).alias("profile"))


def log_ratio_penalty(real: DataFrame, synth: DataFrame) -> DataFrame:
    both = real.withColumnRenamed("profile", "r").join(synth.withColumnRenamed("profile", "s"), "rk")
    return both.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("s"))), F.lit(0.0)).alias("penalty"))


def ema(values: DataFrame, decay: float = 0.99, piece_rows: int = scans.PIECE_ROWS) -> DataFrame:
    """values(key, step, x) -> key, step, ema: the first value, then decay * before + (1 - decay) * x, in the order of step. A null x changes nothing;
    before the first value the average is null. values is read twice.

    A long key is cut into pieces of steps. What a piece makes of the average that it begins with is a line, x * slope + shift, so a first pass finds
    these lines, they are put together piece by piece, and a second pass folds each piece from where the one before it ends. A piece is
    a stream whose state is one number.
    """
    import pyarrow as pa

    rows = values.select("key", "step", F.col("x").cast("double").alias("x"))
    cut = scans.pieces(rows, ["key"], "step", piece_rows)
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("key", "step")}

    def folded(batches, ends: bool):
        """The average after each row, or what a piece does as a whole: the number of its values, and where it ends from 0 and from nothing."""
        own, now, done = object(), None, []
        for batch in batches:
            keys, parts, x, carried = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "piece", "x", "carried"))
            out = []
            for key, part, value, before in zip(keys, parts, x, carried, strict=True):
                if (key, part) != own:
                    own, now = (key, part), before
                    done.append([key, part, 0, 0.0, None])
                if value is not None:
                    now = value if now is None else now * decay + value * (1 - decay)
                    if ends:
                        last = done[-1]
                        last[2:] = last[2] + 1, last[3] * decay + value * (1 - decay), now
                out.append(now)
            if not ends:
                done.clear()
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("step")), pa.array(out, pa.float64())], ["key", "step", "ema"])
        if ends:
            types = [batch.schema.field("key").type if done else pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], types[i]) for i in range(5)], ["key", "piece", "n", "shift", "fresh"])

    def carried(batches):
        """What each piece begins with; rows of a key in the order of its pieces."""
        own, now = object(), None
        for batch in batches:
            out = []
            for key, n, shift, fresh in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                now = now if key == own else None
                own = key
                out.append(now)
                if n:
                    now = fresh if now is None else now * decay**n + shift
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["key", "piece", "carried"])

    sorted_in = lambda df: df.repartition("key", "piece").sortWithinPartitions("key", "piece", "step")
    ends = sorted_in(cut.withColumn("carried", F.lit(None).cast("double"))).mapInArrow(lambda b: folded(b, True), f"key {kind['key']}, piece int, n long, shift double, fresh double")
    ends = ends.repartition("key").sortWithinPartitions("key", "piece")  # scans.PIECES rows of a key at most
    begins = ends.mapInArrow(carried, f"key {kind['key']}, piece int, carried double").where("carried is not null")
    return sorted_in(scans.join_keys(cut, begins, ["key", "piece"], "left")).mapInArrow(lambda b: folded(b, False), f"key {kind['key']}, step {kind['step']}, ema double")


def ema_bias_correction(decay: float, steps: int) -> float:
    return 1 / (1 - decay**steps) if steps else math.nan
