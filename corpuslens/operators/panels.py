"""The rows behind the report's panels: histograms, curves and tables. A panel that doesn't apply is None."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.quantiles import quantile
from corpuslens.functions.vectors import cell_of, exploded, norm
from corpuslens.operators import difficulty, fidelity, sampling, structure
from corpuslens.operators import knn as K


def histogram(values: DataFrame, bins: int, *keys: str) -> DataFrame:
    """values(series, keys..., x) -> series, keys, bin (from 0), lo, hi, density: equal bins over all series (of each key), the last one closed. A single value gets a width of 1e-6."""
    edge = Window.partitionBy(*keys)
    ends = values.groupBy(*keys).agg(F.min("x").alias("a"), F.max("x").alias("b")).withColumn("b", F.when(F.col("b") <= F.col("a"), F.col("a") + 1e-6).otherwise(F.col("b")))
    own = values.join(F.broadcast(ends), list(keys)) if keys else values.join(F.broadcast(ends))  # a row for each key, or one
    bin_ = F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
    n = own.groupBy("series", *keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = n.withColumn("total", F.sum("n").over(Window.partitionBy("series", *keys)))
    full = full.join(F.broadcast(ends), list(keys)) if keys else full.join(F.broadcast(ends))
    width = (F.col("b") - F.col("a")) / bins
    lo = F.col("a") + F.col("bin") * width
    return full.select("series", *keys, "bin", lo.alias("lo"), (lo + width).alias("hi"), (F.col("n") / F.col("total") / width).alias("density"))


def values(df: DataFrame) -> DataFrame:
    return exploded(df, "series").select("series", "x")


def dim_marginals(df: DataFrame, bins: int) -> DataFrame:
    return histogram(exploded(df, "series"), bins, "dim")


def dim_profiles(df: DataFrame) -> DataFrame:
    return fidelity.moments(df).select("series", "dim", "mean", "std", F.col("zero").alias("zero_fraction"))


def norms(df: DataFrame) -> DataFrame:
    return df.select("series", norm(F.col("v")).alias("x"))


def by_series(df: DataFrame, fn: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """series, x: fn's column for each series."""
    out = None
    for s in sorted(r.series for r in df.select("series").distinct().collect()):
        own = fn(df.where(F.col("series") == s)).select(F.lit(s).alias("series"), F.col(column).cast("double").alias("x"))
        out = own if out is None else out.unionByName(own)
    return out


def pairwise(df: DataFrame, pairs: int, seed) -> DataFrame:
    return by_series(df, lambda s: structure.pair_values(s, pairs, seed, structure.distance), "x")


def kth_distance(df: DataFrame, k: int) -> DataFrame:
    return by_series(df, lambda s: K.knn(s, k).groupBy("q").agg(F.max("d").alias("d")), "d")


def lids(df: DataFrame, k: int) -> DataFrame:
    return by_series(df, lambda s: difficulty.lid(K.knn(s, k)), "lid")


def contrasts(df: DataFrame, k: int, seed) -> DataFrame:
    return by_series(df, lambda s: difficulty.relative_contrast(s, K.knn(s, k), seed, difficulty.CONTRAST_TARGETS), "contrast")


def hubness(df: DataFrame, k_hub: int) -> DataFrame:
    return by_series(df, lambda s: difficulty.k_occurrence(s, K.knn(s, k_hub), k_hub), "n")


def distance_cdf(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """i (from 1), y, q10, q50, q90: for each rank, quantiles over queries of the distance of that rank; a target that is the query is left out."""
    n = targets.count()
    near = K.knn(queries, n, targets=targets)
    near = near.where("q <> t").withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy("d", "t")))
    least = near.groupBy("q").agg(F.max("i").alias("m")).agg(F.min("m").alias("m"))
    q = F.percentile("d", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = near.join(F.broadcast(least)).where("i <= m").groupBy("i", "m").agg(q.alias("q"))
    return out.select(F.col("i").cast("long").alias("i"), (F.col("i") / F.col("m")).alias("y"), F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"))


def glyph_cells(df: DataFrame) -> DataFrame:
    row, col, bin_ = cell_of(F.col("dim"))
    return exploded(df, "vec_id").select("vec_id", "dim", row.alias("row"), col.alias("col"), bin_.alias("bin"), "x")


def glyph_scale(df: DataFrame) -> DataFrame:
    """scale: 1 over the 99th percentile of absolute values that aren't zero; 0 if there are none."""
    p = quantile(exploded(df, "vec_id").where("x <> 0").select(F.abs("x").alias("x")), 0.99)
    return p.select(F.coalesce(F.lit(1.0) / F.col("q"), F.lit(0.0)).alias("scale"))


def glyph_rays(df: DataFrame, scale: float, pitch: float = 1.0) -> DataFrame:
    """A ray for each component that isn't zero, from its cell's centre in its bin's direction. Negative ones are at least 0.35 long."""
    cells = glyph_cells(df).where(F.col("x") != 0).where(F.lit(scale) > 0)
    size = F.least(F.abs("x") * scale, F.lit(1.0))
    length = F.when(F.col("x") < 0, F.greatest(size, F.lit(0.35))).otherwise(size) * pitch / 2
    angle = F.col("bin") * F.radians(F.lit(45.0))
    x0, y0 = F.col("col") * pitch, -F.col("row") * pitch
    return cells.select("vec_id", "dim", (F.col("x") < 0).alias("negative"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + length * F.cos(angle)).alias("x1"), (y0 + length * F.sin(angle)).alias("y1"))


def pca_spectrum(df: DataFrame) -> DataFrame:
    rows = []
    for s, v in structure.eigenvalues(df, True, 1).items():
        share, total = v / v.sum(), 0.0
        for i, x in enumerate(share):
            total += float(x)
            rows.append((s, i + 1, float(x), total))
    return df.sparkSession.createDataFrame(rows, "series string, comp int, ratio double, cum double")


def scatter(df: DataFrame) -> DataFrame:
    """vec_id, series, x, y: rows on the two leading directions of all series together. A direction's largest component is positive."""
    c, mean, _ = fidelity.covariances(df.select(F.lit("x").alias("series"), "v"))["x"]
    axes = np.linalg.eigh(c)[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    on = lambda k: F.aggregate(F.zip_with("v", F.array(*map(F.lit, axes[:, k].tolist())), lambda a, b: a * b), F.lit(float(-(mean @ axes[:, k]))), lambda s, x: s + x)
    return df.select("vec_id", "series", on(0).alias("x"), (on(1) if axes.shape[1] > 1 else F.lit(0.0)).alias("y"))


def steady_histogram(values: DataFrame, bins: int, span: float = 1e-6) -> DataFrame:
    """histogram() of values(series, x), but one bin where all values of a series lie as close as rounding lets them: within `span` of their size.
    Values that are no finite numbers are an error."""
    ends = values.groupBy("series").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("off")).collect()  # a row for each series
    if bad := [r.series for r in ends if r.off]:
        raise ValueError(f"values of {', '.join(sorted(bad))} are not finite")
    out = None
    for r in sorted(ends, key=lambda r: r.series):
        own = values.where(F.col("series") == r.series)
        if r.b - r.a <= span * max(abs(r.a), abs(r.b), 1.0):
            own = own.limit(1).select("series", F.lit(0).alias("bin"), F.lit(r.a).alias("lo"), F.lit(r.b).alias("hi"), F.lit(1.0).alias("density"))
        else:
            own = histogram(own, bins)
        out = own if out is None else out.unionByName(own)
    return out


def lorenz(df: DataFrame, nlist: int, seed) -> DataFrame:
    """series, i, share_cells, share_points: how points are spread over cells."""
    out = None
    for s in sorted(r.series for r in df.select("series").distinct().collect()):
        own = difficulty.lorenz(difficulty.ivf_occupancy(df.where(F.col("series") == s), nlist, seed)).select(F.lit(s).alias("series"), "*")
        out = own if out is None else out.unionByName(own)
    return out


def condition_note(conditions: DataFrame) -> DataFrame:
    """conditions(series, n, k, nlist) -> note: one sentence if all series were measured alike, else one for each."""
    text = F.concat_ws(", ", F.concat(F.lit("n="), "n"), F.concat(F.lit("k="), "k"), F.concat(F.lit("nlist="), "nlist"))
    g = conditions.groupBy().agg(F.min(text).alias("a"), F.max(text).alias("b"), F.array_sort(F.collect_list(F.concat_ws(": ", "series", text))).alias("each"))
    return g.select(F.when(F.col("a") == F.col("b"), F.concat(F.lit("All series: "), "a")).otherwise(F.array_join("each", "; ")).alias("note"))


def discarded_note(stats: list[dict]) -> str:
    """The series of which no query is left, and why; empty if there is none. stats: name, ann_k, ann_measured_rows, lid_discarded_queries of each."""
    gone = [s for s in stats if s["ann_measured_rows"] and s["lid_discarded_queries"] == s["ann_measured_rows"]]
    why = lambda s: "with k=1 the nearest neighbour is the farthest too" if s["ann_k"] < 2 else "every query has an exact copy, or neighbours that tie"
    return f"No queries are left of {'; '.join(f'{s['name']} ({why(s)})' for s in gone)}." if gone else ""


def format_stat(x) -> str:
    if x is None:
        return "n/a"
    return str(x) if isinstance(x, int) else f"{x:.6g}"


@dataclass
class Config:
    """The report's settings."""

    k: int = 100
    k_hub: int = 10
    rows: int = 20_000
    nlist: int = 256
    knn: int = 5
    knn_rows: int = 20_000
    pairs: int = 200_000
    bins: int = 80
    top: int = 16
    max_dim: int = 256
    seed: int = 42
    preprocess: str = "l2"
    glyphs: int = 8


@dataclass
class Context:
    df: DataFrame
    config: Config = field(default_factory=Config)
    _measured: DataFrame | None = None

    def width(self) -> int:
        return self.df.select(F.size("v").alias("d")).first().d

    def sampled(self, rows: int) -> DataFrame:
        """So many rows of each series at most."""
        out = None
        for s in sorted(r.series for r in self.df.select("series").distinct().collect()):
            own = sampling.sample(self.df.where(F.col("series") == s), rows, self.config.seed)
            out = own if out is None else out.unionByName(own)
        return out

    def measured(self) -> DataFrame:
        """The rows that the statistics are taken of: config.rows of each series at most, the same for all panels."""
        if self._measured is None:
            self._measured = self.sampled(self.config.rows)
        return self._measured


def _wide(c: Context) -> bool:
    return c.width() > c.config.max_dim


def _rays(c: Context) -> DataFrame | None:
    """Drawings of a few rows of each series; only 128-wide rows have the layout."""
    if c.width() != 128:
        return None
    rows = sampling.glyph_rows(c.df, c.config.glyphs, c.config.seed)
    if rows is None:
        return None
    own = c.df.join(F.broadcast(rows), ["vec_id", "series"]).withColumn("key", F.concat_ws(":", "part", "vec_id"))  # a few rows
    scale = glyph_scale(own).first().scale
    return glyph_rays(own.select(F.col("key").alias("vec_id"), "v"), scale)


#: name -> the panel's rows, or None if it doesn't apply. A new entry adds a panel.
PANELS: dict[str, Callable[[Context], DataFrame | None]] = {
    "lid": lambda c: histogram(lids(c.measured(), c.config.k), c.config.bins),
    "contrast": lambda c: histogram(contrasts(c.measured(), c.config.k, c.config.seed), c.config.bins),
    "hubness": lambda c: histogram(hubness(c.measured(), c.config.k_hub), c.config.bins),
    "ivf": lambda c: lorenz(c.measured(), c.config.nlist, c.config.seed),
    "glyphs": _rays,
    "scatter": lambda c: scatter(c.measured()),
    "values": lambda c: histogram(values(c.df), c.config.bins),
    "marginals": lambda c: None if _wide(c) else dim_marginals(c.df, c.config.bins),
    "profiles": lambda c: dim_profiles(c.df),
    "pairwise": lambda c: histogram(pairwise(c.df, c.config.pairs, c.config.seed), c.config.bins),
    "knn": lambda c: histogram(kth_distance(c.sampled(c.config.knn_rows), c.config.knn), c.config.bins),
    "norms": lambda c: histogram(norms(c.df), c.config.bins) if c.config.preprocess == "none" else None,
    "pca": lambda c: pca_spectrum(c.df),
    "correlation": lambda c: None if _wide(c) else structure.correlation(c.df),
    "mismatch": lambda c: fidelity.divergences(c.df, c.config.top) if c.df.select("series").distinct().count() > 1 else None,
}


def report(context: Context) -> dict[str, DataFrame]:
    """All panels that apply, none of them computed yet."""
    built = {name: build(context) for name, build in PANELS.items()}
    return {name: rows for name, rows in built.items() if rows is not None}
