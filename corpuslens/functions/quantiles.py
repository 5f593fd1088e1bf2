"""Exact quantiles of any number of values, of all rows or of each key, without a task that holds a long key's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import scans

#: Values of a key that one aggregate may hold; longer keys are cut into pieces of about as many.
HELD = 1 << 16


def quantiles(values: DataFrame, first: float, step: float, count: int, *keys: str) -> DataFrame:
    """values(keys..., x) -> keys..., i, q: the quantile at each level first + i * step, i from 0 to count - 1, interpolated between neighbours.
    Nulls are left out; keys without values have no rows. values is read several times.

    Keys of at most HELD values go through Spark's exact percentile. The others are counted by pieces, whose number grows with the key; only
    the pieces in which a wanted rank lies are looked at closer, each by itself, with equal values as one row.
    """
    by = [*keys, "every"]
    own = values.select(*keys, F.lit(0).alias("every"), "x").where(F.col("x").isNotNull())
    sizes = own.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.agg(F.max("rows")).first()[0] or 0
    levels = [min(1.0, max(0.0, first + i * step)) for i in range(count)]
    if most <= HELD:
        held = own.groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, levels))).alias("q"))
        return held.select(*keys, F.posexplode("q").alias("i", "q"))
    pieces = scans.pieces(own, by, "x", HELD, sizes)
    counts = pieces.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("m"))
    past = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = scans.join_keys(counts.withColumn("before", F.coalesce(F.sum("m").over(past), F.lit(0))), sizes.withColumnRenamed("rows", "total"), by)
    # Levels whose places may lie beside these ranks, one more on either side against rounding; the places decide.
    last = F.col("total") - 1
    level = lambda rank: (rank / F.greatest(last, F.lit(1)) - first) / step
    reach = lambda a, b: (F.greatest(F.floor(level(a - 1)) - 1, F.lit(0)), F.least(F.ceil(level(b)) + 1, F.lit(count - 1)))
    low, high = reach(F.col("before"), F.col("before") + F.col("m"))
    wanted = counts.where(low <= high).select(*by, "piece", "before", "total")
    kept = scans.join_keys(pieces, wanted, [*by, "piece"]).groupBy(*by, "piece", "before", "total", "x").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(*by, "piece").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("stop", F.col("start") + F.col("n"))
    low, high = reach(F.col("start"), F.col("stop"))
    near = placed.where(low <= high).select(*keys, "x", "start", "stop", "total", F.explode(F.sequence(low, high)).alias("i"))
    at = F.greatest(F.least((F.lit(first) + F.col("i") * step) * last, last.cast("double")), F.lit(0.0))
    near = near.withColumn("at", at)
    holds = lambda rank: F.max(F.when((rank >= F.col("start")) & (rank < F.col("stop")), F.col("x")))
    got = near.groupBy(*keys, "i").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"), F.first("at").alias("at"))
    return got.select(*keys, F.col("i").cast("int").alias("i"), (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("q"))


def quantile(values: DataFrame, level: float) -> DataFrame:
    """One row: q, null without values."""
    return quantiles(values, level, 1.0, 1).agg(F.max("q").alias("q"))
