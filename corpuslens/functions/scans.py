"""Ordered rows of a key in pieces, so that running values of a long key are many tasks' work: each piece by itself, and what comes before it
carried in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece, about; the most pieces of a key; and cuts that are looked up at once.
PIECE_ROWS, PIECES, RUN = 1 << 16, 4096, 64
#: The most bytes of cuts that are broadcast.
CUT_BYTES = 64 << 20


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys in which null is a key like others; the keys are the left ones."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    out = left.join(other, on, how)
    return out if how == "left_semi" else out.drop(*[f"__right_{k}" for k in keys])


def pieces(rows: DataFrame, keys: list[str], order: str, piece_rows: int = PIECE_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the column piece (int): 0, 1, ... in the order of a numeric column, nulls in 0. Rows with the same place in the order are in the same
    piece. sizes(keys..., rows): how many rows a key has, if that is known. Keys of few rows are one piece; the others are cut at approximate
    quantiles. Where a piece begins depends on values only, not on partitions."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if sizes is None else sizes
    large = sizes.where(F.col("rows") > piece_rows)
    facts = large.agg(F.count(F.lit(1)).alias("keys"), F.max("rows").alias("most")).first()
    if not facts.keys:
        return rows.withColumn("piece", F.lit(0))
    n = min(PIECES, -(-facts.most // piece_rows))
    cuts = join_keys(rows, large.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("__cuts"))
    cuts = cuts.withColumn("__heads", F.expr(f"filter(__cuts, (c, i) -> i % {RUN} = {RUN - 1})"))
    cuts = F.broadcast(cuts) if facts.keys * n * 8 <= CUT_BYTES else cuts
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col(order)))
    placed = join_keys(rows, cuts, keys, "left").withColumn("__first", RUN * below(F.col("__heads")))
    piece = F.col("__first") + below(F.slice("__cuts", F.col("__first") + 1, F.lit(RUN)))
    return placed.withColumn("piece", F.when(F.col("__cuts").isNull() | F.col(order).isNull(), 0).otherwise(piece)).drop("__cuts", "__heads", "__first")


def running(rows: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], past: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows with running values: name -> ("sum" or "min", expression), over the key's rows up to this one, or with past=True before it (null for
    the first). Rows of a key need different places in the order. rows is read several times, so it should be cheap or persisted."""
    inner = {n: f"{n}__x" for n in values}
    cut = pieces(rows.withColumns({inner[n]: e for n, (_, e) in values.items()}), keys, order, piece_rows)
    of = {"sum": F.sum, "min": F.min}
    own = Window.partitionBy(*keys, "piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if past else 0)
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*keys, "piece").agg(*[of[kind](inner[n]).alias(f"{n}__w") for n, (kind, _) in values.items()])  # a key has PIECES of these at most
    carried = whole.select(*keys, "piece", *[of[kind](f"{n}__w").over(before).alias(f"{n}__c") for n, (kind, _) in values.items()])
    cut = cut.withColumns({f"{n}__o": of[kind](inner[n]).over(own) for n, (kind, _) in values.items()})

    def both(n: str, kind: str) -> Column:
        a, b = F.col(f"{n}__o"), F.col(f"{n}__c")
        return F.least(a, b) if kind == "min" else F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

    out = join_keys(cut, carried, [*keys, "piece"]).withColumns({n: both(n, kind) for n, (kind, _) in values.items()})
    return out.select(*[c for c in rows.columns if c not in values], *values)
