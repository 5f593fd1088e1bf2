"""Sampling by portable hashes: any engine with MD5 draws the same rows, whatever the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _key(seed, name: str = "vec_id"):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(name).cast("string")))


def ranked(df: DataFrame, seed, key: str = "vec_id") -> DataFrame:
    """df(key) -> key, rn from 1: a permutation by hash. Rows are numbered within the 4096 blocks of hashes that begin alike, and a
    block's offset is the count of those before it; so no task sorts more than its blocks."""
    ids = df.select(key, _key(seed, key).alias("__h")).withColumn("__b", F.substring("__h", 1, 3))
    counts = sorted((r["__b"], r["n"]) for r in ids.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each block
    base, offsets = 0, []
    for b, n in counts:
        offsets.append((b, base))
        base += n
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "__b string, __base long"))
    own = Window.partitionBy("__b").orderBy("__h", key)
    return ids.withColumn("__i", F.row_number().over(own)).join(before, "__b").select(key, (F.col("__base") + F.col("__i")).cast("long").alias("rn"))


def sample(df: DataFrame, rows: int, seed, key: str = "vec_id") -> DataFrame:
    """At most `rows` rows without replacement (all if rows <= 0): the ids with the least hashes, then a semi-join back to the rows."""
    if rows <= 0:
        return df
    ids = df.select(key).orderBy(_key(seed, key), key).limit(rows)
    return df.join(ids, key, "left_semi")


def holdout_split(df: DataFrame, fraction: float, seed, key: str = "vec_id") -> DataFrame:
    """df with is_holdout: max(1, round half even of n * fraction) rows. An empty training part is an error."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    n = df.count()
    held = max(1, round(n * fraction))
    if held >= n:
        raise ValueError(f"{n} rows leave no training part")
    ids = df.select(key).orderBy(_key(seed, key), key).limit(held).withColumn("is_holdout", F.lit(True))
    return df.join(ids, key, "left").withColumn("is_holdout", F.coalesce("is_holdout", F.lit(False)))


def disjoint_draws(df: DataFrame, draws: int, rows: int, seed, key: str = "vec_id") -> DataFrame:
    """df's rows of `draws` samples that share none: column draw from 0. Too few rows are an error."""
    if (n := df.count()) < draws * rows:
        raise ValueError(f"{draws} draws of {rows} rows need {draws * rows} rows; there are {n}")
    ids = ranked(df, seed, key).where(F.col("rn") <= draws * rows).select(key, F.expr(f"cast((rn - 1) div {rows} as int)").alias("draw"))
    return df.join(ids, key)


def random_pairs(df: DataFrame, pairs: int, seed, key: str = "vec_id") -> DataFrame:
    """pair, a, b: pairs of ids with replacement, of different rows. Numbers follow the order of the keys' hashes."""
    n = df.count()
    spark = df.sparkSession
    number = lambda side: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(side), F.col("pair").cast("string"))), 1, 12), 16, 10).cast("long") % n
    drawn = spark.range(pairs).select(F.col("id").alias("pair")).select("pair", number("a").alias("i"), number("b").alias("j")).where("i <> j")
    own = ranked(df, seed, key).select(key, (F.col("rn") - 1).alias("r"))
    left = own.select(F.col("r").alias("i"), F.col(key).alias("a"))
    right = own.select(F.col("r").alias("j"), F.col(key).alias("b"))
    return drawn.join(left, "i").join(right, "j").select("pair", "a", "b")


def variant_seed(base: int, name: str) -> int:
    """A stable seed of a name: the base plus the first four bytes of its SHA-256, modulo 2**31."""
    return (base + int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")) % (1 << 31)


def variant_seeds(df: DataFrame, base: int, column: str = "name") -> DataFrame:
    head = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn("seed", (F.lit(base).cast("long") + head) % F.lit(1 << 31))


def shuffled_batches(spark: SparkSession, df: DataFrame, size: int, epoch: int, seed, key: str = "vec_id") -> DataFrame:
    """key, batch: a new order for each epoch, whole batches only."""
    n = df.count()
    return ranked(df, f"{seed}:{epoch}", key).where(F.col("rn") <= n // size * size).select(key, F.expr(f"cast((rn - 1) div {size} as long)").alias("batch"))


def glyph_rows(df: DataFrame, rows: int, seed, key: str = "vec_id") -> DataFrame | None:
    """For a drawing: two samples of the real series that share no row, and one of each other series; column part tells them apart. None unless
    all series have enough rows."""
    names = sorted(r.series for r in df.select("series").distinct().collect())
    counts = {r.series: r["count"] for r in df.groupBy("series").count().collect()}
    if counts.get("real", 0) < 2 * rows or any(counts[s] < rows for s in names):
        return None
    first = disjoint_draws(df.where("series = 'real'"), 2, rows, seed, key)
    out = first.select(key, "series", F.concat(F.lit("real_"), "draw").alias("part"))
    for s in names:
        if s != "real":
            out = out.unionByName(sample(df.where(F.col("series") == s), rows, seed, key).select(key, "series", F.col("series").alias("part")))
    return out
