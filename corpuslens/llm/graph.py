"""Connected components by alternating large-star and small-star steps, each a few equi-joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpuslens.llm import shared


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): links in any direction, repeats and loops allowed. Returns (node, component): each node that has a link to
    another, and the smallest node that it reaches. Without such links, no rows."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = None
    path = None
    while True:
        told = Observation()
        after = now if seen is None else _stars(now)
        sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")]
        new = shared.new_path(spark, "stars")
        after.observe(told, *sums).write.parquet(new)
        state = (told.get["n"], told.get["s"])
        now = spark.read.schema("a long, b long").parquet(new)
        if path:
            shared.drop_table(spark, path)
        path = new
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
