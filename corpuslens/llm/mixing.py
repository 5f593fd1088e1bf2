"""Mixing sources to target weights by temperature. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Sections of an interval that one pass tells apart (a pass is six bisections), and passes.
SECTIONS, PASSES = 64, 7
#: Hex digits of a document's hash that name its block, and bits of its text's hash that name its part among the rows of one hash.
BLOCK_DIGITS, PART_BITS = 3, 12
ADDED = ("mix_tokens", "mix_weight", "mix_block", "mix_copies")


@dataclass
class Mixture:
    """exponent: of the token shares. norm: the sum of the shares' powers. budget: tokens in all. sources: source, tokens of each."""

    exponent: float
    norm: float
    budget: float
    total: int
    sources: DataFrame


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def solve(sources: DataFrame, entropy: float, repetition: float, budget: float | None) -> Mixture:
    """sources(source, tokens), tokens > 0. The largest exponent in [0, 1] whose weights have at least `entropy` times the
    logarithm of the number of sources as entropy, or, if larger, the smallest that repeats no source more than `repetition`
    times. Without a budget, the least one that passes every source once. Only sums over sources come to the driver."""
    seen = sources.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not seen.n:
        return Mixture(1.0, 1.0, budget or 0.0, 0, sources)
    target, least, most = entropy * math.log(seen.n), seen.least / seen.t, seen.most / seen.t
    share = F.col("tokens") / F.lit(float(seen.t))

    def norms(grid: list[float]) -> dict[float, tuple[float, float]]:
        """The entropy and the norm of each exponent."""
        power = F.pow(share, F.col("e"))
        rows = sources.withColumn("e", F.explode(F.array(*map(F.lit, grid)))).groupBy("e").agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("l")).collect()
        return {r.e: (math.log(r.z) - r.e * r.l / r.z, r.z) for r in rows}

    def repeats(e: float, z: float) -> float:
        return (most / least) ** (1 - e) if budget is None else budget * least**e / z / (least * seen.t)

    def mixed_enough(e, h, z):
        return h >= target - 1e-12

    def repeats_too_much(e, h, z):
        return repeats(e, z) > repetition * (1 + 1e-12)

    spans = {mixed_enough: (0.0, 1.0), repeats_too_much: (0.0, 1.0)}
    for _ in range(PASSES):  # both tests hold up to some exponent
        grids = {test: [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)] for test, (lo, hi) in spans.items()}
        got = norms(sorted({x for g in grids.values() for x in g}))
        for test, grid in grids.items():
            last = max((i for i, x in enumerate(grid) if test(x, *got[x])), default=-1)
            spans[test] = (grid[last], grid[min(last + 1, SECTIONS)]) if last >= 0 else (grid[0], grid[0])
    found = [spans[mixed_enough][0], spans[repeats_too_much][1]]
    exponent = max(found)
    norm = norms([exponent])[exponent][1]
    return Mixture(exponent, norm, seen.t * norm * most ** (1 - exponent) if budget is None else budget, seen.t, sources)


def _mixed(docs: DataFrame, entropy: float, repetition: float, budget: float | None, seed: int) -> DataFrame:
    """row (all columns of docs), and the columns of ADDED."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tag = F.xxhash64("text")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), tag.cast("string")))  # rows without a doc_id stand by their texts
    own = docs.select(row.alias("row"), word_count(F.col("text")).alias("tokens"), F.coalesce("source", F.lit("")).alias("source"), F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("hash"), tag.alias("tag"))
    own = own.withColumn("mix_block", F.substring("hash", 1, BLOCK_DIGITS))
    lean = shared.table(own.drop("row"), "lean")
    blocks = shared.table(lean.groupBy("source", "mix_block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = shared.table(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "sources")
    found = solve(sources, entropy, repetition, budget)
    weight = F.pow(F.col("tokens") / F.lit(float(found.total or 1)), F.lit(found.exponent)) / F.lit(found.norm)
    plan = sources.select("source", F.col("tokens").alias("whole_tokens"), weight.alias("mix_weight"), F.round(weight * F.lit(found.budget)).cast("long").alias("share"))
    plan = plan.withColumn("whole", F.expr("share div whole_tokens")).withColumn("rest", F.expr("share % whole_tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("mix_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = blocks.withColumn("before", before).join(plan, "source")  # a source has 4096 blocks at most
    cut = cut.withColumn("state", F.when(F.col("before") >= F.col("rest"), 0).when(F.col("before") + F.col("tokens") < F.col("rest"), 1).otherwise(2))
    # Where the budget ends within a block: the last place whose rows begin before its end, and how many of its equal rows do.
    edge = lean.join(cut.where("state = 2").select("source", "mix_block", "before", "rest"), ["source", "mix_block"])
    edge = edge.groupBy("source", "hash", "tag", "tokens", "before", "rest").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.shiftright("tag", 64 - PART_BITS))
    # First the part of a hash in which it ends, as one doc_id may have most rows; then the place in it.
    past = lambda *by: Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = edge.groupBy("source", "hash", "part").agg(F.sum(F.col("tokens") * F.col("n")).alias("m"), F.max(F.col("rest") - F.col("before")).alias("open"))
    parts = parts.withColumn("open", F.col("open") - F.coalesce(F.sum("m").over(past("hash", "part")), F.lit(0))).where("open > 0")
    last = parts.groupBy("source").agg(F.max(F.struct("hash", "part", "open")).alias("last")).select("source", "last.*")
    edge = edge.join(last, ["source", "hash", "part"])
    left = F.col("open") - F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(past("hash", "tag", "tokens")), F.lit(0))
    fit = F.when(F.col("tokens") == 0, F.col("n")).otherwise(F.least("n", F.ceil(F.col("left") / F.nullif("tokens", F.lit(0)))))
    ends = edge.withColumn("left", left).where("left > 0").groupBy("source").agg(F.max(F.struct("hash", "tag", "tokens", fit.alias("fit"), "n")).alias("end"))
    ends = shared.table(ends, "ends")
    verdict = cut.join(ends, "source", "left").select("source", "mix_block", "mix_weight", "whole", "state", "end")
    out = own.join(verdict, ["source", "mix_block"], "left")
    place, end = F.struct("hash", "tag", "tokens"), F.struct("end.hash", "end.tag", "end.tokens")
    at_end = F.coalesce((F.col("state") == 2) & (place == end) & (F.col("end.fit") < F.col("end.n")), F.lit(False))
    taken = F.coalesce((F.col("state") == 1) | ((F.col("state") == 2) & (place <= end)), F.lit(False))
    if ends.where("end.fit < end.n").isEmpty():
        out = out.withColumn("taken", taken)
    else:
        out = out.where(~at_end).withColumn("taken", taken).unionByName(_first_of_equals(out.where(at_end)))
    copies = F.when(F.col("mix_weight").isNull(), F.lit(1)).otherwise(F.col("whole") + F.col("taken").cast("long")).cast("long")
    return out.select("row", F.col("tokens").alias("mix_tokens"), F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"), "mix_block", copies.alias("mix_copies"))


def _first_of_equals(tied: DataFrame) -> DataFrame:
    """Rows of each source that nothing tells apart, of which only end.fit are taken: numbered by written partitions, none of which goes to one task with another."""
    tied = shared.table(tied.withColumn("number", F.monotonically_increasing_id()), "tied").withColumn("part", F.shiftright("number", 33))
    sizes = tied.groupBy("source", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.join(sizes.select("source", "part", before.alias("earlier")), ["source", "part"])
    turn = F.col("earlier") + F.row_number().over(Window.partitionBy("source", "part").orderBy("number"))
    return tied.withColumn("taken", turn <= F.col("end.fit")).drop("number", "part", "earlier")


def mixture(docs: DataFrame, entropy: float = 0.998, repetition: float = 1.5, budget: float | None = None, seed: int = 17) -> DataFrame:
    """All rows and columns of docs(doc_id, text, source, ...), with the columns mix_tokens, mix_weight, mix_block and mix_copies; columns of
    just these four names are replaced, all others stay, whatever they are called.

    A source's weight is its share of all words to the power of an exponent in [0, 1], over their sum; solve() finds the
    exponent. Its budget is that weight of all tokens, rounded. Its documents stand in the order of a seeded hash of doc_id, cut into
    blocks by the hash's first digits: each passes as often as the budget covers the source whole, and once more if it begins
    before what is left of the budget is used up. mix_copies says how often. Without a budget, every document passes at least once.

    Rows of one doc_id stand in the order of their texts' hashes, and those without one where a hash of that puts them. Each row counts and
    is decided by itself: of equal rows at the end of the budget, just as many pass as begin before it. A null source is the source
    "". Null and empty texts have no words and pass with their place in the order; long ones count whole. Sources without any
    words have no weight (0), and their documents pass once. An empty table gives no rows. No task gets more in one window than the hashes of one
    block in 4096 of a source with 4096 parts of each, or the rows of one such part, equal rows as one.
    """
    names = [F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED]
    return _mixed(docs, entropy, repetition, budget, seed).select(*names, *ADDED)


def realised(docs: DataFrame, entropy: float = 0.998, repetition: float = 1.5, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs as often as mixture() says, with docs' columns only."""
    out = _mixed(docs, entropy, repetition, budget, seed).where("mix_copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select("row.*")


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixture(docs).select("doc_id", "source", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_block", "mix_copies")


SQL = r"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
sources AS (SELECT s, sum(tokens)::BIGINT AS t FROM own GROUP BY s HAVING sum(tokens) > 0),
facts AS (SELECT sum(t)::DOUBLE AS total, count(*) AS n, min(t)::DOUBLE AS least, max(t)::DOUBLE AS most FROM sources),
steps(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, if(h >= 0.998 * ln(n) - 1e-12, m, lo), if(h >= 0.998 * ln(n) - 1e-12, hi, m)
  FROM (SELECT k, lo, hi, m, (SELECT n FROM facts) AS n,
               (SELECT ln(sum(pow(t / total, m))) - m * sum(pow(t / total, m) * ln(t / total)) / sum(pow(t / total, m)) FROM sources, facts) AS h
        FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m FROM steps WHERE k < 45))),
mixed AS (
  SELECT CASE WHEN (SELECT -sum(t / total * ln(t / total)) >= 0.998 * ln(any_value(n)) - 1e-12 FROM sources, facts) THEN 1.0
              ELSE (SELECT lo FROM steps WHERE k = 45) END AS e),
limits AS (SELECT CASE WHEN most = least THEN 0.0 ELSE greatest(0.0, 1 - ln(1.5) / ln(most / least)) END AS e FROM facts),
solved AS (SELECT greatest(mixed.e, limits.e) AS e FROM mixed, limits),
norm AS (SELECT sum(pow(t / total, e)) AS z FROM sources, facts, solved),
plan AS (
  SELECT s, t, pow(t / total, e) / z AS w,
         round(pow(t / total, e) / z * (total * z * pow(most / total, 1 - e)))::BIGINT AS budget
  FROM sources, facts, solved, norm),
placed AS (
  SELECT own.*, w, budget // t AS whole, budget % t AS rest,
         coalesce(sum(tokens) OVER (PARTITION BY own.s ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM own LEFT JOIN plan ON own.s = plan.s)
SELECT doc_id, source, tokens AS mix_tokens, round(coalesce(w, 0), 9) AS mix_weight, substr(h, 1, 3) AS mix_block,
       CASE WHEN w IS NULL THEN 1 ELSE whole + (start < rest)::BIGINT END AS mix_copies
FROM placed
"""
