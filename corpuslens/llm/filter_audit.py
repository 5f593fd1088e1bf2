"""How filters overlap: from the counts of their joint failures alone, by inclusion-exclusion."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import shared

FILTERS = "ABCDE"
#: Sets of filters are numbers with a bit for each; so many there are.
SETS = 1 << len(FILTERS)
#: What is counted of the documents that fail all filters of a set.
MEASURES = ("n", "good", "toxic")
#: Words, percent of distinct ones and of capitals, and the characters that filters A to D ask for.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def flags(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, part, digest, A, B, C, D (1: fails), of whole texts; E is decided over all rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    tests = [n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * F.length("text"), F.col("text").rlike(MARKS)]
    return own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[t.cast("long").alias(f) for t, f in zip(tests, FILTERS, strict=False)])


def _members(s: int) -> list[str]:
    return [f for i, f in enumerate(FILTERS) if s >> i & 1]


def joint_failures(failed: DataFrame) -> DataFrame:
    """failed(part, A..E, n, good, toxic) -> part, and of each set of filters and each measure the sum over what fails all of the set:
    joint_<measure>_<set>. The product of the flags of a set tells who does."""
    sums = []
    for s in range(SETS):
        product = F.lit(1)
        for f in _members(s):
            product = product * F.col(f)
        sums += [F.sum(product * F.col(m)).alias(f"joint_{m}_{s}") for m in MEASURES]
    return failed.groupBy("part").agg(*sums)


def _sum(sets: list[int], sign, weight, joint) -> Column:
    """The sum over sets of sign * weight * joint count."""
    return sum((F.lit(sign(s) * weight(s)) * joint(s) for s in sets), F.lit(0))


def survivors(joint, passed: int) -> Column:
    """How many pass all filters of a set: by the signed sum of the joint counts of its subsets."""
    return _sum([s for s in range(SETS) if s & passed == s], lambda s: -1 if s.bit_count() & 1 else 1, lambda s: 1, joint)


def only(joint, i: int) -> Column:
    """How many fail filter i and no other: the Moebius inversion over the sets that hold it."""
    return _sum([s for s in range(SETS) if s >> i & 1], lambda s: 1 if s.bit_count() & 1 else -1, lambda s: 1, joint)


def shapley_over_orders(joint, i: int) -> Column:
    """What filter i removes, summed over all orders: the Harsanyi dividend of a set, its joint count with a sign, goes to its members in equal shares."""
    return _sum([s for s in range(SETS) if s >> i & 1], lambda s: 1 if s.bit_count() & 1 else -1, lambda s: factorial(len(FILTERS)) // s.bit_count(), joint)


def report(joint: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its joint counts."""
    of = {m: (lambda s, m=m: F.col(f"joint_{m}_{s}")) for m in MEASURES}
    by_set = [F.array(*[survivors(of[m], s) for s in range(SETS)]).alias(f"left_{m}") for m in MEASURES]
    by_filter = [F.array(*[f(i) for i in range(len(FILTERS))]).alias(n) for n, f in (("failing", lambda i: of["n"](1 << i)), ("only", lambda i: only(of["n"], i)), ("shares", lambda i: shapley_over_orders(of["n"], i)))]
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "i": i, "before": before, "after": (before := before | 1 << i)})
    kind = "array<struct<filter_order:string,step:int,i:int,before:int,after:int>>"
    out = joint.select("part", *by_set, *by_filter).select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    lost = {m: F.col(f"left_{m}")[F.col("before")] - F.col(f"left_{m}")[F.col("after")] for m in MEASURES}
    own = lambda name: F.col(name)[F.col("i")]
    return out.select(
        "part",
        "filter_order",
        "step",
        F.col("left_n")[F.col("after")].alias("kept"),
        lost["n"].alias("removed"),
        (own("failing") - lost["n"]).alias("redundant"),
        own("only").alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        own("shares").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...), labels(doc_id, quality, toxic, ...) -> a row for each part (lang), order of the five filters and step:
    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A document fails A with fewer than 200 words, B with 100 * distinct words < 50 * words, C with 100 * capitals > 3 * characters, D with
    any of #$%&*|, E if a smaller doc_id of the whole table has the same text. Null texts and parts count as empty ones. Rows that share
    a doc_id and text don't fail E through each other. A null doc_id comes after all others: such a row fails E if a row with a doc_id
    has its text. It has no labels. Of several labels of a doc_id, one that says good (quality 1) or toxic (1) is enough; null labels say nothing. Other
    columns are ignored. Without documents there are no rows; a part has 600.

    Equal texts are told by SHA-256. The smallest doc_id of each digest is a partial aggregate and comes back by (digest, doc_id), a key
    that only equal rows share, which are counted before; so no group of copies meets in one task.
    """
    keys = ["digest", "doc_id", "part", *FILTERS[:4]]
    rows = shared.table(flags(docs).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "flags")
    lead = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).select(F.col("digest").alias("first_digest"), "first_id", F.lit(0).alias("later"))
    same = (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))  # where no row of a digest has a doc_id, all are first
    told = rows.join(lead, same, "left").withColumn("E", F.coalesce("later", F.lit(1)).cast("long"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max((F.coalesce(c, F.lit(0)) == 1).cast("long")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without a doc_id have no labels; they are spread by their digests.
    told = told.withColumn("id", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("named", F.col("doc_id").isNotNull())
    failed = told.join(marks.withColumn("named", F.lit(True)), ["id", "named"], "left")
    failed = failed.select("part", *FILTERS, F.col("rows").alias("n"), *[(F.col("rows") * F.coalesce(m, F.lit(0))).alias(m) for m in MEASURES[1:]])
    return report(joint_failures(failed))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS f
  FROM split LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE length(o) < 5 AND NOT contains(o, l)),
steps AS (SELECT o AS filter_order, s::INT AS step, o[s:s] AS l, o[1:s - 1] AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
hit AS (
  SELECT part, filter_order, step, l, n, good, toxic, f, contains(f, l) AS fails, length(translate(f, before, '')) < length(f) AS earlier FROM steps, counted),
told AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (f = l), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM hit GROUP BY ALL)
SELECT * EXCLUDE l, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley FROM told
"""
