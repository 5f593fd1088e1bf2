"""Exact deduplication with the frequent digests taken out of the shuffle."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Counters of a Misra-Gries summary, and digests that may be broadcast: at most so many rows of a digest, a count and an id.
COUNTERS = 512


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _summaries(counters: int):
    def run(batches):
        kept: Counter = Counter()
        for batch in batches:
            for digest, n in Counter(batch.column(0).to_pylist()).items():
                kept[digest] += n
            if len(kept) > counters:  # take from all what the first counter beyond the limit has
                least = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({d: n - least for d, n in kept.items() if n > least})
        rows = list(kept.items())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["digest", "n"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digests(digest binary, ...): at most `counters` candidates (digest), by Misra-Gries summaries of each partition, which are
    summed and cut again. Each partition's summary holds every digest of more than 1/counters of its rows."""
    sums = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    return sums.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """For each row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of white space became one space; null counts as empty, so null and ""
    are one group. The smallest doc_id of a group stays. Rows that share a doc_id are all counted and all returned. A null
    doc_id sorts last: it stays only in a group of such rows, whose keep_id and kept are null. Other columns are ignored; an
    empty table gives no rows.
    """
    shared.small_batches(docs.sparkSession)
    digests = shared.table(docs.select("doc_id", F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("digest")), "digests")
    candidates = F.broadcast(frequent(digests, counters))  # at most `counters` rows
    winners = digests.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = shared.table(winners, "winners")  # of each candidate, counted over all rows
    hot = digests.join(F.broadcast(winners), "digest")
    own = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("digest", "doc_id", F.min("doc_id").over(own).alias("keep_id"), F.count(F.lit(1)).over(own).alias("group_size"))
    both = hot.select(*rest.columns).unionByName(rest)
    return both.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(shared.read(spark, sf_dir, "documents"))


SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
