"""Removal of globally repeated runs of lines, cut at content-defined boundaries. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: A chunk ends after a line at which the rolling hash of the last two lines is 0 modulo CHUNK_LINES, so its mean length is that.
CHUNK_LINES, STEP = 2, 31


def _apart(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once: a generator of one row, which the optimiser doesn't merge into later expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _line_hash(line):
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunked(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, tag (of the text), lines, ends (the last line of each chunk, from 1)."""
    out = _apart(docs, lines=F.split(F.coalesce("text", F.lit("")), "\n"), tag=F.xxhash64("text"))
    out = _apart(out, hashes=F.transform("lines", _line_hash))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("hashes", F.lit(1), F.size("hashes") - 1))
    rolled = F.zip_with("hashes", before, lambda h, b: F.pmod(h + STEP * b, F.lit(CHUNK_LINES)))
    out = _apart(out, rolled=rolled)
    ends = F.filter(F.transform("rolled", lambda r, i: F.when((r == 0) | (i == F.size("rolled") - 1), i + 1).otherwise(F.lit(0))), lambda e: e > 0)
    return _apart(out, ends=ends).select("id", "tag", "lines", "ends")


def _digest(chunk):
    return F.unhex(F.sha2(chunk, 256))


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk of two lines or more: id, tag, first (from 0), n, chunk, digest."""
    firsts = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    own = F.zip_with(firsts, "ends", lambda a, e: F.struct(a.alias("first"), (e - a).alias("n")))
    out = chunked(docs).select("id", "tag", "lines", F.explode(own).alias("own")).where("own.n > 1")
    out = out.select("id", "tag", "own.*", F.array_join(F.slice("lines", F.col("own.first") + 1, F.col("own.n")), "\n").alias("chunk"))
    return out.withColumn("digest", _digest(F.col("chunk")))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """docs(id, text) -> id, tag, spans: the chunks of a text that occurred before, as (first line, lines), in order."""
    place = F.struct("id", "tag", "first")
    uses = shared.table(_chunks(docs).select("id", "tag", "first", "n", "digest"), "uses").withColumnRenamed("n", "lines")
    # All chunks are compared by their bytes here; a group is one row for each task before the shuffle.
    alike = _chunks(docs).groupBy("digest", "chunk").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("n"))
    groups = alike.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"), F.min("head").alias("head"), F.sum("n").alias("n")).where("n > 1")
    groups = shared.table(groups, "chunk_groups")
    # Where a digest has one kind of bytes, it stands for them.
    again = shared.join_groups(uses, groups.where("kinds = 1").drop("kinds"), "digest").select("id", "tag", "first", "lines", "head")
    rivals = groups.where("kinds > 1").select("digest")
    if not rivals.isEmpty():  # and where it doesn't, the bytes are compared with each use's own
        both = _chunks(docs).join(rivals, "digest", "left_semi").withColumnRenamed("n", "lines")
        again = again.unionByName(both.join(alike.join(rivals, "digest", "left_semi").where("n > 1").drop("n"), ["digest", "chunk"]).select("id", "tag", "first", "lines", "head"))
    later = again.where(place != F.col("head"))
    return later.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("first", F.col("lines").alias("n")))).alias("spans"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs(doc_id, text, ...), with repeated chunks of lines taken out of text, and two more columns:
    lines_before, lines_removed (columns of just these names are replaced, all others stay, whatever they are called).

    A text is cut into chunks of lines at boundaries that depend on two neighbouring lines only, so an insertion moves no later
    boundary. A chunk of two lines or more that occurs with the same bytes in a document of smaller doc_id, or earlier in the
    same document, is removed. Single-line chunks stay. Null texts stay null with 0 lines removed of 1 (as empty texts have one
    empty line); long texts are cut whole. Repeated rows of a doc_id and text count as one and get the same result; several texts of
    one doc_id count as parts of one document, in a fixed order. Rows with a null doc_id come last, as parts of one document too,
    whatever the largest doc_id is, and keep their null. An empty table gives no rows.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shared.id_places(docs).alias("id"), F.xxhash64("text").alias("tag"))
    spans = repeated_chunks(own.select("id", F.col("row.text").alias("text")))
    out = _apart(own.join(spans.hint("shuffle_hash"), ["id", "tag"], "left"), lines=F.split(F.coalesce("row.text", F.lit("")), "\n"))
    gone = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["n"]), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["first"] + s["n"]))
    stops = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size("lines")))
    kept = F.array_join(F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice("lines", a + 1, b - a))), "\n")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(kept).alias("text")
    names = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in names], F.size("lines").cast("long").alias("lines_before"), gone.cast("long").alias("lines_removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "lines_before", "lines_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
hashed AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (
  SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0)) % 2 = 0 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM rolled),
chunks AS (
  SELECT doc_id, k, count(*) AS n, min(i) AS first, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, k),
gone AS (
  SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS r FROM chunks WHERE n > 1) WHERE r > 1),
kept AS (
  SELECT p.doc_id, count(*) AS lines_before, count(*) FILTER (g.k IS NOT NULL) AS lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.k IS NULL), '') AS text
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.k = g.k GROUP BY p.doc_id)
SELECT doc_id, lines_before, lines_removed, sha256(text) AS kept_sha256 FROM kept
"""
