"""How the sources of a language differ by the terms they use: vectors of term counts meet in the rounds of a tournament."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Terms of lower-cased UTF-8: runs of ASCII letters and bytes of other characters.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS, BEST, SCALE = 3, 200, 1_000_000_000
#: Counted terms that a worker gathers before it sends them; counts of a block of terms, about; bytes that circulate at once, at least.
GATHERED, BLOCK_ROWS, CIRCULATING = 1 << 19, 1 << 18, 1 << 28


def probabilities(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), by long division, so that no product leaves 64 bits."""
    whole = total + terms
    out, rest = np.divmod(counts.astype(np.int64) + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def meet(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], terms: int) -> tuple[int, int, int]:
    """(places, counts) of two groups in a block -> the sums of both directions over the places that either has, and how many these are."""
    places = np.union1d(a[0], b[0])
    side = []
    for (at, n), total in ((a, totals[0]), (b, totals[1])):
        counts = np.zeros(len(places), np.int64)
        counts[np.searchsorted(places, at)] = n
        side.append(probabilities(counts, total, terms))
    return int(divergence(*side).sum()), int(divergence(*side[::-1]).sum()), len(places)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _places(blob: bytes | None) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), np.uint32), dtype=np.int64) if blob else np.zeros(0, np.int64)


def _numbers(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int64) if blob else np.zeros(0, np.int64)


def _count(batches):
    """(lang, source, term, n, documents) of what a worker has gathered, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, documents) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *[documents[t] for t in terms]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
            n, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            words = TERM.findall(text.lower())
            n.update(words)
            documents.update(set(words))
            size += len(n) - before
            if size >= GATHERED:
                yield from flush()
                size = 0
    yield from flush()
    shared.tidy()


def _vectors(table: pa.Table) -> pa.Table:
    """Of a block of a language's terms, those in enough documents: a row for each source with the places of its terms among them, its counts,
    the language's counts and the terms."""
    terms, own = np.unique(np.array(table.column("term").to_pylist(), object), return_inverse=True)
    n, documents = (np.asarray(table.column(c), np.int64) for c in ("n", "documents"))
    in_documents, whole = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    np.add.at(in_documents, own, documents)
    np.add.at(whole, own, n)
    kept = in_documents >= LEAST_DOCUMENTS
    place = np.cumsum(kept) - 1
    sources = np.array(table.column("source").to_pylist(), object)
    rows = np.flatnonzero(kept[own])
    rows = rows[np.lexsort((own[rows], sources[rows]))]
    starts = np.flatnonzero(np.concatenate([[True], sources[rows][1:] != sources[rows][:-1]])) if len(rows) else []
    out = []
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=False):
        at = rows[a:b]
        text = [terms[i].encode() for i in own[at]]
        sizes = np.array([len(t) for t in text], np.int64)
        out.append((sources[at[0]], int(kept.sum()), int(n[at].sum()), _packed(np.diff(place[own[at]], prepend=0).astype(np.uint32)), _packed(n[at]), _packed(whole[own[at]]), _packed(sizes), zstandard.compress(b"".join(text), 3)))
    lang, block = table.column("lang")[0].as_py(), table.column("block")[0].as_py()
    names, kinds = zip(*[c.split() for c in VECTORS.split(", ")], strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([x[i - 2] if i > 1 else (lang, block)[i] for x in out], arrow[kinds[i]]) for i in range(len(names))], list(names))


VECTORS = "lang string, block long, source string, kept long, total long, places binary, counts binary, whole binary, sizes binary, terms binary"


def _best(batches):
    """The BEST terms of each row, by value and the terms' bytes: a heap of what a block and group has."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            p, q = probabilities(_numbers(r["counts"]), r["own"], r["v"]), probabilities(_numbers(r["whole"]), r["all"], r["v"])
            ends = np.cumsum(_numbers(r["sizes"]))
            text = zstandard.decompress(r["terms"])
            above = np.flatnonzero(p > q)
            value = divergence(p[above], q[above])
            for i in np.argsort(-value, kind="stable")[:BEST]:  # a group's terms stand in the order of their bytes
                k = above[i]
                out.append((r["lang"], r["source"], text[ends[k - 1] if k else 0 : ends[k]].decode(), int(value[i])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])


def _meetings(batches):
    """Both directions of each meeting: a row for each, with the sum and the number of places."""
    names = ("lang", "source", "item", "value", "places")
    for batch in batches:
        rows = batch.to_pylist()
        out, last, own = [], None, None
        for r in rows:
            if last is not (key := (r["counts"], r["places"])) and last != key:
                last, own = key, (_places(r["places"]), _numbers(r["counts"]))
            there, back, n = meet(own, (_places(r["peer_places"]), _numbers(r["peer_counts"])), (r["own"], r["peer_own"]), r["v"]) if r["v"] else (0, 0, 0)
            out += [(r["lang"], r["source"], r["peer"], there, n), (r["lang"], r["peer"], r["source"], back, n)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string() if i < 3 else pa.int64()) for i in range(5)], names)


def _guests(first: int, end: int):
    """Of a seat, the seats that it visits in the rounds from first to end: of two that meet, the smaller one stays in even rounds, the larger in odd ones."""
    last = F.col("seats") - 1

    def host(turn):
        other = F.pmod(turn - F.col("seat"), last)
        other = F.when(F.col("seat") == last, F.pmod(turn * (F.col("seats") / 2).cast("long"), last)).when(other == F.col("seat"), last).otherwise(other)
        stays = F.when(turn % 2 == 0, F.col("seat") < other).otherwise(F.col("seat") > other)
        return F.when((turn < last) & ~stays & (other < F.col("sources")), other)

    return F.filter(F.transform(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long")), host), lambda x: x.isNotNull())


def source_divergence(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source, ...) -> lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. A language keeps the terms in at least 3 of its
    documents (rows); a group, a language's source, gives each p = 1 + floor(10^9 * (count + 1) / (N + V)), N its count of kept terms and V how
    many there are. f(p, q) = floor((p - q)^2 / q), in exact integers. Part `pair`: for each other source of the language (item) the
    sum of f over all kept terms against that source's q, all ranks. Part `term`: the kept terms that the group has and gives more than the
    whole language does, by f against it, the first 200. Equal values rank by the items' UTF-8 bytes.

    Null texts, langs and sources count as empty. Repeated rows are documents like others; doc_ids aren't read. A group without terms takes
    part in pairs, with 0 where the language keeps no term. A language with one source has no pairs. Other columns are ignored; an empty
    table gives no rows.

    A language's terms are dealt into blocks, so that no task holds a group's vector whole. In each block the groups stay in their seats, and
    compressed vectors go round by the rounds of a tournament, in which each two groups meet once and both directions are summed up. Rounds
    circulate together as far as their bytes stay within the vectors' own, or CIRCULATING.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = own.mapInArrow(_count, "lang string, source string, term string, n long, documents long")
    counted = shared.table(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "terms")
    blocks = max(8, shared.row_count(counted) // BLOCK_ROWS)
    groups = counted.where("term is null").select("lang", "source")
    placed = counted.where("term is not null").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    vectors = shared.table(placed.groupBy("lang", "block").applyInArrow(_vectors, VECTORS), "vectors")
    of_lang = vectors.groupBy("lang", "block").agg(F.max("kept").alias("kept"), F.sum("total").alias("total")).groupBy("lang").agg(F.sum("kept").alias("v"), F.sum("total").alias("all"))
    totals = vectors.groupBy("lang", "source").agg(F.sum("total").alias("own"))
    seat = Window.partitionBy("lang")
    seats = groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["own", "v", "all"])
    seats = seats.withColumn("seat", F.row_number().over(seat.orderBy("source")).cast("long") - 1).withColumn("sources", F.count(F.lit(1)).over(seat))
    seats = shared.table(seats.withColumn("seats", F.col("sources") + F.col("sources") % 2), "seats")
    best = vectors.join(seats.select("lang", "source", "own", "v", "all"), ["lang", "source"]).select("lang", "source", "counts", "whole", "sizes", "terms", "own", "v", "all").mapInArrow(_best, "lang string, source string, item string, value long")

    # Every group has a seat in every block, with an empty vector where it has no terms.
    cells = seats.select("lang", "source", "seat", "seats", "sources", "own", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    resident = shared.table(cells.join(vectors.select("lang", "block", "source", "places", "counts"), ["lang", "block", "source"], "left"), "residents")
    size = resident.agg(F.sum(F.coalesce(F.length("places"), F.lit(0)) + F.coalesce(F.length("counts"), F.lit(0)) + 64).alias("b"), F.max("seats").alias("n")).first()
    rounds = max(0, (size.n or 0) - 1)
    together = max(2, 2 * CIRCULATING // max(1, size.b or 0))  # half of the vectors travel in a round
    sums = []
    for turn in range(0, rounds, together):
        peers = resident.withColumn("host", F.explode(_guests(turn, min(rounds, turn + together))))
        peers = peers.select("lang", "block", F.col("host").alias("seat"), F.col("source").alias("peer"), F.col("own").alias("peer_own"), F.col("places").alias("peer_places"), F.col("counts").alias("peer_counts"))
        met = resident.select("lang", "block", "seat", "source", "own", "v", "places", "counts").join(peers, ["lang", "block", "seat"])
        sums.append(shared.table(met.mapInArrow(_meetings, "lang string, source string, item string, value long, places long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("places").alias("places")), "meetings"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST).withColumn("part", F.lit("term")).select(*columns)
    if not sums:
        return terms
    pairs = sums[0]
    for s in sums[1:]:
        pairs = pairs.unionByName(s)
    # Terms that neither group has count by their number.
    of = lambda name, p: seats.select("lang", F.col("source").alias(name), *([F.col("v")] if name == "source" else []), F.expr(f"if(v > 0, 1 + {SCALE} div (own + v), 1)").alias(p))
    rest = F.expr("(v - places) * ((p0 - q0) * (p0 - q0) div q0)")
    pairs = pairs.join(of("source", "p0"), ["lang", "source"]).join(of("item", "q0"), ["lang", "item"]).withColumn("value", F.col("value") + rest)
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(terms)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(shared.read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v))::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)))::HUGEINT AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY ALL) USING (lang) GROUP BY ALL),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200
"""
