"""Near-duplicates by b-bit MinHash signatures and a multi-index Hamming join, with exact confirmation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import graph, shared

#: A signature has SYMBOLS minima of BITS bits each, cut into chunks of CHUNK symbols. Signatures that differ in fewer than
#: 2 * SYMBOLS / CHUNK symbols agree in some chunk but for at most one symbol (pigeonhole), and every chunk is looked up with each
#: of its symbols left out. So all pairs within GUARANTEED share a key, and of those beyond it nearly all: at a Jaccard similarity of
#: just 0.8, a pair in 10**12 shares none. Pairs of a key are compared on full sets if they are within DISTANCE, which 2 pairs in
#: 10**14 at 0.8 are not.
SYMBOLS, BITS, CHUNK = 64, 14, 4
GUARANTEED, DISTANCE = 2 * SYMBOLS // CHUNK - 1, 40
#: Four symbols go into a long, each with a spare bit above it.
LANES = SYMBOLS // 4
#: Parts of the hashes whose shingles are counted, to tell rare from common ones.
RARITY_BITS = 16
ROLL = shared.Rolling(11)
_rng = np.random.default_rng(23)
SCALE = _rng.integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
SHIFT = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's distinct shingles, sorted, end to end; and where each row's begin and end."""
    first, end, at = shared.word_places(data, offsets)
    words = shared.word_hashes(shared.LOWER[data], first, end)
    n = np.diff(at)
    windows = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    total = np.concatenate([[0], np.cumsum(windows)])
    row = np.repeat(np.arange(len(n)), windows)
    begin = np.arange(total[-1]) - total[row] + at[row]
    stop = np.minimum(begin + width, at[row + 1])
    hashes = shared.mix(ROLL.runs(words, begin, stop) + (stop - begin).astype(np.uint64))
    parts, counts = [], np.zeros(len(n) + 1, np.int64)
    for i in range(len(n)):
        own = np.sort(hashes[total[i] : total[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        counts[i + 1] = len(own)
    return np.concatenate(parts) if parts else hashes, np.cumsum(counts)


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols for each set; sets are not empty."""
    x, starts = (hashes >> np.uint64(32)).astype(np.uint32), at[:-1]
    out = np.zeros((len(starts), SYMBOLS), np.int64)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat(x * SCALE[j] + SHIFT[j], starts)
        out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return out


def lookup_keys(signs: np.ndarray) -> np.ndarray:
    """For each signature, the keys of all chunks with one symbol left out; a key tells its chunk and the place left out."""
    wide = signs.reshape(len(signs), -1, CHUNK)
    keys = []
    for out in range(CHUNK):
        rest = [wide[:, :, k] for k in range(CHUNK) if k != out]
        place = (np.arange(wide.shape[1]) * CHUNK + out) << 48
        keys.append(place | rest[0] << 2 * BITS | rest[1] << BITS | rest[2])
    return np.concatenate(keys, 1)


def _describe(width: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in shared.text_chunks(batch):
                hashes, at = shingle_sets(data, offsets, width)
                size = np.diff(at)
                digests = [hashlib.sha256(hashes[at[i] : at[i + 1]]).digest() if size[i] else None for i in range(b - a)]
                full = np.flatnonzero(size)
                signs = np.zeros((b - a, SYMBOLS), np.int64)
                if len(full):
                    signs[full] = signatures(hashes, np.concatenate([at[full], at[-1:]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([None if x is None else s for x, s in zip(digests, packed(signs).tolist(), strict=True)], pa.list_(pa.int64())),
                        pa.array([None if x is None else s for x, s in zip(digests, lookup_keys(signs).tolist(), strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "sign", "keys"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in shared.text_chunks(batch):
                hashes, at = shingle_sets(data, offsets, width)
                sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], ["doc_id", "shingles"])

    return run


def packed(signs: np.ndarray) -> np.ndarray:
    wide = signs.reshape(len(signs), LANES, 4)
    return sum(wide[:, :, k] << (BITS + 1) * k for k in range(4))


def _lanes(x: str, y: str, i: int) -> str:
    """In how many of its four symbols a long of two packed signatures differs: adding all ones to the exclusive or carries into the spare bit of each symbol that is not zero."""
    ones = sum(((1 << BITS) - 1) << (BITS + 1) * k for k in range(4))
    spare = sum(1 << BITS << (BITS + 1) * k for k in range(4))
    return f"bit_count((({x}[{i}] ^ {y}[{i}]) + {ones}L) & {spare}L)"


def _differing(x: str, y: str):
    return F.expr(" + ".join(_lanes(x, y, i) for i in range(LANES)))


def _meets(x: str, y: str):
    """Whether two packed signatures share a key: some chunk, which is one long, differs in one symbol at most."""
    return F.expr(f"least({', '.join(_lanes(x, y, i) for i in range(LANES))}) <= 1")


def _full_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    texts = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")
    return shared.table(texts.mapInArrow(_sets(width), "doc_id long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of doc_ids whose full shingle sets have 100 * intersection >= percent * union."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.select("a", "b", common.alias("n"), (F.size("x") + F.size("y")).cast("long").alias("s")).where(f"100 * n >= {percent} * (s - n)").select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _common(batches):
    """How many shingles fall into each of 2**RARITY_BITS parts of the hashes."""
    n = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        flat = np.asarray(batch.column(1).flatten(), np.int64).view(np.uint64)
        n += np.bincount((flat >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(n))
    full = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(n[full])], ["part", "n"])


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, tokens, lasts: of each set's n shingles in the order of their rarity, as many as can hold the first one in common
    with a set that is similar enough, each with the one before it. Rarity is known by parts of the hashes, a fixed number of counts; any order gives all pairs."""
    counts = sets.mapInArrow(_common, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    known = np.zeros(1 << RARITY_BITS, np.int64)
    known[np.asarray(counts.column("part"))] = np.asarray(counts.column("n"))
    sent = sets.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            own = batch.column(1)
            at, flat = np.asarray(own.offsets), np.asarray(own.values, np.int64)
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                x = flat[a:b]
                order = np.lexsort((x, sent.value[(x.view(np.uint64) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
                out.append(x[order[: len(x) - -(-percent * len(x) // 100) + 1]])
            lasts = [[None, *x[:-1].tolist()] if len(x) else [] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.int64()))], ["doc_id", "n", "tokens", "lasts"])

    return sets.mapInArrow(run, "doc_id long, n long, tokens array<long>, lasts array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, with A-Z lower-cased; a set holds the distinct runs of `width` words, or of all
    words if there are fewer. Documents with 100 * intersection >= percent * union of their sets are linked (percent >= 80);
    component_id is the smallest doc_id that links reach. Null, empty and white texts have no set (n_shingles 0), link with
    nothing and stay. Rows that share a doc_id are one document with several texts: it has the links of each, and every row is
    returned. A row with a null doc_id links with nothing; its component_id and kept are null. Other columns are ignored; an
    empty table gives no rows.

    Equal sets (by SHA-256) become one class. Classes that meet under a key of the signature index are linked to the centre and the
    smallest of that key, which settles most. What is left are keys whose members still lie in several components: their pairs from
    different components, all of them, but without listing a large key's pairs that can't be similar. Of sets that are similar
    enough, the rarest shingles have one in common, so a key is split by these. Every pair shares a key of the index, and every link
    is confirmed on full sets: of 64-bit hashes of shingles, of which two different ones in a pair of sets of 10,000 are equal once in 10**11 pairs,
    whatever the words look like (shared.word_hashes).
    """
    if percent < 80:
        raise ValueError("the signature index is made for similarities of 0.8 and more")
    spark = docs.sparkSession
    shared.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = shared.table(docs.mapInArrow(_describe(width), "doc_id long, n_shingles long, digest binary, sign array<long>, keys array<long>"), "minhash")
    # Only copies need to meet; the rows of a large group of them get its class by a broadcast.
    first = known.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = shared.table(first, "copies")
    own = shared.join_groups(known.where("digest is not null").select("doc_id", "digest"), first, "digest", "left")
    classes = shared.table(own.select("doc_id", F.coalesce("class", "doc_id").alias("class")), "classes")
    whole = classes.groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    several = classes.join(whole.where("class < last").select("doc_id", F.col("class").alias("a")), "doc_id").select("a", F.col("class").alias("b"))
    heads = classes.where("doc_id = class").select("doc_id").distinct()
    facts = known.select("doc_id", "n_shingles", "sign", "keys").join(heads, "doc_id", "left_semi")
    keys = facts.select(F.col("doc_id").alias("b"), F.explode("keys").alias("key"))
    shown = keys.groupBy("key").agg(F.min("b").alias("first"), F.max("b").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("key", "n")
    members = shared.table(keys.join(shown, "key").select("key", "b", "n"), "members")
    # The centre of a key is the member that meets most others: near the text that the others were made from, so it has most links.
    met = members.groupBy("b").agg(F.sum("n").alias("met"))
    rank = F.col("met") * F.lit(1 << 20) + F.pmod(F.xxhash64("b"), F.lit(1 << 20))
    centres = members.join(met, "b").groupBy("key").agg(F.max_by("b", rank).alias("centre"), F.min("b").alias("least"))
    facts = known.select("doc_id", "n_shingles", "sign")

    def within(pairs: DataFrame) -> DataFrame:
        x, y = (facts.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sign").alias(f"s_{k}")) for k in "ab")
        near = pairs.join(x, "a").join(y, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        return near.where(_meets("s_a", "s_b") & (_differing("s_a", "s_b") <= DISTANCE)).select("a", "b")

    tips = members.join(centres, "key").select("b", F.explode(F.array("centre", "least")).alias("a")).where("a <> b")
    stars = shared.table(within(tips.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "stars")
    sets = _full_sets(_ends(stars), docs, width)
    links = shared.table(_confirmed(stars, sets, percent).unionByName(several), "links")
    parts = graph.components(links)
    shared.drop(first, sets, links)
    # What the stars leave: the pairs of keys whose members lie in several components.
    own = members.select("key", "b").join(parts.withColumnRenamed("node", "b"), "b", "left").select("key", "b", F.coalesce("component", "b").alias("c"))
    placed = shared.table(own, "placed")
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    left = shared.table(placed.join(mixed, "key"), "left")
    shared.drop(members, placed)
    sets = _full_sets(left.select(F.col("b").alias("doc_id")).distinct(), docs, width)
    # A key is split by rare shingles: of two similar sets, the first one in common stands early enough in both for the needed number to follow.
    own = left.select(F.col("b").alias("doc_id"), "c").distinct()
    tokens = _prefixes(sets, percent).join(own, "doc_id").select(F.col("doc_id").alias("b"), "c", "n", F.posexplode(F.arrays_zip("tokens", "lasts")).alias("i", "t")).select("*", F.col("t.tokens").alias("token"), F.col("t.lasts").alias("last")).drop("t")
    x, y = tokens.alias("x"), tokens.alias("y")
    enough = F.expr(f"{100 + percent} * least(x.n - x.i, y.n - y.i) >= {percent} * (x.n + y.n)")
    again = F.expr("coalesce(x.last = y.last, false)")  # then the pair comes up there
    rest = x.join(y, ~again & (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & enough)
    rest = rest.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    rest = within(rest)
    rest = shared.table(rest, "rest")
    more = shared.table(_confirmed(rest, sets, percent), "more")
    if not more.isEmpty():
        parts = graph.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    shared.drop(stars, left, sets, rest, more)
    ends = whole.select("doc_id", "class").join(parts.withColumnRenamed("node", "class"), "class", "left").select("doc_id", F.coalesce("component", "class").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(ends, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"), width=4, percent=80)


SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM split WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, other FROM reached JOIN ways ON ways.a = reached.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
