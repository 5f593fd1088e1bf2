"""Near-duplicate vectors by spherical-cap filters with structured random codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import graph, shared

#: Filters of a set that a random vector passes on average, and each vector at least; and vectors that pass a filter: these set the number of
#: directions and the height of the caps from the number of rows, so that candidates grow in proportion to the rows.
PASSED, SHARED, LEAST_CODES = 8, 4, 256
#: Independent sets of directions. Dimensions from which on they are product codes. Radius of the smallest caps, in angles of linked vectors:
#: smaller ones would part them, so in few dimensions, where links themselves grow with the square of the rows, directions are fewer.
SETS, NARROW, WIDTH = 4, 8, 1.5
#: Widest vectors whose cosine is written out term by term, to be compiled.
UNROLLED = 128
#: Products of vectors and codewords that are held at once.
CELLS = 1 << 22
#: Between these, squares of components neither overflow nor vanish; vectors whose largest component lies outside are divided by it.
SMALL, LARGE = 1e-100, 1e100


def cap_height(dim: int, share: float) -> float:
    """The least inner product with a direction of the given share of all unit vectors."""
    if dim == 2:
        return math.cos(math.pi * share)
    t = np.linspace(0, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above / (2 * above[0]), -share)])


def codes(rows: int, dim: int, number: int = 0, cosine: float = 0.98) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A rotation, a code for either half of the rotated space, and the least inner product with a unit vector that passes. A direction
    is a codeword of each half. Below NARROW dimensions the first code holds random directions of the whole space."""
    if dim == 1:
        return np.eye(1), np.array([[1.0], [-1.0]]), np.zeros((1, 0)), 0.5
    n = max(LEAST_CODES, math.ceil(math.sqrt(PASSED * rows / SHARED)))
    highest = math.cos(min(math.pi / 2, WIDTH * math.acos(cosine)))
    while n > 4 and cap_height(dim, min(0.5, PASSED / (n * n))) > highest:
        n = n * 9 // 10
    height = cap_height(dim, min(0.5, PASSED / (n * n)))
    rng = np.random.default_rng([dim, 77, number])
    if dim < NARROW:
        c = rng.standard_normal((n * n, dim))
        return np.eye(dim), c / np.linalg.norm(c, axis=1, keepdims=True), np.zeros((1, 0)), height
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = dim // 2
    words = []
    for size in (half, dim - half):
        c = rng.standard_normal((n, size))
        words.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2))
    return rotation, *words, height


def decode(unit: np.ndarray, rotation: np.ndarray, first: np.ndarray, second: np.ndarray, height: float) -> list[np.ndarray]:
    """For each unit vector, the numbers of all directions that it exceeds the height in, ascending; its PASSED best ones in any case."""
    out, turned, half = [], unit @ rotation.T, first.shape[1]
    step = max(1, CELLS // (len(first) + len(second)))
    products = (xy for k in range(0, len(turned), step) for xy in zip(turned[k : k + step, :half] @ first.T, turned[k : k + step, half:] @ second.T, strict=True))
    for x, y in products:
        order = np.argsort(y)
        ys = y[order]
        best = np.sort((np.partition(x, -min(PASSED, len(x)))[-PASSED:, None] + ys[-PASSED:]).ravel())
        low = min(height, best[-PASSED:][0]) - 1e-9
        left = np.flatnonzero(x >= low - ys[-1])  # no other codeword has a partner
        begin = np.searchsorted(ys, low - x[left], "left")
        out.append(np.sort(np.concatenate([a * len(y) + order[b:] for a, b in zip(left.tolist(), begin.tolist(), strict=True)])))
    return out


def _filters(rows: int, cosine: float):
    def run(batches):
        known: dict[int, list] = {}
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]
            out: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in known:
                    known[dim] = [codes(rows, dim, k, cosine) for k in range(SETS)]
                x = np.array([vectors[i] for i in at])
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                found = [decode(x, *c) for c in known[dim]]
                for i, parts in zip(at, zip(*found, strict=True), strict=True):
                    out[i] = np.concatenate([p + (k << 56) for k, p in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["class", "filters"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """For each row of vectors(vec_id, embedding, label, ...): vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and their cosine, in double precision, is `cosine` or more; a pair is
    found if it shares a filter. Vectors of any finite size are compared alike: where squares would overflow or vanish, both are taken of
    the vector over its largest component. n_links counts the other rows linked directly, copies included; component_id is the smallest
    vec_id that links reach. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. Rows that share a vec_id are one node, each with the links of its own vector; rows with a null
    vec_id link with nothing (n_links 0; component_id and kept null). Other columns are ignored; an empty table gives no rows.

    Equal vectors (by SHA-256 of what they hold) are one class, so copies are never paired. Classes meet under (label, filter), as ids
    only; then each pair is compared once. Work grows with the pairs that share a filter: of vectors in one narrow cone, whose different
    members all pass the same few filters, that is the square of their number.
    """
    spark = vectors.sparkSession
    shared.small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = rows.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0").where(finite & some)
    sound = sound.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))  # -0.0 is 0.0
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    if dict(rows.dtypes)["embedding"] != "array<float>":
        fair = F.transform("embedding", lambda x: F.when(F.col("most").between(SMALL, LARGE), x.cast("double")).otherwise(x.cast("double") / F.col("most")))
        sound = sound.withColumn("most", most).withColumn("fair", fair)
    else:
        sound = sound.withColumn("fair", F.col("embedding"))
    # What is hashed ends with the label, and tells the vector's length by its commas.
    digest = F.unhex(F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>"), F.concat(F.lit("l"), F.col("label").cast("string"))), 256))
    sound = sound.select("vec_id", "label", F.col("fair").alias("embedding"), digest.alias("digest"))
    lean = shared.table(sound.select("vec_id", "digest"), "vector_digests")
    classes = sound.groupBy("digest").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = shared.table(classes.withColumn("class", F.monotonically_increasing_id()), "vector_classes")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    passed = classes.select("class", "embedding").mapInArrow(_filters(facts.n, cosine), "class long, filters array<long>")
    caps = classes.select("class", "label", F.size("embedding").alias("dim")).join(passed, "class")
    caps = shared.table(caps.select("class", "label", "dim", F.explode("filters").alias("filter")), "caps")
    equal = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "dim", "filter")]
    met = caps.alias("x").join(caps.alias("y"), [*equal, F.col("x.class") < F.col("y.class")])
    met = met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    x, y = (classes.select(F.col("class").alias(a), F.struct(F.col("embedding").alias("v"), norm.alias("norm")).alias(v)) for a, v in (("a", "x"), ("b", "y")))
    if facts.n and facts.least == facts.most <= UNROLLED:
        dot = " + ".join(f"cast(x.v[{i}] as double) * cast(y.v[{i}] as double)" for i in range(facts.most))
    else:
        dot = "aggregate(zip_with(x.v, y.v, (a, b) -> cast(a as double) * cast(b as double)), 0D, (s, p) -> s + p)"
    pairs = met.join(y, "b").join(x, "a").where(f"({dot}) / (x.norm * y.norm) >= {cosine!r}D").select("a", "b")
    pairs = shared.table(pairs, "vector_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    small = classes.select("class", "head", "copies")
    links = both.join(small.select(F.col("class").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    heads = small.select("class", "head")
    edges = pairs.join(heads.select(F.col("class").alias("a"), F.col("head").alias("p")), "a").join(heads.select(F.col("class").alias("b"), F.col("head").alias("q")), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    # Rows of one class and rows of one vec_id belong together too.
    own = shared.join_groups(lean, classes.select("digest", "class", "head", "copies", F.col("copies").alias("n")), "digest")
    own = shared.table(own.select("vec_id", "class", "head", "copies"), "vector_rows")
    twice = own.groupBy("vec_id").agg(F.min("head").alias("a"), F.max("head").alias("b")).where("a < b")
    alike = own.join(twice.select("vec_id", "a"), "vec_id").select("a", F.col("head").alias("b"))
    parts = graph.components(edges.unionByName(alike))
    found = own.join(links.withColumnRenamed("a", "class"), "class", "left").join(parts.withColumnRenamed("node", "head"), "head", "left")
    found = found.select("vec_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    # A vec_id may have sound and other rows.
    whole = found.groupBy("vec_id").agg(F.min("component_id").alias("c"))
    rest = rows.where("vec_id is null or label is null or embedding is null or size(embedding) = 0 or not coalesce(forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('inf')), false) or not coalesce(exists(embedding, x -> x <> 0), false)")
    rest = rest.select("vec_id").join(whole, "vec_id", "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_vector_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ways AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT ways.b, other FROM reached JOIN ways ON ways.a = reached.vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reached LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""
