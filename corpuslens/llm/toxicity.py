"""Toxicity scores: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Lengths of n-grams, bits of a feature's number, and the most labelled documents that a model is fitted on (of those there are, and half of
#: them of either label if there are so many; those with the least hash of doc_id).
LENGTHS, BITS, MAX_ROWS = (4, 6, 8), 20, 6000
#: Rows in which a feature must occur, smoothing of counts, weight of the L2 penalty, steps and rate of the descent.
LEAST_ROWS, SMOOTH, PENALTY, STEPS, RATE = 8, 1.0, 1e-5, 80, 0.1
#: Features with weights: those whose ratio is largest against its chance spread. One row in so many sets only the scale and bias of scores.
KEPT, CALIBRATION = 50_000, 5
#: Rows whose terms are held at once, and characters whose n-grams are.
BLOCK, CHUNK_CHARS = 250, 1 << 18
ROLL = shared.Rolling(31)


def features(texts: list[str]) -> list[np.ndarray]:
    """For each text, the distinct numbers of its lower-cased character n-grams, with a space at either end; sorted."""
    whole = [f" {t.lower()} " for t in texts]
    data = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in whole])])
    symbols = shared.mix(data.astype(np.uint64) + np.uint64(1))
    parts = []
    for n in LENGTHS:
        first = np.arange(max(0, len(symbols) - n + 1))
        h = shared.mix(ROLL.runs(symbols, first, first + n) + np.uint64(n))
        parts.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    out = []
    for i in range(len(texts)):
        own = np.sort(np.concatenate([p[at[i] : max(at[i], at[i + 1] - n + 1)] for n, p in zip(LENGTHS, parts, strict=True)]))
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        """A row's sum of weights, divided by the root of its number of features."""
        return np.array([self.weights[r].sum(dtype=np.float64) / max(1, len(r)) ** 0.5 for r in rows]) + self.bias

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.sums(rows))


def _descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    x, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _weights(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Logistic regression over presence * log-count ratio. rows: numbers of the chosen features. Rows are taken in blocks, so that
    besides the features themselves little memory is held."""
    blocks = []
    for k in range(0, len(rows), BLOCK):
        part = rows[k : k + BLOCK]
        blocks.append((slice(k, k + len(part)), np.concatenate(part), np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part])))

    def gradient(w: np.ndarray) -> np.ndarray:
        out, scaled = np.zeros(len(w)), w[:-1] * ratio
        for at, number, row in blocks:
            n = at.stop - at.start
            error = _sigmoid(np.bincount(row, scaled[number], n) * scale[at] + w[-1]) - labels[at]
            out[:-1] += np.bincount(number, (error * scale[at])[row], len(ratio))
            out[-1] += error.sum()
        out[:-1] *= ratio
        out /= len(rows)
        out[:-1] += PENALTY * w[:-1]
        return out

    return _descend(gradient, np.zeros(len(ratio) + 1), STEPS, RATE)[:-1] * ratio


def fit(rows: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, apart: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, counts: tuple[float, float]) -> Model:
    """Weights from the rows that aren't apart, scale and bias from those that are, which the weights haven't seen; there a row counts as
    many times as its label has documents for each that was taken. Where either part has rows of one label only, or none: no weights,
    and a bias that tells the label's share. sizes: features of each row, not only chosen ones. counts: clean and toxic documents there are."""
    labels = np.asarray(labels, np.float64)
    share = (counts[1] + 0.5) / (sum(counts) + 1)
    prior = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    if any(len(set(part.tolist())) < 2 for part in (labels[apart], labels[~apart])):
        return prior
    scale = 1 / np.sqrt(np.maximum(1, sizes))
    own = _weights([r for r, a in zip(rows, apart, strict=True) if not a], scale[~apart], labels[~apart], ratio)
    z = np.array([own[r].sum() for r, a in zip(rows, apart, strict=True) if a]) * scale[apart]
    y, centre, unit = labels[apart], z.mean(), z.std() or 1.0
    z = (z - centre) / unit
    stands_for = np.where(y > 0, counts[1] / max(1.0, labels.sum()), counts[0] / max(1.0, (1 - labels).sum()))
    stands_for /= stands_for.mean()

    def gradient(x: np.ndarray) -> np.ndarray:
        error = (_sigmoid(x[0] * z + x[1]) - y) * stands_for
        return np.array([(error * z).mean(), error.mean()]) + np.array([1e-3 * x[0], 0])

    slope, bias = _descend(gradient, np.array([1.0, prior.bias]), 600, 0.1)
    weights = prior.weights
    weights[chosen] = own * slope / unit
    return Model(weights, float(bias - slope * centre / unit))


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _runs(batch: pa.RecordBatch, column: int):
    """Runs of rows of a batch of about CHUNK_CHARS characters; a row is never cut."""
    texts = pc.fill_null(batch.column(column), "").to_pylist()
    size, k = 0, 0
    for end in range(1, len(texts) + 1):
        size += len(texts[end - 1])
        if size >= CHUNK_CHARS or end == len(texts):
            yield k, end, texts[k:end]
            size, k = 0, end


def _counted(batches):
    """Of each feature, the rows and the toxic rows that have it."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for a, b, texts in _runs(batch, 0):
            for own, toxic in zip(features(texts), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                seen[0, own] += 1
                seen[1, own] += toxic > 0
    full = np.flatnonzero(seen[0])
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(seen[0, full]), pa.array(seen[1, full])], ["feature", "seen", "ones"])


def _picked(chosen: np.ndarray):
    """The chosen features of each row, by their number among them; and how many features it has in all."""
    number = np.full(1 << BITS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))

    def run(batches):
        for batch in batches:
            for a, b, texts in _runs(batch, 0):
                rows = features(texts)
                own = [x[x >= 0] for x in (number[r] for r in rows)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(r) for r in rows], pa.int32()), pa.array(own, pa.list_(pa.int32()))], ["toxic", "apart", "size", "own"])

    return run


def bounded(n: tuple[int, int], limit: int) -> tuple[int, int]:
    """How many clean and toxic documents are taken of those there are: half of the limit each, and what one lacks from the other."""
    toxic = min(n[1], max(limit // 2, limit - n[0]))
    return min(n[0], limit - toxic), toxic


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on labels(doc_id, toxic) outside fold 0 of documents that docs(doc_id, text) holds: at most max_rows of them, by the
    least hash of doc_id. Null doc_ids and labels are left out; of several labels of a document, the largest counts; of several
    texts of a doc_id, the one of the least hash. A null text has the features of an empty one, and a long one all of its own.
    Without usable labels, as with an empty table, the model has no weights and tells the same score of all. Other columns are
    ignored. What comes to the driver is bounded by max_rows and KEPT, whatever the input's size."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    told = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = shared.table(told.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "told")
    n = told.agg(F.count_if(F.col("toxic") <= 0).alias("clean"), F.count_if(F.col("toxic") > 0).alias("toxic")).first()
    taken = [told.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for side, k in zip(("toxic <= 0", "toxic > 0"), bounded(tuple(n), max_rows), strict=True)]
    taken = taken[0].unionByName(taken[1]).withColumn("apart", F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(CALIBRATION)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most max_rows rows of three numbers
    rows = rows.groupBy("doc_id", "toxic", "apart").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("least.text", "toxic", "apart")
    rows = shared.table(rows, "labelled")
    counts = rows.where("not apart").select("text", "toxic").mapInArrow(_counted, "feature int, seen long, ones long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("ones").alias("ones"))
    counts = shared.table(counts, "counts")
    sums = counts.agg(F.sum("ones").alias("p"), F.sum(F.col("seen") - F.col("ones")).alias("q")).first()
    p, q = ((n or 0) + SMOOTH * (1 << BITS) for n in (sums.p, sums.q))
    ratio = F.log((F.col("ones") + SMOOTH) / p) - F.log((F.col("seen") - F.col("ones") + SMOOTH) / q)
    best = counts.where(F.col("seen") >= LEAST_ROWS).select("feature", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt("seen")).alias("weight")).orderBy(F.desc("weight"), "feature").limit(KEPT).toArrow()
    chosen, ratios = np.asarray(best.column("feature")), np.asarray(best.column("ratio"))
    got = rows.mapInArrow(_picked(chosen), "toxic int, apart boolean, size int, own array<int>").toArrow()
    parts = [x.copy() for c in got.column("own").chunks for x in np.split(np.asarray(c.flatten()), np.cumsum(np.diff(np.asarray(c.offsets)))[:-1])[: len(c)]]
    sizes, toxic, apart = (np.asarray(got.column(c)) for c in ("size", "toxic", "apart"))
    del got
    shared.tidy()
    model = fit(parts, sizes, toxic > 0, apart.astype(bool), chosen, ratios, tuple(n))
    del parts
    shared.tidy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, score (0 to 1, of the whole text), predicted (1 if score >= 0.5): a row for
    each row. Null and empty texts get the score of a text without features. A null doc_id goes through, with held_out null. Other
    columns are never read; an empty table gives no rows. The model is 2**BITS numbers, whatever the input's size."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b, texts in _runs(batch, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sent.value.scores(features(texts)), pa.float64())], ["doc_id", "score"])
        shared.tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs(text, ...) that score below the threshold, with all their columns. Each row is judged by its own whole text,
    also where rows repeat or share a doc_id; null and empty texts have the score of a text without features. An empty table gives
    no rows."""
    shared.small_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b, texts in _runs(batch, at):
                kept = batch.slice(a, b - a).filter(pa.array(sent.value.scores(features(texts)) < threshold))
                if kept.num_rows:
                    yield kept
        shared.tidy()

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # as columns may have any name
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    return score(docs, train(docs, shared.read(spark, sf_dir, "labels")))
