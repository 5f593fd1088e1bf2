"""Exact nearest neighbours: blocks of queries against blocks of targets, by matrix products, then exact distances of the few. Few targets are
broadcast as one block; more meet the queries by a shuffle, in a grid of blocks of either. In few dimensions blocks are cells of space, and a query
meets only those that may hold one of its nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The most bytes of target vectors that are broadcast (and held by the driver on the way), and of the vectors of a block beyond that.
BROADCAST_BYTES, BLOCK_BYTES = 128 << 20, 24 << 20
#: Distances that are held at once, and single-precision scores.
CELLS, SCORES = 1 << 22, 1 << 20
#: Queries that are scored together.
ROWS = 1024
#: Up to so many dimensions targets are dealt into cells of about so many rows, at so many cells most, cut at a sample of so many rows for each.
LOW, CELL_ROWS, MOST_CELLS, SAMPLED = 8, 4096, 1 << 14, 16


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Block:
    """Target vectors in the order of their ids."""

    def __init__(self, ids: pa.Array, vectors: pa.Array):
        ids = np.asarray(ids, np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.v = matrix(vectors)[order] if len(order) else np.zeros((0, 0))

    @cached_property
    def same(self) -> np.ndarray:
        return first_equal(self.v)

    @cached_property
    def centre(self) -> np.ndarray:
        return self.v.mean(0)

    @cached_property
    def far(self) -> float:
        """The largest distance from the centre."""
        return max(float(np.sqrt(((self.v[i : i + 4096] - self.centre) ** 2).sum(1).max())) for i in range(0, len(self.v), 4096))

    def scored(self, metric: str) -> np.ndarray:
        """In single precision, so that products with _scored() of queries order the targets by distance, the nearest first by the largest."""
        if metric not in self.held:
            out = np.empty((len(self.v), self.v.shape[1] + (metric == "l2")), np.float32)
            for i in range(0, len(out), 4096):
                if metric == "cosine":
                    out[i : i + 4096] = unit(self.v[i : i + 4096])
                else:
                    v = (self.v[i : i + 4096] - self.centre) / (self.far or 1.0)
                    out[i : i + 4096, :-1], out[i : i + 4096, -1] = v, (v * v).sum(1) / -2
            self.held[metric] = out
        return self.held[metric]

    @cached_property
    def held(self) -> dict:
        return {}

    @cached_property
    def norms(self) -> tuple[float, float]:
        size = np.sqrt((self.v * self.v).sum(1))
        return float(size.min()) * (1 - 1e-12), float(size.max()) * (1 + 1e-12)

    @cached_property
    def sound(self) -> bool:
        return sound(self.v)


def _columns(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    return table.column(0).combine_chunks(), table.column("v").combine_chunks()


class Targets:
    """The rows of df(key, v), whose keys differ. After a check of their size they are broadcast, or else stay where they are, to be met in blocks."""

    def __init__(self, df: DataFrame, key: str = "vec_id", most: int | None = None):
        self.df = df.select(key, "v")
        self.size, self.rows = _bytes(self.df)
        self.small = self.size <= (BROADCAST_BYTES if most is None else most)

    @cached_property
    def sent(self):
        return self.df.sparkSession.sparkContext.broadcast(Block(*_columns(self.df.toArrow()))) if self.small and self.rows else None

    def __len__(self) -> int:
        return self.rows


def _bytes(df: DataFrame) -> tuple[int, int]:
    """Bytes of the vectors as doubles, and rows."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    return (size.n or 0) * (size.d or 0) * 8, size.n


def blocks(queries: DataFrame, targets: Targets, run: Callable, schema: str, key: str = "vec_id") -> DataFrame:
    """run(ids, vectors, block) -> columns, for blocks of queries and of targets. A query meets each target once, all in one block if targets are
    broadcast, otherwise in several; whoever calls this adds up or merges what a query has from each. Without targets there are no rows."""
    spark, sent = queries.sparkSession, targets.sent
    fields = [x.split() for x in schema.split(",")]
    names, kinds = [n for n, _ in fields], {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def met(ids: pa.Array, v: pa.Array, block: Block) -> Iterator[pa.RecordBatch]:
        own, x = np.asarray(ids, np.int64), matrix(v)
        step = getattr(run, "rows", None) or max(1, CELLS // max(1, len(block.ids)))  # searches hold few distances a query
        for k in range(0, len(own) if len(block.ids) else 0, step):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in run(own[k : k + step], x[k : k + step], block)], names)

    def each(batches):
        for batch in batches:
            yield from met(batch.column(0), batch.column(1), sent.value)

    if sent or not len(targets):
        spread = queries.select(key, "v").repartition(spark.sparkContext.defaultParallelism, key)  # a small file is one split
        return spread.mapInArrow(each if sent else lambda batches: iter(()), schema)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(met(*_columns(left), Block(*_columns(right)))) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], kinds[k]) for _, k in fields], names)

    rows, columns = (max(1, -(-size // BLOCK_BYTES)) for size in (_bytes(queries.select("v"))[0], targets.size))
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(key, "v", part(key, rows).alias("row")).withColumn("column", every(columns))
    right = targets.df.toDF("target", "v").withColumn("column", part("target", columns)).withColumn("row", every(rows))
    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(cell, schema)


def squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances by expanded squares, and how far rounding may have moved those of each row of x: in proportion to the squares of
    the norms, whatever the distance."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    slack = 4 * np.finfo(float).eps * (x.shape[1] + 8) * (a + (b.max() if len(b) else 0))
    return np.maximum(a[:, None] + b[None, :] - 2 * (x @ y.T), 0), slack


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances: by expanded squares, and where rounding would show, anew from the differences."""
    d, slack = squares(x, y)
    rough = d < 1e6 * slack[:, None]
    np.sqrt(d, out=d)
    step = max(1, CELLS // max(1, x.shape[1]))
    for i in np.flatnonzero(rough.any(1)):
        near = np.flatnonzero(rough[i])
        for k in range(0, len(near), step):
            at = near[k : k + step]
            d[i, at] = np.sqrt(((x[i] - y[at]) ** 2).sum(1))
    return d


def _exact(metric: str, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        sizes = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((t * t).sum(2))
        return 1 - (q[:, None, :] * t).sum(2) / np.where(sizes > 0, sizes, 1)
    return np.sqrt(((q[:, None, :] - t) ** 2).sum(2))


def first_equal(v: np.ndarray) -> np.ndarray:
    """For each row, the first row with the same components."""
    if not v.size:
        return np.arange(len(v))
    whole = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel()
    _, first, own = np.unique(whole, return_index=True, return_inverse=True)
    return first[own]


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def sound(m: np.ndarray) -> bool:
    """Finite, and no row so long or short that its square isn't of full precision."""
    size = np.abs(m).max(1, initial=0)
    return bool(np.isfinite(size).all() and ((size == 0) | (size > 1e-140) & (size < 1e140)).all())


def spare(width: int) -> int:
    """Candidates beyond k: many where they cost little and ties are likely."""
    return max(16, 256 // max(1, width))


def _scored(metric: str, x: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Queries for products with block.scored(), and how far rounding may have moved the products."""
    eps, width = float(np.finfo(np.float32).eps), x.shape[1]
    if metric == "cosine":
        return unit(x).astype(np.float32), np.full(len(x), (width + 8) * eps)
    own = (x - block.centre) / (block.far or 1.0)
    return np.hstack([own, np.ones((len(x), 1))]).astype(np.float32), (width + 8) * eps * (np.sqrt((own * own).sum(1)) + 1.5) + 1e-30


def set_places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask of few set places: eight at once are looked at first."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def _best(x: np.ndarray, targets: np.ndarray, at: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of the `keep` targets of the largest products with each row of x, descending; at: a place that doesn't count. Targets come
    in growing stretches; only what exceeds the least that is kept is looked at."""
    rows, done, size = np.arange(len(x)), 0, max(512, 4 * keep)
    place, best = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), np.float32)
    while done < len(targets):
        scores = x @ targets[done : done + size].T
        own = (at >= done) & (at < done + scores.shape[1])
        scores[rows[own], at[own] - done] = -np.inf
        if not done:
            n = min(keep, scores.shape[1])
            place = np.argpartition(scores, scores.shape[1] - n, axis=1)[:, -n:]
            best = np.take_along_axis(scores, place, 1)
        else:
            hits = set_places(scores > best.min(1)[:, None])
            value, row = scores.ravel()[hits], hits // scores.shape[1]
            order = np.lexsort((-value, row))
            hits, value, row = hits[order], value[order], row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            first = rank < keep
            hits, value, row, rank = hits[first], value[first], row[first], rank[first]
            who, short = np.unique(row, return_inverse=True)
            if len(who):
                more, where = np.full((len(who), rank.max() + 1), -np.inf, np.float32), np.zeros((len(who), rank.max() + 1), np.int64)
                more[short, rank], where[short, rank] = value, done + hits % scores.shape[1]
                more, where = np.hstack([best[who], more]), np.hstack([place[who], where])
                top = np.argpartition(more, more.shape[1] - keep, axis=1)[:, -keep:]
                best[who], place[who] = np.take_along_axis(more, top, 1), np.take_along_axis(where, top, 1)
        done += scores.shape[1]
        size = min(2 * size, max(512, 4 * keep, SCORES // len(x)))
    order = np.argsort(-best, axis=1, kind="stable")
    return np.take_along_axis(place, order, 1), np.take_along_axis(best, order, 1)


def _lists(d: np.ndarray, t: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of each row, the finite distances and their ids."""
    keep = np.isfinite(d)
    ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(d[keep])), pa.ListArray.from_arrays(ends, pa.array(t[keep]))


def _both(k: int):
    """The nearest other rows by distance and by cosine, from one pass of products. Those by distance are sought among the candidates by cosine; a row's are
    taken if none of the others can be as near, whatever its norm, or else are sought by themselves."""
    l2, cosine = _nearest(k, "l2", True), _nearest(k, "cosine", True)

    def run(ids, x, block):
        best_of = min(k, len(block.ids))
        keep = min(len(block.ids), best_of + spare(x.shape[1]))
        d, t = np.full((2, len(x), best_of), np.inf), np.zeros((2, len(x), best_of), np.int64)
        unsafe = np.ones((2, len(x)), bool)
        if block.sound and sound(x):
            scored, slack = _scored("cosine", x, block)
            at, size = l2.places(ids, block), np.sqrt((x * x).sum(1))
            for i in range(0, len(x), ROWS):
                rows = slice(i, i + ROWS)
                part, score = _best(scored[rows], block.scored("cosine"), at[rows], keep)
                for j, metric in enumerate(("l2", "cosine")):
                    d[j, rows], t[j, rows] = l2.exact(x[rows], block, part, np.isinf(score), best_of, metric)
                # What is left out has at most this cosine, and with that, at least this distance.
                most = np.minimum(score[:, -1].astype(float) + slack[rows], 1)
                norm = np.clip(size[rows] * most, *block.norms)
                least = np.maximum(size[rows] ** 2 + norm**2 - 2 * size[rows] * norm * most, 0) - 1e-9 * (size[rows] ** 2 + norm**2)
                left = keep < len(block.ids)
                unsafe[0, rows] = left & ~(d[0, rows, -1] ** 2 < least)
                unsafe[1, rows] = left & ~(score[:, -1] < score[:, best_of - 1] - 2 * slack[rows])
        for j, search in enumerate((l2, cosine)):
            again = np.flatnonzero(unsafe[j])
            step = max(1, CELLS // len(block.ids))
            for i in range(0, len(again), step):
                rows = again[i : i + step]
                d[j, rows], t[j, rows] = search.found(ids[rows], x[rows], block)
        return ids, *_lists(d[0], t[0]), *_lists(d[1], t[1])

    run.rows = ROWS
    return run


def _nearest(k: int, metric: str, own: bool, packed: bool = False):
    def ranked(x, block, candidates):
        """Exact distances of one query to candidates, of which equal ones are computed once, a bounded number at a time."""
        first, back = np.unique(block.same[candidates], return_inverse=True)
        step = max(1, CELLS // max(1, block.v.shape[1]))
        return np.concatenate([_exact(metric, x[None], block.v[first[i : i + step]][None])[0] for i in range(0, len(first), step)])[back]

    def exact(x, block, part, hit, best_of, metric=metric):
        """Distances and ids of the best of the candidates at part; hit: candidates that don't count."""
        d = np.empty(part.shape)
        step = max(1, min(64, CELLS // max(1, part.shape[1] * x.shape[1])))
        for i in range(0, len(x), step):
            d[i : i + step] = _exact(metric, x[i : i + step], block.v[part[i : i + step]])
        d[hit] = np.inf
        order = np.lexsort((block.ids[part], d), axis=1)[:, :best_of]
        return np.take_along_axis(d, order, 1), np.take_along_axis(block.ids[part], order, 1)

    def places(ids, block):
        """Where the queries are among the targets, or -1."""
        if not own:
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(block.ids, ids), len(block.ids) - 1)
        return np.where(block.ids[at] == ids, at, -1)

    def doubles(ids, x, block, best_of):
        """In double precision, all targets at once."""
        tids, tv = block.ids, block.v
        if metric == "cosine":
            rough = 1 - unit(x) @ unit(tv).T
            slack = np.full(len(x), 8 * np.finfo(float).eps * (x.shape[1] + 8))
        else:
            rough, slack = squares(x - block.centre, tv - block.centre) if np.isfinite(block.centre).all() else squares(x, tv)
        at = places(ids, block)
        rough[np.flatnonzero(at >= 0), at[at >= 0]] = np.inf
        more = min(rough.shape[1], best_of + spare(x.shape[1]))
        part = np.argpartition(rough, more - 1, axis=1)[:, :more]
        near = np.sort(np.take_along_axis(rough, part, 1), axis=1)
        # Rounding may have kept out targets that tie with the last: rows for which that can be are widened, each by itself.
        edge = near[:, best_of - 1] + 2 * slack
        d, t = exact(x, block, part, np.isinf(np.take_along_axis(rough, part, 1)), best_of)
        for i in np.flatnonzero((near[:, -1] <= edge) & (more < rough.shape[1])):
            candidates = np.flatnonzero(rough[i] <= edge[i])
            distance = ranked(x[i], block, candidates)
            best = np.lexsort((tids[candidates], distance))[:best_of]
            d[i], t[i] = distance[best], tids[candidates[best]]
        return d, t

    def found(ids, x, block):
        """Distances and ids of the nearest by rows, infinite where there are none: from single precision, in which a few candidates more than k are kept,
        and where rounding may have kept out one of the nearest, from double precision."""
        best_of = min(k, len(block.ids))
        keep = min(len(block.ids), best_of + spare(x.shape[1]))
        d, t = np.empty((len(x), best_of)), np.empty((len(x), best_of), np.int64)
        unsafe = np.ones(len(x), bool)
        if block.sound and sound(x) and (metric == "cosine" or np.abs(x - block.centre).max(initial=0) < 1e15 * (block.far or 1.0)):
            scored, slack = _scored(metric, x, block)
            at = places(ids, block)
            for i in range(0, len(x), ROWS):
                rows = slice(i, i + ROWS)
                part, score = _best(scored[rows], block.scored(metric), at[rows], keep)
                d[rows], t[rows] = exact(x[rows], block, part, np.isinf(score), best_of)
                unsafe[rows] = (keep < len(block.ids)) & ~(score[:, -1] < score[:, best_of - 1] - 2 * slack[rows])
        again, step = np.flatnonzero(unsafe), max(1, CELLS // len(block.ids))
        for i in range(0, len(again), step):
            rows = again[i : i + step]
            d[rows], t[rows] = doubles(ids[rows], x[rows], block, best_of)
        return d, t

    def run(ids, x, block):
        d, t = found(ids, x, block)
        keep = np.isfinite(d)
        if packed:
            return ids, *_lists(d, t)
        rank = np.broadcast_to(np.arange(1, d.shape[1] + 1), d.shape)
        return np.repeat(ids, keep.sum(1)), rank[keep].astype(np.int64), t[keep], d[keep]

    run.found, run.exact, run.places, run.rows = found, exact, places, ROWS
    return run


KNN = "q long, rk long, t long, d double"
PACKED = "q long, ds array<double>, ts array<long>"


def _least(k: int, ds: str, ts: str):
    return F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col(ds).alias("d"), F.col(ts).alias("t"))))), 1, k)


def rows_of(found: DataFrame, name: str) -> DataFrame:
    """q, rk, t, d of a column of neighbours in order."""
    return found.select("q", F.posexplode(name).alias("rk", "x")).select("q", (F.col("rk") + 1).cast("long").alias("rk"), "x.t", "x.d")


def merged(found: DataFrame, k: int) -> DataFrame:
    """q, best: arrays of (d, t), the k nearest of what found(q, ds, ts) has for a query from several blocks."""
    return found.groupBy("q").agg(_least(k, "ds", "ts").alias("best"))


def both(points: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """q, l2, cosine: arrays of (d, t), what knn() has by either metric, from one pass over all pairs."""
    held = Targets(points, most=most)
    if len(held) < 2:
        raise ValueError("neighbours need two points at least")
    k = min(k, len(held) - 1)
    found = blocks(points, held, _both(k), f"{PACKED}, cds array<double>, cts array<long>")
    if held.small:
        zipped = lambda ds, ts: F.arrays_zip(F.col(ds).alias("d"), F.col(ts).alias("t"))
        return found.select("q", zipped("ds", "ts").alias("l2"), zipped("cds", "cts").alias("cosine"))
    return found.groupBy("q").agg(_least(k, "ds", "ts").alias("l2"), _least(k, "cds", "cts").alias("cosine"))


def knn(points: DataFrame, k: int, metric: str = "l2", targets: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """q, rk (from 1), t, d: the k nearest of targets (or of the other points), ties by id. k is cut to what there is; fewer than two points are an
    error. More than `most` bytes of targets (BROADCAST_BYTES) aren't broadcast: each block of them gives its k nearest, and these are merged. Many
    targets of few dimensions (LOW, Euclidean) meet the queries in cells of space."""
    held, k = _sought(points, k, targets, most)
    if (held.small or not len(held)) and not _in_space(held, k, metric):
        return blocks(points, held, _nearest(k, metric, targets is None), KNN)
    return rows_of(_lists_of(points, held, k, metric, targets is None), "best")


def knn_lists(points: DataFrame, k: int) -> DataFrame:
    """q, best: arrays of (d, t) in order, what knn() has of the other points as a row for each query."""
    held, k = _sought(points, k, None, None)
    return _lists_of(points, held, k, "l2", True)


def _sought(points: DataFrame, k: int, targets: DataFrame | None, most: int | None) -> tuple[Targets, int]:
    """The targets, and k cut to what there is."""
    held = Targets(points if targets is None else targets, most=most)
    if targets is None and len(held) < 2:
        raise ValueError("neighbours need two points at least")
    if k < 1:
        raise ValueError("k must be 1 at least")
    return held, min(k, len(held) - (targets is None))


def _in_space(held: Targets, k: int, metric: str) -> bool:
    return metric == "l2" and len(held) > 8 * max(CELL_ROWS, 8 * k) and held.size <= 8 * LOW * len(held)


def _lists_of(points: DataFrame, held: Targets, k: int, metric: str, own: bool) -> DataFrame:
    if _in_space(held, k, metric):
        return in_cells(points, held, k, own)
    found = blocks(points, held, _nearest(k, metric, own, packed=True), PACKED)
    return found.select("q", F.arrays_zip(F.col("ds").alias("d"), F.col("ts").alias("t")).alias("best")) if held.small else merged(found, k)


class Cells:
    """Boxes that fill space, cut at quantiles of a sample along its longest side, so that each holds about as many of its rows."""

    def __init__(self, sample: np.ndarray, leaves: int):
        width = sample.shape[1]
        self.axis, self.cut, self.kids, self.leaf, low, high = [], [], [], [], [], []

        def node(rows, n, lo, hi):
            own = len(self.axis)
            self.axis.append(0)
            self.cut.append(np.inf)
            self.kids.append([own, own])
            self.leaf.append(-1)
            axis = int(np.argmax(rows.max(0) - rows.min(0))) if n > 1 and len(rows) > 1 else 0
            x = np.sort(rows[:, axis])
            if n < 2 or len(x) < 2 or x[0] == x[-1]:
                self.leaf[own] = len(low)
                low.append(lo)
                high.append(hi)
                return own
            cut = x[min(len(x) - 1, max(0, len(x) * (n // 2) // n - 1))]
            cut = cut if cut < x[-1] else x[np.searchsorted(x, x[-1]) - 1]  # neither side is empty
            left = rows[:, axis] <= cut
            at = lambda v: np.where(np.arange(width) == axis, cut, v)
            self.axis[own], self.cut[own] = axis, cut
            self.kids[own] = [node(rows[left], n // 2, lo, at(hi)), node(rows[~left], n - n // 2, at(lo), hi)]
            return own

        node(sample, leaves, np.full(width, -np.inf), np.full(width, np.inf))
        self.axis, self.cut, self.kids, self.leaf = map(np.array, (self.axis, self.cut, self.kids, self.leaf))
        self.low, self.high = np.array(low), np.array(high)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            to = self.kids[at, np.where(x[rows, self.axis[at]] <= self.cut[at], 0, 1)] if len(x) else at
            if (to == at).all():
                return self.leaf[at]
            at = to

    def within(self, x: np.ndarray, reach: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and cells other than home that may hold something within reach of them."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gap = np.maximum(np.maximum(self.low - np.fmax.reduce(x, 0), np.fmin.reduce(x, 0) - self.high), 0)
        near = np.flatnonzero(~((gap * gap).sum(1) > np.fmax.reduce(reach) ** 2 * (1 + 1e-9)))
        near = near[near != home]
        rows, cells, step = [], [], max(1, SCORES // max(1, len(near) * x.shape[1]))
        for i in range(0, len(x), step):
            own = x[i : i + step, None]
            gap = np.maximum(np.maximum(self.low[near] - own, own - self.high[near]), 0)
            row, cell = np.nonzero((gap * gap).sum(2) <= reach[i : i + step, None] ** 2 * (1 + 1e-9))
            rows.append(row + i)
            cells.append(near[cell])
        return np.concatenate(rows), np.concatenate(cells)


#: A target (kind 0) or a query (1) on its way to a cell, or what a query has found (2).
VISIT = "cell long, kind int, id long, v array<double>, reach double, ds array<double>, ts array<long>"


def in_cells(points: DataFrame, held: Targets, k: int, own: bool) -> DataFrame:
    """q, best: knn_lists() of few dimensions. Each query finds the k nearest of its own cell, then visits the cells that are not farther than the last of these. Of equal
    targets only the k + 1 smallest ids can be among the nearest. Rows come sorted by cells, targets first, so that a task holds one cell and a batch of
    queries; cells with many queries are dealt out to several tasks, with the cell's targets."""
    spark, width, targets = points.sparkSession, held.size // (8 * len(held)), held.df.toDF("id", "v")
    leaves = min(MOST_CELLS, -(-len(held) // max(CELL_ROWS, 8 * k)))
    sample = matrix(targets.orderBy(F.xxhash64("id")).limit(SAMPLED * leaves).select("v").toArrow().column(0).combine_chunks())
    cells = Cells(sample[np.isfinite(sample).all(1)].reshape(-1, width), leaves)
    leaves, search = len(cells.low), _nearest(k, "l2", own, packed=True)
    sent = spark.sparkContext.broadcast(cells)

    def counted(batches):
        for batch in batches:
            cell, n = np.unique(sent.value.of(matrix(batch.column(0))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counts = points.select("v").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each cell
    parts = np.ones(leaves, np.int64)
    for r in counts:
        parts[r.cell] = max(1, -(-r.n // (4 * max(CELL_ROWS, 8 * k))))

    def dealt(kind: int, salted: bool):
        def rows(batches):
            for batch in batches:
                cell = sent.value.of(matrix(batch.column(1)))
                n = parts[cell]
                if not salted:
                    at = np.arange(len(cell))
                elif kind:
                    at, cell = np.arange(len(cell)), cell + leaves * ((np.asarray(batch.column(0), np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n)
                else:
                    at = np.repeat(np.arange(len(cell)), n)
                    cell = cell[at] + leaves * (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n))
                taken = batch.take(pa.array(at))
                none = [pa.nulls(len(at), x) for x in (pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(at), kind, np.int32)), taken.column(0), taken.column(1), *none], [x.split()[0] for x in VISIT.split(", ")])

        return rows

    def met(batches, done):
        """done(cell, ids, x, reach, found) for the queries of a cell, or of a batch; what has been found goes on as it is."""
        cell, ids, vectors, block = None, [], [], None
        for batch in batches:
            at, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(kinds) != 0)])) if len(at) else []
            for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
                if at[i] != cell:
                    cell, ids, vectors, block = at[i], [], [], None
                part = batch.slice(i, j - i)
                if kinds[i] == 0:
                    ids.append(part.column(2))
                    vectors.append(part.column(3))
                elif kinds[i] == 2:
                    yield pa.RecordBatch.from_arrays([part.column(2), part.column(5), part.column(6)], ["q", "ds", "ts"])
                else:
                    block = block or Block(pa.concat_arrays(ids or [pa.array([], pa.int64())]), pa.concat_arrays(vectors or [pa.array([], pa.list_(pa.float64()))]))
                    q, x = np.asarray(part.column(2), np.int64), matrix(part.column(3))
                    empty = lambda kind, n=len(q): pa.array([[]] * n, pa.list_(kind))
                    found = search(q, x, block)[1:] if len(block.ids) else (empty(pa.float64()), empty(pa.int64()))
                    yield from done(int(cell), part, x, *found)

    def first(batches):
        def done(cell, part, x, ds, ts):
            n = np.diff(np.asarray(ds.offsets))
            last = np.asarray(ds.flatten())[np.maximum(np.cumsum(n) - 1, 0)] if len(ds.flatten()) else np.zeros(len(n))
            row, to = sent.value.within(x, np.where(n < k, np.inf, last), cell % leaves)
            for at, kind, where, *more in ((np.arange(len(n)), 2, np.full(len(n), -1 - cell), ds, ts), (row, 1, to, None, None)):
                far = pa.array(np.where(n < k, np.inf, last)[at])
                lists = [pa.nulls(len(at), pa.list_(t)) if m is None else m for m, t in zip(more, (pa.float64(), pa.int64()), strict=True)]
                v = pa.nulls(len(at), part.column(3).type) if kind == 2 else part.column(3).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.full(len(at), kind, np.int32)), part.column(2).take(pa.array(at)), v, far, *lists], [x.split()[0] for x in VISIT.split(", ")])

        return met(batches, done)

    def second(batches):
        return met(batches, lambda cell, part, x, ds, ts: [pa.RecordBatch.from_arrays([part.column(2), ds, ts], ["q", "ds", "ts"])])

    few = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    targets = targets.withColumn("n", few).where(F.col("n") <= k + 1).select("id", "v")
    queries = points.select(F.col("vec_id").alias("id"), "v")
    tasks = max(1, min(leaves, max(4 * spark.sparkContext.defaultParallelism, leaves // 8)))
    sort = lambda df: df.repartition(tasks, "cell").sortWithinPartitions("cell", "kind")
    home = sort(targets.mapInArrow(dealt(0, True), VISIT).union(queries.mapInArrow(dealt(1, True), VISIT))).mapInArrow(first, VISIT)
    return merged(sort(targets.mapInArrow(dealt(0, False), VISIT).union(home)).mapInArrow(second, PACKED), k)
