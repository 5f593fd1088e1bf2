"""Removal of word windows that occur earlier in the corpus, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import shared

#: Words of a window. Of any two places, some common shift below PERIOD takes both to places that are in COVER modulo PERIOD, as
#: every difference modulo 13 is one of two members. So equal windows share an equal anchor of ANCHOR words at a cover place.
WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a worker gathers before it sends them; bits of the filter that spares most texts the shuffle. Both bound memory only.
GATHERED, FILTER_BITS = 1 << 19, 24
#: Bytes of a bucket of entries, of which a worker holds one at a time; and of an entry of an anchor, of a window, and of a place.
BUCKET_BYTES, ANCHOR_BYTES, WINDOW_BYTES, PLACE_BYTES = 1 << 24, 21, 36, 20
ROLL = shared.Rolling(41)
WINDOW_KEY = b"windows of a corpus"
COVERED = np.zeros(PERIOD, bool)
COVERED[list(COVER)] = True


def window_digests(text: bytes, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keyed 128-bit digests, as two longs, of the words of the windows that begin at these words of a text; sizes: of its words."""
    words = b" ".join(text.split())
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    digests = [hashlib.blake2b(words[a:b], digest_size=16, key=WINDOW_KEY).digest() for a, b in zip(starts[begin].tolist(), (ends[begin + WINDOW - 1] - 1).tolist(), strict=True)]
    h = np.frombuffer(b"".join(digests), np.uint64)
    return h[::2], h[1::2]


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.split())).digest()


def _rows_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    whole = data.tobytes()
    return (whole[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1))


def _facts(batches):
    for batch in batches:
        for a, b, data, offsets in shared.text_chunks(batch):
            words = [t.split() for t in _rows_of(data, offsets)]
            digests = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()), pa.array(digests, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), batch.column(2).slice(a, b - a)], ["id", "n_words", "digest", "class", "doc_id"])


def _sent(bucket: np.ndarray, buckets: int, columns: list[np.ndarray], names: list[str], extra: dict) -> Iterator[pa.RecordBatch]:
    """A row for each bucket, with its entries' columns as bytes; entries stay in the order of the texts, which packs well."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    arrays = [pa.array(full, pa.int32())] + [pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()) for c in columns]
    arrays += [pa.nulls(len(full), t) for t in extra.values()]
    yield pa.RecordBatch.from_arrays(arrays, ["bucket", *names, *extra])


def _lists(keys: list[np.ndarray], places: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """places as one list for each different key."""
    order = np.lexsort((places, *keys[::-1]))
    keys, places = [k[order] for k in keys], places[order]
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(places) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], pa.ListArray.from_arrays(pa.array(np.append(at, len(places)), pa.int32()), pa.array(places.astype(np.int32)))


def _by_group(groups: int, ids: np.ndarray, classes: np.ndarray, places: np.ndarray) -> pa.Table:
    """A row for each group of documents, with the ids, classes and places of all of its entries as bytes."""
    group = (shared.mix(classes.view(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((places, classes, ids, group))
    at = _groups(group[order])
    columns = [x[order] for x in (ids, classes, places.astype(np.uint32))]
    ends = np.append(at, len(order))
    bytes_ = [pa.array([c[ends[k] : ends[k + 1]].tobytes() for k in range(len(at))], pa.binary()) for c in columns]
    return pa.table([pa.array(group[order][at], pa.int32()), *bytes_], ["group", "id", "class", "pos"])


GROUPED = "group int, id binary, class binary, pos binary"


def _documents(table: pa.Table) -> pa.Table:
    """The places of each document of a group, as one list."""
    ids, classes, pos = (_column(table, n, k) for n, k in (("id", np.int64), ("class", np.int64), ("pos", np.uint32)))
    (ids, classes), places = _lists([ids, classes], pos)
    return pa.table({"id": pa.array(ids), "class": pa.array(classes), "places": places})


def _told(table: pa.Table, *names: str) -> list[np.ndarray]:
    """What the workers have settled at once: the named columns, for each place."""
    rows = table.filter(table.column("own").is_valid()).combine_chunks()
    places = rows.column("places").combine_chunks()
    n = np.diff(np.asarray(places.offsets)) if len(places) else np.zeros(0, np.int64)
    return [np.repeat(np.asarray(rows.column(k).combine_chunks(), np.int64), n) for k in names] + [np.asarray(places.flatten(), np.uint32)]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


ANCHORS = "bucket int, h binary, class binary, pos binary, many binary, own long, places array<int>"


def _repeated(h: np.ndarray, one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by h, the first entry of each h, and whether it stands for more than one place of different texts."""
    order = np.argsort(h, kind="stable")
    at = _groups(h[order])
    if not len(at):
        return order, at, np.zeros(0, bool)
    o = one[order]
    return order, at, (np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)) | np.maximum.reduceat(many[order], at).astype(bool)


def _place(classes: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return shared.mix(classes.view(np.uint64) + pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _anchors(buckets: int):
    """What a worker has gathered is settled in part at once: of an anchor that it has seen at several places, all are told
    (own, places) and one entry is sent; so a passage in any share of all documents comes to one entry for each gathering."""

    def flush(h, classes, pos):
        h, classes, pos = (np.concatenate(x) for x in (h, classes, pos))
        order, at, several = _repeated(h, _place(classes, pos), np.zeros(len(h), np.uint8))
        kept = np.sort(order[at])
        many = np.zeros(len(h), np.uint8)
        many[order[at]] = several
        told = order[np.repeat(several, np.diff(np.append(at, len(h))))]
        yield from _sent((h[kept] % np.uint64(buckets)).astype(np.int32), buckets, [h[kept], classes[kept], pos[kept], many[kept]], ["h", "class", "pos", "many"], {"own": pa.int64(), "places": pa.list_(pa.int32())})
        (own,), places = _lists([classes[told]], pos[told])
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array((own % buckets).astype(np.int32)), none, none, none, none, pa.array(own), places], ["bucket", "h", "class", "pos", "many", "own", "places"])

    def run(batches):
        gathered: list = [[], [], []]
        n = 0
        for batch in batches:
            for _, _, data, offsets in shared.text_chunks(batch):
                first, end, at = shared.word_places(data, offsets)
                count = np.diff(at)
                row = np.repeat(np.arange(len(count)), count)
                pos = np.arange(len(first)) - at[row]
                chosen = np.flatnonzero(COVERED[pos % PERIOD] & (pos + ANCHOR <= count[row]) & (count[row] >= WINDOW))
                if not len(chosen):
                    continue
                words = shared.word_hashes(data, first, end)
                classes = np.array([int.from_bytes(_digest(t)[:8], "little", signed=True) if k >= WINDOW else 0 for t, k in zip(_rows_of(data, offsets), count, strict=True)], np.int64)
                for x, y in zip(gathered, (shared.mix(ROLL.runs(words, chosen, chosen + ANCHOR)), classes[row[chosen]], pos[chosen].astype(np.uint32)), strict=True):
                    x.append(y)
                n += len(chosen)
                if n >= GATHERED:
                    yield from flush(*gathered)
                    gathered, n = [[], [], []], 0
        if n:
            yield from flush(*gathered)
        gathered.clear()
        shared.tidy()

    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x is not None), kind)


def _anchor_bucket(groups: int):
    def run(table: pa.Table) -> pa.Table:
        own, places = _told(table, "own")
        h, classes, pos, many = (_column(table, n, k) for n, k in (("h", np.uint64), ("class", np.int64), ("pos", np.uint32), ("many", np.uint8)))
        order, at, several = _repeated(h, _place(classes, pos), many)
        hit = order[np.repeat(several, np.diff(np.append(at, len(h))))]
        hit = hit[many[hit] == 0]
        classes = np.concatenate([own, classes[hit]])
        return _by_group(groups, np.zeros(len(classes), np.int64), classes, np.concatenate([places, pos[hit]]))

    return run


WINDOWS = "bucket int, h binary, g binary, id binary, class binary, pos binary, own long, own_class long, places array<int>"
_WINDOW_KINDS = (("h", np.uint64), ("g", np.uint64), ("id", np.int64), ("class", np.int64), ("pos", np.uint32))


def _own_class(batches):
    """Of rows joined by their id, those whose text is of the class."""
    shared.tidy()
    for batch in batches:
        texts, classes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        same = [int.from_bytes(_digest(t.encode())[:8], "little", signed=True) == c for t, c in zip(texts, classes, strict=True)]
        yield batch.filter(pa.array(same, pa.bool_()))


def _later(h, g, ids, classes, pos) -> tuple[np.ndarray, np.ndarray]:
    """The entries that come first among those of equal windows, and the others; repeats of the first are neither."""
    order = np.lexsort((pos, classes, ids, g, h))
    at = _groups(h[order], g[order])
    first = order[np.repeat(at, np.diff(np.append(at, len(order))))]
    other = (ids[order] != ids[first]) | (classes[order] != classes[first]) | (pos[order] != pos[first])
    return order[at], order[other]


def _windows(buckets: int):
    """Equal windows that meet in one gathering are settled at once; the first of them is sent."""

    def flush(*parts):
        entry = [np.concatenate(p) for p in parts]
        first, rest = _later(*entry)
        first.sort()
        yield from _sent((entry[0][first] % np.uint64(buckets)).astype(np.int32), buckets, [c[first] for c in entry], [n for n, _ in _WINDOW_KINDS], {"own": pa.int64(), "own_class": pa.int64(), "places": pa.list_(pa.int32())})
        (own, own_class), places = _lists([entry[2][rest], entry[3][rest]], entry[4][rest])
        none = pa.nulls(len(own), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array((own % buckets).astype(np.int32))] + [none] * 5 + [pa.array(own), pa.array(own_class), places], ["bucket", *[n for n, _ in _WINDOW_KINDS], "own", "own_class", "places"])

    def run(batches):
        gathered: list = [[] for _ in _WINDOW_KINDS]
        n = 0
        for batch in batches:
            ids, classes, places = (batch.column(batch.schema.get_field_index(k)) for k in ("id", "class", "places"))
            for a, _, data, offsets in shared.text_chunks(batch):
                first, end, at = shared.word_places(data, offsets)
                for i, text in enumerate(_rows_of(data, offsets)):
                    count = at[i + 1] - at[i]
                    anchors = np.asarray(places[a + i].values, np.int64)
                    open_ = np.zeros(count + 1, np.int64)
                    np.add.at(open_, np.maximum(anchors - PERIOD + 1, 0), 1)
                    np.add.at(open_, anchors + 1, -1)
                    begin = np.flatnonzero(np.cumsum(open_)[: max(0, count - WINDOW + 1)] > 0)
                    k = len(begin)
                    if not k:
                        continue
                    own = slice(at[i], at[i + 1])
                    new = [*window_digests(text, end[own] - first[own], begin), np.full(k, ids[a + i].as_py(), np.int64), np.full(k, classes[a + i].as_py(), np.int64), begin.astype(np.uint32)]
                    for x, y in zip(gathered, new, strict=True):
                        x.append(y)
                    n += k
                    if n >= GATHERED:
                        yield from flush(*gathered)
                        gathered, n = [[] for _ in _WINDOW_KINDS], 0
        if n:
            yield from flush(*gathered)
        gathered.clear()
        shared.tidy()

    return run


def _window_bucket(groups: int):
    def run(table: pa.Table) -> pa.Table:
        entry = [_column(table, n, k) for n, k in _WINDOW_KINDS]
        _, rest = _later(*entry)
        told = _told(table, "own", "own_class")
        return _by_group(groups, *(np.concatenate([t, e[rest]]) for t, e in zip(told, entry[2:], strict=True)))

    return run


def _removed(batches):
    for batch in batches:
        ids, classes, texts, places = (batch.column(batch.schema.get_field_index(k)) for k in ("id", "class", "text", "places"))
        rows = []
        for i in range(len(ids)):
            words = texts[i].as_py().encode().split()
            begin = np.asarray(places[i].values, np.int64)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + WINDOW, -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
            rows.append((int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest(), [{"first": int(x), "end": int(y)} for x, y in edge]))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, classes, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], span)], ["id", "class", "n_removed", "kept_sha256", "spans"])


def _filter(ids: DataFrame) -> Callable:
    """Passes the rows whose id may be among ids: by a bitmap of 2**FILTER_BITS hashes, the only thing that goes to the driver, and its size is fixed."""
    spark = ids.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = ids.select((bit / 64).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) % 64 as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bitmap[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    sent = spark.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool))

    def run(batches):
        for batch in batches:
            kept = batch.filter(pa.array(sent.value[np.asarray(batch.column(2))]))
            if kept.num_rows:
                yield kept.select(["id", "text"])

    return lambda docs: docs.withColumn("bit", bit.cast("int")).mapInArrow(run, "id long, text string")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text, ...): doc_id, n_words, n_removed, kept_sha256, spans (of removed words: first, end).

    Words are runs without ASCII white space. Each word that is covered by a window of 20 words whose words also start earlier
    (smaller doc_id, or same document and earlier start) is removed; windows are judged on the input. Null and empty texts have
    no words. Repeated rows of a doc_id and text count as one, and get the same result; several texts of a doc_id count as parts
    of one document, in a fixed order of their digests. Rows with a null doc_id come after all others, whatever the largest doc_id is, and keep
    their null. Other columns are ignored; an empty table gives no rows.

    Texts of equal words are settled by their SHA-256. For the others, each anchor that occurs at several places extends to the windows
    that hold it, and keyed 128-bit BLAKE2b digests of their words' bytes tell the first of equal ones (among 10**13 different windows, two are
    taken for equal once in 6 * 10**12 corpora, whatever the words look like). Texts without such anchors are never shuffled, but for a few by chance. A text is known by 64
    bits of its digest on the way; two that share them share nothing else, as ids and windows decide. Entries are dealt into buckets
    by their hashes; their number grows with the words, so that a bucket's size doesn't.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def buckets(entries: int, size: int) -> int:
        return max(least, -(-entries * size // BUCKET_BYTES))

    def dealt(entries: DataFrame, by: str, number: int, fn, kind: str) -> DataFrame:
        """fn of each bucket, two buckets a task."""
        return entries.repartition(-(-number // 2), by).groupBy(by).applyInArrow(fn, kind)

    own = docs.select(shared.id_places(docs).alias("id"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    facts = shared.table(own.mapInArrow(_facts, "id long, n_words long, digest binary, class long, doc_id long"), "words")
    own = own.select("id", "text")
    heads = facts.groupBy("digest").agg(F.min("id").alias("head"), F.min("class").alias("class"))
    lists = "id long, class long, places array<int>"
    n_anchors = (facts.agg(F.sum("n_words")).first()[0] or 0) * len(COVER) // PERIOD
    n, groups = buckets(n_anchors, ANCHOR_BYTES), buckets(n_anchors, PLACE_BYTES)
    anchors = dealt(own.select("text").mapInArrow(_anchors(n), ANCHORS), "bucket", n, _anchor_bucket(groups), GROUPED)
    marked = dealt(anchors, "group", groups, _documents, lists).select("class", "places")
    marked = shared.table(heads.join(marked, "class").select(F.col("head").alias("id"), "class", "places"), "marked")
    n_windows = (marked.agg(F.sum(F.size("places"))).first()[0] or 0) * PERIOD
    texts = _filter(marked.select("id"))(own).join(marked.hint("shuffle_hash"), "id")
    texts = shared.table(texts.select("id", "text", "class", "places").mapInArrow(_own_class, "id long, text string, class long, places array<int>"), "texts")
    shared.drop(marked)
    n, groups = buckets(n_windows, WINDOW_BYTES), buckets(n_windows, PLACE_BYTES)
    later = dealt(texts.mapInArrow(_windows(n), WINDOWS), "bucket", n, _window_bucket(groups), GROUPED)
    later = dealt(later, "group", groups, _documents, lists)
    changed = texts.select("id", "text", "class").join(later.hint("shuffle_hash"), ["id", "class"]).mapInArrow(_removed, "id long, class long, n_removed long, kept_sha256 string, spans array<struct<first:long,end:long>>").dropDuplicates(["id", "class"])
    return _result(facts, changed)


def _result(facts: DataFrame, changed: DataFrame) -> DataFrame:
    copies = shared.table(facts.groupBy("digest").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    out = shared.join_groups(facts, copies, "digest", "left").join(changed, ["id", "class"], "left")
    copy = (F.col("id") != F.col("head")) & (F.col("n_words") >= WINDOW)
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<first:long,end:long>>"))).alias("spans"),
    )


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_windows(shared.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (
  SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS text
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT split.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
"""
