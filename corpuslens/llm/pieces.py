"""SentencePiece encoding (BPE with byte fallback) and decoding through a table of distinct chunks."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm import shared

#: What stands for a space. A chunk is a run of marks and the characters up to the next mark, if no piece goes on past that.
MARK = "▁"
#: Characters of a block of documents, whose distinct chunks are sent on together, and about so many bytes of a bucket of chunks that are
#: segmented together. Both bound a worker's memory only.
BLOCK_CHARS, BUCKET_BYTES = 1 << 23, 1 << 23
#: Characters from which merges are ordered by a heap.
LONG = 100
NEVER = float("inf")
#: Kinds of pieces in the model's file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """A BPE model with byte fallback and without a character map. Other kinds are refused, as are pieces that cross a mark."""

    def __init__(self, data: bytes):
        parts = list(_fields(data))
        own = [dict(_fields(v)) for k, v in parts if k == 1]
        trainer, normaliser = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        pieces = [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in own]
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or normaliser.get(2) or not normaliser.get(5, 1) or not normaliser.get(3, 1) or normaliser.get(4, 1):
            raise ValueError("only BPE models with byte fallback that put a mark before a text and keep all characters and white space are supported")
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.order = {p: -score for p, score, kind in pieces if kind == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.order):
            raise ValueError("a piece crosses a mark, so chunks can't be segmented apart")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == NORMAL else b"" for p, _, kind in pieces]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text in order, each as its characters after the first mark, with spaces for further marks. A mark in the text is a space."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, marks = [], 0
        for p in parts:
            if p:
                out.append(" " * marks + p)
                marks = 0
            else:
                marks += 1
        return out + [" " * (marks - 1)] * (marks > 0)

    def _heaped(self, chunk: str) -> list[str]:
        get, own, n = self.order.get, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(s, i, 2) for i in range(n - 1) if (s := get(own[i] + own[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if j >= n or not own[i] or len(own[i]) + len(own[j]) != size:
                continue
            own[i], own[j] = own[i] + own[j], ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (s := get(own[a] + own[b])) is not None:
                    heapq.heappush(heap, (s, a, len(own[a]) + len(own[b])))
        return [p for p in own if p]

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk: the best pair of neighbours is merged, the leftmost of equal ones, until none is a piece."""
        chunk = MARK + chunk.replace(" ", MARK)
        if len(chunk) > LONG:
            own = self._heaped(chunk)
        else:
            get, own = self.order.get, list(chunk)
            scores = [get(a + b, NEVER) for a, b in zip(own, own[1:])]
            while scores and (least := min(scores)) != NEVER:
                i = scores.index(least)
                own[i] += own.pop(i + 1)
                del scores[i]
                if i < len(scores):
                    scores[i] = get(own[i] + own[i + 1], NEVER)
                if i:
                    scores[i - 1] = get(own[i - 1] + own[i], NEVER)
        out = []
        for p in own:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids that encoding gave."""
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(" ")


_models: dict[str, Model] = {}


def model(name: str) -> Model:
    """One model for each worker process; name: of a file that Spark distributed."""
    if name not in _models:
        with open(SparkFiles.get(name), "rb") as f:
            _models[name] = Model(f.read())
    return _models[name]


def _packed(x: np.ndarray) -> bytes:
    """Numbers below 2**32, as their lowest bytes, then their next ones and so on, which packs well."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _blocks(batches) -> Iterator[tuple[int, pa.Array, list[str]]]:
    """(block, doc_ids, texts): the same documents under the same number whenever the same rows come in the same order."""
    from pyspark import TaskContext

    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        own = batch.column(1).to_pylist()
        first = 0
        for i, text in enumerate(own):
            texts.append(text or "")
            size += len(texts[-1])
            if size >= BLOCK_CHARS:
                ids.append(batch.column(0).slice(first, i + 1 - first))
                yield number, pa.concat_arrays(ids), texts
                number, ids, texts, size, first = number + 1, [], [], 0, i + 1
        if first < len(own):
            ids.append(batch.column(0).slice(first))
    if texts:
        yield number, pa.concat_arrays(ids), texts


def _distinct(words: list[list[str]], buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of a block, the most frequent first, the bucket of each and its place among those of its bucket."""
    seen: Counter = Counter()
    for w in words:
        seen.update(w)
    chunks = [c for c, _ in seen.most_common()]
    bucket = np.fromiter(map(zlib.crc32, map(str.encode, chunks)), np.int64, len(chunks)) % buckets
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    place = np.empty(len(chunks), np.int64)
    place[order] = np.arange(len(chunks)) - ends[bucket[order]]
    return chunks, bucket, place


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True, fixed: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256, and with keep_ids also ids
    (binary: little-endian unsigned 32-bit) and decoded. A row for each row.

    A text is marked (a mark before it and one for each space) and cut before each run of marks into chunks, which no piece crosses.
    Blocks of documents send their distinct chunks, each to the bucket of its hash; a bucket segments each of its distinct chunks once and
    returns the ids to the blocks by position. There they meet the documents, each chunk of which is a bucket and a place in it.

    A null text counts as empty: no ids, digests of nothing. Texts and chunks of any length are taken whole; a long text is a block of its
    own. Repeated and null doc_ids go through; other columns are ignored; an empty table gives no rows. fixed: docs gives the same rows in the
    same order whenever it is read, as a scan of files does. Otherwise they are written first, as blocks are cut twice.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    spark.sparkContext.addFile(model_path)  # the executors may not have it
    name = model_path.rsplit("/", 1)[-1]
    docs = docs.select("doc_id", "text")
    docs = docs if fixed else shared.table(docs, "texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, size // 8 // BUCKET_BYTES)  # chunks packed by block come to about an eighth of the texts

    def send(batches):
        own = model(name)
        for block, _, texts in _blocks(batches):
            chunks, bucket, _ = _distinct([own.chunks(t) for t in texts], buckets)
            dealt: dict[int, list[str]] = {}
            for c, k in zip(chunks, bucket.tolist(), strict=True):
                dealt.setdefault(k, []).append(c)
            # No chunk holds a mark, so marks keep them apart.
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array([block] * len(dealt), pa.int64()), pa.array([zstandard.compress(MARK.join(x).encode(), 3) for x in dealt.values()], pa.binary())], ["bucket", "block", "chunks"])
        shared.tidy()

    def segment(table: pa.Table) -> pa.Table:
        own, known, out = model(name), {}, []
        for blob in table.column("chunks"):
            chunks = zstandard.decompress(blob.as_py()).decode().split(MARK)
            for c in set(chunks).difference(known):
                known[c] = ",".join(map(str, own.segment(c)))
            out.append(zstandard.compress(";".join([known[c] for c in chunks]).encode(), 3))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    def place(batches):
        own = model(name)
        for block, ids, texts in _blocks(batches):
            words = [own.chunks(t) for t in texts]
            chunks, bucket, at = _distinct(words, buckets)
            number = {c: i for i, c in enumerate(chunks)}
            row = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
            parts = [_packed(np.fromiter(map(len, words), np.int64, len(words))), _packed(bucket[row]), _packed(at[row])]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in parts]], ["block", "doc_ids", "sizes", "bucket", "place"])
        shared.tidy()

    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.BinaryType()), ("decoded", T.StringType())] * keep_ids

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        own = model(name)
        sizes, bucket, at = (_unpacked(left.column(c)[0].as_py()).astype(np.int64) for c in ("sizes", "bucket", "place"))
        begins, coded = np.full(buckets, -1, np.int64), []
        for k, blob in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True):
            begins[k] = len(coded)
            coded += zstandard.decompress(blob).decode().split(";")
        row = begins[bucket] + at
        if left.num_rows != 1 or len(np.unique(row)) != len(coded) or (len(row) and (row.max() >= len(coded) or begins[bucket].min() < 0)):
            raise RuntimeError("the documents changed between two reads; pass fixed=False")
        of = {str(i): b for i, b in enumerate(own.bytes_of)}
        texts = [b"".join([of[i] for i in x.split(",")]) for x in coded]
        coded, texts = np.array([*coded, ""], object)[:-1], np.array([*texts, b""], object)[:-1]
        rows: list[tuple] = []
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            ids, back = ",".join(coded[row[a:b]].tolist()), b"".join(texts[row[a:b]].tolist()).removeprefix(b" ")
            n = ids.count(",") + 1 if b > a else 0
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            if keep_ids:
                rows[-1] += (np.array(ids.split(",") if n else [], "<u4").tobytes(), back.decode("utf-8", "replace"))
        columns = [left.column("doc_ids").combine_chunks().flatten()] + [pa.array(c) for c in zip(*rows, strict=True)]
        return pa.table(columns, [n for n, _ in fields])

    sent = docs.mapInArrow(send, "bucket int, block long, chunks binary")
    back = sent.repartition(max(1, buckets // 2), "bucket").groupBy("bucket").applyInArrow(segment, "block long, bucket int, ids binary")
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in ("sizes", "bucket", "place")]])
    # Blocks without chunks hold empty texts only; their group of ids is empty.
    both = docs.mapInArrow(place, kind).groupBy("block").cogroup(back.groupBy("block"))
    return both.applyInArrow(put_back, T.StructType([T.StructField(n, t) for n, t in fields]))


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(shared.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False, fixed=True)
