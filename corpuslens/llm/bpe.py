"""Byte-level BPE: encoding by rounds over padded matrices, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm import shared

#: Bytes of the widest matrix row; longer pieces are merged one by one with a heap, in n log n instead of n * n.
WIDEST = 256
#: Cells of a matrix, and encoded pieces that a worker remembers; both bound memory only.
CELLS, REMEMBERED = 1 << 20, 400_000
NONE = np.int64(1 << 40)


class PairTable:
    """(left id, right id) -> id of the joined bytes, in open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        keys, todo, step = left.astype(np.int64) << 32 | right, np.arange(len(left)), 0
        while len(todo):  # round by round: whoever finds its slot free takes it
            slot = (self._slot(keys[todo]) + step) & (size - 1)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.values[slot[won]] = value[todo[won]]
            todo, step = todo[~won], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where no such pair is; ids below 0 are padding."""
        keys = left << 32 | (right & 0xFFFFFFFF)
        keys[(left < 0) | (right < 0)] = -2
        slot, mask = self._slot(keys), len(self.keys) - 1
        out = np.full(keys.shape, NONE, np.int64)
        at = self.keys[slot]
        hit = at == keys
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero((~hit & (at != -1)).ravel())
        flat, flat_slot, flat_out = keys.ravel(), slot.ravel(), out.ravel()
        for step in range(1, self.steps):
            if not len(todo):
                break
            s = (flat_slot[todo] + step) & mask
            at = self.keys[s]
            hit = at == flat[todo]
            flat_out[todo[hit]] = self.values[s[hit]]
            todo = todo[~hit & (at != -1)]
        return flat_out.reshape(keys.shape)


class Codec:
    """ranks: bytes -> id, with every single byte among them. pattern: splits a text into the pieces that are merged apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(x, y, i) for b, i in ranks.items() for k in range(1, len(b)) if (x := ranks.get(b[:k])) is not None and (y := ranks.get(b[k:])) is not None]
        self.pairs = PairTable(*np.array(pairs or np.zeros((0, 3)), np.int64).T)
        self._known: dict[str, bytes] = {}

    def _long(self, piece: bytes) -> list[int]:
        """The same merges by a heap of (rank, place) over linked places."""
        ids = [int(x) for x in self.first[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(i: int, j: int) -> int | None:
            return self.ranks.get(self.bytes_of[ids[i]] + self.bytes_of[ids[j]]) if j < n else None

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            if (j := after[i]) >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            after[j] = n
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := rank(a, b)) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length: each round, every row merges its leftmost pair of the least rank, and rows without
        a pair leave."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int64)
        lengths = np.array([len(p) for p in pieces])
        ids[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        out, rows = [np.zeros(0, np.int64)] * len(pieces), np.arange(len(pieces))
        while len(rows):
            if ids.shape[1] < 2:
                going = np.zeros(len(rows), bool)
            else:
                ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
                at = ranks.argmin(1)  # the leftmost of the least
                least = ranks[np.arange(len(rows)), at]
                going = least < NONE
            for i in np.flatnonzero(~going):
                row = ids[i]
                out[rows[i]] = row[row >= 0]
            if not going.any():
                break
            ids, rows, at, least = ids[going], rows[going], at[going], least[going]
            own = np.arange(len(rows))
            ids[own, at] = least
            keep = np.ones(ids.shape, bool)
            keep[own, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[i] = np.array(self._long(p), "<u4").tobytes()
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(i)
        for quarter, members in buckets.items():
            step = max(1, CELLS // (4 * quarter))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part]), strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        new = list(set().union(*split).difference(self._known)) if split else []
        known = self._known
        if len(known) + len(new) > REMEMBERED:
            known = self._known = {}
            new = list(set().union(*split))
        known.update(zip(new, self.encode_pieces([w.encode() for w in new]), strict=True))
        out = [b"".join([known[w] for w in words]) for words in split]
        if len(known) > REMEMBERED:
            self._known = {}
        return out

    def decode(self, ids: bytes) -> bytes:
        own = self.bytes_of
        return b"".join([own[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    """One codec for each worker process. ranks_file: a path, or the name of a file that Spark distributed."""
    key = (ranks_file, pattern)
    if key not in _codecs:
        with open(SparkFiles.get(ranks_file), "rb") as f:
            _codecs[key] = Codec(load_ranks(f.read()), pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = True, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (binary), ids_sha256,
    decoded_sha256, a row for each row. keep_ids=False leaves out the two binary columns (their digests stay).

    Each match of pattern is encoded apart, by ranks_path, without special tokens; ids are then decoded. A null text counts as
    empty: no ids, digests of nothing. Pieces of any length are encoded whole. Repeated and null doc_ids go through; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    spark.sparkContext.addFile(ranks_path)  # the executors may not have it
    name = ranks_path.rsplit("/", 1)[-1]
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.BinaryType()), ("decoded", T.BinaryType())] * 1 if keep_ids else []

    def run(batches):
        own = codec(name, pattern)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            size, k = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < shared.CHUNK_BYTES and end < len(texts):
                    continue
                ids = own.encode(texts[k:end])
                back = [own.decode(x) if decode else b"" for x in ids]
                columns = [batch.column(0).slice(k, end - k), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                columns += [pa.array(ids, pa.binary()), pa.array(back, pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])
                size, k = 0, end

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def production(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", F.col("decoded_sha256"))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return production(shared.read(spark, sf_dir, "documents"))
