"""What the operators of this subpackage share: intermediate tables in the shared folder, and numpy scanning of texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch and bytes of text that numpy works on at once; they bound a worker's memory, not results.
BATCH_ROWS, CHUNK_BYTES = 1000, 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True

#: Keys whose groups are taken out of a shuffle, and the least rows of such a group. As many rows at most are broadcast.
HOT_KEYS, HOT_ROWS = 4096, 64

_tables: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share. Where none is named, a local one if all run on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _local.get("folder") or f"file://{tempfile.mkdtemp(prefix='corpuslens-')}"
        _local["folder"] = at
    return at.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    """At the end of the process, when the session may have been stopped already."""
    for spark, path in _tables:
        try:
            drop_table(spark, path)
        except Exception:  # without a JVM, by pyarrow's file systems; if it doesn't open the folder, the cluster's own clean-up takes it
            with contextlib.suppress(Exception):
                fs, at = pafs.FileSystem.from_uri(path)
                fs.delete_dir(at)


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and its files outlive executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that table() wrote, once nothing reads them any more."""
    for df in tables:
        drop_table(df.sparkSession, df._written)
        _tables[:] = [x for x in _tables if x[1] != df._written]


def written() -> int:
    """How many tables there are now, for drop_since()."""
    return len(_tables)


def drop_since(mark: int, keep: DataFrame | None = None) -> None:
    """Deletes what was written since written() gave the mark, but for keep."""
    kept = keep._written if keep is not None else None
    for spark, path in _tables[mark:]:
        if path != kept:
            drop_table(spark, path)
    _tables[mark:] = [x for x in _tables[mark:] if x[1] == kept]


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with groups(key, n, ...), which has a row for each key with n rows; n isn't returned. The largest groups, HOT_KEYS at
    most, are broadcast to their rows, so no task gets such a group whole; the others meet by a shuffle. Both should be written tables."""
    hot = groups.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS)
    few = F.broadcast(hot.select(key))
    rest = rows.join(few, key, "left_anti").join(groups.join(few, key, "left_anti").drop("n"), key, how)
    return rows.join(F.broadcast(hot.drop("n")), key).select(*rest.columns).unionByName(rest)


def id_places(docs: DataFrame) -> Column:
    """Of docs' doc_id, a long that keeps its order and tells all values apart, with null after all others. It is doc_id itself, and the largest
    long for null, unless that is a doc_id too: then the ids above the largest free long move down by one."""
    top, step = (1 << 63) - 1, 1024
    doc_id = F.col("doc_id").cast("long")
    ids = docs.select(doc_id.alias("id"))
    seen = ids.agg(F.count_if(F.col("id").isNull()).alias("missing"), F.max("id").alias("most")).first()
    if not seen.missing or seen.most != top:
        return F.coalesce(doc_id, F.lit(top))
    free, end = None, top
    while free is None:
        taken = {r.id for r in ids.where(F.col("id").between(end - step + 1, end)).distinct().collect()}  # as many as a step at most
        free = next((x for x in range(end, end - step, -1) if x not in taken), None)
        end -= step
    return F.coalesce(F.when(doc_id > free, doc_id - 1).otherwise(doc_id), F.lit(top))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about CHUNK_BYTES; null is empty; a row is never cut."""
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of runs of symbols as differences of one prefix sum of symbol * base**place, brought to a common place by base**-place (mod 2**64)."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(size, base & (1 << 64) - 1, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._up[:n], self._down[:n]

    def runs(self, symbols: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of symbols[first:end] for each run; symbols are 64-bit."""
        up, down = self.powers(len(symbols) + 1)
        prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=prefix[1:])
        return (prefix[end] - prefix[first]) * down[first]


#: The bytes whose A-Z are a-z; and the masks of the first bytes of a long.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
WORD_KEY = b"words of a corpus"
_WORD_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[first:end]. Up to 16 bytes go through bijective finalisers as two longs, of which the second is 0 up to 8
    bytes; longer words through a keyed BLAKE2b, so that no structure of a word makes it meet another."""
    size = end - first
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    longs = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
    low = longs[first] & FIRST_BYTES[np.minimum(size, 8)]
    high = longs[first + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
    out = mix(low + size.astype(np.uint64) * _WORD_MIX[0]) + mix(high ^ _WORD_MIX[1])
    long = np.flatnonzero(size > 16)
    if len(long):
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(first[long].tolist(), end[long].tolist(), strict=True)]
        known = {w: hashlib.blake2b(w, digest_size=8, key=WORD_KEY).digest() for w in set(words)}
        out[long] = np.frombuffer(b"".join([known[w] for w in words]), np.uint64)
    return out


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word `[^\\x20\\x09-\\x0D]+`, and how many words stand before each row and the end."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    end = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    return first, end, np.searchsorted(first, offsets, "left")


def tidy() -> None:
    """Gives memory that a worker no longer needs back to the system; idle workers otherwise keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first().n
