"""Vector files as DataFrames (vec_id, v): .npy and .fvecs through Python data sources that split by byte ranges and write at byte offsets, and Parquet
list columns."""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpuslens.functions import scans
from corpuslens.operators import sampling

#: Bytes of a split, and of a batch.
SPLIT, BATCH = 32 << 20, 1 << 20
MAGIC = bytes([0x93]) + b"NUMPY"


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def npy_layout(f) -> tuple[int, np.dtype, bool, int, int]:
    """Where the numbers begin, their type, whether they go column by column, and the rows and columns of an open .npy file; anything but a matrix is an error."""
    if f.read(6) != MAGIC:
        raise ValueError("no .npy file")
    version = f.read(2)
    size = struct.unpack("<H", f.read(2))[0] if version[0] == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin-1"))
    if len(head["shape"]) != 2:
        raise ValueError(f"a matrix is needed, not an array of shape {head['shape']}")
    return f.tell(), np.dtype(head["descr"]), head["fortran_order"], *head["shape"]


def fvecs_layout(f) -> tuple[int, int]:
    """Rows and columns of an open .fvecs file, by its first row and its size."""
    size = f.size()
    if not size:
        raise ValueError("the file is empty")
    dim = struct.unpack("<i", f.read(4))[0]
    if dim <= 0:
        raise ValueError(f"a row can't have {dim} dimensions")
    if size % (4 * (dim + 1)):
        raise ValueError("the size is no whole number of rows")
    return size // (4 * (dim + 1)), dim


class Rows(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Rows]:
        with _open(self.path) as f:
            rows, width = self.shape(f)
        step = max(1, SPLIT // max(1, width))
        return [Rows(i, min(rows, i + step)) for i in range(0, rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            _, width = self.shape(f)
            step = max(1, (SPLIT if getattr(self, "by_column", False) else BATCH) // max(1, width))  # of a column, more at once
            for i in range(partition.first, partition.end, step):
                end = min(partition.end, i + step)
                v = self.block(f, i, end).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, end, dtype=np.int64)), lists], ["vec_id", "v"])


class NpyReader(_Reader):
    def shape(self, f):
        f.seek(0)
        self.start, self.kind, self.by_column, self.rows, self.dim = npy_layout(f)
        return self.rows, self.kind.itemsize * self.dim

    def block(self, f, first: int, end: int) -> np.ndarray:
        size = self.kind.itemsize
        read = lambda at, n: np.frombuffer(f.read_at(n * size, self.start + at * size), self.kind)
        if self.by_column:  # a range of each column
            return np.column_stack([read(c * self.rows + first, end - first) for c in range(self.dim)]) if self.dim else np.zeros((end - first, 0))
        return read(first * self.dim, (end - first) * self.dim).reshape(-1, self.dim)


class FvecsReader(_Reader):
    def shape(self, f):
        f.seek(0)
        rows, self.dim = fvecs_layout(f)
        return rows, 4 * (self.dim + 1)

    def block(self, f, first: int, end: int) -> np.ndarray:
        f.seek(first * 4 * (self.dim + 1))
        raw = np.frombuffer(f.read((end - first) * 4 * (self.dim + 1)), "<i4").reshape(-1, self.dim + 1)
        if (raw[:, 0] != self.dim).any():
            raise ValueError("rows differ in their dimensions")
        return raw[:, 1:].copy().view("<f4")


class Placed(DataSourceArrowWriter):
    """Writes rows (place, v) of 32-bit numbers at their places in a file of known size, which is put in its place when all rows are there. The
    folder must be one that the driver and the executors share."""

    def __init__(self, path: str, start: int, rows: int, dim: int, counted: bool):
        self.path, self.start, self.rows, self.dim, self.counted = path, start, rows, dim, counted

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        width, n = 4 * (self.dim + self.counted), 0
        at = os.open(f"{self.path}.part", os.O_WRONLY)
        try:
            for batch in iterator:
                place, v = np.asarray(batch.column(0), np.int64), batch.column(1)
                if (pc.list_value_length(v).to_numpy(False) != self.dim).any():
                    raise ValueError(f"a row doesn't have {self.dim} dimensions")
                x = np.asarray(v.flatten(), "<f4").reshape(-1, self.dim)
                if self.counted:
                    x = np.column_stack([np.full(len(x), self.dim, "<i4").view("<f4"), x])
                cuts = [0, *(np.flatnonzero(np.diff(place) != 1) + 1).tolist(), len(place)]
                for a, b in zip(cuts, cuts[1:], strict=False):  # rows that stand side by side
                    if a < b:
                        os.pwrite(at, np.ascontiguousarray(x[a:b]).tobytes(), self.start + int(place[a]) * width)
                n += len(place)
            os.fsync(at)
        finally:
            os.close(at)
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if (n := sum(m.rows for m in messages if m)) != self.rows:
            self.abort(messages)
            raise RuntimeError(f"{n} rows were written, not {self.rows}")
        os.replace(f"{self.path}.part", self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(f"{self.path}.part"):
            os.unlink(f"{self.path}.part")


@dataclass
class Written(WriterCommitMessage):
    rows: int


class _Source(DataSource):
    counted = False

    def schema(self) -> str:
        return "vec_id long, v array<float>"

    def writer(self, schema, overwrite: bool) -> Placed:
        o = self.options
        return Placed(o["path"], int(o["start"]), int(o["rows"]), int(o["dim"]), self.counted)


class NpySource(_Source):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def reader(self, schema):
        return NpyReader(self.options["path"])


class FvecsSource(_Source):
    counted = True

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def reader(self, schema):
        return FvecsReader(self.options["path"])


def load(spark: SparkSession, path: str, kind: str = "auto", column: str = "embedding", key: str | None = None) -> DataFrame:
    """vec_id, v of a .npy, .fvecs or Parquet file; kind auto goes by the suffix. Parquet takes one list column, and key as vec_id or else rows in order."""
    kind = path.rstrip("/").rpartition(".")[2].lower() if kind == "auto" else kind
    if kind in ("npy", "fvecs"):
        spark.dataSource.register(NpySource if kind == "npy" else FvecsSource)
        return spark.read.format(kind).load(path)
    if kind != "parquet":
        raise ValueError(f"the format {kind!r} is unknown; npy, fvecs and parquet are read")
    df = spark.read.parquet(path)
    return df.select(F.col(key).cast("long").alias("vec_id") if key else F.monotonically_increasing_id().alias("vec_id"), F.col(column).alias("v"))


def synthetic(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Normal vectors, each by its own generator, so that partitions don't matter."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            v = [np.random.default_rng([seed, i]).standard_normal(dim).astype(np.float32) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.list_(pa.float32()))], ["vec_id", "v"])

    return spark.range(rows).mapInArrow(run, "vec_id long, v array<float>")


def _write(df: DataFrame, path: str, kind: str) -> int:
    """Rows in the order of vec_id, written by the executors. The driver counts them, makes a file of the whole size and puts it in place at the end."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if size.a != size.b:
        raise ValueError(f"rows have {size.a} to {size.b} dimensions")
    dim = size.a or 0
    own = scans.running(df.select(F.lit(0).alias("all"), "vec_id", F.col("v").cast("array<float>").alias("v")), ["all"], "vec_id", {"place": ("sum", F.lit(1).cast("long"))})
    with open(f"{path}.part", "wb") as f:
        if kind == "npy":
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": (size.n, dim)})
        start = f.tell()
        f.truncate(start + size.n * 4 * (dim + (kind == "fvecs")))
    df.sparkSession.dataSource.register(NpySource if kind == "npy" else FvecsSource)
    try:
        placed = own.select((F.col("place") - 1).alias("place"), "v").sortWithinPartitions("place")
        placed.write.format(kind).mode("append").options(start=str(start), rows=str(size.n), dim=str(dim)).save(path)
    except BaseException:
        if os.path.exists(f"{path}.part"):
            os.unlink(f"{path}.part")
        raise
    return size.n


def write_fvecs(df: DataFrame, path: str) -> int:
    """One .fvecs file, in the order of vec_id, put in place whole; returns the rows. Rows of several lengths are an error."""
    return _write(df, path, "fvecs")


def write_npy(df: DataFrame, path: str) -> int:
    """One .npy file of 32-bit floats, in the order of vec_id, put in place whole; returns the rows. Rows of several lengths are an error."""
    return _write(df, path, "npy")


def sample_fvecs(spark: SparkSession, source: str, path: str, rows: int, seed: int = 42) -> int:
    """A .npy file of so many rows of an .fvecs file, drawn without replacement; more than it holds, or none, are an error."""
    if rows <= 0:
        raise ValueError("at least one row must be asked for")
    own = load(spark, source, "fvecs")
    if (n := own.count()) < rows:
        raise ValueError(f"{rows} rows were asked for; there are {n}")
    return write_npy(sampling.sample(own, rows, seed), path)


def sample_shards(spark: SparkSession, shards: list[str], rows: int, seed: int = 42, column: str = "openai") -> DataFrame:
    """vec_id, v: a sample without replacement over all Parquet shards in their order (all rows if there are fewer; 0 asks for all). Row counts come from the
    footers. A task reads one row group, for one column, and only those in which a drawn row lies are read."""

    def counted(batches):
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _open(path) as f:
                    footer = pq.ParquetFile(f).metadata
                n = [footer.row_group(g).num_rows for g in range(footer.num_row_groups)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int64()), pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int64())], ["shard", "part", "n"])

    listed = spark.createDataFrame(list(enumerate(shards)), "shard long, path string").repartition(len(shards), "shard")
    parts = listed.mapInArrow(counted, "shard long, part long, n long").orderBy("shard", "part").collect()  # a few numbers for each row group
    ends = np.cumsum([0, *[r.n for r in parts]])
    sent = spark.sparkContext.broadcast((ends, np.array([(r.shard, r.part) for r in parts], np.int64).reshape(-1, 2), shards))

    def placed(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            own = np.searchsorted(sent.value[0], ids, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["vec_id", "own"])

    def read(table: pa.Table) -> pa.Table:
        ends, parts, paths = sent.value
        own = table.column("own")[0].as_py()
        shard, part = parts[own].tolist()
        rows = pc.subtract(table.column("vec_id"), int(ends[own])).combine_chunks()
        with _open(paths[shard]) as f:
            v = pq.ParquetFile(f).read_row_group(part, columns=[column]).column(0).combine_chunks()
        return pa.table([table.column("vec_id"), v.take(rows).cast(pa.list_(pa.float32()))], ["vec_id", "v"])

    drawn = sampling.sample(spark.range(int(ends[-1])).withColumnRenamed("id", "vec_id"), rows, seed)
    return drawn.mapInArrow(placed, "vec_id long, own long").groupBy("own").applyInArrow(read, "vec_id long, v array<float>")


#: The corpora's dimensions, metrics, containers, where the public files are, the data set or column in them, and default subset sizes.
FAMILIES = [
    ("sift", 128, "l2", "hdf5", "http://ann-benchmarks.com/sift-128-euclidean.hdf5", "train", [250_000, 1_000_000]),
    ("gist", 960, "l2", "hdf5", "http://ann-benchmarks.com/gist-960-euclidean.hdf5", "train", [250_000, 1_000_000]),
    ("deep", 96, "angular", "hdf5", "http://ann-benchmarks.com/deep-image-96-angular.hdf5", "train", [250_000, 1_000_000]),
    ("glove", 100, "angular", "hdf5", "http://ann-benchmarks.com/glove-100-angular.hdf5", "train", [250_000, 1_000_000]),
    ("nytimes", 256, "angular", "hdf5", "http://ann-benchmarks.com/nytimes-256-angular.hdf5", "train", [250_000, 1_000_000]),
    ("openai", 1536, "angular", "parquet", "KShivendu/dbpedia-entities-openai-1M", "openai", [250_000]),
]


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "name string, dim int, metric string, container string, origin string, key string, default_rows array<int>")
