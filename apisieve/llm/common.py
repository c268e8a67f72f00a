"""What the corpus operators share: scratch tables in the shared folder, batch limits, hashing of words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder

#: Rows and bytes of one Arrow batch handed to Python; whole texts can be long, so both are bounded.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Bytes of text that the numpy code works on at a time.
SLICE_BYTES = 1 << 20

_SCRATCH: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to ours; limits that are lower already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most or int(now) == 0:
            spark.conf.set(key, str(most))


def scratch_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path in the shared folder, removed by clear_scratch() (unless keep) or when the session's JVM ends."""
    path = f"{shared_folder(spark)}/apisieve-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if not keep:
        _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove this session's scratch tables; DataFrames that still read them can't be used any more."""
    jvm = spark.sparkContext._jvm
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: From here on the optimizer's estimate stands for a size that it doesn't know.
_UNKNOWN = 1 << 60


def text_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of docs' size, from file sizes and without a job; where it knows none, the texts' bytes, counted."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < _UNKNOWN:
        return known
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


# ---------------------------------------------------------------- numpy text kernels

_MIX = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        m = max(n, SLICE_BYTES + (1 << 16))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(m, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_slices(column):
    """(first row, bytes, offsets) for runs of whole texts of about SLICE_BYTES; null counts as empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space; with lower, A-Z in lower case) of the texts data[at[i]:at[i + 1]], and where each text's words begin."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIX[LOWER[data] if lower else data] * up, out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(starts, at)
