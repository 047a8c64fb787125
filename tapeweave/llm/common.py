"""What the text operators share: session settings, shared tables, id ranges, word hashing.

Conventions of every operator in this subpackage:

* a null text counts as an empty text, a null id is kept as null;
* rows are never merged or dropped because an id repeats: repeated rows come back repeated;
* extra columns of the input are ignored unless an operator says that it carries them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a temporary
    one on a local master; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tapeweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tapeweave/{label}-{uuid.uuid4().hex}"


#: Spark's switch for removing a query's shuffle files when the query is over.
CLEARED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when the write is over, not when the driver happens to collect its
    garbage. For writes only: rows that are still being fetched when an action returns would be gone."""
    before = spark.conf.get(CLEARED, "false")
    spark.conf.set(CLEARED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEARED, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, lost executors don't matter."""
    path = shared_path(df.sparkSession, label)
    with shuffles_cleared(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Gives `stored` for tables that are deleted at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, label: str, *folders: str) -> DataFrame:
        paths.append(shared_path(spark, label))
        with shuffles_cleared(spark):
            df.write.partitionBy(*folders).parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep_batches_small(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session's Arrow batches have at most so many rows: for results that carry whole
    texts through Python and are computed later, when `small_batches` is over."""
    now = int(spark.conf.get(BATCH_ROWS))
    if not 0 < now <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs run inside; rows that carry whole texts or
    sets would else fill an executor's memory beside its heap."""
    before = spark.conf.get(BATCH_ROWS)
    keep_batches_small(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def apart(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` with all columns but `keep` under names that clash with nothing, and what takes a frame with
    these columns to their old names and order, with the columns `more` behind them."""
    names = docs.columns
    inner = [n if n in keep else f"column{i}__" for i, n in enumerate(names)]

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*inner, *more).toDF(*names, *more)

    return docs.toDF(*inner), back


LOWEST = np.iinfo(np.int64).min


def range_cuts(df: DataFrame, key: str, ranges: int) -> np.ndarray:
    """At most `ranges` - 1 ascending cuts of `key` that split its rows evenly; null counts as the lowest
    number. A value with more rows than a range holds is a cut several times."""
    if ranges < 2:
        return np.empty(0, np.int64)
    cuts = [i / ranges for i in range(1, ranges)]
    value = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    found = df.agg(F.percentile_approx(value, cuts, max(10_000, 4 * ranges)).alias("b")).first()["b"]
    return np.array(found or [], np.int64)


def range_of(cuts: np.ndarray, keys: pa.Array, part: np.ndarray) -> np.ndarray:
    """The range of each key. A key that is a cut k times fills k ranges, dealt by `part` (32-bit hashes of
    the rest of the row), so ranges ascend by (key, part)."""
    value = keys.fill_null(LOWEST).to_numpy(zero_copy_only=False)
    below = np.searchsorted(cuts, value, "left")
    times = np.searchsorted(cuts, value, "right") - below
    return below + (times > 0) + (np.asarray(part, np.int64) * times >> 32)


# --- Arrow batches -------------------------------------------------------------------------------


def text_steps(batch: pa.RecordBatch, column: str, step_bytes: int = STEP_BYTES, step_rows: int = 512) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets) for runs of rows of about `step_bytes`."""
    whole = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(whole), step_rows):
        col = whole.slice(at, step_rows).cast(pa.large_string()).fill_null("")
        n = len(col)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int64, n + 1 + col.offset)[col.offset :]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + step_bytes, "right")) - 1)
            yield at + lo, at + hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def by_doc(values: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and count, for each of n documents, of entries whose ascending owner is `of`."""
    first = np.searchsorted(of, np.arange(n + 1))
    return first[:-1], np.diff(first)


# --- words and hashes ----------------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Bytes of words: anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: ASCII digits, lower-case letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1024) * 2, _BASE, np.uint64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts, A-Z lower-cased if `fold`: (64-bit hash, owner row, start byte, end byte) each."""
    empty = np.empty(0, np.int64)
    if not len(data):
        return empty.astype(np.uint64), empty, empty, empty
    low = _FOLD[data] if fold else data
    inside = table[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # a text's first byte starts a word whatever came before
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty
    stops = np.ones(len(data), bool)
    stops[:-1] = ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(inside & stops) + 1
    size = ends - starts
    at = np.cumsum(size) - size
    body = low[inside]
    place = np.arange(len(body)) - np.repeat(at, size)
    with np.errstate(over="ignore"):
        code = np.add.reduceat(_BYTE[body] * _power_table(int(size.max()))[place], at)
    owner = np.searchsorted(offsets, starts, "right") - 1
    return mix(code), owner, starts, ends


_STEP = np.cumprod(np.full(64, np.uint64(0xD6E8FEB86659FD93), np.uint64))


def grams(code: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (order counts); shorter by k - 1 than `code`."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += code[j : j + n] * _STEP[j]
    return mix(out)


def sliding_min_last(x: np.ndarray, w: int) -> np.ndarray:
    """For every window of w entries, the index of its smallest entry, the last one on ties."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(n)
    for j in range(1, w):
        other = np.arange(j, j + n)
        best = np.where(x[other] <= x[best], other, best)
    return best
