"""Helpers shared by the training-data operators.

Nothing here depends on the rest of the package, and nothing in the rest of
the package depends on this subpackage.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker tokenises at a time.  It bounds the
#: worker's memory; one longer document is a piece of its own.
PIECE_BYTES = 2 << 20
#: Rows of a piece at most.
PIECE_ROWS = 20_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the session sets it.  Only a local
    master may do without; it gets a temporary folder.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tagmeter-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_PACKED = {
    "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4",
    "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "4",
}


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """While it lasts, Python workers get few rows at a time: a batch of rows
    with blobs would else be as large as an input split."""
    told = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, told)


def table(df: DataFrame, name: str, packed: bool = False, blobs: bool = False) -> DataFrame:
    """Write *df* to the shared folder and read it back.  *packed*: its rows
    are blobs, which no dictionary would shorten and few of which make a page.
    *blobs*: it is made from such rows.

    It cuts the lineage: losing an executor later costs a read, not a
    recomputation, and row positions become stable.  The folders are removed
    at the end of the scope around it, or when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    with small_batches(spark) if blobs else contextlib.nullcontext():
        (df.write.options(**_PACKED) if packed else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


class scratch:
    """A scope for tables: those written inside go at its end, but for the
    ones that ``keep`` names, which a result still reads."""

    def __enter__(self) -> scratch:
        self.begin, self.kept = len(_made), set()
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.kept_at)
        return df

    def __exit__(self, *_) -> None:
        own, _made[self.begin :] = _made[self.begin :], [x for x in _made[self.begin :] if x[1] in self.kept]
        for spark, path in own:
            if path not in self.kept:
                _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Remove a table that nothing reads any more; other frames stay."""
    path = getattr(df, "kept_at", None)
    for entry in [x for x in _made if x[1] == path]:
        _made.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _delete(spark, path)
    _made.clear()


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most about PIECE_BYTES of *column*."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        which = np.cumsum(size, dtype=np.int64) // PIECE_BYTES + np.arange(batch.num_rows) // PIECE_ROWS
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system.  A worker lives on after its task, and
    what it held would else count while others, or none, have work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_pieces(df: DataFrame, make: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text") -> DataFrame:
    """Apply *make* to pieces of *df*; it returns arrays by name of *schema*."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = got = None
        try:
            for piece in pieces(batches, column):
                got = make(piece)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([_as(got[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            piece = got = None
            give_back()

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind, from_pandas=False)


def texts(piece: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [x or b"" for x in piece.column(column).cast(pa.binary()).to_pylist()]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), on uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    known: dict[bytes, int] = {}
    get, one = known.get, xxhash.xxh3_64_intdigest
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            known[w] = h = one(w)
        out[i] = h
    return out


#: An odd factor for each level of doubling.
_FACTORS = mix64(np.arange(1, 40, dtype=np.uint64)) | np.uint64(1)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of *n* consecutive hashes.

    Windows of 1, 2, 4, ... come by doubling; those of n from the ones that
    its binary digits name.  Each level has a factor of its own, so that order
    counts.
    """
    m = len(h) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    power, width, level = h, 1, 0
    out, done = None, 0
    while True:
        if n & width:
            part = power[done : done + m]
            out = part if out is None else out * _FACTORS[20 + level] + part
            done += width
        if done == n:
            return mix64(out)
        longer = power[:-width] * _FACTORS[level]
        longer += power[width:]
        power, width, level = longer, 2 * width, level + 1


#: Rows of ids that may be broadcast, of some tens of bytes each; what has
#: more goes through a shuffled join.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, name: str) -> DataFrame:
    """*df* as a table, marked for broadcast if it has at most SMALL_ROWS."""
    from pyspark.sql import functions as F

    df = table(df, name)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
