"""Helpers shared by the corpus operators: inputs, shared-folder stashes, packed blocks."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are broadcast to thin out a table of texts before a join: about 0.2 GB as a hash relation at this bound.
BROADCAST_IDS = 1 << 22


def only(docs: DataFrame, ids: DataFrame, n: int, col: str) -> DataFrame:
    """docs' rows whose col may be among the n ids: exactly those while n ids may be broadcast, all beyond that. An exact join must follow."""
    return docs.join(F.broadcast(ids.select(col)), col, "left_semi") if n <= BROADCAST_IDS else docs


def without(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """docs' rows whose col is not among the ids (a written table of distinct values); the ids are broadcast while they are few enough."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, col, "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key() -> Column:
    """What tells rows apart: a hash of id and text. Only repeated rows share it; null ids and texts have one too."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


#: Word of the corpus contracts: a maximal run of anything but space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Rows and bytes that pass to Python at once, which bounds the JVM's direct memory and the worker; a longer text goes alone.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's batch sizes where they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    now = spark.conf.get(size)
    if now in ("67108864b", "-1") or now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temp folder only where none is set and the session runs in one JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/crossgauge-checkpoints-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: nothing left to clean with
        pass


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files go when a query ends: behind a written table, or one that was fetched, they are of no more use."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


#: Bytes of input behind each file of a table of texts.
FILE_BYTES = 40 << 20


def fewer_files(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df, made from docs, in about a partition for each FILE_BYTES that docs takes (by Spark's own estimate), and one for each core at least.

    Small splits then don't become small files. On a mounted folder each file also costs a process that Hadoop starts
    to set its mode, and which counts with the JVM's whole memory until it runs.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(1 << 30, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))))


#: Narrow rows (ids, counts) that go into one file of a stash.
ROWS_A_FILE = 500_000


def stash(df: DataFrame, name: str = "stash", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, a lost executor loses nothing.

    rows: a bound on the rows of a narrow table, from which its last stage gets as many tasks as it needs files.
    Files go when the session's Python process ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a row group of a table that Python workers write.
ROW_GROUP = 8 << 20


def stash_map(df: DataFrame, f, schema: str, name: str = "stash") -> DataFrame:
    """stash(df.mapInArrow(f, schema)), but the Python workers write their Parquet files themselves where the shared folder is a mounted one.

    That spares the way back into the JVM. Every attempt of a task writes a file of its own; the files of the attempts
    that ended well (one at most for each task) are the table, so a lost executor or a repeated task adds nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    root = urlparse(shared_dir(spark))
    if root.scheme not in ("", "file"):
        return stash(df.mapInArrow(f, schema), name)
    small_batches(spark)
    folder, kind = f"{root.path}/{name}-{uuid.uuid4().hex}", to_arrow_schema(StructType.fromDDL(schema))
    os.makedirs(folder)

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        path, kept = f"{folder}/part-{uuid.uuid4().hex}.parquet", []
        writer = None

        def flush():
            nonlocal writer, kept
            writer = writer or pq.ParquetWriter(path, kind, use_dictionary=False)
            writer.write_table(pa.Table.from_batches(kept))
            kept = []

        for out in f(batches):
            if out.num_rows:
                kept.append(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(out.columns, kind, strict=True)], schema=kind))
                if sum(b.nbytes for b in kept) >= ROW_GROUP:
                    flush()
        if kept:
            flush()
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([path])], names=["path"])

    with freed_shuffles(spark):
        paths = [r["path"] for r in df.mapInArrow(write, "path string").collect()]
    atexit.register(_delete, spark, folder)
    read = spark.read.schema(schema)
    return read.parquet(*(f"file://{x}" for x in paths)) if paths else spark.createDataFrame([], schema)


def unstash(df: DataFrame) -> None:
    """Delete the files behind a stashed frame that is no longer read."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, f)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
#: Powers that a worker keeps; those for a longer text are made for it alone.
KEPT_POWERS = (1 << 19) + 1024
_POW: np.ndarray | None = None
_INV: np.ndarray | None = None
_VAL = mix64(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _POW, _INV
    if _POW is not None and len(_POW) >= n:
        return _POW[:n], _INV[:n]
    size = max(n, KEPT_POWERS)
    inv = np.uint64(pow(_BASE, -1, 1 << 64))
    pw, iv = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (_BASE, inv))
    if size == KEPT_POWERS:
        _POW, _INV = pw, iv
    return pw[:n], iv[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[j]-S[i] times base**-i the polynomial hash of data[i:j]."""
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VAL[data] * pw[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    return mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def string_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    buf = col.buffers()
    off = np.frombuffer(buf[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, end) of every word of the concatenated texts; documents never share a word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    per_doc = np.diff(np.searchsorted(start, off))
    return np.repeat(np.arange(len(off) - 1), per_doc), start, end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document index, start, end) of every word, A-Z lower-cased."""
    doc, start, end = word_spans(data, off)
    return span_hash(prefix_hash(_LOWER[data]), start, end), doc, start, end


#: Bytes of text that the numpy steps take at once: their arrays (8 bytes a byte, some of them) stay small and in cache.
CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, or nothing to call where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def chunks(col, limit: int = CHUNK):
    """Row ranges of an Arrow string column of about `limit` bytes each (a longer row stands alone).

    After the last one the process gives freed memory back: workers are reused, and what one task's arrays took would
    stay with them.
    """
    _, off = string_bytes(col)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j
        i = j
    _trim()(0)
