"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside Arrow batches: ``bytes.split()`` and
``bytes.strip()`` use exactly the six ASCII white-space characters
(``[\\x20\\x09-\\x0D]``) and ``bytes.lower()`` touches A-Z only, which is what
the operators' definitions ask for.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_base

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Texts are handed to the vectorised helpers in groups of about this many bytes.
CHUNK_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for all-ASCII texts; the others take ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, data): the id and the whole text as UTF-8 bytes; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("data"), *more)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of some MB: both sides hold whole batches outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def map_texts(docs: DataFrame, fn: Callable, schema: str, arrow_schema: pa.Schema,
              setup: Callable | None = None) -> DataFrame:
    """Run ``fn(ids, texts[, state])`` over groups of texts in Arrow batches.

    ``docs`` has (doc_id, data); ``fn`` returns a dict of columns. ``setup()``
    makes one state per task (caches, opened models).
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            ids, data = b.column(0), b.column(1)
            ends = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < len(ids):  # slices, so that only one group's texts are Python objects
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
                args = (ids.slice(start, stop - start).to_pylist(), data.slice(start, stop - start).to_pylist())
                out = fn(*args, state) if setup else fn(*args)
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)
                start = stop
    return docs.mapInArrow(run, schema)


def bounded_sample(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The ``limit`` rows of smallest key hash.

    A share of the hash range that holds about twice as many is cut out
    first, so that the final sort meets few rows from however many tasks.
    """
    h = F.xxhash64(key)
    n = rows.count()
    if n > 4 * limit:
        rows = rows.where(h < F.lit(int(-2**63 + 2**64 * (2 * limit / n))))
    return rows.orderBy(h, *rows.columns).limit(limit)


_REMEMBERED: dict[str, Callable[[], None]] = {}


def claim_memory(name: str = "", forget: Callable[[], None] = lambda: None) -> None:
    """Make ``name`` (or none) the only operator that remembers values in this worker process.

    Workers are used again by other operators; what those had remembered is
    forgotten first.
    """
    for other in [k for k in _REMEMBERED if k != name]:
        _REMEMBERED.pop(other)()
    _REMEMBERED[name] = forget


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset in a single
    process (tests) a folder beside the warehouse is used; on a cluster a
    missing setting is an error.
    """
    return f"{checkpoint_base(spark)}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, name: str, folder: str, col: str) -> DataFrame:
    """As ``written``, in as many buckets of ``col`` as a shuffle has partitions: joins by it leave the frame where it is."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", f"{folder}/{name}")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), col).saveAsTable(table))
    frame = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name only: the files are the folder's
    return frame


def drop_tables(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables that ``written`` made in an operator's own folder, once nothing reads them any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)


def local_path(url: str) -> str:
    """The mounted path of a ``file:`` folder, where tasks can open and memory-map files."""
    if url.startswith("file:"):
        url = "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"{url}: memory-mapped files need a shared folder that is mounted (file:)")
    return os.path.normpath(url)


# -- blocks of texts: rows that ask shards of a key space and get their answers back by block id --------------------

#: Texts are written in blocks of about this many bytes, or as many as an operator says (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20

_BLOCKS = pa.schema([("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("n_bytes", pa.int64())])


def _to_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    ids, texts, size = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"ids": [np.array(ids, np.int64).tobytes()], "sizes": [np.array([len(t) for t in texts], np.int64).tobytes()],
             "data": [zstandard.compress(b"".join(texts), 3)], "n_bytes": [size]}, schema=_BLOCKS)
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            t = t.as_py()
            if size and size + len(t) > block_bytes:
                yield block()
                ids, texts, size = [], [], 0
            ids.append(i.as_py())
            texts.append(t)
            size += len(t)
    if ids:
        yield block()


def text_blocks(rows: DataFrame, folder: str, block_bytes: int | None = None, buckets: bool = False) -> DataFrame:
    """(doc_id, data) rows, none of them null, written as (block, ids, sizes, data, n_bytes): compressed texts end to end.

    ``buckets``: in buckets of ``block``, so that answers come to the blocks and the texts are not shuffled.
    """
    size = block_bytes or BLOCK_BYTES
    blocks = (rows.mapInArrow(lambda batches: _to_blocks(batches, size), "ids binary, sizes binary, data binary, n_bytes long")
              .withColumn("block", F.monotonically_increasing_id()))
    return written_in_buckets(blocks, "blocks", folder, "block") if buckets else written(blocks, "blocks", folder)


def join_answers(blocks: DataFrame, answers: DataFrame, *cols: str) -> DataFrame:
    """Blocks with the list of their shards' answers: at most one for each shard."""
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("shard", *cols)).alias("answers"))
    return blocks.join(lists, "block", "left")


def pack_numbers(a: np.ndarray) -> bytes:
    """A number column, byte planes apart, compressed."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.compress(planes.tobytes(), 1)


def unpack_numbers(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)
