"""Corpus-wide line deduplication that returns keep bitmaps instead of text.

Every line's 128-bit key hash is range-partitioned and sorted by (hash,
document, position). A run of one hash then streams by with its smallest
document first: that document's lines stay, all later ones are dropped. Rows
are dealt by (hash, document), so a line that a third of all documents share
is cut over many tasks; a run that goes on in the next partition is settled
by one boundary row per partition (as many as there are partitions, whatever
the input).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_bytes, work_dir, written

MIN_CHARS = 10

_KEYS = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("pos", pa.int32())])
# kind 0: a dropped line; 1: a line of the partition's first run; 2: the partition's bounds
_STREAM = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32()),
                     ("part", pa.int32()), ("first_h", pa.binary()), ("last_h", pa.binary()),
                     ("first_doc", pa.int64()), ("last_doc", pa.int64())])
_STREAM_DDL = ("kind int, doc_id long, pos int, part int, first_h binary, last_h binary, "
               "first_doc long, last_doc long")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def code_points(data: bytes) -> int:
    """Code points of valid UTF-8: all bytes but continuation bytes."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or code_points(key) >= min_chars)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, doc_id, pos) of every line whose key has at least ``min_chars`` code points. ``docs``: (doc_id, data)."""
    def keys(ids, texts):
        h, d, p = [], [], []
        for i, t in zip(ids, texts):
            for n, line in enumerate(t.split(b"\n")):
                k = line_key(line)
                if _long_enough(k, min_chars):
                    h.append(hashlib.blake2b(k, digest_size=16).digest())
                    d.append(i)
                    p.append(n)
        return {"h": h, "doc_id": d, "pos": p}
    return map_texts(docs, keys, "h binary, doc_id long, pos int", _KEYS)


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk one partition's sorted rows; only the current run's hash and first document are held."""
    run_h = run_doc = first_h = first_doc = part = None
    for b in batches:
        if not b.num_rows:
            continue
        hs, ds, ps = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        kind, doc, pos = [], [], []
        if part is None:
            part, first_h, first_doc = b.column(3)[0].as_py(), hs[0], ds[0]
        for h, d, p in zip(hs, ds, ps):
            if h != run_h:
                run_h, run_doc = h, d
            if h == first_h:
                kind.append(1)
            elif d != run_doc:
                kind.append(0)
            else:
                continue
            doc.append(d)
            pos.append(p)
        n = len(kind)
        yield pa.RecordBatch.from_pydict(
            {"kind": kind, "doc_id": doc, "pos": pos, "part": [part] * n, "first_h": [None] * n,
             "last_h": [None] * n, "first_doc": [None] * n, "last_doc": [None] * n}, schema=_STREAM)
    if part is not None:
        yield pa.RecordBatch.from_pydict(
            {"kind": [2], "doc_id": [None], "pos": [None], "part": [part], "first_h": [first_h],
             "last_h": [run_h], "first_doc": [first_doc], "last_doc": [run_doc]}, schema=_STREAM)


def first_holders(bounds: list[tuple]) -> list[tuple[int, int]]:
    """(part, smallest document holding the hash of the partition's first run).

    ``bounds``: (part, first_h, last_h, first_doc, last_doc) of each partition.
    """
    out, run_h, run_doc = [], None, None
    for part, first_h, last_h, first_doc, last_doc in sorted(bounds, key=lambda r: r[0]):
        holder = run_doc if first_h == run_h else first_doc
        out.append((part, holder))
        run_doc = holder if last_h == first_h else last_doc
        run_h = last_h
    return out


def dropped_lines(keys: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, pos) of every line whose key a document with a smaller id holds as well."""
    spark = keys.sparkSession
    dealt = (keys.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "pos")
             .withColumn("part", F.spark_partition_id()))
    streamed = written(dealt.mapInArrow(_stream, _STREAM_DDL), "lines", folder)
    bounds = [(r.part, bytes(r.first_h), bytes(r.last_h), r.first_doc, r.last_doc)
              for r in streamed.where("kind = 2").select("part", "first_h", "last_h", "first_doc", "last_doc").collect()]
    holders = spark.createDataFrame(first_holders(bounds), "part int, holder long")
    lead = (streamed.where("kind = 1").join(F.broadcast(holders), "part")  # one row for each partition
            .where("doc_id != holder").select("doc_id", "pos"))
    return streamed.where("kind = 0").select("doc_id", "pos").unionByName(lead)


def keep_bitmap(positions: list[int]) -> bytes:
    """Compressed bitmap, bit n set: line n stays. Lines beyond its end stay too."""
    bits = np.ones((max(positions) // 8 + 1) * 8, np.uint8)  # whole bytes
    bits[positions] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def dropped_positions(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    if bitmap is None:
        return np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return np.flatnonzero(bits[:n_lines] == 0)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               folder: str | None = None) -> DataFrame:
    """(doc_id, n_dropped, keep_bitmap) of the documents that lose lines.

    A line's key is the line without white space at both ends, A-Z
    lower-cased. Keys of ``min_chars`` code points or more that are in
    several documents stay only in the one with the smallest id, there in all
    their lines. Null and empty texts are one empty line, which is too short
    to be dropped. Ids identify documents: rows that repeat one are marked
    alike. Rows without an id neither drop lines nor lose any. An empty table
    gives an empty result; other columns are ignored.
    """
    keys = line_keys(text_bytes(docs, id_col, text_col).where("doc_id IS NOT NULL"), min_chars)
    drops = dropped_lines(keys, folder or work_dir(docs.sparkSession))

    def bitmaps(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "n_dropped": [len(set(x)) for x in lists],
                 "keep_bitmap": [keep_bitmap(x) for x in lists]},
                schema=pa.schema([("doc_id", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary())]))
    # a document's list is bounded by its own lines
    return (drops.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
            .mapInArrow(bitmaps, "doc_id long, n_dropped long, keep_bitmap binary"))


def apply_bitmap(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines) of one text."""
    n = text.count(b"\n") + 1
    gone = dropped_positions(bitmap, n)
    if not len(gone):
        return text, n, 0
    gone_set = set(gone.tolist())
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone_set), n, len(gone)


def with_kept(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every document; kept: the remaining lines as UTF-8 bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
                        ("kept", pa.binary())])

    def apply(batches):
        for b in batches:
            done = [apply_bitmap(t, m) for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "n_lines": [x[1] for x in done], "n_dropped": [x[2] for x in done],
                 "kept": [x[0] for x in done]}, schema=schema)
    joined = text_bytes(docs, id_col, text_col).join(bitmaps.select("doc_id", "keep_bitmap"), "doc_id", "left")
    return (joined.select("doc_id", "data", "keep_bitmap")
            .mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept binary"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM l),
m AS (SELECT *, length(line_key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY line_key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
