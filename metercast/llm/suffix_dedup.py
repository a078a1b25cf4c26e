"""Removal of byte strings that an earlier document holds as well, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id. Each window of that length has one designated
gram (the smallest hash of its 24-byte grams), which depends on the window
alone: equal windows of different documents meet at the hash of their gram.

1. Documents are written in blocks of about 4 MB. Each block sends the hashes
   of its designated grams, each once, to the hash's shard; the shard answers
   with a bitmap of those that several documents hold, and of the hot ones
   among them: those with more than ``HOT_SEGMENTS`` segments, summed over the
   blocks. Windows of a hot gram go on by the hash of the whole window: blocks
   ask the window hashes' shards which of them several documents hold.
2. Each block sends the byte segments around the shared grams (all windows that
   designate one, each distinct segment once, with its smallest document) to
   the shard; of a hot gram, each shared window is a segment of its own, in a
   piece of the shard of its own hash. There a suffix array over the distinct segments that
   have a window hash in common with others of their gram's, by induced sorting,
   and its permuted common prefixes group the equal windows;
   the shard answers with the smallest document of each window.
3. Each block marks the bytes of the windows that have a smaller document.

Segments at the edges of a shared passage reach into each document's own text
and differ. A gram that isn't hot brings ``HOT_SEGMENTS`` of them to its shard
at most; a window of a hot one brings one entry for each block, not one for
each document. Questions and answers are joined by block id, which is unique;
blocks lie in buckets of it, so that their texts are not shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, join_answers, pack_numbers, text_blocks, text_bytes, unpack_numbers, work_dir, written
from .suffix_arrays import permuted_prefixes, suffix_array

LENGTH = 50
GRAM = 24
#: Bytes of text for each block, and for each shard of gram hashes. A block sends a row to every shard.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
#: Segment bytes that are indexed by one suffix array; a gram's segments stay together.
INDEX_BYTES = 512 << 10
#: Segments of a gram, each block's distinct ones summed, beyond which its windows are dealt by their own hashes. (So
#: many segments of LENGTH and GRAM are less than a MB.)
HOT_SEGMENTS = 12_288
#: Bytes of hot grams' shared windows for each piece of a shard.
PIECE_BYTES = 4 << 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_HASH_BITS = 48
_PLACE_BITS = 23


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the runs of equal numbers."""
    cuts = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else np.zeros(0, np.int64)
    return a[cuts], np.diff(cuts, append=len(a)).astype(np.int32)


def _inside(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0] - 1, 0, 1, .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


# -- designated grams ---------------------------------------------------------
def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes at each place, from the eight bytes at each place (the last eight may overlap)."""
    words = np.empty(len(data) - 7, np.uint64)
    raw = data.tobytes()
    for k in range(min(8, len(words))):
        words[k::8] = np.frombuffer(raw, "<u8", len(words[k::8]), k)
    n = len(data) - gram + 1
    out = words[:n] * _ODD[0]
    for j, at in enumerate([*range(8, gram - 8, 8), gram - 8]):
        out ^= out >> np.uint64(31)
        out += words[at:at + n]
        out *= _ODD[1 + j % 5]
    out ^= out >> np.uint64(29)
    out *= _ODD[2]
    out ^= out >> np.uint64(32)
    return out


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    return np.minimum(v[:len(v) - (width - n)], v[width - n:]) if width > n else v


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes mixed once more. The smallest of a window's hashes crowd near 0; shards are equal ranges of what this returns."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(31))


def designated(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, first window, windows, text number) of each run of windows with one designated gram.

    ``data`` holds the texts end to end; windows never cross them.
    """
    ends = np.cumsum(sizes)
    whole = np.ones(max(0, len(data) - length + 1), bool)  # windows inside one text
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        whole[max(a, b - length + 1):b] = False
    out = []
    step = 1 << 19
    for a in range(0, len(whole), step):
        part = data[a:a + step + length - 1]
        h = gram_hashes(part, gram)
        v = ((h >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        best = _window_min(v, length - gram + 1)
        start = np.flatnonzero(whole[a:a + step])
        best = best[start]
        new = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)))) if len(best) else start
        place = (best[new] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = start[new] + a
        out.append((_spread(h[place]) >> np.uint64(64 - _HASH_BITS), first, np.diff(new, append=len(best)),
                    np.searchsorted(ends, first, side="right")))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def window_hashes(data: np.ndarray, first: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Hash of the ``length`` bytes at each of the ascending places ``first``."""
    out = np.empty(len(first), np.uint64)
    step = 1 << 19
    for a in range(0, len(data), step):
        p, q = np.searchsorted(first, (a, a + step))
        if q > p:
            out[p:q] = gram_hashes(data[a:a + step + length - 1], length)[first[p:q] - a]
    return out >> np.uint64(64 - _HASH_BITS)


def _several(which: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
    """Of each of ``n`` numbers: whether it comes with several documents."""
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, which, doc)
    np.maximum.at(high, which, doc)
    return low != high


class Block:
    """A block's texts and its runs of windows."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes, length: int, gram: int, shards: int, pieces: int = 1):
        claim_memory()
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = zstandard.decompress(data)
        self.length = length
        self.hash, self.first, self.windows, self.text = designated(np.frombuffer(self.data, np.uint8), self.sizes, length, gram)
        self.hashes, self.which = np.unique(self.hash, return_inverse=True)
        self.shards, self.pieces = shards, pieces

    def by_shard(self, hashes: np.ndarray):
        """(shard, first, stop) of each shard that has some of the sorted hashes: a shard is a range of hashes."""
        at = np.searchsorted(hashes, [(k << _HASH_BITS) // self.shards for k in range(self.shards + 1)]).tolist()
        return [(k, p, q) for k, (p, q) in enumerate(zip(at[:-1], at[1:])) if q > p]

    def ask_grams(self) -> list[tuple]:
        """(shard, hashes, whether several of the block's documents hold them, numbers of distinct segments)."""
        flags, counts = _several(self.which, len(self.hashes), self.ids[self.text]), self.segment_counts()
        return [(k, pack_numbers(np.diff(self.hashes[p:q], prepend=np.uint64(0))), np.packbits(flags[p:q]).tobytes(),
                 pack_numbers(counts[p:q])) for k, p, q in self.by_shard(self.hashes)]

    def segment_counts(self) -> np.ndarray:
        """Of each distinct hash: how many distinct segments the block holds."""
        runs = np.flatnonzero(np.bincount(self.which, minlength=len(self.hashes))[self.which] > 1)
        first, stop = self.first[runs], self.first[runs] + self.windows[runs] + self.length - 1
        data = self.data
        found = {data[a:b]: w for a, b, w in zip(first.tolist(), stop.tolist(), self.which[runs].tolist())}
        counts = np.bincount(np.fromiter(found.values(), np.int64, len(found)), minlength=len(self.hashes))
        return np.maximum(counts, 1).astype(np.int32)

    def ask_windows(self, hot: list) -> list[tuple]:
        """(shard, hashes, whether several of the block's documents hold them) of the windows of hot grams.

        ``hot``: (shard, bitmap) of the hot grams.
        """
        _, h, doc = self.hot_windows(self.flags(self.hashes, hot))
        hashes, which = np.unique(h, return_inverse=True)
        flags = _several(which, len(hashes), doc)
        return [(k, pack_numbers(np.diff(hashes[p:q], prepend=np.uint64(0))), np.packbits(flags[p:q]).tobytes())
                for k, p, q in self.by_shard(hashes)]

    def hot_windows(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, hash, document) of each window that designates a hot gram. ``hot``: of each distinct hash."""
        runs = np.flatnonzero(hot[self.which])
        n = self.windows[runs]
        first = np.repeat(self.first[runs], n) + _inside(n)
        return first, window_hashes(np.frombuffer(self.data, np.uint8), first, self.length), np.repeat(self.ids[self.text[runs]], n)

    def flags(self, hashes: np.ndarray, answers: list) -> np.ndarray:
        """Of each of the sorted hashes: its bit in the shards' bitmaps (none or a missing one: no)."""
        out = np.zeros(len(hashes), bool)
        found = {shard: bits for shard, bits in answers if bits is not None}
        for k, p, q in self.by_shard(hashes) if found else ():
            if k in found:
                out[p:q] = np.unpackbits(np.frombuffer(zstandard.decompress(found[k]), np.uint8))[:q - p] == 1
        return out

    def segments(self, answers: list) -> tuple:
        """(first windows, numbers of windows, documents, segment numbers; distinct segments as bytes, hashes, smallest documents, pieces).

        Only runs whose gram several documents hold, and the single windows of
        hot grams that several hold; distinct segments in the order of shard,
        piece (0, and 1.. for windows of hot grams) and hash, then of the
        block. ``answers``: (shard, bitmaps of shared grams, hot
        grams, shared windows).
        """
        held, hot = (self.flags(self.hashes, [(x[0], x[k]) for x in answers]) for k in (1, 2))
        runs = np.flatnonzero((held & ~hot)[self.which])
        first, windows, keys, doc = self.first[runs], self.windows[runs], self.hash[runs], self.ids[self.text[runs]]
        piece = np.zeros(len(runs), np.int32)
        if hot.any():
            at, h, d = self.hot_windows(hot)
            hashes, which = np.unique(h, return_inverse=True)
            own = self.flags(hashes, [(x[0], x[3]) for x in answers])[which]
            first, keys, doc = (np.concatenate(x) for x in ((first, at[own]), (keys, h[own]), (doc, d[own])))
            windows = np.concatenate([windows, np.ones(int(own.sum()), np.int64)])
            piece = np.concatenate([piece, (h[own] % np.uint64(self.pieces)).astype(np.int32) + 1])
        stop = first + windows + self.length - 1
        data = self.data
        number: dict[bytes, int] = {}  # equal segments have equal grams, hot or not, and equal hashes
        segment = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(first.tolist(), stop.tolist())),
                              np.int64, len(first))
        hashes, low = np.zeros(len(number), np.uint64), np.full(len(number), np.iinfo(np.int64).max)
        hashes[segment] = keys
        np.minimum.at(low, segment, doc)
        pieces = np.zeros(len(number), np.int32)
        pieces[segment] = piece
        order = np.argsort(hashes, kind="stable")
        shard = np.zeros(len(order), np.int32)
        for k, p, q in self.by_shard(hashes[order]):
            shard[p:q] = k
        order = order[np.lexsort((pieces[order], shard))]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        distinct = list(number)
        return (first, windows, doc, place[segment], [distinct[k] for k in order.tolist()], hashes[order], low[order],
                pieces[order])

    def parts(self, hashes: np.ndarray, pieces: np.ndarray):
        """(shard, piece, first, stop) of each piece that has some of the distinct segments, in their order."""
        shard = np.searchsorted([(k << _HASH_BITS) // self.shards for k in range(1, self.shards)], hashes, side="right")
        cuts = np.flatnonzero(np.diff(shard) | np.diff(pieces)) + 1
        ends = [0, *cuts.tolist(), len(hashes)]
        return [(int(shard[p]), int(pieces[p]), p, q) for p, q in zip(ends[:-1], ends[1:]) if q > p]


# -- the shards' answers ------------------------------------------------------
def shared_hashes(blocks: list[tuple], hot_segments: int = HOT_SEGMENTS) -> list[tuple[int, bytes, bytes | None, int]]:
    """For each block of a shard, bitmaps over its hashes: held by several documents, and hot (if any is); how many are held.

    ``blocks``: (block, hashes, flags[, numbers of segments]).
    """
    hashes = [np.cumsum(unpack_numbers(x[1], np.uint64)) for x in blocks]
    here = [np.unpackbits(np.frombuffer(x[2], np.uint8))[:len(h)] for x, h in zip(blocks, hashes)]
    sizes = [len(h) for h in hashes]
    key = np.concatenate(hashes)
    found, where, n = np.unique(key, return_inverse=True, return_counts=True)
    many = n > 1  # a block sends a hash once
    many[where[np.concatenate(here) == 1]] = True
    hot = np.zeros(len(found), bool)
    if len(blocks[0]) > 3:
        hot = many & (np.bincount(where, np.concatenate([unpack_numbers(x[3], np.int32) for x in blocks])) > hot_segments)
    bits, hot = many[where], hot[where]
    out, at = [], 0
    for (block, *_), size in zip(blocks, sizes):
        own, own_hot = bits[at:at + size], hot[at:at + size]
        at += size
        if own.any():
            out.append((block, zstandard.compress(np.packbits(own).tobytes(), 1),
                        zstandard.compress(np.packbits(own_hot).tobytes(), 1) if own_hot.any() else None, int(own.sum())))
    return out


def with_repeats(segments: list[bytes], length: int) -> np.ndarray:
    """Of each segment: whether the hash of one of its windows comes twice or more. Equal windows have equal hashes, so
    the others share no window."""
    size = np.array([len(s) for s in segments], np.int64)
    n = size - length + 1
    first = np.repeat(np.cumsum(size) - size, n) + _inside(n)
    segment = np.repeat(np.arange(len(size)), n)
    h = gram_hashes(np.frombuffer(b"".join(segments), np.uint8), length)[first]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(size), bool)
    out[segment[order[1:][same]]] = True
    out[segment[order[:-1][same]]] = True
    return out


def window_owners(segments: list[bytes], low: np.ndarray, length: int) -> np.ndarray:
    """The smallest document of each window, segment after segment. ``low``: each segment's smallest document."""
    size = np.array([len(s) for s in segments], np.int64)
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text = data.astype(np.int32) + 2
    ends = np.cumsum(size + 1) - 1
    text[ends] = 1                                   # between segments
    order = suffix_array(np.concatenate([text, [0]]))
    segment = np.repeat(np.arange(len(size)), size + 1)
    is_window = np.zeros(len(text) + 1, bool)
    is_window[:-1] = np.arange(len(text)) + length <= ends[segment]
    order = order[is_window[order]]
    same = permuted_prefixes(data, order, length)
    start = np.flatnonzero(~same[order])
    least = np.minimum.reduceat(low[segment[order]], start) if len(order) else low[:0]
    owner = np.empty(len(text), np.int64)
    owner[order] = np.repeat(least, np.diff(start, append=len(order)))
    return owner[is_window[:-1]]


def answer_segments(blocks: list[tuple], length: int) -> list[tuple[int, bytes, bytes]]:
    """For each block of a shard, the smallest document of each window of its segments (runs: values, lengths)."""
    claim_memory()
    number: dict[bytes, int] = {}
    which, lows, grams = [], [], []
    for _, hashes, sizes, data, docs in blocks:
        ends = np.cumsum(unpack_numbers(sizes, np.int32)).tolist()
        data = zstandard.decompress(data)
        which.append(np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends], ends)), np.int64, len(ends)))
        lows.append(unpack_numbers(docs, np.int64))
        grams.append(np.cumsum(unpack_numbers(hashes, np.uint64)))
    keys = list(number)
    del number
    low, gram = np.full(len(keys), np.iinfo(np.int64).max), np.zeros(len(keys), np.uint64)
    every = np.concatenate(which)
    np.minimum.at(low, every, np.concatenate(lows))
    gram[every] = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")
    windows = np.array([len(s) - length + 1 for s in keys], np.int64)
    at = np.cumsum(windows) - windows
    # right for a gram with one segment, and for a segment without a repeated window: there is nothing to sort
    owners = np.repeat(low, windows)
    pending: list[int] = []
    pending_bytes = 0

    def index() -> None:
        nonlocal pending, pending_bytes
        own = np.array(pending, np.int64)
        if len(own):
            own = own[with_repeats([keys[k] for k in pending], length)]
        if len(own):
            found = window_owners([keys[k] for k in own.tolist()], low[own], length)
            n = windows[own]
            place = np.repeat(at[own], n) + _inside(n)
            owners[place] = found
        pending, pending_bytes = [], 0

    cuts = np.flatnonzero(np.diff(gram[order])) + 1
    for own in np.split(order, cuts):
        if len(own) > 1:
            size = int(windows[own].sum()) + len(own) * (length - 1)
            if pending_bytes + size > INDEX_BYTES:
                index()
            pending += own.tolist()
            pending_bytes += size
    index()
    out = []
    for (block, *_), own in zip(blocks, which):
        n = windows[own]
        place = np.repeat(at[own], n) + _inside(n)
        values, lengths = _runs(owners[place])
        out.append((block, pack_numbers(values), pack_numbers(lengths)))
    return out


# -- the job ------------------------------------------------------------------
def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                  gram: int = GRAM, folder: str | None = None, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the removed byte runs of each document and the bytes that remain.

    A string counts if it also starts in a document with a smaller id, judged
    on the input; removed runs are maximal. Null and empty texts, and texts
    of fewer than ``length`` bytes, lose nothing. Rows that repeat an id don't
    take from each other. Rows without an id keep everything and take from
    none. An empty table gives an empty result; other columns are ignored.
    ``hot_segments`` decides how windows reach a shard, not the result.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has eight bytes at least, and fits into the length")
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    rows = text_bytes(docs, id_col, text_col)
    blocks = text_blocks(rows.where("doc_id IS NOT NULL"), folder, BLOCK_BYTES, buckets=True)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))

    def open_block(b, k, pieces=1):
        return Block(b.column("ids")[k].as_py(), b.column("sizes")[k].as_py(), b.column("data")[k].as_py(), length, gram, shards,
                     pieces)

    def pairs(b, k, *names):
        return [tuple(x[n] for n in names) for x in b.column("answers")[k].as_py() or ()]

    def asking(schema, questions):
        """Tasks that send each block's questions: lists of (shard, ...)."""
        def ask(batches):
            for b in batches:
                for k in range(b.num_rows):
                    block = b.column("block")[k].as_py()
                    rows = [(shard, block, *more) for shard, *more in questions(b, k)]
                    yield pa.RecordBatch.from_pydict({n: [r[j] for r in rows] for j, n in enumerate(schema.names)}, schema=schema)
        return ask

    def telling(*names):
        def tell(table):
            rows = sorted(zip(*(table.column(n).to_pylist() for n in ("block", *names))))
            found = shared_hashes(rows, hot_segments)
            return pa.table({"shard": [table.column("shard")[0].as_py()] * len(found), "block": [x[0] for x in found],
                             "bits": [x[1] for x in found], "hot": [x[2] for x in found], "held": [x[3] for x in found]},
                            schema=pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("bits", pa.binary()),
                                              ("hot", pa.binary()), ("held", pa.int64())]))
        return tell

    # 1. which grams do several documents hold? Of hot ones: which windows?
    ask = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("flags", pa.binary())])
    told = "shard int, block long, bits binary, hot binary, held long"
    asked = blocks.mapInArrow(asking(ask.append(pa.field("counts", pa.binary())), lambda b, k: open_block(b, k).ask_grams()),
                              "shard int, block long, hashes binary, flags binary, counts binary")
    shared = written(asked.groupBy("shard").applyInArrow(telling("hashes", "flags", "counts"), told), "shared", folder).drop("held")
    pieces = 1
    hot = shared.where("hot IS NOT NULL")
    if hot.isEmpty():
        shared = shared.withColumn("wide", F.lit(None).cast("binary"))
    else:
        asked = join_answers(blocks, hot, "hot").where("answers IS NOT NULL").mapInArrow(
            asking(ask, lambda b, k: open_block(b, k).ask_windows(pairs(b, k, "shard", "hot"))),
            "shard int, block long, hashes binary, flags binary")
        wide = written(asked.groupBy("shard").applyInArrow(telling("hashes", "flags"), told), "shared_windows", folder)
        pieces = max(1, -(-int(wide.agg(F.sum("held")).first()[0] or 0) * length // (shards * PIECE_BYTES)))
        shared = shared.join(wide.select("shard", "block", F.col("bits").alias("wide")), ["shard", "block"], "full")

    # 2. the smallest document of each window around them
    send = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("sizes", pa.binary()),
                      ("data", pa.binary()), ("docs", pa.binary())])

    def send_segments(batches):
        for b in batches:
            for k in range(b.num_rows):
                answers = pairs(b, k, "shard", "bits", "hot", "wide")
                if not answers:
                    continue
                x = open_block(b, k, pieces)
                *_, segments, hashes, low, piece = x.segments(answers)
                out = {n: [] for n in send.names}
                for s, j, p, q in x.parts(hashes, piece):
                    out["shard"].append(s)
                    out["piece"].append(j)
                    out["block"].append(b.column("block")[k].as_py())
                    out["hashes"].append(pack_numbers(np.diff(hashes[p:q], prepend=np.uint64(0))))
                    out["sizes"].append(pack_numbers(np.array([len(g) for g in segments[p:q]], np.int32)))
                    out["data"].append(zstandard.compress(b"".join(segments[p:q]), 6))
                    out["docs"].append(pack_numbers(low[p:q]))
                yield pa.RecordBatch.from_pydict(out, schema=send)

    def tell_owners(table):
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("block", "hashes", "sizes", "data", "docs"))))
        found = answer_segments(rows, length)
        return pa.table({"shard": [table.column("shard")[0].as_py()] * len(found),
                         "piece": [table.column("piece")[0].as_py()] * len(found), "block": [x[0] for x in found],
                         "owners": [x[1] for x in found], "lengths": [x[2] for x in found]},
                        schema=pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("block", pa.int64()), ("owners", pa.binary()),
                                          ("lengths", pa.binary())]))

    sent = join_answers(blocks, shared, "bits", "hot", "wide").mapInArrow(
        send_segments, "shard int, piece int, block long, hashes binary, sizes binary, data binary, docs binary")
    owners = written(sent.groupBy("shard", "piece").applyInArrow(tell_owners, "shard int, piece int, block long, owners binary, lengths binary"),
                     "owners", folder)
    owners = owners.groupBy("block", "shard").agg(F.sort_array(F.collect_list(F.struct("piece", "owners", "lengths"))).alias("owners"))

    # 3. the bytes that go
    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())),
                        ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])

    def cut(batches):
        for b in batches:
            for k in range(b.num_rows):
                answers = pairs(b, k, "shard", "bits", "hot", "wide", "owners")
                x = open_block(b, k, pieces)
                yield pa.RecordBatch.from_pydict(_cut_block(x, answers), schema=result)

    both = shared.join(owners, ["block", "shard"], "left")  # a shard may know hot grams of a block and none of its segments
    kept = join_answers(blocks, both, "bits", "hot", "wide", "owners").mapInArrow(
        cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    nothing = F.array().cast("array<long>")
    return kept.unionByName(rows.where("doc_id IS NULL").select(
        "doc_id", F.octet_length("data").cast("long").alias("n_bytes"), nothing.alias("starts"), nothing.alias("ends"),
        F.col("data").alias("kept")))


def _cut_block(x: Block, answers: list) -> dict:
    size = len(x.data)
    gone = np.zeros(size, bool)
    told = [(p["owners"], p["lengths"]) for a in sorted(answers, key=lambda a: a[0]) for p in a[-1] or ()]
    if told:
        start, n, doc, segment, *_ = x.segments([a[:4] for a in answers])
        # the answers follow the order of shards, pieces and hashes, as the segments do
        owner = np.concatenate([np.repeat(unpack_numbers(o, np.int64), unpack_numbers(n, np.int32)) for o, n in told])
        width = np.zeros(int(segment.max()) + 1, np.int64)
        width[segment] = n
        at = (np.cumsum(width) - width)[segment]
        inside = _inside(n)
        earlier = owner[np.repeat(at, n) + inside] < np.repeat(doc, n)
        first = (np.repeat(start, n) + inside)[earlier]
        edge = np.bincount(first, minlength=size + 1) - np.bincount(first + x.length, minlength=size + 1)
        gone = np.cumsum(edge[:-1]) > 0
    out = {n: [] for n in ("doc_id", "n_bytes", "starts", "ends", "kept")}
    data = np.frombuffer(x.data, np.uint8)
    a = 0
    for i, n in zip(x.ids.tolist(), x.sizes.tolist()):
        own = gone[a:a + n]
        turns = np.flatnonzero(np.diff(own, prepend=False, append=False)) if own.any() else np.zeros(0, np.int64)
        out["doc_id"].append(i)
        out["n_bytes"].append(n)
        out["starts"].append(turns[::2].tolist())
        out["ends"].append(turns[1::2].tolist())
        out["kept"].append(x.data[a:a + n] if not len(turns) else data[a:a + n][~own].tobytes())
        a += n
    return out
