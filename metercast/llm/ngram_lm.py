"""N-gram language model in an Elias-Fano trie of memory-mapped levels.

Level 1 holds the vocabulary as a sorted sequence of word hashes; a word's
number is its place. A node of level n is a (node of level n - 1, word) pair;
the pairs of a level are one sorted sequence ``context * 2^b + word``, so that
the unary high bits are monotone pointers from the contexts into the level and
a word is looked up by successor search among its context's values. With each
node go its interpolated probability (modified absolute discounting; the
unigrams are the add-one-half estimate) and its back-off weight, both as
logarithms in 16-bit steps.

Counts come from all training texts: tasks send sorted, compressed runs of
counts to the parts of a level, which are ranges of contexts of about equal
counts (a context that is too frequent for one part is cut by word). Every
part of a level is written by one task as files in the shared folder named by
``spark.checkpoint.dir``, under a name of its own and then renamed, so that
lost tasks can run again; scoring tasks map the parts they need. The driver
holds a line for each part.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, local_path, map_texts, pack_numbers, text_bytes, unpack_numbers, work_dir
from .elias_fano import EliasFano

#: Orders of the model: words are scored after the two before them.
ORDER = 3
#: Counted tokens for each part of a level.
PART_TOKENS = 2 << 20
#: Tokens that a task counts before it sends them.
FLUSH_TOKENS = 4 << 20
#: Bytes of text for each part of the vocabulary.
VOCABULARY_BYTES = 64 << 20
#: Words that a worker keeps; it starts afresh beyond that (memory only, results don't depend on it).
CACHE_WORDS = 500_000

_HASH_BITS = 62
_END = b" "                       # no word: the end of a text, counted as a token
_STEP = 20 / 65535                # of log10, from -20 to 0


def _to_code(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, 20) / _STEP).astype(np.uint16)


def _from_code(code: np.ndarray) -> np.ndarray:
    return code * -_STEP


def word_hashes(words: list[bytes]) -> np.ndarray:
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return (digests >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


@dataclass
class Part:
    """A range of (context, word) of one level; of level 1: of hashes (as contexts 0)."""
    level: int
    first: int            # first context, or hash
    word: int = 0         # first word in it
    stop: int = 0         # context, or hash, after the last
    n: int = 0
    width: int = 0
    offset: int = 0       # number of its first node
    folder: str = ""

    def open(self, cache: dict) -> dict:
        found = cache.get(self.folder)
        if found is None:
            found = cache[self.folder] = {"keys": EliasFano.open(self.folder, self.n, self.width)}
            for name in ("counts", "codes", "backoff", "suffix"):
                path = os.path.join(self.folder, f"{name}.npy")
                if os.path.exists(path):
                    found[name] = np.asarray(np.load(path, mmap_mode="r"))
        return found


@dataclass
class Level:
    n: int
    parts: list[Part]

    def __post_init__(self):
        self.firsts = np.array([p.first for p in self.parts], np.int64)
        self.offsets = np.array([p.offset for p in self.parts], np.int64)
        one = np.flatnonzero(np.diff(self.firsts, prepend=-1) != 0)  # first part of each first context
        self.heads, self.head_at = self.firsts[one], one
        self.cut = {int(self.firsts[k]): np.array([p.word for p in self.parts if p.first == self.firsts[k]], np.int64)
                    for k, m in zip(one, np.diff(one, append=len(self.parts))) if m > 1}

    def part_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Number of the part for each pair."""
        where = self.head_at[np.maximum(np.searchsorted(self.heads, context, side="right") - 1, 0)]
        for c, words in self.cut.items():
            own = np.flatnonzero(context == c)
            where[own] += np.searchsorted(words, word[own], side="right") - 1
        return where


def _by_part(where: np.ndarray):
    """(part, rows) of each part that has rows."""
    if (where[1:] >= where[:-1]).all():
        order = np.arange(len(where))
    else:
        small = len(where) and 0 <= int(where.min()) and int(where.max()) < 1 << 16  # a radix sort
        order = np.argsort(where.astype(np.uint16) if small else where, kind="stable")
    cuts = np.flatnonzero(np.diff(where[order])) + 1
    for rows in np.split(order, cuts) if len(order) else ():
        yield int(where[rows[0]]), rows


@dataclass
class NgramModel:
    """Where the levels lie, and their totals. ``words``: distinct tokens; ``tokens``: all counted."""
    order: int
    words: int = 0
    tokens: int = 0
    bits: int = 1
    levels: list[Level] = field(default_factory=list)

    # -- look-ups in mapped levels; ``cache`` keeps a worker's open parts --------------------
    def word_ids(self, hashes: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count or 0) of each word hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if self.words:
            level, order = self.levels[0], np.argsort(hashes)
            for p, rows in _by_part(np.searchsorted(level.firsts, hashes[order], side="right") - 1):
                part, rows = level.parts[p], order[rows]
                data = part.open(cache)
                at = data["keys"].find(hashes[rows] - part.first)
                hit = at >= 0
                ids[rows[hit]] = at[hit] + part.offset
                counts[rows[hit]] = data["counts"][at[hit]]
        return ids, counts

    def node_values(self, level: int, node: np.ndarray, name: str, cache: dict, missing: float = 0) -> np.ndarray:
        """An array's values at nodes of a level (-1: ``missing``)."""
        out = np.full(len(node), missing, np.int64)
        lv = self.levels[level - 1]
        real = np.flatnonzero(node >= 0)
        for p, rows in _by_part(np.searchsorted(lv.offsets, node[real], side="right") - 1):
            rows = real[rows]
            out[rows] = lv.parts[p].open(cache)[name][node[rows] - lv.parts[p].offset]
        return out

    def nodes(self, level: int, context: np.ndarray, word: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, code of its probability) for each (context node, word) of a level from 2 on."""
        node, code = np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint16)
        lv = self.levels[level - 1]
        real = np.flatnonzero((context >= 0) & (word >= 0))
        if not lv.parts or not len(real):
            return node, code
        context, word, which = self._distinct(context[real], word[real])
        found, told = np.full(len(context), -1, np.int64), np.zeros(len(context), np.uint16)
        where = lv.part_of(context, word)  # pairs and parts are in order
        cuts = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            part = lv.parts[int(where[a])]
            a, b = a + np.searchsorted(context[a:b], (part.first, part.stop))
            if a == b:
                continue
            data = part.open(cache)
            at = data["keys"].find(((context[a:b] - part.first) << self.bits) | word[a:b])
            hit = at >= 0
            found[a:b] = np.where(hit, at + part.offset, -1)
            told[a:b] = np.where(hit, data["codes"].take(at, mode="clip"), 0)
        node[real], code[real] = found.take(which), told.take(which)
        return node, code

    def _distinct(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in order, and the place of each pair among them: each is looked up once, near the one before."""
        if int(context.max()) >> (63 - self.bits):  # a pair is no 64-bit number
            order = np.lexsort((word, context))
            which = np.empty(len(order), np.int64)
            which[order] = np.arange(len(order))
            return context[order], word[order], which
        key, which = np.unique((context << self.bits) | word, return_inverse=True)
        return key >> self.bits, key & ((1 << self.bits) - 1), which

    def backoff(self, level: int, context: np.ndarray, cache: dict) -> np.ndarray:
        """log10 of the weight that a context of ``level`` words leaves to shorter ones (0: unseen)."""
        out = np.zeros(len(context))
        lv = self.levels[level]
        real = np.flatnonzero(context >= 0)
        if lv.parts and len(real):
            # the first part of a context has its weight
            where = lv.head_at[np.maximum(np.searchsorted(lv.heads, context[real], side="right") - 1, 0)]
            for p, rows in _by_part(where):
                rows = real[rows]
                part = lv.parts[p]
                rows = rows[(context[rows] >= part.first) & (context[rows] < part.stop)]
                out[rows] = _from_code(part.open(cache)["backoff"][context[rows] - part.first])
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def conditional(self, level: int, context: np.ndarray, word: np.ndarray, cache: dict) -> np.ndarray:
        """log10 P(word | context of ``level - 1`` words), by node; used while a longer level is built."""
        if level == 1:
            return self.unigram(self.node_values(1, word, "counts", cache))
        _, code = found = self.nodes(level, context, word, cache)
        out = _from_code(code)
        miss = np.flatnonzero(found[0] < 0)
        if len(miss):
            shorter = self.suffix(level - 1, context[miss], cache)
            out[miss] = (self.backoff(level - 1, context[miss], cache)
                         + self.conditional(level - 1, shorter, word[miss], cache))
        return out

    def suffix(self, level: int, node: np.ndarray, cache: dict) -> np.ndarray:
        """Node of level - 1 that lacks the node's first word (-1 below level 2)."""
        if level < 2:
            return np.full(len(node), -1, np.int64)
        return self.node_values(level, node, "suffix", cache, missing=-1)


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, place of each word among them, words of each text), A-Z lower-cased."""
    data = pa.array(texts, pa.binary()).view(pa.string())  # only ASCII matters below
    lists = pc.ascii_split_whitespace(pc.ascii_lower(data))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():  # white space at a text's ends
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[real], minlength=len(texts))
        words = words.filter(pa.array(real))
    found = words.dictionary_encode()
    return found.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False), sizes


class _Numbers(defaultdict):
    """Numbers of words in the order of their first look-up."""

    def __init__(self):
        super().__init__(itertools.count().__next__)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """(number of each of these distinct words, those that are new, in the order of their numbers)."""
        known = len(self)
        number = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return number, [words[k] for k in np.flatnonzero(number >= known).tolist()]


class Worker:
    """Words and open parts of one worker process."""

    def __init__(self, model: NgramModel):
        self.model = model
        self.parts: dict = {}
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number or -1, count, tokens of each text): the words of each text, then the end."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        index = self.index
        words, which, sizes = split_words(texts)
        words.append(_END)
        number, new = index.numbers(words)
        sizes = sizes + 1
        at = np.full(sizes.sum(), number[-1], np.int64)
        inside = np.ones(len(at), bool)
        inside[np.cumsum(sizes) - 1] = False
        at[inside] = number[which]
        if new:
            ids, counts = self.model.word_ids(word_hashes(new), self.parts)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return self.ids[at], self.counts[at], sizes

    def contexts(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The word before each token; before the first, the number after the last word's."""
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[np.cumsum(sizes) - sizes] = self.model.words
        return before

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        ids, counts, sizes = self.tokens(texts)
        start = np.cumsum(sizes) - sizes
        base = m.unigram(counts)
        log10 = base.copy()
        context = self.contexts(ids, sizes)
        for level in range(2, m.order + 1):
            node, code = m.nodes(level, context, ids, self.parts)
            hit = node >= 0
            rest = np.flatnonzero(~hit)
            log10[rest] += m.backoff(level - 1, context[rest], self.parts)
            log10[hit] = _from_code(code[hit])
            # the node of the token before is the next level's context
            context = np.concatenate(([-1], node[:-1]))
            context[start] = -1
        return (sizes, np.add.reduceat((counts > 0).astype(np.int64), start), np.add.reduceat(base, start),
                np.add.reduceat(log10, start))


_WORKERS: dict[str, Worker] = {}


def _worker(key: str, model: NgramModel) -> Worker:
    claim_memory("trie", _WORKERS.clear)
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Worker(model)
    return _WORKERS[key]


# -- training ---------------------------------------------------------------------
def _publish(folder: str, name: str, fill) -> str:
    """Fill a new folder and rename it to ``name``; a rerun task finds the finished one and keeps it."""
    final = os.path.join(folder, name)
    own = f"{final}.{uuid.uuid4().hex}"
    os.makedirs(own)
    fill(own)
    try:
        os.rename(own, final)
    except OSError:  # there already, with the same content
        shutil.rmtree(own, ignore_errors=True)
    return final


def _merged(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([np.cumsum(unpack_numbers(x, np.int64)) for x in keys])
    n = np.concatenate([unpack_numbers(x, np.int64) for x in counts])
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.diff(k, prepend=k[:1] - 1))
    return k[first], np.add.reduceat(n, first)


def _counted(context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, count) of each distinct pair, in order."""
    if int(context.max()) >> (63 - bits):  # a pair is no 64-bit number
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        first = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        return context[first], word[first], np.diff(first, append=len(word))
    key, n = np.unique((context << bits) | word, return_counts=True)
    return key >> bits, key & ((1 << bits) - 1), n


def _range_starts(counts: np.ndarray, part_tokens: int):
    """(first node, parts of it): ranges of nodes with about ``part_tokens`` counts; a node over that is cut by word."""
    hot = np.flatnonzero(counts > part_tokens)
    total = np.cumsum(np.where(counts > part_tokens, 0, counts))
    bucket = total // part_tokens
    fresh = np.diff(bucket, prepend=-1) != 0
    fresh[hot] = True
    fresh[np.minimum(hot + 1, len(counts) - 1)] = True
    for k in np.flatnonzero(fresh).tolist():
        yield k, max(1, -(-int(counts[k]) // part_tokens))


_SENT = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BUILT = pa.schema([("part", pa.int32()), ("info", pa.string())])


def _send(parts: list[int], keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"part": parts, "keys": [pack_numbers(np.diff(k, prepend=np.int64(0))) for k in keys],
         "counts": [pack_numbers(n.astype(np.int64)) for n in counts]}, schema=_SENT)


def _build(sent: DataFrame, build) -> list[dict]:
    """One task for each part writes its files; a line for each part comes back."""
    def run(table):
        part = table.column("part")[0].as_py()
        info = build(part, *_merged(table.column("keys").to_pylist(), table.column("counts").to_pylist()))
        return pa.table({"part": [part], "info": [json.dumps(info)]}, schema=_BUILT)
    rows = sent.groupBy("part").applyInArrow(run, "part int, info string").collect()
    return [{"part": r.part, **json.loads(r.info)} for r in sorted(rows, key=lambda r: r.part)]


def _texts_in(batches):
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (4 << 20), side="right")))
            yield b.column(1).slice(start, stop - start).to_pylist()
            start = stop


def _vocabulary(rows: DataFrame, n_parts: int, folder: str, part_tokens: int) -> tuple[Level, int, list]:
    shift = _HASH_BITS - (n_parts - 1).bit_length()

    def count(batches):
        index, counts = _Numbers(), np.zeros(0, np.int64)

        def send():
            h = word_hashes(list(index))  # in the order of their numbers
            order = np.argsort(h)
            h, n = h[order], counts[order]
            own = list(_by_part(h >> shift))
            return _send([p for p, _ in own], [h[r] - (p << shift) for p, r in own], [n[r] for _, r in own])
        for texts in _texts_in(batches):
            words, which, _ = split_words(texts)
            number, new = index.numbers([*words, _END])
            counts = np.concatenate([counts, np.zeros(len(new), np.int64)])
            counts[number] += np.append(np.bincount(which, minlength=len(words)), len(texts))
            if len(index) > CACHE_WORDS:
                yield send()
                index, counts = _Numbers(), np.zeros(0, np.int64)
        if index:
            yield send()

    def build(part, keys, counts):
        ef = EliasFano.build(keys, 1 << shift)

        def fill(d):
            ef.save(d)
            np.save(os.path.join(d, "counts.npy"), counts)
        path = _publish(folder, f"1-{part}", fill)
        return {"n": len(keys), "width": ef.width, "tokens": int(counts.sum()), "folder": path,
                "ranges": list(_range_starts(counts, part_tokens))}

    built = _build(rows.mapInArrow(count, "part int, keys binary, counts binary"), build)
    parts, ranges, offset = [], [], 0
    for x in built:
        parts.append(Part(1, x["part"] << shift, 0, (x["part"] + 1) << shift, x["n"], x["width"], offset, x["folder"]))
        ranges += [(offset + k, cuts) for k, cuts in x["ranges"]]
        offset += x["n"]
    return Level(1, parts), sum(x["tokens"] for x in built), ranges


def _next_level(rows: DataFrame, model: NgramModel, ranges: list, nodes: int, folder: str, part_tokens: int) -> list:
    """Count, write and append the next level; returns the ranges for the one after. ``nodes``: contexts there are."""
    level = len(model.levels) + 1
    bits, width = model.bits, 1 << model.bits
    parts = []
    for k, (first, cuts) in enumerate(ranges):
        stop = ranges[k + 1][0] if k + 1 < len(ranges) else nodes
        parts += [Part(level, first, -(-j * model.words // cuts), stop) for j in range(cuts)]
    frame = Level(level, parts)
    key = uuid.uuid4().hex

    def count(batches):
        worker = _worker(key, model)
        held, size = [], 0

        def send():
            c, w, n = _counted(*(np.concatenate(x) for x in zip(*held)), bits)
            own = list(_by_part(frame.part_of(c, w)))
            return _send([p for p, _ in own], [((c[r] - parts[p].first) << bits) | w[r] for p, r in own], [n[r] for _, r in own])
        for texts in _texts_in(batches):
            ids, _, sizes = worker.tokens(texts)
            context = worker.contexts(ids, sizes)
            start = np.cumsum(sizes) - sizes
            for n in range(2, level):
                node, _ = model.nodes(n, context, ids, worker.parts)
                context = np.concatenate(([-1], node[:-1]))
                context[start] = -1
            real = context >= 0
            held.append((context[real], ids[real]))
            size += int(real.sum())
            if size >= FLUSH_TOKENS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def build(part, keys, counts):
        p = parts[part]
        ef = EliasFano.build(keys, (p.stop - p.first) * width)

        def fill(d):
            ef.save(d)
            with open(os.path.join(d, "raw"), "wb") as f:
                f.write(pack_numbers(counts))
            np.save(os.path.join(d, "codes.npy"), np.zeros(len(keys), np.uint16))
        path = _publish(folder, f"{level}-{part}", fill)
        hot = p.stop == p.first + 1
        return {"n": len(keys), "width": ef.width, "folder": path, "once": [int((counts == k).sum()) for k in (1, 2, 3, 4)],
                "sums": _context_sums(keys >> bits, counts)[1].sum(axis=0).tolist() if hot else None,
                "ranges": list(_range_starts(counts, part_tokens)) if level < model.order else []}

    built = _build(rows.mapInArrow(count, "part int, keys binary, counts binary"), build)
    kept, next_ranges, offset, hot_sums, n = [], [], 0, {}, np.zeros(4)
    for x in built:
        p = parts[x["part"]]
        p.n, p.width, p.folder, p.offset = x["n"], x["width"], x["folder"], offset
        next_ranges += [(offset + k, cuts) for k, cuts in x["ranges"]]
        offset += p.n
        n += x["once"]
        if x["sums"]:
            hot_sums[p.first] = (np.array(hot_sums.get(p.first, 0)) + x["sums"]).tolist()
        kept.append(p)
    discounts = modified_discounts(n)

    # probabilities and back-off weights, from the written counts and the shorter levels
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(k,) for k in range(len(kept))], "part int").repartition(max(1, len(kept)), "part")

    def finish(batches):
        worker = _worker(f"{key}-finish", model)
        for b in batches:
            for k in b.column(0).to_pylist():
                _finish_part(kept[k], model, worker.parts, bits, discounts, hot_sums)
            yield pa.RecordBatch.from_pydict({"part": b.column(0)}, schema=pa.schema([("part", pa.int32())]))
    numbers.mapInArrow(finish, "part int").collect()
    model.levels.append(Level(level, kept))
    return next_ranges, offset


def modified_discounts(n: np.ndarray) -> list[float]:
    """Discounts of counts of one, two, and three or more, from how many counts are 1, 2, 3, 4."""
    y = n[0] / max(1.0, n[0] + 2 * n[1])
    return [float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.1, k - 0.01)) if n[k - 1] else 0.5 for k in (1, 2, 3)]


def _context_sums(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the contexts' runs, and of each: its count, and how many of its counts are 1, 2, and 3 or more."""
    first = np.flatnonzero(np.diff(context, prepend=context[:1] - 1)) if len(context) else np.zeros(0, np.int64)
    cols = [counts, counts == 1, counts == 2, counts >= 3]
    return first, np.stack([np.add.reduceat(c.astype(np.int64), first) for c in cols], axis=1) if len(first) else np.zeros((0, 4), np.int64)


def _finish_part(p: Part, model: NgramModel, cache: dict, bits: int, discounts: list[float], hot_sums: dict) -> None:
    """Write a part's codes, back-off weights and (but for the last level) suffix nodes."""
    if os.path.exists(os.path.join(p.folder, "backoff.npy")):
        return
    keys = EliasFano.open(p.folder, p.n, p.width).values()
    with open(os.path.join(p.folder, "raw"), "rb") as f:
        counts = unpack_numbers(f.read(), np.int64)
    context, word = keys >> bits, keys & ((1 << bits) - 1)
    first, sums = _context_sums(context, counts)
    if p.first in hot_sums:
        sums = np.array([hot_sums[p.first]])
    run = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
    left = (sums[:, 1:] * discounts).sum(axis=1) / np.maximum(sums[:, 0], 1)
    node = context + p.first
    shorter = model.suffix(p.level - 1, node, cache)
    lower = 10 ** model.conditional(p.level - 1, shorter, word, cache)
    own = (counts - np.array([0, *discounts])[np.minimum(counts, 3)]) / np.maximum(sums[run, 0], 1)
    backoff = np.zeros(p.stop - p.first, np.uint16)
    backoff[context[first]] = _to_code(np.log10(np.maximum(left, 1e-20)))
    files = {"codes": _to_code(np.log10(own + left[run] * lower)), "backoff": backoff}
    if p.level < model.order:
        files["suffix"] = word if p.level == 2 else model.nodes(p.level - 1, shorter, word, cache)[0]
    for name, data in files.items():  # back-off last: it says that the part is finished
        if name != "backoff":
            _replace(p.folder, name, data)
    _replace(p.folder, "backoff", backoff)


def _replace(folder: str, name: str, data: np.ndarray) -> None:
    own = os.path.join(folder, f"{uuid.uuid4().hex}.npy")
    np.save(own, data)
    os.replace(own, os.path.join(folder, f"{name}.npy"))


def train_model(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
                part_tokens: int = PART_TOKENS, folder: str | None = None) -> NgramModel:
    """Count all n-grams of all texts, up to ``order`` words, and write the trie.

    Null and empty texts count their end. No texts give a model without words.
    """
    spark = texts.sparkSession
    folder = local_path(folder or work_dir(spark))
    rows = text_bytes(texts, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n_parts = 1 << max(0, int(size) // VOCABULARY_BYTES).bit_length()
    vocabulary, tokens, ranges = _vocabulary(rows, n_parts, folder, part_tokens)
    words = sum(p.n for p in vocabulary.parts)
    model = NgramModel(order, words, tokens, max(1, words.bit_length()), [vocabulary])
    if not words:
        model.levels += [Level(n, []) for n in range(2, order + 1)]
        return model
    ranges, nodes = [*ranges, (words, 1)], words + 1  # after the words: the begin of a text
    for _ in range(2, order + 1):
        ranges, nodes = _next_level(rows, model, ranges, nodes, folder, part_tokens)
    return model


def score_texts(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Scores are log10 probabilities of the words and the end. A null or empty
    text is its end alone. Repeated rows repeat; an empty table gives an empty
    result; other columns are ignored.
    """
    key = uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(ids, texts, worker):
        n, known, base, log10 = worker.score(texts)
        return {"doc_id": ids, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(ids), model.tokens),
                "base_score": base, "score": log10}
    return map_texts(text_bytes(docs, id_col, text_col), score,
                     "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double", schema,
                     setup=lambda: _worker(key, model))


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
