"""Packing documents into fixed-length token sequences by length patterns.

Spark tokenizes every document once and ranks the pieces of equal length.
What reaches the driver is the histogram of piece lengths (at most
``capacity`` numbers). There, patterns of a few lengths that fill a sequence
exactly get repeat counts by non-negative least squares; the rounded counts,
and best-fit over the residual histogram, give runs "pieces of length L with
ranks a..b lie in sequences s..s+b-a at offset o". Spark looks every piece's
run up by its rank.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, map_texts, text_bytes, work_dir, written

CAPACITY = 1024
END_ID = 2
#: Encoded words that a worker keeps; it starts afresh beyond that (memory only, results don't depend on it).
CACHE_WORDS = 1_500_000


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary, installed beside the libraries on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def joined(ids: Iterable[bytes | bool]) -> bytes | None:
    """The chunks' ids end to end; None if a chunk has none of its own (False)."""
    try:
        return b"".join(ids)
    except TypeError:
        return None


class WordEncoder:
    """Byte-level BPE ids of whole texts, from remembered words.

    The tokenizer first cuts a text into words (letters, digits or symbols)
    with one leading space at most, and single line feeds. So a text is cut
    before each space and line feed that has no other white space beside it,
    and each distinct chunk is encoded by the library once. A text with white
    space beside a space or line feed is encoded whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text, unless ``encode`` is told otherwise
        self.path, self.default = path, None
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes | bool] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.feed = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each with its leading space: a thousand in one text, cut at the library's words."""
        out = []
        joined = ["".join(words[k:k + 1000]) for k in range(0, len(words), 1000)]
        for e in self.tok.encode_batch(joined, add_special_tokens=False):
            data = array("I", e.ids).tobytes()
            cuts = np.flatnonzero(np.diff(np.array(e.word_ids))) + 1
            ends = [*(4 * cuts).tolist(), len(data)]
            out += [data[p:q] for p, q in zip([0, *ends], ends)]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Remember new chunks: ``"\\n..."`` as it stands, others with a leading space."""
        split, whole = [], []
        for c in chunks:
            feed = c[:1] == "\n"
            rest = c[1:] if feed else c
            core = rest.rstrip(".,!")
            if core.isalpha():  # letters, then a run of marks: the tokenizer cuts between them
                split.append((c, core if feed else " " + core, rest[len(core):]))
            elif not rest or rest[0].isspace() or rest[-1].isspace():
                self.cache[c] = False  # beside white space: the text is encoded whole
            else:
                whole.append(c)
        self.cache.update(zip(whole, self._encode([c if c[0] == "\n" else " " + c for c in whole])))
        new = {w for _, w, _ in split}.difference(self.words)
        spaced, bare = [w for w in new if w[0] == " "], [w for w in new if w[0] != " "]
        self.words.update(zip(spaced, self._encode_letters(spaced)))
        self.words.update(zip(bare, self._encode(bare)))
        for m in {m for _, _, m in split}.difference(self.marks):
            self.marks[m] = self._encode([m])[0]
        self.cache.update((c, self.words[w] + self.marks[m] if w[0] == " " else self.feed + self.words[w] + self.marks[m])
                          for c, w, m in split)

    def _encode_default(self, text: str) -> bytes:
        """Ids of a text by the library's default: an added token's string is that token."""
        if self.default is None:
            from tokenizers import Tokenizer
            self.default = Tokenizer.from_file(self.path)
        return array("I", self.default.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], literal: bool = True) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        ``literal``: the strings of special tokens are ordinary text. If not,
        texts that hold an added token's string are encoded whole by the
        library's default.
        """
        if not literal:
            held = {k: self._encode_default(t) for k, t in enumerate(texts) if any(a in t for a in self.added)}
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in held]))
            return [held[k] if k in held else next(rest) for k in range(len(texts))]
        if len(self.cache) + len(self.words) > self.cache_words:
            self.cache.clear()
            self.words.clear()
            self.marks = {"": b""}
        # a line feed before the text, whose id is dropped again, makes its first chunk one like the others
        rows = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        new = set().union(*rows).difference(self.cache)  # a group's chunks, each looked up once
        if new:
            self._learn(new)
        get, out = self.cache.__getitem__, []
        for t, r in zip(texts, rows):
            ids = joined(map(get, r))
            out.append(ids[4:] if ids is not None else self._encode([t])[0])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    claim_memory("words", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].cache_words = cache_words
    return _ENCODERS[path]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full, but for the first."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS,
                 literal: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(ids, texts, enc):
        out = {k: [] for k in _PIECES.names}
        for i, data in zip(ids, enc.encode([t.decode("utf-8", "replace") for t in texts], literal)):
            data += end
            for k, (start, length) in enumerate(piece_bounds(len(data) // 4, capacity)):
                for name, v in zip(_PIECES.names, (i, k, start, length,
                                                   zlib.crc32(data[4 * start:4 * (start + length)]))):
                    out[name].append(v)
        return out
    return map_texts(text_bytes(docs, id_col, text_col), cut,
                     "doc_id long, piece int, start long, length long, ids_crc32 long", _PIECES,
                     setup=lambda: encoder(path, cache_words))


def exact_patterns(lengths: list[int], capacity: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All multisets of at most ``depth`` of the given lengths that sum to the capacity."""
    have = set(lengths)

    def fill(rest: int, most: int, depth: int) -> list[tuple[int, ...]]:
        if depth == 1:
            return [(rest,)] if rest <= most and rest in have else []
        out = [(rest,)] if rest <= most and rest in have else []
        for a in have:
            if a <= most and a < rest and a * depth >= rest:
                out += [(a, *more) for more in fill(rest - a, a, depth - 1)]
        return out
    return sorted(fill(capacity, capacity, depth), reverse=True)


def nnls_repeats(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, by accelerated projected gradients.

    A's column of a pattern counts its lengths; it is kept as an index array.
    """
    depth = max(map(len, patterns))
    idx = np.zeros((len(patterns), depth), np.int64)  # 0: no length there
    for i, p in enumerate(patterns):
        idx[i, :len(p)] = p
    size = len(hist)

    def a_times(x):
        return np.bincount(idx.ravel(), np.repeat(x, depth), size) * inside

    inside = np.ones(size)
    inside[0] = 0
    target = hist.astype(float) * inside
    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        w = a_times(v)[idx].sum(axis=1)
        top = np.linalg.norm(w)
        v = w / top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - (a_times(y) - target)[idx].sum(axis=1) / (1.05 * top))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


@dataclass
class Run:
    """``count`` pieces of one length, by rank from ``rank``: sequences from ``sequence`` on, at ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    offset: int


def pack_histogram(hist: np.ndarray, capacity: int = CAPACITY, depth: int = 3) -> tuple[list[Run], int]:
    """Runs that place all pieces counted in ``hist`` (index: length), and the number of sequences."""
    left = hist.astype(np.int64).copy()
    used = np.zeros(len(hist), np.int64)
    runs: list[Run] = []
    sequences = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, int(used[length]), count, sequence, offset))
        used[length] += count
        left[length] -= count

    patterns = exact_patterns([int(n) for n in np.flatnonzero(left)], capacity, depth)
    if patterns:
        wanted = np.rint(nnls_repeats(patterns, left)).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable"):
            p = patterns[i]
            n = min([int(wanted[i]), *(int(left[a]) // p.count(a) for a in p)])
            if n <= 0:
                continue
            offset = 0
            for a in p:
                place(a, n, sequences, offset)
                offset += a
            sequences += n

    # the residual, longest first into the fullest sequences that have room; sequences of equal fill in groups
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    open_rooms: list[int] = []

    def leave(space: int, group: tuple[int, int]) -> None:
        if space > 0:
            if not room[space]:
                bisect.insort(open_rooms, space)
            room[space].append(group)

    for length in range(capacity, 0, -1):
        while left[length]:
            k = bisect.bisect_left(open_rooms, length)
            if k < len(open_rooms):
                space = open_rooms[k]
                start, count = room[space].pop()
                if not room[space]:
                    open_rooms.pop(k)
                n = min(count, int(left[length]))
                place(length, n, start, capacity - space)
                if count > n:
                    leave(space, (start + n, count - n))
                leave(space - length, (start, n))
                continue
            per = capacity // length
            n = max(1, int(left[length]) // per)
            per = min(per, int(left[length]))
            for j in range(per):
                place(length, n, sequences, j * length)
            leave(capacity - per * length, (sequences, n))
            sequences += n
    return runs, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY, depth: int = 3, folder: str | None = None) -> DataFrame:
    """Add (sequence_id, offset) to rows that have ``length`` (1..capacity), doc_id and piece.

    Ranks within a length come from a range partitioning by (length, doc_id,
    piece): a length that many pieces share is cut over many tasks. The
    driver gets one count for each (partition, length), that is at most
    partitions + capacity numbers.
    """
    folder = folder or work_dir(pieces.sparkSession)
    names = pieces.columns
    at = names.index("length")

    def rank(batches):
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            lengths = b.column(at).to_numpy()
            local = np.empty(len(lengths), np.int64)
            # sorted by length: each run of one length continues that length's count
            cuts = np.flatnonzero(np.diff(lengths)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lengths)]):
                if e > s:
                    local[s:e] = seen[lengths[s]] + np.arange(e - s)
                    seen[lengths[s]] += e - s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*names, "part", "local"])

    dealt = (pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
             .withColumn("part", F.spark_partition_id()))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    ranked = written(dealt.mapInArrow(rank, ddl + ", local long"), "ranked", folder)

    counts = ranked.groupBy("part", "length").count().collect()
    hist = np.zeros(capacity + 1, np.int64)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r.length, r.part)):
        before[r.part, r.length] = int(hist[r.length])
        hist[r.length] += r["count"]
    runs, _ = pack_histogram(hist, capacity, depth)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for n in {r.length for r in runs}:
        own = sorted((r for r in runs if r.length == n), key=lambda r: r.rank)
        by_length[n] = tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("rank", "sequence", "offset"))
    out_names = [*names, "sequence_id", "offset"]
    part_at, local_at = len(names), len(names) + 1

    def look_up(batches):
        for b in batches:
            lengths, parts = b.column(at).to_numpy(), b.column(part_at).to_numpy()
            ranks = b.column(local_at).to_numpy().copy()
            seq, off = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.lexsort((parts, lengths))
            cuts = np.flatnonzero(np.diff(lengths[order]) | np.diff(parts[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                n = int(lengths[rows[0]])
                start, sequence, offset = by_length[n]
                rank = ranks[rows] + before[int(parts[rows[0]]), n]
                k = np.searchsorted(start, rank, side="right") - 1
                seq[rows], off[rows] = sequence[k] + rank - start[k], offset[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:part_at], pa.array(seq), pa.array(off)], names=out_names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(look_up, ddl + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, depth: int = 3, folder: str | None = None,
                   cache_words: int = CACHE_WORDS, literal: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is the end id alone. Only documents of more than
    ``capacity`` ids are cut. Repeated rows are packed as documents of their
    own; a null id stays null. An empty table gives an empty result; other
    columns are ignored. ``literal``: see ``WordEncoder.encode``.
    """
    folder = folder or work_dir(docs.sparkSession)
    pieces = written(token_pieces(docs, id_col, text_col, path, capacity, cache_words=cache_words, literal=literal), "pieces", folder)
    return pack(pieces, capacity, depth, folder)
