"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and which pairs do so corpus-wide.

A window is a piece of text whose both ends are ends of tokens on both sides:
byte offsets where tokens of both sides end cut it into groups, and a group
links each of its A tokens with each of its B tokens. Texts are cut before
spaces and line feeds; a chunk that both libraries encode on its own is a
window, aligned once, many new ones at a time, and remembered by its text. A
text with another chunk is tokenised whole by both libraries; there, ends of
tokens that both sides share and that a space-marked token follows on both
sides cut it into windows, remembered by their ids.

Documents are worked on in blocks of some MB of text. A block asks for the
document count of each of its distinct id pairs once, and the answers come
back by block, so that a pair of every document is one row for each block.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing, sentence_pieces
from .common import claim_memory, pack_numbers, unpack_numbers, work_dir, written

#: Texts of about so many bytes share one request for counts (a longer text is a block of its own).
BLOCK_BYTES = 12 << 20
#: Tokens of about so many bytes of text are arrays at once.
CHUNK_BYTES = 2 << 20
#: New chunks that are encoded as one text, at first and where that is not its bytes.
JOINED = (200, 20, 1)
#: Remembered windows; a worker starts afresh beyond them (memory only, results don't depend on it).
CACHE_WINDOWS = 500_000


# -- vocabularies ----------------------------------------------------------------
def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters are themselves,
    the other bytes are U+0100 and on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}


def a_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level BPE vocabulary (special tokens: their own text)."""
    table, out = byte_level(), [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return out


def b_bytes(processor) -> list[bytes]:
    """The bytes of each piece: UTF-8 with U+2581 as space, and <0xHH> as its byte."""
    return [bytes([int(processor.id_to_piece(i)[3:-1], 16)]) if processor.is_byte(i)
            else processor.id_to_piece(i).replace("▁", " ").encode() for i in range(processor.get_piece_size())]


class Tokens:
    """One vocabulary's ids as arrays: lengths in bytes, whether they begin with a space, and their bytes."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.size = np.array([len(x) for x in table], np.int32)
        self.spaced = np.array([x[:1] == b" " for x in table])

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _by_owner(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n[0] values, of the next n[1], and so on."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[np.concatenate(([0], np.cumsum(n)))])


def _inside(n: np.ndarray) -> np.ndarray:
    """0, 1, .. n[0] - 1, 0, 1, .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class PairEncoder(packing.WordEncoder):
    """Ids by both libraries, of chunks and of whole texts.

    As for the byte-level side, a text is cut before single spaces and line
    feeds. The pieces of the other side never go on across such a cut if none
    holds a line feed, or a space mark behind another character; otherwise
    each text is encoded whole.
    """

    def __init__(self, a_path: str, b_path: str):
        super().__init__(a_path)
        import sentencepiece
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = Tokens(a_bytes(self.tok)), Tokens(b_bytes(self.pieces))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.cuts = not any("\n" in x or "▁" in x.lstrip("▁") for x in names)
        self.space = self.pieces.piece_to_id("▁")

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    @staticmethod
    def chunks(text: str) -> list[str]:
        return (" " + text).replace("\n", " \n").split(" ")[1:]

    def encode_chunks(self, chunks: set[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """The chunks whose ids are their bytes on both sides, and of either side: their ids end to end, how many each has.

        ``JOINED`` chunks are one text, cut again at their bytes; the chunks of a text that is not its bytes, or has no
        token end at a cut, are encoded in shorter texts, at last one by one.
        """
        own = []
        for c in chunks:
            rest = c[1:] if c[:1] == "\n" else c
            if rest and not rest[0].isspace() and not rest[-1].isspace():  # beside white space: the text is encoded whole
                own.append(c if c[0] == "\n" else " " + c)
        found = []
        for n in JOINED:
            found.append(self._checked([["a", *own[k:k + n]] for k in range(0, len(own), n)]))
            done = set(found[-1][0])
            own = [c for c in own if c not in done]
        known = [c.removeprefix(" ") for names, _ in found for c in names]
        return known, [tuple(map(np.concatenate, zip(*(sides[k] for _, sides in found)))) for k in (0, 1)]

    def _checked(self, groups: list[list[str]]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """As ``encode_chunks``, of groups' chunks but the first, a word that keeps a side's space before the text from
        the second; without groups that are not their bytes."""
        texts = ["".join(g) for g in groups]
        wanted = [(" " + t).encode() for t in texts]
        size = np.array([len(w) for w in wanted], np.int64)
        sides = [[np.array(e.ids, np.int64) for e in self.tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)],
                 [np.array(ids, np.int64) for ids in self._pieces(texts)]]
        good = np.ones(len(groups), bool)
        ends = [np.cumsum([len(c.encode()) for c in g]) + 1 for g in groups]
        cuts = []
        for v, side in zip((self.a, self.b), sides):
            for k, ids in enumerate(side):
                end = np.cumsum(v.size[ids], dtype=np.int64)
                at = np.searchsorted(end, ends[k])
                good[k] &= len(end) and end[-1] == size[k] and bool((end[at] == ends[k]).all()) and v.joined(ids) == wanted[k]
                cuts.append(at + 1)
        keep = np.flatnonzero(good).tolist()
        out = []
        for side, own in zip(sides, (cuts[:len(groups)], cuts[len(groups):])):
            out.append((np.concatenate([np.zeros(0, np.int64), *(side[k][own[k][0]:] for k in keep)]),
                        np.concatenate([np.zeros(0, np.int64), *(np.diff(own[k]) for k in keep)])))
        return [c for k in keep for c in groups[k][1:]], out

    def encode_whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of space + text by A and of the text by B; both empty where a side's bytes are not those of space + text."""
        a, b = self._encode([" " + text])[0], array("I", self._pieces([text])[0]).tobytes()
        wanted = (" " + text).encode()
        if any(v.joined(np.frombuffer(x, "<u4")) != wanted for v, x in ((self.a, a), (self.b, b))):
            return b"", b""
        return a, b


# -- windows ---------------------------------------------------------------------
def align_window(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> tuple[str, int, int, list[tuple[int, int, int]]]:
    """(groups as text, groups, links, (A id, B id, links)) of ids that cover the same bytes; an id pair may come several times."""
    texts, links, pairs = [], 0, []
    i = j = 0
    while i < len(a):
        x, y = a[i], b[j]
        end_a, end_b = size_a[x], size_b[y]
        if end_a == end_b:
            texts.append(f"{x}|{y}")
            links += 1
            pairs.append((x, y, 1))
            i, j = i + 1, j + 1
            continue
        first_a, first_b = i, j
        while end_a != end_b:  # the side that is behind goes on
            if end_a < end_b:
                i += 1
                end_a += size_a[a[i]]
            else:
                j += 1
                end_b += size_b[b[j]]
        i, j = i + 1, j + 1
        own_a, own_b = a[first_a:i], b[first_b:j]
        texts.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
        links += len(own_a) * len(own_b)
        if len(own_a) * len(own_b) < 64:
            pairs += [(x, y, 1) for x in own_a for y in own_b]
        else:  # many tokens, few different ones
            count_b = Counter(own_b).items()
            pairs += [(x, y, n * m) for x, n in Counter(own_a).items() for y, m in count_b]
    return ";".join(texts), len(texts), links, pairs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


#: Between the two sides' ids in a window's key: no id is that large.
_BETWEEN = b"\xff" * 4


class Aligner:
    """Aligns texts and remembers windows: chunks by their text, others by their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.words = PairEncoder(a_path, b_path)
        self.a, self.b = self.words.a, self.words.b
        self.size_a, self.size_b = self.a.size.tolist(), self.b.size.tolist()
        # ids as text with what comes after them: A's inside and at the end of its part of a group, B's likewise
        n_a, n_b = len(self.size_a), len(self.size_b)
        self.names = [f"{k}{mark}" for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for k in range(n)]
        self.name_size = np.array([len(x) for x in self.names], np.int64)
        self.name_of = (np.array([0, n_a]), np.array([2 * n_a, 2 * n_a + n_b]))
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes | str, int] = {}
        self.apart: set[str] = set()  # chunks that are not encoded on their own
        self.texts: list[str] = []
        self.n_a, self.n_b, self.groups, self.links = (array("i") for _ in range(4))
        self.first, self.pair, self.times = array("q", [0]), array("Q"), array("i")  # windows' pairs, end to end

    def _remember(self, key: bytes | str, a: list[int], b: list[int]) -> int:
        text, groups, links, pairs = align_window(a, b, self.size_a, self.size_b)
        n = self.number[key] = len(self.texts)
        self.texts.append(text)
        for own, value in zip((self.n_a, self.n_b, self.groups, self.links), (len(a), len(b), groups, links)):
            own.append(value)
        self.pair.extend([x << 32 | y for x, y, _ in pairs])
        self.times.extend([times for _, _, times in pairs])
        self.first.append(len(self.pair))
        return n

    def window(self, a: bytes, b: bytes) -> int:
        key = a + _BETWEEN + b
        n = self.number.get(key)
        if n is None:
            n = self._remember(key, memoryview(a).cast("I").tolist(), memoryview(b).cast("I").tolist())
        return n

    def learn(self, chunks: set[str]) -> None:
        """Align new chunks, all at once."""
        known, ((a, n_a), (b, n_b)) = self.words.encode_chunks(chunks)
        self.apart |= chunks.difference(known)
        if not known:
            return
        end_a, end_b = np.cumsum(self.a.size[a], dtype=np.int64), np.cumsum(self.b.size[b], dtype=np.int64)
        at = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[at] == end_a)  # of each group
        last_b = at[last_a]
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        owner = np.searchsorted(np.cumsum(n_a), last_a, side="right")
        if (in_a * in_b).max() >= 64:  # many tokens: one at a time
            many = np.zeros(len(known), bool)
            many[owner[in_a * in_b >= 64]] = True
            stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
            for k in np.flatnonzero(many).tolist():
                self._remember(known[k], a[stop_a[k] - n_a[k]:stop_a[k]].tolist(), b[stop_b[k] - n_b[k]:stop_b[k]].tolist())
            known = [c for c, m in zip(known, many.tolist()) if not m]
            if not known:
                return
            a, b, rest = a[np.repeat(~many, n_a)], b[np.repeat(~many, n_b)], ~many[owner]
            n_a, n_b, in_a, in_b = n_a[~many], n_b[~many], in_a[rest], in_b[rest]
            owner = (np.cumsum(~many) - 1)[owner[rest]]
            last_a, last_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        # groups as text: A's ids of the first group, B's, A's of the next
        names = np.empty(len(a) + len(b), np.int64)
        for ids, last, place, (more, end) in ((a, last_a, np.arange(len(a)) + np.repeat(np.cumsum(in_b) - in_b, in_a), self.name_of[0]),
                                              (b, last_b, np.arange(len(b)) + np.repeat(np.cumsum(in_a), in_b), self.name_of[1])):
            code = ids + more
            code[last] += end - more
            names[place] = code
        text = "".join(map(self.names.__getitem__, names.tolist()))
        ends = np.cumsum(_by_owner(self.name_size[names], n_a + n_b)).tolist()
        n = len(self.texts)
        self.texts += [text[p:q - 1] for p, q in zip([0, *ends], ends)]
        links = in_a * in_b
        for own, values in zip((self.n_a, self.n_b, self.groups, self.links),
                               (n_a, n_b, np.bincount(owner, minlength=len(known)), np.bincount(owner, links, len(known)))):
            own.frombytes(values.astype(np.int32).tobytes())
        # a group's pairs: each of A's with each of B's
        inside, width = _inside(links), np.repeat(in_b, links)
        x = a[np.repeat(last_a + 1 - in_a, links) + inside // width].astype(np.uint64)
        y = b[np.repeat(last_b + 1 - in_b, links) + inside % width].astype(np.uint64)
        before = len(self.pair)
        self.pair.frombytes((x << np.uint64(32) | y).tobytes())
        self.times.frombytes(np.ones(len(x), np.int32).tobytes())
        self.first.frombytes((before + np.cumsum(np.bincount(owner, links, len(known)).astype(np.int64))).tobytes())
        self.number.update(zip(known, range(n, n + len(known))))

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, windows of each text, numbers of all windows)."""
        own: list[np.ndarray | None] = [None] * len(texts)
        if self.words.cuts:
            rows = [self.words.chunks(t) if t else [] for t in texts]
            new = set().union(*rows).difference(self.number, self.apart)
            if new:
                self.learn(new)
            get = self.number.__getitem__
            for k, r in enumerate(rows):
                try:
                    own[k] = np.array(array("q", map(get, r)))
                except KeyError:  # a chunk that is not encoded on its own
                    pass
        rest = [k for k, x in enumerate(own) if x is None]
        if rest:
            for k, x in zip(rest, self._align_whole([texts[k] for k in rest])):
                own[k] = x
        n_windows = np.array([len(x) for x in own], np.int64)
        numbers = np.concatenate(own) if own else np.zeros(0, np.int64)
        n_a, n_b = (_by_owner(np.frombuffer(x, np.int32)[numbers], n_windows) if len(numbers) else np.zeros(len(texts), np.int64)
                    for x in (self.n_a, self.n_b))
        return n_a, n_b, n_windows, numbers

    def _align_whole(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's windows, from the ids of the whole text."""
        a, b = ([np.frombuffer(x, "<u4") for x in side] for side in zip(*(self.words.encode_whole(t) if t else (b"", b"") for t in texts)))
        n_a = np.array([len(x) for x in a], np.int64)
        if not n_a.sum():
            return [np.zeros(0, np.int64)] * len(texts)
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        end_a, end_b = np.cumsum(self.a.size[ids_a], dtype=np.int64), np.cumsum(self.b.size[ids_b], dtype=np.int64)
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        shared = np.flatnonzero(end_b[at] == end_a)
        next_a, next_b = np.append(self.a.spaced[ids_a[1:]], True), np.append(self.b.spaced[ids_b[1:]], True)
        last = np.zeros(len(ids_a), bool)  # the last token of a text
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        stop_a = shared[(next_a[shared] & next_b[at[shared]]) | last[shared]]
        stop_b = at[stop_a]
        start_a, start_b = np.concatenate(([0], stop_a[:-1] + 1)), np.concatenate(([0], stop_b[:-1] + 1))
        numbers = self._numbers(ids_a, ids_b, start_a, stop_a + 1, start_b, stop_b + 1)
        return np.split(numbers, np.searchsorted(stop_a, np.cumsum(n_a))[:-1])

    def _numbers(self, ids_a, ids_b, start_a, stop_a, start_b, stop_b) -> np.ndarray:
        """The number of each window: distinct ones are found by a hash, compared id by id, and looked up by their ids."""
        raw_a, raw_b = ids_a.tobytes(), ids_b.tobytes()

        def look_up(windows: np.ndarray) -> list[int]:
            cuts = zip(*((4 * x[windows]).tolist() for x in (start_a, stop_a, start_b, stop_b)))
            return [self.window(raw_a[p:q], raw_b[r:s]) for p, q, r, s in cuts]
        key = np.zeros(len(start_a), np.uint64)
        sides = []
        for salt, ids, start, stop in ((1, ids_a, start_a, stop_a), (2, ids_b, start_b, stop_b)):
            size = stop - start
            place = np.arange(len(ids)) - np.repeat(start, size)
            key = _mix(key + np.add.reduceat(_mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(20)) + np.uint64(salt << 60)), start))
            sides.append((ids, start, size, place))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        same = all((size == size[first[which]]).all() and (ids == ids[np.repeat(start[first[which]], size) + place]).all()
                   for ids, start, size, place in sides)
        if not same:  # two windows with one hash
            return np.array(look_up(np.arange(len(start_a))), np.int64)
        return np.array(look_up(first), np.int64)[which]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each worker process and pair of vocabularies."""
    claim_memory("alignment", _ALIGNERS.clear)
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


# -- blocks ----------------------------------------------------------------------
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = pa.schema([("ids", pa.binary()), ("known", pa.binary()), ("counts", pa.binary()), ("digests", pa.binary()), ("held", pa.binary()),
                     ("held_pair", pa.binary()), ("held_times", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
                     ("docs", pa.list_(pa.int32()))])
_BLOCKS_DDL = ("ids binary, known binary, counts binary, digests binary, held binary, held_pair binary, held_times binary, "
               "a array<int>, b array<int>, docs array<int>")


def _sums(which: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sum of the values of each. All are 0 or more."""
    if not len(which):
        return which, values
    bits = int(values.max()).bit_length()
    if int(which.max()) >> (63 - bits):
        order = np.argsort(which, kind="stable")
        which, values = which[order], values[order]
    else:  # as one number: values are sorted much faster than places
        both = np.sort(which << bits | values)
        which, values = both >> bits, both & ((1 << bits) - 1)
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    return which[first], np.add.reduceat(values, first)


class _Block:
    """Documents until their texts have some MB: counts, digests and, in the end, each document's id pairs."""

    def __init__(self, own: Aligner):
        self.own, self.size = own, 0
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.doc, self.window, self.times = [], [], []

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        own = self.own
        n_a, n_b, n_windows, numbers = own.align(texts)
        stop = np.cumsum(n_windows)
        sums = [_by_owner(np.frombuffer(x, np.int32)[numbers], n_windows) if len(numbers) else np.zeros(len(ids), np.int64)
                for x in (own.groups, own.links)]
        self.counts.append(np.stack([n_a, n_b, *sums]))
        text, plain = own.texts, numbers.tolist()
        for p, q in zip((stop - n_windows).tolist(), stop.tolist()):
            self.digests.append(hashlib.sha256(";".join([text[k] for k in plain[p:q]]).encode()).hexdigest() if q > p else "")
        # a document's distinct windows
        doc = np.repeat(np.arange(len(ids)), n_windows) + len(self.ids)
        key, times = np.unique(doc << 32 | numbers, return_counts=True)
        self.doc.append((key >> 32).astype(np.int32))
        self.window.append((key & 0xFFFFFFFF).astype(np.int32))
        self.times.append(times.astype(np.int32))
        self.ids += ids
        self.size += sum(map(len, texts))

    def finish(self) -> pa.RecordBatch:
        own = self.own
        doc, window, times = (np.concatenate(x) for x in (self.doc, self.window, self.times))
        first = np.frombuffer(own.first, np.int64)
        size = first[window + 1] - first[window]
        # the block's distinct pairs, from those of its distinct windows
        used = np.flatnonzero(np.bincount(window, minlength=len(own.texts)))
        n = first[used + 1] - first[used]
        place = np.repeat(first[used], n) + _inside(n)
        pairs, number = np.unique(np.frombuffer(own.pair, np.uint64)[place], return_inverse=True)
        number_at = np.zeros(len(own.pair), np.int32)
        number_at[place] = number
        # one slice of a window's pairs for each document that holds it
        place = np.repeat(first[window], size) + _inside(size)
        key, held = _sums(np.repeat(doc.astype(np.int64), size) << 32 | number_at[place],
                          np.frombuffer(own.times, np.int32)[place] * np.repeat(times.astype(np.int64), size))
        del place
        known = np.array([i is not None for i in self.ids], np.uint8)
        pair = (key & 0xFFFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_pydict({
            "ids": [np.array([i or 0 for i in self.ids], np.int64).tobytes()], "known": [known.tobytes()],
            "counts": [np.concatenate(self.counts, axis=1).tobytes()], "digests": [zstandard.compress("\n".join(self.digests).encode(), 1)],
            "held": [np.bincount(key >> 32, minlength=len(self.ids)).astype(np.int64).tobytes()], "held_pair": [pack_numbers(pair)],
            "held_times": [pack_numbers(held)], "a": [(pairs >> np.uint64(32)).astype(np.int32)],
            "b": [(pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)], "docs": [np.bincount(pair, minlength=len(pairs)).astype(np.int32)]},
            schema=_BLOCKS)


def alignment_blocks(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, folder: str,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of aligned documents, written: what each document holds, and the block's distinct id pairs (a, b, docs)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        block = _Block(own)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < b.num_rows:  # slices, so that few texts are Python objects and arrays of tokens at once
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK_BYTES, side="right")))
                ids, texts = (b.column(k).slice(start, stop - start).to_pylist() for k in (0, 1))
                block.add(ids, [t or "" for t in texts])
                if block.size >= block_bytes:
                    yield block.finish()
                    if len(own.texts) > CACHE_WINDOWS:
                        own.forget()
                    block = _Block(own)
                start = stop
        if block.ids:
            yield block.finish()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, _BLOCKS_DDL).withColumn("block", F.monotonically_increasing_id()), "blocks", folder)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold each id pair, and whether no other pair of that A id is in more."""
    counts = (blocks.select(F.inline(F.arrays_zip("a", "b", "docs"))).groupBy("a", "b")
              .agg(F.sum(F.col("docs").cast("long")).alias("count")))
    # an A id has one row for each B id at most
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


_ROWS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()),
                   ("groups_sha256", pa.string())])


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
                    b_path: str | None = None, folder: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A is a byte-level BPE vocabulary of space + text, B a SentencePiece one of
    the text, which adds the space; strings of special tokens are plain text.
    Null and empty texts, and those whose joined bytes on a side are not space
    + text (a literal U+2581), have no tokens: zeros and ''. Repeated rows are
    documents of their own and count as such; a null id stays null; an empty
    table gives no rows; other columns are ignored. One text's tokens are held
    in one task.
    """
    folder = folder or work_dir(docs.sparkSession)
    blocks = alignment_blocks(docs, id_col, text_col, a_path or packing.tokenizer_path(), b_path or sentence_pieces.vocabulary_path(),
                              folder, block_bytes)
    counts = written(pair_counts(blocks), "counts", folder)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "pair")).select("block", "at", "pair.a", "pair.b")
    # one answer for each distinct pair of a block
    answers = (asked.join(counts, ["a", "b"]).groupBy("block")
               .agg(F.collect_list(F.struct("at", "count", "best")).alias("answers")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, known, counts, digests, held, held_pair, held_times = (batch.column(j)[k].as_py() for j in range(7))
                known = np.frombuffer(known, bool)
                told = batch.column(7)[k].values
                n = 0 if told is None else len(told)
                count, best = np.zeros(n, np.int64), np.zeros(n, bool)
                if n:
                    at = told.field("at").to_numpy()
                    count[at] = told.field("count").to_numpy()
                    best[at] = told.field("best").to_numpy(zero_copy_only=False)
                pair, times = unpack_numbers(held_pair, np.int32), unpack_numbers(held_times, np.int64)
                stop = np.concatenate(([0], np.cumsum(np.frombuffer(held, np.int64))))
                sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[stop]) for x in (times * best[pair], times * count[pair])]
                columns = [*np.frombuffer(counts, np.int64).reshape(4, -1), *sums]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64), mask=~known), *map(pa.array, columns),
                                                  pa.array(zstandard.decompress(digests).decode().split("\n"), pa.string())], schema=_ROWS)
    return (blocks.drop("a", "b", "docs").join(answers, "block", "left")
            .select("ids", "known", "counts", "digests", "held", "held_pair", "held_times", "answers")
            .mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
