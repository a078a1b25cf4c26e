"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are concatenated and indexed by a suffix array. Each
piece of the vocabulary is binary-searched in it; its range lists all places
where it occurs. Those edges are sorted by position and relaxed from left to
right. For a BPE vocabulary an edge holds if the piece may follow the piece
that the prefix before it ends with: a sequence of pieces is the BPE result of
its text exactly if every two neighbours are the result of theirs, and every
prefix has one last piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim_memory, map_texts, text_bytes

SPACE = "▁"
#: Encoded words that a worker keeps; it starts afresh beyond that (memory only, results don't depend on it).
CACHE_WORDS = 400_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary_path() -> str:
    """The public SentencePiece vocabulary, installed beside the libraries on every machine."""
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` ordered by their first ``depth`` codes, by prefix doubling.

    The first sort takes as many codes at once as fit in one integer.
    """
    letters, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1          # 0: beyond the end
    bits = int(len(letters)).bit_length()
    width = max(1, min(depth, 62 // bits))
    key = np.zeros(len(text), np.int64)
    for j in range(width):
        key <<= bits
        key[:max(0, len(text) - j)] |= rank[j:]
    while True:
        order = np.argsort(key)
        new = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        if width >= depth or new[-1] == len(text):
            return order
        rank = np.empty(len(text), np.int64)
        rank[order] = new
        key = rank * (int(new[-1]) + 1)
        key[:-width] += rank[width:]
        width *= 2


class PieceCodec:
    """Encoder and decoder of one BPE vocabulary with byte fallback.

    Only the vocabulary (pieces, scores, kinds) is read by the library. The
    vocabulary's normalisation has to be the identity with a leading space
    and white space escaped, as in the public file.
    """

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        byte_ids = [self.unknown] * 256
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_unknown(i):
                self.bytes_of.append(b" \xe2\x81\x87 ")
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or sp.is_unused(i):
                    raise ValueError(f"piece {i} ({piece}): spaces inside pieces and unused pieces are not supported")
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.byte_ids = np.array(byte_ids, "<u4")
        self.pieces = sorted(self.id)
        self.depth = max(map(len, self.pieces))
        self.piece_ids = np.array([self.id[p] for p in self.pieces], np.int64)
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.table = np.full((len(self.pieces), self.depth), -1, np.int64)
        for k, p in enumerate(self.pieces):
            self.table[k, :len(p)] = _codes(p)
        self.text_of = {i: p for p, i in self.id.items()}
        self.len_of = np.ones(self.size, np.int64)
        self.len_of[self.piece_ids] = self.piece_len
        self.pairs_inside = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.follows: dict[int, bool] = {}
        if any("\n" in p for p in self.pieces):
            raise ValueError("line feeds inside pieces are not supported")
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    # -- one pair of pieces -------------------------------------------------
    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(parts[k] + parts[k + 1], -np.inf), -k) for k in range(len(parts) - 1)))
            if best[0] == -np.inf:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each piece ``right`` may come next to ``left`` (-1: the text's start). Ids from size on: other characters."""
        start = left < 0
        free = start | (left >= self.size) | (right >= self.size)
        code = np.where(start, -right - 1, left * self.size + right)
        # at the start the piece has to be the result of its own text
        ask, where = np.unique(code[(~free) | (start & (right < self.size))], return_inverse=True)
        known = np.empty(len(ask), bool)
        for k, c in enumerate(ask.tolist()):
            if (ok := self.follows.get(c)) is None:
                parts = [self.text_of[-c - 1]] if c < 0 else [self.text_of[c // self.size], self.text_of[c % self.size]]
                ok = self.follows[c] = self.merged("".join(parts)) == parts
            known[k] = ok
        out = np.ones(len(left), bool)
        out[(~free) | (start & (right < self.size))] = known[where]
        return out

    # -- a batch of words ---------------------------------------------------
    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece id) of every occurrence of every piece, by suffix array and binary search."""
        sa = suffix_array(text, self.depth)
        padded = np.concatenate([text, np.full(self.depth, -1, np.int64)])

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), len(sa), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = sa[np.minimum(mid, len(sa) - 1)]
                less = np.zeros(len(lo), bool)     # suffix before the piece
                same = np.ones(len(lo), bool)      # no difference so far
                for j in range(self.depth):
                    want = self.table[:, j]
                    live = same & (want >= 0)
                    if not live.any():
                        break
                    have = padded[at + j]
                    less |= live & (have < want)
                    same &= ~live | (have == want)
                right = open_ & (less | (same & upper))
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            return lo
        first, last = bound(False), bound(True)
        n = last - first
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return sa[place], np.repeat(self.piece_ids, n)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the distinct words, which don't merge with their neighbours."""
        sizes = np.array([len(w) for w in words], np.int64)
        text = _codes("\0".join(words) + "\0")  # a NUL in a word is no piece either
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        word = np.repeat(np.arange(len(words)), sizes + 1)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        at, piece = self.edges(text)
        single = np.zeros(len(text), bool)
        single[at[self.len_of[piece] == 1]] = True
        other = np.flatnonzero(inside & ~single)     # characters without a piece of their own
        at = np.concatenate([at, other])
        piece = np.concatenate([piece, self.size + text[other]])
        length = np.ones(len(at), np.int64)
        known = piece < self.size
        length[known] = self.len_of[piece[known]]
        # sorted by the place in its word where an edge ends; all words advance together
        end = at + length - starts[word[at]]
        order = np.argsort(end)
        at, piece, length, end = at[order], piece[order], length[order], end[order]
        cuts = np.searchsorted(end, np.arange(1, int(sizes.max(initial=0)) + 2))
        last = np.full(len(text) + 1, -2, np.int64)  # -2: not reached; -1: a word's start
        last[starts] = -1
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            left = last[at[a:b]]
            live = np.flatnonzero(left != -2) + a
            live = live[self.may_follow(last[at[live]], piece[live])]
            # a word's start position is the position after its predecessor's separator: ends never reach it
            last[at[live] + length[live]] = piece[live]
        back, begin = last.tolist(), starts.tolist()
        lens = self.len_of.tolist()
        out = []
        for k, e in enumerate(ends.tolist()):
            ids: list[int] = []
            while e > begin[k]:
                p = back[e]
                if p >= self.size:
                    ids.extend(self.byte_ids[list(chr(p - self.size).encode("utf-8", "replace"))].tolist()[::-1])
                    e -= 1
                else:
                    ids.append(p)
                    e -= lens[p]
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def _chunk_parts(self, chunk: str) -> list[str]:
        """A chunk, cut before a last mark and, if long, everywhere, where no piece holds both neighbours."""
        if len(chunk) > 64:
            cuts = [k for k in range(1, len(chunk)) if chunk[k - 1:k + 1] not in self.pairs_inside]
            return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]
        if len(chunk) > 2 and chunk[-1] in ".,!" and chunk[-2:] not in self.pairs_inside:
            return [chunk[:-1], chunk[-1]]
        return [chunk]

    def _learn(self, chunks: list[str]) -> None:
        parts = [self._chunk_parts(c if c[0] in (SPACE, "\n") else SPACE + c) for c in chunks]
        distinct = list({p for ps in parts for p in ps}.difference(self.parts))
        if distinct:
            self.parts.update(zip(distinct, self._encode_words(distinct)))
        self.cache.update((c, b"".join([self.parts[p] for p in ps])) for c, ps in zip(chunks, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) + len(self.parts) > CACHE_WORDS:
            self.cache.clear()
            self.parts.clear()
        # no piece crosses from a word into the next space, nor a line feed: texts are cut before them
        rows, new = [], set()
        for t in texts:
            if not t:
                rows.append([])
            elif SPACE in t or t[0] in " \n" or t[-1] == " " or "  " in (cut := t.replace("\n", " \n")):
                rows.append(_CHUNK.findall(SPACE + t.replace(" ", SPACE)))  # chunks with their leading space
            else:
                rows.append(cut.split(" "))                                 # chunks without it, or a line feed's
            new |= set(rows[-1]).difference(self.cache)
        if new:
            self._learn(list(new))
        return [b"".join(map(self.cache.__getitem__, r)) for r in rows]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data[data[:1] == b" ":].decode("utf-8", "replace")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and vocabulary."""
    claim_memory("pieces", _CODECS.clear)
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the whole text's piece ids as little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Repeated rows repeat; an empty table
    gives an empty result; other columns are ignored.
    """
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    return map_texts(text_bytes(docs, id_col, text_col),
                     lambda ids, texts, c: {"doc_id": ids, "ids": c.encode([t.decode("utf-8", "replace") for t in texts])},
                     "doc_id long, ids binary", schema, setup=lambda: codec(path))


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Literal U+2581 in the encoded text comes back as a space."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return map_texts(encoded.selectExpr("doc_id", "coalesce(ids, cast('' as binary)) AS data"),
                     lambda ids, data, c: {"doc_id": ids, "text": [c.decode(x) for x in data]},
                     "doc_id long, text string", schema, setup=lambda: codec(path))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_equal): a digest of each text's ids, and whether they decode to the text."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()),
                        ("decoded_equal", pa.bool_())])

    def digest(ids, texts, c):
        texts = [t.decode("utf-8", "replace") for t in texts]
        data = c.encode(texts)
        return {"doc_id": ids, "n_ids": [len(x) // 4 for x in data], "ids_crc32": [zlib.crc32(x) for x in data],
                "decoded_equal": [c.decode(x) == t for x, t in zip(data, texts)]}
    return map_texts(text_bytes(docs, id_col, text_col), digest,
                     "doc_id long, n_ids long, ids_crc32 long, decoded_equal boolean", schema, setup=lambda: codec(path))
