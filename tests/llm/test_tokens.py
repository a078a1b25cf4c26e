"""SentencePiece and packing against the libraries."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metercast.llm import packing, sentence_pieces

PIECES = st.text(alphabet=st.sampled_from(" \n\t▁.,!aeinorstAT0é中ß<x>|\x00😀\u00a0\u2028'"), max_size=60)


@pytest.fixture(scope="module")
def pieces_library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.vocabulary_path())


@pytest.fixture(scope="module")
def bpe_library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


# -- SentencePiece --------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(PIECES, min_size=1, max_size=20))
def test_pieces_equal_the_library(texts, pieces_library):
    codec = sentence_pieces.codec(sentence_pieces.vocabulary_path())
    for t, data in zip(texts, codec.encode(texts)):
        assert ids_of(data) == pieces_library.encode(t)
        assert codec.decode(data) == pieces_library.decode(pieces_library.encode(t))


def test_long_words(pieces_library):
    codec = sentence_pieces.codec(sentence_pieces.vocabulary_path())
    texts = ["a" * 3000, "the" * 700, " " * 90, "▁" * 33, "\n" * 70, "中文" * 300, "xyzzy." * 200, "aab" * 500 + " " + "ab" * 31]
    assert [ids_of(x) for x in codec.encode(texts)] == pieces_library.encode(texts)


def test_suffix_array_matching():
    text = sentence_pieces._codes("banana\0bandana\0")
    order = sentence_pieces.suffix_array(text, 16).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    codec = sentence_pieces.codec(sentence_pieces.vocabulary_path())
    at, piece = codec.edges(text)
    plain = "banana\0bandana\0"
    want = {(i, n) for p, n in codec.id.items() for i in range(len(plain)) if plain.startswith(p, i)}
    assert set(zip(at.tolist(), piece.tolist())) == want


def test_encode_and_decode_tables(make_docs, messy_rows, pieces_library):
    docs = make_docs(messy_rows)
    encoded = sentence_pieces.encode_pieces(docs)
    got = sorted(((r.doc_id, ids_of(r.ids)) for r in encoded.collect()), key=str)
    assert got == sorted(((i, pieces_library.encode(t or "")) for i, t in messy_rows), key=str)
    back = Counter((r.doc_id, r.text) for r in sentence_pieces.decode_pieces(encoded).collect())
    assert back == Counter((i, (t or "").replace("▁", " ")) for i, t in messy_rows)
    digest = sentence_pieces.round_trip(docs).collect()
    assert {r.doc_id for r in digest if not r.decoded_equal} == {20}  # it holds a literal U+2581
    assert sentence_pieces.encode_pieces(make_docs([])).count() == 0


# -- packing ----------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(PIECES, min_size=1, max_size=20))
def test_words_encode_as_whole_texts(texts, bpe_library):
    got = packing.encoder(packing.tokenizer_path()).encode(texts)
    assert [ids_of(x) for x in got] == [bpe_library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, docs, library, capacity=1024):
    want = []
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(min(first, len(ids)), len(ids), capacity), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled), sum(w[3] for w in want)


def test_packing(make_docs, messy_rows, bpe_library):
    rng = np.random.default_rng(3)
    docs = messy_rows + [(3000 + k, "word " * int(rng.integers(1, 900))) for k in range(150)] + [(4000 + k, "tie") for k in range(70)]
    n, total = check_packing(packing.pack_documents(make_docs(docs)).collect(), docs, bpe_library)
    assert n <= 1.02 * -(-total // 1024) + 1
    assert packing.pack_documents(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_is_complete_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = 64
    lengths = rng.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(capacity, rng.geometric(0.1, 3000))
    hist = np.bincount(lengths, minlength=capacity + 1)
    runs, sequences = packing.pack_histogram(hist, capacity)
    used, fill = np.zeros(capacity + 1, int), defaultdict(list)
    for r in sorted(runs, key=lambda r: (r.length, r.rank)):
        assert r.rank == used[r.length]  # ranks without gaps
        used[r.length] += r.count
        for k in range(r.count):
            fill[r.sequence + k].append((r.offset, r.length))
    assert used.tolist() == hist.tolist() and len(fill) == sequences
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sequences <= 1.05 * -(-int(lengths.sum()) // capacity) + 1 or seed % 2


def test_patterns_and_pieces():
    assert packing.exact_patterns([1, 2, 3], 4, 3) == [(3, 1), (2, 2), (2, 1, 1)]
    assert packing.exact_patterns([4], 4, 1) == [(4,)]
    assert packing.piece_bounds(5, 4) == [(0, 1), (1, 4)] and packing.piece_bounds(8, 4) == [(0, 4), (4, 4)]
    assert packing.piece_bounds(4, 4) == [(0, 4)] and packing.piece_bounds(1, 4) == [(0, 1)]
    x = packing.nnls_repeats([(3, 1), (2, 2), (2, 1, 1)], np.array([0, 10, 6, 4, 0]))
    assert (x >= 0).all()
    assert packing.pack_histogram(np.zeros(9, int), 8) == ([], 0)


def test_query_and_stage_encode_by_the_library_default(spark, make_docs, tmp_path):
    import corpus_pipeline
    from metercast.llm.queries import QUERIES
    from tokenizers import Tokenizer
    rows = [(1, "hi <|endoftext|> there"), (2, "hi there"), (3, "<|endoftext|>"), (4, "a<|endoftext|><|endoftext|>\n b"), (5, None)]
    docs = make_docs(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(packing.tokenizer_path())
    check_packing(QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect(), rows, library)
    check_packing(dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, str(tmp_path)).collect(), rows, library)


def test_chunks_without_ids_of_their_own_send_only_their_text_to_the_library():
    assert packing.joined([b"ab", b"", b"c"]) == b"abc" and packing.joined([]) == b""
    assert packing.joined([b"ab", False, b"c"]) is None
    enc = packing.WordEncoder(packing.tokenizer_path())
    texts = ["one two, three", "", "a  b", " ", "\n\n", "one\ttwo three", "three\n one", "one two, three"] * 2
    whole, asked = enc._encode, []
    enc._encode = lambda t: asked.append(list(t)) or whole(t)
    assert enc.encode(texts) == whole(texts)
    assert ["a  b"] in asked and not any("one two, three" in x for x in asked)
