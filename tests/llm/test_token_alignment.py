"""Cross-tokenizer alignment against the libraries and a plain brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metercast.llm import packing, queries, sentence_pieces, token_alignment

from ..conftest import SF_SMALL

TEXTS = st.text(alphabet=st.sampled_from(" \n\t.,!aeinorstAT0é中ß<x>|\x00😀 '"), max_size=60)


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    ranks = {int(i): base64.b64decode(x) for x, i in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    p = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    return t, ranks, p


def brute_groups(text, libraries):
    """(ids A, ids B, groups as (A ids, B ids)) or None where there are no tokens."""
    t, ranks, p = libraries
    if not text:
        return None
    a, b = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)
    bytes_a = [ranks[i] for i in a]
    bytes_b = [bytes([int(s[3:5], 16)]) if len(s) == 6 and s.startswith("<0x") else s.replace("▁", " ").encode()
               for s in map(p.id_to_piece, b)]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    cut_a, cut_b = (np.cumsum([len(x) for x in s]).tolist() for s in (bytes_a, bytes_b))
    groups, start = [], 0
    for end in sorted(set(cut_a) & set(cut_b)):
        groups.append(([i for i, e in zip(a, cut_a) if start < e <= end], [i for i, e in zip(b, cut_b) if start < e <= end]))
        start = end
    return a, b, groups


def brute(rows, libraries):
    docs = [(i, brute_groups(t, libraries)) for i, t in rows]
    links = [Counter((x, y) for xs, ys in g[2] for x in xs for y in ys) if g else Counter() for _, g in docs]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, g), own in zip(docs, links):
        text = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g[2]) if g else None
        out.append((i, len(g[0]) if g else 0, len(g[1]) if g else 0, len(g[2]) if g else 0, sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def own():
    return token_alignment.Aligner(packing.tokenizer_path(), sentence_pieces.vocabulary_path())


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=12))
def test_windows_give_the_groups_of_whole_texts(texts, own, libraries):
    n_a, n_b, n_windows, numbers = own.align(texts)
    at = 0
    for t, a, b, n in zip(texts, n_a, n_b, n_windows):
        g = brute_groups(t, libraries)
        got = ";".join(own.texts[k] for k in numbers[at:at + n])
        at += n
        assert (a, b) == ((len(g[0]), len(g[1])) if g else (0, 0))
        assert got == (";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g[2]) if g else "")


def test_equal_hashes_of_different_windows(own, libraries, monkeypatch):
    text = "the quick brown fox, the lazy dog; thé brown <|endoftext|> fox"
    want = own.align([text])[3].tolist()
    monkeypatch.setattr(token_alignment, "_mix", lambda x: x * np.uint64(0))
    assert own.align([text])[3].tolist() == want
    assert len(own.number) == len(own.texts)


def test_new_chunks_are_encoded_together(libraries, monkeypatch):
    own, seen = token_alignment.Aligner(packing.tokenizer_path(), sentence_pieces.vocabulary_path()), []
    plain = own.words._pieces
    monkeypatch.setattr(own.words, "_pieces", lambda texts: seen.extend(texts) or plain(texts))
    words = [f"wo{k:03}rd{'.,!'[k % 3]}" for k in range(900)]
    texts = [" ".join(words[:500]), "\n".join(words[400:]), " ".join(words[:3] + ["x▁y", "|" * 90, "z\tz"] + words[-3:]), "x  y", ""]
    n_a, n_b, n_windows, numbers = own.align(texts)
    assert len(seen) < 100  # not each chunk by itself
    start = 0
    for t, a, b, n in zip(texts, n_a, n_b, n_windows):
        g = brute_groups(t, libraries) or ([], [], [])
        assert (a, b) == (len(g[0]), len(g[1]))
        assert ";".join(own.texts[k] for k in numbers[start:start + n]) == ";".join(
            f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g[2])
        start += n
    assert [own.groups[k] for k in numbers[:n_windows[0]]] == [own.texts[k].count("|") for k in numbers[:n_windows[0]]]


def test_a_group_of_many_tokens_is_counted_not_listed():
    text, groups, links, pairs = token_alignment.align_window([2] * 200 + [0], [0] + [2] * 200, [1, 2, 3], [1, 2, 3])
    assert (groups, links) == (1, 201 * 201)
    assert sorted(pairs) == [(0, 0, 1), (0, 2, 200), (2, 0, 200), (2, 2, 200 * 200)]


@pytest.mark.parametrize("block_bytes", [1, 1500, 1 << 24])
def test_documents_against_brute_force(make_docs, messy_rows, libraries, block_bytes):
    rows = [(i, t if t is None else t[:6000]) for i, t in messy_rows] + [(50, "a" * 2500 + " " + "ab" * 400), (51, " " * 300), (52, "▁"),
            (53, "<s> </s> <unk> <0x41> <|endoftext|>"), (54, "中文😀" * 200), (55, "  two  spaces  ")]
    want = brute(rows, libraries)
    assert result(token_alignment.align_documents(make_docs(rows, 4), block_bytes=block_bytes)) == want
    assert sum(not r[1] for r in want) >= 4


def test_empty_table(make_docs):
    assert token_alignment.align_documents(make_docs([])).count() == 0


def test_query_on_a_whole_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op11_token_alignment"](spark, SF_SMALL)) == brute(rows, libraries)
