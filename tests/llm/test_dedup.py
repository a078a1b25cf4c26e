"""Exact, line, suffix-array and near-duplicate operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from metercast.llm import common, components, exact_dedup, jaccard_join, line_dedup, suffix_arrays, suffix_dedup

from ..conftest import SF_SMALL
from .conftest import SENTENCE, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# -- exact ------------------------------------------------------------------------
def brute_exact(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t or "")] if x is not None]
        best = keep(ids) if ids else None
        out.append((i, best, len(groups[lower(t or "")]), i == best, hashlib.sha256(lower(t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(make_docs, messy_rows, keep):
    rows = messy_rows + [(100 + k, "same text") for k in range(50)] + [(200, "É"), (201, "é")]
    got = exact_dedup.exact_dedup(make_docs(rows), keep=keep)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(rows, min if keep == "min" else max)
    assert exact_dedup.exact_dedup(make_docs([])).count() == 0


def test_exact_dedup_keeps_colliding_texts_apart(make_docs):
    from pyspark.sql import functions as F
    rows = [(1, "ab"), (2, "cd"), (3, "AB"), (4, "ef")]
    got = exact_dedup.exact_dedup(make_docs(rows), keep="min", hash_fn=lambda c: F.lit(b"0" * 16))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


# -- lines ------------------------------------------------------------------------
def brute_lines(rows):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    holder = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if i is not None and len(key(s)) >= 10:
                holder[key(s)] = min(holder.get(key(s), i), i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [s for s in all_ if i is None or holder.get(key(s), i) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(docs):
    got = line_dedup.with_kept(docs, line_dedup.line_dedup(docs))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in got.collect()), key=str)


def test_line_dedup(make_docs, messy_rows):
    rows = messy_rows + [(300 + k, f"shared line number one\nunique line number {k}\nshared line number one") for k in range(40)]
    assert line_rows(make_docs(rows, 5)) == brute_lines(rows)
    assert line_rows(make_docs([])) == []


def test_line_runs_across_partitions(spark, make_docs):
    """A line of all documents is cut over partitions; the smallest document keeps it."""
    rows = [(k, "the very common line\n" * (1 + k % 3) + f"own line of document {k}") for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = line_dedup.line_keys(line_dedup.text_bytes(make_docs(rows)))
        sizes = keys.repartitionByRange("h", "doc_id").rdd.glom().map(len).collect()
        assert max(sizes) < 300  # 1,200 equal keys, but not in one task
        assert line_rows(make_docs(rows)) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps():
    for gone in ([0], [3], [7, 8], [0, 1, 2, 9, 31]):
        bits = line_dedup.keep_bitmap(gone)
        assert line_dedup.dropped_positions(bits, 40).tolist() == gone
    assert line_dedup.dropped_positions(None, 5).tolist() == []
    bounds = [(0, b"a", b"b", 1, 4), (1, b"b", b"b", 9, 9), (2, b"b", b"c", 12, 2), (3, b"d", b"d", 5, 5)]
    assert line_dedup.first_holders(bounds) == [(0, 1), (1, 4), (2, 4), (3, 5)]


# -- suffix arrays ------------------------------------------------------------------
def test_induced_sorting():
    rng = np.random.default_rng(4)
    for _ in range(150):
        s = rng.integers(1, rng.choice([3, 4, 300]), rng.integers(0, 60)).tolist()
        s = (s[:6] * 8 if rng.random() < 0.3 else s) + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_arrays.suffix_array(np.array(s)).tolist() == want
        assert suffix_arrays._induced_list(s, max(s) + 1) == want


def test_designated_grams_agree_for_equal_windows():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 101, 200).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 123, 333).astype(np.uint8), shared])
    b = np.concatenate([shared, rng.integers(97, 123, 77).astype(np.uint8)])

    def by_window(data):
        h, first, n, _ = suffix_dedup.designated(data, np.array([len(data)]))
        return np.repeat(h, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    (ha, pa_), (hb, pb) = by_window(a), by_window(b)
    assert pa_.tolist() == list(range(len(a) - 49)) and pb.tolist() == list(range(len(b) - 49))
    assert (ha[333:333 + 151] == hb[:151]).all()


def test_designated_grams_spread_over_the_shards(spark):
    texts = [r.text.encode() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect() if r.text]
    hashes = suffix_dedup.designated(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))[0]
    for shards in (4, 64):
        shard = np.unique(hashes) >> np.uint64(suffix_dedup._HASH_BITS - shards.bit_length() + 1)
        assert np.bincount(shard.astype(int), minlength=shards).max() < 2 / shards * len(shard)


def brute_spans(rows, length=50):
    first = {}
    for i, t in rows:
        x = (t or "").encode()
        for p in range(len(x) - length + 1 if i is not None else 0):
            w = x[p:p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1 if i is not None else 0):
            if first[x[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(x), [a for a, _ in runs], [b for _, b in runs], bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=str)


def test_suffix_dedup(make_docs, messy_rows, monkeypatch):
    rng = np.random.default_rng(9)
    rows = list(messy_rows)
    base = "".join(rng.choice(list("abcde "), 3000))
    for k in range(40):  # passages of all lengths around the limit, at odd places, with changed bytes
        a, n = int(rng.integers(0, 2500)), int(rng.integers(40, 400))
        part = list(base[a:a + n])
        if k % 3 == 0:
            part[n // 2] = "é"
        rows.append((1000 - k, "".join(rng.choice(list("abcde "), 70)) + "".join(part) + "".join(rng.choice(list("xyz"), 30))))
    rows += [(2000 + k, base[500:700]) for k in range(30)]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    got = suffix_dedup.removed_spans(make_docs(rows))
    assert sorted(((r.doc_id, r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in got.collect()), key=str) == brute_spans(rows)
    assert suffix_dedup.removed_spans(make_docs([])).count() == 0


def hot_rows(n):
    """A passage of every second text and a phrase of every third, each within text of the document's own."""
    rng = np.random.default_rng(5)
    own = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    passage, phrase = own(140), "a phrase of many documents "
    return [(7 * k % n, own(45) + (passage if k % 2 else "") + own(30) + (phrase if k % 3 else "") + own(40)) for k in range(n)]


@pytest.mark.parametrize("hot_segments", [0, 5, 60])
def test_hot_grams_are_split_by_window(make_docs, messy_rows, monkeypatch, hot_segments):
    rows = hot_rows(200) + [(i if i is None else i + 10_000, t) for i, t in messy_rows if len(t or "") < 1000]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 2_000)
    got = suffix_dedup.removed_spans(make_docs(rows, 5), hot_segments=hot_segments)
    assert sorted(((r.doc_id, r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in got.collect()), key=str) == brute_spans(rows)


def test_a_hot_gram_is_no_group_of_its_own(monkeypatch):
    """However many documents share a passage, what comes to one place by one hash, and goes into one suffix array, is bounded."""
    rows = hot_rows(20_000)
    blocks = []
    for k in range(4):
        own = rows[5000 * k:5000 * (k + 1)]
        texts = [t.encode() for _, t in own]
        blocks.append(suffix_dedup.Block(np.array([i for i, _ in own]).tobytes(), np.array([len(t) for t in texts]).tobytes(),
                                         suffix_dedup.zstandard.compress(b"".join(texts)), 50, 24, 1))
    told = suffix_dedup.shared_hashes([(k, *x.ask_grams()[0][1:]) for k, x in enumerate(blocks)], 4000)
    hot = {k: bits for k, _, bits, _ in told if bits}
    wide = {k: bits for k, bits, *_ in suffix_dedup.shared_hashes(
        [(k, *blocks[k].ask_windows([(0, bits)])[0][1:]) for k, bits in hot.items()])}
    sent, keys, calls = [], [], []
    for k, bits, *_ in told:
        *_, segments, hashes, low, _ = blocks[k].segments([(0, bits, hot.get(k), wide.get(k))])
        order = np.argsort(hashes, kind="stable")
        segments, hashes, low = [segments[j] for j in order], hashes[order], low[order]
        assert len(set(segments)) == len(segments)
        sent.append((k, suffix_dedup.pack_numbers(np.diff(hashes, prepend=np.uint64(0))),
                     suffix_dedup.pack_numbers(np.array([len(x) for x in segments], np.int32)),
                     suffix_dedup.zstandard.compress(b"".join(segments)), suffix_dedup.pack_numbers(low)))
        keys.append(hashes)
    assert np.unique(np.concatenate(keys), return_counts=True)[1].max() <= 4000
    index = suffix_dedup.window_owners
    monkeypatch.setattr(suffix_dedup, "window_owners", lambda keys, *more: calls.append(sum(map(len, keys))) or index(keys, *more))
    found = suffix_dedup.answer_segments(sent, 50)
    assert [x[0] for x in found] == [0, 1, 2, 3] and hot and max(calls, default=0) <= suffix_dedup.INDEX_BYTES


# -- near duplicates ------------------------------------------------------------------
def shingles(t, size=3):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, percent=90, size=3):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    rng = np.random.default_rng(6)
    rows = []
    for f in range(12):
        words = [f"w{x}" for x in rng.integers(0, 400, 60 + 10 * f)]
        for k in range(1 + f):
            w = list(words)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 50)}"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += [(2000 + k, " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 8)))) for k in range(60)]
    return rows


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_near_duplicates(make_docs, messy_rows, monkeypatch, percent, size):
    monkeypatch.setattr(jaccard_join, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(jaccard_join, "PART_SHINGLES", 300)  # families in several parts
    rows = messy_rows + near_rows()
    got = jaccard_join.near_duplicates(make_docs(rows), percent=percent, size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_components(rows, percent, size)
    assert len(got) == len(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.near_duplicates(make_docs([])).count() == 0


def test_family_links_find_all_components():
    rng = np.random.default_rng(8)
    for _ in range(40):
        base = np.unique(rng.integers(0, 10**6, 80).astype(np.uint64))
        sets = []
        for _ in range(25):
            s = base[rng.random(len(base)) > rng.choice([0.0, 0.03, 0.1])]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 10**6, rng.integers(0, 5)).astype(np.uint64)])))
        docs = rng.permutation(1000)[:25].tolist()
        parent = {d: d for d in docs}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        plain = {d: d for d in docs}
        for a, b in jaccard_join.family_links(docs, sets):
            parent[max(find(a), find(b))] = min(find(a), find(b))
        groups = {d: find(d) for d in docs}
        parent = plain
        for x in range(25):
            for y in range(x):
                n = len(np.intersect1d(sets[x], sets[y]))
                if 100 * n >= 90 * (len(sets[x]) + len(sets[y]) - n):
                    a, b = find(docs[x]), find(docs[y])
                    parent[max(a, b)] = min(a, b)
        assert groups == {d: find(d) for d in docs}


def test_connected_components(spark):
    links = [(5, 4), (4, 9), (9, 1), (20, 21), (21, 20), (7, 7), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (40, None)]
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    want = {1: 1, 4: 1, 5: 1, 9: 1, 20: 20, 21: 20, **{k: 30 for k in range(30, 36)}}
    assert {r.node: r.component for r in got.collect()} == want
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


def test_rows_are_as_many_as_documents(make_docs):
    rows = [(k, SENTENCE) for k in range(200)] + [(500, SENTENCE + " more words than before here")]
    docs = make_docs(rows)
    near = jaccard_join.near_duplicates(docs)
    assert Counter(r.component_id for r in near.collect())[0] == 200
    assert len(rows_of(suffix_dedup.removed_spans(docs))) == 201


def test_segments_without_a_repeated_window_need_no_sort():
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 101, 70, np.uint8))
    segments = [bytes(rng.integers(97, 101, n, np.uint8)) for n in (50, 51, 60, 76)]
    segments += [segments[2][:10] + shared[:55], shared[3:] + segments[3][:5], b"x" * 52, b"y" * 50]
    windows = [{s[k:k + 50] for k in range(len(s) - 49)} for s in segments]
    wanted = [any(s[k:k + 50] in w for j, w in enumerate(windows) if j != i for k in range(len(s) - 49))
              or len(windows[i]) < len(s) - 49 for i, s in enumerate(segments)]
    assert suffix_dedup.with_repeats(segments, 50).tolist() == wanted
    assert sum(wanted) == 3


def test_texts_of_blocks_are_not_shuffled(spark, make_docs):
    folder, rows = common.work_dir(spark), [(k, f"text {k} " * 9) for k in range(40)]
    blocks = common.text_blocks(common.text_bytes(make_docs(rows, 4)), folder, 200, buckets=True)
    answers = common.written(blocks.select("block", F.lit(1).alias("shard"), F.lit(b"x").alias("bits")), "answers", folder)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = common.join_answers(blocks, answers, "bits")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the answers
    assert len(got) > 10 and all(len(r.answers) == 1 for r in got)
    assert sum(r.n_bytes for r in got) == sum(len(t) for _, t in rows)
    assert not any(t.name.startswith("blocks_") for t in spark.catalog.listTables())
