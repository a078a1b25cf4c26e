"""Similarity join of documents on word shingles, by T-occurrence search.

Two documents link if their sets of distinct three-word shingles have a
Jaccard similarity of 0.9 or more. A set of n shingles then shares at least
T = ceil(0.9 n) with any partner, so one of its n - T + 1 rarest shingles is
shared as well, whatever fixed order says what is rare.

1. Blocks of texts ask shards of the shingle hashes how many documents hold
   each shingle (exact counts), and for each set which is the smallest document
   that has it; that one stands for all. A block sends a shingle or set once.
2. Each representative posts its rarest shingles, if others hold them too.
3. These short inverted lists, cut by set size, tie documents to families
   outside which they can have no partner.
4. Inside a family every document searches the inverted lists: DivideSkip
   sets the longest lists aside, merges the short ones with a heap and probes
   the long ones by binary search. Documents already in one component aren't
   compared, so a group of copies costs about one comparison for each. Large
   families are dealt out in pairs of parts.
5. The links, a spanning forest at most for each task, give the components.
"""

from __future__ import annotations

import heapq
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (claim_memory, drop_tables, join_answers, map_texts, pack_numbers, text_blocks, text_bytes, unpack_numbers,
                     work_dir, written)
from .components import connected_components

SHINGLE = 3
PERCENT = 90
#: Bytes of text for each shard of shingle hashes.
SHARD_BYTES = 16 << 20
#: Shingles of a family that one task holds; larger families are dealt out in pairs of parts.
PART_SHINGLES = 2 << 20
#: Hashed words that a worker keeps; it starts afresh beyond that (memory only, results don't depend on it).
CACHE_WORDS = 300_000

_HASH_BITS = 48
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)]
_WORDS: dict[bytes, int] = {}


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: of ``size`` words, or of all if there are fewer; none without words."""
    claim_memory("shingles", _WORDS.clear)
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    rows = [t.lower().split() for t in texts]
    new: set[bytes] = set()
    for r in rows:
        new |= set(r).difference(_WORDS)
    _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    n_words = [len(r) for r in rows]
    total = sum(n_words)
    word = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(rows)), np.uint64, total)
    # the hash of the ``size`` words at each place, of all texts at once
    every = _shingle_hashes(word, size)
    out, at = [], 0
    for n in n_words:
        own = every[at:at + n - size + 1] if n >= size else _shingle_hashes(word[at:at + n], n) if n else word[:0]
        out.append(np.unique(own))
        at += n
    return out


def _shingle_hashes(word: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(word) - size + 1), size, np.uint64)
    for j in range(size):
        out *= _ODD[1]
        out += word[j:j + len(out)]
        out ^= out >> np.uint64(29)
        out *= _ODD[0]
        out ^= out >> np.uint64(32)
    return out


def min_overlap(n, percent: int = PERCENT):
    """Shingles that a set of ``n`` shares with any partner, at least."""
    return (percent * n + 99) // 100


def links_at(overlap, n, m, percent: int = PERCENT):
    return 100 * overlap >= percent * (n + m - overlap)


# -- search inside a family -----------------------------------------------------
def _merge_counts(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted lists, each with the number of lists that hold it: by a heap, or all at once if they are long."""
    if sum(map(len, lists)) > 1000:
        return np.unique(np.concatenate(lists), return_counts=True)
    members, counts = [], []
    for y in heapq.merge(*(x.tolist() for x in lists)):
        if members and members[-1] == y:
            counts[-1] += 1
        else:
            members.append(y)
            counts.append(1)
    return np.array(members, np.int64), np.array(counts, np.int64)


def family_links(docs: list[int], sets: list[np.ndarray], part: list[int] | None = None,
                 percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a spanning forest) between the given documents; with ``part``, only pairs of different parts are compared."""
    n_docs = len(docs)
    rank = sorted(range(n_docs), key=lambda k: (len(sets[k]), docs[k]))
    docs, sets = [docs[k] for k in rank], [sets[k] for k in rank]
    parts = np.array([part[k] for k in rank]) if part else None
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n_docs), size)
    order = np.argsort(code, kind="stable")           # inverted lists, documents in order of size
    lists, first = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    before = np.empty(len(code), np.int64)            # how many earlier documents hold an entry's shingle
    before[order] = np.arange(len(code)) - first[code[order]]
    ends = np.cumsum(size)
    component = np.arange(n_docs)
    links = []

    def overlap(x: int, y: int) -> int:
        a, b = sets[x], sets[y]
        k = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return int((b[k] == a).sum())

    def try_link(x: int, y: int, shared: int | None = None) -> bool:
        if not links_at(overlap(x, y) if shared is None else shared, size[x], size[y], percent):
            return False
        links.append((docs[x], docs[y]))
        component[component == component[x]] = component[y]
        return True

    def fresh(x: int, found: np.ndarray) -> np.ndarray:
        """Those that x may link to and that aren't in its component yet."""
        found = found[(component[found] != component[x]) & (100 * size[found] >= percent * size[x])]
        return found if parts is None else found[parts[found] != parts[x]]

    for x in range(n_docs):
        entries = np.arange(ends[x] - size[x], ends[x])
        held = entries[before[entries] > 0]
        t = int(min_overlap(size[x], percent))
        if len(held) < t:
            continue                                   # no earlier document shares enough
        held = held[np.argsort(before[held], kind="stable")]
        longest = int(before[held[-1]])
        n_long = min(t - 1, int(t / (0.01 * math.log2(longest) + 1)) if longest > 1 else t - 1)
        rows = [lists[first[c]:first[c] + k] for c, k in zip(code[held].tolist(), before[held].tolist())]
        short, long_ = rows[:len(rows) - n_long], rows[len(rows) - n_long:]
        # copies mostly link at once to the nearest in size; what is in that component is then left out
        misses = 0
        for row in short:
            left = fresh(x, row)
            if len(left) and not try_link(x, int(left[-1])):
                misses += 1
                if misses == 3:
                    break
        found, n = _merge_counts([fresh(x, row) for row in short])
        keep = n >= t - n_long
        found, n = found[keep], n[keep]
        for k, row in enumerate(long_):                # probe the long lists for all candidates, the shortest first
            if not len(found):
                break
            at = np.minimum(np.searchsorted(row, found), len(row) - 1)
            n = n + (row[at] == found)
            keep = n + len(long_) - k - 1 >= t
            found, n = found[keep], n[keep]
        for y, shared in zip(found.tolist(), n.tolist()):
            if component[y] != component[x]:
                try_link(x, y, shared)
    return links


# -- the job ----------------------------------------------------------------------
def _code_of_counts(n: np.ndarray) -> np.ndarray:
    """Counts in one byte: 1 stays 1, larger ones on a logarithmic scale. Only the order of shingles depends on it."""
    return np.minimum(255, 1 + np.ceil(6 * np.log2(n))).astype(np.uint8)


def _block_sets(b: pa.RecordBatch, k: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    ids = np.frombuffer(b.column("ids")[k].as_py(), np.int64)
    ends = np.cumsum(np.frombuffer(b.column("sizes")[k].as_py(), np.int64)).tolist()
    data = zstandard.decompress(b.column("data")[k].as_py())
    return ids, shingle_sets([data[p:q] for p, q in zip([0, *ends], ends)], size)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    size: int = SHINGLE, folder: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest id reachable by links, its own included.

    Null and empty texts and texts without words have no shingles and link
    with nothing. Rows that repeat an id are one node; rows without an id are
    returned with a null component and link with nothing. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    rows = text_bytes(docs, id_col, text_col)
    blocks = text_blocks(rows.where("doc_id IS NOT NULL"), folder)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    limits = [(k << _HASH_BITS) // shards for k in range(shards + 1)]

    # 1. each block asks how many documents hold its shingles, and which is the smallest document of each of its sets
    ask = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
                     ("keys", pa.binary()), ("docs", pa.binary())])

    def open_block(b, k):
        ids, sets = _block_sets(b, k, size)
        short = [s >> np.uint64(64 - _HASH_BITS) for s in sets]
        found, n = np.unique(np.concatenate(short), return_counts=True)
        own = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        keys = sorted({x for x in own if x})
        # a shard is a range of shingle hashes, and of the keys' first bits
        key_at = np.searchsorted([int.from_bytes(x[:_HASH_BITS // 8], "big") for x in keys], limits).tolist()
        return ids, sets, short, found, n, np.searchsorted(found, limits).tolist(), own, keys, key_at

    def ask_shards(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, _, _, found, n, at, own, keys, key_at = open_block(b, k)
                low: dict[bytes, int] = {}
                for i, x in zip(ids.tolist(), own):
                    if x:
                        low[x] = min(i, low.get(x, i))
                out = {c: [] for c in ask.names}
                for s in range(shards):
                    p, q, u, v = at[s], at[s + 1], key_at[s], key_at[s + 1]
                    if q > p or v > u:
                        out["shard"].append(s)
                        out["block"].append(b.column("block")[k].as_py())
                        out["hashes"].append(pack_numbers(np.diff(found[p:q], prepend=np.uint64(0))))
                        out["counts"].append(pack_numbers(n[p:q].astype(np.int32)))
                        out["keys"].append(b"".join(keys[u:v]))
                        out["docs"].append(np.array([low[x] for x in keys[u:v]], np.int64).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=ask)

    tell = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("reps", pa.binary())])

    def answer(table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ask.names[1:])))
        hashes = [np.cumsum(unpack_numbers(h, np.uint64)) for _, h, *_ in rows]
        found, where = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(where, np.concatenate([unpack_numbers(r[2], np.int32) for r in rows]))
        codes = np.split(_code_of_counts(n)[where] if len(found) else np.zeros(0, np.uint8),
                         np.cumsum([len(h) for h in hashes])[:-1])
        low: dict[bytes, int] = {}  # a block sends a set once
        own = [[(r[3][k:k + 16], int(d)) for k, d in zip(range(0, len(r[3]), 16), np.frombuffer(r[4], np.int64))] for r in rows]
        for x, d in chain.from_iterable(own):
            low[x] = min(d, low.get(x, d))
        return pa.table({"shard": [table.column("shard")[0].as_py()] * len(rows), "block": [r[0] for r in rows],
                         "codes": [pack_numbers(c) for c in codes],
                         "reps": [np.array([low[x] for x, _ in o], np.int64).tobytes() for o in own]}, schema=tell)

    asked = blocks.mapInArrow(ask_shards, "shard int, block long, hashes binary, counts binary, keys binary, docs binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "shard int, block long, codes binary, reps binary")

    # 2. short inverted lists: the rarest shingles of each representative (rows with h); and a row for each document
    post = pa.schema([("h", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("band", pa.int32()),
                      ("n_shingles", pa.int64()), ("rep", pa.int64())])
    unit = -math.log(percent / 100 - 0.001)  # partners are in the same band of sizes or in neighbouring ones

    def post_rare(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, sets, short, found, _, at, own, keys, key_at = open_block(b, k)
                codes, reps = np.ones(len(found), np.uint8), np.zeros(len(keys), np.int64)
                for x in b.column("answers")[k].as_py() or ():
                    s = x["shard"]
                    codes[at[s]:at[s + 1]] = unpack_numbers(x["codes"], np.uint8)
                    reps[key_at[s]:key_at[s + 1]] = np.frombuffer(x["reps"], np.int64)
                rep_of = dict(zip(keys, reps.tolist()))
                lists, posted = [], set()
                for i, s, h, x in zip(ids.tolist(), sets, short, own):
                    if x is None or rep_of[x] != i or i in posted:
                        continue
                    posted.add(i)
                    code = codes[np.searchsorted(found, h)]
                    rare = np.lexsort((s, code))[:len(s) - int(min_overlap(len(s), percent)) + 1]
                    rare = rare[code[rare] > 1]
                    lists.append((s[rare].view(np.int64), i, int(math.log(len(s)) / unit)))
                n = [len(h) for h, *_ in lists]
                each = lambda c: np.repeat(np.array([x[c] for x in lists], np.int64), n).tolist()
                size_ = len(ids) + sum(n)
                yield pa.RecordBatch.from_pydict(
                    {"h": [None] * len(ids) + list(chain.from_iterable(h.tolist() for h, *_ in lists)),
                     "block": [b.column("block")[k].as_py()] * size_, "doc_id": ids.tolist() + each(1),
                     "band": [None] * len(ids) + each(2), "n_shingles": [len(s) for s in sets] + [None] * sum(n),
                     "rep": [x and rep_of[x] for x in own] + [None] * sum(n)}, schema=post)

    posted = written(join_answers(blocks, answers, "codes", "reps")
                     .mapInArrow(post_rare, "h long, block long, doc_id long, band int, n_shingles long, rep long"), "posted", folder)
    all_docs = posted.where("h IS NULL").select("block", "doc_id", "n_shingles", "rep")
    posted = posted.where("h IS NOT NULL").select("h", "doc_id", "band")
    heads = posted.groupBy("h", "band").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = written(heads, "heads", folder)
    below = heads.select("h", (F.col("band") + 1).alias("band"), F.col("head").alias("b"))
    ties = (posted.join(heads.where("n > 1"), ["h", "band"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
            .unionByName(heads.join(below, ["h", "band"]).select(F.col("head").alias("a"), "b")))
    family = connected_components(ties, f"{folder}/families")

    # 4. search inside the families
    members = all_docs.where("doc_id = rep").dropDuplicates(["doc_id"]).join(family.withColumnRenamed("node", "doc_id"), "doc_id")
    members = written(members.select("block", F.struct("doc_id", F.col("component").alias("family")).alias("member")), "members", folder)
    send = pa.schema([("family", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])

    def send_sets(batches):
        for b in batches:
            for k in range(b.num_rows):
                wanted = {m["doc_id"]: m["family"] for m in b.column("members")[k].as_py()}
                ids = np.frombuffer(b.column("ids")[k].as_py(), np.int64)
                ends = np.cumsum(np.frombuffer(b.column("sizes")[k].as_py(), np.int64)).tolist()
                data = zstandard.decompress(b.column("data")[k].as_py())
                own = {i: data[p:q] for i, p, q in zip(ids.tolist(), [0, *ends], ends) if i in wanted}
                sets = shingle_sets(list(own.values()), size)
                yield pa.RecordBatch.from_pydict(
                    {"family": [wanted[i] for i in own], "doc_id": list(own), "n": [len(s) for s in sets],
                     "shingles": [s.tobytes() for s in sets]}, schema=send)

    lists = members.groupBy("block").agg(F.collect_list("member").alias("members"))
    sent = written(blocks.join(lists, "block").mapInArrow(send_sets, "family long, doc_id long, n long, shingles binary"),
                   "sent", folder)
    weight = sent.groupBy("family").agg(F.ceil(F.sum("n") / PART_SHINGLES).alias("k"))
    dealt = (sent.join(weight, "family").withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("k")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
             .select("family", "doc_id", "shingles", "s", F.least("s", "other").alias("i"), F.greatest("s", "other").alias("j")))

    def search(table):
        docs_, parts = table.column("doc_id").to_pylist(), table.column("s").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        crossed = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        found = family_links(docs_, sets, parts if crossed else None, percent)
        return pa.table({"a": [x[0] for x in found], "b": [x[1] for x in found]},
                        schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    links = dealt.groupBy("family", "i", "j").applyInArrow(search, "a long, b long")

    # 5. components of the representatives, then of all documents
    found = connected_components(links, f"{folder}/components").select(F.col("node").alias("rep"), F.col("component"))
    found = written(found, "found", folder)
    drop_tables(spark, folder, "blocks", "heads", "families", "members", "sent", "components")
    some = (all_docs.join(found, "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())])
    without_id = map_texts(rows.where("doc_id IS NULL"),
                           lambda ids, texts: {"doc_id": ids, "n_shingles": [len(s) for s in shingle_sets(texts, size)]},
                           "doc_id long, n_shingles long", schema)
    return some.unionByName(without_id.withColumn("component_id", F.lit(None).cast("long")))



#: Brute force: all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)] END) AS shingle
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
