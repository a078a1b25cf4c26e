"""Spelling variants: words one edit apart, found by a frontier over a relational trie.

Words are counted in Arrow batches. Every word's prefixes, forwards and
backwards, are rows (node, next code point); nodes with one continuation only
are skipped, so an edge of the distributed edge table carries a label of one
or more code points. A state is (word, position, node, edits). Two words one
edit apart share their first or their last half: the unedited states are
therefore the branching nodes of a word's own path from its middle on, in the
trie and in the trie of reversed words. They join the edge table once to take
their edit (another first code point, or one of the word's left out), and
then, level by level, the edges that go on as the word does, until an edge
ends another word. An insertion is the other word's deletion.

Nodes are 64-bit hashes of prefixes. Two prefixes with one hash could only add
states; a terminal state is compared with the word itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, work_dir, written

#: Fixed by the task: what a word is, which runs lose a code point, and which words count.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
EVERY, MIN_LENGTH, MIN_COUNT = 97, 5, 3
#: Words that a task counts before it sends them on.
HELD_WORDS = 400_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def altered(prefix: int, word: str) -> str:
    """The word, without one code point where the hash of ``<doc_id>:<word>`` says so; ``prefix`` is that of ``<doc_id>:``."""
    h = zlib.crc32(word.encode(), prefix)
    if h % EVERY:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of whole texts, altered, of at least ``MIN_LENGTH`` code points, and how often they occur.

    A null text has no words; a null id is written as nothing. Rows count as
    often as they are repeated.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        get = held.get

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())}, schema=_COUNTS)
            held.clear()
            return out
        for b in batches:
            for i, data in zip(b.column(0), b.column(1)):
                i, data = i.as_py(), data.as_py()
                prefix = zlib.crc32(b"%d:" % i if i is not None else b":")
                for word, n in Counter(RUN.findall(data.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z only
                    if len(word) >= MIN_LENGTH:
                        word = altered(prefix, word)
                        if len(word) >= MIN_LENGTH:
                            held[word] = get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield counts()
        yield counts()
    return (text_bytes(docs, id_col, text_col).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


# -- trie --------------------------------------------------------------------------
_BASE, _MODULUS = 0x1B873593CC9E2D51, (1 << 61) - 1
_PREFIXES = pa.schema([("side", pa.int8()), ("wid", pa.int64()), ("pos", pa.int32()), ("node", pa.int64()), ("next", pa.string())])
#: No word takes its edit before its middle, so nodes nearer to the root are never asked for.
FIRST = MIN_LENGTH // 2


def prefix_nodes(word: str, side: int, modulus: int = _MODULUS) -> list[int]:
    """The node of each prefix of ``word``, the empty and the whole one included."""
    out, h = [side + 1], side + 1
    for c in word:
        h = (h * _BASE + ord(c) + 1) % modulus
        out.append(h)
    return out


def prefixes(words: DataFrame, modulus: int = _MODULUS) -> DataFrame:
    """(side, wid, pos, node, next) for each prefix of at least ``FIRST`` code points of each word and reversed word; at its end next is ''."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in _PREFIXES.names}
            for wid, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for side, w in enumerate((word, word[::-1])):
                    n = len(w) + 1 - FIRST
                    out["side"] += [side] * n
                    out["wid"] += [wid] * n
                    out["pos"] += range(FIRST, len(w) + 1)
                    out["node"] += prefix_nodes(w, side, modulus)[FIRST:]
                    out["next"] += [*w[FIRST:], ""]
                if len(out["pos"]) > 200_000:
                    yield pa.RecordBatch.from_pydict(out, schema=_PREFIXES)
                    out = {c: [] for c in _PREFIXES.names}
            yield pa.RecordBatch.from_pydict(out, schema=_PREFIXES)
    return words.select("wid", "word").mapInArrow(run, "side byte, wid long, pos int, node long, next string")


def edge_table(words: DataFrame, folder: str, modulus: int = _MODULUS) -> tuple[DataFrame, DataFrame]:
    """(states, edges).

    ``states``: (node, pos, side, wid, word, n) for each branching node on a
    word's path. ``edges``: (node, label, first, child, end_word, end_n); an
    edge that ends a word has no child.
    """
    rows = written(prefixes(words, modulus), "prefixes", folder)
    branching = rows.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low != high").select("node")
    own = written(rows.select("side", "wid", "pos", "node").join(branching, "node", "left_semi"), "branching", folder)
    # a word's branching positions in order: at most its length
    path = (own.groupBy("side", "wid").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("path"))
            .join(words, "wid").withColumn("word", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))))
    steps = written(path.selectExpr("side", "wid", "word", "n", """inline(zip_with(path, slice(path, 2, size(path)),
        (a, b) -> struct(a.pos AS pos, a.node AS node, b.pos AS then_pos, b.node AS then_node)))"""), "steps", folder)
    inner = steps.where("then_node is not null").select(
        "node", F.expr("substring(word, pos + 1, then_pos - pos)").alias("label"), F.col("then_node").alias("child"),
        F.lit(None).cast("string").alias("end_word"), F.lit(None).cast("long").alias("end_n")).distinct()
    last = steps.where("then_node is null").select("node", F.expr("substring(word, pos + 1)").alias("label"), F.lit(None).cast("long").alias("child"),
                                              F.col("word").alias("end_word"), F.col("n").alias("end_n"))
    edges = written(inner.unionByName(last).withColumn("first", F.substring("label", 1, 1)), "edges", folder)
    return steps.select("node", "pos", "side", "wid", "word", "n"), edges


def near_words(words: DataFrame, folder: str | None = None, modulus: int = _MODULUS) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words (wid, word, n; distinct words) that one edit turns into each other."""
    folder = folder or work_dir(words.sparkSession)
    states, edges = edge_table(words, folder, modulus)
    early = states.where("pos >= length(word) div 2 AND pos < length(word)")
    went = F.length("label")
    at_end = F.col("end_word").isNotNull()
    edited = early.join(edges, "node").where("first != substring(word, pos + 1, 1)")
    # another code point in the place of the word's own
    replaced = edited.where("label != '' AND substring(label, 2) = substring(word, pos + 2, length(label) - 1)").select(
        "side", "wid", "word", "n", F.lit("r").alias("edit"), F.col("pos").alias("at"), (F.col("pos") + went).alias("pos"), "child", "end_word", "end_n")
    # the word's own left out
    shorter = edited.where("label = substring(word, pos + 2, length(label))").select(
        "side", "wid", "word", "n", F.lit("d").alias("edit"), F.col("pos").alias("at"), (F.col("pos") + 1 + went).alias("pos"), "child", "end_word", "end_n")
    now = written(replaced.unionByName(shorter), "states-0", folder)
    found, step = [], 0
    while True:
        found.append(now.where(at_end & (F.col("pos") == F.length("word"))))
        going = now.where("child is not null")
        if going.isEmpty():
            break
        step += 1
        # the edge that goes on as the word does: '' at the word's end meets an edge that ends there
        going = going.select("side", "wid", "word", "n", "edit", "at", "pos", F.col("child").alias("node"), F.expr("substring(word, pos + 1, 1)").alias("first"))
        now = written(going.join(edges, ["node", "first"]).where("label = substring(word, pos + 1, length(label))").select(
            "side", "wid", "word", "n", "edit", "at", (F.col("pos") + went).alias("pos"), "child", "end_word", "end_n"), f"states-{step}", folder)
    ends = found[0]
    for f in found[1:]:
        ends = ends.unionByName(f)
    head, tail = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")
    same = F.when(F.col("edit") == "d", F.col("end_word") == F.concat(head, tail)).otherwise(
        F.col("end_word") == F.concat(head, F.expr("substring(end_word, at + 1, 1)"), tail))
    forth = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    pairs = ends.where(same & (F.col("end_word") != F.col("word"))).select("edit", forth("word").alias("word"), "n", forth("end_word").alias("near"), F.col("end_n").alias("near_n"))
    back = pairs.where("edit = 'd'").select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"),
                                            F.col("n").alias("near_n"))
    return pairs.drop("edit").unionByName(back).distinct()


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root): the end of each chain of forms (word, form; form null at an end), by joins that double their step."""
    now, step = written(forms.select("word", F.col("form").alias("to")), "chains-0", folder), 0
    known, moving = now.where("to is null").select("word", F.col("word").alias("root")), now.where("to is not null")
    while not moving.isEmpty():  # a form occurs twice as often: chains are as long as the logarithm of a count at most
        step += 1
        ahead = known.select(F.col("word").alias("to"), F.lit(None).cast("string").alias("_to"), "root").unionByName(
            moving.select(F.col("word").alias("to"), F.col("to").alias("_to"), F.lit(None).cast("string").alias("root")))
        now = written(moving.join(ahead, "to").select("word", F.col("_to").alias("to"), "root"), f"chains-{step}", folder)
        known = known.unionByName(now.where("to is null").select("word", "root"))
        moving = now.where("to is not null").select("word", "to")
    return known


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    Words are the lower-cased (A-Z) runs of letters, altered as the task fixes,
    with at least five code points and three occurrences. ``form`` is the near
    word of largest ``n`` (ties: the smallest) if it occurs at least twice as
    often. Null texts have no words; an empty table has no rows; a word of any
    length is one row with labels instead of one row for each code point;
    and other columns are ignored.
    """
    folder = folder or work_dir(docs.sparkSession)
    words = written(count_words(docs, id_col, text_col).where(F.col("n") >= MIN_COUNT)
                    .withColumn("wid", F.monotonically_increasing_id()), "words", folder)
    # 90 letters: a word has fewer than 200 near words for each of its code points
    best = near_words(words, folder).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    often = -F.col("best.least") >= 2 * F.col("n")
    table = written(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.least")).alias("form_n")), "forms", folder)
    return table.join(roots(table, folder), "word").select("word", "form", "root", "n", "n_near", "form_n")
