"""Chat formatting of reply trees: the best root-to-leaf paths, each written as one conversation.

Messages name the message they answer. Self-joins that double their step
(``up`` tables: the 1st, 2nd, 4th, .. message before each one) carry every
message's score sum, length and root upwards in log2(depth) rounds over narrow
rows. Leaves are ranked inside their tree by mean score; only the chosen ones'
paths are then spelled out by the same tables, and only those messages' texts
are joined.

A turn is written ``<turn ROLE>\\nTEXT\\n</turn>\\n``. Inside a text a backslash,
``<turn`` and ``</turn`` get a backslash before them; inside a role a backslash
is doubled, ``>`` is ``\\g`` and a line feed ``\\n``. So control strings stand
only where turns begin and end, and everything is read back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written, work_dir

OPEN, CLOSE = "<turn ", "\n</turn>\n"
_ROLE_MARKS = {"\\": "\\\\", ">": "\\g", "\n": "\\n"}
_ROLE_READ = {"\\": "\\", "g": ">", "n": "\n"}


# -- template ------------------------------------------------------------------
def escape_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescape_text(text: str) -> str:
    return re.sub(r"\\([\\<])", r"\1", text)


def format_turns(turns: Iterable[tuple[str | None, str | None]], loss_role: str = "assistant"):
    """(formatted, starts, ends): the conversation and the code-point spans of the escaped texts that ``loss_role`` says."""
    out, starts, ends, at = [], [], [], 0
    for role, text in turns:
        role, text = role or "", escape_text(text or "")
        head = OPEN + re.sub(r"[\\>\n]", lambda m: _ROLE_MARKS[m[0]], role) + ">\n"
        if role == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(text))
        out += head, text, CLOSE
        at += len(head) + len(text) + len(CLOSE)
    return "".join(out), starts, ends


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        head = formatted.index(">\n", at)
        stop = formatted.index(CLOSE, head + 2)
        role = re.sub(r"\\(.)", lambda m: _ROLE_READ[m[1]], formatted[at + len(OPEN):head])
        turns.append((role, unescape_text(formatted[head + 2:stop])))
        at = stop + len(CLOSE)
    return turns


# -- paths -----------------------------------------------------------------------
def reply_paths(nodes: DataFrame, top: int = 1, folder: str | None = None) -> DataFrame:
    """(leaf, rank, score, node, dist): the messages on the ``top`` best paths of each tree.

    ``nodes`` has (node: unique long, up: the node it answers or null, score).
    A path's score is the mean of its messages' scores (a null score is 0);
    ties go to the smaller leaf. ``dist`` counts from the leaf. Messages that
    answer each other in a circle, and those below them, have no root and are
    on no path.
    """
    folder = folder or work_dir(nodes.sparkSession)
    n = nodes.count()
    first = nodes.select("node", "up", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"),
                         F.lit(1).cast("long").alias("length"), F.when(F.col("up").isNull(), F.col("node")).alias("root"))
    ups = [written(first, "up-0", folder)]
    while True:
        now = ups[-1]
        moving = now.where("up is not null")
        if 2 ** (len(ups) - 1) > n or moving.isEmpty():
            break
        # a node that many answer is one row on the right; adaptive execution cuts the left side
        far = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"),
                         F.col("length").alias("_length"), F.col("root").alias("_root"))
        moved = moving.drop("root").join(far, "up").select(
            "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"),
            (F.col("length") + F.col("_length")).alias("length"), F.col("_root").alias("root"))
        ups.append(written(moved.unionByName(now.where("up is null")), f"up-{len(ups)}", folder))
    rooted = ups[-1].where("up is null")
    answered = first.where("up is not null").select(F.col("up").alias("node")).distinct()
    best = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    chosen = (rooted.join(answered, "node", "left_anti").select("node", "root", (F.col("total") / F.col("length")).alias("score"))
              .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    paths = written(chosen.select(F.col("node").alias("leaf"), "rank", "score", "node", F.lit(0).cast("long").alias("dist")),
                    "paths-0", folder)
    for k, up in enumerate(ups[:-1]):  # distances below 2**k are there
        more = paths.join(up.where("up is not null").select("node", "up"), "node").select(
            "leaf", "rank", "score", F.col("up").alias("node"), (F.col("dist") + 2 ** k).alias("dist"))
        paths = written(paths.unionByName(more), f"paths-{k + 1}", folder)
    return paths


_FORMATTED = pa.schema([("tree", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_turns", pa.int64()),
                        ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
_FORMATTED_DDL = ("tree long, rank int, score double, n_turns long, formatted string, loss_starts array<bigint>, "
                  "loss_ends array<bigint>")


def format_trees(messages: DataFrame, id_col: str = "message_id", parent_col: str = "parent_id", tree_col: str = "tree_id",
                 role_col: str = "role", text_col: str = "text", score_col: str | None = "score", top: int = 1,
                 loss_role: str = "assistant", folder: str | None = None) -> DataFrame:
    """(tree, rank, score, n_turns, formatted, loss_starts, loss_ends): the ``top`` best paths of each reply tree.

    A message without a parent, or whose parent is not in the table, is the
    root of a tree; ``tree`` is the root's ``tree_col`` (long, may be null).
    Of rows that repeat an id each is a message; replies go to one of them.
    Rows without an id have no replies. Null roles and texts are empty. An
    empty table gives no rows; other columns are ignored. A conversation is one
    row, so its messages meet in one task; a tree of any size does not.
    """
    folder = folder or work_dir(messages.sparkSession)
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    rows = written(messages.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
                                   F.col(tree_col).cast("long").alias("tree"), F.col(role_col).cast("string").alias("role"),
                                   F.col(text_col).cast("string").alias("text"), score.alias("score"))
                   .withColumn("node", F.monotonically_increasing_id()), "messages", folder)
    known = rows.where("id is not null").groupBy(F.col("id").alias("parent")).agg(F.min("node").alias("up"))
    asked = rows.select("node", "parent", "score")  # roots meet no join: without a parent they would be one key
    nodes = written(asked.where("parent is not null").join(known, "parent", "left").select("node", "up", "score").unionByName(
        asked.where("parent is null").select("node", F.lit(None).cast("long").alias("up"), "score")), "nodes", folder)
    paths = reply_paths(nodes, top, folder)
    turns = (paths.join(rows.select("node", "tree", "role", "text"), "node").groupBy("leaf")
             .agg(F.first("rank").alias("rank"), F.first("score").alias("score"),
                  F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "tree", "role", "text"))).alias("turns")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in _FORMATTED.names}
            for rank, value, said in zip(b.column(0), b.column(1), b.column(2)):
                said = said.as_py()
                formatted, starts, ends = format_turns([(t["role"], t["text"]) for t in said], loss_role)
                for c, v in zip(_FORMATTED.names, (said[0]["tree"], rank.as_py(), value.as_py(), len(said), formatted, starts, ends)):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)
    return turns.select("rank", "score", "turns").mapInArrow(run, _FORMATTED_DDL)


# -- conversations -----------------------------------------------------------------
def linear_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages that each answer the turn before.

    Order inside a conversation: turn (null first), role, text. Rows without a
    conversation id are conversations of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    at = F.when(F.col("conv_id").isNotNull(), F.row_number().over(order))
    # rows without an id are dealt out by their turn and text: as a group of their own they would be one task
    rows = rows.select("conv_id", "turn", "role", "text")
    lone = rows.where("conv_id is null").select(F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("parent_id"),
                                                F.col("conv_id").alias("tree_id"), "role", "text")
    said = rows.where("conv_id is not null").withColumn("_at", at)
    key = lambda k: F.concat_ws(":", F.col("conv_id").cast("string"), k.cast("string"))
    return said.select(key(F.col("_at")).alias("message_id"), F.when(F.col("_at") > 1, key(F.col("_at") - 1)).alias("parent_id"),
                       F.col("conv_id").alias("tree_id"), "role", "text").unionByName(lone)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and texts under the loss mask as the formatted conversations hold them: counts and digests."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in _DIGESTS.names}
            for tree, text, starts, ends in zip(*b.columns):
                text = text.as_py()
                turns = read_turns(text)
                loss = "".join(unescape_text(text[p:q]) for p, q in zip(starts.as_py(), ends.as_py()))
                said = "".join(f"{role}\n{t}\n" for role, t in turns)
                for c, v in zip(_DIGESTS.names, (tree.as_py(), len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                                                 hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_DIGESTS)
    return formatted.select("tree", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds: control strings of common templates as text.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"

SQL = r"""
WITH added AS (SELECT -7 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '\### Assistant: </turn> ok' AS text),
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, turn, role, text FROM added),
lens AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS escaped,
         replace(replace(replace(role, '\', '\\'), '>', '\g'), chr(10), '\n') AS head
  FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn ' || head || '>' || chr(10) || escaped || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM lens GROUP BY conv_id
"""


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The whole table and one more conversation, formatted as reply trees without branches and read back."""
    spark = conversations.sparkSession
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
    return read_back(format_trees(linear_messages(rows), score_col=None))
