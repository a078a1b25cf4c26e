"""Many patterns in many texts (J6, E24): one automaton pass instead of a ``contains`` for each pair.

The pattern side becomes an Aho-Corasick automaton in every task; texts stream
past it once in Arrow batches, whatever the number of patterns. Patterns are
sent to the tasks in groups of a checked size; a pattern table beyond one group
takes one pass over the texts for each group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Patterns (their UTF-8 bytes and their number) that one automaton holds; it takes some 50 times its patterns' bytes.
GROUP_BYTES, GROUP_PATTERNS = 4 << 20, 200_000

_AUTOMATA: dict[int, tuple] = {}


def _automaton(shared) -> tuple:
    """(automaton or None, pattern keys, rows of each distinct pattern, rows of the empty pattern), once for each worker process."""
    import ahocorasick
    if shared.value["id"] not in _AUTOMATA:
        _AUTOMATA.clear()
        rows: dict[str, list[int]] = {}
        for k, text in enumerate(shared.value["texts"]):
            rows.setdefault(text, []).append(k)
        automaton = ahocorasick.Automaton()
        for k, text in enumerate(rows):
            if text:
                automaton.add_word(text, k)
        if len(automaton):
            automaton.make_automaton()
        _AUTOMATA[shared.value["id"]] = (automaton if len(automaton) else None, shared.value["keys"], list(rows.values()),
                                         rows.get("", []))
    return _AUTOMATA[shared.value["id"]]


def _pass(texts: DataFrame, group: pa.Table, schema: T.StructType, number: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(
        {"id": (number, group.num_rows, hash(tuple(group.column(1).to_pylist()))), "keys": group.column(0).combine_chunks(),
         "texts": group.column(1).to_pylist()})
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, keys, rows, always = _automaton(shared)
        for b in batches:
            at, found = [], []
            for k, text in enumerate(b.column(1)):
                text = text.as_py()  # one text at a time as a Python object
                hits = {n for _, n in automaton.iter(text)} if automaton is not None and text else ()
                own = [*always, *(r for n in hits for r in rows[n])]
                at += [k] * len(own)
                found += own
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(arrow.field(0).type),
                                                  keys.take(pa.array(found)).cast(arrow.field(1).type)], schema=arrow)
    return texts.mapInArrow(run, schema)


def containment_join(texts: DataFrame, patterns: DataFrame, text_key: str, text_col: str, pattern_key: str, pattern_col: str,
                     group_bytes: int = GROUP_BYTES, group_patterns: int = GROUP_PATTERNS) -> DataFrame:
    """(text key, pattern key) of every pair of rows with ``contains(text, pattern)``.

    As the SQL join does: a null on either side matches nothing, an empty
    pattern every text, and repeated rows on either side are pairs of their own.
    Keys may be null or of any type.
    """
    if text_key == pattern_key:
        raise ValueError("the key columns need different names")
    schema = T.StructType([T.StructField(text_key, texts.schema[text_key].dataType),
                           T.StructField(pattern_key, patterns.schema[pattern_key].dataType)])
    src = texts.where(F.col(text_col).isNotNull()).select(F.col(text_key), F.col(text_col).cast("string"))
    own = patterns.where(F.col(pattern_col).isNotNull()).select(F.col(pattern_key), F.col(pattern_col).cast("string").alias("_pattern"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_pattern")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["bytes"] // group_bytes), -(-size["n"] // group_patterns))
    if groups > 1:
        groups *= 2  # groups by hash differ in size
    out = None
    for k in range(groups):
        # one group of a checked size at a time on the driver; equal patterns are in one group
        part = own if groups == 1 else own.where(F.pmod(F.xxhash64("_pattern"), F.lit(groups)) == k)
        found = _pass(src, part.toArrow(), schema, k)
        out = found if out is None else out.unionByName(found)
    return out
