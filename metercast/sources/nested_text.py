"""Text inside nested columns (S8, S12): one row for each text of structs, arrays, maps and VARIANT values.

Typed columns are walked by their schema, in column expressions and one
generator. VARIANT values have no schema: their objects and arrays are opened
level by level, each level a checkpoint in the shared folder that holds only
what is still to be opened, until no level is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: A leaf: its path, its type, and the column of all its values (an array) from the top column.
Leaf = tuple[str, T.DataType, Callable[[Column], Column]]


def leaves(dtype: T.DataType, path: str) -> Iterator[Leaf]:
    """The text and VARIANT leaves of a type. ``a.b``: a field; ``a[]``: elements; ``a{}``: a map's values (keys are no texts)."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType, T.VariantType)):
        yield path, dtype, F.array
    elif isinstance(dtype, T.StructType):
        for f in dtype.fields:
            for p, t, of in leaves(f.dataType, f"{path}.{f.name}"):
                yield p, t, lambda c, of=of, name=f.name: of(c.getField(name))
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        is_map = isinstance(dtype, T.MapType)
        for p, t, of in leaves(dtype.valueType if is_map else dtype.elementType, f"{path}{'{}' if is_map else '[]'}"):
            yield p, t, _of_each(of, t, is_map)


def _of_each(of: Callable[[Column], Column], leaf: T.DataType, is_map: bool) -> Callable[[Column], Column]:
    def each(c: Column) -> Column:
        found = F.flatten(F.transform(F.map_values(c) if is_map else c, lambda v: of(v)))
        return F.coalesce(found, F.array().cast(T.ArrayType(leaf)))  # a null array has no texts
    return each


def _with_path(values: Column, path: str, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(path).alias("path"), v.cast(kind).alias("text")))


def text_paths(df: DataFrame) -> list[str]:
    """Paths of the text leaves of all columns; a VARIANT's own path stands for what it holds."""
    return [p for f in df.schema.fields for p, *_ in leaves(f.dataType, f.name)]


def nested_texts(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, path, text): one row for each non-null text in ``columns`` (default: all but the key), equal ones repeated.

    Empty texts are texts; null structs, arrays, maps and VARIANTs and JSON
    nulls hold none. Elements of an array share the path ``a[]``; a VARIANT's
    objects give ``a.name``. Texts of VARIANT values come whatever types other
    rows have at the same place; finding them runs one job for each level
    of nesting now.
    """
    found = [(f.name, *leaf) for f in df.schema.fields if f.name != key and (columns is None or f.name in columns)
             for leaf in leaves(f.dataType, f.name)]
    out = _rows(df, key, [x for x in found if not isinstance(x[2], T.VariantType)], "string")
    open_ = _rows(df, key, [x for x in found if isinstance(x[2], T.VariantType)], "variant")
    if not any(isinstance(x[2], T.VariantType) for x in found):
        return out
    while True:
        open_ = materialize(open_.withColumn("kind", F.expr("schema_of_variant(text)")).where("kind <> 'VOID'"))
        if open_.isEmpty():
            return out
        out = out.unionByName(open_.where("kind = 'STRING'").select("key", "path", F.expr("CAST(text AS STRING)").alias("text"))
                              .toDF(key, "path", "text"))
        # one generator for both kinds: a level has as many partitions as the one before
        inside = F.expr("""CASE
            WHEN kind LIKE 'OBJECT%' THEN transform(map_entries(TRY_CAST(text AS MAP<STRING, VARIANT>)),
                                                    e -> struct(concat('.', e.key) AS step, e.value AS text))
            WHEN kind LIKE 'ARRAY%' THEN transform(TRY_CAST(text AS ARRAY<VARIANT>), e -> struct('[]' AS step, e AS text)) END""")
        open_ = (open_.select("key", "path", F.explode(inside).alias("_in"))
                 .select("key", F.concat("path", "_in.step").alias("path"), F.col("_in.text").alias("text")).where("text IS NOT NULL"))


def _rows(df: DataFrame, key: str, found: list, kind: str) -> DataFrame:
    """A row for each value of the leaves; VARIANT rows have the column name ``key`` for their key."""
    name = key if kind == "string" else "key"
    none = F.lit(None).cast(f"array<struct<path: string, text: {kind}>>")
    parts = [_with_path(of(F.col(f"`{top}`")), path, kind) for top, path, _, of in found]
    rows = df.select(F.col(f"`{key}`").alias(name), F.explode(F.concat(*parts) if parts else none).alias("_leaf"))
    return rows.select(name, "_leaf.path", "_leaf.text").where("text IS NOT NULL")
