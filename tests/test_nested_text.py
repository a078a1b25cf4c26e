"""Texts inside structs, arrays, maps and VARIANT values."""

import json

from pyspark.sql import functions as F

from metercast.sources.nested_text import nested_texts, text_paths


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_typed_columns(spark):
    schema = ("id long, path string, n int, s struct<a: string, `b.c`: array<string>>, "
              "m map<string, array<struct<text: string, k: int>>>")
    df = spark.createDataFrame([
        (1, "p", 5, ("x", ["", None, "y"]), {"k": [("t", 1), (None, 2)], "none": None}),
        (1, "p", 5, ("x", None), {}),
        (2, None, None, None, None)], schema)
    assert text_paths(df) == ["path", "s.a", "s.b.c[]", "m{}[].text"]
    assert rows_of(nested_texts(df, "id")) == sorted(
        [(1, "path", "p")] * 2 + [(1, "s.a", "x")] * 2 + [(1, "s.b.c[]", ""), (1, "s.b.c[]", "y"), (1, "m{}[].text", "t")])
    assert rows_of(nested_texts(df, "id", ["s"])) == [(1, "s.a", "x"), (1, "s.a", "x"), (1, "s.b.c[]", ""), (1, "s.b.c[]", "y")]
    assert nested_texts(df.limit(0), "id").count() == 0
    assert nested_texts(df.select("id", "n"), "id").columns == ["id", "path", "text"] and nested_texts(df.select("id", "n"), "id").count() == 0


def texts_in(value, path):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from texts_in(v, f"{path}.{k}")
    elif isinstance(value, list):
        for v in value:
            yield from texts_in(v, f"{path}[]")


def test_variants_of_any_shape(spark):
    deep = "bottom"
    for k in range(6):
        deep = {"d": [deep, k]}
    values = ["plain", 3, None, {}, [], {"a": "x", "b": {"a": ["y", ["z", {"c": ""}], 1, None, True]}},
              {"a": 5, "b": "text where others have an object"}, [{"a": "x"}, "x"], deep, {"text": "t", "key": "k", "kind": "STRING"}]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)] + [(99, None)], "key long, j string")
    df = df.select("key", F.parse_json("j").alias("v"), F.array(F.struct(F.parse_json("j").alias("w"))).alias("in"))
    want = [(k, *x) for k, v in enumerate(values) for top in ("v", "in[].w") for x in texts_in(v, top)]
    assert rows_of(nested_texts(df, "key")) == sorted(want)
