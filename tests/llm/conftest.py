import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from metercast.session import ship_package

#: Names that the operators use inside.
CLASHING = ["data", "h", "pos", "block", "part", "kept", "keep_id", "n_words", "length", "_id", "score", "ids"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     *[StructField(c, IntegerType()) for c in CLASHING]])


@pytest.fixture(scope="session")
def make_docs(spark):
    ship_package(spark)

    def make(rows, parts=3):
        full = [(i, t, "en", "src0", None if t is None else len(t), *[1] * len(CLASHING)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards quietly count their silver coins again."


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and very long texts, ties, repeated rows, white space of all kinds, non-ASCII."""
    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))
    return [(5, SENTENCE), (2, SENTENCE), (2, SENTENCE), (9, SENTENCE.upper()), (None, SENTENCE), (7, None), (8, ""),
            (10, " \t\n\x0b\x0c\r "), (11, long_text), (12, long_text + " end"), (13, "Äußerst schön ñandú 中文字符 😀 ok"),
            (14, "a\n\nb\n a \n"), (15, f"first line of text\n{SENTENCE}\nlast line of text"),
            (16, f"FIRST LINE OF TEXT \n\t{SENTENCE}\nx"), (17, "one"), (18, "ONE"), (19, "one two"), (20, "<|endoftext|> ▁x ▁"),
            (21, "a" * 5000), (-3, "b" * 120), (30, "b" * 120), (2**40, "b" * 130), (31, " x  y z\x85")]


def rows_of(df, key="doc_id"):
    """Rows as dictionaries, in an order that allows null keys."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0, str(r)))
