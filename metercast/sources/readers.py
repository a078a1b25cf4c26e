"""Readers for real usage tables and text sources.

Every reader takes a path (parquet by default) or a catalog table name and
returns a lazy DataFrame with the declared schema of its kind, so Spark never
samples files to infer types and column pruning / filter pushdown reach the
scan. Credits columns get an exact ``<col>_e8`` twin (integer units of 1e-8
credit) that the operators sum instead of the double.
"""

from __future__ import annotations

import contextlib

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money

_TS = T.TimestampNTZType()

# Declared schemas of the usage tables the operators read (FIXTURES.md §1).
SCHEMAS: dict[str, T.StructType] = {
    "metering": T.StructType([
        T.StructField("start_time", _TS), T.StructField("service_type", T.StringType()),
        T.StructField("credits_used", T.DoubleType())]),
    "metering_daily": T.StructType([
        T.StructField("usage_date", T.DateType()), T.StructField("service_type", T.StringType()),
        T.StructField("credits_used", T.DoubleType()),
        T.StructField("credits_used_compute", T.DoubleType()),
        T.StructField("credits_used_cloud_services", T.DoubleType())]),
    "usage_hourly": T.StructType([
        T.StructField("start_time", _TS), T.StructField("end_time", _TS),
        T.StructField("function_name", T.StringType()), T.StructField("model_name", T.StringType()),
        T.StructField("warehouse_id", T.LongType()), T.StructField("token_credits", T.DoubleType()),
        T.StructField("tokens", T.LongType())]),
    "usage": T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField("function_name", T.StringType()),
        T.StructField("model_name", T.StringType()), T.StructField("tokens", T.LongType()),
        T.StructField("token_credits", T.DoubleType())]),
    "query_history": T.StructType([
        T.StructField("query_id", T.StringType()), T.StructField("query_text", T.StringType()),
        T.StructField("start_time", _TS), T.StructField("execution_time", T.LongType()),
        T.StructField("user_name", T.StringType()), T.StructField("warehouse_name", T.StringType()),
        T.StructField("role_name", T.StringType())]),
    "analyst": T.StructType([T.StructField("start_time", _TS), T.StructField("credits", T.DoubleType())]),
    "docproc": T.StructType([T.StructField("start_time", _TS), T.StructField("credits_used", T.DoubleType())]),
    "search": T.StructType([T.StructField("start_time", _TS), T.StructField("credits", T.DoubleType())]),
    "finetune": T.StructType([T.StructField("start_time", _TS), T.StructField("token_credits", T.DoubleType())]),
}

# Credits column of each kind (the name differs per source, SURVEY §1.3).
CREDIT_COLUMNS = {
    "metering": ["credits_used"], "metering_daily": ["credits_used", "credits_used_compute",
                                                     "credits_used_cloud_services"],
    "usage_hourly": ["token_credits"], "usage": ["token_credits"], "query_history": [],
    "analyst": ["credits"], "docproc": ["credits_used"], "search": ["credits"],
    "finetune": ["token_credits"],
}

# Type names that count as text when choosing a column.
TEXT_TYPE_NAMES = ["VARCHAR", "STRING", "TEXT", "CHAR", "VARIANT"]


def _is_table(spark: SparkSession, source: str) -> bool:
    if "/" in source or ":" in source:
        return False
    try:
        return spark.catalog.tableExists(source)
    except AnalysisException:
        return False


def read_source(spark: SparkSession, source: str, schema: T.StructType | None = None,
                fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """A catalog table by name, else files at a path with a declared schema."""
    if _is_table(spark, source):
        return spark.table(source)
    r = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        r = r.schema(schema)
    return r.load(source)


def normalize_numeric(df: DataFrame) -> DataFrame:
    """Decimal columns as double (S15); other columns unchanged."""
    return df.select([F.col(f.name).cast("double").alias(f.name)
                      if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                      for f in df.schema.fields])


def with_exact_credits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<col>_e8`` = the credits rounded to 1e-8 as a long, so sums are
    exact and independent of partitioning. Decimal sources keep full
    precision through the conversion."""
    extra = [money.from_decimal_credits(F.col(c)).alias(f"{c}_e8")
             for c in columns if c in df.columns and f"{c}_e8" not in df.columns]
    return df.select("*", *extra) if extra else df


# Formats that carry their own schema in the files (read from footers, no
# data sampling): the declared schema is enforced by projection and cast.
SELF_DESCRIBING = {"parquet", "orc", "delta", "avro"}


def read_usage(spark: SparkSession, source: str, kind: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """One usage table of a known kind (S1-S7) in its declared schema.

    Text formats are read with the declared schema (no inference pass);
    self-describing formats keep their stored types at the scan and are cast
    in the projection, so a warehouse export with decimal credits reads as
    well as one with doubles. The exact ``_e8`` credit twins are taken from
    the stored value before the cast to double (S15). Extra columns (such as
    the ``log_date`` partition) are kept after the declared ones.
    """
    if kind not in SCHEMAS:
        raise ValueError(f"unknown usage table kind {kind!r}; one of {sorted(SCHEMAS)}")
    schema = SCHEMAS[kind]
    text_fmt = _is_table(spark, source) is False and fmt not in SELF_DESCRIBING
    df = read_source(spark, source, schema if text_fmt else None, fmt, options)
    declared = [f.name for f in schema.fields]
    exact = [money.from_decimal_credits(F.col(c)).alias(f"{c}_e8")
             for c in CREDIT_COLUMNS[kind] if f"{c}_e8" not in df.columns]
    extra = [c for c in df.columns if c not in declared]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields],
                     *exact, *extra)


#: Error conditions of a table, schema or path that isn't there.
MISSING = {"TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "SCHEMA_NOT_FOUND", "CATALOG_NOT_FOUND"}


def is_missing(e: AnalysisException) -> bool:
    return (e.getCondition() or "").split(".")[0] in MISSING


def read_usage_tolerant(spark: SparkSession, source: str, kind: str,
                        fmt: str = "parquet") -> tuple[DataFrame, bool]:
    """Like :func:`read_usage`, but a missing table / path yields an empty
    frame of the declared schema and ``False`` (S14). Only these are
    tolerated; a misspelt column, say, propagates."""
    try:
        df = read_usage(spark, source, kind, fmt)
        df.schema  # resolve now: a missing path fails here, not at run time  # noqa: B018
        return df, True
    except AnalysisException as e:
        if not is_missing(e):
            raise
        empty = spark.createDataFrame([], SCHEMAS[kind])
        return with_exact_credits(empty, CREDIT_COLUMNS[kind]), False


def text_source(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """The non-null values of one text column, with an optional key."""
    cols = ([key] if key else []) + [column]
    return df.select(*cols).where(F.col(column).isNotNull())


def _type_name(dt: T.DataType) -> str:
    return dt.simpleString().upper()


def text_columns(df: DataFrame) -> list[str]:
    """Columns whose type name contains a text type name (case-insensitive);
    when there is none, every column (S12)."""
    names = [f.name for f in df.schema.fields
             if any(t in _type_name(f.dataType) for t in TEXT_TYPE_NAMES)]
    return names or list(df.columns)


def list_sources(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Databases and their tables as a small DataFrame (S11): catalog
    metadata only, no data is read."""
    dbs = [database] if database else [d.name for d in spark.catalog.listDatabases()]
    rows = [(db, t.name, t.tableType, bool(t.isTemporary))
            for db in dbs for t in spark.catalog.listTables(db)]
    return spark.createDataFrame(rows, "database string, table string, table_type string, "
                                       "is_temporary boolean")


def check_access(spark: SparkSession, table: str) -> bool:
    """True iff the table exists and a probe returns a row."""
    try:
        if not spark.catalog.tableExists(table):
            return False
        return len(spark.table(table).limit(1).take(1)) > 0
    except AnalysisException:
        return False


def preview(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """First ``n`` non-null values of a column (S19): a limit, so the scan
    stops early instead of reading the table."""
    return text_source(df, column).limit(n)


def count_non_null(df: DataFrame, column: str) -> DataFrame:
    """Number of non-null values of a column."""
    return df.agg(F.count(F.col(column)).alias("row_count"))


@contextlib.contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Persist a frame that several actions read (S18) and release it after.
    Memory-and-disk: partitions that do not fit spill instead of being
    recomputed; lost blocks are recomputed from lineage."""
    df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()
