"""Price catalog and rate lists as small dimension DataFrames.

The catalog is a fixed 22-row dimension, so broadcasting it is safe at any
scale: its size does not grow with the usage data. Rates are kept twice: as
the published credits per 1M tokens (double, for display) and as exact
integer centi-credits (``*_centi``) so that cost sums are exact integers and
do not depend on partitioning or aggregation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the published price list; do not edit).
# One row per model in catalog order:
# model, provider, input credits / 1M, output credits / 1M, tier,
# context window, best-for use cases, supports vision, available
# ---------------------------------------------------------------------------
MODELS = [
    ("openai-gpt-5-nano", "OpenAI", "0.03", "0.22", "small", 128000,
     ["Simple classification", "Basic extraction", "High volume tasks"], False, False),
    ("openai-gpt-5-mini", "OpenAI", "0.14", "1.10", "small", 128000,
     ["Classification", "Sentiment analysis", "Summarization"], False, False),
    ("openai-gpt-5", "OpenAI", "0.69", "5.50", "medium", 128000,
     ["Complex reasoning", "Code generation", "Multi-step tasks"], True, False),
    ("openai-gpt-5-chat", "OpenAI", "0.63", "5.00", "medium", 128000,
     ["Conversational AI", "Chat applications", "Interactive tasks"], False, False),
    ("openai-gpt-4.1", "OpenAI", "1.00", "4.00", "medium", 128000,
     ["General purpose", "Content generation", "Analysis"], True, True),
    ("openai-o4-mini", "OpenAI", "0.55", "2.20", "medium", 128000,
     ["Reasoning tasks", "Math problems", "Logical analysis"], False, False),
    ("claude-4-5-haiku", "Anthropic", "0.55", "2.75", "small", 200000,
     ["Fast responses", "Simple tasks", "Cost-effective"], False, False),
    ("claude-3-5-sonnet", "Anthropic", "1.50", "7.50", "large", 200000,
     ["Complex analysis", "Long documents", "Nuanced understanding"], True, True),
    ("claude-3-7-sonnet", "Anthropic", "1.50", "7.50", "large", 200000,
     ["Complex analysis", "Long documents", "Nuanced understanding"], True, False),
    ("claude-4-sonnet", "Anthropic", "1.50", "7.50", "large", 200000,
     ["Complex analysis", "Long documents", "Nuanced understanding"], True, False),
    ("claude-4-5-sonnet", "Anthropic", "1.65", "8.25", "large", 200000,
     ["Latest capabilities", "Complex reasoning", "Vision tasks"], True, False),
    ("claude-4-opus", "Anthropic", "7.50", "37.50", "premium", 200000,
     ["Most complex tasks", "Highest quality", "Research"], True, False),
    ("snowflake-llama-3.3-70b", "Meta (Snowflake optimized)", "0.29", "0.29", "small", 128000,
     ["General tasks", "Cost-effective", "Good quality/price ratio"], False, True),
    ("snowflake-llama-3.1-405b", "Meta (Snowflake optimized)", "0.96", "0.96", "medium", 128000,
     ["Complex reasoning", "Large context", "Open source preference"], False, True),
    ("llama3.1-70b", "Meta", "0.29", "0.29", "small", 128000,
     ["General tasks", "Balanced performance"], False, True),
    ("llama3.1-8b", "Meta", "0.03", "0.03", "small", 128000,
     ["Simple tasks", "Very high volume", "Lowest cost"], False, True),
    ("mistral-large2", "Mistral AI", "1.00", "3.00", "medium", 128000,
     ["European data compliance", "Multilingual", "Code"], False, True),
    ("mistral-7b", "Mistral AI", "0.05", "0.05", "small", 32000,
     ["Simple tasks", "Very high volume", "Budget-friendly"], False, True),
    ("mixtral-8x7b", "Mistral AI", "0.11", "0.11", "small", 32000,
     ["Balanced performance", "General tasks", "Cost-effective"], False, True),
    ("pixtral-large", "Mistral AI", "1.00", "3.00", "medium", 128000,
     ["Vision tasks", "Image analysis", "Multimodal"], True, False),
    ("snowflake-arctic", "Snowflake", "0.84", "0.84", "medium", 4096,
     ["Enterprise tasks", "Snowflake native", "SQL generation"], False, True),
    ("deepseek-r1", "DeepSeek", "0.55", "2.19", "medium", 64000,
     ["Reasoning", "Math", "Coding"], False, True),
]

# Task-function rates, credits per 1M tokens.
FUNCTION_RATES = [
    ("AI_SENTIMENT", "1.60"), ("AI_AGG", "1.60"), ("AI_CLASSIFY", "1.39"),
    ("AI_EXTRACT", "5.00"), ("AI_FILTER", "1.39"), ("AI_REDACT", "0.63"),
    ("AI_SUMMARIZE_AGG", "1.60"), ("AI_TRANSCRIBE", "1.30"), ("AI_TRANSLATE", "1.50"),
    ("SENTIMENT", "0.08"), ("SUMMARIZE", "0.10"), ("EXTRACT_ANSWER", "0.08"),
    ("TRANSLATE", "1.50"), ("GUARD", "0.25"),
]

# Embedding model rates, credits per 1M tokens.
EMBEDDING_RATES = [
    ("snowflake-arctic-embed-l", "0.05"), ("snowflake-arctic-embed-m", "0.03"),
    ("e5-base-v2", "0.03"), ("voyage-multilingual-2", "0.10"),
]

# Other service rates (rate, unit).
SERVICE_RATES = [
    ("cortex_analyst", "67", "credits per 1,000 messages"),
    ("cortex_search_serving", "6.3", "credits per GB/month indexed"),
    ("ai_parse_document_layout", "3.33", "credits per 1,000 pages"),
    ("ai_parse_document_ocr", "0.5", "credits per 1,000 pages"),
    ("document_ai", "8", "credits per hour compute"),
]

# Keywords per task category used to match tasks to use cases.
TASK_KEYWORDS = [
    ("classification", ["classification", "classify", "categorize"]),
    ("sentiment", ["sentiment", "emotion", "tone"]),
    ("summarization", ["summary", "summarize", "condense"]),
    ("extraction", ["extract", "parse", "identify"]),
    ("translation", ["translate", "language", "multilingual"]),
    ("code", ["code", "programming", "sql"]),
    ("reasoning", ["reasoning", "logic", "math", "complex"]),
    ("vision", ["image", "vision", "visual", "picture"]),
    ("chat", ["chat", "conversation", "interactive"]),
]

# Named model tiers of the test wizard (names outside the
# catalog are kept; they simply match nothing).
NAMED_TIERS = [
    ("Budget", ["llama3.2-1b", "llama3.2-3b", "mistral-7b", "gemma-7b"]),
    ("Balanced", ["llama3.1-8b", "mixtral-8x7b", "snowflake-arctic"]),
    ("Premium", ["llama3.1-70b", "mistral-large", "mistral-large2", "claude-3-5-sonnet"]),
]

DEFAULT_CREDIT_PRICE = 3.0


_FIXED: dict[tuple, tuple[SparkSession, DataFrame]] = {}


def _fixed(spark: SparkSession, key: str, rows_fn, schema) -> DataFrame:
    """A fixed table of this module, built once per session (it never
    changes, so one local relation serves every query)."""
    k = (id(spark), key)
    hit = _FIXED.get(k)
    if hit is None or hit[0] is not spark:
        hit = _FIXED[k] = (spark, local_frame(spark, rows_fn(), schema))
    return hit[1]


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small fixed table as a local relation (built from an Arrow table,
    whatever the session's Arrow setting), so its size is known without
    running a job and filters or projections on it fold on the driver."""
    import pyarrow as pa
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = st.fieldNames()
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}) if rows else None
    if table is None:
        return spark.createDataFrame([], st)
    return spark.createDataFrame(table, st)


def _centi(s: str) -> int:
    """Exact integer hundredths of a decimal string ('0.29' -> 29). A rate
    with more decimals is refused rather than cut."""
    whole, _, frac = s.partition(".")
    if frac[2:].strip("0"):
        raise ValueError(f"rate {s} has more than 2 decimals")
    frac = (frac + "00")[:2]
    return int(whole) * 100 + int(frac)


CATALOG_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("model", T.StringType(), False),
    T.StructField("provider", T.StringType(), False),
    T.StructField("input_credits", T.DoubleType(), False),
    T.StructField("output_credits", T.DoubleType(), False),
    T.StructField("in_centi", T.LongType(), False),
    T.StructField("out_centi", T.LongType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("context_window", T.LongType(), False),
    T.StructField("best_for", T.ArrayType(T.StringType(), False), False),
    T.StructField("supports_vision", T.BooleanType(), False),
    T.StructField("supports_streaming", T.BooleanType(), False),
    T.StructField("available", T.BooleanType(), False),
])


def catalog_rows() -> list[tuple]:
    rows = []
    for pos, (m, prov, i, o, cat, ctx, best, vis, avail) in enumerate(MODELS):
        rows.append((pos, m, prov, float(i), float(o), _centi(i), _centi(o), cat, ctx,
                     list(best), vis, True, avail))
    return rows


def load_catalog(spark: SparkSession, allowed: list[str] | None = None) -> DataFrame:
    """The model price catalog as a dimension (S9), optionally restricted to an
    allow-list (P14). Always small: callers may ``F.broadcast`` it."""
    df = _fixed(spark, "catalog", catalog_rows, CATALOG_SCHEMA)
    if allowed is not None:
        df = df.where(F.col("model").isin(list(allowed)))
    return df


RATES_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("credits_per_unit", T.DoubleType(), False),
    T.StructField("rate_centi", T.LongType(), False),
    T.StructField("unit", T.StringType(), False),
    T.StructField("per_units", T.LongType(), False),
])


def _per_units(unit: str) -> int:
    """How many units one rate is quoted for, from its unit text: per 1M
    tokens, per 1,000 messages / pages, else per single unit (GB-month,
    compute hour)."""
    if "1M" in unit:
        return 1_000_000
    if "1,000" in unit:
        return 1_000
    return 1


def rate_rows(kind: str | None = None) -> list[tuple]:
    rows = [("function", n, float(r), _centi(r), "1M tokens") for n, r in FUNCTION_RATES]
    rows += [("embedding", n, float(r), _centi(r), "1M tokens") for n, r in EMBEDDING_RATES]
    rows += [("service", n, float(r), _centi(r), u) for n, r, u in SERVICE_RATES]
    return [(*r, _per_units(r[4])) for r in rows if kind is None or r[0] == kind]


def load_rates(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """Function / embedding / service rate lists as one dimension."""
    return _fixed(spark, f"rates:{kind}", lambda: rate_rows(kind), RATES_SCHEMA)


def load_named_tiers(spark: SparkSession) -> DataFrame:
    """Named model tiers (P15) as (tier, model) rows."""
    return _fixed(spark, "tiers", lambda: [(t, m) for t, ms in NAMED_TIERS for m in ms],
                  "tier string, model string")


def load_task_keywords(spark: SparkSession) -> DataFrame:
    return _fixed(spark, "keywords", lambda: [(c, k) for c, ks in TASK_KEYWORDS for k in ks],
                  "task_category string, keyword string")


# --- SQL text of the same fixed values (for oracle queries and SQL users) ---

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def catalog_values_sql(alias: str = "cat") -> str:
    """The catalog as a portable ``(VALUES ...) AS cat(...)`` relation
    (best_for omitted; a list literal is not portable)."""
    vals = ",\n    ".join(
        f"({p}, {_q(m)}, {_q(pr)}, CAST({i!r} AS DOUBLE), CAST({o!r} AS DOUBLE), "
        f"CAST({ic} AS BIGINT), CAST({oc} AS BIGINT), {_q(c)}, CAST({ctx} AS BIGINT), "
        f"{str(v).upper()}, {str(a).upper()})"
        for (p, m, pr, i, o, ic, oc, c, ctx, _b, v, _s, a) in catalog_rows())
    return (f"(VALUES\n    {vals}\n) AS {alias}(pos, model, provider, input_credits, output_credits, "
            "in_centi, out_centi, category, context_window, supports_vision, available)")


def best_for_values_sql(alias: str = "bf") -> str:
    """(model, k, use_case) rows of every model's best-for list."""
    vals = ", ".join(f"({_q(row[0])}, {k}, {_q(u)})"
                     for row in MODELS for k, u in enumerate(row[6]))
    return f"(VALUES {vals}) AS {alias}(model, k, use_case)"


def rates_values_sql(kind: str, alias: str = "rates") -> str:
    vals = ", ".join(f"({_q(n)}, CAST({r!r} AS DOUBLE), CAST({rc} AS BIGINT))"
                     for (_k, n, r, rc, _u, _p) in rate_rows(kind))
    return f"(VALUES {vals}) AS {alias}(name, credits_per_unit, rate_centi)"


def keywords_values_sql(alias: str = "kw") -> str:
    vals = ", ".join(f"({_q(c)}, {_q(k)})" for c, ks in TASK_KEYWORDS for k in ks)
    return f"(VALUES {vals}) AS {alias}(task_category, keyword)"


def tiers_values_sql(alias: str = "tiers") -> str:
    vals = ", ".join(f"({_q(t)}, {_q(m)})" for t, ms in NAMED_TIERS for m in ms)
    return f"(VALUES {vals}) AS {alias}(tier, model)"
