"""Token costing against the price catalog.

Cost is linear in tokens, so every group-level estimate sums tokens first
and only then meets the catalog. The catalog's rates travel as **one row
holding a bounded array** (one struct per model, catalog order) joined to
the work by broadcast: pricing a workload on every model is then a
projection over that array. ``explode`` gives one row per (workload, model);
the cheapest / dearest model, the k cheapest and the savings are
``array_min`` / ``array_max`` / ``array_sort`` inside the same projection, so
no aggregation, sort or window follows the fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bands, money, tokens
from ..sources.catalog import DEFAULT_CREDIT_PRICE
from .common import DIM_MAX_ROWS, dimension

_RATE_COLS = ["model", "pos", "in_centi", "out_centi"]


def _rates(catalog: DataFrame) -> DataFrame:
    return dimension(catalog.select(*_RATE_COLS), of=catalog)


def rate_list(catalog: DataFrame, max_models: int = DIM_MAX_ROWS,
              of: DataFrame | None = None) -> DataFrame:
    """The catalog's rates as one row: ``_rates`` = array of
    struct(pos, model, in_centi, out_centi) in catalog order.

    The array lives in one task and is copied to every task, so the catalog
    size is checked first: the catalog (or ``of``, the frame it filters) is
    a local relation, or a bounded probe."""
    r = catalog.select("pos", "model", "in_centi", "out_centi")
    src = catalog if of is None else of
    if not src.isLocal() and r.limit(max_models + 1).count() > max_models:
        raise ValueError(f"price catalog has more than {max_models} models")
    return r.agg(F.sort_array(F.collect_list(F.struct("pos", "model", "in_centi", "out_centi")))
                 .alias("_rates"))


def _with_rate_list(df: DataFrame, catalog: DataFrame, of: DataFrame | None = None) -> DataFrame:
    # one row by construction (a global aggregate), size-checked in rate_list
    return df.crossJoin(F.broadcast(rate_list(catalog, of=of)))


def _e8(in_tok: Column, out_tok: Column, in_rate: Column, out_rate: Column):
    in_e8 = in_tok.cast(money.SUM_TYPE) * in_rate
    out_e8 = out_tok.cast(money.SUM_TYPE) * out_rate
    return in_e8, out_e8, in_e8 + out_e8


def _usd_raw(e8: Column, price: float) -> Column:
    return money.e10_to_usd(e8 * F.lit(money.price_centi(price)))


def cost_columns(in_tok: Column, out_tok: Column, price: float = DEFAULT_CREDIT_PRICE,
                 raw: bool = True, in_rate: Column | None = None,
                 out_rate: Column | None = None) -> list[Column]:
    """The 9-field cost record (E5, E6) given the input/output rates in
    centi-credits per 1M tokens (default: ``in_centi``/``out_centi`` in
    scope): credits rounded to 4 dp and USD to 2 dp (HALF_UP on decimal),
    plus exact twins when ``raw``."""
    in_rate = F.col("in_centi") if in_rate is None else in_rate
    out_rate = F.col("out_centi") if out_rate is None else out_rate
    in_e8, out_e8, tot_e8 = _e8(in_tok, out_tok, in_rate, out_rate)
    cols = [
        money.round_half_up(money.e8_to_credits(in_e8), 4).alias("input_credits"),
        money.round_half_up(money.e8_to_credits(out_e8), 4).alias("output_credits"),
        money.round_half_up(money.e8_to_credits(tot_e8), 4).alias("total_credits"),
        money.round_half_up(_usd_raw(in_e8, price), 2).alias("input_cost_usd"),
        money.round_half_up(_usd_raw(out_e8, price), 2).alias("output_cost_usd"),
        money.round_half_up(_usd_raw(tot_e8, price), 2).alias("total_cost_usd"),
    ]
    if raw:
        cols += [money.e8_to_credits(tot_e8).alias("total_credits_raw"),
                 _usd_raw(tot_e8, price).alias("total_cost_usd_raw")]
    return cols


def with_cost(df: DataFrame, catalog: DataFrame, in_col: str = "input_tokens",
              out_col: str = "output_tokens", model_col: str = "model",
              price: float = DEFAULT_CREDIT_PRICE, strict: bool = True,
              keep_unknown: bool = False) -> DataFrame:
    """Cost of token counts per row (C1). Unknown models raise when
    ``strict`` (the error is in a selected column, so it fires on use);
    otherwise they are skipped, or stay at zero cost with ``keep_unknown``."""
    r = _rates(catalog).withColumnRenamed("model", "_cat_model")
    cond = F.col(model_col) == F.col("_cat_model")
    j = df.join(r, cond, "left" if strict or keep_unknown else "inner")
    if keep_unknown:
        j = j.fillna(0, ["in_centi", "out_centi"])
    model = F.col(model_col)
    if strict:
        # the check rides on the selected model column, so it cannot be pruned
        model = F.when(F.col("_cat_model").isNull(),
                       F.raise_error(F.concat(F.lit("Unknown model: "),
                                              F.coalesce(F.col(model_col), F.lit("NULL"))))
                       ).otherwise(F.col(model_col))
    keep = [c for c in df.columns if c not in (in_col, out_col, model_col)]
    return j.select(*keep, model.alias("model"),
                    F.col(in_col).alias("input_tokens"), F.col(out_col).alias("output_tokens"),
                    *cost_columns(F.col(in_col), F.col(out_col), price))


def compare_models(work: DataFrame, catalog: DataFrame, in_col: str = "input_tokens",
                   out_col: str = "output_tokens", price: float = DEFAULT_CREDIT_PRICE) -> DataFrame:
    """Every workload row on every catalog model (C2, J3): |work| x |models|
    rows by exploding the broadcast rate array; the work keeps its
    partitioning (a narrow projection, no join fan-out stage)."""
    keep = [c for c in work.columns if c not in (in_col, out_col)]
    j = _with_rate_list(work, catalog).select(
        *keep, F.col(in_col).alias("_in"), F.col(out_col).alias("_out"), F.explode("_rates").alias("_r"))
    return j.select(*keep, F.col("_r.model").alias("model"), F.col("_r.pos").alias("pos"),
                    F.col("_in").alias("input_tokens"), F.col("_out").alias("output_tokens"),
                    *cost_columns(F.col("_in"), F.col("_out"), price,
                                  in_rate=F.col("_r.in_centi"), out_rate=F.col("_r.out_centi")))


def _model_costs(in_tok: Column, out_tok: Column, price: float, fields) -> Column:
    """Per row: the array of ``fields(r, usd_raw, usd_rounded)`` structs over
    the rate array ``_rates`` in scope."""
    def one(r):
        _i, _o, tot = _e8(in_tok, out_tok, r["in_centi"], r["out_centi"])
        raw = _usd_raw(tot, price)
        return fields(r, raw, money.round_half_up(raw, 2))
    return F.transform("_rates", one)


def cost_calculator(work: DataFrame, catalog: DataFrame, key: str = "work_id",
                    in_per_request: str = "input_tokens_per_request",
                    out_per_request: str = "output_tokens_per_request",
                    requests: str = "requests", price: float = DEFAULT_CREDIT_PRICE,
                    allowed: list[str] | None = None) -> DataFrame:
    """Workload calculator (C3): tokens per request x requests on every
    allowed model; per workload the cheapest and dearest model (ranked by the
    displayed cost, then exact cost, then catalog order), savings and %.
    One projection per workload row over the rate array: no shuffle."""
    cat = catalog if allowed is None else catalog.where(F.col("model").isin(list(allowed)))
    w = work.select(key, (F.col(in_per_request) * F.col(requests)).alias("_in"),
                    (F.col(out_per_request) * F.col(requests)).alias("_out"))
    costs = _model_costs(F.col("_in"), F.col("_out"), price,
                         lambda r, raw, usd: F.struct(usd.alias("usd"), raw.alias("raw"),
                                                      r["pos"].alias("pos"), r["model"].alias("model")))
    c = _with_rate_list(w, cat, of=catalog).where(F.size("_rates") > 0).select(
        key, F.size("_rates").cast("long").alias("n_models"), costs.alias("_c"))
    lo, hi = F.array_min("_c"), F.array_max("_c")
    return c.select(key, "n_models",
                    lo["model"].alias("cheapest_model"), lo["usd"].alias("cheapest_cost_usd"),
                    hi["model"].alias("most_expensive_model"), hi["usd"].alias("most_expensive_cost_usd"),
                    (hi["usd"] - lo["usd"]).alias("savings_usd"),
                    bands.savings_pct(lo["usd"], hi["usd"]).alias("savings_pct"))


def price_spread(costs: DataFrame, keys: list[str], measure: str = "total_cost_usd_raw") -> DataFrame:
    """Dearest / cheapest model cost per group, 0 if the minimum is 0."""
    g = costs.groupBy(*keys).agg(F.min(measure).alias("min_cost"), F.max(measure).alias("max_cost"),
                                 F.count(F.lit(1)).alias("n_models"))
    return g.withColumn("price_ratio", money.safe_div(F.col("max_cost"), F.col("min_cost")))


def catalog_price_ratio(catalog: DataFrame) -> DataFrame:
    """Max / min input price over the (allowed) catalog (A14): 250 for all."""
    return price_spread(catalog, [], "input_credits")


# -- corpus and request-log costing ---------------------------------------------

def estimate_text_cost(df: DataFrame, text_col: str, catalog: DataFrame, out_tokens: int | Column = 150,
                       keys: list[str] | None = None, price: float = DEFAULT_CREDIT_PRICE,
                       template: str | None = None, count_template: bool = False) -> DataFrame:
    """Cost of sending every non-null text of a column to every model.

    Input tokens per row follow the prompt estimate (E2) on the text alone,
    or on the filled template when ``count_template``; ``out_tokens`` is the
    expected output per row (a number or a column such as E4). Rows are
    summed per group first; the sums then meet the catalog.
    """
    keys = list(keys or [])
    src = df.where(F.col(text_col).isNotNull())
    if template and count_template:
        if template.count("{text}") == 1:
            # the filled prompt's length without building the string
            in_tok = tokens.est_tokens_of_length(F.length(F.col(text_col))
                                                 + F.lit(len(template) - len("{text}")))
        else:
            in_tok = tokens.est_input_tokens(tokens.fill_prompt(template, F.col(text_col)))
    else:
        in_tok = tokens.est_input_tokens(F.col(text_col))
    out = out_tokens if isinstance(out_tokens, Column) else F.lit(int(out_tokens)).cast("long")
    per_row = src.select(*keys, in_tok.alias("_in"), out.alias("_out"))
    agg = [F.count(F.lit(1)).alias("rows"), F.sum("_in").alias("input_tokens"),
           F.sum("_out").alias("output_tokens")]
    g = per_row.groupBy(*keys).agg(*agg) if keys else per_row.agg(*agg)
    g = g.where(F.col("rows") > 0)
    c = compare_models(g, catalog, price=price)
    return c.select(*keys, "model", "pos", "rows", "input_tokens", "output_tokens",
                    "total_credits_raw", "total_cost_usd_raw", "total_cost_usd")


# The test types of the test wizard.
TEST_TYPES = [
    "COMPLETE - Custom Prompt",
    "COMPLETE - Summarize",
    "COMPLETE - Classify",
    "COMPLETE - Extract",
    "SENTIMENT - Built-in",
    "SUMMARIZE - Built-in",
    "Compare: COMPLETE vs SENTIMENT",
    "Compare: COMPLETE vs SUMMARIZE",
]


# The default prompt of each test type (None: a built-in
# function, no prompt) and the default classification categories.
DEFAULT_CATEGORIES = "Positive, Negative, Neutral, Mixed"
TEST_PROMPTS = {
    "COMPLETE - Custom Prompt": "Analyze the following and provide insights:\n\n{text}",
    "COMPLETE - Summarize": "Summarize the following text in 2-3 concise sentences:\n\n{text}",
    "COMPLETE - Classify": tokens.CLASSIFY_PROMPT.replace("{categories}", DEFAULT_CATEGORIES),
    "COMPLETE - Extract": "Extract key entities (names, dates, locations, amounts) from this text as JSON:\n\n{text}",
    "SENTIMENT - Built-in": None,
    "SUMMARIZE - Built-in": None,
    "Compare: COMPLETE vs SENTIMENT": "Analyze sentiment (POSITIVE/NEGATIVE/NEUTRAL): {text}",
    "Compare: COMPLETE vs SUMMARIZE": "Summarize: {text}",
}


def _prompt_extra_chars(template: str | None) -> int | None:
    """Characters a template adds around its one ``{text}`` (None: no prompt)."""
    if template is None:
        return None
    if template.count("{text}") != 1:
        raise ValueError("a test prompt must hold exactly one {text}")
    return len(template) - len("{text}")


def estimate_by_test_type(df: DataFrame, text_col: str, catalog: DataFrame,
                          test_types=TEST_TYPES, price: float = DEFAULT_CREDIT_PRICE,
                          count_template: bool = False, prompts: dict | None = None) -> DataFrame:
    """Cost of running each test type over the whole text column on every
    model (C19 with E4): expected output tokens per row by the test type's
    label (case-sensitive, E4); input tokens of the text only (Q3), or of
    the filled prompt with ``count_template`` (built-in types have none).

    One pass: the filled prompt's length is the template's extra length plus
    the text's, so every test type is one more conditional sum of the same
    aggregate (no per-type copy of the rows); the test types then fan out the
    one aggregated row."""
    prompts = TEST_PROMPTS if prompts is None else prompts
    n = F.length(F.col(text_col))

    def in_tokens(extra: int | None):
        if not count_template or extra is None:
            return tokens.est_input_tokens(F.col(text_col))
        return tokens.est_tokens_of_length(n + F.lit(extra))

    extras = {t: _prompt_extra_chars(prompts.get(t)) for t in test_types}
    src = df.where(F.col(text_col).isNotNull())
    g = src.agg(F.count(F.lit(1)).alias("rows"),
                *[F.sum(in_tokens(extras[t])).alias(f"_in{i}") for i, t in enumerate(test_types)])
    per_type = F.array(*[F.struct(F.lit(t).alias("test_type"), F.col(f"_in{i}").alias("input_tokens"))
                         for i, t in enumerate(test_types)])
    t = g.where(F.col("rows") > 0).select("rows", F.explode(per_type).alias("_t"))
    t = t.select(F.col("_t.test_type").alias("test_type"), "rows", F.col("_t.input_tokens").alias("input_tokens"),
                 (F.col("rows") * tokens.expected_output_tokens(F.col("_t.test_type"))).alias("output_tokens"))
    c = compare_models(t, catalog, price=price)
    return c.select("test_type", "model", "pos", "rows", "input_tokens", "output_tokens",
                    "total_credits_raw", "total_cost_usd_raw", "total_cost_usd")


def request_tokens(conversations: DataFrame, key: str = "conv_id", role_col: str = "role",
                   text_col: str = "text", output_roles=("assistant",)) -> DataFrame:
    """Per request (conversation): input tokens of the prompt turns (E1 per
    turn) and output tokens of the reply turns (E3 per turn), summed."""
    is_out = F.col(role_col).isin(list(output_roles))
    t = conversations.select(
        key,
        F.when(~is_out, tokens.est_tokens(F.coalesce(F.col(text_col), F.lit(""))))
         .otherwise(F.lit(0).cast("long")).alias("_in"),
        F.when(is_out, tokens.est_output_tokens(F.col(text_col)))
         .otherwise(F.lit(0).cast("long")).alias("_out"))
    return t.groupBy(key).agg(F.count(F.lit(1)).alias("turns"),
                              F.sum("_in").alias("input_tokens"),
                              F.sum("_out").alias("output_tokens"))


def estimate_request_cost(conversations: DataFrame, catalog: DataFrame,
                          price: float = DEFAULT_CREDIT_PRICE, key: str = "conv_id") -> DataFrame:
    """Request-log cost per model (C20): token sums over all requests, then
    one row per model."""
    per = request_tokens(conversations, key)
    g = per.agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"),
                F.sum("output_tokens").alias("output_tokens"))
    c = compare_models(g, catalog, price=price)
    return c.select("model", "requests", "input_tokens", "output_tokens",
                    "total_credits_raw", "total_cost_usd_raw")


def request_costs(conversations: DataFrame, catalog: DataFrame,
                  price: float = DEFAULT_CREDIT_PRICE, key: str = "conv_id") -> DataFrame:
    """Per (request, model) cost rows; partitioned by the request key."""
    per = request_tokens(conversations, key)
    return compare_models(per, catalog, price=price)


def cheapest_model_per_request(conversations: DataFrame, catalog: DataFrame,
                               price: float = DEFAULT_CREDIT_PRICE, key: str = "conv_id") -> DataFrame:
    """Cheapest and dearest model per request (T9), first in catalog order
    on ties: ``array_min`` / ``array_max`` over the request's per-model
    costs, in one projection after the per-request token sums."""
    per = request_tokens(conversations, key)
    lo_costs = _model_costs(F.col("input_tokens"), F.col("output_tokens"), price,
                            lambda r, raw, usd: F.struct(raw.alias("m"), r["pos"].alias("p"),
                                                         r["model"].alias("model")))
    hi_costs = _model_costs(F.col("input_tokens"), F.col("output_tokens"), price,
                            lambda r, raw, usd: F.struct(raw.alias("m"), (-r["pos"]).alias("p"),
                                                         r["model"].alias("model")))
    c = _with_rate_list(per, catalog).where(F.size("_rates") > 0).select(
        key, "input_tokens", "output_tokens",
        F.array_min(lo_costs).alias("lo"), F.array_max(hi_costs).alias("hi"))
    return c.select(key, "input_tokens", "output_tokens",
                    F.col("lo.model").alias("cheapest_model"), F.col("lo.m").alias("cheapest_cost_usd"),
                    F.col("hi.model").alias("dearest_model"), F.col("hi.m").alias("dearest_cost_usd"),
                    bands.savings_pct(F.col("lo.m"), F.col("hi.m")).alias("savings_pct"))


def cheapest_k_per_request(conversations: DataFrame, catalog: DataFrame, k: int = 5,
                           price: float = DEFAULT_CREDIT_PRICE, key: str = "conv_id") -> DataFrame:
    """The ``k`` cheapest models per request (T4 per group): the request's
    per-model costs sorted in the row (cost, then catalog order), the first
    ``k`` exploded with their rank."""
    per = request_tokens(conversations, key)
    costs = _model_costs(F.col("input_tokens"), F.col("output_tokens"), price,
                         lambda r, raw, usd: F.struct(raw.alias("c"), r["pos"].alias("p"),
                                                      r["model"].alias("model")))
    c = _with_rate_list(per, catalog).select(
        key, F.posexplode(F.slice(F.array_sort(costs), 1, k)).alias("_i", "_s"))
    return c.select(key, (F.col("_i") + 1).cast("long").alias("rank"),
                    F.col("_s.model").alias("model"), F.col("_s.c").alias("total_cost_usd_raw"))


def named_tier_costs(conversations: DataFrame, catalog: DataFrame, tiers: DataFrame,
                     price: float = DEFAULT_CREDIT_PRICE, key: str = "conv_id") -> DataFrame:
    """Request-log cost on the models of each named tier ∩ catalog."""
    members = dimension(tiers.join(dimension(catalog.select("model"), of=catalog), "model", "left_semi"),
                        of=[tiers, catalog])
    per = estimate_request_cost(conversations, catalog, price, key)
    return per.join(members, "model", "inner").select("tier", *per.columns)


# -- C33 rate-list costing --------------------------------------------------------

def _rate_e8(units: Column, rate_centi: Column, per_units: Column) -> Column:
    """Exact credits x 1e8 of ``units`` at a rate in centi-credits per
    ``per_units`` units (units may carry up to 12 decimals: GB-months, hours)."""
    scaled = (units.cast("decimal(28,12)") * rate_centi.cast("decimal(9,0)")).cast("decimal(38,12)")
    return F.round(scaled * (F.lit(1_000_000) / per_units).cast("decimal(7,0)"), 0).cast(money.SUM_TYPE)


def rate_list_cost(units: DataFrame, rates: DataFrame, name_col: str = "name",
                   units_col: str = "units") -> DataFrame:
    """Credits of metered units at their list rate (C33, E25): tokens per 1M,
    messages or pages per 1,000, GB-months or compute hours per unit. Rows
    whose name has no rate keep NULL rate and credits."""
    r = dimension(rates.select(F.col("name").alias(name_col), "kind", "credits_per_unit",
                               "rate_centi", "per_units", "unit"), of=rates)
    j = units.join(r, name_col, "left")
    e8 = _rate_e8(F.col(units_col), F.col("rate_centi"), F.col("per_units"))
    return j.select(*units.columns, "kind", "unit", "credits_per_unit",
                    money.e8_to_credits(e8).alias("credits"))


def embedding_cost(texts: DataFrame, text_col: str, rates: DataFrame,
                   keys: list[str] | None = None) -> DataFrame:
    """Cost of embedding the whole text column with every embedding model of
    the rate list (C33): E1 tokens summed per group once, then priced on each
    model through a one-row array of the (size-checked) rates."""
    keys = list(keys or [])
    t = texts.where(F.col(text_col).isNotNull()).select(
        *keys, tokens.est_tokens(F.col(text_col)).alias("_t"))
    agg = [F.count(F.lit(1)).alias("rows"), F.sum("_t").alias("tokens")]
    g = t.groupBy(*keys).agg(*agg) if keys else t.agg(*agg).where(F.col("rows") > 0)
    emb = rates.where(F.col("kind") == "embedding")
    if not rates.isLocal() and emb.limit(DIM_MAX_ROWS + 1).count() > DIM_MAX_ROWS:
        raise ValueError(f"more than {DIM_MAX_ROWS} embedding rates")
    arr = emb.agg(F.sort_array(F.collect_list(F.struct("name", "rate_centi", "per_units"))).alias("_m"))
    # ``arr`` is one row by construction (a global aggregate)
    e = g.crossJoin(F.broadcast(arr)).select(*keys, "rows", "tokens", F.explode("_m").alias("_r"))
    e8 = _rate_e8(F.col("tokens"), F.col("_r.rate_centi"), F.col("_r.per_units"))
    return e.select(*keys, F.col("_r.name").alias("embedding_model"), "rows", "tokens",
                    money.e8_to_credits(e8).alias("credits"))


def function_cost(usage: DataFrame, rates: DataFrame, name_col: str = "function_name",
                  tokens_col: str = "tokens") -> DataFrame:
    """Per function: calls, tokens and the cost at the function's list rate
    (E25). Functions without a list rate keep NULL rate and cost."""
    r = dimension(rates.select(F.col("name").alias(name_col), F.col("credits_per_unit").alias("rate_credits_per_1m"),
                               "rate_centi"), of=rates)
    # tokens are summed per function first: only the few sums meet the rates
    g = usage.groupBy(name_col).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens_col).alias("tokens"))
    e8 = F.col("tokens").cast(money.SUM_TYPE) * F.col("rate_centi")
    return g.join(r, name_col, "left").select(name_col, "calls", "tokens", "rate_credits_per_1m",
                                              money.e8_to_credits(e8).alias("rate_credits"))
