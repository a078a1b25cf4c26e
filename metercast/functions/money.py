"""Exact money arithmetic as column expressions.

Credit amounts travel as integers in units of 1e-8 credit (columns ending in
``_e8``); USD amounts as integers in units of 1e-10 USD (``_e10``). Sums are
taken over ``decimal(38,0)`` so they are exact, order independent (identical
on any partitioning) and cannot overflow at 100 TB, and are turned into
doubles once, at the end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

E8 = 100_000_000          # credit units per credit
E10 = 10_000_000_000      # USD units per USD
SUM_TYPE = "decimal(38,0)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """Exact sum of an integer column (never overflows a long accumulator)."""
    return F.sum(_c(c).cast(SUM_TYPE))


def e8_to_credits(c) -> Column:
    return _c(c).cast("double") / F.lit(float(E8))


def e10_to_usd(c) -> Column:
    return _c(c).cast("double") / F.lit(float(E10))


def credits_sum(c_e8) -> Column:
    """``SUM(credits)`` for an exact ``_e8`` column, as double."""
    return e8_to_credits(exact_sum(c_e8))


def usd_sum(c_e10) -> Column:
    return e10_to_usd(exact_sum(c_e10))


def token_credits_e8(tokens, rate_centi) -> Column:
    """tokens x (credits per 1M tokens x 100) = credits x 1e8, exactly."""
    return _c(tokens).cast("long") * _c(rate_centi).cast("long")


def price_centi(price: float) -> int | Decimal:
    """USD per credit in cents, exactly: an integer (3.0 -> 300), or a decimal
    for prices with parts of a cent (2.555 -> 255.5). At most 6 decimals of a
    cent, which decimal products keep."""
    cents = Decimal(str(price)) * 100
    if cents == cents.to_integral_value():
        return int(cents)
    if -cents.as_tuple().exponent > 6:
        raise ValueError(f"credit price {price} has more than 8 decimals")
    return cents.normalize()


def from_decimal_credits(c, scale: int = 8) -> Column:
    """Turn a warehouse credits column (double / decimal) into exact ``_e8``
    units; used by loaders of real usage tables."""
    return F.round(_c(c).cast("decimal(38,10)") * F.lit(10 ** scale), 0).cast("long")


def round_half_up(c, digits: int) -> Column:
    """Money rounding: HALF_UP on a decimal, returned as double."""
    return F.round(_c(c).cast("decimal(38,10)"), digits).cast("double")


def safe_div(num, den, default: float = 0.0) -> Column:
    """``num / den`` when ``den > 0`` else ``default`` (ANSI-safe)."""
    den = _c(den)
    return F.when(den > 0, _c(num) / den).otherwise(F.lit(default))
