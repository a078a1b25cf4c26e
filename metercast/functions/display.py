"""Formatting for the presentation edge only (E20, E19): applied to the
final small result, never inside a computation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def usd(c, digits: int = 2) -> Column:
    """``$1,234.57``."""
    return F.format_string(f"$%,.{int(digits)}f", _c(c))


def credits(c, digits: int = 4) -> Column:
    """``1,234.5678`` (thousands separators, fixed decimals)."""
    return F.format_number(_c(c), int(digits))


def pct(c, digits: int = 1) -> Column:
    """``12.3%``."""
    return F.format_string(f"%.{int(digits)}f%%", _c(c))


def count(c) -> Column:
    """``1,234,567``."""
    return F.format_number(_c(c), 0)


def title(c) -> Column:
    """Title case of a tier or label."""
    return F.initcap(_c(c))
