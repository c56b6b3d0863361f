"""Whole-number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(c: Column | str, n: int) -> Column:
    """Integer division; `/` would go through double and lose large positions."""
    return F.call_function("div", F.col(c) if isinstance(c, str) else c, F.lit(n)).cast("bigint")
