"""Contracts: of columns while a plan is built, of rows inside the job that reads them; an error names what is wrong."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, needed: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ContractError(f"{what} lacks {missing}")
    return df


def holding(df: DataFrame, bad: Column, message: str | Column) -> DataFrame:
    """The rows as they are; the job that meets a ``bad`` one fails with the message.

    The check is part of the plan: it costs no job of its own, and what would have been written
    from broken rows is not.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The table, aggregated by its keys; its job fails at a key that comes twice, and names it."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *([F.first(F.struct(*rest)).alias("_row")] if rest else []))
    shown = F.concat(F.lit(f"{what} repeats {keys}: "), F.to_json(F.struct(*keys)))
    return holding(one, F.col("_rows") > 1, shown).select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def assert_none(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """The table, whose job fails at a bad row."""
    return holding(df, bad, what)


def assert_rows(df: DataFrame, expected: int, key: str | None = None) -> DataFrame:
    aggs = [F.count("*")] + ([F.countDistinct(key)] if key else [])
    got = df.agg(*aggs).first()
    if any(x != expected for x in got):
        raise ContractError(f"{got[0]} rows, {got[-1]} distinct; expected {expected}")
    return df


def assert_labels(df: DataFrame, date: str, number: str, zone: str) -> DataFrame:
    """Refuses period numbers that a day does not have."""
    from ..functions.clock import expected_periods

    return assert_none(df, (F.col(number) < 1) | (F.col(number) > expected_periods(F.col(date), zone)), "impossible period labels")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables that both must have unique keys."""
    return assert_unique(left, keys, "left").join(assert_unique(right, keys, "right"), keys)
