"""Row rules: plausibility, default prices, guarded arithmetic, seasons."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

LIQUIDITY_THRESHOLD = 25.0
ZERO_TOLERANCE = 1e-9


def clean_double(c: Column) -> Column:
    """Lenient numeric cast; NaN and what is no number are null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def out_of_band(x: Column, low: float, high: float) -> Column:
    return F.coalesce((x < low) | (x > high), F.lit(False))


def defaulted(price: Column, volume: Column, threshold: float = LIQUIDITY_THRESHOLD, tolerance: float = ZERO_TOLERANCE) -> Column:
    """A zero price with volume below the threshold; a null volume is no default."""
    return F.coalesce((F.abs(price) <= tolerance) & (volume < threshold), F.lit(False))


def liquidity_anomaly(price: Column, volume: Column, threshold: float = LIQUIDITY_THRESHOLD, tolerance: float = ZERO_TOLERANCE) -> Column:
    """A price that is not zero with volume below the threshold."""
    return F.coalesce((F.abs(price) > tolerance) & (volume < threshold), F.lit(False))


def guarded_ratio(n: Column, d: Column) -> Column:
    """Null where the denominator is not positive."""
    return F.when(d > 0, n / d)


def in_season(date: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Month-day window of any year, ends included; it does not wrap around the year."""
    return (F.month(date) * 100 + F.day(date)).between(first[0] * 100 + first[1], last[0] * 100 + last[1])


def errors(forecast: Column, actual: Column, capacity: Column | None = None) -> dict[str, Column]:
    """Signed and absolute error, and the signed one as a share of capacity."""
    out = {"error": forecast - actual, "abs_error": F.abs(forecast - actual)}
    if capacity is not None:
        out["error_share"] = guarded_ratio(forecast - actual, capacity)
    return out


def available_at(start: Column, lag_minutes: int = 60, step: int = 30) -> Column:
    """When a half hour's value is public: its end and the publication lag."""
    return F.timestamp_seconds(F.unix_timestamp(start) + (step + lag_minutes) * 60)


def weighted_price(prices: list[Column], volumes: list[Column]) -> tuple[Column, Column]:
    """Volume-weighted price and total volume of several providers' columns.

    A pair counts where price and volume are present and the volume is positive; without any the
    price is null and the volume 0.
    """
    ok = [F.coalesce(p.isNotNull() & (v > 0), F.lit(False)) for p, v in zip(prices, volumes)]
    total = reduce(add, [F.when(o, v).otherwise(0.0) for o, v in zip(ok, volumes)])
    value = reduce(add, [F.when(o, p * v).otherwise(0.0) for o, p, v in zip(ok, prices, volumes)])
    return F.when(total > 0, value / total), total


def uncrossed(columns: list[str]) -> list[Column]:
    """Quantile columns sorted within the row, so that they do not cross; a null leaves the row as it is."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    ordered = F.array_sort(F.array(*columns))
    return [F.when(whole, ordered[i]).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)]


def pinball(actual: Column, forecast: Column, q: float) -> Column:
    d = actual - forecast
    return F.greatest(q * d, (q - 1) * d)
