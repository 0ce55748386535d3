"""Shaping landed feeds: canonical columns, wide pivots, re-keyed labels, vintages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, rules
from ..operators.contracts import assert_labels, assert_unique, holding, require_columns
from ..operators.series import latest_revision


def canonical(df: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None, numeric: list[str] | None = None, what: str = "feed") -> DataFrame:
    """Renames required and present optional columns; numeric ones are cast leniently."""
    require_columns(df, required, what)
    names = required | {a: b for a, b in (optional or {}).items() if a in df.columns}
    return df.select(*((rules.clean_double(F.col(a)) if b in (numeric or []) else F.col(a)).alias(b) for a, b in names.items()))


def restrict(df: DataFrame, date: str, start: str | Column, end: str | Column) -> DataFrame:
    """Rows of an inclusive date range, of written dates or of columns."""
    first, last = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (start, end))
    return df.filter(F.col(date).between(first, last))


def pivot_providers(df: DataFrame, keys: list[str], provider: str, providers: list[str], price: str, volume: str) -> DataFrame:
    """One price and volume column a provider; refuses repeated (key, provider)."""
    return assert_unique(df, [*keys, provider], "provider rows").groupBy(*keys).pivot(provider, providers).agg(F.first(price).alias(price), F.first(volume).alias(volume))


def pivot_fuels(df: DataFrame, keys: list[str], fuel: str, fuels: list[str], value: str, revised: str, moved: str | None = None, start: str | None = None) -> DataFrame:
    """The latest revision of each fuel as ``gen_<fuel>_mw``; with ``moved`` also ``rekeyed``, whether any row was
    moved, and with ``start`` also ``start_time``, the first start time that a row of the key carries itself."""
    rows = latest_revision(df, [*keys, fuel], revised)
    name = lambda f: f"gen_{f.strip().lower()}_mw"
    own = F.concat(F.lit("gen_"), F.lower(F.trim(fuel)), F.lit("_mw"))
    cells = [F.first(F.when(own == name(f), rules.clean_double(F.col(value))), ignorenulls=True).alias(name(f)) for f in fuels]
    cells += [F.bool_or(moved).alias("rekeyed")] if moved else []
    cells += [F.min(clock.instant(start)).alias("start_time")] if start else []
    return rows.groupBy(*keys).agg(*cells)


def rekey(df: DataFrame, date: str, number: str, start: str, *, fuel: str | None = None, zone: str = clock.ZONE, most: float = 0.05) -> DataFrame:
    """Labels from each row's own start time where it has one, with ``moved``.

    The job fails at feeds in which more than a share ``most`` of the periods move, and at moved
    rows that land on a label another row has already.
    """
    t = clock.instant(start)
    own_d, own_n = clock.local_date(t, zone), clock.period(t, zone)
    differs = F.coalesce(t.isNotNull() & ((own_d != F.col(date)) | (own_n != F.col(number))), F.lit(False))
    out = df.withColumn("moved", differs).withColumn("_d", F.when(differs, own_d).otherwise(F.col(date))).withColumn("_n", F.when(differs, own_n).otherwise(F.col(number)))
    out = out.drop(date, number).withColumnsRenamed({"_d": date, "_n": number})
    share = out.groupBy(date, number).agg(F.bool_or("moved").alias("m")).agg(F.count("*").alias("_all"), F.count_if("m").alias("_moved"))
    w = Window.partitionBy(date, number, *([fuel] if fuel else []))
    out = holding(out.withColumn("_clash", F.bool_or("moved").over(w) & ~F.bool_and("moved").over(w)), F.col("_clash"), "moved rows meet rows that are there already").drop("_clash")
    told = F.concat(F.col("_moved").cast("string"), F.lit(" of "), F.col("_all").cast("string"), F.lit(" periods disagree with their start times"))
    return holding(out.crossJoin(F.broadcast(share)), F.col("_moved") > F.lit(most) * F.col("_all"), told).drop("_all", "_moved")


def quarantine(df: DataFrame, date: str, number: str, zone: str = clock.ZONE, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows with possible labels, and the others; the job of the first fails where the others are more than ``most``."""
    bad = ~F.coalesce(F.col(number).between(F.lit(1), clock.expected_periods(F.col(date), zone)), F.lit(False))
    n = df.agg(F.count_if(bad).alias("_bad"))
    kept = holding(df.filter(~bad).crossJoin(F.broadcast(n)), F.col("_bad") > most, f"more than {most} rows have impossible labels").drop("_bad")
    return kept, df.filter(bad)


def vintage_table(raw: DataFrame, date: str, number: str, recorded: Column | None, values: list[str], *, minute: int, lead_days: int, start: str | Column, end: str | Column, zone: str = clock.ZONE) -> DataFrame:
    """Canonical vintages: target time, label, resolved publication and values; unique in target and publication."""
    rows = assert_labels(restrict(raw, date, start, end), date, number, zone)
    pub = clock.resolve_publication(F.lit(None).cast("timestamp") if recorded is None else recorded, F.col(date), minute, lead_days, zone)
    out = rows.select(clock.from_label(F.col(date), F.col(number), zone).alias("target_time"), F.col(date).alias("settlement_date"), F.col(number).alias("settlement_period"), *(c.alias(k) for k, c in pub.items()), *values)
    return assert_unique(out, ["target_time", "published_at"], "vintages")


def split_outturn(df: DataFrame, keys: list[str], forecast: list[str], outturn: list[str]) -> tuple[DataFrame, DataFrame]:
    """Forecast and outturn columns as two tables, so that a feature query cannot see the second."""
    return df.select(*keys, *forecast), df.select(*keys, *outturn)


def on_grid(grid: DataFrame, data: DataFrame, keys: list[str]) -> DataFrame:
    """Every grid row with its data or nulls; refuses data that would repeat grid rows."""
    return grid.join(assert_unique(data, keys, "data"), keys, "left")


def outside_grid(data: DataFrame, grid: DataFrame, time: str) -> DataFrame:
    return data.join(grid, time, "left_anti")
