"""Look-ahead audit: every feature once more by another route, compared with the frame.

Where the frame uses equi joins on shifted keys, the audit joins each target's allowed source rows
and takes conditional aggregates; a leak in one route is a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, rules


#: Which margin tells how long before the decision a feature's sources were public; calendar features have no source.
MARGINS = {"f_price": "margin_price", "f_last": "margin_last", "f_wind_err": "margin_error", "f_wind_bias": "margin_error", "f_wind_forecast": "margin_wind", "f_demand": "margin_demand", "f_residual": "margin_both"}


def recompute(pit: DataFrame, prices: DataFrame, outturn: DataFrame, *, price: str = "price_apx", lag_minutes: int = 60, zone: str = clock.ZONE, vintages: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """The features of each target from one pass over its allowed sources, with the margins of ``MARGINS`` in hours.

    ``vintages`` maps ``wind`` and ``demand`` to their tables (``target_time``, ``published_at``)
    and value columns; without them forecasts are those attached to ``pit`` and have no margin.
    """
    t = F.col("target_time")
    src = prices.filter(F.col(price).isNotNull() & ~F.coalesce(F.col(f"{price}_interpolated"), F.lit(False)))
    s = clock.instant("start_time_utc")
    src = src.select(clock.local_date(s, zone).alias("sd"), clock.minute_of_day(s, zone).alias("sm"), clock.first_pass(s, zone).alias("first"), rules.available_at(s, lag_minutes).alias("av"), F.col(price).alias("x"))
    days = pit.select(clock.local_date(t, zone).alias("local_date"), "decision_time").distinct()
    asked = days.select("*", F.explode(F.array(*(F.lit(n) for n in range(2, 9)))).alias("back")).withColumn("sd", F.date_sub("local_date", F.col("back")))
    j = asked.join(src, "sd")
    ok = F.col("av") < F.col("decision_time")
    late = F.bool_or(~ok & (F.col("back") == 2))
    d2 = F.when(ok & (F.col("back") == 2), F.col("x"))
    day = j.groupBy("local_date", "decision_time").agg(
        F.avg(F.when(ok, F.col("x"))).alias("f_price_7d_mean"),
        F.stddev_samp(F.when(ok, F.col("x"))).alias("f_price_7d_std"),
        F.when(~late, F.avg(d2)).alias("f_price_d2_mean"),
        F.when(~late, F.max(d2) - F.min(d2)).alias("f_price_d2_spread"),
        F.min(F.when(ok, _hours("decision_time", "av"))).alias("margin_price"),
    )
    good = ok & F.col("first")
    clock_time = j.groupBy("local_date", "decision_time", F.col("sm").alias("minute_of_day")).agg(
        F.max(F.when(good & (F.col("back") == 2), F.col("x"))).alias("f_price_d2_same_time"),
        F.max(F.when(good & (F.col("back") == 7), F.col("x"))).alias("f_price_d7_same_time"),
        F.avg(F.when(good, F.col("x"))).alias("f_price_7d_same_time_mean"),
    )
    # The latest price: the largest available instant before the decision, of its day or of any day before, a running maximum over days.
    per_day = src.groupBy(F.to_date("av").alias("ad")).agg(F.max_by("x", "av").alias("x"), F.max("av").alias("av"))
    dec = days.select("decision_time").distinct()
    same = dec.join(src, F.to_date("decision_time") == F.to_date("av")).filter("av < decision_time").groupBy("decision_time").agg(F.max(F.struct("av", "x")).alias("s0"))
    both = per_day.select("ad", F.struct("av", "x").alias("s")).unionByName(dec.select(F.to_date("decision_time").alias("ad")), allowMissingColumns=True)
    earlier = Window.orderBy(F.unix_date("ad")).rangeBetween(Window.unboundedPreceding, -1)
    before = both.groupBy("ad").agg(F.max("s").alias("s")).select("ad", F.max("s").over(earlier).alias("s1"))
    last = dec.withColumn("ad", F.to_date("decision_time")).join(same, "decision_time", "left").join(before, "ad", "left").withColumn("s", F.coalesce("s0", "s1"))
    last = last.select("decision_time", F.col("s.x").alias("f_last_known_price"), _hours("decision_time", "s.av").alias("margin_last"))
    err = pit.filter("wind_forecast_mw is not null").join(outturn.filter("gen_wind_mw is not null"), "target_time")
    err = err.withColumn("e", rules.guarded_ratio(F.col("wind_forecast_mw") - F.col("gen_wind_mw"), F.col("wind_capacity_mw")))
    err = err.select(clock.local_date(t, zone).alias("sd"), "e", rules.available_at(t, lag_minutes).alias("av"))
    far = days.select("*", F.explode(F.sequence(F.lit(2), F.lit(29))).alias("back")).withColumn("sd", F.date_sub("local_date", F.col("back")))
    whole = far.join(err, "sd").groupBy("local_date", "decision_time", "back").agg(F.avg("e").alias("e"), F.max("av").alias("av")).filter("av < decision_time")
    wind = whole.groupBy("local_date", "decision_time").agg(F.max(F.when(F.col("back") == 2, F.col("e"))).alias("f_wind_err_d2"), F.avg("e").alias("f_wind_bias_28d"), F.min(_hours("decision_time", "av")).alias("margin_error"))
    keys = ["local_date", "decision_time"]
    local = clock.local(t, zone)
    number = lambda pattern: F.date_format(local, pattern).cast("int")
    out = pit.select("target_time", "decision_time", clock.local_date(t, zone).alias("local_date"), (number("H") * 60 + number("m")).alias("minute_of_day"), "settlement_period", "wind_forecast_mw", "wind_forecast_share", "demand_forecast_mw")
    out = out.withColumns({"f_settlement_period": F.col("settlement_period"), "f_minute_of_day": F.col("minute_of_day"), "f_day_of_week": (F.dayofweek(local) + 5) % 7, "f_is_weekend": F.dayofweek(local).isin(1, 7).cast("int"), "f_month": number("M")})
    none = F.lit(None).cast("double")
    margins = {"wind": none, "demand": none}
    for name, (table, value) in (vintages or {}).items():
        seen = pit.select("target_time", "decision_time").join(table.select("target_time", "published_at", F.col(value).alias("x")), "target_time").filter("published_at < decision_time")
        seen = seen.groupBy("target_time").agg(F.max_by("x", "published_at").alias(f"_{name}"), F.min(_hours("decision_time", "published_at")).alias(f"_{name}_margin"))
        out = out.join(seen, "target_time", "left").withColumn(f"{name}_forecast_mw", F.col(f"_{name}"))
        margins[name] = F.col(f"_{name}_margin")
    out = out.withColumns({"f_wind_forecast_mw": F.col("wind_forecast_mw"), "f_wind_forecast_share": F.col("wind_forecast_share"), "f_demand_forecast_mw": F.col("demand_forecast_mw"), "f_residual_demand_mw": -F.col("wind_forecast_mw") + F.col("demand_forecast_mw")})
    out = out.withColumns({"margin_wind": margins["wind"], "margin_demand": margins["demand"], "margin_both": F.least(margins["wind"], margins["demand"])})
    out = out.join(day, keys, "left").join(clock_time, [*keys, "minute_of_day"], "left").join(last, "decision_time", "left").join(wind, keys, "left")
    return out.withColumn("f_wind_err_d2_demeaned", F.col("f_wind_err_d2") - F.col("f_wind_bias_28d"))


def _hours(later: str, earlier: str) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600


def compare(frame: DataFrame, again: DataFrame, features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Per feature: rows, rows that differ (null against value counts), the least margin, and the verdict.

    A feature passes if no row differs and its sources were public strictly before every decision.
    """
    margin = {f: next((m for prefix, m in MARGINS.items() if f.startswith(prefix)), None) for f in features}
    used = sorted({m for m in margin.values() if m})
    b = again.select("target_time", *used, *(F.col(f).alias(f"_{f}") for f in features))
    j = frame.join(b, "target_time", "left")
    differ = [F.count_if(~F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f))), F.col(f).isNull() & F.col(f"_{f}").isNull())).alias(f) for f in features]
    one = j.agg(F.count("*").alias("rows"), *differ, *(F.min(m).alias(m) for m in used))
    names = F.create_map(*(x for f in features for x in (F.lit(f), F.col(margin[f]) if margin[f] else F.lit(None).cast("double"))))
    out = one.withColumn("_m", names).unpivot(["rows", "_m"], features, "feature", "mismatches").withColumn("least_margin_hours", F.col("_m")[F.col("feature")]).drop("_m")
    good = (F.col("mismatches") == 0) & F.coalesce(F.col("least_margin_hours") > 0, F.lit(True))
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))
