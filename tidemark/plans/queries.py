"""Queries over the driver's tables: each operator bound to a role the tables can play.

``events`` is the irregular feed (its half-hour means are the price series, its event types the
providers, its users the keys), ``orders`` the daily series. Times leave as zoneless UTC.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, rules
from ..operators import asof, audit, dispatch, features, forecast, reports, scoring, series, suspects
from ..sources import ingest
from ..sources.store import Store
from ..sources.tables import read_table

TYPES = ["click", "error", "purchase", "signup", "view"]
#: Power, hours, round-trip efficiency, least, greatest and first share of charge, and wear cost of each scenario.
SCENARIOS = [(1.0, 2.0, 0.9, 0.0, 1.0, 0.5, 0.0), (1.0, 2.0, 0.9, 0.0, 1.0, 0.5, 20.0), (1.0, 1.0, 0.8, 0.1, 0.9, 0.5, 0.0)]


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").withColumn("ts", clock.instant("ts"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").withColumn("o_orderdate", clock.instant("o_orderdate"))


def hundredths(column: str) -> Column:
    """Mean of a column cut to hundredths, in integers, so that no order of summing changes it."""
    cents = F.sum(F.round(F.col(column) * 100).cast("long"))
    return F.floor(cents / F.count(column)) / 100.0


def half_hours(spark: SparkSession, d: str) -> DataFrame:
    """Mean value, in whole hundredths, and count of events of each half hour that has any."""
    t = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800).alias("t")
    return events(spark, d).groupBy(t).agg(hundredths("value").alias("price"), F.count("*").cast("double").alias("volume")).withColumn("s", F.lit(0))


def gridded(spark: SparkSession, d: str) -> DataFrame:
    return series.regular_grid(half_hours(spark, d), ["s"], "t")


def stepped(spark: SparkSession, d: str) -> DataFrame:
    """The grid with values so coarse that runs occur."""
    return gridded(spark, d).withColumn("x", F.floor(F.col("price") / 100) * 100.0)


def daily_orders(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


def priced(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Half-hour targets with their decision, and the sources of features (public 90 minutes after their start)."""
    g = Store(spark, "priced").put(gridded(spark, d))
    px = features.price_sources(g.select(F.col("t").alias("start_time_utc"), F.col("price").alias("price_apx")), time="start_time_utc", price="price_apx")
    base = g.select(F.col("t").alias("target_time"), F.col("price").alias("actual"))
    base = base.withColumns({"settlement_date": clock.local_date(F.col("target_time")), "local_date": clock.local_date(F.col("target_time")), "minute_of_day": clock.minute_of_day(F.col("target_time"))})
    return clock.decision_table(base), px


def asof_purchase_view(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest strictly earlier view."""
    e = events(spark, d)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(left, e.filter("event_type = 'view'"), on=["user_id"], left_time="ts", right_time="ts", columns={"event_id": "view_id", "value": "view_value"}, tie=["event_id"])
    return out.drop("ts")


def asof_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """J1 with windows cut at days, for keys that hold much of the table."""
    e = events(spark, d)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = asof.asof_join(left, e.filter("event_type = 'view'"), on=["user_id"], left_time="ts", right_time="ts", columns={"event_id": "view_id", "value": "view_value"}, tie=["event_id"], bucket="day")
    return out.drop("ts")


def asof_latest_error(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the latest earlier error of anyone."""
    e = events(spark, d)
    out = asof.asof_join(e.filter("event_type = 'purchase'").select("event_id", "ts"), e.filter("event_type = 'error'"), left_time="ts", right_time="ts", columns={"event_id": "error_id"}, tie=["event_id"])
    return out.drop("ts")


def asof_tie_boundary(spark: SparkSession, d: str) -> DataFrame:
    """J1 strictness: each order with the customer's last order of an earlier day."""
    o = orders(spark, d)
    last = o.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("prev_key"))
    out = asof.asof_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), last, on=["o_custkey"], left_time="o_orderdate", right_time="o_orderdate", columns={"prev_key": "prev_key"}, tie=["prev_key"])
    return out.drop("o_orderdate")


def too_late_counts(spark: SparkSession, d: str) -> DataFrame:
    """Views at or after a purchase of the same user and day."""
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "day", F.col("ts").alias("pt"))
    right = e.filter("event_type = 'view'").select("user_id", "day", F.col("ts").alias("vt"))
    return asof.too_late(left, right, ["user_id", "day"], F.col("pt"), F.col("vt"), "event_id")


def grid_periods_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Half hours of each order date in London, counted on the grid."""
    days = orders(spark, d).select(F.to_date("o_orderdate").alias("settlement_date")).distinct()
    g = clock.grid_of(days).groupBy("settlement_date").agg(F.count("*").alias("n_periods"), F.max("settlement_period").alias("last_period"))
    return g.withColumn("expected", clock.expected_periods(F.col("settlement_date")))


def labels_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Instants to (date, period) and back."""
    t = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.pmod("o_orderkey", F.lit(48)) * 1800)
    o = orders(spark, d).select("o_orderkey", t.alias("t"))
    day, n = clock.local_date(F.col("t")), clock.period(F.col("t"))
    return o.select("o_orderkey", day.alias("settlement_date"), n.alias("settlement_period"), clock.plain(clock.from_label(day, n)).alias("back"))


def decision_times(spark: SparkSession, d: str) -> DataFrame:
    """The eve's 11:00 London time of each order date."""
    days = orders(spark, d).select(F.to_date("o_orderdate").alias("settlement_date")).distinct()
    return clock.assert_decided_before(clock.decision_table(days)).select("settlement_date", clock.plain("decision_time").alias("decision_time"))


def calendar_keys(spark: SparkSession, d: str) -> DataFrame:
    """Local keys of the series' half hours."""
    return clock.calendar_table(gridded(spark, d).select(F.col("t").alias("target_time"))).withColumn("target_time", clock.plain("target_time"))


def resolved_publication(spark: SparkSession, d: str) -> DataFrame:
    """An event's recorded time against the start of a target day one day later."""
    e = events(spark, d).withColumn("day", F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int") - 1))
    pub = clock.resolve_publication(F.col("ts"), F.col("day"), 9 * 60, 1)
    return e.select("event_id", clock.plain(pub["published_at"]).alias("published_at"), pub["published_at_source"].alias("published_at_source"), pub["published_at_suspect"].alias("published_at_suspect"))


def halfhour_series(spark: SparkSession, d: str) -> DataFrame:
    """The half-hour series on its complete grid."""
    return gridded(spark, d).select(clock.plain("t").alias("t"), "price", "volume")


def grid_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Length of the gap each half hour lies in."""
    g = series.gap_lengths(gridded(spark, d).withColumn("price", F.when(F.col("volume") >= 3, F.col("price"))), ["s"], "t", "price")
    return g.select(clock.plain("t").alias("t"), "gap")


def fill_short_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Fills gaps of at most two half hours."""
    g = series.fill_short_gaps(gridded(spark, d).withColumn("price", F.when(F.col("volume") >= 3, F.col("price"))), ["s"], "t", "price")
    return g.select(clock.plain("t").alias("t"), F.round("price", 6).alias("price"), "price_interpolated")


def stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    """Half hours in runs of at least two equal values."""
    g = series.stuck_runs(stepped(spark, d), ["s"], "t", "x", 2)
    return g.select(clock.plain("t").alias("t"), "stuck")


def zero_runs(spark: SparkSession, d: str) -> DataFrame:
    """Zeros in runs of at least two."""
    g = series.zero_runs(stepped(spark, d).withColumn("x", F.when(F.col("x") <= 100, 0.0).otherwise(F.col("x"))), ["s"], "t", "x", 2)
    return g.select(clock.plain("t").alias("t"), "zero_run")


def longest_run(spark: SparkSession, d: str) -> DataFrame:
    """W8."""
    return series.longest_run(stepped(spark, d), ["s"], "t", "x").select("longest_run")


def row_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Change into and out of each half hour."""
    return series.jumps(gridded(spark, d), ["s"], "t", "price").select(clock.plain("t").alias("t"), F.round("jump_in", 6).alias("jump_in"), F.round("jump_out", 6).alias("jump_out"))


def rolling_daily(spark: SparkSession, d: str) -> DataFrame:
    """Seven-day mean of daily order totals, and their running sum."""
    o = daily_orders(spark, d).withColumn("s", F.lit(0))
    o = series.cumulative(series.rolling_mean(o, ["s"], "day", "total"), ["s"], "day", "total")
    return o.select("day", F.round("rolling_mean", 4).alias("rolling_mean"), F.round("cumulative", 2).alias("cumulative"))


def default_vs_traded(spark: SparkSession, d: str) -> DataFrame:
    """Default prices, anomalies and the band."""
    g = gridded(spark, d).withColumn("p", F.when(F.col("price") < 150, 0.0).otherwise(F.col("price")))
    p, v = F.col("p"), F.col("volume")
    return g.select(clock.plain("t").alias("t"), rules.defaulted(p, v, 6).alias("defaulted"), rules.liquidity_anomaly(p, v, 6).alias("anomaly"), rules.out_of_band(p, 50, 400).alias("out_of_band"))


POLICY = series.CleaningPolicy(volumes={"price": "volume"}, bounds=(0.0, 450.0), stuck_run=2, liquidity=4.0)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    h = half_hours(spark, d).withColumn("price", F.when(F.col("price") < 150, 0.0).otherwise(F.floor(F.col("price") / 20) * 20.0))
    return series.clean_series(h, ["s"], "t", POLICY)


def clean_pass(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning pass."""
    c = cleaned(spark, d)
    return c.select(clock.plain("t").alias("t"), F.round("price", 6).alias("price"), "price_defaulted", "price_out_of_band", "price_stuck", "price_interpolated", "settlement_date", "settlement_period", "period_usable", "day_complete", "day_usable")


def day_usability(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return series.day_usability(cleaned(spark, d), []).select("settlement_date", "observed", "expected", "day_complete", "day_usable")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return series.quality_report(cleaned(spark, d), POLICY, half_hours(spark, d), ["s", "t"])


def by_type(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("ts").alias("day")
    return events(spark, d).groupBy(day, "event_type").agg(hundredths("value").alias("price"), F.count("*").cast("double").alias("volume"))


def pivot_types(spark: SparkSession, d: str) -> DataFrame:
    """A price and volume column of each event type."""
    return ingest.pivot_providers(by_type(spark, d), ["day"], "event_type", TYPES, "price", "volume")


def pivot_fuel_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each type a day, wide, whether a row of it was moved, and the first start time."""
    e = events(spark, d).withColumns({"day": F.to_date("ts"), "moved": F.pmod("event_id", F.lit(50)) == 0})
    wide = ingest.pivot_fuels(e.select("day", "event_type", "value", "ts", "moved"), ["day"], "event_type", TYPES, "value", "ts", "moved", "ts")
    return wide.withColumn("start_time", clock.plain("start_time"))


def vwap_types(spark: SparkSession, d: str) -> DataFrame:
    """Volume-weighted price of the types."""
    w = pivot_types(spark, d)
    p, v = rules.weighted_price([F.col(f"{t}_price") for t in TYPES], [F.col(f"{t}_volume") for t in TYPES])
    return w.select("day", F.round(p, 6).alias("vwap"), v.alias("volume"))


def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """Each user's latest event of a day."""
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    return series.latest_revision(e, ["user_id", "day"], "ts").select("user_id", "day", "event_id")


def first_event(spark: SparkSession, d: str) -> DataFrame:
    """Each user's first event of a day."""
    e = events(spark, d).select("user_id", F.to_date("ts").alias("day"), "ts", "event_id")
    return series.keep_first(e, ["user_id", "day"], ["ts"]).select("user_id", "day", "event_id")


def lag_same_time(spark: SparkSession, d: str) -> DataFrame:
    """The price of the same clock time two and seven days before."""
    base, px = priced(spark, d)
    out = features.lag_same_time(features.lag_same_time(base, px, 2, "d2"), px, 7, "d7")
    return out.select(clock.plain("target_time").alias("target_time"), "d2", "d7")


def lag_day_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of the day two days before."""
    base, px = priced(spark, d)
    out = features.lag_day(base, features.daily(px), 2, {"mean": "d2_mean", "spread": "d2_spread"})
    return out.select(clock.plain("target_time").alias("target_time"), F.round("d2_mean", 6).alias("d2_mean"), F.round("d2_spread", 6).alias("d2_spread"))


def trailing_7d(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the days D-8 to D-2."""
    base, px = priced(spark, d)
    days = base.select("local_date", "decision_time").distinct()
    out = features.trailing(days, px, 8, 2, [], "price", mean="mean", std="std", n="n")
    return out.select("local_date", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


def trailing_28d_bias(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the daily errors of D-29 to D-2, where the whole day is public."""
    base, px = priced(spark, d)
    days = base.select("local_date", "decision_time").distinct()
    err = features.daily(px).select("local_date", (F.col("mean") - 250.0).alias("err"), "available_at")
    out = features.trailing(days, err, 29, 2, [], "err", mean="bias", n="n")
    return out.select("local_date", F.round("bias", 6).alias("bias"), "n")


def last_known(spark: SparkSession, d: str) -> DataFrame:
    """J2 on decisions: the latest price that was public."""
    base, px = priced(spark, d)
    days = base.select("settlement_date", "decision_time").distinct()
    out = asof.asof_join(days, px, left_time="decision_time", right_time="available_at", columns={"price": "last_price", "source_time": "source_time"})
    return out.select("settlement_date", "last_price", clock.plain("source_time").alias("source_time"))


def forecasts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vintages of two forecasts, for half hours two days after they are published: views and clicks."""
    e = events(spark, d)
    target = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800 + 2 * 86400)
    columns = lambda kind, name: e.filter(F.col("event_type") == kind).select(target.alias("target_time"), F.col("ts").alias("published_at"), F.col("value").alias(name))
    return columns("view", "wind_forecast_mw"), columns("click", "demand_forecast_mw")


def market(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A point-in-time frame, prices and outturn made of the events: views stand for wind forecasts, clicks for demand.

    The half hours and the frame are stored: features and audit read them many times.
    """
    store = Store(spark, "market")
    g = store.put(gridded(spark, d))
    label = {"settlement_date": clock.local_date(F.col("target_time")), "settlement_period": clock.period(F.col("target_time"))}
    targets = clock.decision_table(g.select(F.col("t").alias("target_time")).withColumns(label))
    prices = g.select(F.col("t").alias("start_time_utc"), F.col("price").alias("price_apx"), (F.col("volume") < 2).alias("price_apx_interpolated"))
    views, clicks = forecasts(spark, d)
    own = prices.select(F.col("start_time_utc").alias("target_time"), "price_apx")
    pit = asof.point_in_time(targets, own, {"wind": (views, {"wind_forecast_mw": "wind_forecast_mw"}), "demand": (clicks, {"demand_forecast_mw": "demand_forecast_mw"})})
    pit = pit.withColumns({"wind_capacity_mw": F.lit(500.0), "wind_forecast_share": F.col("wind_forecast_mw") / 500.0, "period_usable": F.col("price_apx").isNotNull(), "day_usable": F.lit(True), "wind_suspect": F.lit(False)})
    pit = store.put(pit)
    outturn = g.select(F.col("t").alias("target_time"), F.col("price").alias("gen_wind_mw"))
    return pit, prices, outturn


def point_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts as they were known at each decision."""
    pit, _, _ = market(spark, d)
    return pit.select(clock.plain("target_time").alias("target_time"), "settlement_period", "price_apx", "wind_forecast_mw", clock.plain("wind_published_at").alias("wind_published_at"), "demand_forecast_mw")


def availability_check(spark: SparkSession, d: str) -> DataFrame:
    """No attached publication is at or after its decision."""
    pit, _, _ = market(spark, d)
    return asof.availability_check(pit, "decision_time", ["wind_published_at"]).select("wind_published_at_late", F.round("wind_published_at_margin_hours", 6).alias("margin_hours"))


def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    """The twenty features."""
    f = features.feature_frame(*market(spark, d))
    kinds = dict(f.dtypes)
    return f.select(clock.plain("target_time").alias("target_time"), *(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in features.REGISTER.features))


def availability_audit(spark: SparkSession, d: str) -> DataFrame:
    """The twenty features by a second route: mismatches and least margin of each."""
    pit, prices, outturn = market(spark, d)
    views, clicks = forecasts(spark, d)
    again = audit.recompute(pit, prices, outturn, vintages={"wind": (views, "wind_forecast_mw"), "demand": (clicks, "demand_forecast_mw")})
    frame = Store(spark, "audit").put(features.feature_frame(pit, prices, outturn))
    out = audit.compare(frame, again, list(features.REGISTER.features))
    return out.withColumn("least_margin_hours", F.round("least_margin_hours", 6))


def missing_shares(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    m = features.missing_shares(features.feature_frame(*market(spark, d)))
    return m.select("feature", F.round("missing_share", 6).alias("missing_share"), "first_day")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Targets with three naive forecasts and quantiles, stored: scores read them more than once."""
    base, px = priced(spark, d)
    out = features.lag_same_time(features.lag_same_time(base, px, 2, "lag_d2"), px, 7, "lag_d7")
    out = forecast.baselines(out, {"lag_d2": "naive_d2", "lag_d7": "naive_d7"})
    days = base.select("local_date", "decision_time").distinct()
    week = features.trailing(days, px.filter("first_occurrence"), 8, 2, ["minute_of_day"], "price", mean="mean_7d")
    out = out.join(week, ["local_date", "minute_of_day"], "left").withColumns({"q10": F.col("mean_7d") - 60.0, "q50": F.col("mean_7d"), "q90": F.col("mean_7d") + 60.0})
    return Store(spark, "scored").put(out)


NAIVE = ["naive_d2", "naive_d7", "mean_7d"]


def score_table(spark: SparkSession, d: str) -> DataFrame:
    """MAE, RMSE and skill of naive forecasts on one set of rows."""
    s = scoring.score_table(scored(spark, d), "actual", NAIVE, "naive_d7")
    return s.select("forecast", "n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "skill")))


def mae_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    s = scoring.mae_by_hour(scored(spark, d), "actual", NAIVE, F.col("minute_of_day"))
    return s.select("hour", *(F.round(f"mae_{c}", 6).alias(f"mae_{c}") for c in NAIVE))


def reliability(spark: SparkSession, d: str) -> DataFrame:
    """Share at or below each quantile, and pinball loss."""
    s = scoring.reliability(scored(spark, d), "actual", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return s.select("quantile", "nominal", F.round("observed_share", 6).alias("observed_share"), F.round("pinball", 6).alias("pinball"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Interval coverage."""
    s = scoring.interval_coverage(scored(spark, d), "actual", "q10", "q90")
    return s.select("n", F.round("coverage", 6).alias("coverage"), F.round("mean_width", 6).alias("mean_width"))


def skill_window(spark: SparkSession, d: str) -> DataFrame:
    """Error summary of the seven-day mean."""
    f = scored(spark, d).withColumn("settlement_period", clock.period(F.col("target_time")))
    s = scoring.skill_window(f, "settlement_date", "mean_7d", "actual", "settlement_period")
    return s.select("days", "periods", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "corr", "mae_early", "mae_late", "growth")))


def date_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of successive days with orders above the usual number."""
    o = daily_orders(spark, d)
    mean = o.agg(F.avg("n").alias("m"))
    busy = o.crossJoin(F.broadcast(mean)).filter("n > m").withColumn("s", F.lit(0))
    return series.date_runs(busy, "day", ["s"]).drop("s")


def season_window(spark: SparkSession, d: str) -> DataFrame:
    """Order totals of one season in any year."""
    o = daily_orders(spark, d).filter(rules.in_season(F.col("day"), (3, 15), (6, 10)))
    return o.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("days"), F.round(F.sum("total"), 2).alias("total"))


def block_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the share of totals of even days' orders, by circular blocks."""
    o = orders(spark, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("all_t"), F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(0.0)).alias("even_t"))
    s = scoring.bootstrap_capture(o, "day", "even_t", "all_t", replicates=2000)
    return s.select(*(F.round(c, 6).alias(c) for c in ("lo", "median", "hi")))


def block_ratio_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of two years' mean daily totals with its verdict."""
    o = daily_orders(spark, d)
    s = scoring.bootstrap_ratio(o.filter("year(day) = 1996"), o.filter("year(day) = 1997"), "day", "total", replicates=10_000)
    s = s.withColumn("verdict", scoring.verdict(F.col("lo"), F.col("hi")))
    return s.select(*(F.round(c, 6).alias(c) for c in ("lo", "median", "hi")), "verdict")


def trailing_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Means of the prior seven days' quartiles."""
    o = orders(spark, d).select(F.to_date("o_orderdate").alias("day"), F.lit(0).alias("s"), "o_totalprice")
    t = dispatch.trailing_thresholds(o, ["s"], "day", "o_totalprice")
    return t.select("day", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


def realisable_spread(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    h = half_hours(spark, d).withColumn("day", clock.local_date(F.col("t")))
    s = dispatch.realisable_spread(h, ["day"], "price", [2, 4, 8], 0.9)
    return s.select("day", "k", F.round("spread", 6).alias("spread"))


def day_prices(spark: SparkSession, d: str, columns: tuple[str, ...] = ("price",)) -> DataFrame:
    """Each local day's prices in order, gaps filled by the day's mean; whole days only."""
    g = gridded(spark, d).withColumn("settlement_date", clock.local_date(F.col("t")))
    mean = g.groupBy("settlement_date").agg(hundredths("price").alias("_mean"))
    g = g.join(mean, "settlement_date").withColumn("price", F.coalesce("price", "_mean"))
    a = dispatch.day_arrays(g, ["settlement_date"], "t", ["price"]).withColumnRenamed("price", "prices")
    return a.filter(F.size("prices") == clock.expected_periods(F.col("settlement_date")))


def scenario_table(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SCENARIOS)], "scenario int, " + ", ".join(f"{c} double" for c in dispatch.SCENARIO))
    return dispatch.scenarios(df)


def clocked(spark: SparkSession, d: str) -> DataFrame:
    """A fixed schedule: full charge in periods 1 to 4, discharge in the last four of a whole day."""
    days = dispatch.with_scenarios(day_prices(spark, d), scenario_table(spark))
    n = F.size("prices")
    mw = F.transform("prices", lambda p, i: F.when(i < 4, F.lit(0.5)).when(i >= n - 4, F.lit(-0.5) * F.col("round_trip")).otherwise(0.0))
    return days.withColumn("mw", mw)


KEYS = ["settlement_date", "scenario"]


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keys, *(((F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c)) for c in df.columns if c not in keys))


def settle_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Settlement of a fixed schedule."""
    return rounded(dispatch.settle(clocked(spark, d), KEYS), KEYS)


def feasibility(spark: SparkSession, d: str) -> DataFrame:
    """Broken limits of the fixed schedule under each scenario."""
    f = dispatch.feasibility(dispatch.trace(clocked(spark, d), KEYS), KEYS)
    return f.select(*KEYS, F.concat_ws("; ", "problems").alias("problems"))


def threshold_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The threshold rule on trailing quartiles, settled."""
    g = gridded(spark, d).withColumn("settlement_date", clock.local_date(F.col("t")))
    t = dispatch.trailing_thresholds(g.filter("price is not null"), ["s"], "settlement_date", "price").drop("s").filter("low is not null")
    days = dispatch.with_scenarios(day_prices(spark, d).join(t, "settlement_date"), scenario_table(spark))
    return rounded(dispatch.threshold_baseline(days, KEYS), KEYS)


def lattice_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """The best lattice schedule of each day and scenario."""
    days = dispatch.with_scenarios(day_prices(spark, d), scenario_table(spark))
    plan = dispatch.lattice_schedule(days, "prices", 5)
    s = dispatch.settle(plan, [*KEYS, "planned_value"])
    return rounded(s, KEYS)


def strategies(spark: SparkSession, d: str) -> DataFrame:
    g = day_prices(spark, d).select("settlement_date", F.col("prices").alias("actual"))
    back = lambda n, name: g.select(F.date_add("settlement_date", n).alias("settlement_date"), F.col("actual").alias(name))
    j = g.join(back(2, "naive_d2"), "settlement_date").join(back(7, "naive_d7"), "settlement_date")
    j = j.filter((F.size("naive_d2") == F.size("actual")) & (F.size("naive_d7") == F.size("actual")))
    return dispatch.with_scenarios(j, scenario_table(spark).filter("scenario = 0"))


def backtest_capture(spark: SparkSession, d: str) -> DataFrame:
    """Lag forecasts planned and settled, as shares of perfect foresight."""
    b = dispatch.backtest(strategies(spark, d), ["settlement_date"], ["naive_d2", "naive_d7"], steps_per_rate=5)
    return rounded(dispatch.capture(b, []), ["strategy"])


def scenario_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Annual figures of every scenario and what is kept of the first's."""
    days = dispatch.with_scenarios(day_prices(spark, d), scenario_table(spark))
    s = dispatch.annual_summary(dispatch.settle(dispatch.lattice_schedule(days, "prices", 5), KEYS), ["scenario"])
    return rounded(dispatch.frontier(s.withColumn("g", F.lit(0)), ["g"], "scenario", ["per_mw_year", "cycles_year"]).drop("g"), ["scenario"])


def rule_against_optimum(spark: SparkSession, d: str) -> DataFrame:
    """The fixed schedule's share of the lattice optimum."""
    rule = dispatch.settle(clocked(spark, d), KEYS)
    best = dispatch.settle(dispatch.lattice_schedule(dispatch.with_scenarios(day_prices(spark, d), scenario_table(spark)), "prices", 5), KEYS)
    return rounded(dispatch.rule_against_optimum(rule, best, KEYS, "net_revenue"), ["days"])


def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A29."""
    m = reports.monthly(daily_orders(spark, d), "day", [], ["total", "n"])
    return m.select("month", F.round("total", 2).alias("total"), "n")


def strategy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals by priority class, by year and overall."""
    o = orders(spark, d)
    day = o.groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    s = reports.strategy_rollup(day, "day", ["F", "O", "P"])
    return s.select("strategy", "year", F.round("revenue", 2).alias("revenue"), "days")


def strategy_table(spark: SparkSession, d: str) -> DataFrame:
    """Yearly figures and captures of the statuses' daily totals less a cost, on all days and without Sundays."""
    one = lambda k: F.col("o_orderstatus") == k
    cells = [F.sum("o_totalprice").alias("all_net"), F.count("*").alias("all_mwh")]
    for k in ("F", "O", "P"):
        cells += [(F.sum(F.when(one(k), F.col("o_totalprice")).otherwise(0.0)) - 150_000.0).alias(f"{k}_net"), F.count_if(one(k)).alias(f"{k}_mwh")]
    daily = Store(spark, "strategies").put(orders(spark, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(*cells))
    tables = [(p, reports.strategy_table(x, "day", ["F", "O", "P"], "all", power=2.0, energy=4.0)) for p, x in (("all", daily), ("clean", daily.filter("dayofweek(day) <> 1")))]
    out = tables[0][1].withColumn("period", F.lit("all")).unionByName(tables[1][1].withColumn("period", F.lit("clean")))
    return out.select("period", "strategy", "days", F.round("per_mw_year", 2).alias("per_mw_year"), F.round("cycles_year", 4).alias("cycles_year"), "loss_days", *(F.round(c, 6).alias(c) for c in ("capture", "ci_low", "ci_high")))


def outturn_report(spark: SparkSession, d: str) -> DataFrame:
    """Quality of a re-keyed outturn, of which some rows have no start time of their own."""
    nth = F.pmod(F.unix_timestamp("t") / 1800, F.lit(97))
    off = F.when(nth == 5, 1).when(nth == 6, -1).otherwise(0)
    feed = gridded(spark, d).select("s", F.when(nth != 7, F.col("t")).alias("own"), F.to_date(clock.local(F.col("t"))).alias("d"), (clock.period(F.col("t")) + off).cast("int").alias("n"), F.col("price").alias("gen_wind_mw"))
    wide = ingest.rekey(feed, "d", "n", "own").withColumn("start", clock.from_label(F.col("d"), F.col("n")))
    r = reports.outturn_quality(wide, ["s"], "start", ["gen_wind_mw"], "moved", "own", "gen_wind_mw")
    return r.select("check", F.round("value", 4).alias("value"))


def day_set_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Days of urgent and of low orders."""
    o = orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    return scoring.date_set_report(o.filter("o_totalprice > 300000"), o.filter("o_totalprice < 50000"), "day")


def provider_report(spark: SparkSession, d: str) -> DataFrame:
    """Quality of two providers."""
    r = reports.provider_quality(pivot_types(spark, d), {"click_price": "click_volume", "view_price": "view_volume"})
    return r.select("check", F.round("value", 4).alias("value"))


def provider_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two providers."""
    r = reports.compare_providers(pivot_types(spark, d), "click_price", "view_price", {"click_price": "click_volume", "view_price": "view_volume"})
    return r.select("check", F.round("value", 4).alias("value"))


def liquidity_report(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    g = gridded(spark, d).withColumn("price", F.when(F.col("price") < 150, 0.0).otherwise(F.col("price")))
    return reports.liquidity_audit(g, "price", "volume", 6)


def vintage_timeliness(spark: SparkSession, d: str) -> DataFrame:
    """Leads of views against the start of a later day."""
    e = events(spark, d).filter("event_type = 'view'").withColumn("day", F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int")))
    t = reports.timeliness(e, "day", "ts", clock.day_start(F.col("day")))
    return t.select("year", "rows", "late_or_missing", F.round("median_lead", 6).alias("median_lead"), F.round("min_lead", 6).alias("min_lead"))


def timezone_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Clock hours of stamps in winter and summer."""
    t = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.pmod("o_orderkey", F.lit(24)) * 3600)
    r = reports.timezone_evidence(orders(spark, d).withColumn("t", t), "t")
    return rounded(r, [])


def day_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many days have how many half hours."""
    return reports.coverage(half_hours(spark, d).withColumn("day", clock.local_date(F.col("t"))), "day")


def price_range(spark: SparkSession, d: str) -> DataFrame:
    """Daily ranges and their extremes."""
    return rounded(reports.daily_range(half_hours(spark, d), "t", "price"), [])


def rekeyed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of which a few disagree with their start times, put right; impossible ones set apart."""
    g = gridded(spark, d)
    n = clock.period(F.col("t"))
    # The labels of two neighbours are swapped now and then.
    nth = F.pmod(F.unix_timestamp("t") / 1800, F.lit(97))
    off = F.when(nth == 5, 1).when(nth == 6, -1).otherwise(0)
    feed = g.select("t", F.to_date(clock.local(F.col("t"))).alias("d"), (n + off).cast("int").alias("n"))
    kept, _ = ingest.quarantine(ingest.rekey(feed, "d", "n", "t"), "d", "n")
    return kept.select(clock.plain("t").alias("t"), F.col("d").alias("settlement_date"), F.col("n").alias("settlement_period"), "moved")


def walk_forward_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of daily order counts for every month that has earlier days, all folds trained at once."""
    o = daily_orders(spark, d)
    w = Window.partitionBy(F.year("day")).orderBy("day")
    f = Store(spark, "walk").put(o.select("day", F.col("n").cast("double").alias("y"), F.weekday("day").alias("dow"), F.lag("n", 7).over(w).alias("l7"), F.avg("n").over(w.rowsBetween(-14, -2)).alias("m14")))
    first, last = f.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return f.withColumns({"fold": F.col("day"), **dict.fromkeys(("q10", "q50", "q90"), F.col("y"))}).select("day", "fold", "y", "q10", "q50", "q90")
    folds = forecast.monthly_folds(spark, str(first + dt.timedelta(40)), str(last))
    q = forecast.walk_forward_quantiles(f, folds, forecast.select_features(["dow", "l7", "m14"]), date="day", target="y", anchor="m14", levels={"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return q.select("day", "fold", "y", "q10", "q50", "q90")


def range_window(spark: SparkSession, d: str) -> DataFrame:
    """Mean total of the calendar days eight to two before each day with orders."""
    o = series.trailing_days(daily_orders(spark, d).withColumn("s", F.lit(0)), ["s"], "day", "total", 8, 2)
    return o.select("day", F.round("trailing_mean", 4).alias("trailing_mean"))


def lead_summary(spark: SparkSession, d: str) -> DataFrame:
    """How long before their half hour views and clicks were published."""
    e = events(spark, d).filter("event_type in ('view', 'click')")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800 + 2 * 86400 + F.pmod("event_id", F.lit(5)) * 3600)
    r = reports.lead_summary(e.withColumns({"start": start, "odd": F.pmod("event_id", F.lit(2)) == 1}), "event_type", "start", "ts", "odd")
    return r.select("event_type", "rows", *(F.round(c, 6).alias(c) for c in ("min_lead", "median_lead", "max_lead")), "suspect")


def worst_days(spark: SparkSession, d: str) -> DataFrame:
    """The ten days with most default prices."""
    g = gridded(spark, d).withColumn("price", F.when(F.col("price") < 150, 0.0).otherwise(F.col("price")))
    return reports.affected_days(g, clock.local_date(F.col("t")), "price", "volume", 6)


def vintage_build(spark: SparkSession, d: str) -> DataFrame:
    """Canonical vintages of a raw feed: renamed, restricted, labelled, with resolved publications."""
    e = events(spark, d).filter("event_type = 'view'")
    target = F.timestamp_seconds(F.unix_timestamp("ts") + F.pmod("event_id", F.lit(4)) * 43200)
    raw = e.select(clock.local_date(target).alias("Date"), clock.period(target).alias("Settlement_period"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Stamp"), F.col("value").cast("string").alias("Forecast"), "event_id")
    feed = ingest.canonical(raw, {"Date": "day", "Settlement_period": "n", "Stamp": "stamp", "Forecast": "forecast", "event_id": "event_id"}, numeric=["forecast"])
    ends = feed.agg(F.date_add(F.min("day"), 1).alias("first"), F.date_sub(F.max("day"), 1).alias("last"))
    # The latest of equal publications, as stamps that come after the day's start are all resolved to one instant.
    feed = feed.withColumn("at", clock.resolve_publication(clock.lenient(F.col("stamp")), F.col("day"), 540, 1)["published_at"])
    feed = series.latest_revision(feed, ["day", "n", "at"], "event_id")
    v = ingest.vintage_table(feed.crossJoin(F.broadcast(ends)), "day", "n", clock.lenient(F.col("stamp")), ["forecast"], minute=540, lead_days=1, start=F.col("first"), end=F.col("last"))
    return v.select(clock.plain("target_time").alias("target_time"), "settlement_date", "settlement_period", clock.plain("published_at").alias("published_at"), "published_at_source", "published_at_suspect", "forecast")


def outside_grid(spark: SparkSession, d: str) -> DataFrame:
    """events' half hours that the grid of the first ten days does not hold."""
    h = half_hours(spark, d)
    first = h.agg(F.min(clock.local_date(F.col("t"))).alias("a"))
    days = first.select(F.explode(F.sequence("a", F.date_add("a", 9))).alias("settlement_date"))
    out = ingest.outside_grid(h, clock.grid_of(days).select(F.col("target_time").alias("t")), "t")
    return out.select(clock.plain("t").alias("t"), "price")


def grid_with_data(spark: SparkSession, d: str) -> DataFrame:
    """Every half hour of the events' days with the forecast part of its data."""
    h = half_hours(spark, d)
    days = h.select(clock.local_date(F.col("t")).alias("settlement_date")).distinct()
    forecast, _ = ingest.split_outturn(h.withColumnRenamed("t", "target_time"), ["target_time"], ["volume"], ["price"])
    return ingest.on_grid(clock.grid_of(days), forecast, ["target_time"]).select(clock.plain("target_time").alias("target_time"), "settlement_date", "settlement_period", "volume")


def skill_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the share of daily totals that even days' orders leave."""
    o = orders(spark, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("all_t"), F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(0.0)).alias("even_t"))
    return rounded(scoring.bootstrap_skill(o, "day", "even_t", "all_t", replicates=2000), [])


def paired_capture(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the paired difference of two statuses' shares of daily totals."""
    part = lambda k: F.sum(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice")).otherwise(0.0))
    o = orders(spark, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("all_t"), part("O").alias("o_t"), part("F").alias("f_t"))
    return rounded(scoring.bootstrap_capture(o, "day", "o_t", "all_t", "f_t", replicates=2000), [])


def matched_days(spark: SparkSession, d: str) -> DataFrame:
    """Days whose half hours all have a target and every naive forecast."""
    f = scored(spark, d).withColumn("usable", F.col("actual").isNotNull())
    return dispatch.matched_days(f, "settlement_date", clock.expected_periods(F.col("settlement_date")), "usable", ["naive_d2", "mean_7d"])


def described_events(spark: SparkSession, d: str) -> DataFrame:
    """A36, IO11: columns of the cleaned series with their types, rows, nulls and extremes."""
    return reports.describe_table(clean_pass(spark, d))


AUDITED = suspects.SuspectColumns(date="day", period="period")


def audited(spark: SparkSession, d: str) -> DataFrame:
    """Orders by day and slot as outturn, the day's mean as a forecast that some slots lack; busy days are suspect."""
    o = orders(spark, d).select(F.to_date("o_orderdate").alias("day"), (F.pmod("o_orderkey", F.lit(48)) + 1).cast("int").alias("period"), "o_totalprice")
    days = o.groupBy("day").agg(hundredths("o_totalprice").alias("forecast"), F.count("*").alias("n"))
    days = days.crossJoin(F.broadcast(days.agg(F.avg("n").alias("usual"))))
    rows = o.groupBy("day", "period").agg(hundredths("o_totalprice").alias("actual")).join(days, "day")
    own = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + (F.col("period") - 1) * 1800)
    return rows.select(
        "day", "period", "actual", F.when(F.col("period") % 11 != 0, F.col("forecast")).alias("forecast"), F.lit(500_000.0).alias("capacity"), (F.col("n") > F.col("usual")).alias("suspect"),
        own.alias("own_start"), clock.from_label(F.col("day"), F.col("period")).alias("label_start"),
    )


def suspect_block(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of suspect days of 1996, with the agreement of two start columns and what is dropped."""
    return suspects.starts_agree(audited(spark, d), AUDITED, 1996, "own_start", "label_start")


def suspect_block_windows(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the block, of its season in control years, and of the year outside it."""
    w = suspects.block_windows(audited(spark, d), AUDITED, 1996, [1995, 1997])
    return w.select("window", "days", "periods", *((F.round(c, 6) + 0.0).alias(c) for c in ("mae", "rmse", "bias", "corr", "mae_early", "mae_late", "growth")))


def suspect_block_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of daily errors of block and controls, and of one control to the other, with intervals and the verdict."""
    r = suspects.block_ratios(audited(spark, d), AUDITED, 1996, [1995, 1997], replicates=2000)
    return r.select("pair", *(F.round(c, 6).alias(c) for c in ("ratio", "lo", "hi")), "verdict")


def shared_days(spark: SparkSession, d: str) -> DataFrame:
    """Totals of large and of small orders on the days that have both, and whether only the first day is not shared."""
    o = orders(spark, d).withColumn("day", F.to_date("o_orderdate"))
    large, small = o.filter("o_totalprice > 200000"), o.filter("o_totalprice < 100000")
    a, b = suspects.shared_days(large, small, "day")
    total = lambda x, name: x.agg(F.countDistinct("day").alias(f"{name}_days"), F.round(F.sum("o_totalprice"), 2).alias(f"{name}_total"))
    claim = suspects.only_the_first(large, small, "day")
    return total(a, "large").crossJoin(total(b, "small")).crossJoin(claim)


def spread_summary(spark: SparkSession, d: str) -> DataFrame:
    """Realisable spreads by k, summed up over days."""
    h = half_hours(spark, d).withColumn("day", clock.local_date(F.col("t")))
    return rounded(dispatch.spread_summary(h, ["day"], "price", [2, 4, 8], 0.9), ["k"])


def single_day(spark: SparkSession, d: str) -> DataFrame:
    """The half hours of one day, which must be whole and priced."""
    g = day_prices(spark, d).select("settlement_date", F.posexplode("prices").alias("i", "price")).withColumn("day_usable", F.lit(True))
    return dispatch.one_day(g, "settlement_date", "2024-01-10", "price").select("settlement_date", "i", "price")


def scenario_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of the fixed schedule by duration (rows) and efficiency (columns)."""
    s = dispatch.settle(clocked(spark, d), [*KEYS, "duration_h", "round_trip"])
    s = s.groupBy("duration_h", "round_trip").agg(F.round(F.sum("gross_revenue"), 4).alias("revenue"))
    p = reports.scenario_pivot(s, "duration_h", "round_trip", "revenue", [0.8, 0.9])
    return p.select("duration_h", F.col("`0.8`").alias("at_80"), F.col("`0.9`").alias("at_90"))


QUERIES = {
    f.__name__: f
    for f in (
        asof_purchase_view, asof_bucketed, asof_latest_error, asof_tie_boundary, too_late_counts, grid_periods_per_day, labels_roundtrip, decision_times, calendar_keys, resolved_publication,
        halfhour_series, grid_gaps, fill_short_gaps, stuck_runs, zero_runs, longest_run, row_jumps, rolling_daily, default_vs_traded, clean_pass, day_usability, quality_report, pivot_types,
        pivot_fuel_revisions, vwap_types, latest_revision, first_event, lag_same_time, lag_day_stats, trailing_7d, trailing_28d_bias, last_known, point_in_time, availability_check, feature_frame,
        availability_audit, missing_shares, score_table, mae_by_hour, reliability, coverage, skill_window, date_islands, season_window, block_bootstrap_ci, block_ratio_verdict, trailing_thresholds,
        realisable_spread, settle_schedule, feasibility, threshold_dispatch, lattice_dispatch, backtest_capture, scenario_frontier, rule_against_optimum, monthly_rollup, strategy_rollup,
        day_set_reconcile, provider_report, provider_comparison, liquidity_report, vintage_timeliness, timezone_evidence, day_coverage, price_range, rekeyed_labels, walk_forward_quantiles,
        range_window, lead_summary, worst_days, vintage_build, outside_grid, grid_with_data, skill_interval, paired_capture, matched_days, described_events,
        strategy_table, outturn_report, suspect_block, suspect_block_windows, suspect_block_ratios, shared_days, spread_summary, single_day, scenario_pivot,
    )
}
