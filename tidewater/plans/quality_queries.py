"""Cleaning, quality reports, features: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import candles, describe, quality
from tidewater.operators.ordering import prefix_sum
from tidewater.plans import inputs as I
from tidewater.registry import register


@register("clean_dedup", "SELECT epoch_us(m) // 1000000 AS minute, event_id, value FROM (SELECT date_trunc('minute', ts) AS m, event_id, value, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id) AS k FROM events) WHERE k = 1")
def clean_dedup(spark, sf):
    e = I.events(spark, sf).select(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("minute"), "event_id", "value")
    return candles.keep_first(e, ["minute"], ["event_id"])


@register("bars_5m_ohlc", f"WITH {I.BARS} SELECT idx, bar, open, high, low, close, round(volume, 6) AS volume, trades, round(taker_buy_quote, 6) AS taker_buy_quote FROM bars")
def bars_5m_ohlc(spark, sf):
    return I.rounded(I.bars(spark, sf).drop("open_time"), volume=6, taker_buy_quote=6)


_DIFFS = f"WITH {I.BARS}, g AS (SELECT lag(bar) OVER (ORDER BY bar) AS prev_bar, bar AS next_bar, bar - lag(bar) OVER (ORDER BY bar) AS seconds FROM bars) "


@register("gap_table", _DIFFS + "SELECT prev_bar, next_bar, seconds, seconds // 300 - 1 AS missing FROM g WHERE seconds > 300")
def gap_table(spark, sf):
    g = quality.gaps(I.bars(spark, sf))
    return g.select(F.unix_seconds("prev_time").alias("prev_bar"), F.unix_seconds("next_time").alias("next_bar"), "seconds", "missing")


@register("diff_histogram", _DIFFS + "SELECT seconds, count(*) AS n FROM g WHERE seconds IS NOT NULL GROUP BY 1")
def diff_histogram(spark, sf):
    return quality.diff_histogram(I.bars(spark, sf))


@register("modal_diff", _DIFFS + "SELECT seconds, count(*) AS n FROM g WHERE seconds IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def modal_diff(spark, sf):
    return quality.modal_diff(I.bars(spark, sf))


@register("regularity", _DIFFS + "SELECT round(avg(seconds), 6) AS mean_seconds, median(seconds) AS median_seconds, count(*) FILTER (seconds <> 300) AS odd_steps, count(*) FILTER (seconds <> 300) = 0 AS regular FROM g WHERE seconds IS NOT NULL")
def regularity(spark, sf):
    return I.rounded(quality.regularity(I.bars(spark, sf)), mean_seconds=6)


@register("duplicate_times", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS repeated_keys FROM (SELECT count(*) AS n FROM events GROUP BY date_trunc('minute', ts))")
def duplicate_times(spark, sf):
    return quality.duplicates(I.events(spark, sf).select(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("open_time")))


@register("expected_rows", f"WITH {I.BARS} SELECT count(*) AS rows, min(bar) AS first_bar, max(bar) AS last_bar, (max(bar) - min(bar)) // 300 + 1 AS expected, (max(bar) - min(bar)) // 300 + 1 - count(*) AS missing FROM bars")
def expected_rows(spark, sf):
    r = quality.expected_rows(I.bars(spark, sf))
    return r.select("rows", F.unix_seconds("first_time").alias("first_bar"), F.unix_seconds("last_time").alias("last_bar"), "expected", "missing")


@register(
    "quality_report",
    _DIFFS + """, c AS (SELECT count(*) AS n, count(*) FILTER (high < low) + count(*) FILTER (open < low OR open > high) + count(*) FILTER (close < low OR close > high) AS bad,
      (max(bar) - min(bar)) // 300 + 1 - count(*) AS missing, """ + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ["open", "high", "low", "close", "volume", "trades", "taker_buy_quote"])
    + ", " + ", ".join(f"count(*) FILTER ({c} <= 0) AS np_{c}" for c in ["open", "high", "low", "close", "volume", "trades"])
    + """, count(*) FILTER (taker_buy_quote < 0) AS neg FROM bars), h AS (SELECT count(*) FILTER (seconds > 300) AS gaps, coalesce(max(seconds // 300 - 1) FILTER (seconds > 300), 0) AS longest FROM g),
      l AS (SELECT 'rows' AS check_name, n AS value, n > 0 AS passed FROM c """
    + "".join(f"UNION ALL SELECT '{name}', {expr}, {expr} = 0 FROM {src} " for name, expr, src in [
        ("null_open_time", "0", "c"), *[(f"null_{c}", f"null_{c}", "c") for c in ["open", "high", "low", "close", "volume", "trades", "taker_buy_quote"]],
        *[(f"not_positive_{c}", f"np_{c}", "c") for c in ["open", "high", "low", "close", "volume", "trades"]], ("negative_taker_buy_quote", "neg", "c"),
        ("ohlc_inconsistent", "bad", "c"), ("duplicates", "0", "c"), ("missing", "missing", "c"), ("gaps", "gaps", "h"), ("longest_gap", "longest", "h")])
    + ") SELECT check_name, CAST(value AS DOUBLE) AS value, passed FROM l",
)
def quality_report(spark, sf):
    return quality.report(I.bars(spark, sf))


@register(
    "numeric_checks",
    "WITH t AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 = 0 THEN ' ' ELSE CAST(event_id % 5 - 1 AS VARCHAR) END AS v FROM events) "
    "SELECT c AS column_name, count(*) FILTER (trim(v) = '') AS nulls, count(*) FILTER (trim(v) <> '' AND try_cast(v AS DECIMAL(38, 18)) IS NULL) AS parse_errors, "
    "count(*) FILTER (trim(v) <> '' AND try_cast(v AS DECIMAL(38, 18)) <= 0) AS not_positive FROM t, (SELECT unnest(['open', 'high', 'low', 'close', 'volume', 'trades', 'taker_buy_quote']) AS c) GROUP BY 1",
)
def numeric_checks(spark, sf):
    e = F.col("event_id")
    v = F.when(e % 97 == 0, "n/a").when(e % 89 == 0, " ").otherwise((e % 5 - 1).cast("string"))
    return quality.numeric_checks(I.events(spark, sf).select(*[v.alias(c) for c in candles.CANDLE_COLUMNS if c != "open_time"]))


@register("null_share", "SELECT 'value' AS column_name, round(100.0 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_percent FROM events UNION ALL SELECT 'maybe', round(100.0 * avg(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM events")
def null_share(spark, sf):
    e = I.events(spark, sf).withColumn("maybe", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return I.rounded(quality.null_share(e, ["value", "maybe"]), null_percent=6)


@register("out_of_order", "SELECT count(*) FILTER (v <= p) AS not_after FROM (SELECT value AS v, lag(value) OVER (ORDER BY event_id) AS p FROM events)")
def out_of_order(spark, sf):
    return quality.out_of_order(I.events(spark, sf), "value", "event_id")


@register(
    "epoch_units",
    "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3",
)
def epoch_units(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 4 == 0, F.floor(us / 1000).cast("string")).when(F.col("event_id") % 4 == 1, us.cast("string")).when(F.col("event_id") % 4 == 2, (us * 1000).cast("string")).otherwise("bad")
    return I.events(spark, sf).select("event_id", F.unix_seconds(S.epoch_to_timestamp(raw)).alias("seconds"))


_RV = [f"rv_past_{n}" for n in (12, 48, 288)] + [f"rv_future_{n}" for n in (12, 48)]


@register(
    "rv_features",
    f"WITH {I.FEATURES} SELECT idx, bar, round(r, 9) AS r, round(r2, 9) AS r2, round(abs(r), 9) AS abs_r, round(hl_range, 9) AS hl_range, round(log_volume, 9) AS log_volume, round(log_trades, 9) AS log_trades, "
    + ", ".join(f"round({c}, 6) AS {c}, round(ln({c} + 1e-12), 6) AS log_{c}" for c in _RV) + " FROM f",
)
def rv_features(spark, sf):
    f = candles.features(I.bars(spark, sf))
    out = I.rounded(f, r=9, r2=9, abs_r=9, hl_range=9, log_volume=9, log_trades=9, **{c: 6 for c in _RV}, **{f"log_{c}": 6 for c in _RV})
    return out.select("idx", "bar", "r", "r2", "abs_r", "hl_range", "log_volume", "log_trades", *_RV, *[f"log_{c}" for c in _RV])


@register(
    "features_shape",
    f"WITH {I.FEATURES}, k AS (SELECT * FROM f WHERE r IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in _RV) + ") SELECT (SELECT count(*) FROM f) AS rows_in, count(*) AS rows_out, min(idx) AS first_idx, max(idx) AS last_idx, min(bar) AS first_bar, max(bar) AS last_bar, min(idx) AS dropped_start, (SELECT count(*) FROM f) - 1 - max(idx) AS dropped_end FROM k",
)
def features_shape(spark, sf):
    b = I.bars(spark, sf)
    kept = candles.complete(candles.features(b)).agg(F.count("*").alias("rows_out"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))
    out = kept.crossJoin(F.broadcast(b.agg(F.count("*").alias("rows_in"))))  # one row
    return out.withColumns({"dropped_start": F.col("first_idx"), "dropped_end": F.col("rows_in") - 1 - F.col("last_idx")})


@register("zero_rv", f"WITH {I.FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} <= 0) AS not_positive FROM f" for c in _RV))
def zero_rv(spark, sf):
    return quality.zero_windows(candles.features(I.bars(spark, sf)), _RV)


@register("feature_ranges", f"WITH {I.FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM f" for c in ["r", *_RV]))
def feature_ranges(spark, sf):
    return I.rounded(describe.ranges(candles.features(I.bars(spark, sf)), ["r", *_RV]), min=6, max=6)


_DESCRIBE = """count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, max(x) AS max,
  """ + ", ".join(f"round(quantile_cont(x, {p}), 6) AS {n}" for n, p in describe.PERCENTILES.items()) + """,
  round(CASE WHEN var_pop(x) = 0 THEN 0 ELSE avg((x - m) ** 3) / var_pop(x) ** 1.5 END, 6) AS skewness,
  round(CASE WHEN var_pop(x) = 0 THEN 0 ELSE avg((x - m) ** 4) / var_pop(x) ** 2 - 3 END, 6) AS kurtosis_excess"""
_SIX = {c: 6 for c in ["mean", "std", *describe.PERCENTILES, "skewness", "kurtosis_excess"]}


@register("describe", f"WITH {I.SERIES}, c AS (SELECT *, avg(x) OVER () AS m FROM s) SELECT {_DESCRIBE}, (SELECT min(idx) FROM s WHERE x = (SELECT min(x) FROM s)) AS min_at, (SELECT min(idx) FROM s WHERE x = (SELECT max(x) FROM s)) AS max_at FROM c")
def describe_(spark, sf):
    return I.rounded(describe.describe(I.series(spark, sf), "x", at="idx"), **_SIX)


@register("describe_by_type", f"WITH {I.SERIES}, c AS (SELECT *, avg(x) OVER (PARTITION BY event_type) AS m FROM s) SELECT event_type, {_DESCRIBE} FROM c GROUP BY 1")
def describe_by_type(spark, sf):
    return I.rounded(describe.describe(I.events(spark, sf).withColumnRenamed("value", "x"), "x", ["event_type"]), **_SIX)


@register(
    "extremes",
    f"WITH {I.BARS} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, '{k}' AS kind, idx AS at, round(CAST({c} AS DOUBLE), 6) AS value, bar FROM bars ORDER BY {c} {o}, idx LIMIT 1)" for c in ("close", "volume", "trades") for k, o in (("min", "ASC"), ("max", "DESC"))
    ),
)
def extremes(spark, sf):
    return I.rounded(describe.extremes(I.bars(spark, sf), ["close", "volume", "trades"], "idx", ["bar"]), value=6)


@register("histogram_clamped", f"WITH {I.SERIES} SELECT CAST(greatest(0, least(39, floor(x / 5.0))) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1")
def histogram_clamped(spark, sf):
    return describe.histogram(I.series(spark, sf), "x", 0.0, 200.0, 40)


@register(
    "histogram_tails",
    f"WITH {I.SERIES}, e AS (SELECT quantile_cont(x, 0.005) AS a, quantile_cont(x, 0.995) AS b FROM s) SELECT CAST(greatest(0, least(89, floor((x - a) / ((b - a) / 90)))) AS INTEGER) AS bin, "
    "count(*) FILTER (x >= a AND x <= b) AS n, count(*) FILTER (x < a) AS below, count(*) FILTER (x > b) AS above FROM s, e GROUP BY 1",
)
def histogram_tails(spark, sf):
    return describe.histogram_of(I.series(spark, sf), "x", 90, 0.005, 0.995).drop("low", "high")


@register("halves", f"WITH {I.SERIES}, h AS (SELECT x, idx < (SELECT count(*) FROM s) // 2 AS early FROM s) SELECT round(avg(x) FILTER (early), 6) AS mean_first, round(avg(x) FILTER (NOT early), 6) AS mean_second, round(stddev_samp(x) FILTER (early), 6) AS std_first, round(stddev_samp(x) FILTER (NOT early), 6) AS std_second FROM h")
def halves(spark, sf):
    s = I.series(spark, sf)
    return I.rounded(describe.halves(s, "x", s.count()), mean_first=6, mean_second=6, std_first=6, std_second=6)


@register("prefix_sum", f"WITH {I.SERIES} SELECT idx, round(sum(x) OVER (ORDER BY idx), 4) AS total FROM s")
def prefix_sum_(spark, sf):
    return I.rounded(prefix_sum(I.series(spark, sf).select("idx", "x"), F.col("x"), "total", block_rows=1024), total=4).select("idx", "total")


@register("downsample_minmax", f"WITH {I.SERIES}, b AS (SELECT *, idx // (((SELECT count(*) FROM s) + 99) // 100) AS bucket FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY x, idx) AS lo, row_number() OVER (PARTITION BY bucket ORDER BY x DESC, idx) AS hi FROM b) SELECT bucket, idx, x FROM k WHERE lo = 1 OR hi = 1")
def downsample_minmax(spark, sf):
    s = I.series(spark, sf)
    return describe.downsample_minmax(s, "x", s.count(), 200)


@register(
    "csv_text",
    "SELECT event_id, format('{:.12g}', value / 3) AS third, format('{:.12g}', value * 1e-7) AS small, coalesce(format('{:.12g}', CASE WHEN event_id % 5 > 0 THEN value * 1e10 END), '') AS large FROM events",
)
def csv_text(spark, sf):
    from tidewater.sources.sinks import csv_columns

    e = I.events(spark, sf).select("event_id", (F.col("value") / 3).alias("third"), (F.col("value") * 1e-7).alias("small"), F.when(F.col("event_id") % 5 > 0, F.col("value") * 1e10).alias("large"))
    return csv_columns(e).withColumn("event_id", F.col("event_id").cast("bigint"))


@register(
    "labels",
    "WITH p AS (SELECT unnest(range(1, 2300)) AS k), t AS (SELECT k, CAST(k AS DOUBLE) AS lags, k / 100.0 - 12 AS stat FROM p) SELECT k, round(lags * 5 / 60, 6) AS hours, round(lags * 5 / 1440, 6) AS days, "
    "CASE WHEN abs(lags - 12) / 12 <= 0.1 THEN '1 hora' WHEN abs(lags - 288) / 288 <= 0.1 THEN '1 dia' WHEN abs(lags - 2016) / 2016 <= 0.1 THEN '1 semana' ELSE '' END AS near, "
    "CASE k WHEN 12 THEN '1 hora' WHEN 288 THEN '1 dia' WHEN 2016 THEN '1 semana' ELSE k || ' retardos' END AS exact, "
    "CASE WHEN stat <= -3.43 THEN '<=0.01' WHEN stat <= -2.86 THEN '0.01-0.05' WHEN stat <= -2.57 THEN '0.05-0.10' ELSE '>0.10' END AS adf, "
    "CASE WHEN stat >= 0.739 THEN '<=0.01' WHEN stat >= 0.463 THEN '0.01-0.05' WHEN stat >= 0.347 THEN '0.05-0.10' ELSE '>0.10' END AS kpss, "
    "CASE WHEN k / 2300.0 < 0.05 THEN 'rechaza H0' ELSE 'no rechaza H0' END AS verdict, round(least(-log10(greatest(exp(-k / 20.0), 1e-16)), 16), 6) AS bar FROM t",
)
def labels(spark, sf):
    k = F.col("k")
    lags, stat = k.cast("double"), k / 100.0 - 12
    return spark.range(1, 2300).withColumnRenamed("id", "k").select(
        "k", F.round(S.period_hours(lags), 6).alias("hours"), F.round(S.period_days(lags), 6).alias("days"), S.nearest_reference(lags).alias("near"), S.reference_label(lags).alias("exact"),
        S.adf_bracket(stat).alias("adf"), S.kpss_bracket(stat).alias("kpss"), S.verdict(k / 2300.0).alias("verdict"), F.round(S.minus_log10_p(F.exp(-k / 20.0)), 6).alias("bar"),
    )
