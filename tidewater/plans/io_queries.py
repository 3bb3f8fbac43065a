"""Files written and read back, models as files, report tables: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import special
from tidewater.operators import candles, embedding, forecast, reports, series
from tidewater.operators.candles import CANDLE_COLUMNS, RAW_COLUMNS
from tidewater.plans import inputs as I
from tidewater.plans.series_queries import _CODES, _acf_sql, _events_series
from tidewater.registry import register
from tidewater.session import scratch
from tidewater.sources import readers, sinks

_PRICES = ["open", "high", "low", "close", "volume", "taker_buy_quote"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _PRICES)


def _candle_rows(df):
    return I.rounded(df.withColumn("bar", F.unix_seconds("open_time")), **dict.fromkeys(_PRICES, 6)).select("bar", "trades", *_PRICES)


@register("candle_file", f"WITH {I.BARS} SELECT bar, trades, {_ROUNDED} FROM bars")
def candle_file(spark, sf):
    path = scratch(spark, "candles")
    sinks.write_csv(I.bars(spark, sf), path, CANDLE_COLUMNS, single=False)
    return _candle_rows(readers.read_candles(spark, path))


@register("clean_klines", f"WITH {I.BARS} SELECT bar, trades, {_ROUNDED.replace('round(volume, 6)', 'CASE WHEN idx % 7 > 0 THEN round(volume, 6) END')} FROM bars")
def clean_klines(spark, sf):
    """Raw text: every bar in milliseconds, every seventh volume no number; a third again in a later file, in microseconds."""
    b = I.bars(spark, sf)
    text = {c: F.col(c).cast("string") for c in _PRICES + ["trades"]}
    text["volume"] = F.when(F.col("idx") % 7 > 0, text["volume"]).otherwise("n/a")

    def file(df, name, unit, **other):
        columns = {"open_time": (F.col("bar") * unit).cast("string")} | text | other
        return df.select(F.lit(name).alias("file"), F.col("idx").alias("line"), *[columns.get(c, F.lit("0")).alias(c) for c in RAW_COLUMNS])

    raw = file(b, "a.zip", 1_000).unionByName(file(b.filter("idx % 3 = 0"), "b.zip", 1_000_000, close=F.lit("1.0")))
    return _candle_rows(candles.clean_klines(raw))


def _feature_files(spark, sf):
    path = scratch(spark, "features")
    sinks.write_parquet(candles.features(I.bars(spark, sf)).withColumn("month", F.date_format("open_time", "yyyy-MM")), path, ["month"])
    return path


@register("feature_files", f"WITH {I.FEATURES} SELECT bar, CAST(trades AS DOUBLE) AS trades, round(rv_past_288, 6) AS rv_past_288 FROM f")
def feature_files(spark, sf):
    df = readers.read_features(spark, _feature_files(spark, sf), ["open_time", "trades", "rv_past_288"], as_double=True)
    return df.select(F.unix_seconds("open_time").alias("bar"), "trades", F.round("rv_past_288", 6).alias("rv_past_288"))


@register("feature_pair", f"WITH {I.FEATURES} SELECT bar, round(ln(rv_past_12 + 1e-12), 6) AS x, round(ln(rv_future_12 + 1e-12), 6) AS y FROM f WHERE rv_past_12 IS NOT NULL AND rv_future_12 IS NOT NULL")
def feature_pair(spark, sf):
    return readers.read_pair(spark, _feature_files(spark, sf)).select(F.unix_seconds("open_time").alias("bar"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("result_table", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, CAST(NULL AS DOUBLE) AS missing FROM events GROUP BY 1")
def result_table(spark, sf):
    folder = scratch(spark, "bundle")
    rows = I.events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.lit(None).cast("double").alias("missing"))
    sinks.write_bundle({"by_type": rows}, folder)
    schema = "event_type string, n long, mean double, missing double"
    none = readers.read_table(spark, f"{folder}/not_there.csv", schema, optional=True)
    return I.rounded(readers.read_table(spark, f"{folder}/by_type.csv", schema).unionByName(none), mean=6)


@register("coefficient_file", "SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, 0.2::DOUBLE), (3, (-0.1)::DOUBLE)) t(lag, coefficient)")
def coefficient_file(spark, sf):
    path = scratch(spark, "coefficients")
    sinks.write_csv(series.ar_table({"coefficients": [0.5, 0.2, -0.1]}, spark), path)
    read = readers.read_table(spark, path, "lag int, coefficient double, abs_coefficient double, rank_abs int")
    return spark.createDataFrame(list(enumerate(readers.dense_coefficients(read), 1)), "lag int, coefficient double")


@register("embedding_parameters", "SELECT * FROM (VALUES ('file', 7, 3, 21), ('fallback', 137, 5, 685)) t(source, tau, dim, theiler)")
def embedding_parameters(spark, sf):
    path = scratch(spark, "parameters")
    spark.createDataFrame([(7, 3, 10)], "tau_selected int, m_selected int, theiler_window int").coalesce(1).write.json(path)
    found = {"file": readers.embedding_parameters(spark, path), "fallback": readers.embedding_parameters(spark, path + "-none", fallback=True)}
    return spark.createDataFrame([(k, p["tau"], p["dim"], p["theiler"]) for k, p in found.items()], "source string, tau int, dim int, theiler int")


_X, _Y = "log_rv_past_12", "log_rv_future_12"
_PAIR = f"WITH {I.FEATURES}, p AS (SELECT idx, ln(rv_past_12 + 1e-12) AS x, ln(rv_future_12 + 1e-12) AS y FROM f WHERE rv_past_12 IS NOT NULL AND rv_future_12 IS NOT NULL)"


@register("model_artifact", _PAIR + f" SELECT 'intercept' AS term, round(regr_intercept(y, x), 6) AS coefficient FROM p UNION ALL SELECT '{_X}', round(regr_slope(y, x), 6) FROM p")
def model_artifact(spark, sf):
    """A fitted model through its JSON."""
    model = forecast.fit_har(candles.features(I.bars(spark, sf)), [_X], _Y)
    read = forecast.model_of(forecast.artifact(model, "har", "1", "2024-01-01T00:00:00Z", {"rmse": model["train_rmse"]}))
    return I.rounded(forecast.coefficient_table(spark, read), coefficient=6)


_RECENT = _PAIR + ", l AS (SELECT max(idx) AS last FROM p), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p, l WHERE idx > last - 300 AND idx < last - 299 + 210 - 12)"


@register("recent_forecast", _RECENT + " SELECT idx, round(a + b * x, 6) AS prediction, (SELECT count(*) FROM p, l WHERE idx >= last - 299 + 210) AS tested FROM p, l, m WHERE idx = last")
def recent_forecast(spark, sf):
    """The latest forecast of the model of the last 300 rows."""
    rows = candles.features(I.bars(spark, sf)).dropna(subset=[_X, _Y])
    _, tested, latest = forecast.recent_mode(rows, 300, features=[_X], target=_Y)
    return latest.select("idx", F.round("prediction", 6).alias("prediction")).crossJoin(F.broadcast(tested.agg(F.count("*").alias("tested"))))


@register("chi_square_tail", "WITH p AS (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS BIGINT) AS half FROM lineitem), i AS (SELECT unnest(range(0, 8)) AS i) SELECT x, half, round(sum(exp(i * ln(x / 2) - lgamma(i + 1) - x / 2)), 9) AS p_value FROM p, i WHERE i < half GROUP BY 1, 2")
def chi_square_tail(spark, sf):
    p = I.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("long").alias("half")).distinct()
    return p.withColumn("p_value", F.round(special.chi_square_tail_udf(F.col("x"), F.col("half").cast("double") * 2), 9))


@register("bds_summary", "SELECT event_type, count(*) AS tests, count(*) FILTER (event_id % 100 < 5) AS rejected, min(value) AS min_statistic, max(value) AS max_statistic, 11 AS seed FROM events GROUP BY 1")
def bds_summary(spark, sf):
    rows = I.events(spark, sf).select("event_type", (F.col("event_id") % 100 / 100).alias("p_value"), F.col("value").alias("statistic"))
    return reports.with_configuration(reports.bds_summary(rows, ["event_type"]), seed=11)


@register("shuffle_summary", "SELECT event_type, count(*) AS lags, round(avg(value), 6) AS mean_original, round(avg(value / 2), 6) AS mean_shuffled, min(event_id % 100 / 100) AS least_percentile, count(*) FILTER (event_id % 100 >= 95) AS above_95 FROM events GROUP BY 1")
def shuffle_summary(spark, sf):
    rows = I.events(spark, sf).select("event_type", F.col("value").alias("original"), (F.col("value") / 2).alias("mean"), (F.col("event_id") % 100 / 100).alias("percentile"))
    return I.rounded(reports.shuffle_summary(rows, ["event_type"]), mean_original=6, mean_shuffled=6)


@register("plot_rows", f"WITH {I.BARS}, n AS (SELECT count(*) AS n FROM bars) SELECT idx, open AS prediction, close AS y, round(open - close, 9) AS error, round(abs(open - close), 9) AS abs_error FROM bars, n WHERE idx >= (n - 720) // 2 AND idx < (n - 720) // 2 + 720")
def plot_rows(spark, sf):
    b = I.bars(spark, sf).select("idx", F.col("open").alias("prediction"), F.col("close").alias("y"))
    return I.rounded(reports.plot_rows(b, b.count()), error=9, abs_error=9)


@register("curve_around", f"WITH {I.SERIES}{_acf_sql(24)} SELECT lag AS tau, round(acf, 8) AS acf FROM acf WHERE lag BETWEEN 7 AND 17")
def curve_around(spark, sf):
    return I.rounded(reports.around(series.acf(_events_series(spark, sf), 24).select(F.col("lag").alias("tau"), "acf"), 12), acf=8)


_AMI = _CODES + (
    ", p AS (SELECT b.idx - a.idx AS tau, a.code AS a, b.code AS b, count(*) AS n FROM c a JOIN c b ON b.idx - a.idx BETWEEN 1 AND 12 GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY tau) AS nn, sum(n) OVER (PARTITION BY tau, a) AS na, sum(n) OVER (PARTITION BY tau, b) AS nb FROM p), "
    "m AS (SELECT tau, round(sum(n / nn * ln(n * nn / (na * nb))), 9) AS ami FROM t GROUP BY 1), l AS (SELECT *, lag(ami) OVER (ORDER BY tau) AS before, lead(ami) OVER (ORDER BY tau) AS after FROM m), low AS (SELECT min(tau) AS tau FROM l WHERE ami < before AND ami <= after), "
    "z AS (SELECT arg_min(ami, tau) AS y0, arg_max(ami, tau) - arg_min(ami, tau) AS rise FROM m), elbow AS (SELECT tau FROM m, z ORDER BY abs(rise * (tau - 1) - 11 * (ami - y0)) DESC, tau LIMIT 1)"
)


@register("tau_selection", _AMI + " SELECT CAST(coalesce(low.tau, elbow.tau) AS INTEGER) AS tau_ami, CAST(coalesce(low.tau, 1) AS INTEGER) AS tau_operational FROM low, elbow")
def tau_selection(spark, sf):
    """The delay from the curve of mutual information of lags 1 to 12."""
    curve = embedding.mutual_information(embedding.discretised(_events_series(spark, sf), 8), list(range(1, 13)))
    values = [r["ami"] for r in I.rounded(curve, ami=9).orderBy("tau").collect()]  # twelve rows
    return spark.createDataFrame([(embedding.tau_from_ami(values), embedding.tau_operational(values))], "tau_ami int, tau_operational int")
