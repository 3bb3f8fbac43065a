"""Series statistics, embeddings and dynamics: queries and, where SQL can say it, their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import describe, dynamics, embedding, series, surrogates
from tidewater.operators.ordering import block_of, lags, sample_evenly
from tidewater.plans import inputs as I
from tidewater.plans.phases import SURROGATE_SIZES, Settings
from tidewater.registry import register
from tidewater.sources import synthetic

_N = "(SELECT count(*) FROM s)"


def _events_series(spark, sf):
    return I.series(spark, sf).select("idx", "x")


@register("lagged", f"WITH {I.SERIES} SELECT idx, x, lag(x, 1) OVER (ORDER BY idx) AS lag_1, lag(x, 12) OVER (ORDER BY idx) AS lag_12, lead(x, 3) OVER (ORDER BY idx) AS ahead_3 FROM s")
def lagged(spark, sf):
    return lags(_events_series(spark, sf), "x", [1, 12, -3]).withColumnRenamed("lag_-3", "ahead_3")


@register(
    "rolling_moments",
    f"WITH {I.SERIES}, w AS (SELECT idx, count(x) OVER f AS n, avg(x) OVER f AS m, stddev_samp(x) OVER f AS sd FROM s WINDOW f AS (ORDER BY idx ROWS BETWEEN 287 PRECEDING AND CURRENT ROW)) SELECT idx, round(m, 9) AS rolling_mean, round(sd, 6) AS rolling_std FROM w WHERE n = 288",
)
def rolling_moments(spark, sf):
    return I.rounded(series.rolling_moments(_events_series(spark, sf), 288).drop("x"), rolling_mean=9, rolling_std=6)


_MEANS = f"WITH {I.SERIES}, w AS (SELECT idx AS start, avg(x) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 299 FOLLOWING) AS mean FROM s), m AS (SELECT * FROM w WHERE start <= {_N} - 300)"


@register("window_means", _MEANS + " SELECT start, round(mean, 6) AS mean FROM m")
def window_means(spark, sf):
    s = _events_series(spark, sf)
    return I.rounded(series.window_means(s, 300, s.count()), mean=6)


_WINDOWS = _MEANS + f""", q AS (SELECT quantile_cont(mean, 0.1) AS q FROM m), n AS (SELECT count(*) AS n FROM s),
  win AS (SELECT 'quiet' AS "window", (SELECT start FROM m, q ORDER BY round(abs(mean - q), 9), start LIMIT 1) AS start
    UNION ALL SELECT 'high_volatility', (SELECT start FROM m ORDER BY round(mean, 9) DESC, start LIMIT 1)
    UNION ALL SELECT 'recent', n - 300 FROM n UNION ALL SELECT 'middle', greatest(0, n // 2 - 150) FROM n)"""


def _windows(spark, sf):
    s = _events_series(spark, sf)
    n = s.count()
    return s, n, series.representative_windows(I.rounded(series.window_means(s, 300, n), mean=9), n, 300)


@register("representative_windows", _WINDOWS.replace("avg(x) OVER", "round(avg(x) OVER").replace("299 FOLLOWING)", "299 FOLLOWING), 9)") + ' SELECT "window", start, start + 300 AS "end" FROM win')
def representative_windows(spark, sf):
    return _windows(spark, sf)[2]


@register(
    "recentred_windows",
    _WINDOWS.replace("avg(x) OVER", "round(avg(x) OVER").replace("299 FOLLOWING)", "299 FOLLOWING), 9)")
    + ', z AS (SELECT "window", greatest(0, least(n - 500, (start + start + 300) // 2 - 49 - 250)) AS start FROM win, n) SELECT "window", start, start + 500 AS "end" FROM z',
)
def recentred_windows(spark, sf):
    _, n, w = _windows(spark, sf)
    return series.recentred(w, 500, n, 49)


@register(
    "window_slices",
    _WINDOWS.replace("avg(x) OVER", "round(avg(x) OVER").replace("299 FOLLOWING)", "299 FOLLOWING), 9)")
    + ' SELECT "window", count(*) AS n, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM win JOIN s ON idx >= start AND idx < start + 300 GROUP BY 1',
)
def window_slices(spark, sf):
    s, _, w = _windows(spark, sf)
    return I.rounded(series.slices(s, w).groupBy("window").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")), mean=6)


@register("zscore", f"WITH {I.SERIES}, t AS (SELECT avg(x) AS m, stddev_samp(x) AS sd FROM s WHERE idx < {_N} * 6 // 10) SELECT idx, round((x - m) / sd, 6) AS z FROM s, t")
def zscore(spark, sf):
    s = _events_series(spark, sf)
    return I.rounded(series.standardised(s, "x", "z", F.col("idx") < s.count() * 6 // 10), z=6).select("idx", "z")


def _acf_sql(k: int, value: str = "x", name: str = "acf") -> str:
    return f""", c AS (SELECT idx, {value} - (SELECT avg({value}) FROM s) AS c FROM s), p AS (SELECT b.idx - a.idx AS lag, sum(a.c * b.c) AS p FROM c a JOIN c b ON b.idx BETWEEN a.idx AND a.idx + {k} GROUP BY 1),
    {name} AS (SELECT CAST(lag AS INTEGER) AS lag, p / (SELECT p FROM p WHERE lag = 0) AS acf, {_N} AS n FROM p)"""


@register("acf_direct", f"WITH {I.SERIES}{_acf_sql(24)} SELECT lag, n, round(acf, 8) AS acf FROM acf")
def acf_direct(spark, sf):
    return I.rounded(series.acf(_events_series(spark, sf), 24), acf=8)


@register("acf_fft", f"WITH {I.SERIES}{_acf_sql(48)} SELECT 'events' AS series, lag, n, round(acf, 8) AS acf FROM acf")
def acf_fft(spark, sf):
    return I.rounded(series.acf_fft(_events_series(spark, sf).withColumn("series", F.lit("events")), 48), acf=8)


@register(
    "acf_by_type",
    "WITH s AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events), c AS (SELECT event_type, idx, x - avg(x) OVER (PARTITION BY event_type) AS c FROM s), "
    "p AS (SELECT event_type, b.idx - a.idx AS lag, sum(a.c * b.c) AS p FROM c a JOIN c b USING (event_type) WHERE b.idx BETWEEN a.idx AND a.idx + 6 GROUP BY 1, 2) "
    "SELECT event_type, CAST(lag AS INTEGER) AS lag, (SELECT count(*) FROM s WHERE s.event_type = p.event_type) AS n, round(p / first_value(p) OVER (PARTITION BY event_type ORDER BY lag), 8) AS acf FROM p",
)
def acf_by_type(spark, sf):
    e = I.series(spark, sf)
    # a series a type: positions within it come from counts by day, not from one window over the type
    from pyspark.sql.window import Window

    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / I.DAY)
    keyed = e.withColumn("_d", day)
    w = Window.partitionBy("event_type", "_d").orderBy("idx")
    before = F.sum("_n").over(Window.partitionBy("event_type").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy("event_type", "_d").agg(F.count("*").alias("_n")).select("event_type", "_d", F.coalesce(before, F.lit(0)).alias("_b"))
    own = keyed.withColumn("_k", F.row_number().over(w) - 1).join(offsets, ["event_type", "_d"]).select("event_type", (F.col("_k") + F.col("_b")).alias("idx"), "x")
    return I.rounded(series.acf(own, 6, by=("event_type",)), acf=8)


@register(
    "correlogram_summary",
    f"WITH {I.SERIES}{_acf_sql(24)} SELECT round(max(acf) FILTER (lag = 1), 8) AS at_1, round(max(acf) FILTER (lag = 12), 8) AS at_12, round(1.96 / sqrt({_N}), 8) AS band, count(*) FILTER (lag > 0 AND abs(acf) > 1.96 / sqrt({_N})) AS significant, "
    f"min(lag) FILTER (lag > 0 AND abs(acf) <= 1.96 / sqrt({_N})) AS first_inside, min(lag) FILTER (lag > 0 AND acf < 0) AS first_negative, (SELECT lag FROM acf WHERE lag > 0 ORDER BY abs(acf) DESC, lag LIMIT 1) AS largest_lag FROM acf",
)
def correlogram_summary(spark, sf):
    return I.rounded(series.correlogram_summary(series.acf(_events_series(spark, sf), 24), marks=(1, 12)), at_1=8, at_12=8, band=8)


@register(
    "pacf",
    f"WITH {I.SERIES}{_acf_sql(3)}, r AS (SELECT max(acf) FILTER (lag = 1) AS a, max(acf) FILTER (lag = 2) AS b, max(acf) FILTER (lag = 3) AS c FROM acf) "
    "SELECT 'events' AS series, 0 AS lag, 1.0::DOUBLE AS pacf UNION ALL SELECT 'events', 1, round(a, 8) FROM r UNION ALL SELECT 'events', 2, round((b - a * a) / (1 - a * a), 8) FROM r "
    "UNION ALL SELECT 'events', 3, round((a * a * a - 2 * a * b + c + a * b * b - a * a * c) / (1 + 2 * a * a * b - b * b - 2 * a * a), 8) FROM r",
)
def pacf(spark, sf):
    return I.rounded(series.pacf(series.acf(_events_series(spark, sf), 3).withColumn("series", F.lit("events")), 3), pacf=8)


_DFT = f"""WITH {I.DAILY}, n AS (SELECT count(*) AS n, CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS m FROM d), c AS (SELECT idx, x - (SELECT avg(x) FROM d) AS c FROM d),
  k AS (SELECT unnest(range(1, m // 2 + 1)) AS k, n, m FROM n),
  f AS (SELECT k, n, m, sum(c * cos(2 * pi() * ((k * idx) % m) / m)) AS re, sum(c * sin(2 * pi() * ((k * idx) % m) / m)) AS im FROM k, c GROUP BY 1, 2, 3),
  sp AS (SELECT k, k / m AS frequency, m / k AS period, (re * re + im * im) / n AS power FROM f)"""


def _spectrum(spark, sf):
    return series.spectrum(I.daily(spark, sf).select("idx", "x").withColumn("series", F.lit("daily")))


@register("periodogram", _DFT + " SELECT 'daily' AS series, k, round(frequency, 9) AS frequency, round(period, 6) AS period_lags, round(period * 5 / 60, 6) AS period_hours, round(period * 5 / 1440, 6) AS period_days, round(power, 3) AS power FROM sp")
def periodogram(spark, sf):
    return I.rounded(_spectrum(spark, sf), frequency=9, period_lags=6, period_hours=6, period_days=6, power=3)


@register(
    "spectral_peaks",
    _DFT + ", l AS (SELECT *, lag(power) OVER (ORDER BY k) AS a, lead(power) OVER (ORDER BY k) AS b FROM sp), t AS (SELECT *, row_number() OVER (ORDER BY power DESC, k) AS rank FROM l WHERE power >= a AND power >= b AND period BETWEEN 2 AND 4032) "
    "SELECT CAST(rank AS INTEGER) AS rank, k, round(period, 6) AS period_lags, round(power, 3) AS power, CASE WHEN abs(period - 12) / 12 <= 0.1 THEN '1 hora' WHEN abs(period - 288) / 288 <= 0.1 THEN '1 dia' WHEN abs(period - 2016) / 2016 <= 0.1 THEN '1 semana' ELSE '' END AS nearest_reference FROM t WHERE rank <= 12",
)
def spectral_peaks(spark, sf):
    return I.rounded(series.spectral_peaks(_spectrum(spark, sf)), period_lags=6, power=3).select("rank", "k", "period_lags", "power", "nearest_reference")


@register(
    "spectral_reference_power",
    _DFT + ", t AS (SELECT p, period, power, row_number() OVER (PARTITION BY p ORDER BY abs(period - p), k) AS j FROM sp, (SELECT unnest([12.0, 288.0, 2016.0]) AS p)) SELECT CAST(p AS DOUBLE) AS reference_period, CASE p WHEN 12 THEN '1 hora' WHEN 288 THEN '1 dia' ELSE '1 semana' END AS reference_label, round(period, 6) AS nearest_period, round(power, 3) AS power FROM t WHERE j = 1",
)
def spectral_reference_power(spark, sf):
    return I.rounded(series.power_at(_spectrum(spark, sf), [12, 288, 2016]).drop("series"), nearest_period=6, power=3)


@register(
    "downsample_spectrum",
    _DFT + ", z AS (SELECT (SELECT count(*) FROM sp) AS n), b AS (SELECT *, (k - 1) // greatest(1, (n + 99) // 100) AS bucket FROM sp, z), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY power DESC, k) AS j FROM b) SELECT bucket, k, round(log10(period), 6) AS log10_period, round(log10(greatest(power, 1e-300)), 6) AS log10_power FROM t WHERE j = 1",
)
def downsample_spectrum(spark, sf):
    s = _spectrum(spark, sf)
    return I.rounded(series.downsample_spectrum(s, 100, s.count()).drop("series"), log10_period=6, log10_power=6)




def _ljung_sql(value: str) -> str:
    return f"""WITH {I.SERIES}{_acf_sql(24, value)}, m AS (SELECT unnest([6, 12, 24]) AS mark), t AS (SELECT mark AS lag, sum(acf * acf / (n - lag)) * max(n) * (max(n) + 2) AS q FROM acf, m WHERE lag BETWEEN 1 AND mark GROUP BY 1),
      i AS (SELECT unnest(range(0, 12)) AS i), pv AS (SELECT lag, q, sum(exp(i * ln(q / 2) - lgamma(i + 1) - q / 2)) AS p FROM t, i WHERE i < lag // 2 GROUP BY 1, 2)
      SELECT lag, round(q, 5) AS q, lag AS df, round(p, 8) AS p_value, CASE WHEN p < 0.05 THEN 'rechaza H0' ELSE 'no rechaza H0' END AS decision FROM pv"""


@register("ljung_box", _ljung_sql("x"))
def ljung_box(spark, sf):
    return I.rounded(series.ljung_box(series.acf(_events_series(spark, sf), 24), [6, 12, 24]), q=5, p_value=8)


@register("ljung_box_squared", _ljung_sql("x * x"))
def ljung_box_squared(spark, sf):
    s = _events_series(spark, sf).select("idx", (F.col("x") * F.col("x")).alias("x"))
    return I.rounded(series.ljung_box(series.acf(s, 24), [6, 12, 24]), q=5, p_value=8)


@register("arch_lm", f"WITH {I.SERIES}{_acf_sql(2, 'x * x')}, r AS (SELECT max(acf) FILTER (lag = 1) AS a, max(acf) FILTER (lag = 2) AS b, max(n) AS n FROM acf), k AS (SELECT a, (b - a * a) / (1 - a * a) AS b, n FROM r) SELECT 1 AS q, round(a * a, 9) AS r2, round((n - 1) * a * a, 6) AS lm FROM k UNION ALL SELECT 2, round(1 - (1 - a * a) * (1 - b * b), 9), round((n - 2) * (1 - (1 - a * a) * (1 - b * b)), 6) FROM k")
def arch_lm(spark, sf):
    s = _events_series(spark, sf).select("idx", (F.col("x") * F.col("x")).alias("x"))
    rows = series.acf(s, 2).orderBy("lag").collect()  # three rows
    found = series.arch_lm([r["acf"] for r in rows], rows[0]["n"], [1, 2])
    return I.rounded(spark.createDataFrame([(r["q"], float(r["r2"]), float(r["lm"])) for r in found], "q int, r2 double, lm double"), r2=9, lm=6)


@register(
    "adf_lag0",
    f"WITH {I.SERIES}, d AS (SELECT x - lag(x) OVER (ORDER BY idx) AS dy, lag(x) OVER (ORDER BY idx) AS y1 FROM s), r AS (SELECT count(*) AS n, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx, regr_syy(dy, y1) AS syy, regr_sxy(dy, y1) AS sxy FROM d WHERE y1 IS NOT NULL) "
    "SELECT 0 AS lag, n AS nobs, round(b, 8) AS gamma, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 5) AS statistic, round(n * ln((syy - b * sxy) / n) + 4, 4) AS aic, round(n * ln((syy - b * sxy) / n) + 2 * ln(n), 4) AS bic FROM r",
)
def adf_lag0(spark, sf):
    r = series.adf(_events_series(spark, sf), 0)
    return I.rounded(spark.createDataFrame([(r["lag"], r["nobs"], r["gamma"], r["statistic"], r["aic"], r["bic"])], "lag int, nobs long, gamma double, statistic double, aic double, bic double"), gamma=8, statistic=5, aic=4, bic=4)


@register("adf_select")
def adf_select(spark, sf):
    r = series.adf_select(_events_series(spark, sf))
    return spark.createDataFrame([(r["lag"], r["nobs"], r["statistic"], r["bic"])], "lag int, nobs long, statistic double, bic double")


@register(
    "kpss",
    f"WITH {I.SERIES}, n AS (SELECT count(*) AS n, CAST(floor(12 * (count(*) / 100.0) ** 0.25) AS BIGINT) AS k FROM s), c AS (SELECT idx, x - (SELECT avg(x) FROM s) AS c FROM s), u AS (SELECT sum(c) OVER (ORDER BY idx) AS u FROM c), "
    "p AS (SELECT b.idx - a.idx AS lag, sum(a.c * b.c) AS p FROM c a JOIN c b ON b.idx BETWEEN a.idx AND a.idx + (SELECT k FROM n) GROUP BY 1), v AS (SELECT sum(p * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (k + 1.0)) END) / max(n) AS v FROM p, n) "
    "SELECT n, k AS nlags, round((SELECT sum(u * u) FROM u) / (n * n) / v, 6) AS statistic, round(v, 4) AS long_run_variance FROM n, v",
)
def kpss(spark, sf):
    r = series.kpss(_events_series(spark, sf))
    return I.rounded(spark.createDataFrame([(r["n"], r["nlags"], r["statistic"], r["long_run_variance"])], "n long, nlags long, statistic double, long_run_variance double"), statistic=6, long_run_variance=4)


#: The Levinson recursion over the autocorrelations r: coefficients phi and innovation variance v of each order.
_LEVINSON = f"""WITH RECURSIVE {I.SERIES}{_acf_sql(20)}, r AS (SELECT list(acf ORDER BY lag) AS r, max(n) AS n FROM acf),
  lv AS (SELECT 1 AS p, [r[2]] AS phi, 1 - r[2] * r[2] AS v FROM r
    UNION ALL SELECT p + 1, list_append(list_transform(phi, lambda f, i: f - k * phi[p + 1 - i]), k), v * (1 - k * k)
    FROM (SELECT p, phi, v, (r[p + 2] - list_sum(list_transform(phi, lambda f, i: f * r[p + 2 - i]))) / v AS k FROM lv, r WHERE p < 20)),
  o AS (SELECT p, phi, n AS nobs, v AS sigma2, n * ln(v) + 2 * p AS aic, n * ln(v) + p * ln(n) AS bic FROM lv, r)"""


@register("ar_order", _LEVINSON + ", k AS (SELECT *, row_number() OVER (ORDER BY bic, p) AS rank FROM o) SELECT p, nobs, round(sigma2, 9) AS sigma2, round(aic, 4) AS aic, round(bic, 4) AS bic, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def ar_order(spark, sf):
    fit = series.ar_fit(_events_series(spark, sf), 20)
    rows = [(r["p"], r["nobs"], float(r["sigma2"]), float(r["aic"]), float(r["bic"])) for r in fit["orders"]]
    best = describe.ranked(spark.createDataFrame(rows, "p int, nobs long, sigma2 double, aic double, bic double"), [F.col("bic"), F.col("p")]).filter("rank <= 10")
    return I.rounded(best, sigma2=9, aic=4, bic=4)


@register("ar_coefficients", _LEVINSON + ", best AS (SELECT phi FROM o ORDER BY bic, p LIMIT 1), t AS (SELECT unnest(range(1, len(phi) + 1)) AS lag, unnest(phi) AS f FROM best) SELECT CAST(lag AS INTEGER) AS lag, round(f, 8) AS coefficient, round(abs(f), 8) AS abs_coefficient, CAST(row_number() OVER (ORDER BY abs(f) DESC, lag) AS INTEGER) AS rank_abs FROM t")
def ar_coefficients(spark, sf):
    return I.rounded(series.ar_table(series.ar_fit(_events_series(spark, sf), 20), spark), coefficient=8, abs_coefficient=8)


_AR = [0.5, 0.2, -0.1]


@register("ar_residuals", f"WITH {I.SERIES}, l AS (SELECT idx, x, 0.5 * lag(x, 1) OVER (ORDER BY idx) + 0.2 * lag(x, 2) OVER (ORDER BY idx) - 0.1 * lag(x, 3) OVER (ORDER BY idx) AS fitted FROM s) SELECT idx, round(fitted, 6) AS fitted, round(x - fitted, 6) AS residual FROM l")
def ar_residuals(spark, sf):
    return I.rounded(series.ar_residuals(_events_series(spark, sf), _AR, "x"), fitted=6, residual=6).select("idx", "fitted", "residual")


@register(
    "ar_forecast",
    f"WITH {I.SERIES}, l AS (SELECT idx, x AS a, lag(x, 1) OVER (ORDER BY idx) AS b, lag(x, 2) OVER (ORDER BY idx) AS c FROM s), f1 AS (SELECT *, 0.5 * a + 0.2 * b - 0.1 * c AS f1 FROM l), f2 AS (SELECT *, 0.5 * f1 + 0.2 * a - 0.1 * b AS f2 FROM f1) SELECT idx, round(10 + 2 * (0.5 * f2 + 0.2 * f1 - 0.1 * a), 6) AS forecast FROM f2",
)
def ar_forecast(spark, sf):
    return I.rounded(series.ar_forecast(_events_series(spark, sf), _AR, 3, "x", 10.0, 2.0), forecast=6).select("idx", "forecast")


_CODES = f"WITH {I.SERIES}, e AS (SELECT " + ", ".join(f"quantile_cont(x, {i / 8}) AS e{i}" for i in range(1, 8)) + " FROM s), c AS (SELECT idx, CAST(" + " + ".join(f"(e{i} <= x)::INT" for i in range(1, 8)) + " AS INTEGER) AS code FROM s, e)"


@register("discretised", _CODES + " SELECT idx, code FROM c")
def discretised(spark, sf):
    return embedding.discretised(_events_series(spark, sf), 8).select("idx", "code")


@register(
    "mutual_information",
    _CODES + ", p AS (SELECT b.idx - a.idx AS tau, a.code AS a, b.code AS b, count(*) AS n FROM c a JOIN c b ON b.idx - a.idx IN (1, 2, 3, 5, 8, 12) GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY tau) AS nn, sum(n) OVER (PARTITION BY tau, a) AS na, sum(n) OVER (PARTITION BY tau, b) AS nb FROM p) "
    "SELECT CAST(tau AS INTEGER) AS tau, CAST(sum(n) AS BIGINT) AS pairs, round(sum(n / nn * ln(n * nn / (na * nb))), 8) AS ami FROM t GROUP BY 1",
)
def mutual_information(spark, sf):
    return I.rounded(embedding.mutual_information(embedding.discretised(_events_series(spark, sf), 8), [1, 2, 3, 5, 8, 12]), ami=8)


@register("delay_embedding", f"WITH {I.SERIES}, l AS (SELECT idx, x AS a, lag(x, 7) OVER (ORDER BY idx) AS b, lag(x, 14) OVER (ORDER BY idx) AS c FROM s) SELECT idx, a AS x1, b AS x2, c AS x3 FROM l WHERE c IS NOT NULL")
def delay_embedding(spark, sf):
    e = embedding.delay_embedding(_events_series(spark, sf), 7, 3, "x")
    return e.select("idx", *[F.col("vec")[k].alias(f"x{k + 1}") for k in range(3)])


def _pattern_sql(order: int, delay: int) -> str:
    items = ", ".join(f"{{'v': lag(x, {(order - 1 - k) * delay}) OVER (ORDER BY idx), 'k': {k}}}" for k in range(order))
    return f"SELECT {order} AS o, {delay} AS d, idx, list_transform(list_sort([{items}]), lambda s: s.k) AS p FROM s"


_PE = [(3, 1), (3, 4), (4, 1), (4, 4)]


@register(
    "permutation_entropy",
    f"WITH {I.SERIES}, a AS (" + " UNION ALL ".join(_pattern_sql(o, d) for o, d in _PE) + "), c AS (SELECT o, d, p, count(*) AS n FROM a WHERE idx >= (o - 1) * d GROUP BY 1, 2, 3), h AS (SELECT o, d, n / sum(n) OVER (PARTITION BY o, d) AS q FROM c) "
    'SELECT o AS "order", d AS delay, count(*) AS patterns, round(-sum(q * ln(q)), 8) AS entropy, round(-sum(q * ln(q)) / ln(CASE o WHEN 3 THEN 6 ELSE 24 END), 8) AS normalised FROM h GROUP BY 1, 2',
)
def permutation_entropy(spark, sf):
    return I.rounded(embedding.permutation_entropy(_events_series(spark, sf), [3, 4], [1, 4]), entropy=8, normalised=8)


_SAMPLE = f"WITH {I.DAILY}, s AS (SELECT idx, x FROM d), n AS (SELECT count(*) AS n FROM s), g AS (SELECT CAST(round_even((n - 1) * i / 199.0, 0) AS BIGINT) AS idx FROM n, (SELECT unnest(range(0, 200)) AS i) WHERE n > 200 UNION ALL SELECT unnest(range(0, n)) FROM n WHERE n <= 200), v AS (SELECT s.idx, x AS a, (SELECT x FROM s t WHERE t.idx = s.idx - 3) AS b FROM s JOIN g USING (idx) WHERE s.idx >= 3)"


#: The published sample size; every day is kept where there are no more.
PUBLISHED_SAMPLE = 2500


def _sampled_vectors(spark, sf, size=200):
    d = I.daily(spark, sf).select("idx", "x")
    return sample_evenly(embedding.delay_embedding(d, 3, 2, "x"), size, d.count())


def _published(sql: str) -> str:
    """The SQL of a sample of 200 with the published size instead."""
    n = PUBLISHED_SAMPLE
    return sql.replace("199.0", f"{n - 1}.0").replace("range(0, 200)", f"range(0, {n})").replace("n > 200", f"n > {n}").replace("n <= 200", f"n <= {n}")


@register("sample_evenly", _SAMPLE + " SELECT idx, round(a, 6) AS x1, round(b, 6) AS x2 FROM v")
def sample_evenly_(spark, sf):
    return _sampled_vectors(spark, sf).select("idx", F.round(F.col("vec")[0], 6).alias("x1"), F.round(F.col("vec")[1], 6).alias("x2"))


_PAIRS = _SAMPLE + ", p AS (SELECT a.idx AS i, b.idx AS j, sqrt((a.a - b.a) * (a.a - b.a) + (a.b - b.b) * (a.b - b.b)) AS d FROM v a JOIN v b ON b.idx - a.idx > 10)"


@register("pair_distances_all", _published(_PAIRS) + " SELECT i, j, round(d, 5) AS d FROM p")
def pair_distances_all(spark, sf):
    return I.rounded(dynamics.pair_distances(_sampled_vectors(spark, sf, PUBLISHED_SAMPLE), 10), d=5)


@register("correlation_sums_all", _published(_PAIRS) + ", r AS (SELECT unnest([1000.0, 2000.0, 4000.0, 8000.0, 16000.0]) AS radius), c AS (SELECT radius, count(*) FILTER (d < radius) AS below, count(*) AS pairs FROM p, r GROUP BY 1) SELECT CAST(radius AS DOUBLE) AS radius, below, pairs, round(below / pairs, 9) AS c FROM c")
def correlation_sums_all(spark, sf):
    c = dynamics.correlation_sums(dynamics.pair_distances(_sampled_vectors(spark, sf, PUBLISHED_SAMPLE), 10), [1000.0, 2000.0, 4000.0, 8000.0, 16000.0])
    return I.rounded(c.select("radius", "below", "pairs", "c"), c=9)


_RADII = _published(_PAIRS) + ", q AS (SELECT quantile_cont(d, 0.01) AS a, quantile_cont(d, 0.7) AS b FROM p WHERE d > 0), steps AS (SELECT unnest(range(0, 24)) AS k), r AS (SELECT k, exp(ln(a) + (ln(b) - ln(a)) * k / 23) AS radius FROM q, steps)"


@register("radii", _RADII + " SELECT k, round(radius, 5) AS radius FROM r")
def radii(spark, sf):
    d = dynamics.pair_distances(_sampled_vectors(spark, sf, PUBLISHED_SAMPLE), 10).cache()  # a bounded sample
    found = dynamics.radii(d, 24)
    d.unpersist()
    return I.rounded(spark.createDataFrame(list(enumerate(found)), "k long, radius double"), radius=5)


@register(
    "correlation_dimension",
    _RADII + ", c AS (SELECT k, radius, count(*) FILTER (d < radius) / count(*) AS c FROM p, r GROUP BY 1, 2), l AS (SELECT k, c, ln(radius) AS lr, CASE WHEN c > 0 THEN ln(c) END AS lc FROM c), "
    "s2 AS (SELECT c, (lead(lc) OVER w - lag(lc) OVER w) / (lead(lr) OVER w - lag(lr) OVER w) AS slope FROM l WINDOW w AS (ORDER BY k)), u AS (SELECT median(slope) AS m, coalesce(stddev_samp(slope), 0) AS sd, count(*) AS n FROM s2 WHERE c BETWEEN 0.02 AND 0.25 AND slope > 0) "
    "SELECT round(m, 10) AS d2, round(sd, 10) AS slope_std, n AS points, n >= 5 AND sd <= greatest(0.2 * abs(m), 0.15) AS plateau FROM u",
)
def correlation_dimension(spark, sf):
    d = dynamics.pair_distances(_sampled_vectors(spark, sf, PUBLISHED_SAMPLE), 10).cache()  # a bounded sample
    return I.rounded(dynamics.correlation_dimension(dynamics.correlation_sums(d, dynamics.radii(d, 24))), d2=10, slope_std=10)


_NN = _SAMPLE + ", q AS (SELECT a.idx AS i, b.idx AS j, (a.a - b.a) * (a.a - b.a) + (a.b - b.b) * (a.b - b.b) AS d FROM v a JOIN v b ON abs(b.idx - a.idx) > 10), k AS (SELECT i, j, sqrt(d) AS d, row_number() OVER (PARTITION BY i ORDER BY sqrt(d), j) AS r FROM q)"


@register("nearest_neighbours_all", _published(_NN) + " SELECT i, j, round(d, 5) AS d FROM k WHERE r = 1")
def nearest_neighbours_all(spark, sf):
    return I.rounded(dynamics.nearest_neighbours(_sampled_vectors(spark, sf, PUBLISHED_SAMPLE), 10), d=5)


_DIVERGE = _NN + ", w AS (SELECT s.idx, x AS a, lag(x, 3) OVER (ORDER BY s.idx) AS b FROM s), t AS (SELECT unnest(range(0, 9)) AS k), f AS (SELECT t.k, sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)) AS d FROM k n, t, w p, w q WHERE n.r = 1 AND p.idx = n.i + t.k AND q.idx = n.j + t.k), dv AS (SELECT CAST(k AS INTEGER) AS k, count(*) AS pairs, avg(ln(d)) AS m FROM f WHERE d > 1e-12 GROUP BY 1)"


def _divergence(spark, sf, size=200):
    whole = embedding.delay_embedding(I.daily(spark, sf).select("idx", "x"), 3, 2, "x")
    return dynamics.divergence(whole, dynamics.nearest_neighbours(_sampled_vectors(spark, sf, size), 10), 8)


@register("divergence_curve_all", _published(_DIVERGE) + " SELECT k, pairs, round(m, 7) AS mean_log_distance FROM dv")
def divergence_curve_all(spark, sf):
    return I.rounded(_divergence(spark, sf, PUBLISHED_SAMPLE), mean_log_distance=7)


@register("lyapunov_slope_all", _published(_DIVERGE) + " SELECT round(regr_slope(m, k), 7) AS slope, round(regr_intercept(m, k), 7) AS intercept, round(regr_r2(m, k), 6) AS r2, count(*) AS points, round(12 * regr_slope(m, k), 6) AS slope_per_hour FROM dv WHERE k BETWEEN 1 AND 6")
def lyapunov_slope_all(spark, sf):
    return I.rounded(dynamics.lyapunov(_divergence(spark, sf, PUBLISHED_SAMPLE), 1, 6), slope=7, intercept=7, r2=6, slope_per_hour=6)


@register("line_fit_by_type", f"WITH {I.SERIES} SELECT event_type, round(regr_slope(x, idx), 9) AS slope, round(regr_intercept(x, idx), 6) AS intercept, round(regr_r2(x, idx), 9) AS r2, count(*) AS points FROM s GROUP BY 1")
def line_fit_by_type(spark, sf):
    return I.rounded(dynamics.line_fit(I.series(spark, sf), "idx", "x", ["event_type"]), slope=9, intercept=6, r2=9)


@register("recurrence_counts", f"WITH {I.SERIES}, v AS (SELECT x, count(*) AS m FROM s GROUP BY 1) SELECT sum(a.m * b.m)::BIGINT AS recurrent, (SELECT count(*) FROM s) AS n, round(sum(a.m * b.m) / ((SELECT count(*) FROM s)::DOUBLE * (SELECT count(*) FROM s)), 9) AS rate FROM v a JOIN v b ON abs(a.x - b.x) <= 2.5")
def recurrence_counts(spark, sf):
    return I.rounded(dynamics.recurrence_counts(_events_series(spark, sf), 2.5), rate=9)


@register("recurrence_epsilon")
def recurrence_epsilon(spark, sf):
    s, _, w = _windows(spark, sf)
    return dynamics.recurrence(series.slices(s, w))


#: The rate at the distance ``mid`` of one row ``b``; a rank is taken by an as-of join on the different values.
_RATE = "(SELECT (2 * (sum(q.m * w.upto)::DOUBLE - any_value(q.n) * (any_value(q.n) - 1) / 2) - any_value(q.n)) / (any_value(q.n)::DOUBLE * any_value(q.n)) AS r FROM (SELECT v.m, v.z + {b}.mid AS z, t.n FROM v, {b}, t) q ASOF JOIN v w ON q.z >= w.z)"
_STEPS = 50
_EPSILON = f"""WITH {I.SERIES}, t AS MATERIALIZED (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std FROM s WHERE x IS NOT NULL),
v AS MATERIALIZED (SELECT z, m, sum(m) OVER (ORDER BY z) AS upto FROM (SELECT (x - mean) / std AS z, count(*) AS m FROM s, t WHERE x IS NOT NULL GROUP BY 1)),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS low, max(z) - min(z) AS high, (max(z) - min(z)) / 2 AS mid FROM v), """ + "".join(
    f"b{k + 1} AS MATERIALIZED (SELECT *, (low + high) / 2 AS mid FROM (SELECT CASE WHEN r < 0.05 THEN mid ELSE low END AS low, CASE WHEN r < 0.05 THEN high ELSE mid END AS high FROM b{k}, {_RATE.format(b=f'b{k}')})), " for k in range(_STEPS)
) + f"e AS (SELECT high + 1e-12 AS mid FROM b{_STEPS}) SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(mid, 9) AS epsilon, round(r, 6) AS rate FROM t, e, {_RATE.format(b='e')}"


@register("recurrence_epsilon_series", _EPSILON)
def recurrence_epsilon_series(spark, sf):
    return I.rounded(dynamics.series_epsilon(_events_series(spark, sf)), mean=6, std=6, epsilon=9, rate=6)


@register("bds")
def bds(spark, sf):
    s, _, w = _windows(spark, sf)
    return dynamics.bds_by(series.slices(s, w), [2, 3, 4], [0.5, 1.0, 1.5])


#: Near pairs of all days within 0.8 standard deviations; dimensions 2 and 3.
_BDS = f"""WITH {I.DAILY}, t AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mean, stddev_samp(x) AS std FROM d), z AS (SELECT idx, (x - mean) / std AS z FROM d, t),
e AS MATERIALIZED (SELECT z, lead(z) OVER (ORDER BY idx) AS z1, lead(z, 2) OVER (ORDER BY idx) AS z2, idx FROM z),
p AS (SELECT a.idx, count(*) AS deg, count(*) FILTER (abs(a.z1 - b.z1) <= 0.8) AS cm2, count(*) FILTER (abs(a.z1 - b.z1) <= 0.8 AND abs(a.z2 - b.z2) <= 0.8) AS cm3,
  count(*) FILTER (a.idx >= 1 AND b.idx >= 1) AS c2, count(*) FILTER (a.idx >= 2 AND b.idx >= 2) AS c3 FROM e a JOIN e b ON abs(a.z - b.z) <= 0.8 AND a.idx <> b.idx GROUP BY 1),
u AS (SELECT n, sum(deg) / (n * (n - 1)) AS c, sum(deg * deg - deg) / (n * (n - 1) * (n - 2)) AS k, sum(cm2) AS cm2, sum(cm3) AS cm3, sum(c2) AS c2, sum(c3) AS c3 FROM p, t GROUP BY n),
m AS (SELECT 2 AS dim, c2 / ((n - 1) * (n - 2)) AS c1, cm2 / ((n - 1) * (n - 2)) AS cm, k, 4 * (k ** 2 + 2 * k * c ** 2 + c ** 4 - 4 * k * c ** 2) AS variance, n FROM u
  UNION ALL SELECT 3, c3 / ((n - 2) * (n - 3)), cm3 / ((n - 2) * (n - 3)), k, 4 * (k ** 3 + 2 * (k ** 2 * c ** 2 + k * c ** 4) + 4 * c ** 6 - 9 * k * c ** 4), n FROM u)
SELECT dim, 0.8::DOUBLE AS factor, round(c1, 9) AS c1, round(cm, 9) AS cm, round(k, 9) AS k, round(sqrt(n - dim + 1) * (cm - c1 ** dim) / sqrt(variance), 5) AS statistic FROM m"""


@register("bds_series", _BDS)
def bds_series(spark, sf):
    made = dynamics.bds_by(I.daily(spark, sf).select(F.lit("all").alias("window"), "idx", "x"), [2, 3], [0.8])
    return I.rounded(made.select("dim", "factor", "c1", "cm", "k", "statistic"), c1=9, cm=9, k=9, statistic=5)


@register("shuffle_comparison")
def shuffle_comparison(spark, sf):
    s, _, w = _windows(spark, sf)
    return dynamics.shuffle_comparison(series.slices(s, w), [1, 12], 50, 11)


@register("fnn_and_cao")
def fnn_and_cao(spark, sf):
    o = Settings()
    return embedding.fnn_and_cao(series.standardised(_events_series(spark, sf)).select("idx", "z"), 3, o.max_dim, o.fnn_sample, 3, o.fnn_rtol)


@register("surrogate_replicates")
def surrogate_replicates(spark, sf):
    o = Settings()
    s = _events_series(spark, sf)
    n = s.count()
    width = min(o.surrogate_window, 1 << int(math.log2(n)))
    window = [r["x"] for r in block_of(s, n, width, 0.5).orderBy("idx").collect()]  # one window by design
    made = surrogates.replicates(spark, window, dict(zip(("shuffled", "phase", "aaft"), o.surrogate_counts, strict=True)), 5, 3, 3, 9, **SURROGATE_SIZES).cache()
    return surrogates.summary(surrogates.long_statistics(made))


@register(
    "surrogate_summary",
    "WITH o AS (SELECT avg(value) AS original FROM events WHERE event_type = 'view'), b AS (SELECT event_type AS kind, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, quantile_cont(value, 0.05) AS p05, median(value) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS max, count(value) AS n FROM events GROUP BY 1), "
    "e AS (SELECT kind, count(*) FILTER (abs(value - mean) >= abs(original - mean)) AS e FROM events JOIN b ON event_type = kind, o GROUP BY 1) SELECT kind, 'value' AS statistic, round(original, 6) AS original, round(mean, 6) AS mean, round(sd, 6) AS std, min, round(p05, 6) AS p05, round(median, 6) AS median, round(p95, 6) AS p95, max, n AS n_success, CAST(0 AS BIGINT) AS n_failures, "
    'round(abs(original - mean) / sd, 6) AS "S", round((1 + e) / (n + 1), 9) AS p_value FROM b JOIN e USING (kind), o',
)
def surrogate_summary(spark, sf):
    e = I.events(spark, sf)
    own = e.filter("event_type = 'view'").agg(F.avg("value").alias("value")).select(F.lit("original").alias("kind"), F.lit("value").alias("statistic"), "value")
    rest = e.select(F.col("event_type").alias("kind"), F.lit("value").alias("statistic"), "value")
    out = surrogates.summary(own.unionByName(rest))
    return I.rounded(out, original=6, mean=6, std=6, p05=6, median=6, p95=6, S=6, p_value=9)


@register("logistic_map", "WITH RECURSIVE g AS (SELECT 0 AS i, 0.123456789::DOUBLE AS x UNION ALL SELECT i + 1, 4.0::DOUBLE * x * (1.0::DOUBLE - x) FROM g WHERE i < 11999) SELECT CAST(i - 1000 AS BIGINT) AS idx, round(x, 9) AS x FROM g WHERE i >= 1000")
def logistic_map(spark, sf):
    return I.rounded(synthetic.series(spark).filter("series = 'clean'").select("idx", "x"), x=9)


@register("logistic_map_all")
def logistic_map_all(spark, sf):
    return synthetic.series(spark)


@register("transition_map", f"WITH {I.SERIES}, p AS (SELECT idx, x, lead(x) OVER (ORDER BY idx) AS y FROM s) SELECT round(regr_slope(y, x), 8) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS points FROM p WHERE y IS NOT NULL AND idx < {_N} * 6 // 10")
def transition_map(spark, sf):
    s = _events_series(spark, sf)
    pairs = lags(s, "x", [-1]).withColumnRenamed("lag_-1", "y").filter(F.col("y").isNotNull() & (F.col("idx") < s.count() * 6 // 10))
    return I.rounded(dynamics.line_fit(pairs, "x", "y"), slope=8, intercept=6).drop("r2")


@register("oblique_view", f"WITH {I.SERIES}, l AS (SELECT idx, x, lag(x, 7) OVER (ORDER BY idx) AS y, lag(x, 14) OVER (ORDER BY idx) AS z FROM s) SELECT idx, round(x + 0.45 * z, 6) AS u, round(y + 0.35 * z, 6) AS v FROM l WHERE z IS NOT NULL")
def oblique_view(spark, sf):
    v = F.col("vec")
    a, b = S.oblique(v[0], v[1], v[2])
    return embedding.delay_embedding(_events_series(spark, sf), 7, 3, "x").select("idx", F.round(a, 6).alias("u"), F.round(b, 6).alias("v"))


@register("robust_range", f"WITH {I.SERIES}, q AS (SELECT quantile_cont(x, 0.01) AS a, quantile_cont(x, 0.99) AS b, avg(x) AS m, stddev_samp(x) AS sd FROM s) SELECT round(a - 0.06 * (b - a), 6) AS low, round(b + 0.06 * (b - a), 6) AS high, round(m - 2 * sd, 6) AS band_low, round(m + 2 * sd, 6) AS band_high FROM q")
def robust_range(spark, sf):
    s = _events_series(spark, sf)
    q = describe.with_quantiles(s.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")), describe.grouped_quantiles(s, "x", [0.01, 0.99]), None)
    a, b = F.col("q")[0], F.col("q")[1]
    return q.select(F.round(a - 0.06 * (b - a), 6).alias("low"), F.round(b + 0.06 * (b - a), 6).alias("high"), F.round(F.col("m") - 2 * F.col("sd"), 6).alias("band_low"), F.round(F.col("m") + 2 * F.col("sd"), 6).alias("band_high"))
