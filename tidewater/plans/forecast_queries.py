"""Splits, neighbours, models and their evaluation: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import special
from tidewater.operators import candles, describe, forecast, neighbours, series
from tidewater.operators.ordering import block_of
from tidewater.plans import inputs as I
from tidewater.registry import register

TRAIN_END, VALIDATION_END = "2024-01-18 23:55:00", "2024-01-24 23:55:00"
_SPLIT = f"""WITH {I.BARS}, sp AS (SELECT *, CASE WHEN bar <= epoch(TIMESTAMP '{TRAIN_END}') THEN 'train' WHEN bar <= epoch(TIMESTAMP '{VALIDATION_END}') THEN 'validation' ELSE 'test' END AS split FROM bars),
  pg AS (SELECT * FROM (SELECT *, max(idx) OVER (PARTITION BY split) AS e FROM sp) WHERE split = 'test' OR idx <= e - 12)"""


def _split(spark, sf):
    return candles.split(I.bars(spark, sf), TRAIN_END, VALIDATION_END)


@register("split_summary", _SPLIT + " SELECT split, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, min(bar) AS first_bar, max(bar) AS last_bar FROM pg GROUP BY 1")
def split_summary(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar"))


@register("split_by_share", f"WITH {I.BARS}, n AS (SELECT count(*) AS n FROM bars) SELECT CASE WHEN idx < floor(n * 0.6) THEN 'train' WHEN idx < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(idx) AS first_idx FROM bars, n GROUP BY 1")
def split_by_share(spark, sf):
    b = I.bars(spark, sf)
    return candles.split_by_share(b, b.count()).groupBy("split").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


@register("combined_splits", _SPLIT + " SELECT idx, split FROM pg WHERE split IN ('train', 'validation')")
def combined_splits(spark, sf):
    return _split(spark, sf).filter(F.col("split").isin("train", "validation")).select("idx", "split")


@register("block_middle", f"WITH {I.BARS}, n AS (SELECT count(*) AS n FROM bars) SELECT idx, bar FROM bars, n WHERE idx >= (n - 720) // 2 AND idx < (n - 720) // 2 + 720")
def block_middle(spark, sf):
    b = I.bars(spark, sf)
    return block_of(b, b.count(), 720).select("idx", "bar")


@register("head_tail", f"WITH {I.BARS}, n AS (SELECT count(*) AS n FROM bars) SELECT idx, bar, close FROM bars, n WHERE idx < 5 OR idx >= n - 5")
def head_tail(spark, sf):
    b = I.bars(spark, sf)
    n = b.count()
    return b.filter((F.col("idx") < 5) | (F.col("idx") >= n - 5)).select("idx", "bar", "close")


@register("alignment", f"WITH {I.BARS}, y AS (SELECT idx, close, lead(close, 12) OVER (ORDER BY idx) AS y FROM bars), a AS (SELECT abs(y - lead(close, 12) OVER (ORDER BY idx)) AS d FROM y) SELECT max(d) AS max_abs_diff, avg(d) AS mean_abs_diff, count(d) AS n FROM a")
def alignment(spark, sf):
    b = I.bars(spark, sf).select("idx", F.col("close").alias("x"))
    made = forecast.supervised(b).select("idx", "y")
    return forecast.alignment(b.join(made, "idx", "left"))


@register("known_mean_before_test", _SPLIT + ", y AS (SELECT idx, lead(close, 12) OVER (ORDER BY idx) AS y FROM bars) SELECT round(avg(y), 6) AS historical_mean, count(y) AS n FROM y WHERE idx + 12 <= (SELECT min(idx) FROM pg WHERE split = 'test')")
def known_mean_before_test(spark, sf):
    first = _split(spark, sf).filter("split = 'test'").agg(F.min("idx")).first()[0]  # the first test query
    return I.rounded(forecast.known_mean(forecast.supervised(I.bars(spark, sf), "close"), first, 12), historical_mean=6)


_PREDICT = _SPLIT + """, t AS (SELECT avg(y) AS m FROM (SELECT split, lead(close, 12) OVER (ORDER BY idx) AS y FROM pg_all) WHERE split = 'train')"""
_MODELS = f"""{_SPLIT}, y AS (SELECT bars.idx, close, lead(close, 12) OVER (ORDER BY idx) AS y, avg(close) OVER (ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS smooth FROM bars),
  z AS (SELECT pg.split, y.* FROM y JOIN pg USING (idx) WHERE y IS NOT NULL), t AS (SELECT avg(y) AS m FROM z WHERE split = 'train'),
  p AS (SELECT split, 'persistence' AS model, y, close AS f FROM z UNION ALL SELECT split, 'smooth', y, smooth FROM z UNION ALL SELECT split, 'historical_mean', y, m FROM z, t),
  e AS (SELECT model, split, count(*) AS n, avg(abs(f - y)) AS mae, avg((f - y) * (f - y)) AS mse, sqrt(avg((f - y) * (f - y))) AS rmse, 1 - sum((f - y) * (f - y)) / sum((y - m) * (y - m)) AS r2, avg(f - y) AS bias, stddev_samp(f - y) AS sd FROM p, t GROUP BY 1, 2)"""


def _predictions(spark, sf):
    b = I.bars(spark, sf)
    y = forecast.supervised(b.select("idx", "close"), "close")
    smooth = series.with_halo(b.select("idx", "close"), lambda w: {"smooth": F.avg("close").over(w.rowsBetween(-11, 0))}, past=11).select("idx", "smooth")
    rows = y.join(smooth, "idx").join(candles.split(b, TRAIN_END, VALIDATION_END).select("idx", "split"), "idx")
    mean = rows.filter("split = 'train'").agg(F.avg("y").alias("train_mean"))  # one row
    rows = rows.crossJoin(F.broadcast(mean))
    models = F.array(*[F.struct(F.lit(n).alias("model"), c.alias("prediction")) for n, c in (("persistence", F.col("close")), ("smooth", F.col("smooth")), ("historical_mean", F.col("train_mean")))])
    return rows.select("idx", "split", "y", "train_mean", F.inline(models))


_METRIC_DIGITS = {"mae": 6, "mse": 5, "rmse": 6, "r2_oos": 6, "bias_yhat_minus_y": 6, "error_std": 6}


@register("forecast_metrics", _MODELS + " SELECT model, split, n, round(mae, 6) AS mae, round(mse, 5) AS mse, round(rmse, 6) AS rmse, round(r2, 6) AS r2_oos, round(bias, 6) AS bias_yhat_minus_y, round(sd, 6) AS error_std FROM e")
def forecast_metrics(spark, sf):
    return I.rounded(forecast.metrics(_predictions(spark, sf), ["model", "split"], F.col("train_mean")), **_METRIC_DIGITS)


@register("model_comparison", _MODELS + ", c AS (SELECT a.*, b.rmse AS ref FROM e a JOIN e b ON a.split = b.split AND b.model = 'persistence') SELECT model, split, round(rmse, 6) AS rmse, round(rmse - ref, 6) AS delta_rmse, round(100 * (rmse - ref) / ref, 5) AS relative_percent, CAST(row_number() OVER (PARTITION BY split ORDER BY rmse, model) AS INTEGER) AS rank FROM c")
def model_comparison(spark, sf):
    m = forecast.metrics(_predictions(spark, sf), ["model", "split"], F.col("train_mean"))
    return I.rounded(forecast.comparison(m, "persistence", ["split"]).select("model", "split", "rmse", "delta_rmse", "relative_percent", "rank"), rmse=6, delta_rmse=6, relative_percent=5)


@register("best_model", _MODELS + " SELECT split, model, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rmse, model) AS k FROM e) WHERE k = 1")
def best_model(spark, sf):
    m = forecast.metrics(_predictions(spark, sf), ["model", "split"], F.col("train_mean")).select("split", "model", "rmse")
    return I.rounded(describe.best(m, "rmse", ["model"], ["split"]), rmse=6)


@register("error_distribution", _MODELS + " SELECT model, split, " + ", ".join(f"round(quantile_cont(f - y, {q}), 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95"))) + " FROM p GROUP BY 1, 2")
def error_distribution(spark, sf):
    return I.rounded(forecast.error_distribution(_predictions(spark, sf), ["model", "split"]), p05=6, q1=6, median=6, q3=6, p95=6)


_KNN = f"""WITH {I.VECTORS}, q AS (SELECT * FROM v WHERE idx % 20 = 0), p AS (SELECT q.idx AS query_idx, v.idx AS cand_idx, sqrt(list_sum(list_transform(list_zip(q.vec, v.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist, v.target
  FROM q JOIN v ON v.idx + 12 <= q.idx AND abs(v.idx - q.idx) > 20), k AS (SELECT *, row_number() OVER (PARTITION BY query_idx ORDER BY dist, cand_idx) AS rank FROM p)"""

_KNN_EVERY = _KNN.replace(" WHERE idx % 20 = 0", "")  # every vector asks


def _neighbours(spark, sf):
    v = I.vectors(spark, sf)
    return forecast.causal_neighbours(v.filter("idx % 20 = 0"), v, 10, 20, 12)


@register("knn_topk", _KNN + " SELECT query_idx, CAST(rank AS INTEGER) AS rank, cand_idx, round(dist, 8) AS dist, target FROM k WHERE rank <= 10")
def knn_topk(spark, sf):
    return I.rounded(_neighbours(spark, sf), dist=8)


@register("knn_indexed", _KNN_EVERY + " SELECT query_idx, CAST(rank AS INTEGER) AS rank, cand_idx, round(dist, 8) AS dist, target FROM k WHERE rank <= 10")
def knn_indexed(spark, sf):
    v = I.vectors(spark, sf)
    return I.rounded(neighbours.indexed_neighbours(v, neighbours.pivot_index(v), 10, 20, 12), dist=8)


@register("knn_means", _KNN + ", t AS (SELECT unnest([1, 3, 10]) AS k) SELECT query_idx, t.k, round(avg(target), 9) AS prediction FROM k, t WHERE rank <= t.k GROUP BY 1, 2")
def knn_means(spark, sf):
    return I.rounded(forecast.neighbour_means(_neighbours(spark, sf), [1, 3, 10]), prediction=9)


@register("knn_nearest", _KNN + " SELECT query_idx, target AS prediction FROM k WHERE rank = 1")
def knn_nearest(spark, sf):
    return forecast.nearest_target(_neighbours(spark, sf))


@register("knn_selection", _KNN_EVERY + ", t AS (SELECT unnest([1, 3, 10]) AS k), m AS (SELECT query_idx, t.k AS k, avg(target) AS f FROM k, t WHERE rank <= t.k GROUP BY 1, 2), e AS (SELECT k, sqrt(avg((f - target) * (f - target))) AS rmse FROM m JOIN v ON v.idx = query_idx GROUP BY 1) SELECT k, round(rmse, 8) AS rmse FROM e ORDER BY rmse, k LIMIT 1")
def knn_selection(spark, sf):
    v = I.vectors(spark, sf)
    means = forecast.neighbour_means(forecast.causal_neighbours(v, v, 10, 20, 12), [1, 3, 10])
    truth = v.select(F.col("idx").alias("query_idx"), F.col("target").alias("y"))
    m = forecast.metrics(means.join(truth, "query_idx"), ["k"], 0.0).select("k", "rmse")
    return describe.best(I.rounded(m, rmse=8), "rmse", ["k"]).select("k", "rmse")


_OLS = """WITH o AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem), m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM o),
  c AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS c1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM m)"""


@register("ols_lineitem", _OLS + " SELECT 'intercept' AS term, round(my - c1 * ma - c2 * mb, 3) AS coefficient FROM c UNION ALL SELECT 'l_quantity', round(c1, 5) FROM c UNION ALL SELECT 'l_discount', round(c2, 3) FROM c")
def ols_lineitem(spark, sf):
    model = forecast.fit_har(I.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    t = forecast.coefficient_table(spark, model)
    return t.withColumn("coefficient", F.when(F.col("term") == "l_quantity", F.round("coefficient", 5)).otherwise(F.round("coefficient", 3)))


@register("ols_predictions", _OLS + " SELECT l_orderkey, l_linenumber, round(my - c1 * ma - c2 * mb + c1 * l_quantity + c2 * l_discount, 2) AS prediction FROM lineitem, c")
def ols_predictions(spark, sf):
    rows = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    model = forecast.fit_har(rows, ["l_quantity", "l_discount"], "l_extendedprice")
    return I.rounded(forecast.predict_har(rows, model), prediction=2).select("l_orderkey", "l_linenumber", "prediction")


@register("cross_sums", "SELECT count(*)::DOUBLE AS s_0_0, round(sum(l_quantity), 2) AS s_0_1, round(sum(l_tax), 4) AS s_0_2, round(sum(l_quantity * l_quantity), 2) AS s_1_1, round(sum(l_quantity * l_tax), 4) AS s_1_2, round(sum(l_tax * l_tax), 4) AS s_2_2 FROM lineitem")
def cross_sums(spark, sf):
    c = series.cross_sums(I.table(spark, sf, "lineitem"), [F.lit(1.0), F.col("l_quantity"), F.col("l_tax")])
    return I.rounded(c, s_0_1=2, s_0_2=4, s_1_1=2, s_1_2=4, s_2_2=4)


@register("har_evaluation")
def har_evaluation(spark, sf):
    f = candles.complete(candles.features(I.bars(spark, sf)))
    n = f.agg(F.max("idx") - F.min("idx")).first()[0]
    if n is None:
        return spark.createDataFrame([], "split string, n long, rmse double")
    low = f.agg(F.min("idx")).first()[0]
    rows = candles.split_by_share(f.withColumn("idx", F.col("idx") - F.lit(low)), n + 1)
    train = rows.filter("split = 'train'")
    model = forecast.fit_har(train)
    mean = train.agg(F.avg(forecast.HAR_TARGET)).first()[0]
    return forecast.metrics(forecast.predict_har(rows, model), ["split"], mean or 0.0, forecast.HAR_TARGET)


@register("normal_quantiles")
def normal_quantiles(spark, sf):
    from pyspark.sql.window import Window

    from tidewater.session import ship

    ship(spark)
    s = describe.ranked(I.daily(spark, sf).select("idx", "x"), [F.col("x"), F.col("idx")])
    n = s.count()
    return s.select("idx", special.inverse_normal_udf((F.col("rank") - 0.5) / F.lit(n)).alias("z"))
