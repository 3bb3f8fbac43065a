"""Forecasts and their evaluation: neighbours in state space, the HAR regression, baselines, metrics."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.describe import grouped_quantiles, with_quantiles
from tidewater.operators.neighbours import best_of, found_rows, query_blocks, tiled
from tidewater.operators.ordering import with_halo
from tidewater.operators.series import ols
from tidewater.session import ship

HAR_FEATURES = ["log_rv_past_12", "log_rv_past_48", "log_rv_past_288"]
HAR_TARGET = "log_rv_future_12"


def supervised(df: DataFrame, value: str = "x", horizon: int = 12, name: str = "y") -> DataFrame:
    """The value ``horizon`` rows on as the target; rows without one go."""
    return with_halo(df, lambda w: {name: F.lead(value, horizon).over(w)}, future=horizon).filter(F.col(name).isNotNull())


def alignment(df: DataFrame, value: str = "x", target: str = "y", horizon: int = 12) -> DataFrame:
    """(max_abs_diff, mean_abs_diff, n) between the target and the value ``horizon`` rows on."""
    ahead = with_halo(df, lambda w: {"_ahead": F.lead(value, horizon).over(w)}, future=horizon)
    d = F.abs(F.col(target) - F.col("_ahead"))
    return ahead.agg(F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"), F.count(d).alias("n"))


# ---------------------------------------------------------------- neighbours


def causal_neighbours(queries: DataFrame, library: DataFrame, k: int, theiler: int, horizon: int, vec: str = "vec", block_rows: int = 65_536, query_rows: int = 16_384) -> DataFrame:
    """(query_idx, rank, cand_idx, dist, target): the exact k nearest known vectors of each query.

    A candidate may be used if its target was known at the query (cand_idx + horizon <= query_idx) and it is
    more than ``theiler`` rows away; ties go by cand_idx; a query with fewer than k has fewer rows. The
    library is cut into blocks of ``block_rows`` positions, the queries into blocks of ``query_rows`` of them; a task holds
    one block of each and keeps k a query, and the blocks' winners are merged, so no task holds the library or all queries.
    """
    ship(queries.sparkSession)
    blocks = library.select(F.floor(F.col("idx") / block_rows).alias("b"), F.col("idx").alias("i"), F.col(vec).alias("v"), F.col("target").alias("t"))
    low = blocks.groupBy("b").agg(F.min("i").alias("low"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return found_rows(left, right, k, theiler, horizon)[0]

    return best_of(tiled(query_blocks(queries, query_rows, vec), blocks, low, horizon, run, "query_idx long, cand_idx long, dist double, target double"), k)


def neighbour_means(neighbours: DataFrame, ks: list[int]) -> DataFrame:
    """(query_idx, k, prediction): the mean target of the nearest k, of all there are if fewer."""
    row = neighbours.groupBy("query_idx").agg(*[F.avg(F.when(F.col("rank") <= k, F.col("target"))).alias(f"k{k}") for k in ks])
    return row.select("query_idx", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("prediction")) for k in ks])))


def nearest_target(neighbours: DataFrame) -> DataFrame:
    return neighbours.filter("rank = 1").select("query_idx", F.col("target").alias("prediction"))


def known_mean(df: DataFrame, first_query: int, horizon: int, target: str = "y") -> DataFrame:
    """The mean of the targets known at the first query."""
    return df.filter(F.col("idx") + horizon <= first_query).agg(F.avg(target).alias("historical_mean"), F.count(target).alias("n"))


# ---------------------------------------------------------------- evaluation


def metrics(predictions: DataFrame, by: list[str], train_mean: float | Column, y: str = "y", yhat: str = "prediction") -> DataFrame:
    """n, mae, mse, rmse, r2_oos (against the training mean), bias (forecast less truth) and error std."""
    e = F.col(yhat) - F.col(y)
    mean = train_mean if isinstance(train_mean, Column) else F.lit(float(train_mean))
    sst = F.sum((F.col(y) - mean) * (F.col(y) - mean))
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2_oos"), F.avg(e).alias("bias_yhat_minus_y"), F.coalesce(F.stddev_samp(e), F.lit(0.0)).alias("error_std"),
    )


def comparison(rows: DataFrame, reference: str, by: list[str] | None = None) -> DataFrame:
    """Difference in RMSE from a reference model, in per cent too, and the rank; of a table of results."""
    by = by or []
    ref = rows.filter(F.col("model") == reference).select(*by, F.col("rmse").alias("_ref"))
    joined = rows.join(F.broadcast(ref), by) if by else rows.crossJoin(F.broadcast(ref))
    w = Window.partitionBy(*by).orderBy("rmse", "model") if by else Window.orderBy("rmse", "model")
    return joined.withColumns({"delta_rmse": F.col("rmse") - F.col("_ref"), "relative_percent": 100 * (F.col("rmse") - F.col("_ref")) / F.col("_ref"), "rank": F.row_number().over(w)}).drop("_ref")


def error_distribution(predictions: DataFrame, by: list[str], y: str = "y", yhat: str = "prediction") -> DataFrame:
    """Exact quantiles of the errors of each group; nulls for a group without errors."""
    errors = predictions.select(*by, (F.col(yhat) - F.col(y)).alias("_e"))
    found = with_quantiles(errors.select(*by).distinct(), grouped_quantiles(errors, "_e", [0.05, 0.25, 0.5, 0.75, 0.95], by), by)
    return found.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("p05", "q1", "median", "q3", "p95"))])


# ---------------------------------------------------------------- HAR


def fit_har(train: DataFrame, features: list[str] = HAR_FEATURES, target: str = HAR_TARGET, ridge: float = 1e-8) -> dict:
    """Least squares with a constant from one aggregate; the ridge only where the system is singular."""
    used = train.dropna(subset=[*features, target])
    beta, n, rss = ols(used, F.col(target), [F.col(f) for f in features], ridge)
    return {"intercept": float(beta[0]), "coefficient_vector": [float(b) for b in beta[1:]], "features": list(features), "target": target, "n_train": n, "ridge": ridge, "train_rmse": math.sqrt(rss / n) if n else math.nan}


def predict_har(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    out = F.lit(float(model["intercept"]))
    for f, c in zip(model["features"], model["coefficient_vector"], strict=True):
        out = out + F.lit(float(c)) * F.col(f)
    return df.withColumn(name, out)


def coefficient_table(spark: SparkSession, model: dict) -> DataFrame:
    rows = [("intercept", float(model["intercept"])), *zip(model["features"], map(float, model["coefficient_vector"]), strict=True)]
    return spark.createDataFrame(rows, "term string, coefficient double")


def artifact(model: dict, name: str, version: str, created: str, metrics_: dict | None = None) -> str:
    """The model as JSON; NaN becomes null."""
    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    body = {"model_name": name, "version": version, "created_at": created, **model, "coefficients": dict(zip(model["features"], model["coefficient_vector"], strict=True)), "metrics": metrics_ or {}}
    return json.dumps(clean(body), indent=2, sort_keys=True)


def model_of(text: str) -> dict:
    """A model from its JSON; the vector, else the map in the order of the features."""
    raw = json.loads(text)
    vector = raw.get("coefficient_vector") or [raw["coefficients"][f] for f in raw["features"]]
    return {"intercept": float(raw["intercept"]), "coefficient_vector": [float(v) for v in vector], "features": list(raw["features"]), "target": raw.get("target", HAR_TARGET)}


def recent_mode(df: DataFrame, rows: int = 1000, train_share: float = 0.7, purge: int = 12, features: list[str] = HAR_FEATURES, target: str = HAR_TARGET) -> tuple[dict, DataFrame, DataFrame]:
    """The model of the last rows: fitted on their first part less the purge, tested on the rest, and the latest forecast."""
    last = df.agg(F.max("idx")).first()[0]
    start = last - rows + 1
    cut = start + int(rows * train_share)
    recent = df.filter(F.col("idx") >= start)
    model = fit_har(recent.filter(F.col("idx") < cut - purge), features, target)
    tested = predict_har(recent.filter(F.col("idx") >= cut), model)
    return model, tested, tested.filter(F.col("idx") == last)
