"""Summaries of result tables and the texts that go with them; everything here is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ordering import block_of


def ar_equation(coefficients: list[float], shown: int = 5) -> str:
    """The largest terms of an autoregression, by size."""
    order = sorted(range(len(coefficients)), key=lambda i: (-abs(coefficients[i]), i))[:shown]
    terms = " ".join(f"{coefficients[i]:+.4f} z(t-{i + 1})" for i in sorted(order))
    return f"z(t) = {terms}{' + ...' if shown < len(coefficients) else ''} + e(t)"


def around(curve: DataFrame, tau: int, reach: int = 5) -> DataFrame:
    """Rows of a curve near the chosen delay."""
    return curve.filter(F.abs(F.col("tau") - tau) <= reach)


def bds_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Tests, rejections and the range of the statistic."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("tests"), F.count_if(F.col("p_value") < 0.05).alias("rejected"), F.min("statistic").alias("min_statistic"), F.max("statistic").alias("max_statistic")
    )


def shuffle_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """How far the original lies above its permutations."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("lags"), F.avg("original").alias("mean_original"), F.avg("mean").alias("mean_shuffled"), F.min("percentile").alias("least_percentile"), F.count_if(F.col("percentile") >= 0.95).alias("above_95")
    )


def with_configuration(rows: DataFrame, **values: object) -> DataFrame:
    """Configuration values as columns beside a result."""
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


def plot_rows(predictions: DataFrame, n: int, size: int = 720, idx: str = "idx") -> DataFrame:
    """A run of predictions from the middle, with errors, for a chart."""
    error: Column = F.col("prediction") - F.col("y")
    return block_of(predictions, n, size, "middle", idx).withColumns({"error": error, "abs_error": F.abs(error)})


def forecast_summary(settings: dict, k: int, rows: dict[str, float], alignment: dict) -> dict:
    """What a forecast run used and found, with the rules that keep it from looking ahead."""
    return {
        "settings": settings, "selected_k": k, "test_rmse": rows, "alignment": alignment,
        "leakage_control": {
            "standardisation": "moments of the training rows only", "library": "targets known at the query: cand_idx + horizon <= query_idx",
            "theiler": "candidates closer than the window are left out", "purge": "the last rows before a split's end, whose targets lie beyond it, are left out",
        },
    }
