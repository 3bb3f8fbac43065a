"""Exact quantiles of groups against numpy, and the report from one scan against its parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import describe, quality

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_groups_have_numpys_quantiles(spark):
    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.standard_normal(3001), "negative": -np.exp(rng.standard_normal(500) * 20), "ties": rng.integers(-2, 3, 900).astype(float),
        "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), "zeros": np.array([0.0, -0.0, 0.0, -5e-324, 5e-324]), "wide": rng.standard_normal(400) * 10.0 ** rng.integers(-300, 300, 400), None: rng.standard_normal(7),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "kind string, x double").repartition(5)
    found = describe.grouped_quantiles(df, "x", SHARES, ["kind"])
    got = {r["kind"]: r["q"] for r in found.collect()}
    assert set(got) == set(groups) and "percentile" not in plan(found)
    for k, x in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(x, SHARES)), rel=1e-13, abs=0), k
    assert {r["kind"] for r in describe.with_quantiles(df.select("kind").distinct(), found, ["kind"]).filter("q is null").collect()} == {"empty"}


def test_one_series_ends_and_not_a_number(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, math.inf, -math.inf, 2, math.nan)], "x double")
    got = describe.grouped_quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0]).first()["q"]
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert [r["q"] for r in describe.grouped_quantiles(df.filter("false"), "x", [0.5]).collect()] == [None]
    assert describe.grouped_quantiles(df.filter("false").withColumn("g", F.lit(1)), "x", [0.5], ["g"]).count() == 0


def test_weights_repeat_rows(spark):
    rows = [(5.0, 3), (1.0, 4), (9.0, 1), (7.0, 0), (8.0, None)]
    got = describe.grouped_quantiles(spark.createDataFrame(rows, "x double, n long"), "x", SHARES, weight="n").first()["q"]
    assert got == pytest.approx(list(np.quantile([1, 1, 1, 1, 5, 5, 5, 9], SHARES)))


def test_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("g"), (F.xxhash64("id") % 1_000_003 / 7.0).alias("x")).cache()
    got = {r["g"]: r["q"] for r in describe.grouped_quantiles(df, "x", [0.1, 0.5], ["g"]).collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    df.unpersist()
    assert len(got) == len(want) > 900 and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def candles(spark):
    rows = [(i * 300 + (3600 if i > 40 else 0), 1.0 + i, 3.0 + i, 0.5 + i, 2.0 + i) for i in range(600)]
    rows += [rows[5], rows[5], rows[300], (None, 1.0, 2.0, 3.0, 4.0), (None, -1.0, None, 0.0, 1.0), (500_000, 9.0, 1.0, 2.0, 0.0)]
    df = spark.createDataFrame([(*r, float(n % 4), n % 3, -1.0 if n % 50 == 0 else 1.0) for n, r in enumerate(rows)], "s long, open double, high double, low double, close double, volume double, trades long, taker_buy_quote double")
    return df.withColumn("open_time", F.timestamp_seconds("s")).drop("s").repartition(4)


def test_report_is_its_parts(spark):
    df = candles(spark)
    got = {r["check_name"]: (r["value"], r["passed"]) for r in quality.report(df).collect()}
    rules, span = quality.ohlc_consistency(df).first(), quality.expected_rows(df).first()
    gaps = quality.gaps(df).collect()
    want = {
        "rows": df.count(), "duplicates": quality.duplicates(df).first()["duplicates"], "missing": span["missing"], "gaps": len(gaps), "longest_gap": max(r["missing"] for r in gaps),
        "ohlc_inconsistent": rules["high_below_low"] + rules["open_outside"] + rules["close_outside"], "null_open_time": 2, "null_high": 1, "not_positive_open": df.filter("open <= 0").count(), "negative_taker_buy_quote": df.filter("taker_buy_quote < 0").count(),
    }
    assert {k: v for k, (v, _) in got.items() if k in want} == want
    assert len(got) == 21 and got["rows"][1] and not got["gaps"][1] and want["gaps"] >= 2 and want["duplicates"] == 4
    empty = {r["check_name"]: (r["value"], r["passed"]) for r in quality.report(df.filter("false")).collect()}
    assert empty["rows"] == (0, False) and empty["missing"] == (None, None) and empty["gaps"] == (0, True)


def test_report_reads_its_input_once(spark, tmp_path):
    candles(spark).write.parquet(str(tmp_path / "c"))
    df = quality.report(spark.read.parquet(str(tmp_path / "c")))
    df.collect()
    assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_regularity_counts_steps(spark):
    got = quality.regularity(candles(spark)).first()
    steps = [r["seconds"] for r in quality.diffs(candles(spark)).collect()]
    assert got["mean_seconds"] == pytest.approx(np.mean(steps)) and got["median_seconds"] == np.median(steps)
    assert got["odd_steps"] == sum(s != 300 for s in steps) and not got["regular"]
