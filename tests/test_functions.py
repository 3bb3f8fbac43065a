import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions import special
from tidewater.operators import describe, dynamics, embedding, series, surrogates
from tidewater.operators.ordering import dense_index, evenly_spaced, prefix_sum, sample_evenly, with_halo


def test_chi_square_tail_against_closed_forms():
    for x in (0.1, 1.0, 5.0, 40.0, 900.0):
        assert math.isclose(special.chi_square_tail(x, 2), math.exp(-x / 2), rel_tol=1e-12)
        assert math.isclose(special.chi_square_tail(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-12)
        assert math.isclose(special.chi_square_tail(x, 1), math.erfc(math.sqrt(x / 2)), rel_tol=1e-10)
    assert math.isclose(special.chi_square_tail(1032.61106383, 239), 4.526e-99, rel_tol=1e-3)
    assert special.chi_square_tail(3.0, 0) is None and special.chi_square_tail(0.0, 3) == 1.0


def test_solve_and_its_singularity():
    a = np.array([[0.0, 2.0], [3.0, 1.0]])
    assert np.allclose(special.solve(a, np.array([4.0, 5.0])), np.linalg.solve(a, [4, 5]))
    with pytest.raises(ValueError, match="singular"):
        special.solve(np.ones((2, 2)), np.ones(2))


def test_line_degenerate():
    assert all(map(math.isnan, special.line([1], [2]))) and all(map(math.isnan, special.line([1, 1], [2, 3])))
    assert special.line([0, 1, 2], [1, 3, 5])[:2] == (2.0, 1.0) and math.isnan(special.line([0, 1], [2, 2])[2])


def test_levinson_of_an_autoregression():
    rho = 0.7 ** np.arange(6)
    pacf, var, phi = special.levinson(rho, 5)
    assert np.allclose(pacf, [1, 0.7, 0, 0, 0, 0]) and np.allclose(phi, [0.7, 0, 0, 0, 0]) and np.allclose(var[1:], 0.51)


@given(st.lists(st.floats(-50, 50), min_size=3, max_size=60))
def test_fft_acf_is_the_direct_one(xs):
    x = np.array(xs)
    c = x - x.mean()
    got = special.acf_fft(x, 2)
    if c @ c > 1e-6:
        assert np.allclose(got, [1, c[1:] @ c[:-1] / (c @ c), c[2:] @ c[:-2] / (c @ c)], atol=1e-9)


def test_significant_digits(spark):
    values = [0.0, 1.0, -2.5, 1 / 3, 1e-5, 1.5e-7, 123456789012.0, 1234567890123.0, 1e20, -0.0001, 7e-300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.significant(F.col("v"))).collect()]
    assert got == [f"{v:.12g}" for v in values]
    half = spark.createDataFrame([(99999999999.95,)], "v double").select(S.significant(F.col("v"))).first()[0]
    assert half == "100000000000"  # as documented: not C's 99999999999.9


def test_epoch_units(spark):
    rows = [("1704067200000",), ("1704067200000000",), ("1704067200000000000",), ("x",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.unix_seconds(S.epoch_to_timestamp(F.col("t")))).collect()]
    assert got == [1704067200] * 3 + [None] * 3


@given(st.integers(0, 300), st.integers(1, 50))
def test_even_spacing(n, size):
    got = evenly_spaced(n, size)
    assert got == sorted(got) and all(0 <= g < n for g in got) and len(got) == min(n, size)


def test_sample_equals_the_positions(spark):
    for n, size in ((100, 7), (5, 9), (1000, 33), (10, 1)):
        got = sorted(r["idx"] for r in sample_evenly(spark.range(n).withColumnRenamed("id", "idx"), size, n).collect())
        assert got == evenly_spaced(n, size)


def test_blocked_windows_equal_the_global_one(spark):
    from pyspark.sql.window import Window

    df = spark.range(1000).select(F.col("id").alias("idx"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"))
    frame = lambda w: {"a": F.sum("x").over(w.rowsBetween(-20, 0)), "b": F.lead("x", 7).over(w), "c": F.count("x").over(w.rowsBetween(-3, 11))}
    want = df.withColumns(frame(Window.orderBy("idx")))
    for block in (13, 50, 4096):
        got = with_halo(df, frame, past=20, future=11, block_rows=block)
        assert got.exceptAll(want).count() == 0 and got.count() == 1000
    run = prefix_sum(df, F.col("x"), "p", block_rows=64)
    assert run.exceptAll(df.withColumn("p", F.sum("x").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))).count() == 0


def test_dense_index_of_shuffled_rows(spark):
    df = spark.range(500).select((F.col("id") * 3).alias("t")).orderBy(F.rand(1))
    got = dense_index(df, F.floor(F.col("t") / 100), ["t"])
    assert got.filter(F.col("idx") * 3 != F.col("t")).count() == 0


def test_unrolled_forecast_equals_the_recursion():
    phi, last = [0.5, 0.2, -0.1], [1.0, 2.0, 4.0]  # newest first
    hist = list(last)
    for _ in range(5):
        hist.insert(0, sum(c * v for c, v in zip(phi, hist, strict=False)))
    assert math.isclose(float(series.forecast_weights(phi, 5) @ np.array(last)), hist[0])


def test_surrogates_keep_what_they_should():
    import random

    x = np.random.default_rng(0).standard_normal(256).cumsum()
    drawn = surrogates.phases(256, random.Random(1))
    p = surrogates.phase_randomised(x, drawn)
    assert np.allclose(np.abs(np.fft.rfft(p))[1:-1], np.abs(np.fft.rfft(x))[1:-1])
    assert np.allclose(np.sort(surrogates.aaft(x, drawn)), np.sort(x))
    with pytest.raises(ValueError, match="power of two"):
        surrogates.phase_randomised(x[:100], drawn)


def test_bds_by_definition():
    x = np.random.default_rng(3).standard_normal(60)
    z = (x - x.mean()) / x.std(ddof=1)
    near = np.abs(z[:, None] - z[None, :]) <= 0.8
    for row in dynamics.bds(x, [2, 3], [0.8]):
        m, n = row["dim"], 60 - row["dim"] + 1
        cm = sum(all(near[i + s, j + s] for s in range(m)) for i in range(n) for j in range(n) if i != j) / (n * (n - 1))
        k = sum(near[i, j] and near[j, h] for j in range(60) for i in range(60) for h in range(60) if len({i, j, h}) == 3) / (60 * 59 * 58)
        assert math.isclose(row["cm"], cm) and math.isclose(row["k"], k)


def test_recurrence_rate_and_epsilon():
    x = np.random.default_rng(4).standard_normal(200)
    brute = lambda e: (np.abs(x[:, None] - x[None, :]) <= e).mean()
    assert math.isclose(dynamics.recurrence_rate(np.sort(x), 0.3), brute(0.3))
    eps, rate = dynamics.recurrence_epsilon(x)
    assert math.isclose(rate, brute(eps)) and abs(rate - 0.05) < 0.01
    assert dynamics.recurrence_image(x[:20], 0.5).startswith(b"\x89PNG")


def test_selection_rules():
    assert embedding.tau_from_ami([3, 2, 1, 2, 3]) == 3 and embedding.tau_from_ami([1.0] * 20) == 1
    assert embedding.tau_from_ami([5, 2, 1.5, 1.2, 1.0]) == 2 and embedding.tau_operational([3, 2, 1]) == 1
    assert embedding.dim_from_fnn([0.5, 0.2, 0.009]) == 3 and embedding.dim_from_fnn([0.5, 0.2, 0.3]) == 2
    assert embedding.dim_from_cao([0.3, 0.8, 0.95, 0.955, 0.96]) == (4, False) and embedding.dim_from_cao([0.1, 0.5])[1]
    assert embedding.dim_from_plateau([0.2, 0.95, 1.0, 1.02]) == 2 and embedding.final_dim(1, 9) == (2, False)


def test_quantiles_of_more_values_than_fit(spark):
    shares = [0.0, 0.005, 0.1, 0.25, 0.5, 0.77, 0.99, 1.0]
    spread = spark.range(30_000).select(F.rand(3).alias("x"))
    tied = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.floor(F.rand(5) * 20)).alias("x"))
    for df in (spread.cache(), tied.cache(), spark.range(1).select(F.lit(2.5).alias("x")), spread.withColumn("x", F.when(F.col("x") < 0.5, F.col("x")))):
        want = df.agg(F.percentile("x", F.array(*[F.lit(q) for q in shares]))).first()[0]
        for most in (50, 1_000, 100_000):
            assert describe.quantiles(df, "x", shares, most) == pytest.approx(want, rel=1e-14)
    assert describe.quantiles(spread.filter("x > 2"), "x", shares) is None


def test_windows_of_two_pieces(spark):
    rows = [float((i * i * 7919) % 1013) for i in range(700)]
    df = spark.createDataFrame(list(enumerate(rows)), "idx long, x double")
    for width in (1, 2, 7, 64, 700, 701):
        got = {r["idx"]: (r["rolling_mean"], r["rolling_std"]) for r in series.rolling_moments(df, width).collect()}
        assert sorted(got) == list(range(width - 1, 700))
        for i, (mean, std) in got.items():
            part = np.array(rows[i - width + 1 : i + 1])
            assert mean == pytest.approx(part.mean()) and std == pytest.approx(part.std(ddof=1) if width > 1 else 0.0)
