"""Statistics of ordered series: stationarity, correlation, spectrum, autoregressions, portmanteau tests.

A series is a DataFrame (idx, x), dense in idx; with ``by`` columns it is many. What is a sum over rows
runs as an aggregate over lag columns, or as transforms of blocks, and only the bounded table of sums comes to the
driver. What needs a whole series at once (a spectrum) runs in one Python call a series.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.functions import special
from tidewater.operators.describe import quantiles
from tidewater.operators.ordering import dense_index, lags, own_rows, prefix_sum, spread, window_pieces, with_halo
from tidewater.session import ship

ADF_LAGS = (0, 1, 2, 3, 6, 12)


def moments(df: DataFrame, value: str = "x") -> tuple[int, float, float]:
    """n, mean and sample std of a series, on the driver."""
    r = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    return r[0], r[1] if r[1] is not None else math.nan, r[2] or 0.0


def standardised(df: DataFrame, value: str = "x", name: str = "z", where: Column | None = None) -> DataFrame:
    """z-score by the sample moments of the rows in ``where`` (all by default); a flat series gives zeros."""
    chosen = df.filter(where) if where is not None else df
    stats = chosen.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))  # one row
    return df.crossJoin(F.broadcast(stats)).withColumn(name, S.zscore(F.col(value), F.col("_mean"), F.coalesce("_std", F.lit(0.0)))).drop("_mean", "_std")


def lag_products(df: DataFrame, max_lag: int, value: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lag, n, s): sums of centred products at lags 0..max_lag, for every series."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(value).alias("n")) if by else df.agg(F.avg(value).alias("_m"), F.count(value).alias("n"))
    centred = (df.join(means, list(by)) if by else df.crossJoin(F.broadcast(means))).withColumn("_c", F.col(value) - F.col("_m"))
    wide = with_halo(centred, lambda w: {f"_l{k}": F.lag("_c", k).over(w) for k in range(1, max_lag + 1)}, past=max_lag, by=by)
    sums = wide.groupBy(*by, "n").agg(F.sum(F.col("_c") * F.col("_c")).alias("_s0"), *[F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(1, max_lag + 1)])
    return sums.select(*by, "n", F.posexplode(F.array(*[F.col(f"_s{k}") for k in range(max_lag + 1)])).alias("lag", "s"))


def acf(df: DataFrame, max_lag: int, value: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, lag, n, acf): biased autocorrelation by direct sums; [1, 0, ...] for a flat series."""
    products = lag_products(df, max_lag, value, by)
    zero = products.filter("lag = 0").select(*by, F.col("s").alias("_s0"))
    joined = products.join(zero, list(by)) if by else products.crossJoin(F.broadcast(zero))
    return joined.select(*by, "lag", "n", F.when(F.col("_s0") > 0, F.col("s") / F.col("_s0")).otherwise((F.col("lag") == 0).cast("double")).alias("acf"))


def acf_fft(df: DataFrame, max_lag: int, value: str = "x", by: str = "series", block_rows: int = 65_536) -> DataFrame:
    """(series, lag, n, acf) by Fourier transforms of blocks; for lags by the thousand.

    A block of ``block_rows`` places also sees the ``max_lag`` rows before it and sums its own rows' products with them; the
    blocks' sums add up to those of the series. Places are counted in the order of idx, so idx may have gaps.
    """
    ship(df.sparkSession)
    x = F.col(value)
    rows = dense_index(df.select(by, "idx", x.cast("double").alias("_x")), F.floor(F.col("idx") / block_rows), ["idx"], "_place", (by,))
    stats = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("_m"), (F.min(x) == F.max(x)).alias("_flat"))
    centred = rows.join(stats, by).select(by, "_place", (F.col("_x") - F.col("_m")).alias("_c"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        seen = part["_c"].to_numpy(float)
        sums = special.lag_sums(np.where(part["_own"] == part["_blk"], seen, 0.0), seen, max_lag)
        return pd.DataFrame({by: part[by].iloc[0], "lag": np.arange(len(sums)), "s": sums})

    sums = spread(centred, max_lag, 0, "_place", block_rows).groupBy(by, "_blk").applyInPandas(run, f"{by} string, lag int, s double").groupBy(by, "lag").agg(F.sum("s").alias("s"))
    whole = sums.filter("lag = 0").select(by, F.col("s").alias("_s0")).join(stats, by)
    moves = (F.col("_s0") > 0) & ~F.isnan("_s0") & ~F.coalesce("_flat", F.lit(False))
    acf = F.when(F.col("lag") >= F.col("n"), 0.0).when(moves, F.col("s") / F.col("_s0")).otherwise((F.col("lag") == 0).cast("double"))
    return sums.join(whole, by).select(by, "lag", "n", acf.alias("acf"))


def spectrum(df: DataFrame, value: str = "x", by: str = "series") -> DataFrame:
    """(series, k, frequency, period_lags, period_hours, period_days, power): periodogram of each series."""
    ship(df.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        f, period, power = special.periodogram(part[value].to_numpy())
        return pd.DataFrame({by: part[by].iloc[0], "k": np.arange(1, len(f) + 1), "frequency": f, "period_lags": period, "power": power})

    out = df.select(by, "idx", value).groupBy(by).applyInPandas(run, f"{by} string, k long, frequency double, period_lags double, power double")
    return out.withColumns({"period_hours": S.period_hours(F.col("period_lags")), "period_days": S.period_days(F.col("period_lags"))})


def spectral_peaks(spectra: DataFrame, top: int = 12, low: float = 2.0, high: float = 4032.0, by: str = "series") -> DataFrame:
    """The strongest local maxima between two periods, ranked and labelled."""
    w = Window.partitionBy(by).orderBy("k")
    local = spectra.withColumn("_a", F.lag("power").over(w)).withColumn("_b", F.lead("power").over(w)).filter(
        (F.col("power") >= F.col("_a")) & (F.col("power") >= F.col("_b")) & F.col("period_lags").between(low, high)
    )
    order = Window.partitionBy(by).orderBy(F.desc("power"), "k")
    return local.drop("_a", "_b").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("nearest_reference", S.nearest_reference(F.col("period_lags")))


def power_at(spectra: DataFrame, periods: list[float], by: str = "series") -> DataFrame:
    """The bin nearest to each period, the first of equals."""
    want = spectra.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("reference_period"))
    near = spectra.crossJoin(F.broadcast(want)).groupBy(by, "reference_period").agg(
        F.min(F.struct(F.abs(F.col("period_lags") - F.col("reference_period")).alias("d"), "k", "period_lags", "power")).alias("b")
    )
    return near.select(by, "reference_period", S.reference_label(F.col("reference_period")).alias("reference_label"), F.col("b.period_lags").alias("nearest_period"), F.col("b.power").alias("power"))


def downsample_spectrum(spectra: DataFrame, buckets: int, n: int, by: str = "series") -> DataFrame:
    """The strongest bin of each bucket with log10 axes, for a chart."""
    size = max(1, -(-n // buckets))
    b = spectra.withColumn("bucket", F.floor((F.col("k") - 1) / size)).groupBy(by, "bucket").agg(F.max(F.struct("power", (-F.col("k")).alias("_k"), "period_lags")).alias("p"))
    return b.select(by, "bucket", (-F.col("p._k")).alias("k"), F.log10("p.period_lags").alias("log10_period"), F.log10(F.greatest(F.col("p.power"), F.lit(1e-300))).alias("log10_power"))


# ---------------------------------------------------------------- regressions


def cross_sums(df: DataFrame, columns: list[Column], names: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of products of every pair i <= j of the columns, in one aggregate: s_i_j."""
    k = len(columns)
    return df.groupBy(*(by or [])).agg(*[F.sum(columns[i] * columns[j]).alias(f"s_{i}_{j}") for i in range(k) for j in range(i, k)])


def _matrix(row, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"s_{i}_{j}"] or 0.0
    return out


def ols(df: DataFrame, y: Column, xs: list[Column], ridge: float = 1e-8, singular: float = 1e-12) -> tuple[np.ndarray, int, float]:
    """Coefficients (constant first), n and the residual sum of squares; a ridge only where the system is singular."""
    cols = [F.lit(1.0), *xs, y]
    row = cross_sums(df, cols).first()
    m = _matrix(row, len(cols))
    a, b = m[:-1, :-1], m[:-1, -1]
    try:
        beta = special.solve(a, b, singular)
    except ValueError:
        beta = special.solve(a + ridge * np.eye(len(a)), b, 0.0)
    return beta, int(m[0, 0]), max(0.0, float(m[-1, -1] - beta @ b))


def adf(df: DataFrame, lag: int, value: str = "x") -> dict:
    """Dickey-Fuller with a constant and ``lag`` lagged differences: t statistic and information criteria."""
    return adf_many(df, (lag,), value)[lag]


def adf_many(df: DataFrame, steps: tuple[int, ...] = ADF_LAGS, value: str = "x") -> dict[int, dict]:
    """The test at each number of lags of a series without nulls, from one pass.

    The sums are taken once, over the rows that have all ``most`` lagged differences; the few rows before them come
    along and complete the sums of the shorter regressions.
    """
    most = max(steps)
    d = lags(df.select("idx", value), value, [1], prefix="_y").withColumn("_d0", F.col(value) - F.col("_y1"))
    d = with_halo(d, lambda w: {f"_d{k}": F.lag("_d0", k).over(w) for k in range(1, most + 1)}, past=most) if most else d
    names = ["_y1", *[f"_d{k}" for k in range(1, most + 1)], "_d0"]
    cols, whole = [F.lit(1.0), *[F.col(c) for c in names]], F.col("idx") > most
    sums = [F.sum(F.when(whole, cols[i] * cols[j])).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    early = F.collect_list(F.when(~whole & (F.col("idx") > 0), F.struct("idx", *names)))  # as many rows as lags
    row = d.agg(*sums, early.alias("early")).first()
    every = _matrix(row, len(cols))
    out = {}
    for p in steps:
        k = p + 3
        keep = [*range(p + 2), len(cols) - 1]
        m = every[np.ix_(keep, keep)]
        for r in row["early"]:
            if r["idx"] > p:
                own = np.array([1.0, *[r[c] for c in names[: p + 1]], r["_d0"]])
                m = m + np.outer(own, own)
        n, q = int(m[0, 0]), k - 1
        inverse = special.solve(m[:-1, :-1], np.eye(q))
        beta = inverse @ m[:-1, -1]
        rss = max(1e-300, float(m[-1, -1] - beta @ m[:-1, -1]))
        se = math.sqrt(rss / (n - q) * inverse[1, 1])
        out[p] = {"lag": p, "nobs": n, "gamma": float(beta[1]), "statistic": float(beta[1] / se), "aic": n * math.log(rss / n) + 2 * q, "bic": n * math.log(rss / n) + q * math.log(n)}
    return out


def adf_select(df: DataFrame, steps: tuple[int, ...] = ADF_LAGS, value: str = "x") -> dict:
    """The number of lags with the least BIC on the standardised series, the first of equals."""
    found = adf_many(standardised(df, value, "_z").select("idx", F.col("_z").alias("x")), steps)
    return min(found.values(), key=lambda r: r["bic"])


def kpss(df: DataFrame, value: str = "x", block_rows: int = 16_384) -> dict:
    """Level stationarity with Bartlett weights and int(12 (n / 100)^(1/4)) lags.

    The partial sums and the lagged products come from one pass: a partial sum is its block's offset B plus the sum
    W within the block, and their squares add up to sum W^2 + 2 B sum W + n B^2 over the blocks.
    """
    held = df.select("idx", value).persist()  # read twice; goes before this returns
    try:
        n, mean, _ = moments(held, value)
        nlags = int(12 * (n / 100) ** 0.25)
        most = min(nlags, max(0, n - 1))
        size = max(block_rows, most + 1)
        c, own = F.col("_c"), F.col("_own") == F.col("_blk")

        def made(w):
            return {"_w": F.sum(F.when(own, c)).over(w.rowsBetween(Window.unboundedPreceding, 0)), **{f"_l{k}": F.lag("_c", k).over(w) for k in range(1, most + 1)}}

        wide = with_halo(held.withColumn("_c", F.col(value) - F.lit(mean)), made, past=most, block_rows=size)
        w = F.col("_w")
        blocks = wide.groupBy(F.floor(F.col("idx") / size).alias("block")).agg(
            F.count("*").alias("_n"), F.sum(c).alias("_t"), F.sum(w).alias("_w1"), F.sum(w * w).alias("_w2"), F.sum(c * c).alias("_s0"), *[F.sum(c * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, most + 1)]
        )
        placed = prefix_sum(blocks, F.col("_t"), "_e", idx="block").withColumn("_b", F.col("_e") - F.col("_t"))
        b = F.col("_b")
        row = placed.agg(F.sum(F.col("_w2") + 2 * b * F.col("_w1") + F.col("_n") * b * b).alias("eta"), *[F.sum(f"_s{k}").alias(f"s{k}") for k in range(most + 1)]).first()  # one row of sums
    finally:
        held.unpersist()
    long_run = (row["s0"] + 2 * sum((1 - k / (nlags + 1)) * (row[f"s{k}"] or 0.0) for k in range(1, most + 1))) / n
    return {"n": n, "nlags": nlags, "statistic": row["eta"] / n**2 / long_run if long_run > 0 else math.nan, "long_run_variance": long_run}


def pacf(acf_rows: DataFrame, max_lag: int, by: str = "series") -> DataFrame:
    """(series, lag, pacf) from autocorrelations, by the Levinson recursion on each series' short vector."""
    ship(acf_rows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        values = part.sort_values("lag")["acf"].to_numpy()
        order = min(max_lag, len(values) - 1)
        return pd.DataFrame({by: part[by].iloc[0], "lag": np.arange(order + 1), "pacf": special.levinson(values, order)[0]})

    return acf_rows.select(by, "lag", "acf").groupBy(by).applyInPandas(run, f"{by} string, lag int, pacf double")


def correlogram_summary(curve: DataFrame, value: str = "acf", marks: tuple[int, ...] = (1, 12, 288, 2016), by: tuple[str, ...] = ()) -> DataFrame:
    """Values at the marked lags, the 1.96 / sqrt(n) band, significant lags, first below it, first negative, largest."""
    band, later = F.lit(1.96) / F.sqrt("n"), F.col("lag") > 0
    return curve.groupBy(*by).agg(
        *[F.max(F.when(F.col("lag") == m, F.col(value))).alias(f"at_{m}") for m in marks], F.first(band).alias("band"),
        F.count_if(later & (F.abs(value) > band)).alias("significant"), F.min(F.when(later & (F.abs(value) <= band), F.col("lag"))).alias("first_inside"),
        F.min(F.when(later & (F.col(value) < 0), F.col("lag"))).alias("first_negative"), F.min(F.when(later, F.struct((-F.abs(value)).alias("v"), "lag")))["lag"].alias("largest_lag"),
    )


def ar_orders(acf_values: np.ndarray, n: int, max_order: int, variance: float = 1.0) -> list[dict]:
    """Orders 1..max by Yule-Walker: innovation variance (of a variance of 1, or in units), AIC and BIC."""
    _, var, _ = special.levinson(acf_values[: max_order + 1], max_order)
    rows = []
    for p in range(1, max_order + 1):
        s = max(1e-300, var[p] * variance)
        rows.append({"p": p, "nobs": n, "sigma2": s, "aic": n * math.log(s) + 2 * p, "bic": n * math.log(s) + p * math.log(n)})
    return rows


def ar_orders_from_zero(x: np.ndarray, max_order: int) -> tuple[list[dict], list[float]]:
    """Orders 0..max of a short series on the driver, and the coefficients of the one with the least BIC.

    Order 0 is the mean; each order counts it as a parameter, and variances are in units, so all compare.
    """
    n = len(x)
    if n <= max_order + 1:
        raise ValueError("too few rows for the orders")
    c = x - x.mean()
    sums = np.array([c[k:] @ c[: n - k] for k in range(max_order + 1)])
    values, zero = sums / sums[0], float(sums[0] / n)
    var = special.levinson(values, max_order)[1]
    rows = []
    for p in range(max_order + 1):
        s = max(1e-300, float(var[p]) * zero if p else zero)
        rows.append({"p": p, "nobs": n, "sigma2": s, "aic": n * math.log(s) + 2 * (p + 1), "bic": n * math.log(s) + (p + 1) * math.log(n)})
    chosen = min(rows, key=lambda r: r["bic"])["p"]
    return rows, special.autoregression(values, chosen).tolist() if chosen else []


def ar_fit(df: DataFrame, max_order: int = 100, value: str = "x") -> dict:
    """The order with the least BIC on the series, its coefficients, and the whole table of orders."""
    rows = acf(df, max_order, value).orderBy("lag").collect()  # max_order + 1 rows
    values, n = np.array([r["acf"] for r in rows]), rows[0]["n"]
    table = ar_orders(values, n, max_order)
    chosen = min(table, key=lambda r: r["bic"])
    return {**chosen, "coefficients": special.autoregression(values, chosen["p"]).tolist(), "orders": table}


def ar_table(fit: dict, spark) -> DataFrame:
    """(lag, coefficient, abs_coefficient, rank_abs), ranked by size, then lag."""
    rows = [(i + 1, float(c)) for i, c in enumerate(fit["coefficients"])]
    w = Window.orderBy(F.desc("abs_coefficient"), "lag")  # as many rows as the order
    return spark.createDataFrame(rows, "lag int, coefficient double").withColumn("abs_coefficient", F.abs("coefficient")).withColumn("rank_abs", F.row_number().over(w))


def ar_residuals(df: DataFrame, coefficients: list[float], value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """fitted = sum of coefficient k times the value k back; residual = value - fitted; null for the first rows."""
    p = len(coefficients)
    wide = with_halo(df, lambda w: {f"_l{k}": F.lag(value, k).over(w) for k in range(1, p + 1)}, past=p, by=by)
    fitted = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col(f"_l{k}") for k, c in enumerate(coefficients, 1)])
    return wide.withColumn("fitted", fitted).withColumn("residual", F.col(value) - F.col("fitted")).drop(*[f"_l{k}" for k in range(1, p + 1)])


def forecast_weights(coefficients: list[float], horizon: int) -> np.ndarray:
    """Weights of the last p values in the h-step forecast: the recursion is linear, so it is unrolled once."""
    p = len(coefficients)
    state = np.eye(p)
    phi = np.array(coefficients, float)
    for _ in range(horizon):
        state = np.vstack([phi @ state, state[:-1]]) if p > 1 else (phi @ state)[None, :]
    return state[0]


def ar_forecast(df: DataFrame, coefficients: list[float], horizon: int, value: str = "z", mean: float = 0.0, std: float = 1.0, name: str = "forecast") -> DataFrame:
    """The h-step forecast from each row, in units; null where the last p values aren't there."""
    if not coefficients:
        return df.withColumn(name, F.lit(float(mean)))
    weights = forecast_weights(coefficients, horizon)
    p = len(weights)
    wide = with_halo(df, lambda w: {f"_l{k}": F.lag(value, k).over(w) for k in range(1, p)}, past=p - 1)
    total = reduce(lambda a, b: a + b, [F.lit(float(c)) * (F.col(value) if k == 0 else F.col(f"_l{k}")) for k, c in enumerate(weights)])
    return wide.withColumn(name, F.lit(float(mean)) + F.lit(float(std)) * total).drop(*[f"_l{k}" for k in range(1, p)])


def ljung_box(curve: DataFrame, marks: list[int], fitted: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(lag, q, df, p_value, decision) at each mark from a table of autocorrelations; no degrees, no p-value."""
    ship(curve.sparkSession)
    want = F.explode(F.array(*[F.lit(m) for m in marks]))
    terms = curve.filter("lag > 0").withColumn("mark", want).filter(F.col("lag") <= F.col("mark"))
    q = terms.groupBy(*by, "mark").agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))
    df = F.col("lag") - F.lit(fitted)
    out = q.withColumnRenamed("mark", "lag").withColumn("df", df)
    p = F.when(F.col("df") > 0, special.chi_square_tail_udf(F.col("q"), F.col("df").cast("double")))
    return out.withColumn("p_value", p).withColumn("decision", S.verdict(F.col("p_value")))


def arch_lm(squares: np.ndarray | list[float], n: int, orders: list[int]) -> list[dict]:
    """From autocorrelations of the squares: R2 = 1 - innovation variance, in [0, 1]; LM = (n - q) R2."""
    var = special.levinson(np.asarray(squares), max(orders))[1]
    out = []
    for q in orders:
        r2 = min(1.0, max(0.0, 1 - var[q]))
        lm = (n - q) * r2
        out.append({"q": q, "r2": float(r2), "lm": float(lm), "p_value": special.chi_square_tail(float(lm), q)})
    return out


def rolling_moments(df: DataFrame, width: int, value: str = "x") -> DataFrame:
    """Rolling mean and sample std over whole windows only, variance 0 at the least; two pieces a window, merged."""
    x = F.col(value)
    made = window_pieces(spread(df, past=width - 1), width, {"_n": F.count(x), "_m": F.avg(x), "_v": F.var_pop(x)})
    a, b = F.col("_n_a"), F.coalesce("_n_b", F.lit(0))
    gap = F.col("_m_a") - F.col("_m_b")
    squares = F.col("_v_a") * a + F.coalesce(F.col("_v_b") * b + gap * gap * a * b / width, F.lit(0.0))
    std = F.sqrt(F.greatest(F.lit(0.0), squares / (width - 1))) if width > 1 else F.lit(0.0)
    out = own_rows(made.filter(a + b == width)).withColumns({"rolling_mean": (F.col("_m_a") * a + F.coalesce(F.col("_m_b") * b, F.lit(0.0))) / width, "rolling_std": std})
    return out.drop(*[f"{n}_{p}" for n in ("_n", "_m", "_v") for p in "ab"])


def window_means(df: DataFrame, width: int, n: int, value: str = "x") -> DataFrame:
    """(start, mean) of every whole window of the first ``n`` rows, named by its first row: two pieces a window, so nothing is
    subtracted and the cost doesn't depend on the width. A window with a null has no row."""
    x = F.col(value)
    made = own_rows(window_pieces(spread(df.select("idx", value), past=width - 1), width, {"_s": F.sum(x), "_c": F.count(x)}))
    whole = made.filter((F.col("_c_a") + F.coalesce("_c_b", F.lit(0)) == width) & (F.col("idx") < n))
    return whole.select((F.col("idx") - (width - 1)).alias("start"), ((F.col("_s_a") + F.coalesce("_s_b", F.lit(0.0))) / width).alias("mean"))


def representative_windows(means: DataFrame, n: int, width: int) -> DataFrame:
    """(window, start, end): the quiet one (mean nearest its 10th percentile), the one around the highest
    mean, the last and the middle; the first of equals."""
    low = quantiles(means, "mean", [0.10]) or [None]
    quiet = means.agg(F.min(F.struct(F.abs(F.col("mean") - F.lit(low[0])).alias("d"), "start"))["start"].alias("start")).select(F.lit("quiet").alias("window"), "start")
    high = means.agg(F.min(F.struct((-F.col("mean")).alias("m"), "start"))["start"].alias("start")).select(F.lit("high_volatility").alias("window"), "start")
    fixed = means.sparkSession.range(1).select(F.inline(F.array(F.struct(F.lit("recent").alias("window"), F.lit(n - width).cast("bigint").alias("start")), F.struct(F.lit("middle").alias("window"), F.lit(max(0, n // 2 - width // 2)).cast("bigint").alias("start")))))
    return quiet.unionByName(high).unionByName(fixed).withColumn("end", F.col("start") + width)


def recentred(windows: DataFrame, width: int, n: int, offset: int = 0) -> DataFrame:
    """Windows of another width around the same middles, moved by ``offset`` and kept inside 0..n."""
    middle = F.floor((F.col("start") + F.col("end")) / 2) - offset
    start = S.clamp(middle - width // 2, 0, n - width)
    return windows.withColumn("start", start.cast("bigint")).withColumn("end", F.col("start") + width)


def slices(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of each window: a handful of windows goes to every task."""
    return df.join(F.broadcast(windows), (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
