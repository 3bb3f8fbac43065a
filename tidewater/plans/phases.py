"""The analysis from candles to the exported model: each phase takes DataFrames and gives its result tables.

A phase returns {table name: DataFrame}; ``sinks.write_bundle`` writes them. Series are (idx, open_time,
x); sizes of samples and windows are parameters, for they are part of what is computed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import candles, describe, dynamics, embedding, forecast, quality, series, surrogates
from tidewater.operators.ordering import block_of, dense_index, evenly_spaced, sample_evenly, with_halo
from tidewater.sources import readers, synthetic

MAIN = "log_rv_past_12"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Settings:
    """What the phases share; the defaults are those of the published run."""

    train_end: str = "2025-06-30 23:55:00"
    validation_end: str = "2025-12-31 23:55:00"
    horizon: int = 12
    rolling: int = 288
    acf_lags: int = 2016
    direct_lags: int = 288
    squared_marks: tuple[int, ...] = (12, 48, 288)
    arch_lags: tuple[int, ...] = (1, 5, 12, 24)
    shuffle_lags: tuple[int, ...] = (1, 12, 288)
    max_order: int = 100
    recurrence_width: int = 2000
    test_width: int = 3000
    ami_bins: int = 32
    ami_lags: int = 288
    max_dim: int = 15
    fnn_sample: int = 3000
    fnn_rtol: float = 10.0
    fnn_threshold: float = 0.05
    corr_sample: int = 2500
    radii: int = 32
    lyap_block: int = 3000
    lyap_steps: int = 60
    lyap_fit: tuple[int, int] = (1, 30)
    orders: tuple[int, ...] = (3, 4, 5, 6, 7)
    surrogate_window: int = 8192
    surrogate_counts: tuple[int, int, int] = (50, 39, 39)
    queries: int = 5000
    k_grid: tuple[int, ...] = (2, 3, 5, 10, 20, 50)
    seed: int = 20260602


#: Sizes of the statistics of a window and its surrogates in the published run.
SURROGATE_SIZES = {"corr_sample": 700, "radii": 24, "block": 1600, "references": 550, "steps": 40, "fit": (1, 20)}


def need(n: int, least: int, what: str) -> None:
    """A series that is too short is an error; nothing shrinks to fit it."""
    if n < least:
        raise ValueError(f"{what} needs {least:,} rows, there are {n:,}")


def need_splits(rows: DataFrame) -> None:
    """Each split must have rows."""
    found = {r["split"] for r in rows.select("split").distinct().collect()}  # three names
    for name in ("train", "validation", "test"):
        if name not in found:
            raise ValueError(f"split {name} is empty")


def indexed(candle_rows: DataFrame) -> DataFrame:
    """Candles with their position on the regular grid, counted by day."""
    return dense_index(candle_rows, F.floor(F.unix_seconds(F.col("open_time").cast("timestamp")) / 86_400), ["open_time"])


def series_of(features: DataFrame, value: str = MAIN) -> DataFrame:
    return features.select("idx", "open_time", F.col(value).alias("x"))


def train_rows(s: DataFrame, o: Settings) -> DataFrame:
    """All rows up to the end of training, without a purge."""
    return s.filter(F.col("open_time") <= F.lit(o.train_end).cast("timestamp"))


def phase0(text_or_typed: DataFrame) -> Tables:
    """Quality of the candles."""
    return {
        "phase0_quality_summary": quality.report(text_or_typed),
        "phase0_numeric_checks": quality.numeric_checks(text_or_typed),
        "phase0_null_counts": quality.null_share(text_or_typed, candles.CANDLE_COLUMNS),
        "phase0_frequency_summary": quality.diff_histogram(text_or_typed),
        "phase0_gap_report": quality.gaps(text_or_typed),
    }


def phase1(rows: DataFrame) -> tuple[DataFrame, Tables]:
    """Features; the result's idx counts from 0 again after the incomplete rows are gone."""
    bad = rows.filter(" OR ".join(f"{p} <= 0" for p in candles.PRICES)).limit(1).count()
    if bad:
        raise ValueError("prices must be positive")
    wide = candles.features(rows)
    whole = candles.complete(wide)
    first = whole.agg(F.min("idx")).first()[0]
    if first is None:
        raise ValueError("no row has all features")
    done = whole.withColumn("idx", F.col("idx") - F.lit(first))
    shape = whole.agg(F.count("*").alias("rows_out"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")).crossJoin(
        F.broadcast(rows.agg(F.count("*").alias("rows_in")))  # one row
    )
    n = F.max("idx")
    return done, {
        "phase1_shape_summary": shape.withColumns({"dropped_start": F.col("first_idx"), "dropped_end": F.col("rows_in") - 1 - F.col("last_idx"), "epsilon": F.lit(S.EPSILON)}),
        "phase1_feature_ranges": describe.ranges(done, candles.CREATED_COLUMNS),
        "phase1_zero_rv_windows": quality.zero_windows(wide, [c for c in candles.CREATED_COLUMNS if c.startswith("rv_")]),
        "phase1_created_columns": rows.sparkSession.createDataFrame([(c,) for c in candles.CREATED_COLUMNS], "column_name string"),
        "phase1_head": done.filter("idx < 5"),
        "phase1_tail": done.crossJoin(F.broadcast(done.agg(n.alias("_last")))).filter(F.col("idx") > F.col("_last") - 5).drop("_last"),
    }


def phase2(features: DataFrame) -> Tables:
    """Descriptive statistics and the most extreme rows."""
    names = ["close", "volume", *candles.CREATED_COLUMNS]
    long = features.select("idx", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in names])))
    return {
        "phase2_descriptive_statistics": describe.describe(long, "x", ["variable"], at="idx"),
        "phase2_extreme_events": describe.extremes(features, ["r", "abs_r", "volume", "hl_range", "rv_past_12", "rv_past_288", "trades"], "idx", ["open_time", "close"]),
    }


def phase3(features: DataFrame, o: Settings = Settings(), names: tuple[str, ...] = ("close", "log_close", "r", "r2", MAIN)) -> Tables:
    """Stationarity of the main series, and the rolling moments."""
    spark, adf_rows, lag_rows, kpss_rows = features.sparkSession, [], [], []
    rolling = None
    for name in names:
        s = series_of(features, name)
        z = series.standardised(s, "x", "z").select("idx", F.col("z").alias("x"))
        found = series.adf_many(z)
        best = min(found.values(), key=lambda r: r["bic"])
        lag_rows += [(name, r["lag"], r["nobs"], float(r["aic"]), float(r["bic"])) for r in found.values()]
        adf_rows.append((name, best["lag"], best["nobs"], float(best["statistic"])))
        k = series.kpss(z)
        kpss_rows.append((name, k["n"], k["nlags"], float(k["statistic"])))
        m = series.rolling_moments(s.select("idx", "x"), o.rolling).agg(*[f(c).alias(f"{n}_{c}") for c in ("rolling_mean", "rolling_std") for n, f in (("min", F.min), ("max", F.max))])
        h = describe.halves(s, "x", s.count())
        row = h.crossJoin(F.broadcast(m)).withColumn("variable", F.lit(name))
        rolling = row if rolling is None else rolling.unionByName(row)
    adf = spark.createDataFrame(adf_rows, "variable string, lag int, nobs long, statistic double")
    kpss = spark.createDataFrame(kpss_rows, "variable string, n long, nlags long, statistic double")
    return {
        "phase3_adf_results": adf.withColumns({"p_range": S.adf_bracket(F.col("statistic")), "rejects_unit_root": F.col("statistic") <= S.ADF_CRITICAL["5%"]}),
        "phase3_adf_lag_selection": spark.createDataFrame(lag_rows, "variable string, lag int, nobs long, aic double, bic double"),
        "phase3_kpss_results": kpss.withColumns({"p_range": S.kpss_bracket(F.col("statistic")), "rejects_level": F.col("statistic") >= S.KPSS_CRITICAL["5%"]}),
        "phase3_rolling_summary": rolling,
    }


def _named(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return features.select("idx", F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in names])))


def phase4(features: DataFrame, o: Settings = Settings(), names: tuple[str, ...] = ("r", "r2", MAIN)) -> Tables:
    """Correlograms and spectra."""
    long = _named(features, names)
    curve = series.acf_fft(long, o.acf_lags)
    spectra = series.spectrum(long)
    return {
        "phase4_acf_values": curve,
        "phase4_pacf_values": series.pacf(curve, o.direct_lags),
        "phase4_correlogram_summary": series.correlogram_summary(curve, by=("series",)),
        "phase4_spectral_peaks": series.spectral_peaks(spectra),
        "phase4_spectral_reference_power": series.power_at(spectra, list(S.PERIODS.values())),
    }


def phase5(features: DataFrame, o: Settings = Settings()) -> Tables:
    """Representative windows and their recurrence."""
    s = series_of(features)
    n = s.count()
    windows = series.representative_windows(series.window_means(s.select("idx", "x"), o.recurrence_width, n), n, o.recurrence_width)
    inside = series.slices(s, windows)
    stats = inside.groupBy("window").agg(F.min("open_time").alias("start_time"), F.max("open_time").alias("end_time"), F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    return {"phase5_selected_windows": windows.join(stats, "window"), "phase5_recurrence_parameters": dynamics.recurrence(inside)}


def phase6(features: DataFrame, windows: DataFrame, o: Settings = Settings()) -> tuple[DataFrame, list[float], Tables]:
    """The autoregressive filter: its order, coefficients, and what it leaves."""
    s = series_of(features)
    train = train_rows(s, o)
    n_train, mean, std = series.moments(train)
    z = s.withColumn("z", S.zscore(F.col("x"), F.lit(mean), F.lit(std)))
    need(n_train, 4 * o.max_order, f"an autoregression of order {o.max_order}")
    fit = series.ar_fit(train.select("idx", "x"), o.max_order)
    left = series.ar_residuals(z, fit["coefficients"]).filter(F.col("residual").isNotNull())
    rows = [(r["p"], r["nobs"], float(r["sigma2"]), float(r["aic"]), float(r["bic"])) for r in fit["orders"]]
    orders = s.sparkSession.createDataFrame(rows, "p int, nobs long, sigma2 double, aic double, bic double")
    both = left.select("idx", F.inline(F.array(F.struct(F.lit("original").alias("series"), F.col("z").alias("x")), F.struct(F.lit("residual").alias("series"), F.col("residual").alias("x")))))
    curve = series.acf_fft(both, o.acf_lags)
    p = len(fit["coefficients"])
    recurrence = dynamics.recurrence(series.slices(left.select("idx", F.col("residual").alias("x")), windows.select("window", "start", "end").filter(F.col("start") >= p)))
    return left, fit["coefficients"], {
        "phase6_ar_order_selection": orders,
        "phase6_top10_ar_bic": describe.ranked(orders, [F.col("bic"), F.col("p")]).filter("rank <= 10"),
        "phase6_ar_coefficients": series.ar_table(fit, s.sparkSession),
        "phase6_residual_series": left,
        "phase6_residual_statistics": describe.describe(left, "residual"),
        "phase6_residual_histogram": describe.histogram_of(left, "residual", 90, 0.005, 0.995),
        "phase6_correlogram_comparison": series.correlogram_summary(curve, by=("series",)),
        "phase6_residual_pacf_values": series.pacf(curve.filter("series = 'residual'"), o.direct_lags),
        "phase6_ljung_box_residuals": series.ljung_box(curve.filter("series = 'residual'"), [12, 48, 288], fitted=p, by=("series",)),
        "phase6_residual_recurrence_parameters": recurrence,
    }


def phase7(left: DataFrame, windows: DataFrame, order: int, o: Settings = Settings()) -> Tables:
    """Tests of what the filter leaves: squares, conditional variance, independence."""
    first = left.agg(F.min("idx")).first()[0]
    r = left.select((F.col("idx") - F.lit(first)).alias("idx"), F.col("residual").alias("x"))
    n = r.count()
    width = o.test_width
    need(n, width, "a test window")
    need(n - 1, o.direct_lags, "an autocorrelation")
    for name, at, most in (("squared_marks", o.squared_marks, o.direct_lags), ("arch_lags", o.arch_lags, o.direct_lags), ("shuffle_lags", o.shuffle_lags, width - 1)):
        if max(at) > most:
            raise ValueError(f"{name} {at} go beyond {most}")
    placed = series.recentred(windows.select("window", "start", "end"), width, n, order)
    squares = r.select("idx", F.lit("residual").alias("series"), (F.col("x") * F.col("x")).alias("x"))
    curve = series.acf_fft(squares, o.direct_lags)
    rho = np.array([v["acf"] for v in curve.orderBy("lag").collect()])  # direct_lags + 1 rows
    lm = [(v["q"], float(v["r2"]), float(v["lm"]), None if v["p_value"] is None else float(v["p_value"])) for v in series.arch_lm(rho, n, list(o.arch_lags))]
    inside = series.slices(r, placed).cache()  # four windows
    return {
        "phase7_windows": placed,
        "phase7_ljungbox_squared": series.ljung_box(curve, list(o.squared_marks), by=("series",)),
        "phase7_arch_lm": left.sparkSession.createDataFrame(lm, "q int, r2 double, lm double, p_value double").withColumn("decision", S.verdict(F.col("p_value"))),
        "phase7_bds_results": dynamics.bds_by(inside, [2, 3, 4, 5], [0.5, 1.0, 1.5]),
        "phase7_shuffle_results": dynamics.shuffle_comparison(inside, list(o.shuffle_lags), 50, o.seed),
    }


def standard_train(features: DataFrame, o: Settings) -> DataFrame:
    """(idx, open_time, x, z): z by the moments of the unpurged training rows."""
    s = series_of(features)
    _, mean, std = series.moments(train_rows(s, o))
    if std == 0:
        raise ValueError("the training series is flat")
    return s.withColumn("z", S.zscore(F.col("x"), F.lit(mean), F.lit(std)))


def phase8(features: DataFrame, o: Settings = Settings()) -> tuple[dict[str, int], Tables]:
    """Delay, dimension and the Theiler window of the reconstruction."""
    z = standard_train(features, o)
    train = train_rows(z, o)
    coded = embedding.discretised(train.select("idx", "z"), o.ami_bins, "z")
    curve = embedding.mutual_information(coded, list(range(1, o.ami_lags + 1)))
    ami = [r["ami"] for r in curve.orderBy("tau").collect()]  # ami_lags rows
    tau = embedding.tau_from_ami(ami)
    apart = max(tau, 12)
    grid = embedding.fnn_and_cao(train, tau, o.max_dim, o.fnn_sample, apart, o.fnn_rtol)
    rows = grid.orderBy("dim").collect()  # max_dim rows
    m_fnn, m_cao = embedding.dim_from_fnn([r["fraction"] for r in rows], o.fnn_threshold), embedding.dim_from_plateau([r["E1"] for r in rows])
    dim, agree = embedding.final_dim(m_fnn, m_cao, o.max_dim)
    chosen = {"tau": tau, "dim": dim, "theiler": tau * dim}
    spark = z.sparkSession
    return chosen, {
        "phase8_ami_tau": curve,
        "phase8_ami_shuffled_tau": embedding.mutual_information(embedding.shuffled_codes(coded, o.seed), list(range(1, o.ami_lags + 1))),
        "phase8_fnn": grid.select("dim", "valid", "false", "fraction"),
        "phase8_cao": grid.select("dim", "E", "E_star", "E1", "E2"),
        "phase8_selected_embedding_params": spark.createDataFrame([(tau, m_fnn, m_cao, dim, apart, agree)], "tau_selected int, m_fnn int, m_cao int, m_selected int, theiler_window int, compatible boolean"),
    }


def phase9(features: DataFrame, p: dict[str, int], o: Settings = Settings()) -> Tables:
    """Correlation dimension, divergence and ordinal patterns of the training series and of a shuffled copy."""
    train = train_rows(standard_train(features, o), o).select("idx", "z")
    mixed = embedding.shuffled(train, "z", o.seed)
    out: Tables = {}
    for name, s in (("original", train), ("shuffled", mixed)):
        vec = embedding.delay_embedding(s, p["tau"], p["dim"])
        low = vec.agg(F.min("idx"), F.count("*")).first()
        dense = vec.withColumn("idx", F.col("idx") - F.lit(low[0]))
        d = dynamics.pair_distances(sample_evenly(dense, o.corr_sample, low[1]), p["theiler"]).cache()  # a bounded sample
        curve = dynamics.correlation_sums(d, dynamics.radii(d, o.radii))
        block = block_of(dense, low[1], o.lyap_block).cache()  # a bounded block
        usable = block.filter(F.col("idx") < F.lit(block.agg(F.max("idx")).first()[0] - o.lyap_steps))
        spread = dynamics.divergence(block, dynamics.nearest_neighbours(usable, p["theiler"]), o.lyap_steps)
        pe = embedding.permutation_entropy(s.select("idx", F.col("z").alias("x")), list(o.orders), [1, p["tau"]])
        made = {
            "phase9_correlation_dimension": curve, "phase9_correlation_dimension_summary": dynamics.correlation_dimension(curve), "phase9_lyapunov_rosenstein": spread,
            "phase9_lyapunov_summary": dynamics.lyapunov(spread, *o.lyap_fit), "phase9_permutation_entropy": pe,
            "phase9_quantification_summary": pe.groupBy("delay").agg(F.avg("normalised").alias("mean_normalised")),
        }
        for k, v in made.items():
            v = v.withColumn("series", F.lit(name))
            out[k] = out[k].unionByName(v) if k in out else v
    return out


def phase10(features: DataFrame, p: dict[str, int], o: Settings = Settings(), **sizes) -> Tables:
    """Statistics of a window against shuffled, phase-randomised and amplitude-adjusted surrogates."""
    train = train_rows(standard_train(features, o), o).select("idx", "z")
    n = train.count()
    width = o.surrogate_window
    need(n, width, "a surrogate window")
    window = [r["z"] for r in block_of(train, n, width, 0.5).orderBy("idx").collect()]  # one window by design
    made = surrogates.replicates(train.sparkSession, window, dict(zip(("shuffled", "phase", "aaft"), o.surrogate_counts, strict=True)), o.seed, p["tau"], p["dim"], p["theiler"], **(SURROGATE_SIZES | sizes)).cache()
    long = surrogates.long_statistics(made)
    names = {"original": "original", "shuffled": "shuffled", "phase": "phase_randomized", "aaft": "aaft"}
    tables = {f"phase10_{name}_stats": made.filter(F.col("kind") == k) for k, name in names.items()}
    return tables | {"phase10_surrogate_summary": surrogates.summary(long)}


def embedded(features: DataFrame, p: dict[str, int], o: Settings) -> DataFrame:
    """(idx, open_time, split, vec, target, x): vectors on the whole series, then split and purged."""
    z = standard_train(features, o)
    ahead = with_halo(z, lambda w: {"target": F.lead("x", o.horizon).over(w)}, future=o.horizon)
    vec = embedding.delay_embedding(ahead, p["tau"], p["dim"]).filter(F.col("target").isNotNull())
    return candles.split(vec, o.train_end, o.validation_end, purge=o.horizon)


def _sampled(rows: DataFrame, split: str, o: Settings) -> DataFrame:
    """The evenly spaced queries of a split."""
    part = rows.filter(F.col("split") == split)
    dense = dense_index(part, F.floor(F.col("idx") / 65_536), ["idx"], "_k")
    return sample_evenly(dense, o.queries, part.count(), "_k", distinct=True).drop("_k")


def _evaluated(features: DataFrame, p: dict[str, int], coefficients: list[float], o: Settings, theiler: int) -> tuple[DataFrame, DataFrame, int]:
    rows = embedded(features, p, o).cache()  # used by every model
    train = rows.filter("split = 'train'")
    mean = train.agg(F.avg("target")).first()[0]
    ask = _sampled(rows, "validation", o)
    found = forecast.causal_neighbours(ask, train, max(o.k_grid), theiler, o.horizon)
    truth = lambda q: q.select(F.col("idx").alias("query_idx"), F.col("target").alias("y"), "x")
    grid = forecast.metrics(forecast.neighbour_means(found, list(o.k_grid)).join(truth(ask), "query_idx"), ["k"], mean)
    k = describe.best(grid, "rmse", ["k"]).first()["k"]
    ask = _sampled(rows, "test", o)
    found = forecast.causal_neighbours(ask, rows.filter("split != 'test'"), k, theiler, o.horizon).cache()
    t = truth(ask)
    _, zmean, zstd = series.moments(train_rows(series_of(features), o))
    ar = series.ar_forecast(standard_train(features, o).select("idx", "z"), coefficients, o.horizon, "z", zmean, zstd, "prediction").select(F.col("idx").alias("query_idx"), "prediction")
    known = forecast.known_mean(rows.select("idx", F.col("target").alias("y")), ask.agg(F.min("idx")).first()[0], o.horizon).first()[0]
    parts = {
        "historical_mean": t.select("query_idx", F.lit(known).alias("prediction")), "persistence": t.select("query_idx", F.col("x").alias("prediction")), f"ar{len(coefficients)}": ar,
        "nearest": forecast.nearest_target(found), f"knn_{k}": forecast.neighbour_means(found, [k]).drop("k"),
    }
    all_ = None
    for name, part in parts.items():
        part = part.withColumn("model", F.lit(name))
        all_ = part if all_ is None else all_.unionByName(part)
    return grid, all_.join(t, "query_idx"), k


def phase11(features: DataFrame, p: dict[str, int], coefficients: list[float], o: Settings = Settings()) -> Tables:
    """Neighbours in state space against the simple models, without a look ahead."""
    theiler = max(p["theiler"], p["tau"] * p["dim"])
    grid, predictions, _ = _evaluated(features, p, coefficients, o, theiler)
    rows = embedded(features, p, o)
    mean = rows.filter("split = 'train'").agg(F.avg("target")).first()[0]
    s = series_of(features)
    y = forecast.supervised(s.select("idx", "x"), "x", o.horizon).select("idx", "y")
    return {
        "phase11_split_summary": rows.groupBy("split").agg(F.count("*").alias("n"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time")),
        "phase11_validation_k_selection": grid,
        "phase11_test_metrics": forecast.metrics(predictions, ["model"], mean),
        "phase11_predictions_test_sample": predictions.withColumns({"error": F.col("prediction") - F.col("y"), "abs_error": F.abs(F.col("prediction") - F.col("y"))}),
        "phase11_alignment": forecast.alignment(s.select("idx", "x").join(y, "idx", "left"), horizon=o.horizon),
    }


def phase12(features: DataFrame, configs: list[dict[str, int]], coefficients: list[float], o: Settings = Settings()) -> Tables:
    """The same for other delays, dimensions and Theiler windows; a row set per configuration."""
    out: Tables = {}
    for i, c in enumerate(configs):
        grid, predictions, k = _evaluated(features, c, coefficients, o, c["theiler"])
        mean = embedded(features, c, o).filter("split = 'train'").agg(F.avg("target")).first()[0]
        tables = {"phase12_validation_k_selection": grid, "phase12_test_metrics": forecast.metrics(predictions, ["model"], mean)}
        for name, df in tables.items():
            df = df.withColumns({"config": F.lit(i), "tau": F.lit(c["tau"]), "m": F.lit(c["dim"]), "theiler": F.lit(c["theiler"])})
            out[name] = out[name].unionByName(df) if name in out else df
    knn = out["phase12_test_metrics"].filter("model LIKE 'knn%'")
    return out | {"phase12_config_comparison": describe.ranked(knn, [F.col("rmse"), F.col("config")])}


#: The control has sizes of its own.
CONTROL = Settings(max_dim=10, fnn_sample=1200, fnn_threshold=0.01, ami_lags=50, queries=10**9, horizon=1, k_grid=(1, 2, 3, 5, 10, 20, 50), seed=20260603)


def phase13(spark, o: Settings = CONTROL, **options) -> Tables:
    """The control: the same reconstruction on the logistic map, clean and noisy."""
    from tidewater.functions import special

    out: Tables = {}
    for name, (values, cut) in synthetic.bundle(**options).items():
        x = np.array(values)
        n = len(x)
        end = int(0.6 * n)
        z = (x - x[:end].mean()) / x[:end].std(ddof=1)
        s = spark.createDataFrame(list(enumerate(z.tolist())), "idx bigint, z double")
        train = s.filter(F.col("idx") < end)
        ami = embedding.mutual_information(embedding.discretised(train, o.ami_bins, "z"), list(range(1, o.ami_lags + 1)))
        tau = embedding.tau_operational([r["ami"] for r in ami.orderBy("tau").collect()])
        grid = embedding.fnn_and_cao(train, tau, o.max_dim, o.fnn_sample, tau, o.fnn_rtol)
        rows = grid.orderBy("dim").collect()
        dim = max(1, min(o.max_dim, embedding.dim_from_fnn([r["fraction"] for r in rows], o.fnn_threshold)))
        block = z[: 1800 + (dim - 1) * tau] if n < 2 * 1800 else z[n // 2 - 900 - (dim - 1) * tau : n // 2 + 900]
        curve = dynamics.rosenstein(block, tau, dim, max(1, tau * dim), 20)
        slope = special.line([r["k"] for r in curve[1:7]], [r["mean_log_distance"] for r in curve[1:7]])
        m_cao = embedding.dim_from_cao([r["E1"] for r in rows], 0.03)[0]
        tables = _control_forecasts(spark, x, z, end, tau, dim, o) | {
            "phase13_selected_embedding_params": spark.createDataFrame([(tau, embedding.dim_from_fnn([r["fraction"] for r in rows], o.fnn_threshold), m_cao, dim)], "tau_selected int, m_fnn int, m_cao int, m_selected int"),
            "phase13_ami": ami, "phase13_fnn": grid.select("dim", "valid", "false", "fraction"), "phase13_cao": grid.select("dim", "E1", "E2"),
            "phase13_lyapunov_rosenstein": spark.createDataFrame([(r["k"], r["pairs"], r["mean_log_distance"]) for r in curve], "k long, pairs long, mean_log_distance double"),
            "phase13_lyapunov_summary": spark.createDataFrame([(tau, dim, float(slope[0]), float(slope[2]), math.log(2), cut)], "tau int, m int, slope double, r2 double, theory double, clipped int"),
        }
        for k, df in tables.items():
            df = df.withColumn("series_name", F.lit(name))
            out[k] = out[k].unionByName(df) if k in out else df
    return out


def _control_forecasts(spark, x: np.ndarray, z: np.ndarray, end: int, tau: int, dim: int, o: Settings) -> Tables:
    """Neighbours, AR of the order with the least BIC and simple models on one series of the control.

    Every row of validation and test is a query. The control's splits aren't purged: a candidate counts if its
    target is known at the query.
    """
    n, theiler, ahead = len(x), max(1, tau * dim), o.horizon
    later = int(0.8 * n)
    vec = [(i, [float(z[i - k * tau]) for k in range(dim)], float(x[i + ahead]), float(x[i])) for i in range((dim - 1) * tau, n - ahead)]
    every = spark.createDataFrame(vec, "idx long, vec array<double>, target double, x double").cache()  # the control has some thousand rows
    train, validation, test = (every.filter(c) for c in (F.col("idx") < end, F.col("idx").between(end, later - 1), F.col("idx") >= later))
    mean = forecast.known_mean(train, end, ahead, "target").first()[0]
    truth = lambda q: q.select(F.col("idx").alias("query_idx"), F.col("target").alias("y"), "x")
    found = forecast.causal_neighbours(validation, train, max(o.k_grid), theiler, ahead)
    grid = forecast.metrics(forecast.neighbour_means(found, list(o.k_grid)).join(truth(validation), "query_idx"), ["k"], mean)
    k = describe.best(grid, "rmse", ["k"]).first()["k"]
    found = forecast.causal_neighbours(test, every.filter(F.col("idx") < later), k, theiler, ahead).cache()
    orders, coefficients = series.ar_orders_from_zero(z[:end], min(o.max_order, end - 2))
    t = truth(test)
    if coefficients:
        whole = spark.createDataFrame(list(enumerate(z.tolist())), "idx long, z double")
        ar = series.ar_forecast(whole, coefficients, ahead, "z", float(x[:end].mean()), float(x[:end].std(ddof=1)), "prediction").select(F.col("idx").alias("query_idx"), "prediction")
    else:
        ar = t.select("query_idx", F.lit(mean).alias("prediction"))
    parts = {
        "historical_mean": t.select("query_idx", F.lit(mean).alias("prediction")), "persistence": t.select("query_idx", F.col("x").alias("prediction")), "ar_bic": ar,
        "nearest_neighbor": forecast.nearest_target(found), f"knn_mean_k{k}": forecast.neighbour_means(found, [k]).drop("k"),
    }
    all_ = None
    for name, part in parts.items():
        part = part.withColumn("model", F.lit(name))
        all_ = part if all_ is None else all_.unionByName(part)
    made = forecast.metrics(all_.join(t, "query_idx"), ["model"], mean)
    sizes = {"tau": F.lit(tau), "m": F.lit(dim), "theiler_window": F.lit(theiler)}
    return {
        "phase13_validation_k_selection": grid.withColumns(sizes),
        "phase13_prediction_metrics": made.withColumns(sizes | {"split": F.lit("test"), "selected_k": F.lit(k), "ar_order": F.when(F.col("model") == "ar_bic", F.lit(len(coefficients)))}),
        "phase13_ar_order_selection": spark.createDataFrame([(r["p"], r["nobs"], r["sigma2"], r["aic"], r["bic"]) for r in orders], "p int, nobs_train long, innovation_variance double, aic double, bic double"),
    }


def phase14(features: DataFrame, o: Settings = Settings(), recent_rows: int = 1000, coefficients: list[float] | None = None, p: dict[str, int] | None = None, k: int = 200) -> tuple[str, Tables]:
    """The compact regression: fit, evaluation, ranking, the recent mode, and the exported artifact.

    Beside it stand the mean, persistence and the autoregression (that of phase6, fitted here if not given) on
    the whole of validation and test; and on the neighbours' sample of test all of these and ``k`` neighbours.
    """
    p = p or {"tau": 137, "dim": 5, "theiler": 685}
    rows = candles.split(readers.finite_rows(features, [*forecast.HAR_FEATURES, forecast.HAR_TARGET]), o.train_end, o.validation_end, purge=o.horizon)
    need_splits(rows)
    train = rows.filter("split = 'train'")
    model = forecast.fit_har(train)
    mean = train.agg(F.avg(forecast.HAR_TARGET)).first()[0]
    y = F.col(forecast.HAR_TARGET).alias("y")
    known = train_rows(series_of(features), o)
    n_train, zmean, zstd = series.moments(known)
    if coefficients is None:
        need(n_train, 4 * o.max_order, f"an autoregression of order {o.max_order}")
        coefficients = series.ar_fit(known.select("idx", "x"), o.max_order)["coefficients"]
    ar = series.ar_forecast(standard_train(features, o).select("idx", "z"), coefficients, o.horizon, "z", zmean, zstd, "prediction").select("idx", "prediction")
    scored = forecast.predict_har(rows, model).select("idx", "split", y, F.inline(F.array(
        F.struct(F.lit("har_logrv_compact").alias("model"), F.col("prediction").alias("prediction")), F.struct(F.lit("persistence").alias("model"), F.col(MAIN).alias("prediction")),
        F.struct(F.lit("historical_mean").alias("model"), F.lit(mean).alias("prediction")),
    ))).unionByName(rows.select("idx", "split", y).filter("split != 'train'").join(ar, "idx").withColumn("model", F.lit(f"ar{len(coefficients)}_horizon{o.horizon}")))
    vec = embedded(features, p, o).cache()  # read for the sample and the library
    ask = _sampled(vec, "test", o).cache()  # a bounded sample
    found = forecast.causal_neighbours(ask, vec.filter("split != 'test'"), k, p["theiler"], o.horizon)
    near = forecast.neighbour_means(found, [k]).select(F.col("query_idx").alias("idx"), "prediction", F.lit(f"knn_tau{p['tau']}_m{p['dim']}_k{k}").alias("model"))
    sample = scored.filter("split = 'test'").join(ask.select("idx"), "idx").select("idx", "y", "model", "prediction")
    sample = sample.unionByName(ask.select("idx", F.col("target").alias("y")).join(near, "idx"))
    full = forecast.metrics(scored.withColumn("split", F.concat("split", F.lit("_full"))), ["split", "model"], mean)
    comparable = forecast.metrics(sample.withColumn("split", F.lit("test_knn_comparable_sample")), ["split", "model"], mean).cache()  # five rows
    recent, tested, latest = forecast.recent_mode(features, recent_rows, purge=o.horizon)
    spark = features.sparkSession
    both = full.filter("split IN ('train_full', 'validation_full')").unionByName(comparable).filter("model = 'har_logrv_compact'")
    best = {r["split"].split("_")[0]: r["rmse"] for r in both.collect()}  # three rows
    return forecast.artifact(model, "har_logrv", "1", "", best), {
        "phase14_har_coefficients": forecast.coefficient_table(spark, model),
        "phase14_validation_metrics": full.filter("split = 'validation_full'"),
        "phase14_test_metrics": comparable.unionByName(full.filter("split = 'test_full'")),
        "phase14_model_comparison": forecast.comparison(comparable, "har_logrv_compact"),
        "phase14_predictions_test": scored.filter("split = 'test'").withColumn("error", F.col("prediction") - F.col("y")),
        "phase14_mvp_1000_mode_summary": forecast.metrics(tested, [], mean, forecast.HAR_TARGET).withColumns({"n_train": F.lit(recent["n_train"]), "last_forecast": F.lit(float(latest.first()["prediction"]))}),
    }
