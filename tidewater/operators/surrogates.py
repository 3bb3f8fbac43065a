"""Surrogate series and the comparison of statistics with them; a task for each replicate."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import special
from tidewater.operators.dynamics import rosenstein
from tidewater.operators.ordering import evenly_spaced
from tidewater.session import ship

STATISTICS = ["d2", "lyapunov_slope_per_step", "lyapunov_slope_per_hour", "permutation_entropy_delay_1", "permutation_entropy_delay_tau"]
#: Sizes of the samples and fits of the statistics.
DEFAULTS = {"corr_sample": 600, "radii": 30, "block": 1500, "references": 300, "steps": 30, "fit": (1, 30), "order": 5}


def phases(n: int, rng: random.Random) -> np.ndarray:
    """Drawn one after the other from the standard generator, so a seed gives the same surrogate everywhere."""
    return np.array([rng.uniform(0.0, 2.0 * math.pi) for _ in range(1, n // 2)])


def phase_randomised(x: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The same power at every frequency under other phases; the length must be a power of two."""
    n = len(x)
    if n & (n - 1):
        raise ValueError("the length must be a power of two")
    f = np.fft.rfft(np.asarray(x, float))
    f[1:-1] = np.abs(f[1:-1]) * np.exp(1j * drawn)
    f[0], f[-1] = f[0].real, f[-1].real
    return np.fft.irfft(f, n)


def gaussianised(x: np.ndarray) -> np.ndarray:
    """The normal quantile of (rank + 0.5) / n, ties by place."""
    rank = np.empty(len(x), int)
    rank[np.argsort(x, kind="stable")] = np.arange(len(x))
    return np.array([special.inverse_normal((r + 0.5) / len(x)) for r in rank])


def aaft(x: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The values of x in the order of a phase-randomised gaussian copy."""
    order = np.argsort(phase_randomised(gaussianised(np.asarray(x, float)), drawn), kind="stable")
    out = np.empty(len(x))
    out[order] = np.sort(x)
    return out


def ordinal_entropy(x: np.ndarray, order: int, delay: int) -> float:
    n = len(x) - (order - 1) * delay
    if n <= 0:
        return math.nan
    vec = np.column_stack([x[k * delay : k * delay + n] for k in range(order)])
    codes = np.argsort(vec, axis=1, kind="stable") @ (order ** np.arange(order))
    p = np.array(list(Counter(codes.tolist()).values())) / n
    return float(-(p * np.log(p)).sum() / math.log(math.factorial(order)))


def correlation_dimension(x: np.ndarray, tau: int, dim: int, theiler: int, sample: int, steps: int) -> float:
    n = len(x) - (dim - 1) * tau
    at = np.array(evenly_spaced(n, sample))
    vec = np.column_stack([x[(dim - 1 - k) * tau + at] for k in range(dim)])
    d = np.sqrt(((vec[:, None, :] - vec[None, :, :]) ** 2).sum(axis=2))
    d = np.sort(d[(at[None, :] - at[:, None]) > theiler])
    positive = d[d > 0]
    a, b = np.quantile(positive, [0.01, 0.70])
    r = np.exp(np.linspace(math.log(a), math.log(b), steps))
    c = np.searchsorted(d, r, "left") / len(d)
    with np.errstate(divide="ignore", invalid="ignore"):
        lr, lc = np.log(r), np.log(c)
        slope = (lc[2:] - lc[:-2]) / (lr[2:] - lr[:-2])
    used = slope[(c[1:-1] >= 0.02) & (c[1:-1] <= 0.25) & (slope > 0)]
    return float(np.median(used)) if len(used) else math.nan


def statistics(x: np.ndarray, tau: int, dim: int, theiler: int, **sizes) -> dict[str, float]:
    """The five statistics of a window; one that can't be computed is NaN and counts as a failure."""
    o = DEFAULTS | sizes

    def tried(f) -> float:
        try:
            return float(f())
        except (ValueError, IndexError, ZeroDivisionError, FloatingPointError):
            return math.nan

    def slope() -> float:
        n = len(x) - (dim - 1) * tau
        start = max(0, n // 2 - o["block"] // 2)
        part = x[start : start + min(o["block"], n - start) + (dim - 1) * tau]
        usable = len(part) - (dim - 1) * tau - o["steps"]
        curve = rosenstein(part, tau, dim, theiler, o["steps"], evenly_spaced(usable, min(o["references"], usable)))
        used = [r for r in curve if o["fit"][0] <= r["k"] <= o["fit"][1]]
        return special.line([r["k"] for r in used], [r["mean_log_distance"] for r in used])[0]

    step = tried(slope)
    return {
        "d2": tried(lambda: correlation_dimension(x, tau, dim, theiler, o["corr_sample"], o["radii"])),
        "lyapunov_slope_per_step": step,
        "lyapunov_slope_per_hour": step * 12.0,
        "permutation_entropy_delay_1": tried(lambda: ordinal_entropy(x, o["order"], 1)),
        "permutation_entropy_delay_tau": tried(lambda: ordinal_entropy(x, o["order"], tau)),
    }


def replicates(spark: SparkSession, window: list[float], counts: dict[str, int], seed: int, tau: int, dim: int, theiler: int, **sizes) -> DataFrame:
    """(kind, replicate, statistic..., of the original and of every surrogate): kinds shuffled, phase, aaft.

    One generator feeds them in order, so what each replicate needs (a permutation or phases) is drawn on
    the driver and shipped; the work runs a replicate a task.
    """
    ship(spark)
    rng = random.Random(seed)
    jobs = [("original", 0, [])]
    n = len(window)
    for kind in ("shuffled", "phase", "aaft"):
        for i in range(counts.get(kind, 0)):
            if kind == "shuffled":
                order = list(range(n))
                rng.shuffle(order)
                jobs.append((kind, i, [float(k) for k in order]))
            else:
                jobs.append((kind, i, phases(n, rng).tolist()))
    sent = spark.sparkContext.broadcast(np.asarray(window, float))

    def run(parts):
        for part in parts:
            rows = []
            for kind, i, drawn in zip(part["kind"], part["replicate"], part["drawn"], strict=True):
                x, d = sent.value, np.asarray(drawn, float)
                made = x if kind == "original" else x[d.astype(int)] if kind == "shuffled" else phase_randomised(x, d) if kind == "phase" else aaft(x, d)
                rows.append({"kind": kind, "replicate": i, **statistics(made, tau, dim, theiler, **sizes)})
            yield pd.DataFrame(rows)

    todo = spark.createDataFrame(jobs, "kind string, replicate long, drawn array<double>").repartition(max(1, len(jobs)))
    return todo.mapInPandas(run, "kind string, replicate long, " + ", ".join(f"{s} double" for s in STATISTICS))


def long_statistics(made: DataFrame) -> DataFrame:
    """(kind, replicate, statistic, value); what failed is null."""
    parts = F.array(*[F.struct(F.lit(s).alias("statistic"), F.when(~F.isnan(s), F.col(s)).alias("value")) for s in STATISTICS])
    return made.select("kind", "replicate", F.inline(parts))


def summary(long: DataFrame, original: str = "original") -> DataFrame:
    """Per kind and statistic: moments and quantiles of the replicates, S = |original - mean| / std, and the
    share p = (1 + as far from the mean) / (n + 1)."""
    own = long.filter(F.col("kind") == original).select("statistic", F.col("value").alias("original"))
    rest = long.filter(F.col("kind") != original)
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    base = rest.groupBy("kind", "statistic").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.when(F.count("value") > 0, F.lit(0.0))).alias("std"), F.min("value").alias("min"),
        q[0].alias("p05"), q[1].alias("median"), q[2].alias("p95"), F.max("value").alias("max"),
        F.count("value").alias("n_success"), F.count_if(F.col("value").isNull()).alias("n_failures"),
    ).join(own, "statistic", "left")
    far = F.abs(F.col("value") - F.col("mean")) >= F.abs(F.col("original") - F.col("mean"))
    extreme = rest.join(base.select("kind", "statistic", "mean", "original"), ["kind", "statistic"]).groupBy("kind", "statistic").agg(F.count_if(far).alias("_e"))
    usable = (F.col("std") > 0) & F.col("original").isNotNull()
    return base.join(extreme, ["kind", "statistic"]).withColumns(
        {"S": F.when(usable, F.abs(F.col("original") - F.col("mean")) / F.col("std")), "p_value": F.when(usable, (1 + F.col("_e")) / (F.col("n_success") + 1))}
    ).drop("_e")
