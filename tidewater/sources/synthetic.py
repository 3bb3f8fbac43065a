"""The logistic map and its noisy observations: a series whose invariants are known."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the control experiment.
R, X0, TOTAL, BURN_IN, SEED = 4.0, 0.123456789, 12_000, 1_000, 20260603
NOISE = {"clean": 0.0, "small_noise": 0.01, "moderate_noise": 0.05}


def logistic_map(r: float = R, x0: float = X0, total: int = TOTAL, burn_in: int = BURN_IN) -> list[float]:
    """x' = r * x * (1 - x), in this order of operations: a chaotic orbit follows every bit of it."""
    out, x = [], x0
    for i in range(total):
        if i >= burn_in:
            out.append(x)
        x = r * x * (1.0 - x)
    return out


def observed(clean: list[float], sigma: float, seed: int) -> tuple[list[float], int]:
    """Gaussian noise cut to [0, 1], and how often it was cut."""
    rng = random.Random(seed)
    noisy = [v + rng.gauss(0.0, sigma) for v in clean]
    return [min(1.0, max(0.0, v)) for v in noisy], sum(v < 0.0 or v > 1.0 for v in noisy)


def bundle(**options) -> dict[str, tuple[list[float], int]]:
    """Clean, small and moderate noise (1 and 5 per cent of the sample std, seeds one and two on): values, cuts."""
    clean = logistic_map(**options)
    spread = statistics.stdev(clean)
    out = {"clean": (clean, 0)}
    for i, name in enumerate(("small_noise", "moderate_noise"), 1):
        out[name] = observed(clean, NOISE[name] * spread, SEED + i)
    return out


def series(spark: SparkSession, **options) -> DataFrame:
    """(series, idx, x) of the bundle; made in order on the driver, for each value needs the one before it."""
    rows = [(name, i, x) for name, (values, _) in bundle(**options).items() for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "series string, idx bigint, x double")
