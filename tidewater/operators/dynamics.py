"""Invariants and tests of nonlinear dynamics: correlation sums, divergence rates, recurrence, BDS."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.functions import special
from tidewater.operators.describe import quantiles
from tidewater.operators.embedding import nearest
from tidewater.operators.neighbours import epsilon_of_rate, near_pairs
from tidewater.session import ship


def pair_distances(vectors: DataFrame, theiler: int, vec: str = "vec") -> DataFrame:
    """(i, j, d) of a bounded sample of vectors: i < j more than ``theiler`` apart."""
    a = vectors.select(F.col("idx").alias("i"), F.col(vec).alias("_a"))
    b = vectors.select(F.col("idx").alias("j"), F.col(vec).alias("_b"))
    return a.join(b, F.col("j") - F.col("i") > theiler).select("i", "j", F.sqrt(S.distance_sq(F.col("_a"), F.col("_b"))).alias("d"))


def radii(distances: DataFrame, steps: int, low_q: float = 0.01, high_q: float = 0.70) -> list[float]:
    """Log-spaced radii between two quantiles of the distances above 0."""
    a, b = quantiles(distances.filter("d > 0"), "d", [low_q, high_q])
    return np.exp(np.linspace(math.log(a), math.log(b), steps)).tolist() if steps > 1 else [a]


def correlation_sums(distances: DataFrame, at: list[float]) -> DataFrame:
    """(k, radius, below, pairs, c, log_r, log_c, slope): share of distances under each radius, local slopes by
    central differences. A pass that counts each distance once, in its bin; the bins are summed up."""
    edges = F.array(*[F.lit(float(r)) for r in at])
    binned = distances.withColumn("k", F.size(F.filter(edges, lambda r: r <= F.col("d")))).groupBy("k").agg(F.count("*").alias("n"))
    spark = distances.sparkSession
    every = spark.range(1).select(F.posexplode(edges).alias("pos", "radius"))
    w = Window.orderBy("pos")  # as many rows as radii
    total = binned.agg(F.sum("n").alias("pairs"))
    curve = every.join(F.broadcast(binned), F.col("k") <= F.col("pos"), "left").groupBy("pos", "radius").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("below")).crossJoin(F.broadcast(total))
    curve = curve.withColumn("c", F.col("below") / F.col("pairs")).withColumns({"log_r": F.log("radius"), "log_c": F.when(F.col("c") > 0, F.log("c"))})
    slope = (F.lead("log_c").over(w) - F.lag("log_c").over(w)) / (F.lead("log_r").over(w) - F.lag("log_r").over(w))
    return curve.withColumn("slope", slope).withColumnRenamed("pos", "k")


def correlation_dimension(curve: DataFrame, low: float = 0.02, high: float = 0.25) -> DataFrame:
    """(d2, slope_std, points, plateau): median slope in the scaling range; a plateau has five points and little spread."""
    used = curve.filter((F.col("c") >= low) & (F.col("c") <= high) & (F.col("slope") > 0))
    out = used.agg(F.median("slope").alias("d2"), F.coalesce(F.stddev_samp("slope"), F.lit(0.0)).alias("slope_std"), F.count("*").alias("points"))
    return out.withColumn("plateau", (F.col("points") >= 5) & (F.col("slope_std") <= F.greatest(F.lit(0.2) * F.abs("d2"), F.lit(0.15))))


def nearest_neighbours(vectors: DataFrame, theiler: int, vec: str = "vec") -> DataFrame:
    """(i, j, d): the nearest other vector more than ``theiler`` away, the first of equals; of a bounded sample."""
    a = vectors.select(F.col("idx").alias("i"), F.col(vec).alias("_a"))
    b = vectors.select(F.col("idx").alias("j"), F.col(vec).alias("_b"))
    pairs = a.join(b, F.abs(F.col("i") - F.col("j")) > theiler).select("i", F.struct(F.sqrt(S.distance_sq(F.col("_a"), F.col("_b"))).alias("d"), "j").alias("p"))
    return pairs.groupBy("i").agg(F.min("p").alias("p")).select("i", F.col("p.j").alias("j"), F.col("p.d").alias("d"))


def divergence(vectors: DataFrame, neighbours: DataFrame, steps: int, vec: str = "vec") -> DataFrame:
    """(k, pairs, mean_log_distance): neighbours followed k steps on; distances of 1e-12 and less are left out."""
    k = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    ahead = neighbours.select("i", "j", k).select("k", (F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k")).alias("j"))
    a = vectors.select(F.col("idx").alias("i"), F.col(vec).alias("_a"))
    b = vectors.select(F.col("idx").alias("j"), F.col(vec).alias("_b"))
    d = ahead.join(a, "i").join(b, "j").select("k", F.sqrt(S.distance_sq(F.col("_a"), F.col("_b"))).alias("d")).filter("d > 1e-12")
    return d.groupBy("k").agg(F.count("*").alias("pairs"), F.avg(F.log("d")).alias("mean_log_distance"))


def line_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, r2, points; null without two points or spread in x, r2 null without spread in y."""
    flat_x, flat_y = (F.var_pop(x) == 0) | (F.count(x) < 2), F.var_pop(y) == 0
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(by or [])).agg(
        F.when(~flat_x, F.regr_slope(y, x)).alias("slope"), F.when(~flat_x, F.regr_intercept(y, x)).alias("intercept"),
        F.when(~flat_x & ~flat_y, F.regr_r2(y, x)).alias("r2"), F.count("*").alias("points"),
    )


def lyapunov(curve: DataFrame, first: int, last: int, per_hour: float = 12.0, by: list[str] | None = None) -> DataFrame:
    """Slope of the divergence curve between two steps, per step and per hour."""
    fit = line_fit(curve.filter(F.col("k").between(first, last)), "k", "mean_log_distance", by)
    return fit.withColumn("slope_per_hour", F.col("slope") * per_hour)


# ---------------------------------------------------------------- recurrence


def recurrence_rate(sorted_x: np.ndarray, eps: float) -> float:
    """Share of ordered pairs at most eps apart, the diagonal included."""
    n = len(sorted_x)
    near = np.searchsorted(sorted_x, sorted_x + eps, "right") - np.arange(n)
    return float(2 * near.sum() - n) / (n * n)


def recurrence_epsilon(x: np.ndarray, target: float = 0.05, steps: int = 50) -> tuple[float, float]:
    """The distance whose recurrence rate is the target, by bisection, and the rate it has."""
    s = np.sort(np.asarray(x, float))
    low, high = 0.0, float(s[-1] - s[0])
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if recurrence_rate(s, mid) < target else (low, mid)
    return high, recurrence_rate(s, high)


def recurrence(windows: DataFrame, value: str = "x", by: str = "window", target: float = 0.05) -> DataFrame:
    """(window, n, mean, std, epsilon, rate) of each window's z-scores; a window is a few thousand rows by design."""
    ship(windows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("idx")[value].to_numpy()
        mean, std = float(x.mean()), float(x.std(ddof=1)) if len(x) > 1 else 0.0
        eps, rate = recurrence_epsilon((x - mean) / std if std > 0 else np.zeros(len(x)), target)
        return pd.DataFrame([{by: part[by].iloc[0], "n": len(x), "mean": mean, "std": std, "epsilon": eps, "rate": rate}])

    return windows.select(by, "idx", value).groupBy(by).applyInPandas(run, f"{by} string, n long, mean double, std double, epsilon double, rate double")


def recurrence_counts(df: DataFrame, eps: float, value: str = "x") -> DataFrame:
    """(n, recurrent, rate) of a series of any length (see ``neighbours.near_pairs``)."""
    return near_pairs(df, eps, value)


def series_epsilon(df: DataFrame, target: float = 0.05, value: str = "x") -> DataFrame:
    """(n, mean, std, epsilon, rate) of the z-scores of a series of any length (see ``neighbours.epsilon_of_rate``)."""
    return epsilon_of_rate(df, target, value)


def recurrence_image(x: np.ndarray, eps: float) -> bytes:
    """The recurrence plot of a window as a grey PNG, recurrent points black."""
    import struct
    import zlib

    z = np.asarray(x, float)
    near = np.abs(z[:, None] - z[None, :]) <= eps
    rows = b"".join(b"\0" + r.tobytes() for r in np.where(near, 0, 255).astype(np.uint8))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(z), len(z), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


# ---------------------------------------------------------------- BDS and shuffles


def bds(x: np.ndarray, dims: list[int], factors: list[float]) -> list[dict]:
    """The statistic for each embedding dimension and radius (a factor of the sample std), z-scored input."""
    z = np.asarray(x, float)
    sd = z.std(ddof=1)
    z = (z - z.mean()) / sd if sd > 0 else np.zeros(len(z))
    n, out = len(z), []
    for factor in factors:
        near = np.abs(z[:, None] - z[None, :]) <= factor
        np.fill_diagonal(near, False)
        degree = near.sum(axis=1).astype(float)
        c = float(degree.sum()) / (n * (n - 1))
        k = float((degree * degree).sum() - degree.sum()) / (n * (n - 1) * (n - 2))
        for m in dims:
            size = n - m + 1
            both = near[:size, :size].copy()
            for s in range(1, m):
                both &= near[s : s + size, s : s + size]
            cm = float(both.sum()) / (size * (size - 1))
            tail = near[m - 1 :, m - 1 :]
            c1 = float(tail.sum()) / (size * (size - 1))
            var = 4 * (k**m + 2 * sum(k ** (m - j) * c ** (2 * j) for j in range(1, m)) + (m - 1) ** 2 * c ** (2 * m) - m * m * k * c ** (2 * m - 2))
            stat = math.sqrt(size) * (cm - c1**m) / math.sqrt(var) if var > 0 else math.nan
            out.append({"dim": m, "factor": factor, "c1": c1, "cm": cm, "k": k, "variance": var, "statistic": stat, "p_value": special.normal_two_sided(stat)})
    return out


def bds_by(windows: DataFrame, dims: list[int], factors: list[float], value: str = "x", by: str = "window", tile: int = 1024) -> DataFrame:
    """The test on every window, of any length, in tiles of ``tile`` rows by ``tile`` columns of the indicator of near pairs.

    A tile needs its rows and columns and the ``max(dims) - 1`` positions that follow; its memory doesn't depend on the window, and
    tiles of the lower half are those of the upper one turned. Spark adds up the tiles' counts: near pairs for each dimension, and
    near values of each position, whose squares give k. A window of fewer than ``max(dims)`` rows is an error; a sum over
    fewer than two vectors is 0, and statistic and p-value are null where the variance isn't above 0.
    """
    spark = ship(windows.sparkSession)
    halo = max(dims) - 1
    moments = windows.groupBy(F.col(by).alias("_w")).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"), F.min("idx").alias("_first"))
    short = moments.filter(F.col("_n") <= halo).first()
    if short:
        raise ValueError(f"window {short['_w']} has {short['_n']} rows, dimension {max(dims)} needs as many")
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    at = windows.join(F.broadcast(moments), F.col(by).eqNullSafe(F.col("_w"))).select("_w", "_n", (F.col("idx") - F.col("_first")).alias("_i"), z.alias("_z"))  # a row a window
    seen = F.sequence(F.floor(F.greatest(F.col("_i") - halo, F.lit(0)) / tile), F.floor(F.col("_i") / tile))
    packed = at.withColumn("_a", F.explode(seen)).groupBy("_w", "_n", "_a").agg(F.array_sort(F.collect_list(F.struct("_i", "_z")))["_z"].alias("za"))  # tile + halo values
    others = packed.select(F.col("_w").alias("_v"), F.col("_a").alias("_b"), F.col("za").alias("zb"))
    tiles = packed.join(others, F.col("_w").eqNullSafe(F.col("_v")) & (F.col("_a") <= F.col("_b"))).select("_w", "_n", "_a", "_b", "za", "zb")
    tiles = tiles.repartition(spark.sparkContext.defaultParallelism * 2, "_w", "_a", "_b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for t in part.itertuples(index=False, name=None):
                for factor in factors:
                    yield _tile_counts(t, factor, dims, tile)

    counts = tiles.mapInPandas(run, "w string, factor double, m int, i long, s long").groupBy("w", "factor", "m", "i").agg(F.sum("s").alias("s"))
    d, sums = F.when(F.col("m") == 0, F.col("s").cast("double")), lambda m: F.coalesce(F.sum(F.when(F.col("m") == m, F.col("s"))), F.lit(0)).cast("double")
    row = counts.groupBy("w", "factor").agg(F.sum(d).alias("_d"), F.sum(d * d - d).alias("_dd"), *[sums(m).alias(f"_cm{m}") for m in dims], *[sums(-m).alias(f"_c1{m}") for m in dims])
    row = row.join(F.broadcast(moments.select(F.col("_w"), F.col("_n").cast("double").alias("n"))), F.col("w").eqNullSafe(F.col("_w")))
    n, share = F.col("n"), lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    row = row.withColumns({"c": share(F.col("_d"), n * (n - 1)), "k": share(F.col("_dd"), n * (n - 1) * (n - 2))})
    c, k = F.col("c"), F.col("k")

    def variance(m: int) -> Column:
        total = F.lit(0.0)
        for j in range(1, m):
            total = total + F.pow(k, F.lit(m - j)) * F.pow(c, F.lit(2 * j))
        return 4 * (F.pow(k, F.lit(m)) + 2 * total + (m - 1) ** 2 * F.pow(c, F.lit(2 * m)) - m * m * k * F.pow(c, F.lit(2 * m - 2)))

    pairs = lambda m: (n - m + 1) * (n - m)
    parts = [F.struct(F.lit(m).cast("long").alias("dim"), share(F.col(f"_c1{m}"), pairs(m)).alias("c1"), share(F.col(f"_cm{m}"), pairs(m)).alias("cm"), variance(m).alias("variance")) for m in dims]
    out = row.select(F.col("w").alias(by), "factor", "n", "k", F.inline(F.array(*parts)))
    stat = F.when(F.col("variance") > 0, F.sqrt(n - F.col("dim") + 1) * (F.col("cm") - F.pow("c1", "dim")) / F.sqrt("variance"))
    out = out.withColumn("statistic", stat).withColumn("p_value", special.normal_two_sided_udf(F.col("statistic")))
    return out.select("dim", "factor", "c1", "cm", "k", "variance", "statistic", "p_value", by).withColumn("decision", S.verdict(F.col("p_value")))


def _tile_counts(t: tuple, factor: float, dims: list[int], tile: int) -> pd.DataFrame:
    """Counts (w, factor, m, i, s) of a tile: m above 0 near pairs of vectors, below 0 of last values, 0 near values of position i."""
    w, n, a, b, za, zb = t
    at, to = a * tile + np.arange(len(za)), b * tile + np.arange(len(zb))
    near = np.abs(np.asarray(za)[:, None] - np.asarray(zb)[None, :]) <= factor
    if a == b:
        np.fill_diagonal(near, False)
    rows, cols = min(tile, len(za)), min(tile, len(zb))
    twice = 1 if a == b else 2
    out = []
    for m in dims:
        r, q = min(rows, len(za) - m + 1), min(cols, len(zb) - m + 1)
        if r > 0 and q > 0:
            both = near[:r, :q]
            for step in range(1, m):
                both = both & near[step : step + r, step : step + q]
            out.append((m, -1, twice * int(both.sum())))
        late = near[:rows, :cols][at[:rows] >= m - 1][:, to[:cols] >= m - 1]
        out.append((-m, -1, twice * int(late.sum())))
    own = near[:rows, :cols]
    made = [pd.DataFrame(out, columns=["m", "i", "s"]), pd.DataFrame({"m": 0, "i": at[:rows], "s": own.sum(axis=1)})]
    if a != b:
        made.append(pd.DataFrame({"m": 0, "i": to[:cols], "s": own.sum(axis=0)}))
    return pd.concat(made).assign(w=w, factor=factor)[["w", "factor", "m", "i", "s"]]


def squared_acf(x: np.ndarray, lag: int) -> float:
    """Autocorrelation of the squares at one lag; 0 for a flat series."""
    s = np.asarray(x, float) ** 2
    s = s - s.mean()
    total = float(s @ s)
    return float(s[lag:] @ s[:-lag]) / total if total > 0 else 0.0


def shuffle_comparison(windows: DataFrame, marks: list[int], replicates: int, seed: int, value: str = "x", by: str = "window") -> DataFrame:
    """(window, lag, original, mean, std, percentile): against permutations, each a shuffle of the one before it."""
    import random

    ship(windows.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("idx")[value].to_list()
        own = {m: squared_acf(x, m) for m in marks}
        rng, found = random.Random(seed), {m: [] for m in marks}
        for _ in range(replicates):
            rng.shuffle(x)
            for m in marks:
                found[m].append(squared_acf(x, m))
        rows = [{by: part[by].iloc[0], "lag": m, "original": own[m], "mean": float(np.mean(v)), "std": float(np.std(v, ddof=1)), "percentile": float(np.mean(np.array(v) <= own[m]))} for m, v in found.items()]
        return pd.DataFrame(rows)

    return windows.select(by, "idx", value).groupBy(by).applyInPandas(run, f"{by} string, lag long, original double, mean double, std double, percentile double")


def rosenstein(x: np.ndarray, tau: int, dim: int, theiler: int, steps: int, sample: list[int] | None = None) -> list[dict]:
    """The divergence curve of one series in memory, over all or sampled reference points."""
    n = len(x) - (dim - 1) * tau
    vec = np.column_stack([x[(dim - 1 - k) * tau : (dim - 1 - k) * tau + n] for k in range(dim)])
    usable = n - steps
    if usable < 2:
        return []
    who, _ = nearest(vec[:usable], np.arange(usable), theiler)
    refs = np.arange(usable) if sample is None else np.array([s for s in sample if s < usable])
    refs = refs[who[refs] >= 0]
    out = []
    for k in range(steps + 1):
        d = np.sqrt(((vec[refs + k] - vec[who[refs] + k]) ** 2).sum(axis=1))
        d = d[d > 1e-12]
        out.append({"k": k, "pairs": len(d), "mean_log_distance": float(np.log(d).mean()) if len(d) else math.nan})
    return out
