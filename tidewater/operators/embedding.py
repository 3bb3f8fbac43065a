"""State-space reconstruction: delay vectors, mutual information, false neighbours, and the choices made."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.operators.describe import grouped_quantiles, quantiles
from tidewater.operators.ordering import dense_index, evenly_spaced, with_halo
from tidewater.session import ship


def delay_embedding(df: DataFrame, tau: int, dim: int, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """vec = [z(t), z(t - tau), ...] on the whole series, so vectors may reach into an earlier split;
    rows without all of it go. Filter a split afterwards, not before."""
    wide = with_halo(df, lambda w: {"vec": F.array(*[F.lag(value, k * tau).over(w) for k in range(dim)])}, past=(dim - 1) * tau, by=by)
    return wide.filter(~F.exists("vec", lambda v: v.isNull()))


def quantile_edges(df: DataFrame, bins: int, value: str = "x", by: list[str] | None = None) -> DataFrame:
    """The bins - 1 inner edges, interpolated; no buffer holds the values of a series."""
    if not by:
        return df.sparkSession.createDataFrame([(quantiles(df, value, [i / bins for i in range(1, bins)]),)], "edges array<double>")
    return grouped_quantiles(df, value, [i / bins for i in range(1, bins)], by, "edges")


def discretised(df: DataFrame, bins: int, value: str = "x", by: list[str] | None = None) -> DataFrame:
    edges = quantile_edges(df, bins, value, by)  # a row a series
    joined = df.join(F.broadcast(edges), by) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("code", S.bin_code(F.col(value), F.col("edges"))).drop("edges")


def mutual_information(coded: DataFrame, taus: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, tau, pairs, ami): average mutual information of the codes tau apart, in nats.

    One exchange for the lags; the joint counts of a lag are at most bins squared.
    """
    wide = with_halo(coded.select(*by, "idx", "code"), lambda w: {"_pairs": F.array(*[F.struct(F.lit(t).alias("tau"), F.lag("code", t).over(w).alias("a")) for t in taus])}, past=max(taus), by=by)
    joint = wide.select(*by, F.col("code").alias("b"), F.explode("_pairs").alias("p")).select(*by, "b", "p.tau", "p.a").filter("a IS NOT NULL").groupBy(*by, "tau", "a", "b").agg(F.count("*").alias("n"))
    total = lambda *keys: F.sum("n").over(Window.partitionBy(*by, "tau", *keys))
    shares = joint.withColumns({"_n": total(), "_a": total("a"), "_b": total("b")})
    term = F.col("n") / F.col("_n") * F.log(F.col("n") * F.col("_n") / (F.col("_a") * F.col("_b")))
    return shares.groupBy(*by, "tau").agg(F.sum("n").alias("pairs"), F.sum(term).alias("ami"))


def shuffled(df: DataFrame, value: str, seed: int) -> DataFrame:
    """(idx, value): the same values in an order drawn from ``seed``; for a null curve. Ranked in blocks, both times."""
    drawn = df.select(value, F.col("idx").alias("_i"), F.xxhash64("idx", F.lit(seed)).alias("_h"))
    places = dense_index(df.select("idx"), F.floor(F.col("idx") / 65_536), ["idx"], "_k")
    return places.join(dense_index(drawn, F.shiftright("_h", 52), ["_h", "_i"], "_k").select(value, "_k"), "_k").select("idx", value)


def shuffled_codes(coded: DataFrame, seed: int) -> DataFrame:
    return shuffled(coded, "code", seed)


def tau_from_ami(curve: list[float]) -> int:
    """1-based lag: the first local minimum (strict on the left), else the elbow farthest from the chord
    (of a flat curve the first lag)."""
    for i in range(1, len(curve) - 1):
        if curve[i] < curve[i - 1] and curve[i] <= curve[i + 1]:
            return i + 1
    n = len(curve)
    if n < 3:
        return 1
    span = math.hypot(n - 1, curve[-1] - curve[0])
    far = [abs((curve[-1] - curve[0]) * i - (n - 1) * (curve[i] - curve[0])) / span for i in range(n)]
    return max(range(n), key=lambda i: (far[i], -i)) + 1


def tau_operational(curve: list[float]) -> int:
    """The first local minimum, else 1."""
    return next((i + 1 for i in range(1, len(curve) - 1) if curve[i] < curve[i - 1] and curve[i] <= curve[i + 1]), 1)


# ---------------------------------------------------------------- false neighbours


def nearest(points: np.ndarray, places: np.ndarray, theiler: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest other point with |place difference| > theiler, first of equals; -1 where there is none. Blocked."""
    n = len(points)
    who, dist = np.full(n, -1), np.full(n, np.inf)
    for a in range(0, n, 512):
        b = min(n, a + 512)
        d = np.zeros((b - a, n))
        for j in range(points.shape[1]):
            d += (points[a:b, j, None] - points[None, :, j]) ** 2
        d[np.abs(places[a:b, None] - places[None, :]) <= theiler] = np.inf
        k = d.argmin(axis=1)
        dist[a:b] = d[np.arange(b - a), k]
        who[a:b] = np.where(np.isfinite(dist[a:b]), k, -1)
    return who, np.sqrt(dist)


def false_neighbours(z: np.ndarray, tau: int, max_dim: int, size: int, theiler: int, rtol: float = 10.0, atol: float = 2.0, dims: list[int] | None = None) -> list[dict]:
    """For each dimension: false neighbours by both criteria, and the mean distance ratios E and E*.

    The sample is evenly spaced from the first place that has max_dim + 1 delays.
    """
    first = max_dim * tau + tau
    places = np.array(evenly_spaced(len(z) - first, size, first), np.int64)
    delays = np.array([z[places - k * tau] for k in range(max_dim + 2)])
    return false_in_sample(places, delays, float(np.std(z, ddof=1)), theiler, rtol, atol, dims or range(1, max_dim + 2))


def false_in_sample(places: np.ndarray, delays: np.ndarray, sigma: float, theiler: int, rtol: float, atol: float, dims) -> list[dict]:
    """The same from a sample: its places, the values at each delay of them, and the std of the whole series."""
    out = []
    for m in dims:
        vec = delays[:m].T
        extra = delays[m] if m < len(delays) else None
        who, dist = nearest(vec, places, theiler)
        ok = who >= 0
        row = {"dim": m, "valid": int(ok.sum()), "false": 0, "E": math.nan, "E_star": math.nan}
        if extra is not None and ok.any():
            delta = np.abs(extra[ok] - extra[who[ok]])
            d = dist[ok]
            up = np.sqrt(d * d + delta * delta)
            wrong = (delta / np.maximum(d, 1e-12) > rtol) | (up / max(sigma, 1e-12) > atol)
            row |= {"false": int(wrong.sum()), "E": float(np.mean(up / np.maximum(d, 1e-12))), "E_star": float(delta.mean())}
        out.append(row)
    return out


def fnn_and_cao(df: DataFrame, tau: int, max_dim: int, size: int, theiler: int, rtol: float = 10.0, atol: float = 2.0, value: str = "z") -> DataFrame:
    """(dim, valid, false, fraction, E, E_star, E1, E2): one task a dimension over a bounded sample of the series.

    Only the sample and its delays leave the series: size * (max_dim + 2) values.
    """
    spark = ship(df.sparkSession)
    first = (max_dim + 1) * tau
    n, sigma = df.agg(F.max("idx") + 1, F.stddev_samp(value)).first()
    wanted = evenly_spaced(max(0, (n or 0) - first), size, first)
    at = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<bigint>")).alias("idx"))
    taken = delay_embedding(df.select("idx", value), tau, max_dim + 2, value).join(F.broadcast(at), "idx").select("idx", "vec").orderBy("idx").collect()
    places = np.array([r["idx"] for r in taken], np.int64)
    sent = spark.sparkContext.broadcast((places, np.array([r["vec"] for r in taken], float).reshape(-1, max_dim + 2).T.copy(), float(sigma or 0.0)))

    def run(parts):
        places, delays, sigma = sent.value
        for part in parts:
            yield pd.DataFrame([r for m in part["id"] for r in false_in_sample(places, delays, sigma, theiler, rtol, atol, [int(m)])])

    made = spark.range(1, max_dim + 2, numPartitions=max_dim + 1).mapInPandas(run, "dim long, valid long, false long, E double, E_star double")
    w = Window.orderBy("dim")  # a row a dimension
    return made.withColumn("fraction", F.col("false") / F.greatest(F.col("valid"), F.lit(1))).withColumns({"E1": F.lead("E").over(w) / F.col("E"), "E2": F.lead("E_star").over(w) / F.col("E_star")}).filter(F.col("dim") <= max_dim)


def dim_from_fnn(fractions: list[float], threshold: float = 0.01) -> int:
    """The first dimension under the threshold, else the one with least false neighbours."""
    return next((i + 1 for i, f in enumerate(fractions) if f <= threshold), min(range(len(fractions)), key=lambda i: fractions[i]) + 1)


def dim_from_cao(e1: list[float], tolerance: float = 0.02) -> tuple[int, bool]:
    """The first dimension, the third at least, at which E1 hardly moves on either side; else the one after the
    least move (ambiguous). Returns the dimension and whether it is ambiguous."""
    moves = [abs(b - a) for a, b in zip(e1, e1[1:], strict=False)]
    settled = next((i + 1 for i in range(2, len(e1) - 1) if max(moves[i - 1], moves[i]) <= tolerance), None)
    if settled is not None:
        return settled, False
    if len(e1) <= 2:
        return len(e1), True
    return min(range(1, len(moves)), key=moves.__getitem__) + 2, True


def dim_from_plateau(e1: list[float], within: float = 0.10, tail: int = 3) -> int:
    """The first dimension from which the whole rest of E1, three values at least, is within 10 per cent of 1;
    without one, the local rule decides."""
    start = next((i + 1 for i in range(len(e1) - tail + 1) if all(abs(v - 1) <= within for v in e1[i:])), None)
    return dim_from_cao(e1)[0] if start is None else start


def final_dim(fnn: int, cao: int, max_dim: int = 10) -> tuple[int, bool]:
    """False neighbours decide, between 2 and the largest; and whether both rules are within two of each other."""
    return max(2, min(max_dim, fnn)), abs(fnn - cao) <= 2


# ---------------------------------------------------------------- ordinal patterns


def permutation_entropy(df: DataFrame, orders: list[int], delays: list[int], value: str = "x", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, delay, patterns, entropy, normalised): ties go by offset; normalised by ln(order!)."""
    past = (max(orders) - 1) * max(delays)
    reach = sorted({k * d for o in orders for d in delays for k in range(o)})
    wide = with_halo(df.select(*by, "idx", value), lambda w: {f"_v{k}": F.lag(value, k).over(w) for k in reach}, past=past, by=by)
    def pattern(o: int, d: int) -> Column:  # oldest first
        parts = [F.struct(F.col(f"_v{(o - 1 - k) * d}").alias("v"), F.lit(k).alias("k")) for k in range(o)]
        whole = F.col(f"_v{(o - 1) * d}").isNotNull()
        return F.when(whole, F.struct(F.lit(o).alias("order"), F.lit(d).alias("delay"), F.array_join(F.transform(F.array_sort(F.array(*parts)), lambda s: s["k"].cast("string")), "").alias("pattern")))

    all_ = F.array_compact(F.array(*[pattern(o, d) for o in orders for d in delays]))
    counts = wide.select(*by, F.explode(all_).alias("p")).groupBy(*by, "p").agg(F.count("*").alias("n")).select(*by, "p.order", "p.delay", "p.pattern", "n")
    total = F.sum("n").over(Window.partitionBy(*by, "order", "delay"))
    share = counts.withColumn("_p", F.col("n") / total)
    out = share.groupBy(*by, "order", "delay").agg(F.count("*").alias("patterns"), (-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))
    return out.withColumn("normalised", F.col("entropy") / F.log(F.factorial("order").cast("double")))
