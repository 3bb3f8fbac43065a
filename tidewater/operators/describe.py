"""Descriptive statistics, exact quantiles, histograms, extremes and range tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The percentiles of the descriptive tables.
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, value: str, by: list[str] | None = None, at: str | None = None) -> DataFrame:
    """n, mean, sample std, min, percentiles, max, population skewness and excess kurtosis, and with ``at``
    the first place of the least and of the largest value. Nulls are left out. The percentiles are exact and come
    from ``grouped_quantiles``, which reads its input four times more; keep an expensive one."""
    x = F.col(value)
    flat = F.var_pop(x) == 0
    aggs = [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.when(flat, F.lit(0.0)).otherwise(F.skewness(x)).alias("skewness"), F.when(flat, F.lit(0.0)).otherwise(F.kurtosis(x)).alias("kurtosis_excess"),
    ]
    if at:
        aggs += [F.min(F.struct(x.alias("v"), F.col(at).alias("i")))["i"].alias("min_at"), F.max(F.struct(x.alias("v"), (-F.col(at)).alias("i")))["i"].alias("_max_at")]
    out = df.filter(x.isNotNull()).groupBy(*(by or [])).agg(*aggs)
    out = with_quantiles(out, grouped_quantiles(df, value, list(PERCENTILES.values()), by, "_p"), by)
    out = out.withColumns({n: F.col("_p")[i] for i, n in enumerate(PERCENTILES)}).drop("_p")
    return out.withColumn("max_at", -F.col("_max_at")).drop("_max_at") if at else out


#: Bits that a pass of ``grouped_quantiles`` settles; a group's pass has at most 2^16 counts.
DIGIT_BITS = 16


def grouped_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, name: str = "q", weight: str | None = None) -> DataFrame:
    """(by..., name array<double>): exact interpolated quantiles of every group, by radix selection.

    A double's bits, with those of negative ones turned round, are a 64-bit number of the same order. Each of four passes
    counts, for all groups and wanted ranks at once, the rows that share a rank's settled digits by their next 16 bits, and
    so settles these. Counts are added up before they are shuffled, and a group never has more than 2^16 of them for a
    settled prefix, so no buffer or task holds a group. What a pass sends on is a row for a group and a wanted prefix.

    ``weight``: a column that says how often a row counts; rows of weight 0 or null don't. Null values don't count; a group
    without values has no row (without ``by``: one row of nulls). NaN is the largest value, and -0.0 is 0.0.
    """
    keys = [f"_g{i}" for i in range(len(by or []))]
    v = F.col(value).cast("double") + F.lit(0.0)
    x = df.select(*[F.col(c).alias(k) for c, k in zip(by or [], keys, strict=True)], v.alias("_v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("_w"))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("_v")).cast("bigint")
    x = x.filter(F.col("_v").isNotNull() & (F.col("_w") > 0)).withColumn("_b", bits)
    x = x.select(*keys, "_v", "_w", F.when(F.col("_b") < 0, F.col("_b").bitwiseXOR(F.lit(2**63 - 1))).otherwise(F.col("_b")).alias("_b"))
    upto = lambda *group: F.sum("_n").over(Window.partitionBy(*group).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
    counted = [F.sum("_w").alias("_n"), F.min("_v").alias("_v")]
    state = None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        nxt = F.shiftright("_b", shift).alias("_next")
        if state is None:
            cells = x.groupBy(*keys, nxt).agg(*counted).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
            ends = [f(F.lit(q) * (F.col("_total") - 1)).cast("bigint") for q in shares for f in (F.floor, F.ceil)]
            cells = cells.withColumn("_ranks", F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ends)])).withColumn("_upto", upto(*keys))
        else:
            named = state.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_prefix", F.col("_ranks").alias("_r"), F.col("_total").alias("_t"))
            same = F.shiftright("_b", shift + DIGIT_BITS) == F.col("_prefix")
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_s{k}"))
            cells = x.join(named, same).groupBy(*keys, "_prefix", nxt).agg(*counted, F.any_value("_r").alias("_ranks"), F.any_value("_t").alias("_total"))
            cells = cells.withColumn("_upto", upto(*keys, "_prefix"))
        before = F.col("_upto") - F.col("_n")
        inside = F.filter("_ranks", lambda r: (r["r"] >= before) & (r["r"] < F.col("_upto")))  # noqa: B023
        left = F.transform(inside, lambda r: F.struct(r["i"].alias("i"), (r["r"] - before).alias("r")))  # noqa: B023
        state = cells.select(*keys, F.col("_next").alias("_prefix"), left.alias("_ranks"), "_total", "_v").filter(F.size("_ranks") > 0)
    ends = state.select(*keys, "_v", "_total", F.explode("_ranks.i").alias("_i"))
    row = ends.groupBy(*keys).agg(F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))  # two a share
    parts = []
    for i, q in enumerate(shares):
        at = F.lit(q) * (F.col("_total") - 1)
        low, high = F.element_at("_m", F.lit(2 * i)), F.element_at("_m", F.lit(2 * i + 1))
        parts.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    found = F.when(F.col("_total").isNotNull(), F.array(*parts)).alias(name)
    return row.select(*[F.col(k).alias(c) for c, k in zip(by or [], keys, strict=True)], found)


def with_quantiles(df: DataFrame, found: DataFrame, by: list[str] | None) -> DataFrame:
    """The rows of ``df``, one a group, with their group's quantiles; null where a group has none."""
    if not by:
        return df.crossJoin(F.broadcast(found))  # one row each
    named = found.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in found.columns if c not in by])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & df[c].eqNullSafe(F.col(f"_by{i}"))
    return df.join(named, same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def quantiles(df: DataFrame, value: str, shares: list[float], most: int = 100_000) -> list[float] | None:
    """Exact interpolated quantiles of a column of any size; None without a value. Nulls and NaN are left out.

    Up to ``most`` values are ranked on the driver. Of more, each wanted rank is closed in between two approximate
    quantiles whose true ranks are then counted; a bound that holds the rank itself, as with ties, ends the search, and
    an open interval of few enough rows is collected. An interval shrinks some thousandfold a round.
    """
    x = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    v = F.col("v")
    few = x.limit(most + 1).toPandas()["v"].to_numpy()
    n = len(few)
    if n == 0:
        return None
    found: dict[int, float] = {}
    if n <= most:
        few = np.sort(few)
    else:
        n = x.count()
    ranks = {k for q in shares for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    if n <= most:
        found = {k: float(few[k]) for k in ranks}
    else:
        found = _ranked_values(x, v, ranks, n, most)
    out = []
    for q in shares:
        at = q * (n - 1)
        low, high = math.floor(at), math.ceil(at)
        out.append(found[low] if low == high else (high - at) * found[low] + (at - low) * found[high])
    return out


def _ranked_values(x: DataFrame, v: Column, ranks: set[int], n: int, most: int, accuracy: int = 10_000) -> dict[int, float]:
    """The values at 0-based ranks. A rank's state: an open interval (None: no bound), the rows before it and in it."""
    found: dict[int, float] = {}
    state = {k: (None, None, 0, n) for k in ranks}

    def inside(a, b):
        return (F.lit(True) if a is None else v > a) & (F.lit(True) if b is None else v < b)

    while state:
        for k in [k for k, s in state.items() if s[3] <= most]:
            a, b, before, _ = state.pop(k)
            rows = np.sort(x.filter(inside(a, b)).toPandas()["v"].to_numpy())  # at most ``most``
            found[k] = float(rows[k - before])
        if not state:
            break
        near = lambda k, s: [min(1.0, max(0.0, (k - s[2]) / s[3] + e)) for e in (-2 / accuracy, 2 / accuracy)]
        row = x.agg(*[F.percentile_approx(F.when(inside(s[0], s[1]), v), near(k, s), accuracy).alias(str(k)) for k, s in state.items()]).first()
        bounds = {k: tuple(row[str(k)]) for k in state}
        ends = sorted({e for pair in bounds.values() for e in pair})
        counts = x.agg(*[f for i, e in enumerate(ends) for f in (F.count_if(v < e).alias(f"a{i}"), F.count_if(v == e).alias(f"b{i}"))]).first()
        less = {e: (counts[f"a{i}"], counts[f"b{i}"]) for i, e in enumerate(ends)}
        for k, (low, high) in bounds.items():
            a, b, before, size = state[k]
            past = before + size
            for e in (low, high):
                lt, eq = less[e]
                if lt <= k < lt + eq:
                    found[k] = float(e)
                elif lt + eq <= k and lt + eq >= before:
                    a, before = e, lt + eq
                elif lt > k and lt <= past:
                    b, past = e, lt
            if k in found:
                del state[k]
            else:
                state[k] = (a, b, before, past - before)
    return found


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing, min, max)."""
    row = df.agg(*[f for c in columns for f in (F.count_if(F.col(c).isNull()).alias(f"{c}__m"), F.min(c).cast("double").alias(f"{c}__a"), F.max(c).cast("double").alias(f"{c}__b"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__m").alias("missing"), F.col(f"{c}__a").alias("min"), F.col(f"{c}__b").alias("max")) for c in columns])))


def extremes(df: DataFrame, columns: list[str], at: str, context: list[str]) -> DataFrame:
    """(column_name, kind, at, value, context...): the first least and the first largest row of each column."""
    rest = [F.col(c).alias(c) for c in context]
    row = df.agg(
        *[f for c in columns for f in (
            F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("double").alias("value"), F.col(at).alias("at"), *rest))).alias(f"{c}__min"),
            F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c).cast("double")).alias("value"), F.col(at).alias("at"), *rest))).alias(f"{c}__max"),
        )]
    )
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"{c}__{k}.at").alias("at"), (F.col(f"{c}__{k}.value") * s).alias("value"), *[F.col(f"{c}__{k}.{x}").alias(x) for x in context]) for c in columns for k, s in (("min", 1), ("max", -1))]
    return row.select(F.inline(F.array(*parts)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of bins between low and high, values beyond them in the end bins; empty bins have no row."""
    width = (high - low) / bins
    k = F.floor((F.col(value) - F.lit(low)) / F.lit(width))
    return df.filter(F.col(value).isNotNull()).groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_of(df: DataFrame, value: str, bins: int, low_q: float = 0.0, high_q: float = 1.0, pad: float = 0.0) -> DataFrame:
    """(bin, low, high, n, below, above): bins over a quantile range with padding, and the tails counted apart."""
    a, b = quantiles(df, value, [low_q, high_q]) or (None, None)
    span = None if a is None else b - a
    edge = df.sparkSession.createDataFrame([(None, None) if a is None else (a - pad * span, b + pad * span)], "_a double, _b double")
    x = F.col(value)
    placed = df.filter(x.isNotNull()).crossJoin(F.broadcast(edge))  # one row
    k = F.floor((x - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins))
    return (
        placed.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int"))
        .groupBy("bin", "_a", "_b")
        .agg(F.count_if((x >= F.col("_a")) & (x <= F.col("_b"))).alias("n"), F.count_if(x < F.col("_a")).alias("below"), F.count_if(x > F.col("_b")).alias("above"))
        .select("bin", (F.col("_a") + F.col("bin") * (F.col("_b") - F.col("_a")) / bins).alias("low"), (F.col("_a") + (F.col("bin") + 1) * (F.col("_b") - F.col("_a")) / bins).alias("high"), "n", "below", "above")
    )


def halves(df: DataFrame, value: str, n: int, idx: str = "idx") -> DataFrame:
    """Mean and sample std of the first n // 2 rows and of the others."""
    x, early = F.col(value), F.col(idx) < n // 2
    return df.agg(
        F.avg(F.when(early, x)).alias("mean_first"), F.avg(F.when(~early, x)).alias("mean_second"),
        F.stddev_samp(F.when(early, x)).alias("std_first"), F.stddev_samp(F.when(~early, x)).alias("std_second"),
    )


def downsample_minmax(df: DataFrame, value: str, n: int, points: int, idx: str = "idx") -> DataFrame:
    """The first least and first largest row of each bucket, for a line chart."""
    size = -(-n // max(2, points // 2))
    keyed = df.select(idx, value).withColumn("bucket", F.floor(F.col(idx) / size))
    low, high = F.min(F.struct(value, idx)).alias("a"), F.min(F.struct((-F.col(value)).alias(value), F.col(idx))).alias("b")
    both = keyed.groupBy("bucket").agg(low, high)
    return both.select("bucket", F.explode(F.array_distinct(F.array(F.struct(F.col(f"a.{idx}").alias(idx), F.col(f"a.{value}").alias(value)), F.struct(F.col(f"b.{idx}").alias(idx), (-F.col(f"b.{value}")).alias(value))))).alias("p")).select("bucket", f"p.{idx}", f"p.{value}")


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Place in an order, from 1; for tables of results, which are small."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def best(df: DataFrame, metric: str, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """The row with the least metric, the first in ``ties`` of equals; one partial result a task."""
    others = [c for c in df.columns if c not in (by or [])]
    row = F.struct(F.col(metric).alias("_m"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)], *others)
    return df.groupBy(*(by or [])).agg(F.min(row).alias("_r")).select(*(by or []), *[F.col(f"_r.{c}").alias(c) for c in others])
