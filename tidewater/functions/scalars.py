"""Column functions over candles, series and reports; all compile into whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
BAR_SECONDS = 300
#: Named periods in five-minute lags.
PERIODS = {"1 hora": 12.0, "1 dia": 288.0, "1 semana": 2016.0}
#: Critical values at 1, 5 and 10 per cent.
ADF_CRITICAL = {"1%": -3.43, "5%": -2.86, "10%": -2.57}
KPSS_CRITICAL = {"1%": 0.739, "5%": 0.463, "10%": 0.347}


def epoch_to_timestamp(raw: Column) -> Column:
    """Epoch text to a UTC timestamp; the unit follows from the magnitude, what can't be read is null."""
    v = raw.try_cast("decimal(30,6)")
    micros = F.when(F.abs(v) >= F.lit(10**17).cast("decimal(30,0)"), F.floor(v / 1000)).when(F.abs(v) >= F.lit(10**14).cast("decimal(30,0)"), v).otherwise(v * 1000)
    return F.timestamp_micros(micros.try_cast("bigint"))


def safe_log(x: Column, epsilon: float = EPSILON) -> Column:
    """log(x + epsilon); null stays null."""
    return F.log(x + F.lit(epsilon))


def log_plus_one(x: Column) -> Column:
    return F.log(x + F.lit(1.0))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """0 where the spread is 0."""
    return F.when(std == 0, F.lit(0.0)).otherwise((x - mean) / std)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


def bin_code(x: Column, edges: Column) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(edges, lambda e: e <= x)).cast("int")


def period_hours(lags: Column) -> Column:
    return lags * F.lit(5.0) / F.lit(60.0)


def period_days(lags: Column) -> Column:
    return lags * F.lit(5.0) / F.lit(1440.0)


def nearest_reference(lags: Column, within: float = 0.10) -> Column:
    """The named period closest by ratio, if it is within 10 per cent; else ""."""
    by_ratio = F.array(*[F.struct(F.abs(F.log(lags / p)).alias("d"), F.lit(p).alias("p"), F.lit(n).alias("n")) for n, p in PERIODS.items()])
    best = F.array_min(by_ratio)
    return F.when(F.abs(lags - best["p"]) / best["p"] <= within, best["n"]).otherwise(F.lit(""))


def reference_label(lags: Column) -> Column:
    out = None
    for name, p in PERIODS.items():
        hit = F.abs(lags - p) < 1e-9
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.concat(F.format_string("%.0f", lags), F.lit(" retardos")))


def adf_bracket(t: Column) -> Column:
    return F.when(t <= -3.43, "<=0.01").when(t <= -2.86, "0.01-0.05").when(t <= -2.57, "0.05-0.10").otherwise(">0.10")


def kpss_bracket(eta: Column) -> Column:
    return F.when(eta >= 0.739, "<=0.01").when(eta >= 0.463, "0.01-0.05").when(eta >= 0.347, "0.05-0.10").otherwise(">0.10")


def verdict(p: Column, level: float = 0.05) -> Column:
    """Fixed report texts; null where there is no p-value."""
    return F.when(p < level, "rechaza H0").when(p.isNotNull() & ~F.isnan(p), "no rechaza H0")


def minus_log10_p(p: Column) -> Column:
    return F.least(-F.log10(F.greatest(p, F.lit(1e-16))), F.lit(16.0))


def oblique(x: Column, y: Column, z: Column, shift: float = 0.45, lift: float = 0.35) -> tuple[Column, Column]:
    """Three dimensions on a sheet."""
    return x + shift * z, y + lift * z


def distance_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def significant(x: Column, digits: int = 12) -> Column:
    """The shortest decimal text of ``digits`` significant digits; null becomes "".

    Halves are those of the number's shortest decimal form, and go up: 99999999999.95 gives 100000000000,
    where C's %.12g, which rounds the binary value below it, gives 99999999999.9.
    """
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}e", x), r"(\.\d*?)0+(e)", "$1$2"), r"\.(e)", "$1")
    exponent = F.when(x == 0, F.lit(0)).otherwise(F.regexp_extract(F.format_string(f"%.{digits - 1}e", x), r"e([+-]\d+)$", 1).cast("int"))
    places = F.greatest(F.lit(0), F.lit(digits - 1) - exponent)
    fixed = F.regexp_replace(F.regexp_replace(F.call_function("format_string", F.concat(F.lit("%."), places.cast("string"), F.lit("f")), x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), F.lit("")).when((exponent < -4) | (exponent >= digits), plain).otherwise(fixed)
