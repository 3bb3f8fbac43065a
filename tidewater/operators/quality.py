"""Data-quality reports over candles or any timed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import scalars as S
from tidewater.operators.candles import CANDLE_COLUMNS, PRICES
from tidewater.operators.describe import grouped_quantiles, with_quantiles


def numeric_checks(text_candles: DataFrame) -> DataFrame:
    """(column_name, nulls, parse_errors, not_positive) of candles read as text, compared as exact decimals.

    A blank counts as null; what isn't a number counts as a parse error.
    """
    d = lambda c: F.col(c).cast("string").try_cast("decimal(38,18)")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    numbers = [c for c in CANDLE_COLUMNS if c != "open_time"]
    row = text_candles.agg(
        *[F.count_if(blank(c)).alias(f"{c}__0") for c in numbers],
        *[F.count_if(~blank(c) & d(c).isNull()).alias(f"{c}__1") for c in numbers],
        *[F.count_if(~blank(c) & (d(c) <= 0)).alias(f"{c}__2") for c in numbers],
    )
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{i}").alias(n) for i, n in enumerate(("nulls", "parse_errors", "not_positive"))]) for c in numbers])
    return row.select(F.inline(parts))


def ohlc_consistency(candles: DataFrame) -> DataFrame:
    """Rows that break each rule among those with all four prices."""
    o, h, low, c = (F.col(x) for x in PRICES)
    return candles.dropna(subset=PRICES).agg(
        F.count("*").alias("checked"), F.count_if(h < low).alias("high_below_low"), F.count_if((o < low) | (o > h)).alias("open_outside"), F.count_if((c < low) | (c > h)).alias("close_outside")
    )


def diffs(df: DataFrame, time: str = "open_time", day: bool = True) -> DataFrame:
    """Each time with the one before it and the seconds between; runs by day, joined over day ends. Null times are left out."""
    t = F.unix_seconds(F.col(time).cast("timestamp"))
    keyed = df.select(F.col(time).alias("t"), t.alias("s")).filter(F.col("s").isNotNull()).withColumn("_day", F.floor(F.col("s") / 86_400))
    within = Window.partitionBy("_day").orderBy("s")
    ends = keyed.groupBy("_day").agg(F.max(F.struct("s", "t")).alias("_last"))
    carried = ends.select("_day", F.lag("_last").over(Window.orderBy("_day")).alias("_carry"))  # a row a day
    before = F.coalesce(F.lag(F.struct("s", "t")).over(within), F.col("_carry"))
    return keyed.join(carried, "_day").withColumn("_before", before).filter(F.col("_before").isNotNull()).select(
        F.col("_before.t").alias("prev_time"), F.col("t").alias("next_time"), (F.col("s") - F.col("_before.s")).alias("seconds")
    )


def gaps(df: DataFrame, time: str = "open_time", step: int = S.BAR_SECONDS) -> DataFrame:
    """Places where more than a step is missing, with the count of missing rows."""
    return diffs(df, time).filter(F.col("seconds") > step).withColumn("missing", (F.floor(F.col("seconds") / step) - 1).cast("bigint"))


def diff_histogram(df: DataFrame, time: str = "open_time") -> DataFrame:
    return diffs(df, time).groupBy("seconds").agg(F.count("*").alias("n"))


def modal_diff(df: DataFrame, time: str = "open_time") -> DataFrame:
    """The most frequent step, the smallest of equals."""
    return diff_histogram(df, time).orderBy(F.desc("n"), "seconds").limit(1)


def regularity(df: DataFrame, time: str = "open_time", step: int = S.BAR_SECONDS) -> DataFrame:
    """Mean and median step and the steps that aren't ``step``; from the counts of the different steps."""
    steps = diff_histogram(df, time)
    n = F.sum("n")
    row = steps.agg((F.sum(F.col("seconds") * F.col("n")) / n).alias("mean_seconds"), F.coalesce(F.sum(F.when(F.col("seconds") != step, F.col("n"))), F.lit(0)).alias("odd_steps"))
    row = with_quantiles(row, grouped_quantiles(steps, "seconds", [0.5], weight="n"), None)
    return row.select("mean_seconds", F.col("q")[0].alias("median_seconds"), "odd_steps", (F.col("odd_steps") == 0).alias("regular"))


def duplicates(df: DataFrame, key: str = "open_time") -> DataFrame:
    """Second and later occurrences; null counts as one value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"), F.count_if(F.col("n") > 1).alias("repeated_keys"))


def out_of_order(df: DataFrame, time: str, line: str) -> DataFrame:
    """Rows that don't come after the row before them in file order."""
    keyed = df.select(F.col(line).alias("_l"), F.col(time).alias("_t")).withColumn("_b", F.floor(F.col("_l") / 100_000))
    ends = keyed.groupBy("_b").agg(F.max(F.struct("_l", "_t")).alias("_last"))
    carried = ends.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_carry"))  # a row for 100,000 lines
    before = F.coalesce(F.lag(F.struct("_l", "_t")).over(Window.partitionBy("_b").orderBy("_l")), F.col("_carry"))
    return keyed.join(carried, "_b").withColumn("_p", before).agg(F.count_if(F.col("_t") <= F.col("_p._t")).alias("not_after"))


def expected_rows(df: DataFrame, time: str = "open_time", step: int = S.BAR_SECONDS) -> DataFrame:
    s = F.unix_seconds(F.col(time).cast("timestamp"))
    return df.agg(F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), ((F.max(s) - F.min(s)) / step + 1).cast("bigint").alias("expected")).withColumn(
        "missing", F.col("expected") - F.col("rows")
    )


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(c) * 100).alias("null_percent")) for c in columns])))


def zero_windows(featured: DataFrame, columns: list[str]) -> DataFrame:
    """Realised variances that are zero or less, by column."""
    row = featured.agg(*[F.count_if(F.col(c) <= 0).alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("not_positive")) for c in columns])))


def report(candles: DataFrame, time: str = "open_time", step: int = S.BAR_SECONDS) -> DataFrame:
    """(check_name, value, passed): the whole report in long form, from one scan.

    Counts are added up for each time, which meets repeated times before anything is sorted; the times of a day are put in
    order and make a summary (counts, first and last time, gaps, repeats), and the summaries are merged in the order of the
    days, where the gap between two days comes in. A null time is in no gap, and counts as one repeated value.
    """
    o, h, low, c = (F.col(x) for x in PRICES)
    whole = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
    not_positive = [*PRICES, "volume", "trades"]
    one = lambda b: F.when(b, 1).otherwise(0)
    flags = {
        **{f"null_{x}": F.count_if(F.col(x).isNull()) for x in CANDLE_COLUMNS},
        **{f"not_positive_{x}": F.count_if(F.col(x) <= 0) for x in not_positive},
        "negative_taker_buy_quote": F.count_if(F.col("taker_buy_quote") < 0),
        "ohlc_inconsistent": F.coalesce(F.sum(F.when(whole, one(h < low) + one((o < low) | (o > h)) + one((c < low) | (c > h)))), F.lit(0)),
    }
    s = F.unix_seconds(F.col("_t").cast("timestamp"))
    times = candles.groupBy(F.col(time).alias("_t")).agg(F.count("*").alias("rows"), *[f.alias(n) for n, f in flags.items()])
    times = times.withColumn("_s", s).withColumn("_day", F.floor(F.col("_s") / 86_400))
    missing = lambda d: F.when(d > step, F.floor(d / step) - 1)
    inside = missing(F.col("_s") - F.lag("_s").over(Window.partitionBy("_day").orderBy("_s")))
    days = times.withColumn("_gap", F.when(F.col("_day").isNotNull(), inside)).groupBy("_day").agg(
        *[F.sum(n).alias(n) for n in ("rows", *flags)], F.sum(F.col("rows") - 1).alias("duplicates"), F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.count("_gap").alias("gaps"), F.max("_gap").alias("longest_gap")
    )
    between = missing(F.col("_first") - F.lag("_last").over(Window.orderBy("_day")))  # a row a day
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(n)
    row = days.withColumn("_gap", between).agg(
        *[total(n) for n in ("rows", *flags, "duplicates")],
        ((F.max("_last") - F.min("_first")) / step + 1).cast("bigint").alias("expected"),
        (F.coalesce(F.sum("gaps"), F.lit(0)) + F.count("_gap")).alias("gaps"),
        F.coalesce(F.greatest(F.max("longest_gap"), F.max("_gap")), F.lit(0)).alias("longest_gap"),
    ).withColumn("missing", F.col("expected") - F.col("rows"))
    names = ["rows", *flags, "duplicates", "missing", "gaps", "longest_gap"]
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.col(n).cast("double").alias("value"), (F.col(n) > 0 if n == "rows" else F.col(n) == 0).alias("passed")) for n in names
    ])))
