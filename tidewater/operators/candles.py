"""Candles: cleaning, five-minute bars from events, and the realised-volatility features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewater.functions import scalars as S
from tidewater.operators.ordering import own_rows, spread, window_pieces, with_halo

RAW_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore"]
CANDLE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "trades", "taker_buy_quote"]
PRICES = ["open", "high", "low", "close"]
PAST, FUTURE = (12, 48, 288), (12, 48)
CREATED_COLUMNS = [
    "log_close", "r", "r2", "abs_r", "hl_range", "log_volume", "log_trades",
    *[f"rv_past_{n}" for n in PAST], *[f"rv_future_{n}" for n in FUTURE],
    *[f"log_rv_past_{n}" for n in PAST], *[f"log_rv_future_{n}" for n in FUTURE],
]


def clean_klines(raw: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """Typed candles in order; of a repeated open_time the first row (file, then line) stays.

    Numbers that can't be read become null; unreadable times are null, count as one time and come last.
    """
    typed = raw.select(
        S.epoch_to_timestamp(F.col("open_time")).alias("open_time"),
        *[F.col(c).try_cast("double").alias(c) for c in CANDLE_COLUMNS if c not in ("open_time", "trades")],
        F.col("trades").try_cast("double").try_cast("bigint").alias("trades"),
        file,
        line,
    )
    first = Window.partitionBy("open_time").orderBy(file, line)
    return typed.withColumn("_k", F.row_number().over(first)).filter("_k = 1").select(*CANDLE_COLUMNS).orderBy(F.col("open_time").asc_nulls_last())


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def bars(events: DataFrame, seconds: int = S.BAR_SECONDS) -> DataFrame:
    """Bars of events with a value: one row per bar that has any, partial sums before the only exchange."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds) * seconds)
    at = F.struct("ts", "event_id")
    return (
        events.filter(F.col("value") > 0)
        .groupBy(start.alias("open_time"))
        .agg(
            F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
            F.sum("value").alias("volume"), F.count("*").alias("trades"),
            F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("taker_buy_quote"),
        )
    )


def rolling_sum(x: Column, w: WindowSpec, first: int, last: int) -> Column:
    """Sum over rows first..last, null unless the frame is whole and has no null."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(x).over(frame) == last - first + 1, F.sum(x).over(frame))


def features(candles: DataFrame, idx: str = "idx", block_rows: int = 16_384) -> DataFrame:
    """All created columns; rows at the ends have nulls (see ``complete``). Needs positive prices."""
    logs = candles.withColumns(
        {
            "log_close": F.log("close"), "hl_range": F.log(F.col("high") / F.col("low")),
            "log_volume": S.log_plus_one(F.col("volume")), "log_trades": S.log_plus_one(F.col("trades").cast("double")),
        }
    )
    r = with_halo(logs, lambda w: {"r": F.col("log_close") - F.lag("log_close", 1).over(w)}, past=1, idx=idx, block_rows=block_rows)
    r = r.withColumns({"r2": F.col("r") * F.col("r"), "abs_r": F.abs("r")})
    most, r2 = max(PAST), F.col("r2")
    blocks = spread(r, most - 1, max(FUTURE), idx, block_rows)
    w = Window.partitionBy("_blk").orderBy(idx)
    short = {f"rv_past_{n}": rolling_sum(r2, w, 1 - n, 0) for n in PAST if n < most} | {f"rv_future_{n}": rolling_sum(r2, w, 1, n) for n in FUTURE}
    made = window_pieces(blocks.withColumns(short), most, {"_n": F.count(r2), "_s": F.sum(r2)}, idx=idx)
    whole = F.col("_n_a") + F.coalesce("_n_b", F.lit(0)) == most
    made = made.withColumn(f"rv_past_{most}", F.when(whole, F.col("_s_a") + F.coalesce("_s_b", F.lit(0.0))))
    rv = own_rows(made).drop("_n_a", "_n_b", "_s_a", "_s_b")
    return rv.withColumns({f"log_{c}": S.safe_log(F.col(c)) for c in [*[f"rv_past_{n}" for n in PAST], *[f"rv_future_{n}" for n in FUTURE]]})


def complete(featured: DataFrame) -> DataFrame:
    """Rows with every created column."""
    return featured.dropna(subset=CREATED_COLUMNS)


def split(df: DataFrame, train_end: str, validation_end: str, time: str = "open_time", idx: str = "idx", purge: int = 12) -> DataFrame:
    """split = train, validation or test by time; the last ``purge`` rows of train and validation go."""
    t = F.col(time)
    named = df.withColumn("split", F.when(t <= F.lit(train_end).cast("timestamp"), "train").when(t <= F.lit(validation_end).cast("timestamp"), "validation").otherwise("test"))
    ends = named.groupBy("split").agg(F.max(idx).alias("_end"))  # three rows
    return named.join(F.broadcast(ends), "split").filter((F.col("split") == "test") | (F.col(idx) <= F.col("_end") - purge)).drop("_end")


def split_by_share(df: DataFrame, n: int, idx: str = "idx", train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """60/20/20 by position, cut down to whole rows."""
    a, b = int(n * train), int(n * (train + validation))
    return df.withColumn("split", F.when(F.col(idx) < a, "train").when(F.col(idx) < b, "validation").otherwise("test"))
