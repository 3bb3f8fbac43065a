"""How the driver's tables stand in for candles, series, windows and vectors; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import candles
from tidewater.operators.ordering import dense_index

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _seconds(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars with bar (epoch seconds) and idx."""
    made = candles.bars(events(spark, sf_dir)).withColumn("bar", F.unix_seconds("open_time"))
    return dense_index(made, F.floor(F.col("bar") / DAY), ["bar"])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, x, ts, event_type): event values in order."""
    e = events(spark, sf_dir).select("ts", "event_id", "event_type", F.col("value").alias("x"))
    return dense_index(e, F.floor(_seconds("ts") / DAY), ["ts", "event_id"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, day, x): order totals of each day, in thousands."""
    o = table(spark, sf_dir, "orders").groupBy(F.floor(_seconds("o_orderdate") / DAY).alias("day")).agg((F.sum("o_totalprice") / 1000).alias("x"))
    return dense_index(o, F.floor(F.col("day") / 512), ["day"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, vec, target) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("target"))


#: The same in DuckDB.
BARS = """bars AS (
  SELECT *, row_number() OVER (ORDER BY bar) - 1 AS idx FROM (
    SELECT CAST(floor(epoch_us(ts) / 300000000.0) AS BIGINT) * 300 AS bar, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
           arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS trades,
           coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0) AS taker_buy_quote
    FROM events WHERE value > 0 GROUP BY 1))"""
SERIES = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, value AS x, ts, event_type FROM events)"
DAILY = """d AS (
  SELECT *, row_number() OVER (ORDER BY day) - 1 AS idx FROM (
    SELECT CAST(floor(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS day, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1))"""
VECTORS = "v AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS DOUBLE) AS target FROM embeddings)"
RETURNS = BARS + """, r AS (SELECT *, ln(close) - lag(ln(close)) OVER (ORDER BY idx) AS r FROM bars),
r2 AS (SELECT *, r * r AS r2 FROM r)"""


def rolled(value: str, first: str, last: str, n: int) -> str:
    """A whole-window sum in SQL."""
    frame = f"(ORDER BY idx ROWS BETWEEN {first} AND {last})"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN sum({value}) OVER {frame} END"


FEATURES = RETURNS + ", f AS (SELECT *, ln(high / low) AS hl_range, ln(volume + 1) AS log_volume, ln(trades + 1) AS log_trades, " + ", ".join(
    [f"{rolled('r2', f'{n - 1} PRECEDING', 'CURRENT ROW', n)} AS rv_past_{n}" for n in (12, 48, 288)] + [f"{rolled('r2', '1 FOLLOWING', f'{n} FOLLOWING', n)} AS rv_future_{n}" for n in (12, 48)]
) + " FROM r2)"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """The columns rounded; both sides of a comparison round alike."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})
