"""Readers: raw kline archives, typed candle and feature tables, small parameter files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.scalars import finite
from tidewater.operators.candles import CANDLE_COLUMNS, CREATED_COLUMNS, RAW_COLUMNS
from tidewater.session import ship

CANDLE_SCHEMA = "open_time timestamp, open double, high double, low double, close double, volume double, trades bigint, taker_buy_quote double"
FEATURE_SCHEMA = CANDLE_SCHEMA + "".join(f", {c} double" for c in CREATED_COLUMNS)


def read_zips(spark: SparkSession, folder: str) -> DataFrame:
    """Raw klines as text from every *.zip: file, line, the raw columns, and warning rows (line null).

    Of an archive the first .csv by name is read, without a header; none or several, or an archive that
    can't be read, give a warning and the rest goes on. Archives are read where they lie, one a task.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, warning = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = sorted(n for n in z.namelist() if n.lower().endswith(".csv"))
                        if not names:
                            warning = "no csv"
                        else:
                            warning = "several csv" if len(names) > 1 else None
                            with z.open(names[0]) as f:
                                rows = [r[: len(RAW_COLUMNS)] + [None] * (len(RAW_COLUMNS) - len(r)) for r in csv.reader(io.TextIOWrapper(f, "utf-8")) if r]
                except Exception as e:  # noqa: BLE001  a bad archive must not end the ingest
                    rows, warning = [], f"unreadable: {type(e).__name__}"
                lines = list(range(len(rows)))
                if warning:
                    rows.append([None] * len(RAW_COLUMNS))
                    lines.append(None)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(RAW_COLUMNS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array(lines, pa.int64()), *[pa.array(c, pa.string()) for c in columns], pa.array([warning if i is None else None for i in lines], pa.string())],
                    names=["file", "line", *RAW_COLUMNS, "warning"],
                )

    return files.mapInArrow(run, "file string, line long, " + ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", warning string")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has the columns; ValueError names those that are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """A candle CSV whose header must be exactly the candle columns."""
    header = spark.read.option("header", True).csv(path).columns
    if header != CANDLE_COLUMNS:
        raise ValueError(f"expected the header {CANDLE_COLUMNS}, found {header}")
    return spark.read.schema(CANDLE_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None, as_double: bool = False) -> DataFrame:
    """Feature rows from parquet or CSV, only the columns asked for; ``as_double`` casts all but the time."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.schema(FEATURE_SCHEMA).option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    df = require(df, columns).select(*columns) if columns else df
    return df.select(*[F.col(c).cast("double").alias(c) if as_double and c != "open_time" else F.col(c) for c in df.columns])


def read_pair(spark: SparkSession, path: str, x: str = "log_rv_past_12", y: str = "log_rv_future_12") -> DataFrame:
    """open_time, x, y where both are finite."""
    df = read_features(spark, path, ["open_time", x, y])
    return df.select("open_time", F.col(x).alias("x"), F.col(y).alias("y")).filter(finite(F.col("x")) & finite(F.col("y")))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows on which all the columns are finite."""
    for c in require(df, columns).columns:
        if c in columns:
            df = df.filter(finite(F.col(c)))
    return df


def read_table(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A small result table (CSV with a header); a missing one is empty where that is allowed."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException:
        if not optional:
            raise
        return spark.createDataFrame([], schema)


def dense_coefficients(table: DataFrame) -> list[float]:
    """Coefficients by lag from 1 on; a lag that is missing is an error."""
    rows = table.select("lag", "coefficient").orderBy("lag").collect()  # as many as the order
    if [r["lag"] for r in rows] != list(range(1, len(rows) + 1)):
        raise ValueError("the lags of the coefficients have holes")
    return [r["coefficient"] for r in rows]


def embedding_parameters(spark: SparkSession, path: str, fallback: bool = False) -> dict[str, int]:
    """tau, dim and theiler from the parameter file; a missing file gives 137, 5 and 685 where that is allowed."""
    from pyspark.errors import AnalysisException

    try:
        r = spark.read.option("multiLine", True).json(path).first().asDict()
    except AnalysisException:
        if not fallback:
            raise
        return {"tau": 137, "dim": 5, "theiler": 685}
    tau, dim = int(r["tau_selected"]), int(r["m_selected"])
    return {"tau": tau, "dim": dim, "theiler": max(int(r.get("theiler_window") or 0), tau * dim)}
