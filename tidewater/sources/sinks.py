"""Writers: tables as CSV with 12 significant digits, parquet, JSON, embeddings, images."""

from __future__ import annotations

import io
import json
import math
import zipfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalars import significant


def csv_columns(df: DataFrame, columns: list[str] | None = None, digits: int = 12) -> DataFrame:
    """The columns in order as text: doubles to ``digits`` significant digits, nulls empty."""
    kinds = dict(df.dtypes)
    return df.select(*[(significant(F.col(c), digits) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns or df.columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = True) -> None:
    """A CSV with a header, an empty one too; ``single`` for tables of results, parts for data."""
    out = csv_columns(df, columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_text(value: object) -> str:
    """JSON whose NaN and infinities are null."""
    def clean(v):
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(clean(value), indent=2, ensure_ascii=False)


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table of a phase under its name."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}.csv")


def npz_bytes(vectors: np.ndarray, indices: np.ndarray, metadata: dict) -> bytes:
    """An embedding as .npz: X (float64), indices (int64) and the metadata as JSON."""
    out = io.BytesIO()
    np.savez(out, X=np.asarray(vectors, "<f8"), indices=np.asarray(indices, "<i8"))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("metadata.json", json_text(metadata))
    return out.getvalue()


def table_text(df: DataFrame, rows: int = 20) -> str:
    """A table of results for the console."""
    return df._jdf.showString(rows, 60, False)
