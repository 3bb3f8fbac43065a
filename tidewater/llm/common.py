"""What the corpus operators share: word rules, shared-folder tables, defensive column handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The blank characters that separate words.
BLANK = "[\\x20\\x09-\\x0D]"
NON_BLANK = "[^\\x20\\x09-\\x0D]"

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where all is one process."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):  # a folder of this machine is of no use to the executors of others
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="tidewater-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = f"file://{folder}"
    return _own[context.applicationId]


_own: dict[str, str] = {}


def _handle(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; the file system deletes it when the application ends."""
    path = f"{shared_dir(spark)}/tidewater/{label}-{uuid.uuid4().hex}"
    handle, store = _handle(spark, path)
    store.deleteOnExit(handle)
    return path


#: Shuffle files of a query that has ended and whose result is written are of no more use.
_SPENT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def spent_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a query are removed when the query has ended."""
    was = spark.conf.get(_SPENT, "false")
    spark.conf.set(_SPENT, "true")
    try:
        yield
    finally:
        spark.conf.set(_SPENT, was)


def materialise(df: DataFrame, label: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a lost executor costs only its running tasks.

    The shuffle files that made it go once it is written, so they never pile up over the steps of an operator.
    With ``by`` a folder for each of its values, for readers that want one of them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with spent_shuffles_go(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``materialise`` that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/tidewater/" in folder:
                handle, store = _handle(table.sparkSession, folder)
                store.delete(handle, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of non-blank characters, in order; native."""
    return F.array_remove(F.split(text, BLANK + "+"), "")


def rows_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``kept`` (doc_id, text_hash) names; one for each of its rows.

    Rows equal in doc_id and text are told apart by their other columns: the first by their JSON text stays.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    held = docs.select(row.alias("_in"), docs["doc_id"].cast("long").alias("_d"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_h"))
    told = kept.select(F.col("doc_id").alias("_kd"), F.col("text_hash").alias("_kh"))
    left = held.join(told, F.col("_d").eqNullSafe(F.col("_kd")) & (F.col("_h") == F.col("_kh")), "left_semi")
    if left.count() != told.count():  # some rows repeat; only such tables pay for telling them apart
        nth = F.row_number().over(Window.partitionBy("_d", "_h").orderBy(F.to_json("_in")))
        left = left.withColumn("_nth", nth).filter("_nth = 1")
    return left.select(*[F.col("_in")[c].alias(c) for c in docs.columns])
