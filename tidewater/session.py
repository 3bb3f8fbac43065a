"""Session defaults that every plan in this package assumes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that change results or plan shape; sizes (memory, cores) stay with the deployer.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewater") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once an application, for the operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tidewater-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/tidewater.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, gone when the application ends; a folder of our own only in local mode."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _own:
            folder = tempfile.mkdtemp(prefix="tidewater-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[context.applicationId] = f"file://{folder}"
        base = _own[context.applicationId]
    path = f"{base.rstrip('/')}/tidewater/{label}-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path
