"""Session settings, the shared work folder and table access."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: A table is broadcast only if its files are below this many bytes.
BROADCAST_BYTES = 8 << 20


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": "quern",
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.codegen.cache.maxEntries": "2000",  # many small jobs of few shapes: compile each once
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_scratch: dict[str, set[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of one run in the shared folder."""
    folder = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_forget_all)
    _scratch.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    return f"{folder}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: what is computed once survives the loss of executors, and its lineage is cut.

    The folder is the session's until `clear_scratch` or the end of the application.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application has written, once the results made of them are stored. How many there were."""
    folders = _scratch.pop(spark.sparkContext.applicationId, set())
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def _forget_all() -> None:
    """At the end of the process: what is still there goes, if the session still runs."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
            clear_scratch(spark)
    except Exception:  # noqa: BLE001  the JVM may be gone; the shared folder's owner clears the rest
        pass


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so Python functions run where it is not installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, folder, True)
    bundle = os.path.join(folder, "quern_package.zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(bundle)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _splits(df: DataFrame) -> int:
    """How many splits a scan's files give at most, told from their number and the plan's size, without running or planning anything."""
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return max(len(df.inputFiles()), plan_bytes(df) // (int(number) << 10 * " kmgt".index(unit or " ")))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that is heavy per row. If its files give fewer splits than the cluster has cores (a lone small file, say), its
    rows are dealt out once; a table of many splits, as any large one is, is read as it lies."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if _splits(df) >= cores else df.repartition(cores)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of a plan, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the plan's estimated size allows a broadcast."""
    return plan_bytes(df) <= limit
