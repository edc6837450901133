"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "textbench", cpus: int | str = "*", **settings: str) -> SparkSession:
    """A local session. On a cluster use the session that spark-submit configures;
    nothing in this package depends on the settings made here."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"textbench-{application}-")


def _work_root(spark: SparkSession) -> str:
    """The folder of this application in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, because executors share no local disk.
    """
    application = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _own_folder(application)
    return f"{shared.rstrip('/')}/textbench/{application}"


def work_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder; see ``clear_work``."""
    return f"{_work_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, computes the
    frame exactly once, and keeps column pruning and filter pushdown for readers.
    """
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> bool:
    """Delete everything that this application has written to the shared folder with
    ``work_dir`` and ``materialize``, and tell whether there was anything.

    For when the results are saved: frames that operators have returned may read from there.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
