"""Session helpers.

The library never creates a cluster-wide setting it cannot read back: the
checkpoint directory comes from ``spark.checkpoint.dir`` (the shared folder the
cluster names) and is only filled in when it is unset, as in local tests.
"""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that hold for local tests; on a cluster the session's own values win.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, app: str = "codeloom", conf: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a scratch one only when none is configured."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    # Test / local only: the cluster always names spark.checkpoint.dir.
    local = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again: readers pick columns, lineage ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete what :func:`stored` wrote for tables that nothing reads any more."""
    for df in dfs:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer referred to; without this they wait for the driver's next full collection."""
    gc.collect()
    time.sleep(1)          # py4j passes on what Python has let go from a thread of its own
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is not installed (Python stages need it)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="codeloom-zip-"), "codeloom")
    spark.sparkContext.addPyFile(shutil.make_archive(out, "zip", root, "codeloom"))
