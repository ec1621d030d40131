"""Spark sessions with the settings the engine wants."""

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use its own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("parley")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": os.path.join(tempfile.gettempdir(), f"parley-{os.getuid()}"),  # driver and executors are one process here
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where it is unset, one of our own if driver and executors are one process, as in tests, else an error."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"parley-{os.getuid()}")
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written to the shared folder and read again, for what is used several times or must not change."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Has the session cut what goes to Python workers into Arrow batches of at most 8 MB, as texts may be long; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > limit:
        spark.conf.set(name, str(limit))


def _bytes(size: str) -> int:
    m = re.match(r"(-?\d+)\s*([kmgt]?)", size.lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if int(m[1]) > 0 else 1 << 62
