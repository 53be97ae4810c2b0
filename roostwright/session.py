"""Session defaults for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """A session on this machine. Tables that operators write on their way go to checkpoint_dir, a new temporary folder unless given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("roostwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one in local mode if it is unset, an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="roostwright-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name in the shared folder that nothing has yet; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, tag: str, **measures) -> tuple[DataFrame, dict]:
    """df, evaluated once into the shared folder and read back, and the aggregates `measures` of its rows, taken by that same pass."""
    path, seen = new_folder(df.sparkSession, tag), Observation()
    (df.observe(seen, *[v.alias(k) for k, v in measures.items()]) if measures else df).write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path), (seen.get if measures else {})
