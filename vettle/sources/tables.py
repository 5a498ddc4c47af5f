"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _DIRS["base"] = _DIRS.get("base") or tempfile.mkdtemp(prefix="vettle-")
    path = f"{base.rstrip('/')}/vettle-{spark.sparkContext.applicationId}"
    if path not in _DIRS:
        _DIRS[path] = path
        atexit.register(_clear, spark, path)
    return path


def _clear(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone
        pass


def plain_unions(spark: SparkSession) -> SparkSession:
    """Keeps unions from taking over their sides' partitioning: with reused exchanges, Spark 4.1.2 then groups wrongly."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Documents to a task, at most, where they are dealt anew: what a task holds doesn't grow with the input.
DEALT = 20_000


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks rows are dealt to."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // DEALT))


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written and read again: its lineage is cut, and it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    plain_unions(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
