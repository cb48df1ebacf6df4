"""Written intermediate tables, in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files outlive any executor, and a lost task
reads them again instead of recomputing a whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a key table that may be broadcast (two longs a row: about 32 MB in memory); larger tables are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only on one machine, where executors see the driver's files, a temporary folder
    stands in for one that is not set; a cluster without one is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"{tempfile.gettempdir()}/codelake-checkpoints")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codelake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back; its lineage ends at the files."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._codelake_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_codelake_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
