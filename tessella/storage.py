"""Durable intermediate tables in the folder that driver and executors share, and guards for broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table that may be broadcast: checked before each use.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20
#: Bytes of a table's files for each partition of a shuffle whose size follows the table's.
PARTITION_BYTES = 64 << 20
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set and all runs in one process."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors. What drop_stored() has not deleted goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(gone)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete tables made by stored() once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if shared_dir(df.sparkSession).split("://")[-1].lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def _width(name: str, kind: str):
    """Bytes of a column's value, about."""
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if "<" in kind else F.lit(8)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark df for a broadcast if a count of its rows and bytes proves it small; else leave it to a shuffled join, whose skew AQE splits."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(sum((_width(*c) for c in df.dtypes), F.lit(0))).alias("bytes")).first()
    return F.broadcast(df) if found.n <= rows and (found.bytes or 0) <= size else df


def partitions(spark: SparkSession, of: DataFrame | None = None) -> int:
    """How many partitions to shuffle to: the session's number, or more where the files that the table comes from ask for it."""
    least = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if of is None:
        return least
    leaves, size = of._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():
        own = int(leaves.next().stats().sizeInBytes())
        size += own if own < 1 << 60 else 0  # Spark's stand-in for a table of unknown size
    return max(least, -(-size // PARTITION_BYTES))
