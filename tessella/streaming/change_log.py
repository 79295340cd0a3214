"""A stream of change-log rows applied to a stored table of features, batch by batch.

The reference point is a synchronous update; the stream is an extension of it. The table lies in buckets by id. A batch writes the buckets that it touches, as a new version, and then a manifest that tells
for each bucket which version holds it; a batch that comes again finds its manifest and is skipped, and one that was cut off has none. Rows of a batch are applied in the order of seq: what an earlier row did
to an id is void where a later one adds or removes it, and a remove_all voids all rows before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changes import apply_changes

BUCKETS = 64


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _names(spark, f"{folder}/manifest") if n.startswith("version=") and _exists(spark, f"{folder}/manifest/{n}"))


def latest(spark: SparkSession, folder: str) -> int:
    return _versions(spark, folder)[-1]


def _manifest(spark: SparkSession, folder: str, number: int) -> dict[int, int]:
    """bucket -> version, at most a row for each bucket."""
    return {r.bucket: r.held for r in spark.read.parquet(f"{folder}/manifest/version={number}").collect()}


def _bucket(buckets: int):
    return F.coalesce(F.pmod(F.xxhash64("id"), F.lit(buckets)), F.lit(0)).cast("int")


def _write(rows: DataFrame, folder: str, number: int, buckets: int, others: dict[int, int]) -> None:
    """The version's buckets, then its manifest, in which the others stay where they are."""
    spark = rows.sparkSession
    rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/version={number}")
    own = {int(n.split("=")[1]): number for n in _names(spark, f"{folder}/version={number}") if n.startswith("bucket=")}
    spark.createDataFrame(sorted((others | own).items()), "bucket int, held int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/version={number}")


def start(source: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write version 0."""
    source.limit(0).withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/columns-{buckets}")
    _write(source, folder, 0, buckets, {})


def _read(spark: SparkSession, folder: str, held: dict[int, int]) -> DataFrame:
    layout = next(n for n in _names(spark, folder) if n.startswith("columns-"))
    schema = spark.read.parquet(f"{folder}/{layout}").drop("buckets").schema
    paths = [f"{folder}/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def version(spark: SparkSession, folder: str, number: int) -> DataFrame:
    return _read(spark, folder, _manifest(spark, folder, number))


def in_order(batch: DataFrame) -> tuple[DataFrame, bool]:
    """The rows of a batch that later ones leave in force, and whether all that was there goes."""
    first = batch.where("op = 'remove_all'").agg(F.max("seq")).first()[0]
    rows = batch.where("op <> 'remove_all'")
    rows = rows if first is None else rows.where(F.col("seq") > first)
    whole = F.max(F.when(F.col("op").isin("add", "remove"), F.col("seq"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("whole", whole).where(F.col("id").isNull() | F.col("whole").isNull() | (F.col("seq") >= F.col("whole"))).drop("whole")
    return rows, first is not None


def apply_batch(folder: str):
    """For foreachBatch: rows of (op: remove_all, remove, add or update, and the columns of the features, seq among them)."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{folder}/manifest/version={number + 1}"):
            return
        buckets = int(next(n for n in _names(spark, folder) if n.startswith("columns-")).split("-")[1])
        rows, every = in_order(batch)
        touched = {r.bucket for r in rows.select(_bucket(buckets).alias("bucket")).distinct().collect()}
        held = _manifest(spark, folder, latest(spark, folder))
        source = _read(spark, folder, {} if every else {b: v for b, v in held.items() if b in touched})
        of = lambda op: rows.where(F.col("op") == op).select(*source.columns)
        new, _ = apply_changes(source, of("remove"), of("add"), of("update"), last=(number + 1) << 40)
        _write(new, folder, number + 1, buckets, {} if every else {b: v for b, v in held.items() if b not in touched})

    return run


def expire(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the last versions, and the buckets that none of these needs."""
    known = _versions(spark, folder)
    needed = {(v, b) for n in known[-keep:] for b, v in _manifest(spark, folder, n).items()}
    for n in known[:-keep]:
        gone, fs = _path(spark, f"{folder}/manifest/version={n}")
        fs.delete(gone, True)
    for n in known:
        own = [int(x.split("=")[1]) for x in _names(spark, f"{folder}/version={n}") if x.startswith("bucket=")]
        for b in own:
            if (n, b) not in needed:
                gone, fs = _path(spark, f"{folder}/version={n}/bucket={b}")
                fs.delete(gone, True)
