"""Geometry derived from the driver's tables by integer arithmetic, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LON, _LAT = "(({k} * 7919) % {a}) / 100.0 - {b}", "(({k} * 104729) % {a}) / 100.0 - {b}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(key: str, times: int, mod: int, div: float, off: float) -> Column:
    return ((F.col(key).cast("long") * times) % mod).cast("double") / div - off


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), _mod("event_id", 7919, 36000, 100.0, 180.0).alias("lon"), _mod("event_id", 104729, 17000, 100.0, 85.0).alias("lat"), "user_id", "event_type", "value")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pts: a line for each customer over its orders."""
    o = table(spark, sf_dir, "orders")
    lon = _mod("o_custkey", 7919, 34000, 100.0, 170.0) + _mod("o_orderkey", 31, 2000, 1000.0, 1.0)
    lat = _mod("o_custkey", 104729, 15000, 100.0, 75.0) + _mod("o_orderkey", 37, 2000, 1000.0, 1.0)
    rows = o.select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey", lon.alias("lon"), lat.alias("lat")).alias("p"), F.col("o_orderstatus").alias("status"))
    pts = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return rows.groupBy("id").agg(pts.alias("pts"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, west, south, east, north, brand"""
    p = table(spark, sf_dir, "part")
    lon, lat = _mod("p_partkey", 7919, 36000, 100.0, 180.0), _mod("p_partkey", 104729, 17000, 100.0, 85.0)
    w, h = F.lit(0.1) + F.col("p_size") / 100.0, F.lit(0.1) + (F.col("p_partkey") % 50) / 100.0
    return p.select(F.col("p_partkey").alias("id"), (lon - w / 2).alias("west"), (lat - h / 2).alias("south"), (lon + w / 2).alias("east"), (lat + h / 2).alias("north"), F.col("p_brand").alias("brand"))


PI = "3.141592653589793"
PX = "(lon / 360.0::DOUBLE + 0.5::DOUBLE)"
PY = f"(CASE WHEN sin(lat * {PI}::DOUBLE / 180) >= 1 THEN 0.0 WHEN sin(lat * {PI}::DOUBLE / 180) <= -1 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.5 - 0.25 * ln((1 + sin(lat * {PI}::DOUBLE / 180)) / (1 - sin(lat * {PI}::DOUBLE / 180))) / {PI}::DOUBLE)) END)"
SQL_POINTS = "gp AS (SELECT event_id AS id, ((event_id * 7919) % 36000)::DOUBLE / 100 - 180 AS lon, ((event_id * 104729) % 17000)::DOUBLE / 100 - 85 AS lat, user_id, event_type, value FROM events)"
SQL_PROJECTED = f"{SQL_POINTS}, pp AS (SELECT *, {PX} AS px, {PY} AS py FROM gp)"
SQL_TRACKS = """tr AS (SELECT o_custkey AS id, o_orderstatus AS status, ((o_custkey * 7919) % 34000)::DOUBLE / 100 - 170 + (((o_orderkey * 31) % 2000)::DOUBLE / 1000 - 1) AS lon,
((o_custkey * 104729) % 15000)::DOUBLE / 100 - 75 + (((o_orderkey * 37) % 2000)::DOUBLE / 1000 - 1) AS lat, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)"""
SQL_BOXES = """bb AS (SELECT *, lon - w / 2 AS west, lat - h / 2 AS south, lon + w / 2 AS east, lat + h / 2 AS north FROM (SELECT p_partkey AS id, p_brand AS brand,
((p_partkey * 7919) % 36000)::DOUBLE / 100 - 180 AS lon, ((p_partkey * 104729) % 17000)::DOUBLE / 100 - 85 AS lat, 0.1::DOUBLE + p_size::DOUBLE / 100 AS w, 0.1::DOUBLE + (p_partkey % 50)::DOUBLE / 100 AS h FROM part))"""
