"""Inputs of the catalogue, derived from the test tables by fixed rules (there is no slide among them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import unit_rows

VIEW = (0, 0, 12800, 12800)
SIDE = 1024
SLIDE = (40000, 30000)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_wide(spark: SparkSession, sf_dir: str, name: str, megabytes: int = 8) -> DataFrame:
    """The same for work that is heavy for each row: a table too small to fill all cores as it lies is dealt out anew."""
    df, cores = load(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (megabytes << 20) else df


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec): unit rows."""
    return unit_rows(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def references(rows: DataFrame) -> DataFrame:
    """Label 0 is good, label 1 is bad."""
    return rows.where("label in (0, 1)").select(F.when(F.col("label") == 0, "good").otherwise("bad").alias("label"), "vec")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x0, y0, cx, cy): 25 tiles a row, 256 microns apart at 0.25 microns per pixel."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    x0, y0 = F.col("id") % 25 * 256 / 0.25, F.floor(F.col("id") / 25) * 256 / 0.25
    return rows.select("id", x0.alias("x0"), y0.alias("y0"), (x0 + SIDE / 2).alias("cx"), (y0 + SIDE / 2).alias("cy"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and normalised boxes from the integers of lineitem."""
    return load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey * 7 % 20000 AS vx", "l_partkey * 13 % 15000 AS vy", "500 + l_suppkey * 31 % 9000 AS vw", "500 + l_linenumber * 977 % 7000 AS vh",
        "l_orderkey % 1100 - 50 AS n0", "l_partkey % 1100 - 50 AS n1", "l_suppkey * 3 % 1100 - 50 AS n2", "(l_orderkey + l_partkey) % 1100 - 50 AS n3",
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, gray): mean event value by user modulo 64 and hour."""
    e = load(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 64).alias("x"), F.hour("ts").cast("bigint").alias("y")).agg(F.avg("value").alias("gray"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value")
