"""Trace logs as JSON lines: a declared schema, appending, and reading whole folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "type string, timestamp string, model string, content string, reasoning string, messages array<struct<role:string,content:string,tool_call_id:string,"
    "tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"
)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the log files at path (a folder, file or glob), with file and line order kept as (file, at): content may be text, null or a list of parts, which stays JSON text."""
    rows = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.to_timestamp_ntz(F.regexp_replace("timestamp", "Z$", "")).alias("at"))


def append_traces(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
