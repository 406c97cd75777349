"""Files of a folder, read by the executors, and captures written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]", contents: bool = True) -> DataFrame:
    """path, filename, size, modified and, unless contents is false, file_hash (SHA-256, lowercase hex) and head (the first bytes as text) of a folder's files. Without contents no file is opened. Spark's reader leaves empty files out, so they aren't listed; an upload without bytes is refused before it is stored."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    told = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("file_hash"), F.decode(F.substring("content", 1, 8), "ISO-8859-1").alias("head")] if contents else []))
    return told


def write_captures(rows: DataFrame, folder: str, day: str) -> None:
    """Captures as JSON lines, appended in folders by day; a write that fails leaves no rows behind it for readers."""
    rows.withColumn("_day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("_day").json(folder)


def read_captures(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _day date").json(folder).drop("_day")
