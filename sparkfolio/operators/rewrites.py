"""Table changes as rewrites: results to be written as a new version, since Parquet tables have no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest version of each key, changes included; rows alike in version: the change wins."""
    rows = table.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_side"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_side")


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(key).join(table, key, "left_anti"))


def guarded_append(table: DataFrame, rows: DataFrame, key: list[str], allowed: DataFrame) -> DataFrame:
    """Append rows whose key the allowed table has."""
    return table.unionByName(rows.join(allowed, key, "left_semi"))


def update(table: DataFrame, condition, values: dict) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, condition: str) -> tuple[DataFrame, DataFrame]:
    gone = parents.filter(condition).select(key)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")
