"""Structured Streaming forms of the metering operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metering import FINAL, hold_state
from ..operators.trees import shared_folder

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a file stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def window_totals(stream: DataFrame, late: str = "1 day", size: str = "7 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), "user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,10)")).alias("cost"))


def holds(stream: DataFrame, name: str) -> DataFrame:
    """Reservation states after all events (reservation_id, seq, event) that are available now: held, then the first final event; uncertain holds have no time-out.

    Each batch's events are folded without Python and without states in memory: from the state that the last earlier batch wrote to the shared folder. Every batch
    writes the states that it met under its number, so a batch that is run again replaces its own rows. The states of earlier batches are read in each batch.
    """
    folder = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    key = stream.schema["reservation_id"].dataType.simpleString()

    def states(spark: SparkSession, before: int | None = None) -> DataFrame:
        rows = spark.read.schema(f"reservation_id {key}, state string, batch long").parquet(f"{folder}/rows")
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return rows.groupBy("reservation_id").agg(F.max_by("state", "batch").alias("state"))

    def put(batch: DataFrame, number: int) -> None:
        # seq without a value comes last; events that change no state are not shuffled
        rows = batch.filter(F.col("event").isin("held", *FINAL)).groupBy("reservation_id").agg(F.sort_array(F.collect_list(F.struct(F.isnull("seq").alias("last"), "seq", "event"))).alias("e"))
        if number:
            old = states(batch.sparkSession, number).select(F.col("reservation_id").alias("old_id"), F.col("state").alias("old"))
            rows = rows.join(old, F.col("reservation_id").eqNullSafe(F.col("old_id")), "left")
        else:
            rows = rows.withColumn("old", F.lit(None).cast("string"))
        rows.select("reservation_id", hold_state(F.col("e"), F.col("old")).alias("state")).filter("state IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.sparkSession.createDataFrame([], f"reservation_id {key}, state string").write.parquet(f"{folder}/rows/batch=-1")  # a stream without a batch has a table too
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return states(stream.sparkSession)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available now, as a table of files in the folder that the cluster shares; complete totals replace the files."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
