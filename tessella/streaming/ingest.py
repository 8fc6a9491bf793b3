"""Ingest as Structured Streaming: files in, deduplicated rows out; event windows; task states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FINISHED = ("completed", "failed", "cancelled")


def incoming(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first, `per_trigger` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").parquet(path)


def deduplicated(stream: DataFrame, content: str, time: str, within: str = "1 day") -> DataFrame:
    """The first row of each content hash, remembered for `within` of event time."""
    return stream.withColumn("hash", F.sha2(F.col(content), 256)).withWatermark(time, within).dropDuplicatesWithinWatermark(["hash"])


def event_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n, total of tumbling windows; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the rows of each micro-batch whose key is not in the target yet; a repeated batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(target).select(key)
        except Exception as e:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = batch.select(key).limit(0)
        batch.dropDuplicates([key]).join(have, key, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def task_states(events: DataFrame) -> DataFrame:
    """task_id, status, progress, updated_at: the latest event of each task; a finished task stays finished."""
    done = F.col("status").isin(*FINISHED)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = F.struct(done.cast("int"), F.when(done, -at).otherwise(at))
    return events.groupBy("task_id").agg(F.max_by("status", order).alias("status"), F.max("progress").alias("progress"), F.max("ts").alias("updated_at"))


def visible(tasks: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Tasks that are unfinished or were updated within the last `seconds`."""
    return tasks.where(~F.col("status").isin(*FINISHED) | (F.unix_timestamp("updated_at") >= F.unix_timestamp(now) - seconds))
