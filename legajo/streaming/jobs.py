"""Structured Streaming: incremental ingestion of files, the entity graph, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from legajo.sources.files import parse_files


def hourly(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) in windows of an hour; with lateness, a watermark on ts bounds the state of a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        events = events.withWatermark("ts", lateness)
    by = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_hourly(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, lateness: str = "2 hours") -> StreamingQuery:
    """Run hourly() over Parquet files as they arrive in a folder, appending closed windows to out; late rows beyond the watermark are dropped."""
    events = spark.readStream.schema(schema).parquet(folder)
    return hourly(events, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_files(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Parse new files of a folder and add those whose doc_id the table does not hold yet, batch by batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def add(batch: DataFrame, _: int) -> None:
        docs = parse_files(batch).dropDuplicates(["doc_id"])
        try:
            known = batch.sparkSession.read.parquet(table).select("doc_id")
            docs = docs.join(known, "doc_id", "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        docs.write.mode("append").parquet(table)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edge weights are sums, so a batch's edges (src, dst, weight) are added to those there are."""
    return old.unionByName(new).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
