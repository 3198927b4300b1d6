"""Structured Streaming forms: daily usage, sessions, rate limits, token reassembly, incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import rocks_state

FIGURES = "batch long, state_rows long, late_rows long"
ENVELOPE = "kind string, seq long, token string"


def event_stream(spark: SparkSession, path: str, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; zone-free timestamps become instants, which watermarks ask for."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def daily_usage(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    days = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return days.select(F.to_date("w.start").alias("day"), "requests")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def rate_windows(events: DataFrame, client: str, ts: str, width: str = "1 minute", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(client, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(client, F.col("w.start").alias("started"), "n")


def sse_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Envelope of each ``data: {json}`` line; other and malformed lines and the end mark fall away."""
    body = F.when(F.startswith(F.col(line), F.lit("data:")), F.trim(F.substring(line, 6, 1 << 30)))
    parsed = lines.withColumn("__body", body).where("__body is not null and __body <> '[DONE]'").withColumn("event", F.from_json("__body", ENVELOPE))
    return parsed.where("event is not null and event.kind is not null").drop("__body")


def reassemble(events: DataFrame, message: str) -> DataFrame:
    """Tokens of each message in sequence, joined."""
    tokens = events.where("event.kind = 'token'").groupBy(message).agg(F.sort_array(F.collect_list(F.struct("event.seq", "event.token"))).alias("parts"))
    return tokens.select(message, F.array_join(F.transform("parts", lambda p: p["token"]), "").alias("text"), F.size("parts").alias("n_tokens"))


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream through all that is there now and read its result back from the files beside its checkpoint.

    In append mode a row is written once, when the watermark says that it is final, and its state is let go; a batch writes a
    folder of its own, so one that is run again after a failure writes the same rows to the same place.  In complete mode
    each batch is the whole result and takes the place of the one before.  The stream's figures (rows in the state, rows
    dropped as late) are beside the result, a line of JSON a batch.
    """
    result = f"{checkpoint}/result"
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{result}/batch_none")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result}/batch_{number if mode == 'append' else 0}")

    with rocks_state(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        figures = [(p["batchId"], o["numRowsTotal"], o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"]]
    finally:
        query.stop()
    spark.createDataFrame(figures, FIGURES).coalesce(1).write.mode("append").json(f"{checkpoint}/figures")
    return spark.read.schema(stream.schema).parquet(f"{result}/*")


def figures(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(batch, state_rows, late_rows) of the runs over a checkpoint."""
    return spark.read.schema(FIGURES).json(f"{checkpoint}/figures")


def run_each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hand each micro-batch to ``write``, which gets a batch again after a failure and must overwrite, not append."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
