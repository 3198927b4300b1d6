"""Queries of counters, job states and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources.scratch import new_folder
from ..sources.tables import table
from ..streaming import keyed, streams


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.daily_quota(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 2)
    return out.select("event_id", "use_no", "allowed", "remaining")


def bulk_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("left_today", F.col("user_id") % 4)
    return state.reserve_within(e, "user_id", F.col("ts"), "event_id", F.col("left_today")).select("event_id", "user_id")


def quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("chat"), (F.col("c_custkey") % 7).cast("int").alias("explain"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 3).cast("int")).alias("reset_at"))
    return state.reset_stale(c, {"chat": 20, "explain": 10}, "reset_at", F.lit("2024-01-02").cast("date"), only="chat")


def global_usage_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.global_usage(table(spark, sf_dir, "events"), "ts", limit=350)


def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("client", F.col("user_id") % 5)
    out = state.rate_limited(e, "client", "ts", 1)
    return out.select("client", F.unix_timestamp("minute").alias("minute"), "n")


def job_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(s) for s in ("pending", "running", "running", "complete", "failed")))
    e = table(spark, sf_dir, "events").withColumn("job_state", F.get(names, (F.col("event_id") % 5).cast("int")))
    out = state.job_states(e, "user_id", "job_state", "ts", "event_id")
    return out.select("event_id", "previous", "job_state", "legal", "stale")


def insight_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    insights = c.select(F.col("c_custkey").alias("o_custkey"), F.lit("1997-01-01").cast("timestamp").alias("generated"))
    return state.is_stale(o, insights, "o_custkey", "o_orderdate", "generated").select("o_custkey", "is_stale")


def sse_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's words as server-sent lines, shuffled and with noise between, put together again."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = c.select(F.concat_ws("-", "conv_id", "turn").alias("message"), F.posexplode(F.split("text", " ")).alias("seq", "token"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("token").alias("kind"), "seq", F.concat("token", F.lit(" ")).alias("token"))))
    noise = words.where("seq % 3 = 0").select("message", F.lit("data: {broken").alias("line"))
    lines = words.select("message", line.alias("line")).unionByName(noise).unionByName(words.where("seq = 0").select("message", F.lit("data: [DONE]").alias("line")))
    out = streams.reassemble(streams.sse_events(lines), "message")
    return out.select("message", F.sha2("text", 256).alias("text_sha256"), "n_tokens")


def stream_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.daily_usage(streams.event_stream(spark, sf_dir, "events.parquet"))
    return streams.run_to_table(stream, new_folder(spark, "daily_usage"), "complete")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.sessions(streams.event_stream(spark, sf_dir, "events.parquet"))
    out = streams.run_to_table(stream, new_folder(spark, "sessions"), "complete")
    return out.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


def _arrivals(spark: SparkSession, rows: DataFrame, slices: int, name: str, only: range | None = None, folder: str | None = None) -> str:
    """A folder that a stream reads: one file for each number in the column ``slice``, the earlier ones older."""
    folder = folder or new_folder(spark, name)
    for k in only or range(slices):
        rows.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(folder)
    return folder


def _late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three slices by time; every fiftieth of the first days comes with the last slice, far too late."""
    e = table(spark, sf_dir, "events")
    e = e.withColumns({f.name: F.col(f.name).cast("timestamp") for f in e.schema if f.dataType.typeName() == "timestamp_ntz"})
    by_time = F.when(F.col("ts") < "2024-01-15", 0).when(F.col("ts") < "2024-01-22", 1).otherwise(2)
    return e.withColumn("slice", F.when((F.col("event_id") % 50 == 7) & (F.col("ts") < "2024-01-12"), 2).otherwise(by_time))


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly requests of each client in append mode: windows come once, when they are final, and late rows are dropped."""
    folder = _arrivals(spark, _late_events(spark, sf_dir), 3, "late_events")
    stream = streams.rate_windows(streams.event_stream(spark, folder, "*.parquet").withColumn("client", F.col("user_id") % 5), "client", "ts", "1 hour", late="1 hour")
    return streams.run_to_table(stream, new_folder(spark, "late")).select("client", F.unix_timestamp("started").alias("started"), "n")


def reservations_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reservation a key, taken over when it is stale, in a stream with late rows: what the watermark has passed is decided."""
    folder = _arrivals(spark, _late_events(spark, sf_dir), 3, "requests")
    events = streams.event_stream(spark, folder, "*.parquet").withColumn("owner", F.col("user_id") % 15)
    out = keyed.reservations(events, "owner", "event_id", "ts", F.col("event_type") == "purchase")
    return streams.run_to_table(out, new_folder(spark, "reservations")).select("key", "request", "outcome")


def reservations_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules over the whole table."""
    out = keyed.reservations_batch(table(spark, sf_dir, "events").withColumn("owner", F.col("user_id") % 15), "owner", "event_id", "ts", F.col("event_type") == "purchase")
    return out.select("key", "request", "outcome")


def stream_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn's words as frames in cut bytes, whose pieces come in three batches out of order, the last after a restart."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    body = F.concat(F.lit(": hello\n\n"), F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("data: "), w)), "\n\n"), F.lit("\n\ndata: cut o")).cast("binary")
    sent = turns.select(F.concat_ws("-", "conv_id", "turn").alias("message"), (F.col("conv_id") % 17 + 3).cast("int").alias("width"), body.alias("body"))
    cut = sent.select("message", "width", "body", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / F.col("width")))).alias("k"))
    pieces = cut.select("message", "k", F.substring("body", (F.col("k") * F.col("width") + 1).cast("int"), F.col("width")).alias("piece"), (F.col("k") * 7 % 3).alias("slice"))
    folder, state = _arrivals(spark, pieces, 3, "pieces", only=range(2)), new_folder(spark, "framed")

    def run() -> DataFrame:
        stream = spark.readStream.schema("message string, k long, piece binary").option("maxFilesPerTrigger", 1).parquet(folder)
        return streams.run_to_table(keyed.framed(stream, "message", "k", "piece"), state)

    run()
    _arrivals(spark, pieces, 3, "pieces", only=range(2, 3), folder=folder)
    frames = run().where("frame like 'data: _%'")
    return frames.groupBy(F.col("key").alias("message")).agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.length("frame") - 6).alias("chars"), F.max("frame_no").alias("last_no"))


QUERIES = {f.__name__: f for f in (daily_quota, bulk_reservation, quota_reset, global_usage_rollover, rate_limit_minute, job_state_machine, insight_staleness, sse_reassembly, stream_daily_usage, stream_sessions, stream_late_rows, reservations_stream, reservations_batch, stream_framed)}

_LAST = "(SELECT max(ts) FROM events)"
#: Each key's events in order; the reservation (owner, since) goes from one to the next.
_RESERVED = """WITH RECURSIVE e AS (SELECT user_id % 15 AS key, event_id AS request, epoch_ms(ts) AS at_ms, event_type = 'purchase' AS ends,
        row_number() OVER (PARTITION BY user_id % 15 ORDER BY epoch_ms(ts), event_id) AS k FROM events {where}),
      s AS (SELECT key, k, request, at_ms, CASE WHEN ends THEN 'ignored' ELSE 'granted' END AS outcome, CASE WHEN NOT ends THEN at_ms END AS since FROM e WHERE k = 1
        UNION ALL SELECT e.key, e.k, e.request, e.at_ms,
          CASE WHEN ends THEN CASE WHEN since IS NULL THEN 'ignored' ELSE 'finished' END WHEN since IS NULL THEN 'granted' WHEN e.at_ms - since > 600000 THEN 'taken over' ELSE 'refused' END,
          CASE WHEN ends THEN NULL WHEN since IS NULL OR e.at_ms - since > 600000 THEN e.at_ms ELSE since END
        FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)"""

SQL = {
    "daily_quota": """SELECT event_id, n AS use_no, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining
      FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id)::INT AS n FROM events)""",
    "bulk_reservation": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= user_id % 4",
    "quota_reset": """WITH c AS (SELECT c_custkey, (c_custkey % 5)::INT AS chat, (c_custkey % 7)::INT AS explain, (DATE '2024-01-01' + (c_custkey % 3)::INT) AS reset_at FROM customer)
      SELECT c_custkey, CASE WHEN reset_at < DATE '2024-01-02' THEN 20 ELSE chat END AS chat, explain, greatest(reset_at, DATE '2024-01-02') AS reset_at FROM c""",
    "global_usage_rollover": "SELECT ts::DATE AS day, count(*) AS requests, count(*) >= 315 AS warning, count(*) > 350 AS over FROM events GROUP BY 1",
    "rate_limit_minute": "SELECT user_id % 5 AS client, epoch(date_trunc('minute', ts))::BIGINT AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "job_state_machine": """WITH e AS (SELECT *, ['pending', 'running', 'running', 'complete', 'failed'][event_id % 5 + 1] AS job_state FROM events),
      p AS (SELECT *, lag(job_state) OVER w AS previous, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) AS since FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT event_id, previous, job_state, CASE WHEN previous IS NULL THEN job_state = 'pending' ELSE
        (previous = 'pending' AND job_state IN ('running', 'cancelled', 'failed')) OR (previous = 'running' AND job_state IN ('running', 'complete', 'failed', 'cancelled'))
        OR (previous IN ('failed', 'cancelled') AND job_state = 'pending') END AS legal, coalesce(previous = 'running' AND since > 600, false) AS stale FROM p""",
    "insight_staleness": "SELECT c_custkey AS o_custkey, coalesce(max(o_orderdate) > TIMESTAMP '1997-01-01', false) AS is_stale FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "sse_reassembly": """SELECT conv_id || '-' || turn AS message, sha256(text || ' ') AS text_sha256, len(string_split(text, ' '))::INT AS n_tokens FROM conversations WHERE role = 'assistant'""",
    "stream_daily_usage": "SELECT ts::DATE AS day, count(*) AS requests FROM events GROUP BY 1",
    "stream_late_rows": f"""SELECT user_id % 5 AS client, epoch(date_trunc('hour', ts))::BIGINT AS started, count(*) AS n FROM events
      WHERE NOT (event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-12') GROUP BY 1, 2, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_LAST} - INTERVAL 1 HOUR""",
    "reservations_stream": f"""{_RESERVED.format(where="WHERE NOT (event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-12')")} SELECT key, request, outcome FROM s WHERE at_ms <= (SELECT epoch_ms(max(ts)) FROM events) - 600000""",
    "reservations_batch": f"{_RESERVED.format(where='')} SELECT key, request, outcome FROM s",
    "stream_framed": """WITH w AS (SELECT conv_id || '-' || turn AS message, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
      n AS (SELECT conv_id || '-' || turn AS message, string_split(text, ' ') AS ws FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
      SELECT message, count(*) AS n_frames, sum(length(w))::BIGINT AS chars, any_value(list_max(list_filter(generate_series(1, len(ws)), lambda i: ws[i] <> ''))) AS last_no FROM w JOIN n USING (message) WHERE w <> '' GROUP BY message""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w > INTERVAL 30 MINUTES)::INT AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(coalesce(jump, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 30 MINUTES) AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
}
