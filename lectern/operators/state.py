"""Counters and state machines in batch form; streaming has the same rules on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_quota(uses: DataFrame, user: str, feature: str, ts: str, key: str, quota: int) -> DataFrame:
    """Each use with its number of the day and whether the user's quota for the feature still allowed it."""
    today = Window.partitionBy(user, feature, F.to_date(ts)).orderBy(ts, key)
    return uses.withColumn("use_no", F.row_number().over(today)).withColumn("allowed", F.col("use_no") <= quota).withColumn("remaining", F.greatest(F.lit(0), F.lit(quota) - F.col("use_no")))


def reset_stale(rows: DataFrame, counters: dict[str, int], reset_at: str, today: Column, only: str | None = None) -> DataFrame:
    """Counters of rows last reset before today go back to their defaults.

    With ``only``, as when one feature is used, that counter alone is refilled while the date moves on, so the others keep
    what they had.
    """
    stale = F.col(reset_at) < today
    cols = {c: F.when(stale, F.lit(n)).otherwise(F.col(c)) for c, n in counters.items() if only in (None, c)}
    return rows.withColumns(cols | {reset_at: F.greatest(F.col(reset_at), today)})


def global_usage(events: DataFrame, ts: str, limit: int = 1000, warn: float = 0.9) -> DataFrame:
    """Requests of each UTC day and whether they reached the warning and the limit."""
    days = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    return days.withColumn("warning", F.col("requests") >= int(limit * warn)).withColumn("over", F.col("requests") > limit)


def rate_limited(events: DataFrame, client: str, ts: str, per_minute: int) -> DataFrame:
    """Minutes in which a client went over its limit."""
    counts = events.groupBy(client, F.window(ts, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > per_minute).select(client, F.col("w.start").alias("minute"), "n")


#: from -> states that may follow
JOB_STEPS = {"pending": ("running", "cancelled", "failed"), "running": ("running", "complete", "failed", "cancelled"), "complete": (), "failed": ("pending",), "cancelled": ("pending",)}


def job_states(events: DataFrame, job: str, state: str, ts: str, key: str, stale_seconds: int = 600) -> DataFrame:
    """Each job event with the state before it, whether the step is legal, and whether a running job had gone stale."""
    order = Window.partitionBy(job).orderBy(ts, key)
    before, since = F.lag(state).over(order), F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(order))
    legal = F.lit(False)
    for source, targets in JOB_STEPS.items():
        if targets:
            legal = legal | ((before == source) & F.col(state).isin(*targets))
    first = before.isNull() & (F.col(state) == "pending")
    return events.withColumn("previous", before).withColumn("legal", F.coalesce(first | legal, F.lit(False))).withColumn("stale", F.coalesce((before == "running") & (since > stale_seconds), F.lit(False)))


def reserve_within(candidates: DataFrame, owner: str, order: Column, tie: str, remaining: Column) -> DataFrame:
    """Bulk reservation: the first candidates of each owner that its remaining quota covers."""
    line = Window.partitionBy(owner).orderBy(order, tie)
    return candidates.withColumn("__k", F.row_number().over(line)).where(F.col("__k") <= remaining).drop("__k")


def is_stale(changes: DataFrame, insights: DataFrame, key: str, changed: str, generated: str) -> DataFrame:
    last = changes.groupBy(key).agg(F.max(changed).alias("__last"))
    return insights.join(last, key, "left").withColumn("is_stale", F.coalesce(F.col("__last") > F.col(generated), F.lit(False))).drop("__last")


def progress(done: Column, total: Column) -> Column:
    return F.floor(F.try_divide(done * 100, total)).cast("int")
