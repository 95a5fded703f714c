"""Durable queues as tables: who is due, who takes it, what a failure does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_LEASE, EVENT_LEASE = "15 minutes", "5 minutes"
MAX_ATTEMPTS, MAX_DELAY = 5, 300


def due_events(now: Column) -> Column:
    return (F.col("status") == "pending") & (F.col("available_at") <= now)


def claimable_jobs(now: Column) -> Column:
    return (F.col("status") == "queued") | (
        (F.col("status") == "running") & (F.col("lease_until") < now))


def expired_leases(now: Column) -> Column:
    return (F.col("status") == "processing") & (F.col("lease_until") < now)


def claim(queue: DataFrame, condition: Column, running: str, lease: str, now: Column,
          n: int) -> DataFrame:
    """The oldest ``n`` claimable rows, leased; a top-n scan, no full sort."""
    oldest = queue.filter(condition).orderBy("created_at", "id").limit(n)
    return oldest.withColumns({
        "status": F.lit(running), "attempts": F.col("attempts") + 1,
        "lease_until": now + F.expr(f"INTERVAL {lease}")})


def recover(queue: DataFrame, now: Column) -> DataFrame:
    """Expired leases go back to pending."""
    lost = expired_leases(now)
    return queue.withColumns({
        "status": F.when(lost, "pending").otherwise(F.col("status")),
        "lease_until": F.when(lost, F.lit(None)).otherwise(F.col("lease_until"))})


def retry_delay(attempts: Column) -> Column:
    """min(300, 2^min(attempts, 8)) seconds."""
    return F.least(F.lit(MAX_DELAY), F.pow(F.lit(2), F.least(attempts, F.lit(8))).cast("int"))


def fail(events: DataFrame, now: Column) -> DataFrame:
    """Failed attempts: pending again after a delay, dead from the fifth on."""
    seconds = F.make_dt_interval(secs=retry_delay(F.col("attempts")).cast("decimal(18,6)"))
    return events.withColumns({
        "status": F.when(F.col("attempts") >= MAX_ATTEMPTS, "dead").otherwise("pending"),
        "available_at": now + seconds, "lease_until": F.lit(None).cast("timestamp")})


def retry_jobs(jobs: DataFrame) -> DataFrame:
    """Finished jobs may be asked again: a new queued row, history stays."""
    return jobs.filter(F.col("status").isin("failed", "succeeded")).select(
        "document_id", "version_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"))
