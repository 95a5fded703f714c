"""The outbox as a stream: the reference polls its tables, here files trigger batches.

Events are appended as files.  Every micro-batch is one unit of work that can
be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veinstone.cluster import cut_lineage
from veinstone.operators.queue import due_events


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet",
                files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def publish_stream(events: DataFrame, publish: Callable[[DataFrame], DataFrame], target: str,
                   state: str, now: Column) -> StreamingQuery:
    """Publish each event once, when it is due; what is not due or has failed waits in a queue table.

    ``publish`` turns due events (all columns, attempts counted) into the same rows with their new
    status; failed ones come back as pending with a later ``available_at``.  The stream itself keeps
    no state: ``publish_step`` keeps the queue and the outcomes as tables.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        publish_step(batch, publish, target, now)

    return (events.writeStream.foreachBatch(run)
            .option("checkpointLocation", state).trigger(availableNow=True).start())


def publish_step(batch: DataFrame, publish: Callable[[DataFrame], DataFrame], target: str, now: Column) -> None:
    """One trigger: add new events to the queue, publish the due ones, write queue and outcomes.

    The step reads the newest complete step and writes the next, so a step that broke off is done again
    from the same queue.  Events whose id waits or is settled already are not new.
    """
    spark = batch.sparkSession
    step, waiting, settled = _newest(spark, target, batch.schema)
    fresh = batch.dropDuplicates(["id"]).join(waiting.select("id").unionByName(settled.select("id")), "id", "left_anti")
    queue = cut_lineage(waiting.unionByName(fresh))
    tried = cut_lineage(publish(queue.filter(due_events(now)).withColumn("attempts", F.col("attempts") + 1))
                        .select(*queue.columns))
    over = F.col("status").isin("published", "dead")
    tried.filter(over).write.mode("overwrite").parquet(f"{target}/settled/step={step + 1}")
    rest = queue.join(tried.select("id"), "id", "left_anti").unionByName(tried.filter(~over))
    rest.write.mode("overwrite").parquet(f"{target}/waiting/step={step + 1}")


def _newest(spark: SparkSession, target: str, schema) -> tuple[int, DataFrame, DataFrame]:
    """The number of the newest step with a complete queue, that queue, and all outcomes up to it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/waiting/step=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    step = max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)
    if not step:
        empty = spark.createDataFrame([], schema)
        return 0, empty, empty
    settled = spark.read.schema(schema).parquet(*[f"{target}/settled/step={i}" for i in range(1, step + 1)])
    return step, spark.read.schema(schema).parquet(f"{target}/waiting/step={step}"), settled


def outcomes(spark: SparkSession, target: str, schema) -> DataFrame:
    """Every event in its newest state: settled or still waiting."""
    _, waiting, settled = _newest(spark, target, schema)
    return settled.unionByName(waiting)


def status_counts_stream(events: DataFrame, target: str, state: str) -> StreamingQuery:
    """Running (event_type, status) counts; partial sums before the shuffle."""
    counts = events.groupBy("event_type", "status").agg(
        F.count("*").alias("n"), F.max("attempts").alias("max_attempts"))

    def run(snapshot: DataFrame, batch_id: int) -> None:
        snapshot.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (counts.writeStream.outputMode("complete").foreachBatch(run)
            .option("checkpointLocation", state).trigger(availableNow=True).start())
