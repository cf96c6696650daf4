"""Streams: calls per minute, and history that grows by deliveries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.attribution import read_paths, replay, touched_paths
from millrace.plans.scope import seconds
from millrace.sources.ingest import new_commits


def minute_counts(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls and failures per minute, project and tool; a minute is final when the watermark has passed it."""
    by = calls.withColumn("called_at", F.col("called_at").cast("timestamp")).withWatermark("called_at", late).groupBy(F.window("called_at", "1 minute"), "project", "tool")
    out = by.agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failed"))
    return out.select((seconds(F.col("window.start")) / 60).cast("long").alias("minute"), "project", "tool", "calls", "failed")


def start_minute_counts(calls: DataFrame, path: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Appends final minutes to a Parquet folder, and ends when all input is read."""
    return minute_counts(calls, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_history(deliveries: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Appends each delivery's unknown commits to ``root/commits``; a batch that is delivered again adds nothing.

    A batch is written under its number, so that running it again replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(f"{root}/commits").filter(F.col("batch") != number)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = spark.createDataFrame([], "commit_id long, repo_slug string, sha string, batch long")
        fresh = new_commits(df, known).join(known.select("repo_slug", "sha"), ["repo_slug", "sha"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{root}/commits/batch={number}")

    return deliveries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RUNS = "repo_slug string, path string, start_line int, end_line int, commit_id long"


def current_runs(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest runs of every path: those of the last batch that touched it, which may have left none."""
    try:
        touched, runs = spark.read.parquet(f"{root}/touched"), spark.read.parquet(f"{root}/runs")
    except AnalysisException as e:  # no batch yet
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], RUNS)
    if before is not None:
        touched, runs = touched.filter(F.col("batch") < before), runs.filter(F.col("batch") < before)
    newest = touched.groupBy("repo_slug", "path").agg(F.max("batch").alias("batch"))
    return runs.join(newest, ["repo_slug", "path", "batch"]).select(*(c.split(" ")[0] for c in RUNS.split(", ")))


def append_attribution(changes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Replays each delivery's touched paths and writes only these, under the batch's number; ``current_runs`` reads the state."""

    def batch(df: DataFrame, number: int) -> None:
        touched = touched_paths(df)
        known = current_runs(df.sparkSession, root, number).join(read_paths(df), ["repo_slug", "path"], "left_semi")
        replay(df, known).write.mode("overwrite").parquet(f"{root}/runs/batch={number}")
        touched.write.mode("overwrite").parquet(f"{root}/touched/batch={number}")  # last: it makes the runs current

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
