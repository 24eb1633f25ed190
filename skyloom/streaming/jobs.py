"""Job tables: queue positions, counts, expiry, and a progress stream.

The originals poll dictionaries; a stream over a folder of logs is an extension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.text import age_seconds, progress
from skyloom.operators.textjoin import containing

LIFETIME_S = 7200


def expired(jobs: DataFrame, now: Column, lifetime: float = LIFETIME_S) -> DataFrame:
    """Finished or failed jobs that are older than their lifetime."""
    return jobs.where(F.col("status").isin("complete", "error") & (age_seconds(now, F.col("last_updated")) > lifetime))


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def queue_positions(jobs: DataFrame, shards_by: str = "job_id") -> DataFrame:
    """(job_id, position) of queued jobs, oldest first.

    Ranks are counted in two steps, within days and over the days before, so no task sorts the whole queue.
    """
    queued = jobs.where("status = 'queued'").withColumn("day", F.date_trunc("day", "created_at"))
    days = queued.groupBy("day").agg(F.count("*").alias("n"))
    before = days.withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = queued.withColumn("own", F.row_number().over(Window.partitionBy("day").orderBy("created_at", "job_id")))
    return own.join(before, "day").select("job_id", (F.col("own") + F.col("earlier")).alias("position"))


def unprotected_files(files: DataFrame, active: DataFrame) -> DataFrame:
    """Files whose path contains no active job's id, wherever in it; null and empty ids protect nothing.

    Repeated paths stay as often as they come, a null path is unprotected.
    """
    held = containing(files, active, "path", "job_id").select("path").distinct()
    return files.join(held.hint("merge"), "path", "left_anti")


def tail(lines: DataFrame, n: int, by: str, order: str) -> DataFrame:
    return lines.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def progress_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (path, done, total) from lines ``a/b`` in the text files of a folder."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), progress(F.col("value")).alias("p"))
    return lines.where("p is not null").select("path", "p.done", "p.total")
