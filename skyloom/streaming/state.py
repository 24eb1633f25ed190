"""Job state in streams: expiry by session windows, the last lines of each job, and progress for a callback.

State lives in the state store of the query and its checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from skyloom.streaming.jobs import LIFETIME_S

#: Spark's state store with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("complete", "error")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def expired_stream(updates: DataFrame, lifetime: float = LIFETIME_S, late: str = "0 seconds") -> DataFrame:
    """Stream of (job_id, status, updated_us, expired_ms) from a stream of ``updates(job_id, status, last_updated)``.

    Time is that of the updates: a job expires when some update is more than ``lifetime`` seconds later than its own last
    one, to the millisecond. An update starts its job's time afresh, also after it has expired, however batches are cut:
    updates of a job that follow each other within its lifetime are one session, given out by its last update when the
    watermark passes its end. State lives in Spark's session windows, without a call to Python for each job. Of updates
    at one time the greatest status counts. Updates that are ``late`` behind the newest by more are dropped, those without time too.
    """
    rows = updates.where("job_id is not null and last_updated is not null").select("job_id", F.coalesce("status", F.lit("")).alias("status"), F.col("last_updated").cast("timestamp").alias("at"))
    timed = rows.select("job_id", "status", F.unix_micros("at").alias("updated_us"), F.date_trunc("millisecond", "at").alias("last_updated")).withWatermark("last_updated", late)
    still = F.session_window("last_updated", f"{round(1000 * lifetime) + 1} milliseconds")
    last = timed.groupBy(still.alias("span"), "job_id").agg(F.max(F.struct("updated_us", "status")).alias("last"))
    return last.where(F.col("last.status").isin(*DONE)).select("job_id", "last.status", "last.updated_us", F.unix_millis("span.end").alias("expired_ms"))


class Tail(StatefulProcessor):
    """The last lines of each job, ordered by their number."""

    def __init__(self, lines: int):
        self.lines = lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "number long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(x) for x in self.kept.get()] if self.kept.exists() else []
        for pdf in rows:
            kept = sorted(kept + list(zip(pdf["number"].tolist(), pdf["line"].tolist(), strict=True)))[-self.lines :]
        self.kept.put(kept)
        yield pd.DataFrame({"job_id": key[0], "number": [n for n, _ in kept], "line": [x for _, x in kept]})

    def close(self) -> None:
        pass


def tail_stream(lines: DataFrame, n: int) -> DataFrame:
    """Stream of (job_id, number, line): each time a job has new lines, its last ``n`` by number, ties by line.

    ``lines(job_id, number, line)``; a null line is empty, rows without a job or a number are dropped. State and output
    of a job are bounded by ``n``.
    """
    kind = lines.schema["job_id"].dataType.simpleString()
    rows = lines.where("job_id is not null and number is not null").select("job_id", F.col("number").cast("long").alias("number"), F.coalesce("line", F.lit("")).alias("line"))
    return rows.groupBy("job_id").transformWithStateInPandas(Tail(n), f"job_id {kind}, number long, line string", "Update", "None")


class Progress(StreamingQueryListener):
    """Calls ``report(name, batch, rows)`` for each batch of a named query, with the rows read so far; ``report(name, -1, rows)`` at its end.

    What the callback raises is kept in ``errors`` and does not stop the query.
    """

    def __init__(self, report: Callable[[str, int, int], None]):
        self.report, self.rows, self.names, self.errors = report, {}, {}, []

    def _call(self, *args) -> None:
        try:
            self.report(*args)
        except Exception as e:  # noqa: BLE001  a callback's fault is not the stream's
            self.errors.append(e)

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or ""
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.rows[run] = self.rows.get(run, 0) + p.numInputRows
        self._call(p.name or "", p.batchId, self.rows[run])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._call(self.names.get(run, ""), -1, self.rows.get(run, 0))


def run_to_end(stream: DataFrame, folder: str, checkpoint: str, name: str = "jobs", mode: str = "append") -> DataFrame:
    """All that is there now, appended to Parquet files in ``folder``; the table written so far."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.queryName(name).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination()
    else:  # files cannot be updated: each batch is appended with its number, the last for a key counts

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

        stream.writeStream.queryName(name).foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder) if mode == "append" else spark.read.parquet(folder)
