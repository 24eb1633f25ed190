"""Streams with state: expiry by timers, tails, progress; restarts go on from the checkpoint."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from skyloom.plans.tables import jobs
from skyloom.streaming import jobs as J
from skyloom.streaming import state as S


@pytest.fixture(scope="module")
def store(spark):
    S.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    later = time.time() + len(os.listdir(folder))
    for f in os.listdir(f"{folder}/{name}"):
        os.utime(f"{folder}/{name}/{f}", (later, later))


UPDATES = "job_id string, status string, last_updated timestamp"


def stream(spark, folder, schema=UPDATES):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_expiry_over_restarts(spark, store, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    os.mkdir(src)
    put(spark, src, "a", [("x", "complete", at(0)), ("y", "processing", at(0)), ("z", "error", at(10)), (None, "error", at(0)), ("w", "error", None)], UPDATES)
    put(spark, src, "b", [("z", "error", at(50)), ("t", "queued", at(105))], UPDATES)
    read = lambda: sorted((r.job_id, r.status, r.updated_us // 10**6 % 86400) for r in S.run_to_end(S.expired_stream(stream(spark, src), 100), out, ckpt).collect())
    assert read() == [("x", "complete", 0)]
    put(spark, src, "c", [("y", "complete", at(130)), ("x", "complete", at(140)), ("t", "queued", at(151))], UPDATES)
    assert read() == [("x", "complete", 0), ("z", "error", 50)]  # the state came back from the checkpoint
    put(spark, src, "d", [("t", "queued", at(260))], UPDATES)
    assert read() == [("x", "complete", 0), ("x", "complete", 140), ("y", "complete", 130), ("z", "error", 50)]


def test_expired_events_equal_the_batch(spark, sf, store, tmp_path):
    """The events in the order of their time, in two runs; what expires is what the table says at the end."""
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    j = jobs(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), "status", F.col("last_updated").cast("timestamp").alias("last_updated"))
    rows = j.orderBy("last_updated").collect()
    want = {r.job_id for r in J.expired(j, F.lit(max(r.last_updated for r in rows))).collect()}
    os.mkdir(src)
    half = len(rows) // 2
    put(spark, src, "a", rows[:half], UPDATES)
    S.run_to_end(S.expired_stream(stream(spark, src)), out, ckpt)
    put(spark, src, "b", rows[half:], UPDATES)
    got = [r.job_id for r in S.run_to_end(S.expired_stream(stream(spark, src)), out, ckpt).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_tails_and_progress(spark, store, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    os.mkdir(src)
    schema = "job_id int, number int, line string"
    told = []
    listener = S.Progress(lambda *x: told.append(x) or (1 / 0 if x[1] == 0 else None))
    spark.streams.addListener(listener)
    try:
        put(spark, src, "a", [(1, k, f"l{k}") for k in range(7)] + [(2, 5, None), (None, 1, "x"), (3, None, "x")], schema)
        run = lambda: S.run_to_end(S.tail_stream(stream(spark, src, schema), 3), out, ckpt, "tails", "update")
        last = lambda d: {k: [(r.number, r.line) for r in sorted(d.collect()) if r.job_id == k and r.batch == d.where(F.col("job_id") == k).agg(F.max("batch")).first()[0]] for k in (1, 2)}
        assert last(run()) == {1: [(4, "l4"), (5, "l5"), (6, "l6")], 2: [(5, "")]}
        put(spark, src, "b", [(1, 100, "end"), (1, 2, "old")], schema)
        assert last(run()) == {1: [(5, "l5"), (6, "l6"), (100, "end")], 2: [(5, "")]}
        for _ in range(50):
            if [x[1] for x in told].count(-1) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert {x[0] for x in told} == {"tails"} and max(x[2] for x in told) == 10 and [x[1] for x in told].count(-1) == 2
    assert all(isinstance(e, ZeroDivisionError) for e in listener.errors) and listener.errors


def test_expiry_does_not_depend_on_batches(spark, store, tmp_path):
    """A job that comes again after its lifetime has expired in between, also where one batch holds both; without Python for each job (F1)."""
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    os.mkdir(src)
    put(spark, src, "a", [("x", "complete", at(0)), ("x", "error", at(500)), ("t", "queued", at(1000))], UPDATES)
    found = S.expired_stream(stream(spark, src), 100)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert sorted((r.job_id, r.status, r.expired_ms % 86400000) for r in S.run_to_end(found, out, ckpt).collect()) == [("x", "complete", 100001), ("x", "error", 600001)]
