"""Substring joins against a plain loop."""

import random
import uuid

import pytest

from skyloom.operators.textjoin import containing
from skyloom.streaming import jobs as J


def plain(texts, patterns):
    return sorted({(t, p) for t in texts if t is not None for p in patterns if p and p in t})


@pytest.mark.parametrize("gram", [1, 4])
def test_containing_equals_loop(spark, gram):
    rng = random.Random(gram)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(60)]
    texts = [f"out/{i}_final.ply" for i in ids] + [f"{a}{b}" for a, b in zip(ids, ids[1:])] + ["", None, "a", "é漢字", "x" * 3000, ids[0], ids[0]]
    patterns = ids[::3] + [ids[1][:9], ids[2][5:8], "a", "-", "漢字", "é", "", None, "zzzz", "x" * 2999, "x" * 3001, ".ply", ids[0]]
    got = containing(spark.createDataFrame([(t, 1) for t in texts], "path string, t int"), spark.createDataFrame([(p, 2) for p in patterns], "job_id string, p int"), gram=gram, part=7)
    assert sorted(map(tuple, got.collect())) == plain(texts, patterns)


def test_containing_small(spark):
    none = spark.createDataFrame([], "path string"), spark.createDataFrame([], "job_id string")
    some = spark.createDataFrame([("a1",)], "path string"), spark.createDataFrame([("1",)], "job_id string")
    assert containing(none[0], some[1]).count() == containing(some[0], none[1]).count() == 0
    assert containing(*some).collect() == [("a1", "1")]


def test_no_cross_join(spark):
    t = spark.range(1000).selectExpr("cast(id as string) as path")
    plan = containing(t, t.selectExpr("path as job_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan


def test_active_files(spark):
    live, done = "3f2b8c1e-1111-4222-8333-abcdefabcdef", "00000000-1111-4222-8333-abcdefabcdef"
    files = [(f"results/{live}_out.ply",), (f"results/{live}.ply",), (f"results/{done}_out.ply",), ("results/notes.txt",), ("results/notes.txt",), (None,)]
    active = spark.createDataFrame([(live,), (None,), ("",)], "job_id string")
    left = [r.path for r in J.unprotected_files(spark.createDataFrame(files, "path string"), active).collect()]
    assert sorted(map(str, left)) == sorted(["None", "results/notes.txt", "results/notes.txt", f"results/{done}_out.ply"])


def test_nothing_is_broadcast(spark, sf):
    """Exploded grams are estimated as small as their table; none may go through the driver for that (F3)."""
    from skyloom.plans.refine import jn20_uuid

    plan = jn20_uuid(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
