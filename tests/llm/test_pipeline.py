import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import bpe, mixing, quality, simhash, toxicity
from skyloom.llm import queries as Q
from skyloom.llm.common import table


def test_pipeline_equals_plain_composition(spark, sf):
    """Decisions of the operators on each stage's own input, applied one after another without the stages' plumbing."""
    labels = Q.learnable(table(spark, sf, "labels"))
    d = table(spark, sf, "documents").toPandas()
    back = lambda p: spark.createDataFrame(p, table(spark, sf, "documents").schema)
    for score, keep in ((toxicity.score_toxicity, 0), (quality.score_quality, 1)):
        ok = {r.doc_id for r in score(back(d), labels).where(F.col("predicted") == keep).collect()}
        d = d[d.doc_id.isin(ok)]
    heads = {r.component_id for r in simhash.near_duplicates(back(d)).collect()}
    d = d[d.doc_id.isin(heads)]
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) <= set(d.doc_id)
    codec = bpe.codec(*Q.tokenizer())
    times = out.groupby("doc_id").size()
    assert times.max() <= 3
    text = d.set_index("doc_id").text
    size = {i: len(t.encode().split()) for i, t in text.items()}
    by = d.groupby("source", dropna=False).doc_id.apply(list)
    want = mixing.targets([(s, sum(size[i] for i in ids)) for s, ids in by.items()], [1, 2, 3])
    for s, ids in by.items():
        taken = sum(size[i] * int(times.get(i, 0)) for i in ids)
        assert abs(taken - float(want[s])) <= max(size[i] for i in ids)
    for r in out.drop_duplicates("doc_id").head(40).itertuples():
        ids = codec.encode(text[r.doc_id])
        assert bytes(r.ids) == ids.tobytes() and r.n_tokens == len(ids)


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_the_columns(spark, sf, k):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "", "en", None, 0), (3, "a b d", "en", "s", 5)]
    d = spark.createDataFrame(rows, table(spark, sf, "documents").schema)
    for x in (d, d.limit(0), d.withColumn("row", F.lit(1)).withColumn("times", F.lit(2))):
        out = corpus_pipeline.STAGES[k][1](spark, x, sf)
        assert k == 4 or out.columns == corpus_pipeline.COLUMNS
        rows = out.collect()
        assert k < 4 or len(rows) == x.count()


def test_pipeline_drops_planted_near_copies(spark, sf):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:50], "q1", *words[51:120], "q2", *words[121:]]), " ".join([*words[:20], *[f"z{i}" for i in range(30)], *words[50:]])]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() > 2
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], table(spark, sf, "documents").schema)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, sf).collect()} == {0, 2}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources])
def test_texts_are_shuffled_once(spark, sf, stage):
    """Rows that met by their key are not dealt anew to be numbered within it."""
    rows = [(i % 20, f"a b c d e f g{i % 20} h", "en", "s", 20) for i in range(40)]
    out = stage(spark, spark.createDataFrame(rows, table(spark, sf, "documents").schema), sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window [")
    assert "Exchange" not in plan[window : plan.index("Join", window)]
    assert {r.doc_id for r in out.collect()} <= set(range(20))


def test_folds():
    assert zlib.crc32(b"17") % 3 in (0, 1, 2)
