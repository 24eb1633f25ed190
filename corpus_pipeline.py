"""The corpus pipeline: reject toxic and poor documents, keep one of each near-duplicate group, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All stages read COLUMNS alone, so further columns, whatever their names, have no effect; an empty table gives no rows;
texts are taken whole, and a null text counts as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import bpe, mixing, quality, simhash, toxicity
from skyloom.llm.common import ensure_checkpoint_dir, table
from skyloom.llm.queries import learnable, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict toxic, repeated rows and null keys included."""
    scored = toxicity.score_toxicity(docs.select(COLUMNS), learnable(table(spark, sf_dir, "labels")), carry=True)
    return scored.where("predicted = 0").select("row.*")


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator predicts good, repeated rows and null keys included."""
    scored = quality.score_quality(docs.select(COLUMNS), learnable(table(spark, sf_dir, "labels")), carry=True)
    return scored.where("predicted = 1").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key that only rows of one id and one text share.

    Its fields may be null, as those of keys that come back from Python: a join of two kinds of keys would cast one, and
    what groups by the key after it would shuffle the texts again.
    """
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},text_hash:bigint>"
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("text_hash")).cast(kind).alias("row_key"))


def _first_of_key(docs: DataFrame) -> DataFrame:
    """One row of each key."""
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("source", "lang"))
    return docs.withColumn("nth", nth).where("nth = 1").drop("nth")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of texts whose sets of five-word shingles are linked by a similarity of 0.8 or more.

    A null id comes last. Of rows with one id and one text the first by source and language stays; texts without words are one group.
    """
    keyed = _keyed(docs)
    groups = simhash.near_copies(keyed, key="row_key")
    heads = groups.where("row_key = component_id").select("row_key").distinct()
    return _first_of_key(keyed.join(heads, "row_key", "left_semi")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows with one id and one text are one document, with the copies of all."""
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, key="row_key").where("times > 0").groupBy("row_key").agg(F.sum("times").cast("int").alias("times"))
    once = _first_of_key(keyed.join(taken, "row_key"))
    return once.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number and the digests; repeated rows and null keys as they come."""
    return bpe.encode_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained scores and hypergeometric draws are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's output lies as Parquet in the shared folder until the session ends."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs
