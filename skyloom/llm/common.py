"""Shared plumbing of the corpus operators: tables, lineage cuts, models on executors, components."""

from __future__ import annotations

import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.spatial import components
from skyloom.session import cut, ensure_checkpoint_dir

__all__ = ["components", "cut", "ensure_checkpoint_dir"]

#: Rows that a function on rows gets at once.
TEXT_BATCH_ROWS = 1000
#: A class of rows is hot when it holds more than this share of them, so there are at most so many hot classes.
HOT_SHARE = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null ids have no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k)).cast("int")


def is_fold(doc_id: Column, k: int, remainder: int) -> Column:
    """Whether a row is in the fold; false for a null id."""
    return F.coalesce(fold(doc_id, k) == remainder, F.lit(False))


def raw(text: Column) -> Column:
    """The UTF-8 bytes of a text, which cross to Python undecoded; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_LOADED: dict[str, object] = {}


class Shipped:
    """A read-only model sent to executors once, unpickled once in each Python worker."""

    def __init__(self, spark: SparkSession, model: object):
        self.key = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(pickle.dumps(model, protocol=5))

    def get(self):
        return loaded(self.key, lambda: pickle.loads(self.data.value))


def loaded(key: object, make: Callable[[], object]):
    """The model of this key, made once. A worker serves one model at a time; older ones would only hold memory."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def release() -> None:
    """Gives freed memory back: workers live on from task to task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # no glibc


def map_rows(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``fn`` on every Arrow batch, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for start in range(0, b.num_rows, TEXT_BATCH_ROWS):
                    yield fn(b.slice(start, TEXT_BATCH_ROWS))
        release()

    return df.mapInArrow(run, schema)


def map_scored(docs: DataFrame, key: str, text: str, carry: bool, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``map_rows`` over (key, bytes of the text); with ``carry`` each row of ``docs`` comes along as a struct named row."""
    cols = [docs[key].alias(key), raw(docs[text]).alias("t")]
    if not carry:
        return map_rows(docs.select(*cols), schema, fn)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = fn(b.select([0, 1]))
        return pa.RecordBatch.from_arrays([*out.columns, b.column(2)], names=[*out.schema.names, "row"])

    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).schema["row"].dataType.simpleString()
    return map_rows(docs.select(*cols, F.struct(*[docs[c] for c in docs.columns]).alias("row")), f"{schema}, row {row}", run)


def sample_ids(labels: DataFrame, label: str, key: str, per_class: int, seed: str) -> tuple[DataFrame | None, dict[int, int]]:
    """At most ``per_class`` ids of each of the labels 0 and 1, by smallest hash, and how many rows each label has.

    Rows with a null id or label are left out; of several labels for one id the largest counts.
    """
    spark = labels.sparkSession
    clean = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    sizes = {int(r["y"]): int(r["n"]) for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = []
    for y in sizes:
        top = clean.where(F.col("y") == y).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(per_class)
        rows += [(r[key], y) for r in top.select(key).collect()]
    if not rows:
        return None, sizes
    kind = labels.schema[key].dataType.simpleString()
    return spark.createDataFrame(rows, f"{key} {kind}, y int"), sizes


def join_classes(rows: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """``rows`` with the columns of their class in ``classes(on, n, ...)``, where n is how many rows it has.

    Classes that hold more than one in HOT_SHARE of all rows are at most HOT_SHARE in number and are broadcast, so no
    task gathers a large class; the others meet their rows by key.
    """
    classes = cut(classes)
    bound = max(1000, (classes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot, rest = F.broadcast(classes.where(F.col("n") > bound)), classes.where(F.col("n") <= bound)
    by_key = rows.join(hot.select(on), on, "left_anti").join(rest, on)
    return rows.join(hot, on).unionByName(by_key).drop("n")
