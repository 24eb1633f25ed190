"""The driver's tables read as rasters, frames, splats, masks and jobs, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import rotations as R

WIDTH = 200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RASTER_SQL = f"""raster AS (SELECT CAST(o_orderkey // {WIDTH} AS INTEGER) AS v, CAST(o_orderkey % {WIDTH} AS INTEGER) AS u,
 o_totalprice / 10000 AS depth FROM orders),
dims AS (SELECT CAST(MAX(v) + 1 AS DOUBLE) AS h, {WIDTH}.0::DOUBLE AS w FROM raster)"""
FRAMES_SQL = f"""frames AS (SELECT l_linenumber AS frame_idx, CAST(l_orderkey // {WIDTH} AS INTEGER) AS v, CAST(l_orderkey % {WIDTH} AS INTEGER) AS u,
 AVG(l_extendedprice / 1000) AS raw, MIN(o_totalprice / 10000) AS rendered, AVG(l_discount * 10) + 0.0 AS alpha
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
dims AS (SELECT CAST(MAX(o_orderkey) // {WIDTH} + 1 AS DOUBLE) AS h, {WIDTH}.0::DOUBLE AS w FROM orders)"""
SPLATS_SQL = """raw_splats AS (SELECT vec_id AS splat_id, label AS frame_idx, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
normed AS (SELECT *, sqrt(e[7]*e[7]+e[8]*e[8]+e[9]*e[9]+e[10]*e[10]) AS qn FROM raw_splats),
splats AS (SELECT splat_id, frame_idx, e[1] AS x, e[2] AS y, e[3] AS z, exp(e[4]) AS sx, exp(e[5]) AS sy, exp(e[6]) AS sz,
 e[7]/qn AS qw, e[8]/qn AS qx, e[9]/qn AS qy, e[10]/qn AS qz,
 1/(1+exp(-e[11])) AS r, 1/(1+exp(-e[12])) AS g, 1/(1+exp(-e[13])) AS b, e[14] AS opacity_logit, 1/(1+exp(-e[14])) AS opacity FROM normed)"""
MASKS_SQL = "masks AS (SELECT user_id AS cam_id, CAST((user_id * 24) % 360 AS DOUBLE) AS azimuth, value > 150 AS hole, event_id FROM events)"
JOBS_SQL = """jobs AS (SELECT event_id AS job_id, ts AS last_updated, ts AS created_at,
 CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' WHEN 'click' THEN 'queued' ELSE 'processing' END AS status FROM events)"""


def raster(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.floor(key / WIDTH).cast("int").alias("v"), (key % WIDTH).cast("int").alias("u"), (F.col("o_totalprice") / 10000).alias("depth"))


def height(raster: DataFrame) -> Column:
    """Rows of a raster, as a scalar subquery."""
    return raster.agg((F.max("v") + 1).cast("double")).scalar()


def width() -> Column:
    return F.lit(float(WIDTH))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    key = F.col("l_orderkey")
    px = [F.col("l_linenumber").alias("frame_idx"), F.floor(key / WIDTH).cast("int").alias("v"), (key % WIDTH).cast("int").alias("u")]
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return joined.groupBy(*px).agg(F.avg(F.col("l_extendedprice") / 1000).alias("raw"), F.min(F.col("o_totalprice") / 10000).alias("rendered"), (F.avg(F.col("l_discount") * 10) + 0.0).alias("alpha"))


def splats(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("splat_id"), F.col("label").alias("frame_idx"), *[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(14)])
    c = {i: F.col(f"e{i}") for i in range(1, 15)}
    q = R.normalized((c[7], c[8], c[9], c[10]))
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    return e.select(
        "splat_id", "frame_idx", c[1].alias("x"), c[2].alias("y"), c[3].alias("z"), F.exp(c[4]).alias("sx"), F.exp(c[5]).alias("sy"), F.exp(c[6]).alias("sz"),
        q[0].alias("qw"), q[1].alias("qx"), q[2].alias("qy"), q[3].alias("qz"), *[sigmoid(c[i]).alias(n) for i, n in ((11, "r"), (12, "g"), (13, "b"))], c[14].alias("opacity_logit"), sigmoid(c[14]).alias("opacity"),
    )


def masks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("cam_id"), ((F.col("user_id") * 24) % 360).cast("double").alias("azimuth"), (F.col("value") > 150).alias("hole"), "event_id")


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "queued").otherwise("processing")
    return e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("last_updated"), F.col("ts").alias("created_at"), status.alias("status"))


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros: engines differ in the last bits."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_rounded(body: tuple[str, str], keys: str, values: list[str], digits: int = 6) -> str:
    """``SELECT keys, round(values) FROM (...)`` around the last SELECT of ``body`` (its WITH list, then the SELECT)."""
    with_list, select = body
    cols = ", ".join([keys] * bool(keys) + [f"round({v}, {digits}) + 0.0 AS {v}" for v in values])
    return f"WITH {with_list} SELECT {cols} FROM ({select})"
