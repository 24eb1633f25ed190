"""Nearness and components within a radius, without a list of point pairs.

Points are grouped to boxes that know their bounds, their number and one point. Whether a point is near a box mostly
follows from those; where it does not, the box is split into 64 and only its parts that lie across the radius are asked
again, until a part holds so few points that each can be compared. A crowded cell costs a few boxes, not its square.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.spatial import AXES, components
from skyloom.session import cut

#: Points of a box that are compared one by one.
FEW = 32
#: Splits of a box by 4 on each side; boxes are then 4^-15 of the radius wide, and points in one place are one.
LEVELS = 15
#: Bounds decide only beyond this share of the radius; nearer cases go on to the points.
SLACK = 1e-9


def sound(points: DataFrame) -> DataFrame:
    """Points without null, NaN or infinite coordinates."""
    return points.where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf")) for x in AXES]))


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((p**2 for p in parts), F.lit(0.0)))


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, bounds and one point of each group."""
    bounds = [f(a).alias(f"{name}_{a}") for f, name in ((F.min, "low"), (F.max, "high")) for a in AXES]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*AXES)).alias("one"), *bounds)


def _status(radius: float) -> Column:
    """near, far or open: a point x, y, z against a box."""
    one = _norm([F.col(a) - F.col(f"one.{a}") for a in AXES])
    gap = _norm([F.greatest(F.col(f"low_{a}") - F.col(a), F.col(a) - F.col(f"high_{a}"), F.lit(0.0)) for a in AXES])
    most = _norm([F.greatest(F.abs(F.col(a) - F.col(f"low_{a}")), F.abs(F.col(a) - F.col(f"high_{a}"))) for a in AXES])
    return F.when((one <= radius) | (most < radius * (1 - SLACK)), "near").when(gap > radius * (1 + SLACK), "far").otherwise("open")


def decide(asks: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """The targets t, once each, for which some row of ``asks(t, x, y, z, g)`` has a point of ``points(g, x, y, z)`` within reach.

    A target that is decided asks no more. Points at one place count once.
    """
    points = points.select("g", *AXES).distinct()
    part = lambda level: [F.floor(F.col(a) / radius * 4**level).cast("long").alias(f"s_{a}") for a in AXES]
    parts = [f"s_{a}" for a in AXES]
    asked = asks.select("t", *AXES, "g").join(_boxes(points, ["g"]), "g")
    found: list[DataFrame] = []
    for level in range(LEVELS + 1):
        judged = cut(asked.withColumn("status", _status(radius)).where("status <> 'far'").select("t", *AXES, "g", *(parts if level else []), "n", "status"))
        near = judged.where("status = 'near'").select("t").distinct()
        open_ = judged.where("status = 'open'").join(near, "t", "left_anti")
        keys = ["g", *parts] if level else ["g"]
        own = points.select("g", *(part(level) if level else []), *[F.col(a).alias(f"p_{a}") for a in AXES])
        few = open_ if level == LEVELS else open_.where(F.col("n") <= FEW)
        close = few.join(own, keys).where(_norm([F.col(a) - F.col(f"p_{a}") for a in AXES]) <= radius).select("t").distinct()
        now = cut(near.union(close))
        found.append(now)
        rest = cut(open_.where(F.col("n") > FEW).join(now, "t", "left_anti").drop("n", "status"))
        if level == LEVELS or rest.isEmpty():
            break
        crowded = points.join(rest.select("g").distinct(), "g", "left_semi").select("g", *AXES, *part(level + 1))
        boxes = _boxes(crowded, ["g", *parts])
        if level:
            boxes = boxes.withColumns({f"up_{a}": F.shiftright(f"s_{a}", 2) for a in AXES})
            rest = rest.withColumnsRenamed({s: f"up_{a}" for s, a in zip(parts, AXES, strict=True)})
        asked = rest.join(boxes, ["g", *[f"up_{a}" for a in AXES]] if level else ["g"])
    return reduce(DataFrame.union, found).distinct()


def _steps(reach: int, half: bool = False) -> Column:
    steps = [(i, j, k) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) for k in range(-reach, reach + 1)]
    return F.array(*[F.struct(*[F.lit(d).cast("long").alias(a) for d, a in zip(s, AXES, strict=True)]) for s in steps if not half or s > (0, 0, 0)])


def near_groups(left: DataFrame, right: DataFrame, radius: float, id: str = "splat_id", group: str = "frame_idx") -> DataFrame:
    """(id, group), once each: the groups of ``right`` with some point at distance <= radius of a point of ``left``.

    Points with unsound coordinates are near none, groups that are null have no points.
    """
    edge = lambda a: F.floor(F.col(a) / radius).cast("long").alias(f"c_{a}")
    cells = [f"c_{a}" for a in AXES]
    r = sound(right).where(F.col(group).isNotNull()).select(F.col(group).alias("group"), *[F.col(a).cast("double").alias(a) for a in AXES])
    r = r.select("group", *AXES, *[edge(a) for a in AXES])
    l = sound(left).select(F.col(id).alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    l = l.select("*", F.explode(_steps(1)).alias("d")).select("id", *AXES, *[(edge(a) + F.col(f"d.{a}")).alias(f"c_{a}") for a in AXES])
    g = F.struct("group", *cells).alias("g")
    asks = l.join(r.select("group", *cells).distinct(), cells).select(F.struct("id", "group").alias("t"), *AXES, g)
    return decide(asks, r.select(g, *AXES), radius).select(F.col("t.id").alias(id), F.col("t.group").alias(group))


def near_any(left: DataFrame, right: DataFrame, radius: float, id: str = "splat_id") -> DataFrame:
    """The ids of ``left``, once each, with some point of ``right`` at distance <= radius."""
    return near_groups(left, right.select(*AXES, F.lit(0).alias("_all")), radius, id, "_all").select(id)


def near_components(points: DataFrame, radius: float, id: str = "splat_id") -> DataFrame:
    """(node, component) of the graph that links points at distance <= radius: every sound point with the least id reached.

    Cells whose diagonal is within the radius are nodes: all their points hang together. Cells are linked by their
    bounds or their one point where those suffice; only for cells that this leaves apart are points asked, those of the
    smaller against the boxes of the larger. Rows that share an id are one node.
    """
    edge = radius / 3**0.5 * (1 - SLACK)
    cells = [f"c_{a}" for a in AXES]
    p = sound(points).where(F.col(id).isNotNull()).select(F.col(id).alias("id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    p = p.select("*", *[F.floor(F.col(a) / edge).cast("long").alias(f"c_{a}") for a in AXES])
    boxes = cut(_boxes(p, cells).join(p.groupBy(*cells).agg(F.min("id").alias("name")), cells))
    named = cut(p.join(boxes.select(*cells, "name"), cells).select("id", *AXES, F.col("name").alias("g")))
    other = boxes.select(*cells, *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c not in cells])
    pairs = boxes.select("*", F.explode(_steps(2, half=True)).alias("d")).select(*[c for c in boxes.columns if c not in cells], *[(F.col(f"c_{a}") + F.col(f"d.{a}")).alias(f"c_{a}") for a in AXES]).join(other, cells)
    gap = _norm([F.greatest(F.col(f"low_{a}") - F.col(f"b_high_{a}"), F.col(f"b_low_{a}") - F.col(f"high_{a}"), F.lit(0.0)) for a in AXES])
    most = _norm([F.greatest(F.col(f"high_{a}") - F.col(f"b_low_{a}"), F.col(f"b_high_{a}") - F.col(f"low_{a}")) for a in AXES])
    one = _norm([F.col(f"one.{a}") - F.col(f"b_one.{a}") for a in AXES])
    pairs = cut(pairs.where(gap <= radius * (1 + SLACK)).select(F.col("name").alias("a"), F.col("b_name").alias("b"), "n", "b_n", ((one <= radius) | (most < radius * (1 - SLACK))).alias("sure")))
    spread = named.groupBy("id").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b")  # an id at several places
    same = named.join(spread.select("id", "a"), "id").select("a", F.col("g").alias("b")).where("a <> b").distinct()
    links = pairs.where("sure").select("a", "b").union(same)
    first = components(links)
    label = lambda d, c: d.join(first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    apart = label(label(pairs.where("not sure"), "a"), "b").where("a_in <> b_in")
    small = F.col("n") <= F.col("b_n")
    apart = apart.select(F.struct("a", "b").alias("t"), F.when(small, F.col("a")).otherwise(F.col("b")).alias("asks"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("g"))
    asks = apart.join(named.select(F.col("g").alias("asks"), *AXES), "asks").select("t", *AXES, "g")
    more = decide(asks, named, radius).select("t.a", "t.b")
    found = components(links.union(more))
    nodes = named.join(found, F.col("g") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "g").alias("component"))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
