"""Edges against a merged region: the parts inside it, on its border, and outside.

The region is cut into trapezoids by tile.  What an edge shares with a
trapezoid is an interval of the edge in closed form, and the trapezoid lies at
its left, at its right, or at both hands.  Where both hands are covered the
edge is inside, where one is it runs along the border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import lattice
from lamina.operators.trapezoids import SIDE, trapezoids
from lamina.sources.staging import staged

#: Edges longer than this are cut, so that no task orders all of a long edge.
PIECE = 1024
#: Distances below this, in database units, count as none.
NEAR = 1e-7
#: Where a part of an edge may lie.
PLACES = ("inside", "border", "outside")


def edge_parts(edges: DataFrame, polygons: DataFrame, tags: tuple[str, ...] = (), size: int = SIDE) -> DataFrame:
    """Parts of edges (*tags, id, x1, y1, x2, y2) against polygons (*tags, pts[, holes]) taken as one region: (*tags, id, t0, t1, place).

    ``t0`` and ``t1`` are distances from the edge's start and ``place`` is
    inside, border or outside; parts of one edge do not overlap and fill it, and
    one longer than ``PIECE`` has a cut at each.  Edges are told apart by tags
    and id; those without length give nothing, those with a null tag lie outside.
    """
    region = staged(trapezoids(polygons.withColumn("side", F.lit("a")), "or", tags, size=size).where(F.col("top") - F.col("y") > NEAR), "trapezoids")
    length = F.sqrt(F.pow((F.col("x2") - F.col("x1")).cast("double"), 2) + F.pow((F.col("y2") - F.col("y1")).cast("double"), 2))
    cut = edges.select(*tags, "id", "x1", "y1", "x2", "y2", length.alias("length")).where("length > 0").withColumn("n", F.ceil(F.col("length") / PIECE))
    cut = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * (k / F.col("n"))
    k = F.col("part")
    ends = {"ax": at("x1", "x2", k), "ay": at("y1", "y2", k), "bx": at("x1", "x2", k + 1), "by": at("y1", "y2", k + 1), "long": F.col("length") / F.col("n")}
    pieces = cut.withColumns(ends).select(*tags, "id", "part", *ends)
    low, high = (lambda c: F.least(f"a{c}", f"b{c}")), (lambda c: F.greatest(f"a{c}", f"b{c}"))
    cells = lambda c: F.explode(F.sequence((F.ceil(low(c) / size) - 1).cast("long"), F.floor(high(c) / size).cast("long")))
    dealt = pieces.withColumn("tx", cells("x")).withColumn("ty", cells("y"))
    # which side of the edge a point lies on, as a distance
    hand = lambda x, y: ((F.col("bx") - F.col("ax")) * (y - F.col("ay")) - (F.col("by") - F.col("ay")) * (x - F.col("ax"))) / F.col("long")
    left, down = F.col("tx") * float(size), F.col("ty") * float(size)
    tile_corners = F.array(*[hand(x, y) for x in (left, left + size) for y in (down, down + size)])
    dealt = dealt.where((F.array_min(tile_corners) <= NEAR) & (F.array_max(tile_corners) >= -NEAR))

    same = [F.col(f"e.{c}") == F.col(f"z.{c}") for c in (*tags, "tx", "ty")]
    near = (F.col("y") <= high("y")) & (F.col("top") >= low("y")) & (F.least("l0", "l1") <= high("x")) & (F.greatest("r0", "r1") >= low("x"))
    met = dealt.alias("e").join(region.alias("z"), [*same, near])
    slope = lambda side, y: F.col(f"{side}0") + (F.col(f"{side}1") - F.col(f"{side}0")) * (y - F.col("y")) / (F.col("top") - F.col("y"))
    walls = [lambda x, y: y - F.col("y"), lambda x, y: F.col("top") - y, lambda x, y: x - slope("l", y), lambda x, y: slope("r", y) - x]
    limits = [F.struct(f(F.col("ax"), F.col("ay")).alias("g0"), f(F.col("bx"), F.col("by")).alias("g1")) for f in walls]
    outer = reduce(lambda p, q: p | q, [(g["g0"] < -NEAR) & (g["g1"] < -NEAR) for g in limits])
    cuts = lambda g, rising: F.when((F.least(g["g0"], g["g1"]) < -NEAR) & ((g["g1"] > g["g0"]) == rising), g["g0"] / (g["g0"] - g["g1"]))
    # greatest and least pass over nulls
    t0, t1 = F.greatest(F.lit(0.0), *[cuts(g, True) for g in limits]), F.least(F.lit(1.0), *[cuts(g, False) for g in limits])
    corners = F.array(hand(F.col("l0"), F.col("y")), hand(F.col("r0"), F.col("y")), hand(F.col("l1"), F.col("top")), hand(F.col("r1"), F.col("top")))
    key = [*tags, "id", "part", "long"]
    covers = met.where(~outer).select(*[F.col(f"e.{c}") for c in (*tags, "id")], "part", "long", t0.alias("t0"), t1.alias("t1"), (F.array_max(corners) > NEAR).cast("int").alias("a"), (F.array_min(corners) < -NEAR).cast("int").alias("b"))
    covers = covers.where((F.col("t1") - F.col("t0")) * F.col("long") > NEAR)
    event = lambda t, sign: F.struct(F.round(F.lit(t) if isinstance(t, float) else F.col(t), 11).alias("t"), (F.col("a") * sign).alias("a"), (F.col("b") * sign).alias("b"))
    whole = pieces.select(*key, F.lit(0).alias("a"), F.lit(0).alias("b"))
    events = covers.select(*key, F.inline(F.array(event("t0", 1), event("t1", -1)))).unionByName(whole.select(*key, F.inline(F.array(event(0.0, 1), event(1.0, -1)))))
    steps = events.groupBy(*key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    along = Window.partitionBy(*key).orderBy("t")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    hands = (F.sum("a").over(upto) > 0).cast("int") + (F.sum("b").over(upto) > 0).cast("int")
    runs = steps.select(*key, "t", F.lead("t").over(along).alias("u"), hands.alias("hands")).where("u IS NOT NULL")
    # neighbouring runs in one place are one
    fresh = F.coalesce((F.lag("hands").over(along) != F.col("hands")).cast("int"), F.lit(1))
    runs = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(upto))
    place = F.when(F.col("hands") == 2, "inside").when(F.col("hands") == 1, "border").otherwise("outside")
    joined = runs.groupBy(*key, "run", "hands").agg(F.min("t").alias("t"), F.max("u").alias("u"))
    return joined.select(*tags, "id", ((F.col("part") + F.col("t")) * F.col("long")).alias("t0"), ((F.col("part") + F.col("u")) * F.col("long")).alias("t1"), place.alias("place"))


def whole_box() -> Column:
    """Polygons without holes whose contour is that of a box with whole corners, in either direction and from any corner."""
    p = lambda k: F.element_at("pts", k)
    along = lambda c, d: (p(1)[c] == p(2)[c]) & (p(3)[c] == p(4)[c]) & (p(2)[d] == p(3)[d]) & (p(4)[d] == p(1)[d])
    whole = F.forall("pts", lambda q: _small(q["x"]) & _small(q["y"]))
    return F.when(F.size("pts") == 4, (along("x", "y") | along("y", "x")) & whole).otherwise(False)


def _small(c: Column) -> Column:
    """Whole numbers that an int holds."""
    return (F.abs(c) < 2**30) & (F.floor(c) == c)


def edge_lengths(edges: DataFrame, polygons: DataFrame, tags: tuple[str, ...] = (), size: int = SIDE, by: str = "id") -> DataFrame:
    """(*tags, id, inside, border, outside): how much of each edge lies where, or of all edges with one value of column ``by``, as ``by``.

    Against whole boxes, level and upright edges with whole ends are looked up
    in rasters, whose work does not grow with the pieces that meet in a tile.
    """
    sums = [F.sum(F.when(F.col("place") == p, F.col("t1") - F.col("t0")).otherwise(0.0)).alias(p) for p in PLACES]

    def listed(some: DataFrame) -> DataFrame:
        parts = edge_parts(some, polygons, tags, size)
        if by != "id":
            own = some.select(*tags, "id", by).distinct().alias("own")
            parts = parts.alias("part").join(own, reduce(lambda p, q: p & q, [F.col(f"part.{c}").eqNullSafe(F.col(f"own.{c}")) for c in (*tags, "id")])).select("part.*", f"own.{by}")
        return parts.groupBy(*tags, by).agg(*sums)

    if "holes" in polygons.columns or polygons.where(~F.coalesce(whole_box(), F.lit(False))).limit(1).count():
        return listed(edges)
    ends = ("x1", "y1", "x2", "y2")
    straight = ((F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2"))) & reduce(lambda p, q: p & q, [_small(F.col(c)) for c in ends])
    straight = F.coalesce(straight, F.lit(False))
    low, high = (lambda c, name: F.least(f"{c}1", f"{c}2").cast("int").alias(name)), (lambda c, name: F.greatest(f"{c}1", f"{c}2").cast("int").alias(name))
    side = lambda f, c: f(F.transform("pts", lambda q: q[c])).cast("int")
    boxes = polygons.dropna(subset=list(tags)).select(*tags, side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))
    parts = lattice.hands(edges.where(straight).select(*tags, F.col(by).alias("id"), low("x", "x0"), low("y", "y0"), high("x", "x1"), high("y", "y1")), boxes, tags)
    found = parts.groupBy(*tags, F.col("id").alias(by)).agg(*[F.sum(p).cast("double").alias(p) for p in PLACES])
    if edges.where(~straight).limit(1).count():
        found = found.unionByName(listed(edges.where(~straight))).groupBy(*tags, by).agg(*[F.sum(p).alias(p) for p in PLACES])
    return found
