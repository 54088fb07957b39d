"""Merged polygons from the loose edges of a merged region.

Every border edge knows the edge before it on its contour.  Pointer doubling
follows these links 1, 2, 4, ... edges back, so naming a ring and numbering its
edges takes rounds by the logarithm of the longest ring; rings that are known
leave, and each round is a table of its own.  No task ever holds a ring.

Hulls run clockwise and holes the other way, so the region is at the right
hand.  Where two parts touch in one corner they make one polygon, or two with
``min_coherence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import sweep
from lamina.operators.connectivity import components
from lamina.sources.staging import staged


def directed(edges: DataFrame) -> DataFrame:
    """Outline edges with ``edge``, their end points x1, y1, x2, y2 and ``heading``: 0 up, 1 right, 2 down, 3 left."""
    upright, rising = F.col("axis") == "y", (F.col("axis") == "y") == (F.col("side") == -1)
    begin, end = F.when(rising, F.col("t0")).otherwise(F.col("t1")), F.when(rising, F.col("t1")).otherwise(F.col("t0"))
    pos = F.col("pos").cast("long")
    points = {"x1": F.when(upright, pos).otherwise(begin), "y1": F.when(upright, begin).otherwise(pos), "x2": F.when(upright, pos).otherwise(end), "y2": F.when(upright, end).otherwise(pos)}
    heading = F.when(upright, F.when(rising, 0).otherwise(2)).otherwise(F.when(rising, 1).otherwise(3))
    return edges.withColumns(points).withColumns({"heading": heading, "edge": F.monotonically_increasing_id()})


def linked(edges: DataFrame, tags: tuple[str, ...], min_coherence: bool) -> DataFrame:
    """(edge, prev, least): the edge before each one on its contour, and its own start as the least corner so far."""
    coming = [F.max(F.when(F.col("heading") == h, F.col("edge"))).alias(f"from{h}") for h in range(4)]
    corners = edges.groupBy(*tags, F.col("x2").alias("x1"), F.col("y2").alias("y1")).agg(*coming)
    at = lambda turn: F.element_at(F.array(*[f"from{h}" for h in range(4)]), ((F.col("heading") + turn) % 4 + 1).cast("int"))
    right, left = at(3), at(1)
    prev = F.coalesce(right, left) if min_coherence else F.coalesce(left, right)
    return edges.join(corners, [*tags, "x1", "y1"]).select("edge", prev.alias("prev"), F.struct("y1", "x1", "edge").alias("least"))


def ranked(links: DataFrame) -> DataFrame:
    """(edge, ring, position): rings of (edge, prev, least) are named by the edge with the least corner, and numbered from there.

    A row knows the least corner among the 2^k edges from its own backwards,
    and how many steps lie between.  If the 2^k before those have the same one,
    the whole ring was seen.  A row whose partner has left is known as well:
    the partner saw its ring whole, so after that round every row had.
    """
    known = []
    now = staged(links.select("edge", "prev", "least", F.lit(0).cast("long").alias("steps"), F.lit(False).alias("known")), "ring-links")
    reach = 1
    while True:
        known.append(now.where("known").select("edge", F.col("least.edge").alias("ring"), F.col("steps").alias("position")))
        open_ = now.where("NOT known")
        if open_.isEmpty():
            break
        far = open_.select(F.col("edge").alias("prev"), F.col("prev").alias("before"), F.col("least").alias("far"), F.col("steps").alias("more"))
        both = open_.join(far, "prev", "left")
        better = F.col("far") < F.col("least")
        done = F.col("far").isNull() | (F.col("far") == F.col("least"))
        now = staged(
            both.select(
                "edge", F.col("before").alias("prev"), F.when(better, F.col("far")).otherwise(F.col("least")).alias("least"),
                F.when(better, F.col("more") + reach).otherwise(F.col("steps")).alias("steps"), done.alias("known"),
            ),
            "ring-links",
        )
        reach *= 2
    found = known[0]
    for part in known[1:]:
        found = found.unionByName(part)
    return found


def rings(boxes: DataFrame, tags: tuple[str, ...] = (), min_coherence: bool = False, size: int = sweep.TILE) -> DataFrame:
    """The merged region's contours as edges: (*tags, ring, position, axis, side, pos, t0, t1, x1, y1, x2, y2).

    ``position`` counts from 0 at the lowest, then leftmost corner.  Boxes
    without area have no contour; rows with a null tag belong to no region.
    """
    edges = staged(directed(sweep.outline(boxes, tags, size)), "ring-edges")
    return staged(edges.join(ranked(linked(edges, tags, min_coherence)), "edge").drop("edge", "heading"), "rings")


def corners(ringed: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """(*tags, ring, position, x, y): the corners of each contour in order."""
    return ringed.select(*tags, "ring", "position", F.col("x1").alias("x"), F.col("y1").alias("y"))


def measures(ringed: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ring: its bounding box, ``n_points``, ``perimeter``, ``area``, and whether it is a ``hole``; ``wall`` is its leftmost edge's x and lowest row."""
    twice = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))
    box = [F.min("x1").alias("x0"), F.min("y1").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    wall = F.min(F.when(F.col("axis") == "y", F.struct("x1", F.col("t0").alias("row")))).alias("wall")
    length = F.sum(F.col("t1") - F.col("t0")).alias("perimeter")
    found = ringed.groupBy(*tags, "ring").agg(*box, F.count("*").alias("n_points"), length, twice.alias("twice"), wall)
    return found.withColumns({"hole": F.col("twice") > 0, "area": (F.abs("twice") / 2).cast("long")}).drop("twice")


def left_of(holes: DataFrame, ringed: DataFrame, tags: tuple[str, ...], size: int) -> DataFrame:
    """(a, b): each hole and the ring that bounds the region at the left of its wall.

    Edges meet the rows asked for through tiles of rows; along a row they are
    ordered part by part, and a part without an edge looks up the last one before it.
    """
    asked = holes.select(*tags, F.col("ring").alias("a"), F.col("wall.x1").alias("x"), F.col("wall.row").alias("row"))
    lines = asked.select(*tags, "row", F.floor(F.col("row") / size).alias("ty")).distinct()
    begins = ringed.where("axis = 'y' AND side = -1").select(*tags, "ring", F.col("x1").alias("x"), "t0", "t1")
    begins = begins.withColumn("ty", F.explode(F.sequence(F.floor(F.col("t0") / size), F.floor((F.col("t1") - 1) / size))))
    crossing = begins.join(lines, [*tags, "ty"]).where("t0 <= row AND row < t1").select(*tags, "row", "x", "ring", F.lit(None).cast("long").alias("a"))
    both = crossing.unionByName(asked.select(*tags, "row", "x", F.lit(None).cast("long").alias("ring"), "a"))
    both = both.withColumn("part", F.floor(F.col("x") / size))
    piece = [*tags, "row", "part"]
    within = Window.partitionBy(*piece).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    inner = both.withColumn("b", F.last("ring", ignorenulls=True).over(within)).where("a IS NOT NULL")
    ends = both.groupBy(*piece).agg(F.max_by("ring", F.when(F.col("ring").isNotNull(), F.col("x"))).alias("end"))
    earlier = Window.partitionBy(*tags, "row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("earlier", F.last("end", ignorenulls=True).over(earlier)).drop("end")
    return inner.join(ends, piece).select("a", F.coalesce("b", "earlier").alias("b"))


def polygons(ringed: DataFrame, tags: tuple[str, ...] = (), size: int = sweep.TILE) -> DataFrame:
    """``measures`` with ``hull``, the ring of the polygon's hull: a hull's own, for a hole that of the polygon it is cut from.

    What bounds the region at the left of a hole is the same polygon's hull or
    another hole of it, so these links tie each polygon's rings together.
    """
    found = staged(measures(ringed, tags), "ring-measures")
    links = left_of(found.where("hole"), ringed, tags, size)
    nets = staged(components(found.select(F.col("ring").alias("id")), links).withColumnRenamed("id", "ring"), "ring-nets")
    hulls = nets.join(found.where("NOT hole").select("ring"), "ring").select("net", F.col("ring").alias("hull"))
    return found.join(nets, "ring").join(hulls, "net").drop("net", "wall")
