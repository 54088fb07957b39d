"""Boolean operations on polygons of any angle.

Polygons are dealt to the tiles they meet; what lies left or right of a tile is
pressed onto its border, which keeps every winding number inside right.  In a
tile the rows of all corners and of all crossings begin slabs.  No two edges
cross within a slab, so ordering them at its mid-height and summing windings
from the left splits it into trapezoids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import shapes as s
from lamina.operators.sweep import OPERATIONS
from lamina.sources.staging import staged

#: Side of a tile; a usual shape meets one or two, and crossings cut the slabs of their own tile only.
SIDE = 32
#: Side of the bins in which edges look for crossings.
CROSSING_BIN = 8


def x_at(y: Column, of: str = "") -> Column:
    """The x of an edge piece at height ``y``: its border's if it was pressed onto one."""
    c = lambda name: F.col(of + name)
    return F.coalesce(c("fixed"), c("xa") + (y - c("ya")) * (c("xb") - c("xa")) / (c("yb") - c("ya")))


def edge_pieces(polygons: DataFrame, tags: tuple[str, ...], size: int) -> DataFrame:
    """Edges of polygons (*tags, side, pts[, holes]) by tile: (*tags, tx, ty, side, w, lo, hi, xa, ya, xb, yb, fixed).

    A piece runs over the rows lo..hi of the line from (xa, ya) up to (xb, yb);
    ``w`` is what the winding number gains at its right.  Hulls count as
    clockwise and holes as the other way, however they are written.  Level
    edges are left out: windings along a row do not need them.
    """
    least = lambda c, f: f(F.transform("pts", lambda p: p[c]))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size)))
    turned = lambda pts, hole: F.struct(pts.alias("pts"), F.when((s.area2(pts) > 0) == hole, 1).otherwise(-1).alias("turn"))
    outlines = F.array(turned(F.col("pts"), F.lit(False)))
    if "holes" in polygons.columns:
        outlines = F.concat(outlines, F.coalesce(F.transform("holes", lambda h: turned(h, F.lit(True))), F.slice(outlines, 1, 0)))
    boxed = polygons.select(*tags, "side", outlines.alias("outlines"), least("x", F.array_min).alias("x0"), least("x", F.array_max).alias("x1"), least("y", F.array_min).alias("y0"), least("y", F.array_max).alias("y1"))
    dealt = boxed.where("x1 > x0 AND y1 > y0").withColumn("tx", cells(F.col("x0"), F.col("x1"))).withColumn("ty", cells(F.col("y0"), F.col("y1")))
    e = F.col("e")
    dealt = dealt.select(*tags, "side", "tx", "ty", F.inline("outlines"))
    edges = dealt.select(*tags, "side", "tx", "ty", "turn", F.explode(s.polygon_edges(F.col("pts"))).alias("e")).where(e["y1"] != e["y2"])
    rising = e["y1"] < e["y2"]
    pick = lambda a, b: F.when(rising, e[a]).otherwise(e[b]).cast("double")
    edges = edges.select(*tags, "side", "tx", "ty", F.when(rising, F.col("turn")).otherwise(-F.col("turn")).alias("w"), pick("x1", "x2").alias("xa"), pick("y1", "y2").alias("ya"), pick("x2", "x1").alias("xb"), pick("y2", "y1").alias("yb"))
    left, low = F.col("tx") * float(size), F.col("ty") * float(size)
    edges = edges.withColumns({"lo": F.greatest("ya", low), "hi": F.least("yb", low + size)}).where("lo < hi")
    meets = lambda x: F.when(F.col("xa") != F.col("xb"), F.col("ya") + (x - F.col("xa")) * (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")))
    cuts = F.array_sort(F.array_distinct(F.filter(F.array("lo", "hi", meets(left), meets(left + size)), lambda y: (y >= F.col("lo")) & (y <= F.col("hi")))))
    parts = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.element_at("cuts", k).alias("lo"), F.element_at("cuts", k + 1).alias("hi")))
    pieces = edges.withColumn("cuts", cuts).select(*tags, "tx", "ty", "side", "w", "xa", "ya", "xb", "yb", F.inline(parts))
    line = F.col("xa") + ((F.col("lo") + F.col("hi")) / 2 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    return pieces.withColumn("fixed", F.when(line <= left, left).when(line >= left + size, left + size))


def crossings(pieces: DataFrame, tile: list[str]) -> DataFrame:
    """(*tile, y): heights at which two pieces of a tile cross.

    Pieces meet in small bins; of two crossing pieces one is slanted, and two
    slanted ones are taken in one order.  Pieces that merely touch have a corner there.
    """
    ends = pieces.where("fixed IS NULL").withColumns({"p": x_at(F.col("lo")), "q": x_at(F.col("hi"))})
    cell = lambda c: F.floor(c / CROSSING_BIN)
    bins = ends.select(*tile, "lo", "hi", "fixed", "xa", "ya", "xb", "yb", F.explode(F.sequence(cell(F.least("p", "q")), cell(F.greatest("p", "q")))).alias("bx"), "p")
    bins = bins.withColumn("by", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))).drop("p").distinct()
    a, b = bins.where("xa <> xb").alias("a"), bins.alias("b")
    key = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*tile, "bx", "by")]
    low, high = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    line = lambda of: F.struct(*[F.col(f"{of}.{c}") for c in ("xa", "ya", "xb", "yb")])
    ordered = (F.col("b.xa") == F.col("b.xb")) | (line("a") < line("b"))
    pairs = a.join(b, [*key, low < high, ordered]).select(*[F.col(f"a.{c}") for c in tile], low.alias("low"), high.alias("high"), (x_at(low, "a.") - x_at(low, "b.")).alias("d0"), (x_at(high, "a.") - x_at(high, "b.")).alias("d1"))
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("d0") / (F.col("d0") - F.col("d1"))
    return pairs.where("d0 * d1 < 0").select(*tile, at.alias("y")).distinct()


def trapezoids(polygons: DataFrame, keep: Column | str, tags: tuple[str, ...] = (), more: tuple[str, ...] = (), size: int = SIDE) -> DataFrame:
    """Disjoint trapezoids (*tags, tx, ty, y, top, l0, l1, r0, r1, *more) of polygons (*tags, side, pts[, holes]) where ``keep`` holds.

    ``side`` is a or b, ``pts`` the hull's points x, y and ``holes``, if that
    column is there, a list of such contours; directions do not matter.
    ``keep`` is an operation's name or a condition on ``a`` and ``b``, which
    are 1 where that input's winding number is not 0, else 0; ``more`` may name
    them.  The sides run from l0 and r0 at ``y`` to l1 and r1 at ``top``.
    Polygons without area give nothing.
    """
    tile = [*tags, "tx", "ty"]
    pieces = staged(edge_pieces(polygons, tags, size), "edge-pieces")
    heights = pieces.select(*tile, F.explode(F.array("lo", "hi")).alias("y")).unionByName(crossings(pieces, tile)).distinct()
    slabs = heights.withColumn("top", F.lead("y").over(Window.partitionBy(*tile).orderBy("y"))).where("top IS NOT NULL")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in tile]
    spans = pieces.alias("p").join(slabs.alias("s"), [*same, F.col("lo") <= F.col("y"), F.col("hi") >= F.col("top")])
    y, top = F.col("y"), F.col("top")
    spans = spans.select(*[F.col(f"s.{c}") for c in tile], "y", "top", "side", "w", x_at(y).alias("l0"), x_at(top).alias("l1"), x_at((y + top) / 2).alias("x"))
    along = Window.partitionBy(*tile, "y", "top").orderBy("x")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    wrap = lambda side: (F.sum(F.when(F.col("side") == side, F.col("w")).otherwise(0)).over(upto) != 0).cast("int")
    runs = spans.select(*tile, "y", "top", "l0", "l1", "x", F.lead("l0").over(along).alias("r0"), F.lead("l1").over(along).alias("r1"), F.lead("x").over(along).alias("far"), wrap("a").alias("a"), wrap("b").alias("b"))
    condition = OPERATIONS[keep](F.col("a"), F.col("b")) if isinstance(keep, str) else keep
    return runs.where(condition & (F.col("far") > F.col("x"))).select(*tile, "y", "top", "l0", "l1", "r0", "r1", *more)


def trapezoid_area() -> Column:
    return (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2 * (F.col("top") - F.col("y"))


def lattice_rows(found: DataFrame, dx: float, dy: float) -> DataFrame:
    """``found`` by lattice row: ``row`` and ``points``, how many points (i + dx, row + dy) of whole i, row lie in each trapezoid."""
    first, last = F.ceil(F.col("y") - dy), F.ceil(F.col("top") - dy) - 1
    rows = found.where(last >= first).withColumn("row", F.explode(F.sequence(first, last)))
    part = (F.col("row") + dy - F.col("y")) / (F.col("top") - F.col("y"))
    at = lambda a, b: F.ceil(F.col(a) + (F.col(b) - F.col(a)) * part - dx)
    return rows.withColumn("points", at("r0", "r1") - at("l0", "l1")).where("points > 0")
