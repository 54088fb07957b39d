"""Recursive scan of a cell hierarchy: every placement below a top cell, and the shapes it brings.

Transformations are composed level by level, so rounds follow the depth of the
hierarchy.  With a box to confine the scan to, a placement whose cell has
nothing near it leaves before anything below it is expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.sources.staging import staged

#: x' = xx * x + xy * y + dx, y' = yx * x + yy * y + dy
PLACE = ("xx", "xy", "yx", "yy", "dx", "dy")
#: More levels than this mean a cell that holds itself.
DEEPEST = 200


def placements(instances: DataFrame) -> DataFrame:
    """(parent, child, *PLACE) of instances (parent, child, x, y, quarter, mirror, na, nb, ax, ay, bx, by), arrays spread out.

    A cell is mirrored (y to -y) if ``mirror`` holds, turned to the left by
    ``quarter`` right angles and moved, at each of na by nb steps of (ax, ay) and (bx, by).
    """
    turn = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("quarter", F.lit(4)) + 1).cast("int")).cast("long")
    cos, sin, flip = turn(1, 0, -1, 0), turn(0, 1, 0, -1), F.when(F.col("mirror"), -1).otherwise(1)
    copies = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    each = instances.withColumn("i", copies("na")).withColumn("j", copies("nb"))
    moved = [(F.col(c) + F.col(f"a{c}") * F.col("i") + F.col(f"b{c}") * F.col("j")).cast("long") for c in "xy"]
    values = (cos, -sin * flip, sin, cos * flip, *moved)
    return each.select("parent", "child", *[v.alias(n) for v, n in zip(values, PLACE, strict=True)])


def placed(box: list[Column], of: str = "") -> list[Column]:
    """A box moved by the placement in columns ``of`` + PLACE."""
    p = {c: F.col(of + c) for c in PLACE}
    x0, y0, x1, y1 = box
    xs = [p["xx"] * x + p["xy"] * y + p["dx"] for x, y in ((x0, y0), (x1, y1))]
    ys = [p["yx"] * x + p["yy"] * y + p["dy"] for x, y in ((x0, y0), (x1, y1))]
    return [c.alias(n) for c, n in zip((F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)), g.BOX, strict=True)]


def extents(steps: DataFrame, shapes: DataFrame) -> DataFrame:
    """(cell, x0, y0, x1, y1): the bounding box of all shapes in and below each cell; cells without any are left out."""
    joined = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    level = staged(shapes.groupBy("cell").agg(*joined), "extents")
    found = level
    for _ in range(DEEPEST):
        upper = steps.join(level.withColumnRenamed("cell", "child"), "child").select(F.col("parent").alias("cell"), *placed(list(g.box())))
        level = staged(upper.groupBy("cell").agg(*joined), "extents")
        if level.isEmpty():
            return staged(found.groupBy("cell").agg(*joined), "extents")
        found = found.unionByName(level)
    raise ValueError("a cell holds itself")


def scan_instances(tops: DataFrame, instances: DataFrame, shapes: DataFrame, max_depth: int | None = None, confine: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(top, cell, depth, *PLACE): the placements of all cells below ``tops`` (cell), the tops themselves at depth 0.

    ``confine`` keeps placements whose extent touches that box, in the top cell's units.
    """
    steps = staged(placements(instances), "placements")
    near = None
    if confine:
        bx0, by0, bx1, by1 = confine
        near = extents(steps, shapes).select("cell", *[F.col(c).alias(f"e{c}") for c in g.BOX])

    def kept(level: DataFrame) -> DataFrame:
        if near is None:
            return level
        x0, y0, x1, y1 = placed([F.col(f"e{c}") for c in g.BOX])
        return level.join(near, "cell").where((x0 <= bx1) & (x1 >= bx0) & (y0 <= by1) & (y1 >= by0)).select(*level.columns)

    start = tops.select(F.col("cell").alias("top"), "cell", F.lit(0).alias("depth"), *[F.lit(v).cast("long").alias(n) for v, n in zip((1, 0, 0, 1, 0, 0), PLACE, strict=True)])
    level = staged(kept(start), "scan")
    found = level
    for depth in range(1, DEEPEST + 1):
        if level.isEmpty() or (max_depth is not None and depth > max_depth):
            return found
        o, i = {c: F.col(f"o.{c}") for c in PLACE}, {c: F.col(f"i.{c}") for c in PLACE}
        turn = {f"{r}{c}": o[f"{r}x"] * i[f"x{c}"] + o[f"{r}y"] * i[f"y{c}"] for r in "xy" for c in "xy"}
        move = {f"d{r}": o[f"{r}x"] * i["dx"] + o[f"{r}y"] * i["dy"] + o[f"d{r}"] for r in "xy"}
        both = level.alias("o").join(steps.alias("i"), F.col("o.cell") == F.col("i.parent"))
        lower = both.select(F.col("o.top").alias("top"), F.col("i.child").alias("cell"), F.lit(depth).alias("depth"), *[(turn | move)[c].alias(c) for c in PLACE])
        level = staged(kept(lower), "scan")
        found = found.unionByName(level)
    raise ValueError("a cell holds itself")


def scan_shapes(tops: DataFrame, instances: DataFrame, shapes: DataFrame, min_depth: int = 0, max_depth: int | None = None, confine: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Shapes (cell, x0, y0, x1, y1, more) as the tops hold them: (top, depth, cell, more, and the box in the top cell's units).

    ``min_depth`` and ``max_depth`` bound how many placements lie above a
    shape; ``confine`` keeps shapes that touch the box, borders included.
    """
    found = scan_instances(tops, instances, shapes, max_depth, confine).where(F.col("depth") >= min_depth)
    more = [c for c in shapes.columns if c not in ("cell", *g.BOX)]
    out = found.join(shapes, "cell").select("top", "depth", "cell", *more, *placed(list(g.box())))
    if not confine:
        return out
    bx0, by0, bx1, by1 = confine
    return out.where((F.col("x0") <= bx1) & (F.col("x1") >= bx0) & (F.col("y0") <= by1) & (F.col("y1") >= by0))
