"""Boolean operations on axis-parallel shapes with whole corners.

Shapes are cut at tile borders, so a tile is covered on its own.  A tile's
shapes are streamed into rasters of its unit cells, from which slabs of alike
rows and runs along x tell how often either input covers them (``lattice``).
Tiles too large for that are swept: every distinct y begins a slab, each shape
opens and closes an interval in the slabs it crosses, and running sums along x
give how often either input covers a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import lattice
from lamina.sources.staging import staged

TILE = 256
#: Longest side of a tile that is drawn cell by cell; larger ones are swept by SQL windows.
LARGEST = 1024

#: Operation to the condition on wrap counts a and b.
OPERATIONS = {
    "and": lambda a, b: (a > 0) & (b > 0),
    "not": lambda a, b: (a > 0) & (b == 0),
    "xor": lambda a, b: (a > 0) != (b > 0),
    "or": lambda a, b: (a > 0) | (b > 0),
}


def tiled(df: DataFrame, size: int, rim: int = 0) -> DataFrame:
    """Each box clipped to every tile (tx, ty), grown by ``rim``, that it covers with area."""
    x0, y0, x1, y1 = g.box()
    df = df.where((x1 > x0) & (y1 > y0))
    df = df.withColumn("tx", F.explode(F.sequence(F.floor((x0 - rim) / size).cast("int"), F.floor((x1 - 1 + rim) / size).cast("int"))))
    df = df.withColumn("ty", F.explode(F.sequence(F.floor((y0 - rim) / size).cast("int"), F.floor((y1 - 1 + rim) / size).cast("int"))))
    tx, ty = F.col("tx") * size - rim, F.col("ty") * size - rim
    full = size + 2 * rim
    return df.withColumns({"x0": F.greatest(x0, tx), "y0": F.greatest(y0, ty), "x1": F.least(x1, tx + full), "y1": F.least(y1, ty + full)})


def swept(boxes: DataFrame, tile: list[str]) -> DataFrame:
    """Wrap counts of boxes with ``side`` a or b: (*tile, y, top, x0, x1, a, b) for each slab y..top and run x0..x1 of a tile; the last run's x1 is null."""
    ys = boxes.select(*tile, F.explode(F.array("y0", "y1")).alias("y")).distinct()
    slabs = ys.withColumn("top", F.lead("y").over(Window.partitionBy(*tile).orderBy("y"))).where("top IS NOT NULL")
    crossing = boxes.alias("r").join(slabs.alias("s"), [F.col(f"r.{c}") == F.col(f"s.{c}") for c in tile] + [F.col("r.y0") <= F.col("s.y"), F.col("r.y1") >= F.col("s.top")])
    events = crossing.select(*[F.col(f"r.{c}") for c in tile], "y", "top", "side", F.inline(F.array(F.struct(F.col("r.x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("r.x1").alias("x"), F.lit(-1).alias("d")))))
    slab = [*tile, "y", "top"]
    change = lambda side: F.sum(F.when(F.col("side") == side, F.col("d")).otherwise(0))
    steps = events.groupBy(*slab, "x").agg(change("a").alias("da"), change("b").alias("db"))
    along = Window.partitionBy(*slab).orderBy("x")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*slab, F.col("x").alias("x0"), F.lead("x").over(along).alias("x1"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"))


def wraps(boxes: DataFrame, tile: list[str], size: int, rim: int, present: bool) -> DataFrame:
    """``swept`` without open runs, from rasters where they are small enough; with ``present`` the counts need only tell whether there is any."""
    if size + 2 * rim <= LARGEST:
        return lattice.wraps(boxes, tile, size, rim, present)
    return swept(boxes, tile).where("x1 IS NOT NULL")


def runs(a: DataFrame, b: DataFrame | None, keep: Column | str, size: int = TILE, tags: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """Disjoint boxes (tx, ty, x0, y0, x1, y1) where ``keep`` holds.

    ``keep`` is an operation's name or a condition on the wrap counts ``a``
    and ``b``; ``tags`` are columns that must agree, such as a property, and
    ``more`` may name the counts to keep them.
    """
    boxes = tiled(a.select(*g.BOX, *tags), size).withColumn("side", F.lit("a"))
    if b is not None:
        boxes = boxes.unionByName(tiled(b.select(*g.BOX, *tags), size).withColumn("side", F.lit("b")))
    tile = ["tx", "ty", *tags]
    wrapped = wraps(boxes, tile, size, 0, present=isinstance(keep, str) and not more)
    condition = OPERATIONS[keep](F.col("a"), F.col("b")) if isinstance(keep, str) else keep
    return wrapped.where(condition).select(*tile, "x0", F.col("y").alias("y0"), "x1", F.col("top").alias("y1"), *more)


def area_by_tile(a: DataFrame, b: DataFrame | None, keep: Column | str, size: int = TILE, tags: tuple[str, ...] = ()) -> DataFrame:
    """(tx, ty, area) of a boolean operation; tiles without area are left out."""
    return runs(a, b, keep, size, tags).groupBy("tx", "ty", *tags).agg(F.sum(g.area()).alias("area"))


def density(a: DataFrame, size: int = TILE) -> DataFrame:
    """(tx, ty, area): sum of clipped box areas, overlaps counted as often as they are covered."""
    return tiled(a.select(*g.BOX), size).groupBy("tx", "ty").agg(F.sum(g.area()).alias("area"))


def chained(runs: DataFrame, key: list[str]) -> DataFrame:
    """(*key, t0, t1): disjoint runs of a key that touch are one."""
    along = Window.partitionBy(*key).orderBy("t0")
    fresh = F.coalesce((F.lag("t1").over(along) < F.col("t0")).cast("int"), F.lit(1))
    numbered = runs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def line_runs(segments: DataFrame, first: Column, second: Column, keep: str, span: int | None = None) -> DataFrame:
    """Booleans of collinear edges: (line, t0, t1) runs where ``keep`` holds for the segments told apart by two conditions.

    With ``span`` lines are cut at its multiples and swept part by part, so a
    line that holds much of the table is spread over tasks; along the whole
    line only runs that reach a border are chained, two for each part at most.
    """
    side = F.when(first, F.lit("a")).when(second, F.lit("b"))
    marked = segments.withColumn("side", side).where("side IS NOT NULL AND t1 > t0").withColumn("part", F.lit(0).cast("long"))
    begin = F.col("part") * F.lit(span)
    if span:
        marked = marked.withColumn("part", F.explode(F.sequence(F.floor(F.col("t0") / span), F.floor((F.col("t1") - 1) / span))))
        marked = marked.withColumns({"t0": F.greatest("t0", begin), "t1": F.least("t1", begin + span)})
    piece = ["line", "part"]
    events = marked.select(*piece, "side", F.inline(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")))))
    change = lambda s: F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0))
    steps = events.groupBy(*piece, "t").agg(change("a").alias("da"), change("b").alias("db"))
    along = Window.partitionBy(*piece).orderBy("t")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    wraps = steps.select(*piece, F.col("t").alias("t0"), F.lead("t").over(along).alias("t1"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"))
    found = chained(wraps.where(OPERATIONS[keep](F.col("a"), F.col("b")) & F.col("t1").isNotNull()).select(*piece, "t0", "t1"), piece)
    if span:
        border = (F.col("t0") == begin) | (F.col("t1") == begin + span)
        found = chained(found.withColumn("part", F.when(~border, F.col("part"))), piece)
    return found.select("line", "t0", "t1")


def swapped(df: DataFrame) -> DataFrame:
    """Boxes with x and y exchanged, so that what works along x works along y."""
    return df.withColumns({"x0": F.col("y0"), "y0": F.col("x0"), "x1": F.col("y1"), "y1": F.col("x1")})


def outline(a: DataFrame, tags: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """The merged region's edges: (*tags, axis, pos, side, t0, t1).

    ``axis`` x holds edges along x at y = ``pos``; ``side`` is -1 where the
    region begins there and 1 where it ends.  Borders of the runs that a
    neighbouring run continues cancel out; the rest is chained along its line.
    """
    found = None
    boxes = staged(runs(a, None, "or", size, tags), "runs")
    for axis, low, high, t in (("y", "x0", "x1", "y"), ("x", "y0", "y1", "x")):
        sides = F.inline(F.array(F.struct(F.col(low).alias("pos"), F.lit("a").alias("border")), F.struct(F.col(high).alias("pos"), F.lit("b").alias("border"))))
        borders = boxes.select(*tags, sides, F.col(f"{t}0").cast("long").alias("t0"), F.col(f"{t}1").cast("long").alias("t1"))
        line = F.struct(*tags, F.lit(axis).alias("axis"), "pos").alias("line")
        borders = borders.select(line, "border", "t0", "t1")
        for keep, side in (("not", -1), ("not", 1)):
            first, second = (F.col("border") == "a", F.col("border") == "b")[::-side]
            part = line_runs(borders, first, second, keep).select("line.*", F.lit(side).alias("side"), "t0", "t1")
            found = part if found is None else found.unionByName(part)
    return found


def facing(a: DataFrame, distance: int, inside: bool, tags: tuple[str, ...] = (), size: int = TILE) -> DataFrame:
    """Edge pairs of the merged region that face each other less than ``distance`` apart, as (*tags, axis, first, second, t0, t1).

    With ``inside`` pairs face through the region (width), else through the gap
    between its parts or a notch (space).  ``axis`` y holds vertical edges at
    x = ``first`` and ``second`` that both run over t0..t1.

    A tile is swept with a rim of ``distance`` around it, so runs shorter than
    that and beginning in the tile are whole; their pieces are chained along t.
    """
    found = None
    for axis, boxes in (("y", a), ("x", swapped(a))):
        near = tiled(boxes.select(*g.BOX, *tags), size, distance)
        tile = ["tx", "ty", *tags]
        strips = wraps(near.withColumn("side", F.lit("a")), tile, size, distance, present=True)
        strips = strips.withColumn("in", F.col("a") > 0)
        # neighbouring runs that are both covered or both free are one
        along = Window.partitionBy(*tile, "y", "top").orderBy("x0")
        fresh = F.coalesce((F.lag("in").over(along) != F.col("in")).cast("int"), F.lit(1))
        strips = strips.withColumn("run", F.sum(fresh).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        strips = strips.groupBy(*tile, "y", "top", "run", "in").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
        mine = (F.floor(F.col("x0") / size) == F.col("tx")) & (F.col("x1") - F.col("x0") < distance) & (F.col("in") == inside)
        low, high = F.greatest("y", F.col("ty") * size), F.least("top", F.col("ty") * size + size)
        strips = strips.where(mine).select(*tags, "x0", "x1", low.cast("long").alias("t0"), high.cast("long").alias("t1")).where("t1 > t0")
        line = F.struct(*tags, F.lit(axis).alias("axis"), F.col("x0").alias("first"), F.col("x1").alias("second")).alias("line")
        joined = line_runs(strips.select(line, F.lit("a").alias("layer"), "t0", "t1"), F.lit(True), F.lit(False), "or").select("line.*", "t0", "t1")
        found = joined if found is None else found.unionByName(joined)
    return found


def sized(a: DataFrame, by: int) -> DataFrame:
    """Boxes grown by ``by`` on all sides; merged, they are the grown region."""
    x0, y0, x1, y1 = g.box()
    return a.withColumns({"x0": x0 - by, "y0": y0 - by, "x1": x1 + by, "y1": y1 + by})


def shrunk_area(a: DataFrame, by: int, size: int = TILE) -> DataFrame:
    """(tx, ty, area) of the merged region less all within ``by`` of what it does not cover.

    The free part of each tile and a rim around it is grown and taken away.
    """
    near = tiled(a.select(*g.BOX), size, by + 1)
    x0, y0 = F.col("tx") * size - by - 1, F.col("ty") * size - by - 1
    frame = near.select("tx", "ty").distinct().select("tx", "ty", x0.alias("x0"), y0.alias("y0"), (x0 + size + 2 * by + 2).alias("x1"), (y0 + size + 2 * by + 2).alias("y1"))
    both = near.select("tx", "ty", *g.BOX, F.lit("b").alias("side")).unionByName(frame.withColumn("side", F.lit("a")))
    gaps = wraps(both, ["tx", "ty"], size, by + 1, present=True).where("a > 0 AND b = 0")
    free = sized(gaps.select("tx", "ty", "x0", F.col("y").alias("y0"), "x1", F.col("top").alias("y1")), by)
    tx, ty = F.col("tx") * size, F.col("ty") * size
    core = {"x0": F.greatest("x0", tx), "y0": F.greatest("y0", ty), "x1": F.least("x1", tx + size), "y1": F.least("y1", ty + size)}
    both = near.select("tx", "ty", *g.BOX, F.lit("a").alias("side")).unionByName(free.select("tx", "ty", *g.BOX, F.lit("b").alias("side"))).withColumns(core)
    left = wraps(both.where("x1 > x0 AND y1 > y0"), ["tx", "ty"], size, 0, present=True).where("a > 0 AND b = 0")
    area = (F.col("x1") - F.col("x0")).cast("long") * (F.col("top") - F.col("y"))
    return left.groupBy("tx", "ty").agg(F.sum(area).alias("area"))
