"""Spatial joins and the selections built on them.

A join by inequalities would compare all pairs.  Both sides are dealt to the
grid bins they cover instead, joined by bin, and a pair counts only in the bin
of its lowest common corner, so no duplicates need removing.  A crowded bin is
an ordinary skewed join key, which adaptive execution splits.

Selections by meeting do not need the pairs, whose number grows with the square
of the density: ``lattice`` counts the partners of each shape.  Only shapes that
it cannot hold, and ids that stand for several boxes, go through pairs.  So do
boxes wider than its rasters where boxes inside others are asked for.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import lattice, sweep

#: Side of a grid bin, in database units; a few times a usual shape.
BIN = 64
#: The same where only the lower left corners of one side are dealt.
CORNER_BIN = 16
#: Boxes of one side of a bin that a task compares with as many of the other, where all pairs are asked for.
DEALT = 1 << 15


def binned(df: DataFrame, size: int, grow: int = 0) -> DataFrame:
    x0, y0, x1, y1 = g.box()
    cell = lambda c: F.floor(c / size).cast("int")
    df = df.withColumn("bx", F.explode(F.sequence(cell(x0 - grow), cell(x1 + grow))))
    return df.withColumn("by", F.explode(F.sequence(cell(y0 - grow), cell(y1 + grow))))


def spatial_join(a: DataFrame, b: DataFrame, condition: Column, distance: int = 0, size: int = BIN) -> DataFrame:
    """Pairs of aliases ``a`` and ``b`` that meet within ``distance`` and fulfil ``condition``."""
    left, right = binned(a, size, distance).alias("a"), binned(b, size).alias("b")
    corner_x = F.floor(F.greatest(F.col("a.x0") - distance, F.col("b.x0")) / size) == F.col("a.bx")
    corner_y = F.floor(F.greatest(F.col("a.y0") - distance, F.col("b.y0")) / size) == F.col("a.by")
    same = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by"))
    return left.join(right, same & g.touches("a", "b", distance) & corner_x & corner_y & condition)


#: Selection modes: how a shape and a partner must lie.
MODES = {
    "interacting": lambda: g.touches("a", "b"),
    "overlapping": lambda: g.overlaps("a", "b"),
    "inside": lambda: g.inside("a", "b"),
    "covering": lambda: g.inside("b", "a"),
}


#: Modes that ``lattice`` counts, and whether it leaves out the upper border.
MEETING = {"interacting": 0, "overlapping": 1}
#: Modes seen from the partner.
TURNED = {"interacting": "interacting", "overlapping": "overlapping", "inside": "covering", "covering": "inside"}


def listed_counts(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """(id, n) by listing pairs."""
    return spatial_join(a, b, on).groupBy(F.col("a.id").alias("id")).agg(F.count_distinct("b.id").alias("n"))


def met_counts(a: DataFrame, b: DataFrame, mode: str, tag: str | None = None) -> DataFrame:
    """(id, n): parts that add up to the number of boxes in ``b`` that each shape of ``a`` meets; with ``tag`` of those with the same value of it."""
    last = MEETING[mode]
    found = lattice.meetings(a, b, last, tag)
    if lattice.any_irregular(last, a, b):
        on = MODES[mode]() if tag is None else MODES[mode]() & (F.col(f"a.{tag}") == F.col(f"b.{tag}"))
        b_rows = b.withColumn("id", F.monotonically_increasing_id())
        found = found.unionByName(listed_counts(a.where(lattice.irregular(last)), b_rows, on)).unionByName(listed_counts(a.where(lattice.regular(last)), b_rows.where(lattice.irregular(last)), on))
    return found


def covering_counts(a: DataFrame, b: DataFrame, enough: int) -> DataFrame:
    """(id, n): parts that add up to the number of boxes in ``b`` inside each shape of ``a``; sums under ``enough`` are exact, others at least that."""
    found = lattice.inners(a, b, enough)
    odd = lattice.irregular(0)
    wide = lattice.regular(0) & ~lattice.narrow()
    rest = [t.agg(F.max(odd | wide).alias("odd")) for t in (a.where(odd), b)]
    if rest[0].unionByName(rest[1]).agg(F.max("odd")).first()[0]:
        on, b = MODES["covering"](), b.withColumn("id", F.monotonically_increasing_id())
        found = found.unionByName(listed_counts(a.where(odd), b, on)).unionByName(listed_counts(a.where(wide), b.where(wide), on)).unionByName(listed_counts(a.where(lattice.regular(0)), b.where(odd), on))
    return found


def repeated(df: DataFrame) -> DataFrame:
    """Ids of several different boxes."""
    return df.groupBy("id").agg(F.count("*").alias("boxes")).where("boxes > 1").select("id")


def partner_counts(a: DataFrame, b: DataFrame, mode: str, extra: Column | None = None, enough: int | None = None) -> DataFrame:
    """``a`` with ``partners``, its number of distinct partners in ``b``; 0 where there is none.

    With ``enough`` only numbers under it need to be told apart.
    """
    on = MODES[mode]() if extra is None else MODES[mode]() & extra
    inner = mode == "covering" and enough is not None and enough <= lattice.ENOUGH
    once_counts = (lambda p, q: covering_counts(p, q, enough)) if inner else (lambda p, q: met_counts(p, q, mode))
    if not (mode in MEETING or inner) or extra is not None:
        counts = listed_counts(a, b, on)
    else:
        left, right = a.select("id", *g.BOX).distinct(), b.select("id", *g.BOX).distinct()
        twice_a, twice_b = repeated(left), repeated(right)
        if not twice_a.unionByName(twice_b.select(F.col("id").cast(a.schema["id"].dataType))).isEmpty():
            once_a, once_b = left.join(twice_a, "id", "left_anti"), right.join(twice_b, "id", "left_anti")
            counts = once_counts(once_a, once_b).unionByName(listed_counts(left.join(twice_a, "id", "left_semi"), right, on)).unionByName(listed_counts(once_a, right.join(twice_b, "id", "left_semi"), on))
        else:
            counts = once_counts(left, right)
    counts = counts.groupBy("id").agg(F.sum("n").alias("partners"))
    return a.join(counts, "id", "left").withColumn("partners", F.coalesce("partners", F.lit(0)))


def hits(a: DataFrame, b: DataFrame, mode: str, tag: str | None = None, same: bool = True) -> DataFrame:
    """(id): shapes of ``a`` with a partner in ``b``; with ``tag`` one with the same value of it, or with another one."""
    if mode == "covering" and tag is None:
        return covering_counts(a, b, 1).select("id").distinct()
    if mode not in MEETING:
        on = MODES[mode]() if tag is None else MODES[mode]() & (F.col(f"a.{tag}") == F.col(f"b.{tag}") if same else F.col(f"a.{tag}") != F.col(f"b.{tag}"))
        return spatial_join(a, b, on).select(F.col("a.id").alias("id")).distinct()
    if tag is None or same:
        return met_counts(a, b, mode, tag).select("id").distinct()
    a, b = a.dropna(subset=[tag]), b.dropna(subset=[tag])
    less = met_counts(a, b, mode, tag).withColumn("n", -F.col("n"))
    return met_counts(a, b, mode).unionByName(less).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0").select("id")


def selected(a: DataFrame, b: DataFrame, mode: str, at_least: int = 1, at_most: int | None = None, invert: bool = False, extra: Column | None = None) -> DataFrame:
    """Shapes of ``a`` with ``at_least`` to ``at_most`` partners, or the others."""
    if at_least == 1 and at_most is None and extra is None:
        return a.join(hits(a, b, mode), "id", "left_anti" if invert else "left_semi")
    n = F.col("partners")
    good = n >= at_least if at_most is None else n.between(at_least, at_most)
    return partner_counts(a, b, mode, extra, (at_least if at_most is None else at_most + 1)).where(~good if invert else good).drop("partners")


def selected_by(a: DataFrame, b: DataFrame, mode: str, tag: str, same: bool) -> DataFrame:
    """Shapes of ``a`` with a partner that has the same value of ``tag``, or with one that has another; null has neither."""
    return a.join(hits(a, b, mode, tag, same), "id", "left_semi")


def split(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """``a`` with ``hit``: both halves of a selection from one join."""
    found = hits(a, b, mode).withColumn("hit", F.lit(True))
    return a.join(found, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def covered_area(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with ``covered``, the area of each shape under ``b`` taken as one merged region; equal to its own area where it lies inside."""
    pieces = sweep.runs(b, None, "or").select(*g.BOX)
    wide = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    high = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    sums = spatial_join(a, pieces, g.overlaps("a", "b")).groupBy(F.col("a.id").alias("id")).agg(F.sum(wide.cast("long") * high).alias("covered"))
    return a.join(sums, "id", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))


def selected_inside(a: DataFrame, b: DataFrame, invert: bool = False) -> DataFrame:
    """Shapes of ``a`` inside ``b`` taken as one merged region, or the others; borders count as inside, shapes without area as not."""
    inside = (F.col("covered") == g.area()) & (F.col("covered") > 0)
    return covered_area(a, b).where(~inside if invert else inside).drop("covered")


def pulled(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """Shapes of ``b`` that are partners of any shape of ``a``."""
    return b.join(hits(b, a, TURNED[mode]), "id", "left_semi")


def members(a: DataFrame, b: DataFrame, invert: bool = False) -> DataFrame:
    """Shapes of ``a`` that ``b`` holds exactly, or the others."""
    return a.join(b.select(*g.BOX).distinct(), list(g.BOX), "left_anti" if invert else "left_semi")


def placed_join(a: DataFrame, b: DataFrame, condition: Column, distance: int, size: int = BIN) -> DataFrame:
    """As ``spatial_join``, of places: ``a.ids`` and ``b.ids`` are all rows with that box, as structs.

    Boxes at one place are compared once, and their pairs are made where they are
    written.  A task has some ``DEALT`` boxes of a side: its pairs have few
    different ids, in runs, so they take little room.  Larger bins are dealt to
    a grid of tasks.
    """
    spark = a.sparkSession
    count = lambda df, grow, name: binned(df.select(*g.BOX), size, grow).groupBy("bx", "by").agg(F.count("*").alias(name))
    load = count(a, distance, "left").join(count(b, 0, "right"), ["bx", "by"], "full").fillna(0)
    total, most = load.agg(F.sum(F.col("left") + F.col("right")), F.max(F.greatest("left", "right"))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // DEALT))
    crowded = (most or 0) > DEALT
    keys = ["bx", "by"]
    if crowded:
        grid = load.where(F.greatest("left", "right") > DEALT).select("bx", "by", *(F.greatest(F.ceil(F.col(c) / DEALT), F.lit(1)).cast("int").alias(c) for c in ("left", "right")))
        keys += ["row", "column"]

    def places(df: DataFrame, grow: int, own: str, other: str) -> DataFrame:
        rows = binned(df.select("id", *g.BOX), size, grow)
        if crowded:
            at = {"left": "row", "right": "column"}
            rows = rows.join(F.broadcast(grid), ["bx", "by"], "left").fillna(1, ["left", "right"])
            rows = rows.withColumn(at[own], F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(at[other], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.repartition(tasks, *keys).groupBy(*keys, *g.BOX).agg(F.sort_array(F.collect_list(F.struct("id"))).alias("ids"))

    left, right = places(a, distance, "left", "right").alias("a"), places(b, 0, "right", "left").alias("b")
    corner_x = F.floor(F.greatest(F.col("a.x0") - distance, F.col("b.x0")) / size) == F.col("a.bx")
    corner_y = F.floor(F.greatest(F.col("a.y0") - distance, F.col("b.y0")) / size) == F.col("a.by")
    same = reduce(and_, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys))
    return left.join(right, same & g.touches("a", "b", distance) & corner_x & corner_y & condition)


def space_pairs(a: DataFrame, b: DataFrame, distance: int, same: bool) -> DataFrame:
    """Facing edges of two boxes less than ``distance`` apart, projections overlapping: (first, second, gap, axis).

    With ``same`` both sides are one layer and each pair comes once.
    """
    ax0, ay0, ax1, ay1 = g.box("a")
    bx0, by0, bx1, by1 = g.box("b")
    gap_x, gap_y = F.greatest(bx0 - ax1, ax0 - bx1), F.greatest(by0 - ay1, ay0 - by1)
    beside = (gap_x > 0) & (gap_x < distance) & (ay0 < by1) & (by0 < ay1)
    above = (gap_y > 0) & (gap_y < distance) & (ax0 < bx1) & (bx0 < ax1)
    pairs = placed_join(a, b, beside | above, distance)
    found = [F.when(beside, gap_x).otherwise(gap_y).alias("gap"), F.when(beside, "x").otherwise("y").alias("axis")]
    pairs = pairs.select(F.col("a.ids").alias("ps"), F.col("b.ids").alias("qs"), *found)
    pairs = pairs.withColumn("p", F.explode("ps")).withColumn("q", F.explode("qs")).select(F.col("p.id").alias("first"), F.col("q.id").alias("second"), "gap", "axis")
    return pairs.where(F.col("first") < F.col("second")) if same else pairs


def enclosure_pairs(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """Boxes of ``b`` inside a box of ``a`` with a margin below ``distance`` on some side: (first, second, margin).

    The lower left corner of a box inside another one lies in that one too, so
    boxes of ``b`` are dealt to one small bin each and few that do not fit are compared.
    """
    ax0, ay0, ax1, ay1 = g.box("a")
    bx0, by0, bx1, by1 = g.box("b")
    margin = F.least(bx0 - ax0, ax1 - bx1, by0 - ay0, ay1 - by1)
    corner = {n: F.floor(F.col(c) / CORNER_BIN).cast("int") for n, c in (("bx", "x0"), ("by", "y0"))}
    left, right = binned(a, CORNER_BIN).alias("a"), b.withColumns(corner).alias("b")
    same = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by"))
    pairs = left.join(right, same & g.touches("a", "b") & g.inside("b", "a") & (margin < distance))
    return pairs.select(F.col("a.id").alias("first"), F.col("b.id").alias("second"), margin.alias("margin"))
