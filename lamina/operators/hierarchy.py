"""Cell hierarchy: a DAG of instances, expanded level by level with aggregates instead of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def total_weights(tops: DataFrame, instances: DataFrame, depth: int) -> DataFrame:
    """(top, cell, level, weight): how often each top cell holds a cell, over all paths of at most ``depth`` steps.

    Paths that meet in a cell are summed at every level, so the work follows
    the number of distinct (top, cell) pairs and not the number of paths.
    """
    level = tops.select(F.col("cell").alias("top"), "cell", F.lit(0).alias("level"), F.lit(1).cast("long").alias("weight"))
    found = level
    steps = instances.groupBy("parent", "child").agg(F.count("*").alias("n"))
    for k in range(1, depth + 1):
        level = level.join(steps, F.col("cell") == F.col("parent")).groupBy("top", F.col("child").alias("cell"))
        level = level.agg(F.sum(F.col("weight") * F.col("n")).alias("weight")).withColumn("level", F.lit(k))
        found = found.unionByName(level)
    return found


def cell_boxes(cell_shapes: DataFrame, *cells: str) -> DataFrame:
    """(cell, x0, y0, x1, y1): the bounding box below each cell named by the columns ``cells`` of a shape's row."""
    named = cell_shapes.select(F.explode(F.array(*cells)).alias("cell"), "x0", "y0", "x1", "y1")
    return named.groupBy("cell").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def flattened(instances: DataFrame, shapes: DataFrame) -> DataFrame:
    """Boxes (cell, x0, y0, x1, y1) of the top cell from one level of instances.

    ``instances`` has cell, x, y, quarter (turns to the left) and an array of
    na by nb copies at steps (ax, ay) and (bx, by); ``shapes`` has cell and the box.
    """
    each = instances.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    placed = each.select("cell", "quarter", (F.col("x") + F.col("ax") * F.col("i") + F.col("bx") * F.col("j")).alias("dx"), (F.col("y") + F.col("ay") * F.col("i") + F.col("by") * F.col("j")).alias("dy"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    turns = [(x0, y0, x1, y1), (-y1, x0, -y0, x1), (-x1, -y1, -x0, -y0), (y0, -x1, y1, -x0)]
    turned = [F.element_at(F.array(*[t[k] for t in turns]), F.col("quarter") + 1) for k in range(4)]
    moved = [(c + F.col("dx" if k % 2 == 0 else "dy")).alias(n) for k, (c, n) in enumerate(zip(turned, ("x0", "y0", "x1", "y1"), strict=True))]
    return placed.join(shapes, "cell").select("cell", *moved)
