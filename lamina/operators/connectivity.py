"""Nets: connected components of touching shapes, and measures per net."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import lattice
from lamina.operators.spatial import MODES, spatial_join
from lamina.sources.staging import discard, staged


def touching(a: DataFrame, b: DataFrame | None = None, extra: Column | None = None) -> DataFrame:
    """(a, b): ids of touching shapes, within one layer once each."""
    on = MODES["interacting"]() if b is not None else MODES["interacting"]() & (F.col("a.id") < F.col("b.id"))
    pairs = spatial_join(a, a if b is None else b, on if extra is None else on & extra)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id) with ``net``, the smallest id that edges (a, b) reach."""
    roots = spanning_stars(edges).withColumnRenamed("node", "id").withColumnRenamed("root", "net")
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("net", "id").alias("net"))


def spanning_stars(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) except the smallest of its component, which is its root.

    Alternates two steps until nothing moves.  Large star: each node ties its
    larger neighbours to its smallest one.  Small star: each node ties its
    smaller neighbours and itself to the smallest.  Both keep components whole
    and hook whole trees at once, so rounds follow the logarithm of the longest
    chain whatever the order of its ids.  Each round is a table of its own:
    lost executors do not bring back earlier rounds and size estimates start afresh.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    now = staged(pairs.distinct(), "edges")
    was = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == was:
            return now
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.min("node")).alias("least"))
        larger = now.select(F.col("root").alias("node"), F.col("node").alias("far")).join(least, "node")
        large = staged(larger.select(F.col("far").alias("node"), F.col("least").alias("root")).distinct(), "edges")
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        smaller = large.join(least, "node")
        moved = smaller.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        next_ = staged(moved.unionByName(least.select("node", F.col("least").alias("root"))).distinct(), "edges")
        discard(now, large)
        now, was = next_, mark


def layer_nets(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``net``, joined within themselves."""
    return jointed(shapes, [(shapes, None)])


def connected_nets(shapes: DataFrame, connections: list[tuple[str, str]]) -> DataFrame:
    """``shapes`` with ``net``: layers of a pair (p, q) connect where they touch; (p, p) connects a layer with itself."""
    of = lambda layer: shapes.where(F.col("layer") == layer)
    return jointed(shapes, [(of(p), None if p == q else of(q)) for p, q in connections])


def jointed(shapes: DataFrame, pairs: list[tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """``shapes`` with ``net``, the smallest id of its component where the two sides of each pair touch.

    Joints stand for all touching pairs of a tile, so the links followed are
    those between joints of one shape, not those between shapes.
    """
    found = None
    for k, (first, second) in enumerate(pairs):
        part = lattice.joints(first, second).withColumn("joint", F.struct(F.lit(k).alias("pair"), "tx", "ty", "k"))
        part = part.select("id", "joint", (F.col("many") | F.lit(len(pairs) > 1)).alias("many"))
        found = part if found is None else found.unionByName(part)
    of = staged(found, "joints")
    several = of.where("many").select("joint", F.min("joint").over(Window.partitionBy("id")).alias("least"))
    roots = spanning_stars(several.select(F.col("joint").alias("a"), F.col("least").alias("b")))
    tied = of.select("id", "joint").join(roots, F.col("joint") == F.col("node"), "left").select("id", F.coalesce("root", "joint").alias("root"))
    names = tied.groupBy("root").agg(F.min("id").alias("net"))
    nets = tied.join(names, "root").select("id", "net").distinct()
    every = [df for pair in pairs for df in pair if df is not None]
    if lattice.any_irregular(0, *every):
        edges = nets.select(F.col("id").alias("a"), F.col("net").alias("b"))
        for first, second in pairs:
            odd = lattice.irregular(0)
            for a, b in ((first.where(odd), first if second is None else second), *(() if second is None else ((first, second.where(odd)),))):
                edges = edges.unionByName(touching(a, b))
        nets = components(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), edges)
    return shapes.join(nets, "id", "left").withColumn("net", F.coalesce("net", "id"))


def antenna(nets: DataFrame, gate: str, metal: str, limit: int) -> DataFrame:
    """Nets whose metal area is over ``limit`` times their gate area, both of single shapes: (net, gate_area, metal_area)."""
    size = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0")).cast("long")
    of = lambda layer: F.sum(F.when(F.col("layer") == layer, size).otherwise(0))
    sums = nets.groupBy("net").agg(of(gate).alias("gate_area"), of(metal).alias("metal_area"))
    return sums.where((F.col("gate_area") > 0) & (F.col("metal_area") > limit * F.col("gate_area")))


def traced(nets: DataFrame, seed: Column) -> DataFrame:
    """All shapes of the nets that hold a seed shape."""
    return nets.join(nets.where(seed).select("net").distinct(), "net", "left_semi")
