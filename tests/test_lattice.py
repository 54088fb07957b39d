"""Partners counted, and nets joined, without listing pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.operators import connectivity, lattice, spatial, trapezoids
from lamina.plans import shape_catalog

BOX = "id string, layer string, pid string, x0 int, y0 int, x1 int, y1 int"


def boxes(rng, name, n, far=300, long=40):
    made = []
    for k in range(n):
        x, y = rng.randint(-far, far), rng.randint(-far, far)
        made.append((f"{name}{k}", name, rng.choice(["F", "O", None]), x, y, x + rng.randint(1, long), y + rng.randint(1, long)))
    return made


def meets(a, b, open_=0):
    return a[3] + open_ <= b[5] and b[3] + open_ <= a[5] and a[4] + open_ <= b[6] and b[4] + open_ <= a[6]


@pytest.fixture(scope="module")
def layers():
    rng = random.Random(5)
    a, b = boxes(rng, "A", 300), boxes(rng, "R", 300)
    # a long one, a point, borders of tiles, turned inside out, without a corner, one id for two boxes
    a += [("A-long", "A", "F", -700, -3, 900, 3), ("A-point", "A", "O", 128, 128, 128, 128), ("A-out", "A", "F", 90, 60, 40, 20), ("A-null", "A", "F", None, 0, 5, 5), ("A0", "A", "O", 250, 250, 290, 290)]
    b += [("R-edge", "R", "O", 128, 100, 256, 128), ("R-out", "R", "F", 30, 200, 10, 160), ("R-flat", "R", "O", -200, 7, 200, 7), ("R1", "R", "F", 0, 0, 128, 128)]
    return a, b


@pytest.mark.parametrize("mode, open_", [("interacting", 0), ("overlapping", 1)])
def test_partners_against_all_pairs(spark, layers, mode, open_):
    a, b = layers
    whole = [r for r in a if r[3] is not None]
    want = {x[0]: {z[0] for y in whole if y[0] == x[0] for z in b if meets(y, z, open_)} for x in a}
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    got = {(r["id"], r["x0"]): r["partners"] for r in spatial.partner_counts(left, right, mode).collect()}
    assert got == {(x[0], x[3]): len(want[x[0]]) for x in a}
    hit = {r["id"] for r in spatial.selected(left, right, mode).collect()}
    assert hit == {k for k, v in want.items() if v}
    assert {r["id"] for r in spatial.pulled(left, right, mode).collect()} == set().union(*want.values())
    assert {r["id"] for r in spatial.split(left, right, mode).where("NOT hit").collect()} == {k for k, v in want.items() if not v}


def test_covering_against_all_pairs(spark, layers):
    a, b = layers
    rng = random.Random(3)
    small = [(f"S{k}", "R", "F", x, y, x + rng.randint(0, 6), y + rng.randint(0, 6)) for k in range(400) for x, y in [(rng.randint(-300, 300), rng.randint(-300, 300))]]
    b = b + small + [("R-wide", "R", "F", -600, -2, -500, 2), ("R-out2", "R", "F", -100, 1, -104, 2), ("R-in", "R", "F", 250, 250, 251, 251), ("S1", "R", "F", 251, 250, 251, 252)]
    lies = lambda x, z: z[3] >= x[3] and z[5] <= x[5] and z[4] >= x[4] and z[6] <= x[6] and meets(x, z)
    whole = [r for r in a if r[3] is not None]
    want = {x[0]: {z[0] for y in whole if y[0] == x[0] for z in b if lies(y, z)} for x in a}
    assert max(map(len, want.values())) > 3 and "R-wide" in want["A-long"]
    left, right = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    for least, most in ((1, None), (2, None), (1, 1), (2, 3), (9, None)):
        good = {k for k, v in want.items() if len(v) >= least and (most is None or len(v) <= most)}
        assert {r["id"] for r in spatial.selected(left, right, "covering", least, most).collect()} == good, (least, most)
    assert {r["id"] for r in spatial.split(left, right, "covering").where("hit").collect()} == {k for k, v in want.items() if v}
    assert {r["id"] for r in spatial.pulled(right, left, "inside").collect()} == {k for k, v in want.items() if v}


def test_dense_layers_cover_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "spatial_join", None)
    side = lambda name, low, high: spark.range(20_000).selectExpr(f"concat('{name}', id) AS id", *[f"CAST(id % {n} + {d} AS int) AS {c}" for c, n, d in (("x0", 7, low), ("y0", 11, low), ("x1", 5, high), ("y1", 3, high))])
    a, b = side("A", 0, 100), side("R", 20, 70)
    assert spatial.selected(a, b, "covering", 2).count() == spatial.split(a, b, "covering").where("hit").count() == 20_000


@pytest.mark.parametrize("same", [True, False])
def test_partners_by_property(spark, layers, same):
    a, b = ([r for r in side if r[3] is not None] for side in layers)
    want = {x[0] for x in a for y in b if meets(x, y) and None not in (x[2], y[2]) and (x[2] == y[2]) == same}
    got = spatial.selected_by(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), "interacting", "pid", same)
    assert {r["id"] for r in got.collect()} == want


def nets(shapes, joined):
    net = {s[0]: s[0] for s in shapes}
    while True:
        was = dict(net)
        for x, y in joined:
            net[x] = net[y] = min(net[x], net[y])
        if net == was:
            return net


def test_nets_against_all_pairs(spark, layers):
    rng = random.Random(8)
    for far, long in ((300, 60), (700, 25)):
        shapes = boxes(rng, "A", 150, far, long) + boxes(rng, "R", 150, far, long) + [r for side in layers for r in side if "-" in r[0] and r[3] is not None]
        frame = spark.createDataFrame(shapes, BOX)
        for pairs in ([("A", "A")], [("A", "R")], [("A", "R"), ("R", "R")]):
            want = nets(shapes, [(x[0], y[0]) for x in shapes for y in shapes if (x[1], y[1]) in pairs and meets(x, y)])
            assert {r["id"]: r["net"] for r in connectivity.connected_nets(frame, pairs).collect()} == want, (far, pairs)


def test_comb_links_its_teeth_through_gaps(spark):
    """Points of one box that lie apart are one net; those of two boxes side by side are not."""
    teeth = [(f"R{k}", "R", "F", 10 * k, 5 * (k % 3), 10 * k + 2, 5 * (k % 3) + 1) for k in range(12)]
    rows = [("A0", "A", "F", 0, 0, 60, 20), ("A1", "A", "F", 63, 0, 119, 20), *teeth]
    found = {r["id"]: r["net"] for r in connectivity.connected_nets(spark.createDataFrame(rows, BOX), [("A", "R")]).collect()}
    assert found == {r[0]: "A0" if r[0] == "A0" or (r[0][0] == "R" and r[3] <= 60) else "A1" for r in rows}


def test_dense_layers_list_no_pairs(spark, monkeypatch):
    """Partners are counted although nothing is joined pair by pair."""
    monkeypatch.setattr(spatial, "spatial_join", None)
    monkeypatch.setattr(connectivity, "spatial_join", None)
    side = lambda name: spark.range(30_000).selectExpr(f"concat('{name}', id) AS id", f"'{name}' AS layer", "'F' AS pid", *[f"CAST(id % {n} + {d} AS int) AS {c}" for c, n, d in (("x0", 7, 0), ("y0", 11, 0), ("x1", 5, 200), ("y1", 3, 200))])
    a, b = side("A"), side("R")
    assert spatial.partner_counts(a, b, "interacting").where("partners = 30000").count() == 30_000
    assert connectivity.connected_nets(a.unionByName(b), [("A", "R")]).where("net = 'A0'").count() == 60_000
    assert lattice.SIDE < 200


def test_rasters_cover_as_windows_do(spark):
    from lamina.functions import geometry as g
    from lamina.operators import sweep

    rows = [(r[1], r[2], *r[3:]) for name in "AR" for r in boxes(random.Random(name), name, 120, 150, 60)]
    frame = spark.createDataFrame(rows, "layer string, pid string, x0 int, y0 int, x1 int, y1 int")
    tiles = sweep.tiled(frame.select("layer", *g.BOX), 32, 3).select("tx", "ty", *g.BOX, (frame.layer == "A").alias("first")).selectExpr("tx", "ty", "x0", "y0", "x1", "y1", "IF(first, 'a', 'b') AS side")

    def cells(wraps, clip):
        found = {}
        for r in wraps.collect():
            for x in range(r.x0, r.x1):
                for y in range(r.y, r.top):
                    if r.a or r.b:
                        assert (r.tx, r.ty, x, y) not in found
                        found[r.tx, r.ty, x, y] = (min(r.a, clip), min(r.b, clip))
        return found

    for present in (False, True):
        by_windows = cells(sweep.swept(tiles, ["tx", "ty"]).where("x1 IS NOT NULL"), 1 if present else 999)
        assert cells(lattice.wraps(tiles, ["tx", "ty"], 32, 3, present), 999) == by_windows


def test_many_boxes_at_one_place_are_few_runs(spark):
    """What 20,000 boxes cover together is told by one run; the windows gave some for each height."""
    from lamina.operators import sweep

    heap = spark.range(20_000).selectExpr("CAST(id % 50 AS int) AS x0", "CAST(id % 49 AS int) AS y0", "CAST(100 + id % 50 AS int) AS x1", "CAST(100 + id % 49 AS int) AS y1", "'L' AS layer")
    square = heap.unionByName(spark.createDataFrame([(0, 0, 149, 148, "L")], heap.schema))
    assert [tuple(r) for r in sweep.runs(square, None, "or").select("x0", "y0", "x1", "y1").collect()] == [(0, 0, 149, 148)]


def test_difference_counts_like_difference(spark):
    from lamina.operators import netlist

    rng = random.Random(2)
    a, b = (spark.createDataFrame([(rng.randint(0, 3), rng.choice(["F", None])) for _ in range(n)], "x0 int, pid string") for n in (40, 31))
    want = netlist.difference(a, b).groupBy("side", "x0", "pid").count().collect()
    assert sorted(map(repr, map(tuple, netlist.difference_counts(a, b).collect()))) == sorted(map(repr, map(tuple, want)))


def test_edge_intersections_list_no_pairs(spark, sf_dir, monkeypatch):
    from lamina.plans import shape_catalog

    monkeypatch.setattr(spatial, "spatial_join", None)
    found = shape_catalog.edge_intersections(spark, sf_dir)
    assert found.count() == found.distinct().count() > 0


def test_points_inside_crowds_of_polygons(spark):
    """Holes, contours either way round, an L, polygons over many tiles and a crowd at one place, against trapezoids and point by point."""
    rng = random.Random(9)
    dx, dy = 0.3711037, 0.4138291
    point = lambda: (rng.randint(-150, 150), rng.randint(-90, 200))
    near = lambda: (rng.randint(0, 20), rng.randint(0, 20))
    rows = [(rng.randint(0, 1), [point() for _ in range(3)], None) for _ in range(12)]
    rows += [(0, [(-140, 0), (-140, 30), (-120, 30), (-120, 10), (-100, 10), (-100, 0)], None), (1, [(200, 200), (300, 200), (300, 300), (200, 300)], [[(210, 210), (210, 290), (290, 290)], [(299, 201), (299, 203), (240, 201)]])]
    rows += [(1, [(5, 5), (9, 9), (0, 0)], None), (1, [(3, 3)], None), (1, None, None), (7, [(0, 0), (0, 9), (9, 9)], None), (None, [(0, 0), (0, 9), (9, 9)], None)]
    schema = "kind int, pts array<struct<x: int, y: int>>, holes array<array<struct<x: int, y: int>>>"
    polygons = spark.createDataFrame(rows, schema)
    count = lambda found: {(r.a, r.b): r.n for r in found.groupBy("a", "b").agg(F.sum("n").alias("n")).collect() if r.a or r.b}
    bits = [F.expr(f"int((inside >> {k}) & 1)").alias(c) for k, c in enumerate("ab")]
    got = count(lattice.points_inside(polygons, 2, dx, dy).select("n", *bits))
    sided = polygons.where("kind < 2").withColumn("side", F.expr("if(kind = 0, 'a', 'b')"))
    assert got == count(trapezoids.lattice_rows(trapezoids.trapezoids(sided, F.lit(True), (), ("a", "b")), dx, dy).withColumnRenamed("points", "n"))

    crowd = [(rng.randint(0, 1), [near() for _ in range(3)], None) for _ in range(4000)]
    want = {}
    x, y = np.meshgrid(np.arange(20) + dx, np.arange(20) + dy)
    for kind in (0, 1):
        hit = np.zeros(x.shape, bool)
        for p in (p for k, p, _ in crowd if k == kind):
            turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(p, p[1:] + p[:1], strict=True)]
            hit |= np.logical_and.reduce(turns) | ~np.logical_or.reduce(turns)
        want[kind] = hit
    got = count(lattice.points_inside(spark.createDataFrame(crowd, schema).drop("holes"), 2, dx, dy).select("n", *bits))
    pairs = {(a, b): int(((want[0] == a) & (want[1] == b)).sum()) for a, b in ((0, 1), (1, 0), (1, 1))}
    assert got == {k: n for k, n in pairs.items() if n}


def test_points_inside_in_small_steps():
    rng = random.Random(3)
    contours = [[rng.randint(-40, 200) for _ in range(2 * n)] for n in (3, 1, 5, 4)] * 2
    columns = {"tx": [0] * 8, "ty": [0] * 8, "hole": [False] * 8, "pts": pa.array(contours, pa.list_(pa.int32()))}
    rows = pa.RecordBatch.from_pydict(columns)
    found = []
    for step in (1, 7, 1 << 20):
        state = lattice._Windings(0.3, 0.4)
        state.ROWS = step
        state.take(0, rows.slice(0, 3))
        state.take(0, rows.slice(3))
        found.append(state.close().to_pylist())
    assert found[0] == found[1] == found[2] and len(found[0]) == 2


def test_poly_booleans_looks_for_no_crossings(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(trapezoids, "edge_pieces", None)
    assert shape_catalog.poly_booleans(spark, sf_dir).count() > 0


def test_enclosure_pairs_deal_inner_boxes_once(spark, layers, monkeypatch):
    a, b = layers
    b = b + [(f"R-in{k}", "R", "F", x, y, x + 4, y + 3) for k, (_, _, _, x, y, _, _) in enumerate(r for r in a if r[3] is not None)]
    inner = lambda p, q: q[3] >= p[3] and q[5] <= p[5] and q[4] >= p[4] and q[6] <= p[6]
    margin = lambda p, q: min(q[3] - p[3], p[5] - q[5], q[4] - p[4], p[6] - q[6])
    straight = lambda r: r[3] is not None and r[3] <= r[5] and r[4] <= r[6]
    whole = [[r for r in t if straight(r)] for t in (a, b)]
    want = sorted((p[0], q[0], margin(p, q)) for p in whole[0] for q in whole[1] if inner(p, q) and margin(p, q) < 3)
    dealt, was = [], spatial.binned
    monkeypatch.setattr(spatial, "binned", lambda df, *size: (dealt.append(size), was(df, *size))[1])
    left, right = (spark.createDataFrame([r for r in t if r[3] is None or straight(r)], BOX) for t in (a, b))
    assert sorted(map(tuple, spatial.enclosure_pairs(left, right, 3).collect())) == want and len(want) > 100
    assert len(dealt) == 1
