"""Parts of edges inside, along and outside of a region."""

import math
import random

from lamina.operators import edge_region as e

POLYGONS = "pts array<struct<x: int, y: int>>, holes array<array<struct<x: int, y: int>>>"
BOX = [(0, 0), (0, 10), (10, 10), (10, 0)]


def parts(spark, edges, polygons, size=32):
    rows = e.edge_parts(spark.createDataFrame([(k, *v) for k, v in enumerate(edges)], "id int, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame([(p, None) if isinstance(p, list) else p for p in polygons], POLYGONS), (), size).collect()
    return [sorted((round(r.t0, 6), round(r.t1, 6), r.place) for r in rows if r.id == k) for k in range(len(edges))]


def test_by_hand(spark):
    s = math.sqrt(2)
    edges = [(0, 0, 10, 0), (0, 0, 10, 10), (1, 1, 20, 20), (-5, 5, 15, 5), (10, -3, 10, 4), (20, 20, 30, 30), (3, 3, 3, 3), (-4, 10, 4, 10)]
    found = parts(spark, edges, [BOX])
    assert found[0] == [(0, 10, "border")] and found[1] == [(0, round(10 * s, 6), "inside")]
    assert found[2] == [(0, round(9 * s, 6), "inside"), (round(9 * s, 6), round(19 * s, 6), "outside")]
    assert found[3] == [(0, 5, "outside"), (5, 15, "inside"), (15, 20, "outside")]
    assert found[4] == [(0, 3, "outside"), (3, 7, "border")] and found[5] == [(0, round(10 * s, 6), "outside")]
    assert found[6] == [] and found[7] == [(0, 4, "outside"), (4, 8, "border")]


def test_abutting_boxes_are_one_region(spark):
    other = [(10, 0), (10, 10), (20, 10), (20, 0)]
    for size in (4, 10, 32):
        found = parts(spark, [(10, 0, 10, 10), (10, -2, 10, 12), (2, 5, 18, 5)], [BOX, other, BOX], size)
        assert found == [[(0, 10, "inside")], [(0, 2, "outside"), (2, 12, "inside"), (12, 14, "outside")], [(0, 16, "inside")]]


def test_slanted_border_hole_and_long_edge(spark):
    triangle, hole = [(0, 0), (0, 30), (40, 0)], [(5, 5), (5, 10), (10, 10), (10, 5)]
    found = parts(spark, [(0, 30, 40, 0), (40, 0, 0, 30), (0, 7, 12, 7), (5, 0, 5, 10), (-3000, 1, 3000, 1)], [(triangle, [hole])], 8)
    assert found[0] == found[1] == [(0, 50, "border")]
    assert found[2] == [(0, 5, "inside"), (5, 10, "outside"), (10, 12, "inside")] and found[3] == [(0, 5, "inside"), (5, 10, "border")]
    assert round(sum(b - a for a, b, p in found[4] if p == "inside"), 5) == round(40 * 29 / 30, 5)


def test_random_edges_against_samples(spark):
    rng = random.Random(11)
    point = lambda: (rng.randint(-30, 60), rng.randint(-30, 60))
    triangles, edges = [[point() for _ in range(3)] for _ in range(9)], [(*point(), *point()) for _ in range(60)]

    def within(p, x, y):
        return len({(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(p, p[1:] + p[:1])}) == 1

    for (x1, y1, x2, y2), found in zip(edges, parts(spark, edges, triangles, 16)):
        long = math.hypot(x2 - x1, y2 - y1)
        assert abs(sum(b - a for a, b, _ in found) - long) < 1e-4
        for a, b, place in found:
            for part in (0.013, 0.31, 0.52, 0.77, 0.988):
                k = (a + (b - a) * part) / long
                hit = any(within(p, x1 + (x2 - x1) * k, y1 + (y2 - y1) * k) for p in triangles)
                assert b - a < 1e-4 or hit == (place == "inside"), (x1, y1, x2, y2, a, b, place)


def test_lengths_in_rasters_equal_sums_of_parts(spark, monkeypatch):
    """Level and upright edges against whole boxes make no trapezoids, and give what their parts sum to."""
    rng = random.Random(4)
    corner = lambda: (rng.randint(-150, 150), rng.randint(-150, 150))
    boxes, edges = [(128, -128, 140, 128, 1), (-128, 0, 0, 5, 0), (20, 20, 20, 60, 0)], [(0, 128, -140, 128, 128, 1), (1, -140, 0, 140, 0, 0), (2, 5, 5, 5, 5, 0)]
    boxes += [(x, y, x + rng.randint(1, 60), y + rng.randint(1, 60), rng.randint(0, 1)) for x, y in (corner() for _ in range(30))]
    for k in range(3, 120):
        x, y = corner()
        d = rng.randint(-200, 200)
        edges.append((k, x, y, *((x + d, y) if k % 2 else (x, y + d)), rng.randint(0, 1)))
    edges.append((200, 0, 0, 1, 1, None))
    frame = spark.createDataFrame(edges, "id int, x1 int, y1 int, x2 int, y2 int, layer int")
    region = spark.createDataFrame([(b[4], [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]) for b in boxes], "layer int, pts array<struct<x: int, y: int>>")
    rows = lambda df: {r.id: (r.layer, round(r.inside, 6), round(r.border, 6), round(r.outside, 6)) for r in df.collect()}
    parts = e.edge_parts(frame, region, ("layer",))
    want = rows(parts.groupBy("layer", "id").pivot("place", ["inside", "border", "outside"]).sum("t1", "t0").selectExpr("layer", "id", *[f"coalesce(`{p}_sum(t1)` - `{p}_sum(t0)`, 0.0) AS {p}" for p in ("inside", "border", "outside")]))
    slanted = spark.createDataFrame([(201, 0, 0, 30, 40, 1)], frame.schema)
    both = rows(e.edge_lengths(frame.unionByName(slanted), region, ("layer",)))
    assert abs(sum(both.pop(201)[1:]) - 50) < 1e-5 and both == want
    odd = e.edge_lengths(frame.unionByName(slanted).selectExpr("*", "id % 2 AS odd"), region, ("layer",), by="odd").where("layer = 1 AND odd = 1").first()
    assert abs(odd.inside + odd.border + odd.outside - 50 - sum(sum(v[1:]) for k, v in want.items() if k % 2 and v[0] == 1)) < 1e-4
    monkeypatch.setattr(e, "trapezoids", None)
    del want[200]
    assert rows(e.edge_lengths(frame.where("id <> 200"), region, ("layer",))) == want
