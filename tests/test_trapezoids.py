"""Booleans of polygons of any angle compared with exact clipping of triangles."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from lamina.operators import trapezoids as t

SCHEMA = "tag int, side string, pts array<struct<x: int, y: int>>, holes array<array<struct<x: int, y: int>>>"


def areas(spark, rows, size=t.SIDE):
    """{tag: (and, not, xor, or)} of rows (tag, side, points)."""
    rows = [(*r, None) if len(r) == 3 else r for r in rows]
    found = t.trapezoids(spark.createDataFrame(rows, SCHEMA), F.lit(True), ("tag",), ("a", "b"), size).withColumn("area", t.trapezoid_area())
    sums = [F.sum(F.when(t.OPERATIONS[k](F.col("a"), F.col("b")), F.col("area")).otherwise(0)).alias(k) for k in ("and", "not", "xor", "or")]
    return {r[0]: tuple(r)[1:] for r in found.groupBy("tag").agg(*sums).collect()}


def area2(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))


def common2(p, q):
    """Twice the common area of two convex polygons, exactly."""
    p = [tuple(map(Fraction, c)) for c in p]
    if area2(q) < 0:
        q = q[::-1]
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1]):
        out, at = [], lambda c: (bx - ax) * (c[1] - ay) - (by - ay) * (c[0] - ax)  # noqa: B023
        for c, d in zip(p, p[1:] + p[:1]):
            if at(c) >= 0:
                out.append(c)
            if at(c) * at(d) < 0:
                k = at(c) / (at(c) - at(d))
                out.append((c[0] + k * (d[0] - c[0]), c[1] + k * (d[1] - c[1])))
        p = out
        if not p:
            return 0
    return abs(area2(p))


def test_pairs_of_triangles(spark):
    rng = random.Random(3)
    point = lambda: (rng.randint(-40, 50), rng.randint(-40, 50))
    pairs = [([point() for _ in range(3)], [point() for _ in range(3)]) for _ in range(150)]
    rows = [(k, side, pts) for k, pair in enumerate(pairs) for side, pts in zip("ab", pair)]
    found = areas(spark, rows, 16)
    for k, (p, q) in enumerate(pairs):
        a, b, both = abs(area2(p)), abs(area2(q)), common2(p, q) if area2(p) and area2(q) else 0
        want = [float(Fraction(v) / 2) for v in (both, a - both, a + b - 2 * both, a + b - both)]
        assert all(abs(g - w) < 1e-6 for g, w in zip(found.get(k, (0,) * 4), want)), (k, p, q)


def test_overlapping_crowd_equals_points(spark):
    """Each input merges many polygons; lattice points inside are counted one by one."""
    rng = random.Random(5)
    point = lambda: (rng.randint(-20, 60), rng.randint(-20, 60))
    rows = [(0, rng.choice("ab"), [point() for _ in range(3)]) for _ in range(24)] + [(0, "a", [(0, 0), (0, 9), (30, 9), (30, 0)])] * 2
    found = t.trapezoids(spark.createDataFrame([(*r, None) for r in rows], SCHEMA).drop("holes"), F.lit(True), ("tag",), ("a", "b"))
    got = {(r.a, r.b): r.n for r in t.lattice_rows(found, 0.3711037, 0.4138291).groupBy("a", "b").agg(F.sum("points").alias("n")).collect()}

    def within(p, x, y):
        signs = {(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(p, p[1:] + p[:1])}
        return len(signs) == 1

    want = {}
    for i in range(-20, 60):
        for j in range(-20, 60):
            hit = tuple(int(any(s == side and within(p, i + 0.3711037, j + 0.4138291) for _, s, p in rows)) for side in "ab")
            want[hit] = want.get(hit, 0) + 1
    got.pop((0, 0), None), want.pop((0, 0), None)
    assert got == want and len(got) == 3


def test_hole_touching_edges_and_nothing(spark):
    square = [(0, 0), (0, 8), (8, 8), (8, 0)]
    hole = [(2, 2), (6, 2), (4, 6)]
    rows = [(1, "a", square, [hole]), (2, "a", square), (2, "b", [(8, 0), (8, 8), (16, 8)]), (3, "a", square), (3, "b", square), (4, "a", [(0, 0), (5, 5), (9, 9)]), (5, "a", [(1, 1), (1, 1), (4, 1)])]
    found = areas(spark, rows)
    assert found[1] == (0, 56, 56, 56) and found[2] == (0, 64, 96, 96) and found[3] == (64, 0, 0, 64)
    assert sum(found.get(4, (0,))) < 1e-9 and 5 not in found
