"""Recursive scans compared with a plain recursion over a random hierarchy."""

import random

import pytest

from lamina.operators import cell_scan

INSTANCE = "parent string, child string, x int, y int, quarter int, mirror boolean, na int, nb int, ax int, ay int, bx int, by int"


def tables(spark, instances, shapes, top):
    return spark.createDataFrame([(top,)], "cell string"), spark.createDataFrame(instances, INSTANCE), spark.createDataFrame(shapes, "cell string, x0 int, y0 int, x1 int, y1 int, layer int")


def plain(instances, shapes, cell, depth=0, place=lambda x, y: (x, y)):
    for c, x0, y0, x1, y1, layer in shapes:
        if c == cell:
            (a, b), (p, q) = place(x0, y0), place(x1, y1)
            yield depth, cell, layer, min(a, p), min(b, q), max(a, p), max(b, q)
    for parent, child, x, y, quarter, mirror, na, nb, ax, ay, bx, by in instances:
        if parent == cell:
            for i in range(na):
                for j in range(nb):

                    def inner(u, v, i=i, j=j):
                        v = -v if mirror else v
                        for _ in range(quarter):
                            u, v = -v, u
                        return place(u + x + i * ax + j * bx, v + y + i * ay + j * by)

                    yield from plain(instances, shapes, child, depth + 1, inner)


def test_random_hierarchy(spark):
    rng = random.Random(2)
    cells, n = "ABCDEF", lambda: rng.randint(-20, 20)
    instances = [(cells[k], cells[m], n(), n(), rng.randint(0, 3), rng.random() < 0.5, rng.randint(1, 2), rng.randint(1, 2), n(), n(), n(), n()) for k in range(5) for m in range(k + 1, 6) if rng.random() < 0.6 or m == k + 1]
    shapes = [(rng.choice(cells), x, y, x + rng.randint(0, 5), y + rng.randint(1, 5), rng.randint(1, 2)) for x, y in ((n(), n()) for _ in range(9))]
    every = list(plain(instances, shapes, "A"))
    x, y = next(r[3:5] for r in every if r[0] == 2)
    for low, high, box in ((0, None, None), (2, 3, None), (0, None, (-25, -10, 5, 20)), (1, 4, (x, y, x, y))):
        rows = cell_scan.scan_shapes(*tables(spark, instances, shapes, "A"), low, high, box).collect()
        want = [r for r in every if low <= r[0] <= (99 if high is None else high) and (not box or (r[3] <= box[2] and r[5] >= box[0] and r[4] <= box[3] and r[6] >= box[1]))]
        assert sorted((r.depth, r.cell, r.layer, r.x0, r.y0, r.x1, r.y1) for r in rows) == sorted(want) and want


def test_confined_placements_leave_early(spark):
    one = (0, 0, 0, False, 1, 1, 0, 0, 0, 0)
    instances = [("T", "L", -500, *one[1:]), ("T", "M", 500, *one[1:]), ("L", "Z", *one), ("M", "Z", *one), ("M", "empty", *one)]
    tops, inst, shapes = tables(spark, instances, [("Z", 0, 0, 9, 9, 1)], "T")
    found = cell_scan.scan_instances(tops, inst, shapes, confine=(400, 0, 600, 5)).collect()
    assert sorted((r.depth, r.cell, r.dx) for r in found) == [(0, "T", 0), (1, "M", 500), (2, "Z", 500)]


def test_nothing_and_a_cell_in_itself(spark):
    tops, inst, shapes = tables(spark, [], [], "T")
    assert cell_scan.scan_shapes(tops, inst, shapes).count() == 0
    assert [(r.cell, r.depth) for r in cell_scan.scan_instances(tops, inst, shapes).collect()] == [("T", 0)]


def test_a_cell_that_holds_itself_is_refused(spark, monkeypatch):
    monkeypatch.setattr(cell_scan, "DEEPEST", 4)
    loop = [("T", "T", 1, 0, 0, False, 1, 1, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        cell_scan.scan_instances(*tables(spark, loop, [("T", 0, 0, 1, 1, 1)], "T"))
