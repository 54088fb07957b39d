"""Merged polygons compared with a flood fill and with hand-made shapes."""

import random

from lamina.operators import contours


def merged(spark, boxes, **options):
    """Each ring as (hole, hull's first corner, corners)."""
    df = spark.createDataFrame([(*b, "m") for b in boxes], "x0 int, y0 int, x1 int, y1 int, layer string")
    ringed = contours.rings(df, ("layer",), **options)
    at = {}
    for r in contours.corners(ringed, ("layer",)).collect():
        at.setdefault(r.ring, []).append((r.position, r.x, r.y))
    points = {k: [p[1:] for p in sorted(v)] for k, v in at.items()}
    rows = contours.polygons(ringed, ("layer",)).collect()
    assert sorted(r.ring for r in rows) == sorted(points)
    for r in rows:
        p = points[r.ring]
        assert [k for k, *_ in sorted(at[r.ring])] == list(range(len(p))) and r.n_points == len(p)
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(p, p[1:] + p[:1]))
        assert p[0] == min(p, key=lambda c: (c[1], c[0]))
        assert r.area == abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) // 2
    return sorted((r.hole, points[r.hull][0], points[r.ring]) for r in rows)


def test_two_boxes_make_one_polygon(spark):
    corners = [(0, 100), (0, 300), (50, 300), (50, 350), (250, 350), (250, 150), (200, 150), (200, 100)]
    assert merged(spark, [(0, 100, 200, 300), (50, 150, 250, 350)]) == [(False, (0, 100), corners)]


def test_frame_with_an_island(spark):
    frame = [(0, 0, 90, 10), (0, 80, 90, 90), (0, 0, 10, 90), (80, 0, 90, 90)]
    found = merged(spark, [*frame, (40, 40, 50, 50), (40, 40, 50, 50), (5, 5, 5, 9)])
    assert [(hole, hull, len(p)) for hole, hull, p in found] == [(False, (0, 0), 4), (False, (40, 40), 4), (True, (0, 0), 4)]
    assert found[2][2] == [(10, 10), (80, 10), (80, 80), (10, 80)]


def test_corner_touch(spark):
    boxes = [(0, 0, 5, 5), (5, 5, 9, 9)]
    assert [len(p) for _, _, p in merged(spark, boxes)] == [8]
    assert [len(p) for _, _, p in merged(spark, boxes, min_coherence=True)] == [4, 4]


def test_nothing_to_merge(spark):
    assert merged(spark, []) == [] and merged(spark, [(3, 3, 3, 8)]) == []


def groups(cells, diagonal):
    """Connected sets of cells, of 4 or 8 neighbours."""
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    left, found = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            part.add((x, y))
            for dx, dy in near:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    stack.append((x + dx, y + dy))
        found.append(part)
    return found


def lowest(cells):
    return min(cells, key=lambda c: (c[1], c[0]))


def test_random_boxes_against_a_flood_fill(spark):
    rng = random.Random(7)
    boxes = [(x, y, x + rng.randint(1, 9), y + rng.randint(1, 9)) for x, y in ((rng.randint(-30, 60), rng.randint(-30, 60)) for _ in range(330))]
    cells = {(x, y) for x0, y0, x1, y1 in boxes for x in range(x0, x1) for y in range(y0, y1)}
    around = {(x, y) for x in range(-32, 72) for y in range(-32, 72)} - cells
    for min_coherence in (False, True):
        solids = groups(cells, diagonal=not min_coherence)
        owner = {c: lowest(part) for part in solids for c in part}
        want = [(False, lowest(part)) for part in solids]
        for free in groups(around, diagonal=min_coherence):
            if (-32, -32) not in free:
                x, y = min(free)
                want.append((True, owner[x - 1, y]))
        # tiles of 16 cut rings and rows many times
        found = merged(spark, boxes, min_coherence=min_coherence, size=16)
        assert sorted((hole, hull) for hole, hull, _ in found) == sorted(want)
        assert sum(hole for hole, *_ in found) > 5
        twice = sum(a[0] * b[1] - b[0] * a[1] for _, _, p in found for a, b in zip(p, p[1:] + p[:1]))
        assert -twice == 2 * len(cells)


def test_a_long_ring(spark):
    comb = [(0, 0, 1199, 1)] + [(2 * k, 0, 2 * k + 1, 3) for k in range(600)]
    ((_, _, p),) = merged(spark, comb)
    assert len(p) == 4 * 600 and p[0] == (0, 0)
