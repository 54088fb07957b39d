"""Points, vectors, edges, edge pairs, boxes, paths, texts and matrices as Column expressions.

A point or vector is STRUCT<x, y>, an edge STRUCT<x1, y1, x2, y2> from its start
to its end, an edge pair two edge columns, a matrix STRUCT<m11, m12, m21, m22,
dx, dy>.  Whole-number products are taken as BIGINT, so signs are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def point(x: Column | int, y: Column | int) -> Column:
    return F.struct(_long(x).alias("x"), _long(y).alias("y"))


def edge(x1: Column | int, y1: Column | int, x2: Column | int, y2: Column | int) -> Column:
    return F.struct(_long(x1).alias("x1"), _long(y1).alias("y1"), _long(x2).alias("x2"), _long(y2).alias("y2"))


def rounded(c: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(c + 0.5).cast("long")


# ---------------------------------------------------------------- points and vectors


def sq_distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return dx * dx + dy * dy


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(sq_distance(p, q).cast("double"))


def sq_abs(p: Column) -> Column:
    return p["x"] * p["x"] + p["y"] * p["y"]


def abs_(p: Column) -> Column:
    """Distance from the origin, or a vector's length."""
    return F.sqrt(sq_abs(p).cast("double"))


def moved(p: Column, dx: Column | int, dy: Column | int) -> Column:
    return point(p["x"] + dx, p["y"] + dy)


def to_s(p: Column) -> Column:
    return F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))


def from_s(s: Column) -> Column:
    """A point from ``x,y``; null where the text is none."""
    parts = F.split(s, ",")
    return F.when(s.rlike(r"^\s*-?\d+\s*,\s*-?\d+\s*$"), point(F.trim(parts[0]), F.trim(parts[1])))


def hash_(p: Column) -> Column:
    return F.xxhash64(p["x"], p["y"])


def vprod(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def sprod(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def sign(c: Column) -> Column:
    return F.signum(c).cast("int")


# ---------------------------------------------------------------- edges


def p1(e: Column) -> Column:
    return point(e["x1"], e["y1"])


def p2(e: Column) -> Column:
    return point(e["x2"], e["y2"])


def dx(e: Column) -> Column:
    return e["x2"] - e["x1"]


def dy(e: Column) -> Column:
    return e["y2"] - e["y1"]


def d(e: Column) -> Column:
    """The vector from start to end."""
    return point(dx(e), dy(e))


def dx_abs(e: Column) -> Column:
    return F.abs(dx(e))


def dy_abs(e: Column) -> Column:
    return F.abs(dy(e))


def sq_length(e: Column) -> Column:
    return dx(e) * dx(e) + dy(e) * dy(e)


def length(e: Column) -> Column:
    """Rounded to whole units, as lengths of whole-number edges are."""
    return rounded(F.sqrt(sq_length(e).cast("double")))


def ortho_length(e: Column) -> Column:
    return dx_abs(e) + dy_abs(e)


def is_degenerate(e: Column) -> Column:
    return (dx(e) == 0) & (dy(e) == 0)


def swapped_points(e: Column) -> Column:
    return edge(e["x2"], e["y2"], e["x1"], e["y1"])


def edge_enlarged(e: Column, dx_: int, dy_: int) -> Column:
    """Start moved against the vector, end along it."""
    return edge(e["x1"] - dx_, e["y1"] - dy_, e["x2"] + dx_, e["y2"] + dy_)


def _unit(e: Column) -> tuple[Column, Column]:
    n = F.greatest(F.sqrt(sq_length(e).cast("double")), F.lit(1e-300))
    return dx(e) / n, dy(e) / n


def shifted(e: Column, by: float) -> Column:
    """Moved at a right angle to its left; a point stays."""
    ux, uy = _unit(e)
    sx, sy = rounded(-uy * by), rounded(ux * by)
    return edge(e["x1"] + sx, e["y1"] + sy, e["x2"] + sx, e["y2"] + sy)


def extended(e: Column, by: float) -> Column:
    """Longer by ``by`` at either end; a point stays."""
    ux, uy = _unit(e)
    sx, sy = rounded(ux * by), rounded(uy * by)
    return edge(e["x1"] - sx, e["y1"] - sy, e["x2"] + sx, e["y2"] + sy)


def _from_start(e: Column, p: Column) -> Column:
    return point(p["x"] - e["x1"], p["y"] - e["y1"])


def side_of(e: Column, p: Column) -> Column:
    """1 left of the edge's line, -1 right of it, 0 on it."""
    return sign(vprod(d(e), _from_start(e, p)))


def edge_distance(e: Column, p: Column) -> Column:
    """Signed distance of a point to the edge's line, positive to its left; 0 for a point-like edge."""
    away = vprod(d(e), _from_start(e, p)) / F.sqrt(sq_length(e).cast("double"))
    return F.when(is_degenerate(e), F.lit(0).cast("long")).otherwise(rounded(away))


def distance_abs(e: Column, p: Column) -> Column:
    return F.abs(edge_distance(e, p))


def euclidian_distance(e: Column, p: Column) -> Column:
    """Distance of a point to the nearest point of the edge."""
    along, near = sprod(d(e), _from_start(e, p)), F.lit(0)
    ends = F.when(along <= near, distance(p1(e), p)).when(along >= sq_length(e), distance(p2(e), p))
    return rounded(F.coalesce(ends, F.abs(vprod(d(e), _from_start(e, p))) / F.sqrt(sq_length(e).cast("double"))))


def contains(e: Column, p: Column) -> Column:
    """The point lies on the edge, its ends included."""
    along = sprod(d(e), _from_start(e, p))
    return (vprod(d(e), _from_start(e, p)) == 0) & (along >= 0) & (along <= sq_length(e)) & (~is_degenerate(e) | (sq_distance(p1(e), p) == 0))


def contains_excl(e: Column, p: Column) -> Column:
    """The point lies on the edge between its ends."""
    along = sprod(d(e), _from_start(e, p))
    return (vprod(d(e), _from_start(e, p)) == 0) & (along > 0) & (along < sq_length(e))


def is_parallel(e: Column, f: Column) -> Column:
    return vprod(d(e), d(f)) == 0


def coincident(e: Column, f: Column) -> Column:
    """Collinear edges that share more than a point."""
    line = is_parallel(e, f) & (vprod(d(e), _from_start(e, p1(f))) == 0)
    a, b = sprod(d(e), _from_start(e, p1(f))), sprod(d(e), _from_start(e, p2(f)))
    return line & ~is_degenerate(e) & (F.greatest(a, b) > 0) & (F.least(a, b) < sq_length(e))


def crossed_by(e: Column, line: Column) -> Column:
    """The ends of ``e`` are not on one side of the line through ``line``."""
    return side_of(line, p1(e)) * side_of(line, p2(e)) <= 0


def intersects(e: Column, f: Column) -> Column:
    """Closed edges share a point."""
    boxes = (
        (F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"])) & (F.least(f["x1"], f["x2"]) <= F.greatest(e["x1"], e["x2"]))
        & (F.least(e["y1"], e["y2"]) <= F.greatest(f["y1"], f["y2"])) & (F.least(f["y1"], f["y2"]) <= F.greatest(e["y1"], e["y2"]))
    )
    return boxes & crossed_by(e, f) & crossed_by(f, e)


def cut_point(e: Column, f: Column) -> Column:
    """Where the lines of two edges meet; null for parallel ones."""
    t = vprod(_from_start(e, p1(f)), d(f)) / vprod(d(e), d(f)).cast("double")
    return F.when(~is_parallel(e, f), point(rounded(e["x1"] + t * dx(e)), rounded(e["y1"] + t * dy(e))))


def crossing_point(e: Column, line: Column) -> Column:
    """Where ``line``'s line crosses the edge; null where it does not."""
    return F.when(crossed_by(e, line), cut_point(e, line))


def intersection_point(e: Column, f: Column) -> Column:
    """Where two edges meet; null where they do not or run along each other."""
    return F.when(intersects(e, f), cut_point(e, f))


def _clip(e: Column, x0: Column, y0: Column, x1: Column, y1: Column, low: Column, high: Column) -> Column:
    for n, a, delta, first, last in (("x", e["x1"], dx(e), x0, x1), ("y", e["y1"], dy(e), y0, y1)):
        t0, t1 = (first - a) / delta.cast("double"), (last - a) / delta.cast("double")
        still = delta == 0
        low = F.when(still, F.when((a < first) | (a > last), F.lit(float("inf"))).otherwise(low)).otherwise(F.greatest(low, F.least(t0, t1)))
        high = F.when(still, high).otherwise(F.least(high, F.greatest(t0, t1)))
    at = lambda t: (rounded(e["x1"] + t * dx(e)), rounded(e["y1"] + t * dy(e)))
    return F.when(low <= high, edge(*at(low), *at(high)))


def clipped(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of the edge inside a box; null where there is none."""
    safe = F.when(~is_degenerate(e), e)
    return _clip(safe, x0, y0, x1, y1, F.lit(0.0), F.lit(1.0))


def clipped_line(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of the edge's line inside a box; null where there is none."""
    safe = F.when(~is_degenerate(e), e)
    return _clip(safe, x0, y0, x1, y1, F.lit(float("-inf")), F.lit(float("inf")))


def segment(e: Column, mode: str, by: int, fraction: float) -> Column:
    """Start, end or centre piece: as long as ``by`` or ``fraction`` of the edge, whichever is longer."""
    n = F.sqrt(sq_length(e).cast("double"))
    share = F.greatest(F.lit(float(by)), n * fraction) / F.greatest(n, F.lit(1e-300))
    low, high = {"start": (F.lit(0.0), share), "end": (1 - share, F.lit(1.0)), "center": (0.5 - share / 2, 0.5 + share / 2)}[mode]
    at = lambda t: (rounded(e["x1"] + t * dx(e)), rounded(e["y1"] + t * dy(e)))
    return edge(*at(low), *at(high))


def orientation(e: Column) -> Column:
    """horizontal, vertical, diagonal (45 or 135 degrees), other or point."""
    kind = F.when(is_degenerate(e), "point").when(dy(e) == 0, "horizontal").when(dx(e) == 0, "vertical")
    return kind.when(dx_abs(e) == dy_abs(e), "diagonal").otherwise("other")


# ---------------------------------------------------------------- edge pairs


def normalized(first: Column, second: Column) -> tuple[Column, Column]:
    """The first edge turned where it runs like the second one, so that the polygon between them does not cross itself."""
    turn = sprod(d(first), d(second)) > 0
    flip = lambda e: F.when(turn, swapped_points(e)).otherwise(e)
    return flip(first), second


def pair_points(first: Column, second: Column) -> Column:
    """Vertices of the polygon between two edges."""
    a, b = normalized(first, second)
    return F.array(p1(a), p2(a), p1(b), p2(b))


def pair_distance(first: Column, second: Column) -> Column:
    """Least distance of two edges; 0 where they meet."""
    ends = F.least(euclidian_distance(first, p1(second)), euclidian_distance(first, p2(second)), euclidian_distance(second, p1(first)), euclidian_distance(second, p2(first)))
    return F.when(intersects(first, second), F.lit(0).cast("long")).otherwise(ends)


def pair_perimeter(first: Column, second: Column) -> Column:
    return length(first) + length(second)


def pair_area2(first: Column, second: Column) -> Column:
    """Twice the area of the polygon between two edges."""
    return F.abs(area2(pair_points(first, second)))


def pair_bbox(first: Column, second: Column) -> Column:
    xs = [e[c] for e in (first, second) for c in ("x1", "x2")]
    ys = [e[c] for e in (first, second) for c in ("y1", "y2")]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def lesser(first: Column, second: Column) -> Column:
    """By start, then end; y before x."""
    key = lambda e: F.struct(e["y1"], e["x1"], e["y2"], e["x2"])
    return F.when(key(first) <= key(second), first).otherwise(second)


def greater(first: Column, second: Column) -> Column:
    key = lambda e: F.struct(e["y1"], e["x1"], e["y2"], e["x2"])
    return F.when(key(first) <= key(second), second).otherwise(first)


# ---------------------------------------------------------------- polygons


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def polygon_edges(points: Column) -> Column:
    """The edges of a closed contour, in order."""
    return F.zip_with(points, _next(points), lambda a, b: edge(a["x"], a["y"], b["x"], b["y"]))


def area2(points: Column) -> Column:
    """Twice the signed area, positive for counter-clockwise contours."""
    return F.aggregate(polygon_edges(points), F.lit(0).cast("long"), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])


def contour_length(points: Column) -> Column:
    return F.aggregate(polygon_edges(points), F.lit(0).cast("long"), lambda s, e: s + length(e))


def is_rectilinear(points: Column) -> Column:
    return F.forall(polygon_edges(points), lambda e: (dx(e) == 0) | (dy(e) == 0))


def extent(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_rectangle(points: Column) -> Column:
    b = extent(points)
    return (F.size(points) == 4) & is_rectilinear(points) & (F.abs(area2(points)) == 2 * (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))


def corners(points: Column) -> Column:
    """For each vertex: x, y, the turn there (1 left, -1 right, 0 none) and whether it is a right angle."""
    edges = polygon_edges(points)
    before = F.concat(F.slice(edges, -1, 1), F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))))
    return F.zip_with(
        before, edges,
        lambda a, b: F.struct(b["x1"].alias("x"), b["y1"].alias("y"), sign(vprod(d(a), d(b))).alias("turn"), (sprod(d(a), d(b)) == 0).alias("right")),
    )


def transformed(points: Column, quarter: int = 0, mirror: bool = False, factor: int = 1, move: tuple[int, int] = (0, 0)) -> Column:
    """Mirrored at the x axis, turned left by quarters, scaled, moved."""

    def one(p: Column) -> Column:
        x, y = p["x"], -p["y"] if mirror else p["y"]
        for _ in range(quarter % 4):
            x, y = -y, x
        return point(x * factor + move[0], y * factor + move[1])

    return F.transform(points, one)


def snapped(points: Column, grid: int, mul: int = 1, div: int = 1) -> Column:
    """Vertices scaled by ``mul`` / ``div`` and moved to the nearest grid point; repeated vertices in a row stay one."""
    near = lambda c: (F.floor((2 * c * mul + grid * div) / F.lit(2 * grid * div)) * grid).cast("long")
    moved_ = F.transform(points, lambda p: point(near(p["x"]), near(p["y"])))
    return F.transform(F.filter(F.arrays_zip(moved_.alias("p"), _next(moved_).alias("q")), lambda z: z["p"] != z["q"]), lambda z: z["p"])


# ---------------------------------------------------------------- boxes, paths, texts


def box_contains(x0: Column, y0: Column, x1: Column, y1: Column, p: Column) -> Column:
    return (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1)


def box_center(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The middle, halves towards the lower left."""
    return point(F.floor((x0 + x1) / F.lit(2)), F.floor((y0 + y1) / F.lit(2)))


def path_length(points: Column, bgn_ext: Column | int = 0, end_ext: Column | int = 0) -> Column:
    """Length along the points, extensions included."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    legs = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), distance)
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x) + bgn_ext + end_ext


def path_area(points: Column, width: Column, bgn_ext: Column | int = 0, end_ext: Column | int = 0) -> Column:
    """Width times length."""
    return path_length(points, bgn_ext, end_ext) * width


def path_boxes(points: Column, width: Column) -> Column:
    """A box for each leg of an axis-parallel path, half the width around it at corners too."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    half = F.floor(width / F.lit(2)).cast("long")
    grown = lambda a, b: F.struct(
        (F.least(a["x"], b["x"]) - half).alias("x0"), (F.least(a["y"], b["y"]) - half).alias("y0"),
        (F.greatest(a["x"], b["x"]) + half).alias("x1"), (F.greatest(a["y"], b["y"]) + half).alias("y1"),
    )
    return F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), grown)


def text_box(p: Column, around: int = 1) -> Column:
    """The box that stands for a text as a polygon."""
    return F.struct((p["x"] - around).alias("x0"), (p["y"] - around).alias("y0"), (p["x"] + around).alias("x1"), (p["y"] + around).alias("y1"))


# ---------------------------------------------------------------- matrices


def matrix(mag_x: float, mag_y: float, angle: float, mirror: bool, shear: float = 0.0, dx_: float = 0.0, dy_: float = 0.0) -> Column:
    """Mirror at the x axis first, then scale, shear, turn, move; angles in degrees."""
    a, s = F.radians(F.lit(float(angle))), F.radians(F.lit(float(shear)))
    flip = -1.0 if mirror else 1.0
    c11, c12 = F.cos(s) * mag_x, F.sin(s) * mag_y * flip
    c21, c22 = F.sin(s) * mag_x, F.cos(s) * mag_y * flip
    return F.struct(
        (F.cos(a) * c11 - F.sin(a) * c21).alias("m11"), (F.cos(a) * c12 - F.sin(a) * c22).alias("m12"), (F.sin(a) * c11 + F.cos(a) * c21).alias("m21"),
        (F.sin(a) * c12 + F.cos(a) * c22).alias("m22"), F.lit(float(dx_)).alias("dx"), F.lit(float(dy_)).alias("dy"),
    )


def determinant(m: Column) -> Column:
    return m["m11"] * m["m22"] - m["m12"] * m["m21"]


def is_mirror(m: Column) -> Column:
    return determinant(m) < 0


def matrix_trans(m: Column, x: Column, y: Column) -> Column:
    """The point (x, y) under the matrix, in real numbers."""
    return F.struct((m["m11"] * x + m["m12"] * y + m["dx"]).alias("x"), (m["m21"] * x + m["m22"] * y + m["dy"]).alias("y"))


def matrix_inverted(m: Column) -> Column:
    n = determinant(m)
    a, b, c, e = m["m22"] / n, -m["m12"] / n, -m["m21"] / n, m["m11"] / n
    return F.struct(
        a.alias("m11"), b.alias("m12"), c.alias("m21"), e.alias("m22"), (-(a * m["dx"] + b * m["dy"])).alias("dx"), (-(c * m["dx"] + e * m["dy"])).alias("dy")
    )


def matrix_product(a: Column, b: Column) -> Column:
    """``b`` first, then ``a``."""
    moved_ = matrix_trans(a, b["dx"], b["dy"])
    return F.struct(
        (a["m11"] * b["m11"] + a["m12"] * b["m21"]).alias("m11"), (a["m11"] * b["m12"] + a["m12"] * b["m22"]).alias("m12"),
        (a["m21"] * b["m11"] + a["m22"] * b["m21"]).alias("m21"), (a["m21"] * b["m12"] + a["m22"] * b["m22"]).alias("m22"), moved_["x"].alias("dx"), moved_["y"].alias("dy"),
    )
