"""Counts of meeting boxes and their nets without listing pairs, on the lattice of whole coordinates.

Boxes with whole corners meet where they share a lattice point.  They are dealt
to square tiles of lattice points and each tile's rows come to a task as one
sorted stream: first the boxes that are drawn into its rasters, then those that
are looked up in them.  A task holds the rasters of one tile, however many boxes
meet there, and work grows with the boxes and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g

#: Lattice points at a tile's side.
SIDE = 128
#: The same where boxes inside others are looked up, and the widest of them that a raster there holds.
INNER_SIDE = INNER_WIDTH = 64
#: Most boxes that such a raster tells apart; asked for more, pairs are listed.
ENOUGH = 8


def dealt(df: DataFrame, last: int, *more: str) -> DataFrame:
    """Boxes by tile: (tx, ty, u0, v0, u1, v1, starts, many, *more), cut to the tile and counted from its corner.

    ``last`` is 0 where a box holds its upper border and 1 where it does not;
    ``starts`` has 1 for a box that begins in the tile along x and 2 along y.
    """
    x0, y0, x1, y1 = g.box()
    cell = lambda c: F.floor(c / SIDE).cast("int")
    many = (cell(x0) != cell(x1 - last)) | (cell(y0) != cell(y1 - last))
    df = df.select(*g.BOX, many.alias("many"), *more)
    df = df.withColumn("tx", F.explode(F.sequence(cell(x0), cell(x1 - last)))).withColumn("ty", F.explode(F.sequence(cell(y0), cell(y1 - last))))
    left, down = F.col("tx") * SIDE, F.col("ty") * SIDE
    inner = {"u0": F.greatest(x0 - left, F.lit(0)), "v0": F.greatest(y0 - down, F.lit(0)), "u1": F.least(x1 - last - left, F.lit(SIDE - 1)), "v1": F.least(y1 - last - down, F.lit(SIDE - 1))}
    starts = (x0 >= left).cast("int") + (y0 >= down).cast("int") * 2
    return df.select("tx", "ty", *[c.cast("short").alias(n) for n, c in inner.items()], starts.cast("short").alias("starts"), "many", *more)


def regular(last: int) -> Column:
    """Boxes that a lattice can hold: no corner missing, not turned inside out and, without their upper border, with area."""
    x0, y0, x1, y1 = g.box()
    return F.coalesce((x0 + last <= x1) & (y0 + last <= y1), F.lit(False))


def irregular(last: int) -> Column:
    x0, y0, x1, y1 = g.box()
    return ~regular(last) & x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()


def any_irregular(last: int, *tables: DataFrame) -> bool:
    found = [t.agg(F.max(irregular(last)).alias("odd")) for t in tables]
    both = found[0]
    for t in found[1:]:
        both = both.unionByName(t)
    return bool(both.agg(F.max("odd")).first()[0])


def streamed(rows: DataFrame, key: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """Each tile's rows, by ``kind`` in ascending order, through the ``take`` of a state of its own.

    ``take(kind, rows)``, and ``close()`` after the last one, give columns to return, or nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, was = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = np.zeros(batch.num_rows, bool)
            for c in (*key, "kind"):
                codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                cuts[1:] |= codes[1:] != codes[:-1]
            begins = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
            for low, high in zip(begins, begins[1:], strict=False):
                part = batch.slice(low, high - low)
                tile = tuple(part.column(c)[0].as_py() for c in key)
                if tile != was:
                    if state is not None and (out := state.close()) is not None:
                        yield out
                    state, was = make(), tile
                out = state.take(part.column("kind")[0].as_py(), part)
                if out is not None:
                    yield out
        if state is not None and (out := state.close()) is not None:
            yield out

    return rows.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(run, schema)


def _ints(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _raster(side: int = SIDE) -> np.ndarray:
    return np.zeros((side + 1, side + 1), np.int64)


def _add(raster: np.ndarray, v: np.ndarray, u: np.ndarray, by: int) -> None:
    np.add.at(raster.reshape(-1), v * raster.shape[1] + u, by)


def _cover(raster: np.ndarray, u0: np.ndarray, v0: np.ndarray, u1: np.ndarray, v1: np.ndarray) -> None:
    """Adds 1 to a raster of differences over u0..u1 and v0..v1; empty ranges add nothing."""
    for v, u, by in ((v0, u0, 1), (v0, u1 + 1, -1), (v1 + 1, u0, -1), (v1 + 1, u1 + 1, 1)):
        _add(raster, v, u, by)


def _sums(raster: np.ndarray) -> np.ndarray:
    return raster.cumsum(0).cumsum(1)


def _before(raster: np.ndarray, axis: int) -> np.ndarray:
    """Sums of all that comes before along an axis."""
    return np.cumsum(raster, axis) - raster


class _State:
    def close(self) -> pa.RecordBatch | None:
        return None


class _Meetings(_State):
    """How many drawn boxes a box meets, each counted in the tile and at the point where both have begun along x and y."""

    def __init__(self):
        self.drawn = self.ready = False

    def take(self, kind: int, part: pa.RecordBatch) -> pa.RecordBatch | None:
        u0, v0, u1, v1, starts = _ints(part, "u0", "v0", "u1", "v1", "starts")
        if kind == 0:
            if not self.drawn:
                self.drawn, self.here, self.along, self.up, self.corner = True, _raster(), _raster(), _raster(), _raster()
            x, y = starts & 1 > 0, starts & 2 > 0
            _cover(self.here, u0, v0, u1, v1)
            _add(self.along, v0[x], u0[x], 1)
            _add(self.along, v1[x] + 1, u0[x], -1)
            _add(self.up, v0[y], u0[y], 1)
            _add(self.up, v0[y], u1[y] + 1, -1)
            _add(self.corner, v0[x & y], u0[x & y], 1)
            return None
        if not self.drawn:
            return None
        if not self.ready:
            self.ready, self.here = True, _sums(self.here)
            self.along, self.up = _before(self.along.cumsum(0), 1), _before(self.up.cumsum(1), 0)
            self.corner = _before(_before(self.corner, 0), 1)
        x, y = starts & 1, starts >> 1
        lu, lv, hu, hv = u0 + x, v0 + y, u1 + 1, v1 + 1
        n = x * y * self.here[v0, u0] + y * (self.along[v0, hu] - self.along[v0, lu]) + x * (self.up[hv, u0] - self.up[lv, u0])
        n += self.corner[hv, hu] - self.corner[hv, lu] - self.corner[lv, hu] + self.corner[lv, lu]
        some = pa.array(n > 0)
        return pa.RecordBatch.from_arrays([part.column("id").filter(some), pa.array(n).filter(some)], names=["id", "n"])


def meetings(a: DataFrame, b: DataFrame, last: int, tag: str | None = None) -> DataFrame:
    """(id, n): for shapes of ``a`` with any, parts of the number of shapes in ``b`` that they meet; parts of one id add up.

    ``last`` is 0 to count common borders and 1 to count common area only;
    with ``tag`` only shapes with the same value of it count.
    """
    tags = [tag] if tag else []
    key = ["tx", "ty", *tags]
    a, b = (df.where(regular(last)).dropna(subset=tags) if tags else df.where(regular(last)) for df in (a, b))
    id_type = a.schema["id"].dataType
    drawn = dealt(b, last, *tags).withColumns({"kind": F.lit(0), "id": F.lit(None).cast(id_type)})
    asked = dealt(a, last, *tags, "id").withColumn("kind", F.lit(1))
    return streamed(drawn.unionByName(asked).drop("many"), key, _Meetings, f"id {id_type.simpleString()}, n long")


def _linked(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that links p to q tie each number to."""
    label = np.arange(n)
    while len(p):
        p, q = label[p], label[q]
        apart = p != q
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


class _Joints(_State):
    """Names the connected parts of the points at which boxes of both layers, or of one, lie.

    All boxes at such a point are one net, and so are all such points of one
    box.  Neighbours that a box holds are linked by rasters; a box with gaps
    between its points links them row by row.
    """

    def __init__(self, two: bool):
        self.cover, self.right, self.over = [_raster() for _ in range(1 + two)], _raster(), _raster()
        self.points = self.label = None
        self.links = np.zeros((0, 2), np.int64)

    def take(self, kind: int, part: pa.RecordBatch) -> pa.RecordBatch | None:
        box = _ints(part, "u0", "v0", "u1", "v1")
        u0, v0, u1, v1 = box
        if kind == 0:
            second = part.column("second").to_numpy(zero_copy_only=False)
            for raster, which in zip(self.cover, (~second, second) if len(self.cover) > 1 else (slice(None),), strict=True):
                _cover(raster, *[c[which] for c in box])
            _cover(self.right, u0, v0, u1 - 1, v1)
            _cover(self.over, u0, v0, u1, v1 - 1)
            return None
        if self.points is None:
            self.points = np.logical_and.reduce([_sums(c)[:SIDE, :SIDE] > 0 for c in self.cover])
            self.inner = np.zeros((SIDE + 1, SIDE + 1), np.int64)
            self.inner[1:, 1:] = self.points.cumsum(0).cumsum(1)
            at = np.where(self.points, np.arange(SIDE), SIDE)
            self.next = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1]
            self.reach = np.full((SIDE, SIDE), -1)
        held = self.inner[v1 + 1, u1 + 1] - self.inner[v1 + 1, u0] - self.inner[v0, u1 + 1] + self.inner[v0, u0]
        if kind == 1:
            gaps = (held > 0) & (held < (u1 - u0 + 1) * (v1 - v0 + 1))
            if gaps.any():
                which, row, first = self.rows(*[c[gaps] for c in box])
                np.maximum.at(self.reach, (row, first), u1[gaps][which])
                point = row * SIDE + first
                same = which[1:] == which[:-1]
                self.links = np.unique(np.concatenate([self.links, np.stack([point[:-1][same], point[1:][same]], 1)]), axis=0)
                if len(self.links) > 8 * SIDE * SIDE:
                    label = _linked(SIDE * SIDE, *self.links.T)
                    tied = np.flatnonzero(label != np.arange(SIDE * SIDE))
                    self.links = np.stack([tied, label[tied]], 1)
            return None
        hit = np.flatnonzero(held > 0)
        if not len(hit):
            return None
        if self.label is None:
            self.label = self.named()
        u, v = u0[hit], v0[hit]
        away = np.flatnonzero(~self.points[v, u])
        if len(away):
            which, row, first = self.rows(*[c[hit[away]] for c in box])
            begins = np.flatnonzero(np.diff(which, prepend=-1))
            u[away], v[away] = first[begins], row[begins]
        columns = [part.column(n).take(pa.array(hit)) for n in ("id", "many", "tx", "ty")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.label[v, u].astype(np.int32))], names=["id", "many", "tx", "ty", "k"])

    def rows(self, u0, v0, u1, v1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of a box with a point: which box, the row, and the first point."""
        high = v1 - v0 + 1
        which = np.repeat(np.arange(len(u0)), high)
        row = np.arange(len(which)) - np.repeat(np.cumsum(high) - high, high) + v0[which]
        first = self.next[row, u0[which]]
        held = first <= u1[which]
        return which[held], row[held], first[held]

    def named(self) -> np.ndarray:
        points = np.flatnonzero(self.points)
        row, col = points // SIDE, points % SIDE
        reach = np.maximum.accumulate(self.reach, 1)
        right, over = _sums(self.right)[:SIDE, :SIDE] > 0, _sums(self.over)[:SIDE, :SIDE] > 0
        tied = np.zeros(len(points), bool)
        tied[1:] = (row[1:] == row[:-1]) & ((reach[row[:-1], col[:-1]] >= col[1:]) | ((col[1:] == col[:-1] + 1) & right[row[:-1], col[:-1]]))
        run = np.full(SIDE * SIDE, -1)
        run[points] = np.cumsum(~tied) - 1
        low = np.flatnonzero((self.points[:-1] & self.points[1:] & over[:-1]).reshape(-1))
        links = np.concatenate([np.stack([run[low], run[low + SIDE]], 1), run[self.links]])
        label = _linked(int(run.max()) + 1, *np.unique(links, axis=0).T)
        return np.where(run >= 0, label[run], -1).reshape(SIDE, SIDE)


def joints(first: DataFrame, second: DataFrame | None) -> DataFrame:
    """(id, many, tx, ty, k): the joints of each shape, at least one for each tile in which it touches a shape of the other layer.

    Shapes with a joint in common are one net.  ``many`` tells that a shape
    meets several tiles.  Without ``second`` a layer is joined within itself,
    and every shape has a joint.
    """
    two = second is not None
    both = first.where(regular(0)).select("id", *g.BOX, F.lit(False).alias("second"))
    if two:
        both = both.unionByName(second.where(regular(0)).select("id", *g.BOX, F.lit(True).alias("second")))
    id_type = first.schema["id"].dataType
    boxes = dealt(both, 0, "second", "id").drop("starts")
    drawn = boxes.withColumn("id", F.lit(None).cast(id_type))
    rows = boxes.withColumn("kind", F.lit(2)).unionByName(drawn.withColumn("kind", F.lit(0)))
    if two:
        rows = rows.unionByName(drawn.withColumn("kind", F.lit(1)))
    return streamed(rows, ["tx", "ty"], lambda: _Joints(two), f"id {id_type.simpleString()}, many boolean, tx int, ty int, k int")


class _Wraps(_State):
    """How often two sides cover the unit cells of a tile, as runs of rows that are alike."""

    def __init__(self, key: list[str], size: int, rim: int, present: bool):
        self.key, self.size, self.rim, self.present = key, size, rim, present
        self.cover = [_raster(size + 2 * rim) for _ in "ab"]

    def take(self, kind: int, part: pa.RecordBatch) -> None:
        x0, y0, x1, y1 = _ints(part, *g.BOX)
        self.tile = [part.column(c)[0] for c in self.key]
        self.left, self.down = (part.column(c)[0].as_py() * self.size - self.rim for c in ("tx", "ty"))
        _cover(self.cover[kind], x0 - self.left, y0 - self.down, x1 - 1 - self.left, y1 - 1 - self.down)

    def close(self) -> pa.RecordBatch | None:
        full = self.size + 2 * self.rim
        both = np.stack([_sums(c)[:full, :full] for c in self.cover])
        if self.present:
            both = (both > 0).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any((0, 2))]))
        tops = np.append(begins[1:], full)
        both = both[:, begins]
        fresh = np.ones(both.shape[1:], bool)
        fresh[:, 1:] = (both[:, :, 1:] != both[:, :, :-1]).any(0)
        row, x0 = np.nonzero(fresh)
        last = np.append(row[1:] != row[:-1], True)
        x1 = np.where(last, full, np.append(x0[1:], full))
        a, b = both[:, row, x0]
        # what is free at the left and right of all boxes is no run
        some = np.flatnonzero((a > 0) | (b > 0) | ((x0 > 0) & ~last))
        if not len(some):
            return None
        row, x0, x1, a, b = (c[some] for c in (row, x0, x1, a, b))
        columns = {"y": begins[row] + self.down, "top": tops[row] + self.down, "x0": x0 + self.left, "x1": x1 + self.left, "a": a, "b": b}
        tile = [pa.array([value.as_py()], value.type).take(pa.array(np.zeros(len(some), np.int64))) for value in self.tile]
        return pa.RecordBatch.from_arrays([*tile, *[pa.array(c) for c in columns.values()]], names=[*self.key, *columns])


def wraps(boxes: DataFrame, tile: list[str], size: int, rim: int, present: bool) -> DataFrame:
    """(*tile, y, top, x0, x1, a, b): runs x0..x1 of slabs y..top of a tile that boxes of ``side`` a and b cover equally often.

    Boxes lie within their tile (tx, ty) grown by ``rim``; with ``present``
    the counts are 0 or 1.  Free runs between covered ones come as well.
    """
    boxes = boxes.dropna(subset=tile).select(*tile, *g.BOX, F.when(F.col("side") == "a", 0).when(F.col("side") == "b", 1).alias("kind")).where("kind IS NOT NULL AND x1 > x0 AND y1 > y0")
    types = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = [f"{c} {types[c]}" for c in tile] + [f"{c} long" for c in ("y", "top", "x0", "x1", "a", "b")]
    found = streamed(boxes, tile, lambda: _Wraps(tile, size, rim, present), ", ".join(schema))
    return found.withColumns({c: F.col(c).cast(types[of]) for c, of in (("y", "y0"), ("top", "y0"), ("x0", "x0"), ("x1", "x0"))})


def narrow() -> Column:
    x0, _, x1, _ = g.box()
    return x1 - x0 <= INNER_WIDTH


def _fewest(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    """The least len(p) of each two ascending lists, ascending."""
    low = [np.minimum(a, b) for a, b in zip(p, reversed(q), strict=True)]
    for upto in range(len(low) - 1, 0, -1):
        for k in range(upto):
            low[k], low[k + 1] = np.minimum(low[k], low[k + 1]), np.maximum(low[k], low[k + 1])
    return low


class _Inners(_State):
    """How many drawn boxes lie inside a box, of those that begin in the tile; ``enough`` or more count as ``enough``.

    A few boxes are compared one by one.  For more, ``tops[k]`` holds for each
    corner and right border the k-th lowest upper border of the boxes that begin
    there or further up and right, and end there or further left.
    """

    FEW = 1024
    NONE = np.iinfo(np.int32).max

    def __init__(self, enough: int):
        self.enough, self.held, self.tops, self.ready = enough, [], None, False

    def take(self, kind: int, part: pa.RecordBatch) -> pa.RecordBatch | None:
        u, v, x1, y1 = _ints(part, "u", "v", "x1", "y1")
        w = np.minimum(x1 - part.column("tx")[0].as_py() * INNER_SIDE, INNER_SIDE + INNER_WIDTH)
        if kind == 0:
            if self.tops is None:
                self.held.append(np.stack([u, v, w, y1]))
                if sum(h.shape[1] for h in self.held) <= self.FEW:
                    return None
                u, v, w, y1 = np.concatenate(self.held, 1)
                self.held, self.tops = [], np.full((self.enough, INNER_SIDE, INNER_SIDE, INNER_SIDE + INNER_WIDTH + 1), self.NONE, np.int32)
            self.draw(u, v, w, y1)
            return None
        if self.tops is not None:
            if not self.ready:
                self.ready = True
                self.spread()
            n = (self.tops[:, u, v, w] <= y1).sum(0)
        elif self.held:
            self.held = [np.concatenate(self.held, 1)]
            own = [c[:, None] for c in self.held[0].astype(np.int32)]
            n = np.zeros(len(u), np.int64)
            for k in range(0, len(u), self.FEW):
                s = slice(k, k + self.FEW)
                n[s] = ((own[0] >= u[s].astype(np.int32)) & (own[1] >= v[s].astype(np.int32)) & (own[2] <= w[s].astype(np.int32)) & (own[3] <= y1[s].astype(np.int32))).sum(0)
            n = np.minimum(n, self.enough)
        else:
            return None
        some = pa.array(n > 0)
        return pa.RecordBatch.from_arrays([part.column("id").filter(some), pa.array(n.astype(np.int64)).filter(some)], names=["id", "n"])

    def draw(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, y1: np.ndarray) -> None:
        flat = self.tops.reshape(self.enough, -1)
        at = (u * self.tops.shape[2] + v) * self.tops.shape[3] + w
        order = np.lexsort((y1, at))
        at, y1 = at[order], y1[order]
        places, first, group = np.unique(at, return_index=True, return_inverse=True)
        rank = np.arange(len(at)) - first[group]
        few = rank < self.enough
        fresh = np.full((self.enough, len(places)), self.NONE, np.int32)
        fresh[rank[few], group[few]] = y1[few]
        flat[:, places] = _fewest(list(flat[:, places]), list(fresh))

    def spread(self) -> None:
        for axis, back in ((1, True), (2, True), (3, False)):
            lines = np.moveaxis(self.tops, axis, 0)
            lines = lines[::-1] if back else lines
            for before, line in zip(lines[:-1], lines[1:], strict=True):
                line[...] = _fewest(list(line), list(before))


def inners(a: DataFrame, b: DataFrame, enough: int) -> DataFrame:
    """(id, n): for shapes of ``a`` with any, parts of the number of narrow shapes in ``b`` inside them; parts of one id add up.

    Sums under ``enough`` are exact, others are at least that.
    """
    x0, y0, x1, y1 = g.box()
    cell = lambda c: F.floor(c / INNER_SIDE).cast("int")
    inner = lambda c, of: F.greatest(c - F.col(of) * INNER_SIDE, F.lit(0)).cast("short")
    id_type = a.schema["id"].dataType
    drawn = b.where(regular(0) & narrow()).select(F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), *g.BOX, cell(x0).alias("tx"), cell(y0).alias("ty"))
    asked = a.where(regular(0)).select(F.lit(1).alias("kind"), "id", *g.BOX).withColumn("tx", F.explode(F.sequence(cell(x0), cell(x1)))).withColumn("ty", F.explode(F.sequence(cell(y0), cell(y1))))
    rows = drawn.unionByName(asked).select("kind", "id", "tx", "ty", inner(x0, "tx").alias("u"), inner(y0, "ty").alias("v"), "x1", "y1")
    return streamed(rows, ["tx", "ty"], lambda: _Inners(enough), f"id {id_type.simpleString()}, n long")


class _Hands(_State):
    """How much of a level or upright edge has drawn cells at both hands, at one, and at none."""

    def __init__(self):
        self.cells, self.sums = _raster(SIDE + 1), None

    def take(self, kind: int, part: pa.RecordBatch) -> pa.RecordBatch | None:
        u0, v0, u1, v1 = _ints(part, "u0", "v0", "u1", "v1")
        if kind == 0:
            _cover(self.cells, u0, v0, u1, v1)
            return None
        if self.sums is None:
            cells = (_sums(self.cells)[: SIDE + 1, : SIDE + 1] > 0).astype(np.int64)
            self.sums = []
            for axis, one, other in ((1, cells[1:, 1:], cells[:-1, 1:]), (0, cells[1:, 1:], cells[1:, :-1])):
                self.sums.append([np.pad(c.cumsum(axis), ((axis == 0, 0), (axis == 1, 0))) for c in (one & other, one ^ other)])
        level = v0 == v1
        both, single = (np.zeros(len(u0), np.int64) for _ in "ab")
        for which, sums in ((level, self.sums[0]), (~level, self.sums[1])):
            for found, c in zip((both, single), sums, strict=True):
                found[which] = c[v1[which], u1[which]] - c[v0[which], u0[which]]
        names = [n for n in part.schema.names if n not in ("kind", "tx", "ty", "u0", "v0", "u1", "v1")]
        counts = {"inside": both, "border": single, "outside": u1 - u0 + v1 - v0 - both - single}
        return pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *[pa.array(c) for c in counts.values()]], names=[*names, *counts])


def hands(edges: DataFrame, boxes: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """(*tags, id, inside, border, outside): parts of the lengths of whole level or upright edges (*tags, id, x0, y0, x1, y1) against boxes (*tags, x0, y0, x1, y1) taken as one region; those of one edge add up."""
    x0, y0, x1, y1 = g.box()
    cell = lambda c: F.floor(c / SIDE).cast("int")
    cells = lambda low, high: F.explode(F.sequence(cell(low), cell(high)))
    left, down = F.col("tx") * SIDE, F.col("ty") * SIDE
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    # a tile's cells, and those left of and below it
    drawn = boxes.where("x1 > x0 AND y1 > y0").withColumn("tx", cells(x0, x1)).withColumn("ty", cells(y0, y1))
    near = {"u0": F.greatest(x0 - left + 1, F.lit(0)), "v0": F.greatest(y0 - down + 1, F.lit(0)), "u1": F.least(x1 - left, F.lit(SIDE)), "v1": F.least(y1 - down, F.lit(SIDE))}
    drawn = drawn.select(*tags, F.lit(None).cast(kinds["id"]).alias("id"), F.lit(0).alias("kind"), "tx", "ty", *[c.cast("short").alias(n) for n, c in near.items()])
    asked = edges.where("(x1 > x0) <> (y1 > y0)").withColumn("tx", cells(x0, F.greatest(x0, x1 - 1))).withColumn("ty", cells(y0, F.greatest(y0, y1 - 1)))
    own = {"u0": F.greatest(x0 - left, F.lit(0)), "v0": F.greatest(y0 - down, F.lit(0)), "u1": F.least(x1 - left, F.lit(SIDE)), "v1": F.least(y1 - down, F.lit(SIDE))}
    asked = asked.select(*tags, "id", F.lit(1).alias("kind"), "tx", "ty", *[c.cast("short").alias(n) for n, c in own.items()])
    schema = [*[f"{c} {kinds[c].simpleString()}" for c in (*tags, "id")], *[f"{c} long" for c in ("inside", "border", "outside")]]
    return streamed(drawn.unionByName(asked), [*tags, "tx", "ty"], _Hands, ", ".join(schema))


class _Windings(_State):
    """How many points of a tile lie inside polygons of which kinds: windings are summed along rows of points, whatever polygons cross there."""

    #: Rows of edges taken at a time.
    ROWS = 1 << 20

    def __init__(self, dx: float, dy: float):
        self.dx, self.dy, self.kind = dx, dy, None
        self.inside = np.zeros((SIDE, SIDE), np.int64)

    def take(self, kind: int, part: pa.RecordBatch) -> None:
        if kind != self.kind:
            self.finish()
            self.kind, self.gains = kind, _raster()
        self.tile = [part.column(c)[0].as_py() for c in ("tx", "ty")]
        lists = part.column("pts")
        n = np.diff(lists.offsets.to_numpy()) // 2
        points = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 2)
        n, hole = n[n > 0], part.column("hole").to_numpy(zero_copy_only=False)[n > 0]
        if not len(n):
            return
        after = np.arange(1, len(points) + 1)
        begins = np.cumsum(n) - n
        after[begins + n - 1] = begins
        x, y = points.T
        clockwise = np.add.reduceat(x * y[after] - x[after] * y, begins) <= 0
        turn = np.repeat(np.where(clockwise != hole, 1, -1), n)
        rising = y < y[after]
        low, high = (np.where((rising == first)[:, None], points, points[after]) for first in (True, False))
        first, last = (np.clip(np.ceil(c[:, 1] - self.dy) - self.tile[1] * SIDE, 0, SIDE).astype(np.int64) for c in (low, high))
        rows = last - first
        upto = np.cumsum(rows)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + self.ROWS, self.ROWS)))
        for some in map(slice, cuts, [*cuts[1:], len(rows)]):
            self.gain(low[some], high[some], first[some], rows[some], np.where(rising, turn, -turn)[some])

    def gain(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, rows: np.ndarray, by: np.ndarray) -> None:
        """Adds what windings gain at the right of edges, at the first point of each row there."""
        edge = np.repeat(np.arange(len(rows)), rows)
        row = np.arange(len(edge)) - (np.cumsum(rows) - rows - first)[edge]
        slope = (high[:, 0] - low[:, 0]) / np.where(rows > 0, high[:, 1] - low[:, 1], 1)
        x = low[edge, 0] + (row + (self.tile[1] * SIDE + self.dy) - low[edge, 1]) * slope[edge]
        at = np.clip(np.ceil(x - self.dx) - self.tile[0] * SIDE, 0, SIDE).astype(np.int64)
        _add(self.gains, row, at, by[edge])

    def finish(self) -> None:
        if self.kind is not None:
            self.inside |= (self.gains.cumsum(1)[:SIDE, :SIDE] != 0).astype(np.int64) << self.kind

    def close(self) -> pa.RecordBatch | None:
        self.finish()
        found, n = np.unique(self.inside, return_counts=True)
        tile = [np.full(len(found), c, np.int64) for c in self.tile]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*tile, found, n.astype(np.int64))], names=["tx", "ty", "inside", "n"])


def points_inside(polygons: DataFrame, kinds: int, dx: float, dy: float) -> DataFrame:
    """(tx, ty, inside, n): how many points (i + dx, j + dy) of whole i, j of a tile lie inside polygons (kind, pts[, holes]) of the same kinds.

    Bit k of ``inside`` is set where the winding number of kind k, of 0 to
    ``kinds`` - 1 and at most 62, is not 0.  Directions of contours do not matter, nor do
    the number of polygons at a point and the crossings of their edges: work
    grows with the rows that edges meet.  Tiles that no polygon meets are left out.
    """
    known = polygons.where(F.col("kind").between(0, kinds - 1)).withColumn("kind", F.col("kind").cast("int"))
    if "holes" in polygons.columns:
        contour = lambda pts, hole: F.struct(pts.alias("pts"), F.lit(hole).alias("hole"))
        contours = F.array(contour(F.col("pts"), False))
        contours = F.concat(contours, F.coalesce(F.transform("holes", lambda h: contour(h, True)), F.slice(contours, 1, 0)))
        known = known.select("kind", F.inline(contours))
    else:
        known = known.select("kind", "pts", F.lit(False).alias("hole"))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("pts")), 0))
            if not batch.num_rows:
                continue
            corners = batch.column("pts").flatten()
            n = np.diff(batch.column("pts").offsets.to_numpy())
            begins = np.cumsum(n) - n
            corners = [corners.field(corners.type.get_field_index(c)) for c in "xy"]
            low, many = [], []
            for c, d in zip(corners, (dx, dy), strict=True):
                c = np.ceil(c.to_numpy(zero_copy_only=False) - d)
                low.append(np.floor_divide(np.minimum.reduceat(c, begins), SIDE))
                # closed contours: what begins and ends before the same point holds none
                some = np.maximum.reduceat(c, begins) > np.minimum.reduceat(c, begins)
                many.append(np.where(some, np.floor_divide(np.maximum.reduceat(c, begins) - 1, SIDE) - low[-1] + 1, 0).astype(np.int64))
            tiles = many[0] * many[1]
            which = np.repeat(np.arange(len(n)), tiles)
            at = np.arange(len(which)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            tx, ty = low[0][which] + at % many[0][which], low[1][which] + at // many[0][which]
            places = 2 * np.arange(len(corners[0]))
            flat = pa.concat_arrays(corners).take(pa.array(np.argsort(np.concatenate([places, places + 1]), kind="stable")))
            pts = pa.ListArray.from_arrays(pa.array(np.append(begins, len(places)).astype(np.int32) * 2), flat)
            columns = [pa.array(tx.astype(np.int32)), pa.array(ty.astype(np.int32)), *[c.take(pa.array(which)) for c in (batch.column("kind"), batch.column("hole"), pts)]]
            yield pa.RecordBatch.from_arrays(columns, names=["tx", "ty", "kind", "hole", "pts"])

    number = polygons.schema["pts"].dataType.elementType["x"].dataType.simpleString()
    rows = known.mapInArrow(dealt, f"tx int, ty int, kind int, hole boolean, pts array<{number}>")
    return streamed(rows, ["tx", "ty"], lambda: _Windings(dx, dy), "tx long, ty long, inside long, n long")
