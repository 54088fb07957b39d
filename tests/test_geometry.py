"""Literal micro-cases of the geometry functions and operators."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import connectivity, hierarchy, netlist, spatial, sweep


def boxes(spark, *rows):
    return spark.createDataFrame([(f"s{k}", *r) for k, r in enumerate(rows)], "id string, x0 int, y0 int, x1 int, y1 int")


def test_units():
    assert g.to_dbu("1um", 0.05) == 20
    assert g.to_dbu("1um2", 0.05) == 400
    assert g.to_dbu("1mm", 0.05) == 20000
    assert g.to_dbu("50nm", 0.05) == 1
    with pytest.raises(ValueError):
        g.to_dbu("60nm", 0.05)


def test_glob():
    import re

    assert re.match(g.glob_regex("a*[0-9]{x,y}?"), "abc7yz")
    assert not re.match(g.glob_regex("a.c"), "abc")


def test_merge_of_two_overlapping_boxes(spark):
    a = boxes(spark, (0, 100, 200, 300), (50, 150, 250, 350))
    assert sweep.runs(a, None, "or", 1 << 20).agg(F.sum(g.area())).first()[0] == 2 * 40000 - 150 * 150
    assert sweep.area_by_tile(a, None, "or", 64).agg(F.sum("area")).first()[0] == 57500
    assert sweep.area_by_tile(a, None, F.col("a") >= 2, 64).agg(F.sum("area")).first()[0] == 22500


def test_touching_counts_as_interaction_but_not_as_overlap(spark):
    a, b = boxes(spark, (0, 0, 10, 10)), boxes(spark, (10, 0, 20, 10))
    assert spatial.selected(a, b, "interacting").count() == 1
    assert spatial.selected(a, b, "overlapping").count() == 0
    assert spatial.selected(boxes(spark, (11, 0, 20, 5)), a, "interacting").count() == 0


def test_shared_border_is_inside(spark):
    a, b = boxes(spark, (0, 0, 10, 5)), boxes(spark, (0, 0, 10, 10))
    assert spatial.selected(a, b, "inside").count() == 1
    assert spatial.selected(b, a, "covering").count() == 1


def test_inside_two_abutting_boxes(spark):
    a, b = boxes(spark, (2, 2, 14, 3), (2, 2, 21, 3), (30, 0, 31, 1)), boxes(spark, (0, 0, 10, 10), (10, 0, 20, 10), (0, 0, 10, 10))
    corner = lambda df: sorted(tuple(r) for r in df.select("x0", "x1").collect())
    assert corner(spatial.selected_inside(a, b)) == [(2, 14)]
    assert corner(spatial.selected_inside(a, b, invert=True)) == [(2, 21), (30, 31)]


def test_pair_in_many_bins_counts_once(spark):
    a, b = boxes(spark, (-500, -500, 500, 500)), boxes(spark, (-400, -400, 400, 400))
    assert spatial.spatial_join(a, b, g.touches("a", "b"), 0, 64).count() == 1


def test_space_is_strict(spark):
    a = boxes(spark, (0, 0, 10, 10), (14, 0, 20, 10), (0, 13, 10, 20))
    found = {(r["gap"], r["axis"]) for r in spatial.space_pairs(a, a, 4, same=True).collect()}
    assert found == {(3, "y")}


def test_snap_and_rotate(spark):
    a = boxes(spark, (2, -3, 13, 8))
    row = a.select(g.snapped(F.col("x0"), 5).alias("p"), g.snapped(F.col("y0"), 5).alias("q"), g.snapped(F.col("x1"), 5).alias("r")).first()
    assert tuple(row) == (0, -5, 15)
    assert tuple(a.select(*g.rotated(1)).first()) == (-8, 2, 3, 13)
    assert tuple(a.select(*g.rotated(0, mirror=True)).first()) == (2, -8, 13, 3)


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(k,) for k in range(40)], "id long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long")
    nets = {r["id"]: r["net"] for r in connectivity.components(nodes, edges).collect()}
    assert all(nets[k] == 0 for k in range(31)) and all(nets[k] == k for k in range(31, 40))


def test_components_of_a_shuffled_chain_take_few_rounds(spark, monkeypatch):
    import random

    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    tables, inner = [], connectivity.staged

    def counted(*args):
        tables.append(1)
        return inner(*args)

    monkeypatch.setattr(connectivity, "staged", counted)
    roots = connectivity.spanning_stars(edges)
    assert roots.where("root <> 0").count() == 0 and roots.count() == 9999
    assert len(tables) <= 40  # two a round


def test_weights_multiply_along_paths(spark):
    tops = spark.createDataFrame([("top",)], "cell string")
    inst = spark.createDataFrame([("top", "mid"), ("top", "mid"), ("mid", "leaf"), ("mid", "leaf"), ("mid", "leaf"), ("top", "leaf")], "parent string, child string")
    got = {(r["cell"], r["level"]): r["weight"] for r in hierarchy.total_weights(tops, inst, 2).collect()}
    assert got == {("top", 0): 1, ("mid", 1): 2, ("leaf", 1): 1, ("leaf", 2): 6}


def test_empty_inputs(spark):
    none = boxes(spark, (0, 0, 1, 1)).where("x0 > 5")
    one = boxes(spark, (0, 0, 1, 1))
    assert spatial.selected(one, none, "interacting", invert=True).count() == 1
    assert sweep.runs(none, one, "and").count() == 0
    assert sweep.runs(one, none, "not").count() == 1


def test_compare_statuses(spark):
    a = spark.createDataFrame([("p", 5), ("q", 9), ("r", 1)], "net string, n int")
    b = spark.createDataFrame([("p", 6), ("q", 2), ("s", 1)], "net string, n int")
    got = {r["net"]: r["status"] for r in netlist.compare(a, b, "net", ["n"], 1).collect()}
    assert got == {"p": "Match", "q": "Mismatch", "r": "NoMatch", "s": "NoMatch"}


def test_cut_lines_give_the_same_runs(spark):
    rng = random.Random(5)
    rows = [(None if k % 9 == 0 else k % 3, "ab"[k % 2], t := rng.randrange(-200, 400), t + rng.randrange(0, 90)) for k in range(90)]
    edges = spark.createDataFrame(rows, "line long, layer string, t0 long, t1 long")
    for keep in sweep.OPERATIONS:
        whole, cut = (sorted(map(repr, sweep.line_runs(edges, F.col("layer") == "a", F.col("layer") == "b", keep, span).collect())) for span in (None, 50))
        assert whole == cut and whole


def _close(a, b, distance, same):
    """Pairs by comparing all rows, as the SQL of the space checks does."""
    found = []
    for i, ax0, ay0, ax1, ay1 in a:
        for j, bx0, by0, bx1, by1 in b:
            gap_x, gap_y = max(bx0 - ax1, ax0 - bx1), max(by0 - ay1, ay0 - by1)
            beside, above = 0 < gap_x < distance and ay0 < by1 and by0 < ay1, 0 < gap_y < distance and ax0 < bx1 and bx0 < ax1
            if (beside or above) and (not same or (i is not None and j is not None and i < j)):
                found.append((i, j, gap_x if beside else gap_y, "x" if beside else "y"))
    return sorted(found, key=repr)


@pytest.mark.parametrize("dealt", [1 << 15, 3])
def test_space_pairs_of_boxes_at_one_place(spark, monkeypatch, dealt):
    """Many rows of one box, repeated rows, an id of several boxes, null ids; bins within their limit, and dealt to several tasks."""
    rnd = random.Random(7)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in ((rnd.randrange(200), rnd.randrange(60), rnd.randrange(1, 30), rnd.randrange(1, 9)) for _ in range(25))]
    sides = [[(f"{name}{k}", *rnd.choice(boxes)) for k in range(120)] for name in "ba"]
    sides[0] += [sides[0][0], sides[0][0], ("b1", *boxes[3]), (None, *boxes[4]), (None, *boxes[5]), ("a7", *boxes[6])]
    monkeypatch.setattr(spatial, "DEALT", dealt)
    a, b = (spark.createDataFrame(s, "id string, x0 int, y0 int, x1 int, y1 int") for s in sides)
    for left, right, rows, same in ((a, b, sides, False), (b, a, sides[::-1], False), (a, a, [sides[0]] * 2, True)):
        want = _close(*rows, 4, same)
        assert len(want) > 50 and sorted(map(tuple, spatial.space_pairs(left, right, 4, same).collect()), key=repr) == want


def test_space_pairs_take_little_room(spark, tmp_path):
    """Pairs grow with the square of the copies; what is written of each must stay small."""
    copies = lambda kind, x0, x1: spark.range(60_000).selectExpr(f"concat_ws('-', '{kind}', md5(string(id))) AS id", f"int(id % 3000 * 100 + {x0}) AS x0", "0 AS y0", f"int(id % 3000 * 100 + {x1}) AS x1", "5 AS y1")
    pairs = spatial.space_pairs(copies("a", 0, 10), copies("b", 12, 20), 4, same=False)
    pairs.write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 3000 * 20 * 20
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 10e6
