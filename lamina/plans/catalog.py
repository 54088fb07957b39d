"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry as g
from lamina.operators import connectivity, hierarchy, netlist, spatial, sweep
from lamina.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lamina.plans.views import SEGMENTS_SQL, SPAN, layer, read, rects, segments

BOXES = ["x0", "y0", "x1", "y1"]

# ---------------------------------------------------------------- layout query, hierarchy


@query(
    """@owned AS (SELECT n_name, r_name, x0, y0, x1, y1 FROM rects JOIN orders ON CAST(split_part(id, '-', 1) AS BIGINT) = o_orderkey
         JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
       SELECT cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
       FROM (SELECT n_name AS cell, x0, y0, x1, y1 FROM owned UNION ALL SELECT r_name, x0, y0, x1, y1 FROM owned) GROUP BY cell"""
)
def lq_select_cell_bbox(spark, sf):
    shapes = rects(spark, sf).withColumn("o_orderkey", F.split("id", "-")[0].cast("long"))
    owned = shapes.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    owned = owned.join(read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
    owned = owned.join(read(spark, sf, "nation"), "n_nationkey").join(read(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return hierarchy.cell_boxes(owned, "n_name", "r_name")


@query(
    """SELECT r_name AS top, 1 AS level, count(DISTINCT n_nationkey) AS cells, count(DISTINCT n_nationkey) AS weight FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1
       UNION ALL SELECT r_name, 2, count(*), count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
       UNION ALL SELECT r_name, 3, count(*), count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    views="",
)
def lq_tot_weight(spark, sf):
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    region, nation = read(spark, sf, "region"), read(spark, sf, "nation")
    instances = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), name("nation", "n_nationkey").alias("child"))
    instances = instances.unionByName(read(spark, sf, "customer").select(name("nation", "c_nationkey").alias("parent"), name("customer", "c_custkey").alias("child")))
    instances = instances.unionByName(read(spark, sf, "orders").select(name("customer", "o_custkey").alias("parent"), name("order", "o_orderkey").alias("child")))
    found = hierarchy.total_weights(region.select(F.col("r_name").alias("cell")), instances, 3).where("level > 0")
    return found.groupBy("top", "level").agg(F.count("*").alias("cells"), F.sum("weight").alias("weight"))


# ---------------------------------------------------------------- basics and filters


@query("SELECT layer, count(*) AS shapes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rects GROUP BY layer")
def rg_count_bbox(spark, sf):
    return rects(spark, sf).groupBy("layer").agg(F.count("*").alias("shapes"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("SELECT id, layer FROM rects WHERE layer = 'A' UNION ALL SELECT id, layer FROM rects WHERE layer = 'R'")
def rg_add(spark, sf):
    return layer(spark, sf, "A").unionByName(layer(spark, sf, "R")).select("id", "layer")


@query("SELECT id, CAST(x1 - x0 AS BIGINT) * (y1 - y0) AS area FROM rects WHERE CAST(x1 - x0 AS BIGINT) * (y1 - y0) >= 100 AND CAST(x1 - x0 AS BIGINT) * (y1 - y0) < 300")
def flt_area(spark, sf):
    return rects(spark, sf).select("id", g.area().alias("area")).where("area >= 100 AND area < 300")


@query("SELECT id, CAST(2 * ((x1 - x0) + (y1 - y0)) AS BIGINT) AS perimeter FROM rects WHERE 2 * ((x1 - x0) + (y1 - y0)) >= 40 AND 2 * ((x1 - x0) + (y1 - y0)) < 80")
def flt_perimeter(spark, sf):
    return rects(spark, sf).select("id", g.perimeter().alias("perimeter")).where("perimeter >= 40 AND perimeter < 80")


@query("SELECT id FROM rects WHERE greatest(x1 - x0, y1 - y0) >= 2 * least(x1 - x0, y1 - y0)")
def flt_bbox_ratio(spark, sf):
    return rects(spark, sf).where(F.greatest(g.width(), g.height()) >= 2 * F.least(g.width(), g.height())).select("id")


@query("SELECT id FROM rects WHERE x1 - x0 = y1 - y0")
def flt_squares(spark, sf):
    return rects(spark, sf).where(g.width() == g.height()).select("id")


@query("SELECT line, t0, t1 FROM segments WHERE t1 - t0 >= 600 AND t1 - t0 < 86400", views=SEGMENTS_SQL)
def flt_edge_length(spark, sf):
    return segments(spark, sf).where("t1 - t0 >= 600 AND t1 - t0 < 86400").select("line", "t0", "t1")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'Part%1_' OR p_brand LIKE '%#2%'", views="")
def flt_text_glob(spark, sf):
    return read(spark, sf, "part").where(g.matches_glob(F.col("p_name"), "Part*1?") | g.matches_glob(F.col("p_brand"), "*#2*")).select("p_partkey", "p_name")


# ---------------------------------------------------------------- selections

_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_OVER = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_COVER = "b.x0 >= a.x0 AND b.x1 <= a.x1 AND b.y0 >= a.y0 AND b.y1 <= a.y1"


def _pair(on: str) -> str:
    return f"@ra AS (SELECT * FROM rects WHERE layer = 'A'), rb AS (SELECT * FROM rects WHERE layer = 'R'), hits AS (SELECT a.id AS a, b.id AS b, a.pid AS pa, b.pid AS pb FROM ra a JOIN rb b ON {on})"


@query(_pair(_MEET) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits)")
def rg_interacting(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting").select("id")


@query(_pair(_MEET) + " SELECT id FROM ra WHERE id NOT IN (SELECT a FROM hits)")
def rg_not_interacting(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting", invert=True).select("id")


@query(_pair(_MEET) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits GROUP BY a HAVING count(DISTINCT b) BETWEEN 2 AND 3)")
def rg_interacting_count(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting", 2, 3).select("id")


@query(_pair(_OVER) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits)")
def rg_overlapping(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "overlapping").select("id")


_COVERED_CELLS = """@ra AS (SELECT * FROM rects WHERE layer = 'A'), own AS (SELECT id, x, unnest(range(y0, y1)) AS y FROM (SELECT id, y0, y1, unnest(range(x0, x1)) AS x FROM ra)),
  cells AS (SELECT DISTINCT x, unnest(range(y0, y1)) AS y FROM (SELECT y0, y1, unnest(range(x0, x1)) AS x FROM rects WHERE layer = 'R')),
  uncovered AS (SELECT DISTINCT id FROM own ANTI JOIN cells USING (x, y))"""


@query(_COVERED_CELLS + " SELECT id FROM ra WHERE id NOT IN (SELECT id FROM uncovered)")
def rg_inside(spark, sf):
    return spatial.selected_inside(layer(spark, sf, "A"), layer(spark, sf, "R")).select("id")


@query(_COVERED_CELLS + " SELECT id FROM ra WHERE id IN (SELECT id FROM uncovered)")
def rg_not_inside(spark, sf):
    return spatial.selected_inside(layer(spark, sf, "A"), layer(spark, sf, "R"), invert=True).select("id")


@query(_pair(_OVER) + " SELECT id FROM ra WHERE id NOT IN (SELECT a FROM hits)")
def rg_outside(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "overlapping", invert=True).select("id")


@query(_pair(_COVER) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits)")
def rg_covering(spark, sf):
    return spatial.selected(layer(spark, sf, "A"), layer(spark, sf, "R"), "covering").select("id")


@query(_pair(_MEET) + " SELECT id FROM rb WHERE id IN (SELECT b FROM hits)")
def rg_pull_interacting(spark, sf):
    return spatial.pulled(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting").select("id")


@query(_pair(_MEET) + " SELECT id, id IN (SELECT a FROM hits) AS hit FROM ra")
def rg_split_interacting(spark, sf):
    return spatial.split(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting").select("id", "hit")


@query(_pair(_MEET) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits WHERE pa = pb)")
def props_eq(spark, sf):
    return spatial.selected_by(layer(spark, sf, "A"), layer(spark, sf, "R"), "interacting", "pid", True).select("id")


@query(_pair(_MEET) + " SELECT id FROM ra WHERE id IN (SELECT a FROM hits WHERE pa <> pb)")
def props_ne(spark, sf):
    return spatial.selected_by(layer(spark, sf, "A"), layer(spark, sf, "N"), "interacting", "pid", False).select("id")


ORACLES["props_ne"] = ORACLES["props_ne"].replace("layer = 'R'", "layer = 'N'")
_EXACT = "SELECT 1 FROM rects b WHERE b.layer = 'R' AND (b.x0, b.y0, b.x1, b.y1) = (a.x0, a.y0, a.x1, a.y1)"


@query(f"SELECT id FROM rects a WHERE layer = 'A' AND EXISTS ({_EXACT})")
def rg_in(spark, sf):
    return spatial.members(layer(spark, sf, "A"), layer(spark, sf, "R")).select("id")


@query(f"SELECT id FROM rects a WHERE layer = 'A' AND NOT EXISTS ({_EXACT})")
def rg_not_in(spark, sf):
    return spatial.members(layer(spark, sf, "A"), layer(spark, sf, "R"), invert=True).select("id")


# ---------------------------------------------------------------- booleans, density

_CELLS = """@cells AS (SELECT DISTINCT layer, x, y FROM (SELECT layer, x, unnest(range(y0, y1)) AS y FROM (SELECT layer, y0, y1, unnest(range(x0, x1)) AS x FROM rects WHERE layer IN ('A', 'R'))))"""
_BY_TILE = "SELECT CAST(x // 256 AS INTEGER) AS tx, CAST(y // 256 AS INTEGER) AS ty, count(*) AS area FROM"


@query(_CELLS + f" {_BY_TILE} (SELECT x, y FROM cells WHERE layer = 'A' INTERSECT SELECT x, y FROM cells WHERE layer = 'R') GROUP BY 1, 2")
def bool_and_area(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), layer(spark, sf, "R"), "and")


@query(_CELLS + f" {_BY_TILE} (SELECT x, y FROM cells WHERE layer = 'A' EXCEPT SELECT x, y FROM cells WHERE layer = 'R') GROUP BY 1, 2")
def bool_not_area(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), layer(spark, sf, "R"), "not")


@query(_CELLS + f" {_BY_TILE} (SELECT x, y FROM cells GROUP BY x, y HAVING count(*) = 1) GROUP BY 1, 2")
def bool_xor_area(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), layer(spark, sf, "R"), "xor")


@query(_CELLS + f" {_BY_TILE} (SELECT DISTINCT x, y FROM cells) GROUP BY 1, 2")
def bool_or_area(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), layer(spark, sf, "R"), "or")


@query(_CELLS + f" {_BY_TILE} (SELECT x, y FROM cells WHERE layer = 'A') GROUP BY 1, 2")
def merged_area(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), None, "or")


@query(f"{_BY_TILE} (SELECT x, y FROM (SELECT x, unnest(range(y0, y1)) AS y FROM (SELECT y0, y1, unnest(range(x0, x1)) AS x FROM rects WHERE layer = 'A')) GROUP BY x, y HAVING count(*) >= 2) GROUP BY 1, 2")
def merged_min_wc(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), None, F.col("a") >= 2)


@query(f"{_BY_TILE} (SELECT x, unnest(range(y0, y1)) AS y FROM (SELECT y0, y1, unnest(range(x0, x1)) AS x FROM rects WHERE layer = 'A')) GROUP BY 1, 2")
def density_map(spark, sf):
    return sweep.density(layer(spark, sf, "A"))


@query(_CELLS + f" SELECT tx, ty FROM ({_BY_TILE} (SELECT x, y FROM cells WHERE layer = 'A') GROUP BY 1, 2) WHERE area * 100 >= 1 * 65536")
def with_density(spark, sf):
    return sweep.area_by_tile(layer(spark, sf, "A"), None, "or").where("area * 100 >= 65536").select("tx", "ty")


def _edge_sql(condition: str) -> str:
    return f"""@used AS (SELECT line, t0, t1, CASE WHEN layer IN ('click', 'view') THEN 1 ELSE 0 END AS a, CASE WHEN layer NOT IN ('click', 'view') THEN 1 ELSE 0 END AS b FROM segments WHERE t1 > t0
      UNION ALL SELECT line, t0 + 300, t1 + 300, 0, 1 FROM segments WHERE layer = 'click' AND t1 > t0),
      ts AS (SELECT line, t0 AS t, sum(a) AS a, sum(b) AS b FROM (SELECT line, t0, a, b FROM used UNION ALL SELECT line, t1, -a, -b FROM used) GROUP BY 1, 2),
      w AS (SELECT line, t, lead(t) OVER p AS t1, sum(a) OVER p AS a, sum(b) OVER p AS b FROM ts WINDOW p AS (PARTITION BY line ORDER BY t))
      SELECT line, CAST(sum(t1 - t) AS BIGINT) AS length FROM w WHERE t1 IS NOT NULL AND ({condition}) GROUP BY line"""


def _edges(spark, sf, keep: str) -> DataFrame:
    """Lengths by line of booleans between clicks and views, and all other edges with the clicks shifted by 300 s."""
    own = segments(spark, sf)
    first = F.col("layer").isin("click", "view")
    shifted = own.where("layer = 'click'").select("line", F.lit("shifted").alias("layer"), (F.col("t0") + 300).alias("t0"), (F.col("t1") + 300).alias("t1"))
    return sweep.line_runs(own.unionByName(shifted), first, ~first, keep, SPAN).groupBy("line").agg(F.sum(F.col("t1") - F.col("t0")).alias("length"))


@query(_edge_sql("a > 0 AND b > 0"), views=SEGMENTS_SQL)
def edge_and(spark, sf):
    return _edges(spark, sf, "and")


@query(_edge_sql("a > 0 AND b = 0"), views=SEGMENTS_SQL)
def edge_not(spark, sf):
    return _edges(spark, sf, "not")


@query(_edge_sql("(a > 0) <> (b > 0)"), views=SEGMENTS_SQL)
def edge_xor(spark, sf):
    return _edges(spark, sf, "xor")


@query(_edge_sql("a > 0 OR b > 0"), views=SEGMENTS_SQL)
def edge_or(spark, sf):
    return _edges(spark, sf, "or")


# ---------------------------------------------------------------- checks

_GAPS = """SELECT first, second, gap, axis FROM (
  SELECT a.id AS first, b.id AS second, CASE WHEN greatest(b.x0 - a.x1, a.x0 - b.x1) BETWEEN 1 AND 3 AND a.y0 < b.y1 AND b.y0 < a.y1 THEN greatest(b.x0 - a.x1, a.x0 - b.x1)
         WHEN greatest(b.y0 - a.y1, a.y0 - b.y1) BETWEEN 1 AND 3 AND a.x0 < b.x1 AND b.x0 < a.x1 THEN greatest(b.y0 - a.y1, a.y0 - b.y1) END AS gap,
         CASE WHEN a.y0 < b.y1 AND b.y0 < a.y1 THEN 'x' ELSE 'y' END AS axis
  FROM ra a JOIN rb b ON a.x0 - 4 <= b.x1 AND b.x0 <= a.x1 + 4 AND a.y0 - 4 <= b.y1 AND b.y0 <= a.y1 + 4 {order}) WHERE gap IS NOT NULL"""


@query("@ra AS (SELECT * FROM rects WHERE layer = 'A'), rb AS (SELECT * FROM ra) " + _GAPS.format(order="AND a.id < b.id"))
def chk_space(spark, sf):
    a = layer(spark, sf, "A")
    return spatial.space_pairs(a, a, 4, same=True)


@query("@ra AS (SELECT * FROM rects WHERE layer = 'A'), rb AS (SELECT * FROM rects WHERE layer = 'R') " + _GAPS.format(order=""))
def chk_separation(spark, sf):
    return spatial.space_pairs(layer(spark, sf, "A"), layer(spark, sf, "R"), 4, same=False)


@query("SELECT id, least(x1 - x0, y1 - y0) AS width FROM rects WHERE least(x1 - x0, y1 - y0) < 5")
def chk_width(spark, sf):
    return rects(spark, sf).select("id", F.least(g.width(), g.height()).alias("width")).where("width < 5")


@query("@ra AS (SELECT * FROM rects WHERE layer = 'A'), rb AS (SELECT * FROM rects WHERE layer = 'R')" + f" SELECT a.id AS first, b.id AS second, least(b.x0 - a.x0, a.x1 - b.x1, b.y0 - a.y0, a.y1 - b.y1) AS margin FROM ra a JOIN rb b ON {_COVER} WHERE least(b.x0 - a.x0, a.x1 - b.x1, b.y0 - a.y0, a.y1 - b.y1) < 3")
def chk_enclosing(spark, sf):
    return spatial.enclosure_pairs(layer(spark, sf, "A"), layer(spark, sf, "R"), 3)


@query("SELECT id FROM rects WHERE x0 % 5 <> 0 OR x1 % 5 <> 0 OR y0 % 2 <> 0 OR y1 % 2 <> 0")
def chk_grid(spark, sf):
    return rects(spark, sf).where(g.off_grid(F.col("x0"), 5) | g.off_grid(F.col("x1"), 5) | g.off_grid(F.col("y0"), 2) | g.off_grid(F.col("y1"), 2)).select("id")


@query("SELECT id, " + ", ".join(f"CAST(floor((2 * {c} + 5) / 10.0) * 5 AS INTEGER) AS {c}" for c in BOXES) + " FROM rects")
def rg_snapped(spark, sf):
    return rects(spark, sf).select("id", *[g.snapped(F.col(c), 5).alias(c) for c in BOXES])


@query("SELECT id, -y1 AS x0, x0 AS y0, -y0 AS x1, x1 AS y1 FROM rects")
def rg_rotated(spark, sf):
    return rects(spark, sf).select("id", *g.rotated(1))


# ---------------------------------------------------------------- properties, nets, netlists


@query("SELECT id, CAST(x1 - x0 AS BIGINT) * (y1 - y0) AS area, pid || '/' || layer AS label FROM rects WHERE x1 - x0 > 2 * (y1 - y0)")
def eval_put(spark, sf):
    return rects(spark, sf).where(g.width() > 2 * g.height()).select("id", g.area().alias("area"), F.concat_ws("/", "pid", "layer").alias("label"))


@query("SELECT x0, y0, string_agg(DISTINCT pid, ',' ORDER BY pid) AS pids, count(*) AS shapes FROM rects GROUP BY x0, y0 HAVING count(*) > 1")
def merged_props(spark, sf):
    by = rects(spark, sf).groupBy("x0", "y0").agg(F.array_join(F.array_sort(F.collect_set("pid")), ",").alias("pids"), F.count("*").alias("shapes"))
    return by.where("shapes > 1")


_NETS = """RECURSIVE @ra AS (SELECT * FROM rects WHERE layer = 'A'), e AS (SELECT a.id AS a, b.id AS b FROM ra a JOIN ra b ON a.id <> b.id AND """ + _MEET + """),
  walk AS (SELECT id, id AS seen FROM ra UNION SELECT w.id, e.b FROM walk w JOIN e ON w.seen = e.a), net AS (SELECT id, min(seen) AS net FROM walk GROUP BY id)"""


@query(_NETS + " SELECT id, net FROM net")
def net_components(spark, sf):
    return connectivity.layer_nets(layer(spark, sf, "A")).select("id", "net").distinct()


@query(_NETS + " SELECT net, count(*) AS shapes, CAST(sum(CAST(x1 - x0 AS BIGINT) * (y1 - y0)) AS BIGINT) AS area FROM net JOIN ra USING (id) GROUP BY net HAVING count(*) > 2")
def evaluate_nets(spark, sf):
    return connectivity.layer_nets(layer(spark, sf, "A")).groupBy("net").agg(F.count("*").alias("shapes"), F.sum(g.area()).alias("area")).where("shapes > 2")


@query(
    """RECURSIVE @ra AS (SELECT * FROM rects WHERE layer IN ('A', 'R')), e0 AS (SELECT a.id AS a, b.id AS b FROM ra a JOIN ra b ON a.layer = 'A' AND b.layer = 'R' AND """ + _MEET + """),
  e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), walk AS (SELECT id, id AS seen FROM ra UNION SELECT w.id, e.b FROM walk w JOIN e ON w.seen = e.a), net AS (SELECT id, min(seen) AS net FROM walk GROUP BY id),
  m AS (SELECT net, CAST(sum(CASE WHEN layer = 'A' THEN CAST(x1 - x0 AS BIGINT) * (y1 - y0) ELSE 0 END) AS BIGINT) AS gate_area, CAST(sum(CASE WHEN layer = 'R' THEN CAST(x1 - x0 AS BIGINT) * (y1 - y0) ELSE 0 END) AS BIGINT) AS metal_area FROM net JOIN ra USING (id) GROUP BY net)
  SELECT net, gate_area, metal_area FROM m WHERE gate_area > 0 AND metal_area > 2 * gate_area"""
)
def antenna(spark, sf):
    shapes = rects(spark, sf).where("layer IN ('A', 'R')")
    return connectivity.antenna(connectivity.connected_nets(shapes, [("A", "R")]), "A", "R", 2)


_PLACE = "SELECT x0, y0, x1, y1, pid FROM rects WHERE layer = "


@query(f"""SELECT side, x0, y0, x1, y1, pid, count(*) AS shapes FROM (SELECT 'a' AS side, * FROM ({_PLACE}'A' EXCEPT ALL {_PLACE}'R')
       UNION ALL SELECT 'b', * FROM ({_PLACE}'R' EXCEPT ALL {_PLACE}'A')) GROUP BY ALL""")
def layout_diff(spark, sf):
    place = lambda name: layer(spark, sf, name).select(*BOXES, "pid")
    return netlist.difference_counts(place("A"), place("R"))


def _devices(spark, sf) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("class"), (F.col("l_partkey") % 500).alias("net_a"), (F.col("l_suppkey") % 500).alias("net_b"), F.col("l_quantity").cast("long").alias("value"))
    return lines


@query("SELECT l_returnflag AS class, least(l_partkey % 500, l_suppkey % 500) AS net_a, greatest(l_partkey % 500, l_suppkey % 500) AS net_b, count(*) AS devices, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3", views="")
def dev_combine(spark, sf):
    return netlist.combine_parallel(_devices(spark, sf))


@query("SELECT c_custkey AS net FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", views="")
def purge_nets(spark, sf):
    return netlist.purge_nets(read(spark, sf, "customer").select(F.col("c_custkey").alias("net")), read(spark, sf, "orders").select(F.col("o_custkey").alias("net")))


@query(
    """SELECT coalesce(a.k, b.k) AS net, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'NoMatch' WHEN abs(a.n - b.n) <= 1 THEN 'Match' ELSE 'Mismatch' END AS status
       FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""",
    views="",
)
def lvs_match_status(spark, sf):
    side = lambda s: read(spark, sf, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("net")).agg(F.count("*").alias("n"))
    return netlist.compare(side("F"), side("O"), "net", ["n"], 1)
