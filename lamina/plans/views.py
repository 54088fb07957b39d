"""Whole-number geometry views of the driver's tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECTS_SQL = """
rects AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, d) AS id, l_returnflag AS layer, l_linestatus AS pid,
         CAST((l_partkey * 37) % 10000 AS INTEGER) AS x0, CAST(d AS INTEGER) AS y0,
         CAST((l_partkey * 37) % 10000 + CAST(l_quantity AS INTEGER) AS INTEGER) AS x1, CAST(d + 1 + (l_suppkey % 20) AS INTEGER) AS y1
  FROM (SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem)
)"""

SEGMENTS_SQL = """
segments AS (
  SELECT user_id AS line, event_type AS layer, t0, lead(t0) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS t1
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t0 FROM events)
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, layer, pid, x0, y0, x1, y1): one box for each line item."""
    d = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    x0 = ((F.col("l_partkey") * 37) % 10000).cast("int")
    return (
        read(spark, sf_dir, "lineitem").withColumn("d", d)
        .select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "d").alias("id"), F.col("l_returnflag").alias("layer"), F.col("l_linestatus").alias("pid"),
            x0.alias("x0"), F.col("d").cast("int").alias("y0"), (x0 + F.col("l_quantity").cast("int")).alias("x1"), (F.col("d") + 1 + (F.col("l_suppkey") % 20)).cast("int").alias("y1"),
        )
    )


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rects(spark, sf_dir).where(F.col("layer") == name)


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, layer, pts): an L, a triangle or a box for each box, by its width; contours run clockwise."""
    from lamina.functions.shapes import point

    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    xm, ym = (x0 + F.floor((x1 - x0) / 2)), (y0 + F.floor((y1 - y0) / 2))
    ell = F.array(point(x0, y0), point(x0, y1), point(xm, y1), point(xm, ym), point(x1, ym), point(x1, y0))
    three, four = F.array(point(x0, y0), point(x0, y1), point(x1, y0)), F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0))
    kind = (x1 - x0) % 3
    pts = F.when((kind == 0) & (x1 - x0 >= 2) & (y1 - y0 >= 2), ell).when(kind == 1, three).otherwise(four)
    return rects(spark, sf_dir).select("id", "layer", pts.alias("pts"))


#: Seconds after which a line of events is cut, so that no task orders a whole line.
SPAN = 7 * 86_400


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, layer, t0, t1): an edge from each event of a user to the next one, in whole seconds.

    Events are ordered within a week; the last of a week looks up the first of the next week with any.
    """
    from pyspark.sql import Window

    t0 = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("line"), F.col("event_type").alias("layer"), t0.alias("t0"), "event_id")
    events = events.withColumn("part", F.floor(F.col("t0") / SPAN))
    firsts = events.groupBy(F.col("line").alias("of"), F.col("part").alias("week")).agg(F.min("t0").alias("begins"))
    firsts = firsts.withColumn("later", F.lead("begins").over(Window.partitionBy("of").orderBy("week")))
    inner = events.withColumn("t1", F.lead("t0").over(Window.partitionBy("line", "part").orderBy("t0", "event_id")))
    both = inner.join(firsts, F.col("line").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("week")))
    return both.select("line", "layer", "t0", F.coalesce("t1", "later").alias("t1"))
