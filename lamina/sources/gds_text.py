"""Polygons as the text form of GDS2 streams: one BOUNDARY record for each, ended by ENDEL.

Records are split by Spark's text source at their end mark, so files of any size
are read in parallel.  Other records, such as the headers of libraries and
structures, are passed over; a written folder holds records only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_END = "ENDEL\n"


def write(polygons: DataFrame, path: str) -> None:
    """Writes (layer INT, datatype INT, points ARRAY<STRUCT<x, y>>, property STRING); contours are closed by their first point."""
    closed = F.concat("points", F.slice("points", 1, 1))
    xy = F.array_join(F.transform(closed, lambda p: F.concat_ws(": ", p["x"].cast("string"), p["y"].cast("string"))), "\n")
    prop = F.when(F.col("property").isNotNull(), F.concat(F.lit("PROPATTR 1\nPROPVALUE "), "property", F.lit("\n"))).otherwise("")
    record = F.concat(F.lit("BOUNDARY\nLAYER "), F.col("layer").cast("string"), F.lit("\nDATATYPE "), F.col("datatype").cast("string"), F.lit("\nXY "), xy, F.lit("\n"), prop)
    polygons.select(record.alias("value")).write.option("lineSep", _END).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(layer, datatype, points, property) of all BOUNDARY records; the closing point is left out."""
    text = spark.read.option("lineSep", _END).text(path).where(F.col("value").rlike(r"(?m)^BOUNDARY\b"))
    part = lambda name: F.regexp_extract("value", rf"(?m)^{name} (.+)$", 1)
    pairs = F.regexp_extract_all("value", F.lit(r"(-?\d+): (-?\d+)"), F.lit(0))
    point = lambda t: F.struct(F.split(t, ": ")[0].cast("long").alias("x"), F.split(t, ": ")[1].cast("long").alias("y"))
    points = F.transform(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), point)
    return text.select(part("LAYER").cast("int").alias("layer"), part("DATATYPE").cast("int").alias("datatype"), points.alias("points"), F.nullif(part("PROPVALUE"), F.lit("")).alias("property"))
