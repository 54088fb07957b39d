"""Markers of checks as report databases: XML items with category, cell and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ITEM = "category string, cell string, multiplicity int, values struct<value: array<string>>"


def box_value(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The text of a box as an item's value."""
    return F.format_string("box: (%d,%d;%d,%d)", x0, y0, x1, y1)


def edge_pair_value(first: Column, second: Column) -> Column:
    """The text of a pair of edges (STRUCT<x1, y1, x2, y2>) as an item's value."""
    ends = [e[c] for e in (first, second) for c in ("x1", "y1", "x2", "y2")]
    return F.format_string("edge-pair: (%d,%d;%d,%d)/(%d,%d;%d,%d)", *ends)


def box_of(value: Column) -> list[Column]:
    """x0, y0, x1, y1 of a box value; null for other kinds."""
    return [F.nullif(F.regexp_extract(value, r"^box: \((-?\d+),(-?\d+);(-?\d+),(-?\d+)\)$", k), F.lit("")).cast("long") for k in range(1, 5)]


def write(markers: DataFrame, path: str) -> None:
    """Writes (category, cell, value), one item each."""
    items = markers.select("category", "cell", F.lit(1).alias("multiplicity"), F.struct(F.array("value").alias("value")).alias("values"))
    items.write.format("xml").option("rootTag", "items").option("rowTag", "item").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(category, cell, multiplicity, value), a row for each value of each item."""
    items = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    return items.select("category", "cell", "multiplicity", F.explode("values.value").alias("value"))
