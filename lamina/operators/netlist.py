"""Netlist tables: combination, purge and comparison as grouping and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine_parallel(devices: DataFrame, net_a: str = "net_a", net_b: str = "net_b", value: str = "value") -> DataFrame:
    """Devices of a class between the same two nets, in either order, become one: (class, net_a, net_b, devices, value)."""
    low, high = F.least(net_a, net_b).alias("net_a"), F.greatest(net_a, net_b).alias("net_b")
    return devices.select("class", low, high, value).groupBy("class", "net_a", "net_b").agg(F.count("*").alias("devices"), F.sum(value).alias("value"))


def purge_nets(nets: DataFrame, terminals: DataFrame) -> DataFrame:
    """Nets with a terminal; floating ones go."""
    return nets.join(terminals.select("net").distinct(), "net", "left_semi")


def compare(left: DataFrame, right: DataFrame, key: str, values: list[str], tolerance: int = 0) -> DataFrame:
    """(key, status): Match, Mismatch where a value differs by more than ``tolerance``, or NoMatch where a side lacks the key."""
    a, b = left.select(key, *values).alias("a"), right.select(key, *values).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    near = F.lit(True)
    for v in values:
        near = near & (F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) <= tolerance)
    missing = F.col(f"a.{key}").isNull() | F.col(f"b.{key}").isNull()
    status = F.when(missing, "NoMatch").when(near, "Match").otherwise("Mismatch")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as often as they are missing on the other, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``difference`` with equal rows as one, and ``shapes``, their number.

    Rows are dealt by value before they are counted, so a task counts its own
    share of the values and not all that its part of the file holds.
    """
    values = a.columns
    both = a.withColumn("more", F.lit(1)).unionByName(b.withColumn("more", F.lit(-1)))
    sums = both.repartition(*values).groupBy(*values).agg(F.sum("more").alias("more")).where("more <> 0")
    return sums.select(F.when(F.col("more") > 0, "a").otherwise("b").alias("side"), *values, F.abs("more").alias("shapes"))
