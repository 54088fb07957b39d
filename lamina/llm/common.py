"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.staging import discard, new_path, shared_dir, staged  # noqa: F401

#: Fixed by the contracts: what separates words, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
_TRIM = "' ', '\\t', '\\n', '\\u000B', '\\f', '\\r'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean() -> None:
    """Gives back what earlier tasks of a reused Python worker left, before a task with much text begins."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has such a column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, an empty array for null or blank."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE}]+"))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
