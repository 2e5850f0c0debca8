"""Expressions that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and the letters that are lower-cased.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words in order; an empty array for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rank_among(value: Column, bounds: Sequence) -> Column:
    """How many of the ascending bounds are at most ``value`` (0 for null), by binary search."""
    if not bounds:
        return F.lit(0)
    places = F.lit(list(bounds))
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(places, low + step - 1) <= value, low + step).otherwise(low)
    )


def with_columns(df: DataFrame, row: str, made: dict[str, Column]) -> DataFrame:
    """Unpack the struct column ``row`` and add columns; an input column of the same name is replaced."""
    taken = {name.lower() for name in made}
    kept = [F.col(row)[f.name].alias(f.name) for f in df.schema[row].dataType if f.name.lower() not in taken]
    return df.select(*kept, *[value.alias(name) for name, value in made.items()])
