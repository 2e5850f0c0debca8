"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ampliq.session import cut_lineage

SALTS = 16
#: Rows and bytes of values that a side may have to be broadcast.  The driver gathers the rows, builds the table and cuts
#: it into blocks, so it holds several times these bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24 << 20


def _value_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: eight a column, and the texts."""
    size = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for field in df.schema:
        if isinstance(field.dataType, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, ArrayType | MapType | StructType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))), F.lit(0))
    return size


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most ``max_rows`` rows of ``max_bytes`` in all; every row is counted where it is."""
    found = df.select(_value_bytes(df).alias("_size")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("size")).first()
    return found["rows"] <= max_rows and (found["size"] or 0) <= max_bytes


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a frame that is small in bytes but about to be blown up.

    Adaptive execution merges small shuffle partitions by their bytes and would leave such work to one task;
    a repartition with a stated number is not merged.  Later steps that group by ``keys`` need no shuffle.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *keys)


def shuffled(side: DataFrame) -> DataFrame:
    """Mark one side of a join so that Spark does not gather it on the driver.

    Spark broadcasts by the bytes of the files read: compressed ones, and those before a generator makes many rows of one.
    """
    return side.hint("merge")


def counted_lookup(
    big: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS,
    heavy_share: float = 0.002, salts: int = 64,
) -> DataFrame:
    """Join rows to a table that has a bounded number of rows per key, by what the counts of the keys say.

    A table of at most ``max_rows`` rows and ``BROADCAST_BYTES`` is broadcast; others are joined by ``dealt_lookup``.
    """
    if fits_broadcast(table, max_rows):
        return big.join(F.broadcast(table), list(on), how)
    return dealt_lookup(big, table, on, how, heavy_share, salts)


def dealt_lookup(
    big: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", heavy_share: float = 0.002, salts: int = 64,
) -> DataFrame:
    """Join rows to a table without broadcasting it.

    The big side's keys are counted: a key that holds more than ``heavy_share`` of the rows (there are fewer than 1 / ``heavy_share`` of them) is dealt over ``salts``
    partitions and only its rows of the table are repeated; all other keys are joined plainly.  Rows with a null key
    match nothing and are dealt out as well.  The salt is the number of the input partition, so a task that runs
    again sends the same rows to the same place, and equal rows are dealt out too.
    """
    counts = cut_lineage(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    least = int((counts.agg(F.sum("_n")).first()[0] or 0) * heavy_share) + 1
    heavy = cut_lineage(counts.dropna(subset=list(on)).where(F.col("_n") > least).select(*on, F.lit(True).alias("_heavy")))
    null_key = F.lit(False)
    for key in on:
        null_key = null_key | F.col(key).isNull()
    place = F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int")
    left = big.withColumn("_place", place).join(F.broadcast(heavy), list(on), "left")
    left = left.withColumn("_salt", F.when(F.col("_heavy") | null_key, F.col("_place")).otherwise(0)).drop("_heavy", "_place")
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(F.broadcast(heavy), list(on), "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that a later filter on them does not make Spark compute them twice.

    A filter is pushed through a projection by repeating its expressions, but not through a generator.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def code_ends(df: DataFrame, column: str) -> DataFrame:
    """End the generated code that makes these rows; what follows becomes code of its own.

    Spark fuses all steps between two exchanges into loops of one class, and the JVM runs a method of more than 8,000 bytes
    of code without ever compiling it, some tens of times slower.  A lambda is not part of fused code, so one that
    leaves ``column`` (not null) as it is divides the steps.  It costs as much as copying a row, so it belongs behind a filter.
    """
    kept = F.element_at(F.transform(F.array(F.col(column)), lambda value: value), 1)
    return df.withColumn(column, kept)
