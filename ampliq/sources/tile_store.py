"""A stored reference: tiles in order of contig and place, of which a read opens only the files that hold wanted tiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases that a file holds, and files that a store may have (their first tiles pass through the driver).
FILE_BASES, MOST_FILES = 64_000_000, 20_000
_TILES = "chrom string, tile int, tile_start long, lead int, core_len int, seq string"


def _part_of(chrom: Column, tile: Column, firsts: Sequence[tuple[str, int]]) -> Column:
    """The last part whose first tile is not behind (chrom, tile), by binary search; 0 also for what lies before all."""
    if len(firsts) < 2:
        return F.lit(0)
    bounds = F.array(*[F.struct(F.lit(c).alias("chrom"), F.lit(t).cast("int").alias("tile")) for c, t in firsts])
    place = F.struct(chrom.alias("chrom"), tile.cast("int").alias("tile"))
    steps = F.lit([1 << k for k in reversed(range(len(firsts).bit_length()))])
    passed = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(bounds, low + step - 1) <= place, low + step).otherwise(low)
    )
    return F.greatest(passed - 1, F.lit(0))


@dataclass(frozen=True)
class TileStore:
    """Where a store lies, and the first (chrom, tile) of each of its parts, in order."""

    spark: SparkSession
    path: str
    firsts: tuple[tuple[str, int], ...]

    @classmethod
    def write(cls, tiles: DataFrame, path: str, file_bases: int = FILE_BASES) -> TileStore:
        """Store tiles without lead and overlap: one sorted file a part, and a table of the parts.

        Parts are ranges of (chrom, tile), so a contig's neighbouring tiles lie together however the contigs differ in
        length.  The number of files follows the bases, up to a bound.
        """
        bases = tiles.agg(F.sum("core_len")).first()[0] or 0
        n_parts = min(MOST_FILES, max(1, -(-bases // file_bases)))
        rows = tiles.select("chrom", "tile", "tile_start", "lead", "core_len", "seq")
        placed = rows.repartitionByRange(n_parts, "chrom", "tile").sortWithinPartitions("chrom", "tile")
        placed = placed.withColumn("part", F.spark_partition_id())
        placed.write.partitionBy("part").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/tiles")
        stored = _stored(tiles.sparkSession, path)
        place = F.struct("chrom", "tile")
        parts = stored.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("tiles"))
        parts.coalesce(1).write.parquet(f"{path}/parts")
        return cls.open(tiles.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TileStore:
        rows = spark.read.parquet(f"{path}/parts").orderBy("first").select("part", "first.chrom", "first.tile").collect()
        if [r.part for r in rows] != sorted(r.part for r in rows):
            raise ValueError(f"the parts of {path} are not in order")
        return cls(spark, path, tuple((r.chrom, r.tile) for r in rows))

    def tiles(self) -> DataFrame:
        """All tiles."""
        return _stored(self.spark, self.path).drop("part")

    def holding(self, wanted: DataFrame) -> DataFrame:
        """The tiles of those parts that hold any of the wanted (chrom, tile) rows; no other file is opened.

        The wanted rows are reduced to the numbers of their parts, of which there are no more than files.
        """
        names = sorted(r.part for r in self.spark.read.parquet(f"{self.path}/parts").select("part").collect())
        asked = wanted.where("chrom is not null and tile is not null")
        nth = asked.select(_part_of(F.col("chrom"), F.col("tile"), self.firsts).alias("nth")).distinct().collect()
        parts = [names[r.nth] for r in nth if r.nth < len(names)]
        return _stored(self.spark, self.path).where(F.col("part").isin(parts) if parts else F.lit(False)).drop("part")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_TILES}, part int").parquet(f"{path}/tiles")
