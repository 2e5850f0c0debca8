from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import region_label


def region_table_scan(table: DataFrame) -> DataFrame:
    """Regions (1-based inclusive) from any table with chrom, start and end; name is optional."""
    for needed in ("chrom", "start", "end"):
        if needed not in table.columns:
            raise ValueError(f"required column is missing: {needed}")
    name = F.nullif(F.trim(F.col("name").cast("string")), F.lit("")) if "name" in table.columns else F.lit(None)
    given = F.col("region_id") if "region_id" in table.columns else None
    chrom, start, end = F.col("chrom").cast("string"), F.col("start").cast("bigint"), F.col("end").cast("bigint")
    return table.select(
        region_label(chrom, start, end, given).alias("region_id"),
        chrom.alias("chrom"), start.alias("start"), end.alias("end"), name.cast("string").alias("name"),
    )
