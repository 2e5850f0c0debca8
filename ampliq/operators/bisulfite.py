"""Bisulfite conversion with a methylation pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import bisulfite_convert
from ..joins import counted_lookup
from ..session import cut_lineage


def methylation_join(
    windows: DataFrame, pattern: DataFrame, cpg_default: str = "methyl", key: str = "region_id"
) -> DataFrame:
    """Windows with ``converted``: the default conversion, overridden at the sites the pattern names.

    Only CG sites meet the pattern (chrom, pos, methylated), and only those that differ from the default
    come back; their number per window is bounded by the window.  A methylated entry wins over a contrary one.
    The windows are read for their sites, for the counts of the lookup and at the end, so they are fetched once and written.
    """
    windows = cut_lineage(windows)
    converted = bisulfite_convert(F.col("template_plus"), cpg_default)
    sites = windows.select(
        key, "chrom", "window_start", "template_plus",
        F.explode(F.sequence(F.lit(1), F.length("template_plus") - 1)).alias("i"),
    ).filter(F.substring("template_plus", F.col("i"), F.lit(2)) == "CG")
    sites = sites.select(key, "chrom", "i", (F.col("window_start") + F.col("i") - 1).alias("pos"))
    stated = pattern.groupBy("chrom", "pos").agg(F.max("methylated").alias("methylated"))
    against = stated.filter(F.col("methylated") != F.lit(cpg_default == "methyl"))
    changed = counted_lookup(sites, cut_lineage(against), ["chrom", "pos"], "inner").groupBy(key).agg(
        F.collect_list(F.struct("i", F.when(F.col("methylated"), "C").otherwise("T").alias("base"))).alias("_changes")
    )
    joined = windows.join(changed, key, "left")
    patched = F.aggregate(
        F.coalesce("_changes", F.array().cast("array<struct<i:int,base:string>>")), converted,
        lambda s, c: F.overlay(s, c["base"], c["i"], F.lit(1)),
    )
    return joined.withColumn("converted", patched).drop("_changes")
