"""Reference sequences as contigs and as tiles.

A tile is a bounded piece of a contig (``core_len`` bases) with up to ``lead`` bases before and
``overlap`` bases after it, so that every job over a genome works on small rows whatever the contig length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TILE = 1024
#: Lines that are numbered together: some 1 MB of text.
LINES = 16_384


def fasta_contig_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per contig.  For references of many short contigs; see ``fasta_tile_scan`` for long ones."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"\s", "")
    return records.select(header.alias("chrom"), F.upper(body).alias("seq"))


def contig_tiles(contigs: DataFrame, tile: int = TILE, lead: int = 0, overlap: int = 0) -> DataFrame:
    """Cut contigs into tiles.  Bytes are cut, not characters, so a cut does not walk the contig."""
    cut = contigs.select(
        "chrom", F.length("seq").alias("_n"), F.col("seq").cast("binary").alias("_b")
    ).filter("_n > 0")
    last = (F.expr(f"(_n - 1) div {tile}")).cast("int")
    tiles = cut.select("*", F.explode(F.sequence(F.lit(0), last)).alias("tile"))
    first = F.col("tile") * tile
    got_lead = F.least(first, F.lit(lead))
    return tiles.select(
        "chrom", "tile",
        first.cast("bigint").alias("tile_start"),
        got_lead.cast("int").alias("lead"),
        F.least(F.lit(tile), F.col("_n") - first).cast("int").alias("core_len"),
        F.substring("_b", (first - got_lead + 1).cast("int"), (got_lead + F.lit(tile + overlap)).cast("int"))
        .cast("string").alias("seq"),
    )


def fasta_tile_scan(
    spark: SparkSession, path: str, tile: int = TILE, lead: int = 0, overlap: int = 0, lines_at_once: int = LINES
) -> DataFrame:
    """Tiles straight from the lines of FASTA files, without ever holding a contig in one row.

    Each run of ``lines_at_once`` lines of a file split numbers its own bases; one small row per run carries the open
    contig and its length over to the next one.  No task has to sort a whole split.
    """
    place = ["_block", "_chunk"]
    split = ["_file", *place]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>([^\s]*)", 1)).alias("_head"),
        F.when(~F.col("value").startswith(">"), F.upper(F.regexp_replace("value", r"\s", ""))).alias("_text"),
    )
    # The low 33 bits of a row's number count the rows of its partition, in the order of the file.
    lines = lines.withColumn("_chunk", F.expr(f"(_row & {(1 << 33) - 1}L) div {lines_at_once}"))
    in_split = W.partitionBy(*split).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    numbered = (
        lines.withColumn("_n", F.coalesce(F.length("_text"), F.lit(0)).cast("bigint"))
        .withColumn("_name", F.last("_head", ignorenulls=True).over(in_split))
        .withColumn("_upto", F.sum("_n").over(in_split))
        .withColumn("_base", F.last(F.when(F.col("_head").isNotNull(), F.col("_upto")), ignorenulls=True).over(in_split))
    )
    # Per run: the contig left open at its end, and how many of its bases the run holds.
    ends = numbered.groupBy(*split).agg(
        F.max_by("_name", "_row").alias("_open"),
        (F.max("_upto") - F.coalesce(F.max("_base"), F.lit(0))).alias("_held"),
    )
    earlier = W.partitionBy("_file").orderBy(*place).rowsBetween(W.unboundedPreceding, -1)
    run = ends.withColumn("_run", F.sum(F.col("_open").isNotNull().cast("int")).over(
        W.partitionBy("_file").orderBy(*place)))
    run = run.withColumn("_sofar", F.sum("_held").over(W.partitionBy("_file", "_run").orderBy(*place)))
    carried = run.select(
        *split,
        F.last("_open", ignorenulls=True).over(earlier).alias("_carry_name"),
        F.coalesce(
            F.lag("_sofar").over(W.partitionBy("_file").orderBy(*place)), F.lit(0)
        ).alias("_carry_n"),
    )
    placed = (
        numbered.filter(F.col("_n") > 0)
        .join(carried, split)
        .select(
            F.coalesce("_name", "_carry_name").alias("chrom"),
            (
                F.col("_upto") - F.col("_n") - F.coalesce("_base", F.lit(0))
                + F.when(F.col("_name").isNull(), F.col("_carry_n")).otherwise(0)
            ).alias("_at"),
            F.col("_text").cast("binary").alias("_b"), "_n",
        )
    )
    # A line goes to every tile whose reach it touches; the pieces of one tile are bounded by its reach.
    low = F.expr(f"greatest(_at - {overlap}, 0) div {tile}")
    high = F.expr(f"(_at + _n - 1 + {lead}) div {tile}")
    pieces = placed.select("*", F.explode(F.sequence(low, high)).alias("tile")).select(
        "chrom", "tile", "_at", "_b", "_n",
        F.greatest(F.col("tile") * tile - lead, F.lit(0)).alias("_from"),
        (F.col("tile") * tile + tile + overlap).alias("_to"),
    )
    cut_from = F.greatest(F.col("_from") - F.col("_at"), F.lit(0))
    cut_to = F.least(F.col("_to") - F.col("_at"), F.col("_n"))
    pieces = pieces.filter(cut_to > cut_from).select(
        "chrom", "tile", "_at",
        F.substring("_b", (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")).cast("string").alias("_s"),
    )
    joined = pieces.groupBy("chrom", "tile").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda p: p["_s"]), "").alias("seq")
    )
    got_lead = F.least(F.col("tile") * tile, F.lit(lead)).cast("int")
    return joined.select(
        "chrom", F.col("tile").cast("int").alias("tile"),
        (F.col("tile") * tile).alias("tile_start"),
        got_lead.alias("lead"),
        F.least(F.lit(tile), F.length("seq") - got_lead).cast("int").alias("core_len"),
        "seq",
    ).filter("core_len > 0")
