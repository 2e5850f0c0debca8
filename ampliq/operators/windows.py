"""Fetching pieces of a reference for many intervals at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import BROADCAST_ROWS, fits_broadcast
from ..session import cut_lineage
from ..sources.fasta import TILE
from ..sources.tile_store import TileStore


def fetch_intervals(
    intervals: DataFrame, tiles: DataFrame | TileStore, keys: list[str], start: str, end: str, out: str = "seq",
    tile: int = TILE, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the upper-case reference text of [start, end), 0-based; cut at the contig end.

    Each distinct interval is fetched once, however many rows ask for it, and the rows are joined to it by its
    coordinates.  The interval join is an equi-join on (chrom, tile): few intervals are broadcast, so the genome is
    not shuffled; with many, adaptive execution splits tiles that very many of them want.
    ``keys`` are left as they are; ``tiles`` must have no lead and no overlap.  Of a stored reference only those
    files are opened that hold tiles of the intervals.
    """
    place = ["chrom", "_s", "_e"]
    asked = intervals.withColumns({"_s": F.col(start).cast("bigint"), "_e": F.col(end).cast("bigint")})
    wanted = asked.select(*place).filter((F.col("_s") >= 0) & (F.col("_e") > F.col("_s"))).distinct()
    wanted = wanted.select("*", F.explode(
        F.sequence(F.expr(f"int(_s div {tile})"), F.expr(f"int((_e - 1) div {tile})"))
    ).alias("tile"))
    if isinstance(tiles, TileStore):
        wanted = cut_lineage(wanted)
        tiles = tiles.holding(wanted)
    store = tiles.select("chrom", "tile", F.col("seq").alias("_t"))
    few = fits_broadcast(wanted, broadcast_rows)
    met = store.join(F.broadcast(wanted) if few else wanted, ["chrom", "tile"])
    at = F.col("tile").cast("bigint") * tile
    lo = F.greatest(F.col("_s") - at, F.lit(0))
    hi = F.least(F.col("_e") - at, F.lit(tile))
    piece = F.substring(F.col("_t").cast("binary"), (lo + 1).cast("int"), (hi - lo).cast("int")).cast("string")
    parts = met.groupBy(*place).agg(
        F.upper(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("tile", piece.alias("p")))), lambda x: x["p"]), "")).alias(out)
    )
    return asked.join(parts, place, "left").select(*intervals.columns, out)


def region_windows(regions: DataFrame, max_amplicon_length: int) -> DataFrame:
    """The template window of each region, 0-based half-open, and the target's place inside it."""
    m = F.lit(max_amplicon_length)
    ws = F.col("end") - m
    return regions.withColumns({
        "window_start": ws,
        "window_end": F.col("start") - 1 + m + 1,
        "target_start_index": (F.col("start") - 1 - ws).cast("int"),
        "target_end_index": (F.col("end") - ws).cast("int"),
    })


def template_window_fetch(
    regions: DataFrame, tiles: DataFrame | TileStore, max_amplicon_length: int, look_ahead: int = 0, tile: int = TILE
) -> DataFrame:
    """Region windows with their template.  A window before the contig start or behind its end, or an
    unknown contig, gives an error and no template.

    ``look_ahead`` adds ``template_plus``, the same window with that many more bases (for bisulfite conversion).
    """
    windows = region_windows(regions, max_amplicon_length).withColumn(
        "_fetch_end", F.col("window_end") + look_ahead
    )
    got = fetch_intervals(windows, tiles, ["region_id"], "window_start", "_fetch_end", "template_plus", tile)
    size = (F.col("window_end") - F.col("window_start")).cast("int")
    got = got.withColumns({
        "template": F.substring("template_plus", F.lit(1), size),
        "error": F.when(F.col("window_start") < 0, F.lit("window starts before the contig")).when(
            F.col("template_plus").isNull(), F.lit("contig unknown or window behind its end")
        ),
    })
    return got.drop("_fetch_end") if look_ahead else got.drop("_fetch_end", "template_plus")


def subseq_fetch(ranges: DataFrame, tiles: DataFrame | TileStore, keys: list[str], tile: int = TILE) -> DataFrame:
    """Upper-case text of 1-based inclusive ranges (chrom, start, end)."""
    zero = ranges.withColumn("_from", F.col("start") - 1)
    return fetch_intervals(zero, tiles, keys, "_from", "end", "seq", tile).drop("_from")
