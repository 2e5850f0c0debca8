"""Region design: regions and a tiled reference in, ranked amplicons out.  One job for all regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AMPLICON_THRESHOLDS, DESIGN_DEFAULTS
from ..functions.sequence import bisulfite_convert, region_label
from ..joins import once, shuffled
from ..operators.bisulfite import methylation_join
from ..operators.design import (
    amplicon_row, bounded_pairs, pair_topn, primer_candidates, probe_candidates, probe_primer_join, probe_topn,
)
from ..operators.qc import passes_thresholds
from ..operators.structure import hairpin_screen, heterodimer_screen, homodimer_screen
from ..operators.windows import template_window_fetch
from ..session import cut_lineage


def distinct_regions(regions: DataFrame) -> DataFrame:
    """Each region once; a region_id that stands for several intervals has the interval added (``id chrom:start-end``)."""
    # Read again for the clashing ids, for the windows and for what they fetch; written, so that it is worked out once.
    regions = cut_lineage(regions.dropDuplicates(["region_id", "chrom", "start", "end"]))
    place = F.struct("chrom", "start", "end")
    ids = regions.groupBy("region_id").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    clashing = ids.where("low < high").select(F.col("region_id").alias("_clashing"))
    apart = F.concat("region_id", F.lit(" "), region_label(F.col("chrom"), F.col("start"), F.col("end")))
    marked = regions.join(clashing, F.col("region_id") == F.col("_clashing"), "left")
    named = F.when(F.col("_clashing").isNotNull(), F.coalesce(apart, "region_id")).otherwise(F.col("region_id"))
    return marked.withColumn("region_id", named).drop("_clashing")


def region_templates(
    regions: DataFrame, tiles: DataFrame, p: dict, methylation: DataFrame | None = None
) -> DataFrame:
    """Templates of all regions that have one, converted where asked for; a repeated region comes once."""
    regions = distinct_regions(regions)
    if not p["bisulfite"]:
        got = template_window_fetch(regions, tiles, p["max_amplicon_length"])
        got = got.withColumn("reference_template", F.col("template"))
    else:
        got = template_window_fetch(regions, tiles, p["max_amplicon_length"], look_ahead=1)
        got = got.withColumn("reference_template", F.col("template"))
        if methylation is None:
            converted = bisulfite_convert(F.col("template_plus"), p["cpg_default"])
            got = got.withColumn("template", converted).drop("template_plus")
        else:
            got = methylation_join(got.filter(F.col("template").isNotNull()), methylation, p["cpg_default"])
            got = got.withColumn("template", F.col("converted")).drop("converted", "template_plus")
    return got.filter(F.col("error").isNull() & F.col("template").isNotNull()).drop("error")


def failed_regions(regions: DataFrame, tiles: DataFrame, params: dict | None = None) -> DataFrame:
    """The regions without a template (region_id, error), which ``region_design`` leaves out."""
    p = {**DESIGN_DEFAULTS, **(params or {})}
    got = template_window_fetch(distinct_regions(regions), tiles, p["max_amplicon_length"])
    return got.filter("error is not null").select("region_id", "error")


def design_amplicons(templates: DataFrame, p: dict) -> DataFrame:
    """Best pairs per region, or per probe when probes are asked for."""
    low, high = p["min_amplicon_length"], p["max_amplicon_length"]
    if p["n_probes"] == 0:
        return bounded_pairs(
            primer_candidates(templates, p), p["n_primers"], low, high, p["max_tm_difference"], p["primer_opt_tm"], p["primer_opt_length"])
    probes = probe_topn(probe_candidates(templates, p), p["n_probes"], p["probe_opt_tm"], p["probe_opt_length"])
    # Primers can only be used in the band below the probe limits, so others are not made.
    band = (p["probe_min_tm"] - p["max_primer_probe_tm_diff"], p["probe_max_tm"] - p["min_primer_probe_tm_diff"])
    primers = primer_candidates(templates, p, band)
    triples = probe_primer_join(probes, primers, p, low, high)
    best = pair_topn(triples, p["n_primers"], ("region_id", "p_start", "p_len"))
    return best.join(
        shuffled(probes.select("region_id", F.col("start").alias("p_start"), F.col("len").alias("p_len"), "probe_rank")),
        ["region_id", "p_start", "p_len"],
    )


def region_design(
    regions: DataFrame, tiles: DataFrame, params: dict | None = None, methylation: DataFrame | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Wide amplicon rows with structures and ``selected`` (all thresholds met).

    ``params`` override the defaults and hold for all regions of the call.
    """
    p = {**DESIGN_DEFAULTS, **(params or {})}
    templates = region_templates(regions, tiles, p, methylation)
    # Both are read again: for the bounds, the oligo catalog, the dimer screen and the rows themselves.
    templates = cut_lineage(templates)
    best = design_amplicons(templates, p)
    if p["n_probes"]:
        best = cut_lineage(best)
    longest = max(p["primer_max_length"], p["probe_max_length"])
    used = ["l_seq", "r_seq", *(["p_seq"] if p["n_probes"] else [])]
    oligos = best.select(F.explode(F.array(*used)).alias("sequence")).distinct()
    catalog = hairpin_screen(oligos, longest).join(homodimer_screen(oligos, longest), "sequence")
    rows = amplicon_row(best, templates, catalog)
    dimers = heterodimer_screen(
        best.select(F.col("l_seq").alias("f_seq"), F.col("r_seq").alias("r_seq")), longest
    ).select(
        F.col("f_seq").alias("forward_sequence"), F.col("r_seq").alias("reverse_sequence"),
        "heterodimer_dg", "heterodimer_tm",
    )
    judged = rows.join(dimers, ["forward_sequence", "reverse_sequence"], "left")
    return once(judged, selected=passes_thresholds(thresholds or AMPLICON_THRESHOLDS))
