"""Pair QC: pairs and a tiled reference in, one judged row per pair out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.amplicons import all_amplicons, amplicon_rollup, amplicon_total, hits_by_pair
from ..operators.external_hits import pair_hit_counts, resolve_hits
from ..operators.qc import final_result, qc_flags, qc_pair_assembly, search_status
from ..operators.search import hit_cap, hit_counts, hit_filter, seed_extend_hits
from ..operators.structure import heterodimer_screen, longest_oligo, oligo_catalog
from ..profiles import STRICT_AMPLICON, QcProfile
from ..session import cut_lineage


@dataclass(frozen=True)
class PairQc:
    hits: DataFrame
    amplicons: DataFrame
    rollup: DataFrame
    results: DataFrame


def pair_oligos(pairs: DataFrame) -> DataFrame:
    """Distinct oligos of all pairs."""
    return pairs.select(F.explode(F.array("f_seq", "r_seq")).alias("sequence")).distinct()


def profile_hits(hits: DataFrame, profile: QcProfile) -> DataFrame:
    """The alignment cap, then the profile's limits, in the order the search applies them."""
    return hit_filter(hit_cap(hits, profile.max_alignments), profile.min_identity, profile.min_length)


def pair_qc(
    pairs: DataFrame, tiles: DataFrame | None, profile: QcProfile = STRICT_AMPLICON,
    hits: DataFrame | None = None, searched: DataFrame | None = None, keep_hits: bool = True,
) -> PairQc:
    """Judge primer pairs.  ``hits`` may come from elsewhere; otherwise ``tiles`` are searched.

    Hits of an external search (those with ``qseqid`` and no ``sequence``, as ``hit_tsv_scan`` reads them) are resolved
    by name to pairs and sides; that search has capped them already, so only the profile's limits are applied.
    Distinct oligos and hits are used several times, so they are written once to the shared folder; a
    lost executor then does not start the search over the reference again.
    """
    oligos = cut_lineage(pair_oligos(pairs))
    longest = longest_oligo(oligos)
    if hits is None:
        if tiles is None:
            raise ValueError("either tiles or hits are needed")
        hits = seed_extend_hits(oligos, tiles, min_identity=min(80.0, profile.min_identity), min_length=0, max_length=longest)
    if "qseqid" in hits.columns and "sequence" not in hits.columns:
        return _external_qc(pairs, hits, oligos, longest, profile, searched)
    used = profile_hits(hits, profile)
    if keep_hits:
        used = cut_lineage(used)
    amplicons = all_amplicons(hits_by_pair(used, pairs), profile)
    rollup = amplicon_rollup(amplicons)
    assembled = qc_pair_assembly(
        pairs, oligo_catalog(oligos, longest), heterodimer_screen(pairs, longest), hit_counts(used, oligos), amplicon_total(rollup)
    )
    judged = final_result(qc_flags(search_status(assembled, searched), profile), profile)
    return PairQc(used, amplicons, rollup, judged)


def _external_qc(
    pairs: DataFrame, hits: DataFrame, oligos: DataFrame, longest: int, profile: QcProfile, searched: DataFrame | None
) -> PairQc:
    key = ["pair_id", "f_seq", "r_seq"]
    used = cut_lineage(resolve_hits(hit_filter(hits, profile.min_identity, profile.min_length), pairs))
    amplicons = all_amplicons(used, profile, key)
    rollup = amplicon_rollup(amplicons, key)
    assembled = qc_pair_assembly(
        pairs, oligo_catalog(oligos, longest), heterodimer_screen(pairs, longest), pair_hit_counts(used),
        amplicon_total(rollup, key),
    )
    judged = final_result(qc_flags(search_status(assembled, searched), profile), profile)
    return PairQc(used, amplicons, rollup, judged)
