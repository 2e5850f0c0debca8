"""Registered queries against their SQL at the smallest scale (the quick ones; ``python -m checks.verify`` runs all)."""

from __future__ import annotations

import os

import pytest

from checks.registry import QUERIES, SQL
from checks.verify import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = [
    "pair_tsv_scan", "bed_record_scan", "region_table_scan", "fasta_contig_scan", "fasta_tile_scan", "hit_tsv_scan", "gc_percent", "cpg_count",
    "non_cpg_c_count", "three_prime_is", "locate_oligo", "full_annotation", "ref_aligned_line", "bisulfite_convert", "param_defaults",
    "template_window_fetch", "tile_store_fetch", "subseq_fetch", "methylation_join", "homodimer_screen", "hairpin_screen", "heterodimer_screen", "thermo_catalog",
    "binding_window", "highlight_spans", "pair_alignment_rows", "seed_extend_hits", "fr_amplicon_join", "self_amplicon_join", "external_pair_qc", "reaction_catalog",
    "amplicon_row", "cpg_range", "bed_batch_design", "qc_pass_count", "candidate_view", "best_per_region", "probe_primer_append", "design_bundle_write",
]


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note
