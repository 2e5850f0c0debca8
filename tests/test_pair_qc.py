from __future__ import annotations

from dataclasses import replace

import pytest

from ampliq.operators.binding import binding_window, pair_alignment_rows
from ampliq.operators.qc import final_result, qc_flags
from ampliq.plans import pair_qc
from ampliq.profiles import ALL_FLAGS, PROFILES, STRICT_AMPLICON
from ampliq.sources import contig_tiles, pair_tsv_scan
from pyspark.sql import functions as F

from .plain import dna, melting, rc


def test_pair_tsv(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("Forward_Primer\tx\ty\tz\nF\t acgt \tR\tTTTT\tmore\nshort\tA\tB\nP\tA+C\tR\tG\nS\tAC\tS\tGG\n")
    rows = [(r.f_name, r.f_seq, r.r_name, r.r_seq) for r in pair_tsv_scan(spark, str(tmp_path / "p.tsv")).collect()]
    assert rows == [("F", "ACGT", "R", "TTTT"), ("S", "AC", "S", "GG")]


def test_whole_qc(spark):
    """Equal names, a repeated pair, a pair without hits, and a failed search."""
    seq = dna(900, 42)
    f, r = seq[100:120], rc(seq[200:220])
    rows = [(1, "same", f, "same", r), (2, "F", f, "R", r), (3, "F3", "ACACACACACACACACACAC", "R3", "GTTGGTTGGTTGGTTGGTTG")]
    pairs = spark.createDataFrame(rows, "pair_id long, f_name string, f_seq string, r_name string, r_seq string")
    tiles = contig_tiles(spark.createDataFrame([("c", seq)], "chrom string, seq string"), lead=32, overlap=32)
    searched = spark.createDataFrame([(1, True), (2, False)], "pair_id long, ok boolean")
    got = {x.pair_id: x for x in pair_qc(pairs, tiles, STRICT_AMPLICON).results.collect()}
    assert (got[1].f_hits, got[1].r_hits, got[1].amplicons, got[1].min_size) == (1, 1, 1, 101 + 40)
    assert got[1].info == "FR:c:120(+)-220(-)(141bp)" and got[2].info == got[1].info
    assert got[1].f_tm == pytest.approx(melting(f)) and got[1].qc_amplicon == "X" and got[1].final_result == "FAIL"
    assert (got[3].f_hits, got[3].amplicons, got[3].min_size, got[3].info) == (0, 0, None, "")
    failed = {x.pair_id: x for x in pair_qc(pairs, tiles, ALL_FLAGS, searched=searched).results.collect()}
    assert (failed[1].f_hits, failed[1].qc_hit, failed[1].qc_amplicon) == (1, "0", "x")
    for i in (2, 3):
        assert (failed[i].f_hits, failed[i].amplicons, failed[i].qc_hit, failed[i].qc_amplicon) == (-1, -1, "x", "x")


@pytest.mark.parametrize("profile,result", [(STRICT_AMPLICON, "PASS"), (ALL_FLAGS, "FAIL")])
def test_only_one_profile_counts_hits_in_the_result(spark, profile, result):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {
        "f_tm": 60.0, "r_tm": 63.0, "f_hairpin_dg": -5.0, "r_hairpin_dg": 0.0, "f_homodimer_dg": -6.0, "r_homodimer_dg": 0.0,
        "heterodimer_dg": -6.0, "f_hits": 2, "r_hits": 1, "amplicons": 0, "search_ok": True}.items()])
    got = final_result(qc_flags(row, profile), profile).first()
    assert got.final_result == result and got.qc_hit == profile.bad and got.qc_tm_diff == profile.good
    tight = replace(profile, tm_diff_max=2.9)
    assert final_result(qc_flags(row, tight), tight).first().final_result == "FAIL"
    assert PROFILES[profile.name] is profile


def test_binding_window_falls_back(spark):
    rows = [("c", 50, 70, "primer_1", "ACGT", "+", "g"), ("c", 90, 95, "target", "A", "+", "g"), ("c", 100, 120, "primer_2", "AAGG", "-", "g"),
            ("c", 10, 20, "other", "A", "+", "h"), ("c", 40, 45, "target", "A", "+", "h")]
    got = {r.grp: r for r in binding_window(spark.createDataFrame(rows, "chrom string, start int, end int, name string, sequence string, strand string, grp string"), 5).collect()}
    assert (got["g"].win_start, got["g"].win_end, got["g"].primer_2) == (45, 125, "GGAA")
    assert (got["h"].win_start, got["h"].win_end) == (5, 50)


@pytest.mark.parametrize("offset,line,match", [(1, " ACT ", " || "), (-1, "CT   ", "    "), (3, "   AC", "    ")])
def test_alignment_lines(spark, offset, line, match):
    lines = pair_alignment_rows(F.lit("GACGT"), F.lit("ACT"), F.lit(offset), "p", "ref")
    row = spark.range(1).select(*[v.alias(k) for k, v in lines.items()]).first()
    assert row.line_primer == "p: " + line and row.line_ref == "ref: GACGT"
    assert row.line_match.startswith("   " + match)
