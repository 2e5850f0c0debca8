from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ampliq.constants import DESIGN_DEFAULTS
from ampliq.operators.bisulfite import methylation_join
from ampliq.operators.design import (
    PAIR_ORDER, any_primers, bounded_pairs, oligo_candidates, pair_candidates, pair_topn, param_defaults, primer_candidates,
    probe_candidates, probe_primer_join, with_longest, with_tm_gc,
)
from ampliq.operators.ranking import candidate_rank_top
from ampliq.operators.windows import fetch_intervals, subseq_fetch, template_window_fetch
from ampliq.plans import region_design, score_rank_job
from ampliq.plans.region_design import design_amplicons, failed_regions, region_templates
from ampliq.sinks import thresholds_table
from ampliq.sources import contig_tiles, fasta_tile_scan, hit_tsv_scan, region_table_scan

from .plain import dna, hits, melting, rc, stem


@pytest.fixture(scope="module")
def contigs():
    return [(f"c{i}", dna(2500 + 13 * i, 900 + i)) for i in range(3)]


@pytest.fixture(scope="module")
def regions(spark):
    rows = [("c0", 500, 519, "one"), ("c1", 1000, 1010, " "), ("c2", 60, 70, None), ("c2", 2500, 2520, "end")]
    return region_table_scan(spark.createDataFrame(rows, "chrom string, start long, end long, name string"))


def _tiles(spark, contigs, **kw):
    return contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), **kw)


def test_region_table_needs_its_columns(spark):
    with pytest.raises(ValueError, match="end"):
        region_table_scan(spark.createDataFrame([("c", 1)], "chrom string, start long"))


def test_windows(spark, contigs, regions):
    got = {r.region_id: r for r in template_window_fetch(regions, _tiles(spark, contigs), 120).collect()}
    one = got["c0:500-519"]
    assert one.template == contigs[0][1][399:620] and (one.target_start_index, one.target_end_index) == (100, 120)
    assert got["c2:60-70"].error and got["c2:60-70"].template is None
    assert got["c2:2500-2520"].template == contigs[2][1][2400:2620]
    assert got["c1:1000-1010"].name is None


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_fetch_both_ways(spark, contigs, broadcast_rows):
    rows = [(i, "c1", s, e) for i, (s, e) in enumerate([(0, 1), (60, 70), (63, 65), (5, 900), (2400, 9999)])]
    wanted = spark.createDataFrame(rows, "id int, chrom string, s long, e long")
    got = fetch_intervals(wanted, _tiles(spark, contigs, tile=64), ["id"], "s", "e", tile=64, broadcast_rows=broadcast_rows)
    assert {r.id: r.seq for r in got.collect()} == {i: contigs[1][1][s:e] for i, _, s, e in rows}


def test_subseq_is_one_based(spark, contigs):
    ranges = spark.createDataFrame([(1, "c0", 1, 3)], "id int, chrom string, start long, end long")
    assert subseq_fetch(ranges, _tiles(spark, contigs), ["id"]).first().seq == contigs[0][1][:3]


@pytest.mark.parametrize("split", [150, 1 << 20])
def test_fasta_tiles_over_many_splits(spark, contigs, tmp_path, split):
    """A contig that goes on over several file splits is put together as if there were one."""
    text = "".join(f">{c} note\n" + "\n".join(s[i:i + 60].lower() for i in range(0, len(s), 60)) + "\n" for c, s in contigs)
    (tmp_path / "ref.fa").write_text(text)
    (tmp_path / "other.fa").write_text(">z\nACGT\n>y\nAC\nGT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = fasta_tile_scan(spark, str(tmp_path), tile=128, lead=16, overlap=24)
        if split < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    every = [*contigs, ("z", "ACGT"), ("y", "ACGT")]
    want = contig_tiles(spark.createDataFrame(every, "chrom string, seq string"), tile=128, lead=16, overlap=24)
    assert rows == sorted(tuple(r) for r in want.select(*got.columns).collect())


@pytest.mark.parametrize("n, difference", [(1, 2.0), (40, 2.0), (400, 0.7), (100_000, 2.0), (5, 0.0)])
def test_bounded_pairs_equal_all_pairs(spark, contigs, regions, n, difference):
    templates = template_window_fetch(regions, _tiles(spark, contigs), 120).filter("template is not null")
    primers = primer_candidates(templates, DESIGN_DEFAULTS)

    def rows(df):
        return sorted((r.region_id, r.rank, r.l_seq, r.r_seq) for r in df.collect())

    whole = rows(pair_topn(pair_candidates(primers, 80, 120, difference), n))
    assert whole or not difference
    assert rows(bounded_pairs(primers, n, 80, 120, difference, 60.0, 25)) == whole


def test_pairs_by_brute_force(spark, contigs):
    t = contigs[0][1][:150]
    templates = spark.createDataFrame([("r", t, 0, 0)], "region_id string, template string, target_start_index int, target_end_index int")
    primers = any_primers(templates, (20, 21), (50.0, 70.0), (35.0, 65.0))
    got = pair_candidates(primers, 80, 100, 2.0, 60.0, 20, one_target=False)
    ok = []
    for n in (20, 21):
        for s in range(len(t) - n + 1):
            o = t[s:s + n]
            if 35 <= 100 * sum(b in "GC" for b in o) / n <= 65 and 50 <= melting(o) <= 70:
                ok.append((s, n, melting(o)))
    want = sorted(
        (a[0], a[1], b[0], b[1]) for a in ok for b in ok
        if 80 <= b[0] + b[1] - a[0] <= 100 and abs(a[2] - b[2]) <= 2 and a[0] + a[1] <= b[0]
    )
    assert want and sorted((r.l_start, r.l_len, r.r_start, r.r_len) for r in got.collect()) == want


def test_region_design_with_probes(spark, contigs, regions):
    rows = region_design(regions, _tiles(spark, contigs), {"n_probes": 3, "n_primers": 2}).collect()
    assert rows
    for r in rows:
        f, q, v = (r.forward_start_index, r.forward_end_index), (r.probe_start_index, r.probe_end_index), r.reverse_start_index
        assert q[0] <= r.target_start_index and q[1] + 1 >= r.target_end_index
        assert f[1] + 1 <= q[0] - 1 and v >= q[1] + 2
        assert r.probe_tm - 8 <= r.forward_tm <= r.probe_tm - 6
        assert r.template_sequence[f[0]:f[1] + 1] == r.forward_sequence and rc(r.reverse_sequence) in r.template_sequence
        assert 80 <= r.amplicon_length <= 120 and r.heterodimer_dg is not None and r.probe_hairpin_dg is not None


def test_bisulfite_design_counts_cpg_in_the_unconverted_template(spark, contigs, regions):
    rows = region_design(regions, _tiles(spark, contigs), {"n_probes": 0, "n_primers": 2, "bisulfite": True, "primer_min_gc": 0.0, "primer_min_tm": 40.0}).collect()
    assert rows
    for r in rows:
        ref, t = r.reference_template_sequence, r.template_sequence
        assert len(ref) == len(t) and all(a == b or (a, b) == ("C", "T") for a, b in zip(ref, t))
        assert "C" not in t[:-1].replace("CG", "")
        assert r.forward_cpg_count == ref[r.forward_start_index:r.forward_end_index + 2].count("CG")


def test_methylation_pattern_wins_over_default(spark):
    windows = spark.createDataFrame([("r", "c", 10, "ACGTCGCCGA"), ("s", "c", 500, "AACCA")], "region_id string, chrom string, window_start long, template_plus string")
    pattern = spark.createDataFrame([("c", 11, False), ("c", 14, True), ("c", 14, False), ("c", 17, True)], "chrom string, pos long, methylated boolean")
    assert {r.region_id: r.converted for r in methylation_join(windows, pattern).collect()} == {"r": "ATGTCGTCG", "s": "AATT"}
    assert {r.region_id: r.converted for r in methylation_join(windows, pattern, "unmethyl").collect()} == {"r": "ATGTCGTCG", "s": "AATT"}


def test_score_rank_by_brute_force(spark, contigs):
    """Every ranked amplicon is scored as the parts worked out by hand, and the pairs are the best ten."""
    jobs = spark.createDataFrame([("j", contigs[0][1][:160])], "job_id string, template string")
    tiles = _tiles(spark, contigs, lead=32, overlap=32)
    got = score_rank_job(jobs, tiles).collect()
    assert len(got) == 10 and [r.score for r in sorted(got, key=lambda r: r.position)] == sorted(r.score for r in got)

    def dg(x, y, kind):
        best = stem(x, y, kind)
        return abs(best[1]) * 1000 if best and best[1] < 0 else 0.0

    found = hits({o for r in got for o in (r.forward, r.reverse)}, contigs)
    for r in got:
        off = {o: max(0, sum(h[0] == o for h in found) - 1) for o in (r.forward, r.reverse)}
        want = sum(dg(o, o, k) for o in (r.forward, r.reverse) for k in ("homodimer", "hairpin"))
        want += dg(r.forward, r.reverse, "heterodimer") + 3 * off[r.forward] + 3 * off[r.reverse]
        assert r.score == pytest.approx(want, abs=1e-6)


def test_params_and_thresholds(spark):
    asked = spark.createDataFrame([("q", None, 33)], "id string, n_primers int, probe_min_length int")
    row = param_defaults(asked).first()
    assert (row.n_primers, row.probe_min_length, row.primer_max_length) == (100, 33, 30)
    assert {tuple(r) for r in thresholds_table(asked).collect()} == {("id", "q"), ("probe_min_length", "33")}


def test_twelve_column_hits_fail_on_another_width(spark, tmp_path):
    good = "\t".join(["q", "s", "90.0", "20", "0", "0", "1", "20", "5", "24", "0.1", "30"])
    (tmp_path / "good").write_text(good + "\n\n")
    assert hit_tsv_scan(spark, str(tmp_path / "good"), 12).count() == 1
    (tmp_path / "bad").write_text(good + "\textra\n")
    with pytest.raises(Exception, match="12 columns"):
        hit_tsv_scan(spark, str(tmp_path / "bad"), 12).select(F.sum("length")).collect()


def test_repeated_and_unknown_regions(spark):
    text = "ACGT" * 200
    tiles = _tiles(spark, [("c", text)])
    rows = [("a", "c", 300, 310), ("a2", "c", 300, 310), ("b", "x", 300, 310), ("d", "c", 5000, 5010), ("e", "c", 10, 20)]
    regions = spark.createDataFrame(rows, "region_id string, chrom string, start long, end long")
    twice = regions.unionByName(regions.filter("region_id = 'a'"))
    got = template_window_fetch(twice, tiles, 120).collect()
    assert len(got) == 6
    assert {r.template for r in got if r.region_id in ("a", "a2")} == {text[190:420]}
    assert {r.region_id: r.error for r in got if r.error} == {
        "b": "contig unknown or window behind its end", "d": "contig unknown or window behind its end",
        "e": "window starts before the contig",
    }


def test_regions_that_share_an_id_are_kept_apart(spark):
    seq = dna(400, 3)
    rows = [("same", "c", 150, 160), ("same", "c", 150, 160), ("same", "c", 200, 215), ("same", "c", 5, 9), ("own", "c", 180, 190), (None, "c", 170, 175)]
    regions = region_table_scan(spark.createDataFrame(rows, "region_id string, chrom string, start long, end long"))
    tiles = _tiles(spark, [("c", seq)])
    got = {r.region_id: (r.start, r.end) for r in region_templates(regions, tiles, DESIGN_DEFAULTS).collect()}
    assert got == {"same c:150-160": (150, 160), "same c:200-215": (200, 215), "own": (180, 190), "c:170-175": (170, 175)}
    assert [r.region_id for r in failed_regions(regions, tiles).collect()] == ["same c:5-9"]


def test_primers_by_sums_equal_primers_one_by_one(spark, contigs):
    """Sums along the template give what each oligo gives by itself, to the last bit, unclear letters and palindromes included."""
    texts = [contigs[0][1][:400], "ACGT" * 30, "AC" * 20 + "NNACGTRY" + dna(90, 3) + "n" + dna(40, 4).lower() + dna(60, 5), "GAATTC" * 12, "A", ""]
    rows = [(f"r{i}", t, 60, 75) for i, t in enumerate(texts)]
    templates = spark.createDataFrame(rows, "region_id string, template string, target_start_index int, target_end_index int")
    p = {**DESIGN_DEFAULTS, "primer_min_length": 18, "primer_min_tm": 20.0, "primer_max_tm": 90.0, "primer_min_gc": 0.0, "primer_max_gc": 100.0}
    got = {(r.region_id, r.role, r.start, r.len): (r.sequence, r.gc, r.tm) for r in primer_candidates(templates, p).collect()}
    oligos = with_tm_gc(oligo_candidates(templates, 18, 30), 30)
    want = {
        (r.region_id, r.role, r.start, r.len): (r.sequence, r.gc, r.tm) for r in oligos.collect()
        if (r.start + r.len <= 60 if r.role == "left" else r.start >= 76) and 20 <= r.tm <= 90
    }
    assert want and got == want


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidate_oligos_carry_no_code(spark, contigs):
    """Nothing reads the two-bit code of a plain candidate, so it is not worked out for each of them."""
    templates = spark.createDataFrame([("r", contigs[0][1][:90], 40, 50)], "region_id string, template string, target_start_index int, target_end_index int")
    got = oligo_candidates(templates, 20, 30)
    assert "conv(" not in _plan(got)
    assert got.count() == 2 * sum(90 - n + 1 for n in range(20, 31))


def test_no_pair_is_looked_up_for_its_bound(spark, contigs, regions):
    """The bound comes with the left primer: one join makes the pairs, and two lookups the primers of both sides."""
    templates = template_window_fetch(regions, _tiles(spark, contigs), 120).filter("template is not null")
    best = bounded_pairs(primer_candidates(templates, DESIGN_DEFAULTS), 5, 80, 120, 2.0, 60.0, 25)
    assert _plan(best).count("Join ") == 3
    assert "bound" not in best.columns and best.count() > 0


def test_windows_are_fetched_once_for_the_pattern(spark, contigs, regions):
    """The plan reads written windows, not the reference, at each of their uses."""
    windows = template_window_fetch(regions, _tiles(spark, contigs), 120, look_ahead=1)
    pattern = spark.createDataFrame([("c0", 450, False)], "chrom string, pos long, methylated boolean")
    got = methylation_join(windows, pattern)
    assert "tile" not in _plan(got.select("region_id", "converted"))
    assert got.count() == windows.count()


def test_places_are_read_once_for_all_lengths(spark):
    """Codes come along with the oligos; letters that are no bases, also such of several bytes, spoil only what holds them."""
    texts = [dna(60, 71), dna(25, 72) + "N" + dna(40, 73), dna(23, 74) + "x" + dna(30, 75) + "\u00e9" + dna(28, 76), "ACGT" * 3]
    rows = [("r", t, 30, 40) for t in texts] + [("r", texts[0], 30, 40)]
    templates = spark.createDataFrame(rows, "region_id string, template string, target_start_index int, target_end_index int")
    oligos = oligo_candidates(templates, 20, 30)
    assert "_code" in oligos.columns
    want = sorted(
        (role, i, n, s if role == "left" else rc(s)) for _, t, _, _ in rows for n in range(20, 31) for i in range(len(t) - n + 1)
        for s in [t[i:i + n]] if not set(s) - set("ACGT") for role in ("left", "right"))
    got = with_tm_gc(oligos, 30).collect()
    assert sorted((r.role, r.start, r.len, r.sequence) for r in got) == want
    for r in got[::29]:
        assert r.tm == pytest.approx(melting(r.sequence), abs=1e-9)
    probes = probe_candidates(templates, {**DESIGN_DEFAULTS, "probe_min_tm": 0.0, "probe_max_tm": 99.0, "probe_min_gc": 0.0, "probe_max_gc": 100.0})
    covering = sorted((i, n, s) for role, i, n, s in want if role == "left" and i <= 30 and i + n >= 40)
    assert sorted((r.start, r.len, r.sequence) for r in probes.collect()) == covering


def test_ten_shortest_products_need_few_pairs(spark):
    rows = [(f"r{k}", dna(240, 800 + k), 110, 130) for k in range(3)] + [("none", "AT" * 120, 110, 130)]
    templates = spark.createDataFrame(rows, "region_id string, template string, target_start_index int, target_end_index int")
    primers = primer_candidates(templates, DESIGN_DEFAULTS)
    every = pair_candidates(primers, 80, 120)
    few = pair_candidates(with_longest(primers, 10, 80, 120), 80, 120)
    assert "longest" not in few.columns and 0 < few.count() < every.count() / 4
    tops = [candidate_rank_top(p, ["product_size", *PAIR_ORDER]).select(sorted(every.columns + ["rank"])).collect() for p in (every, few)]
    assert sorted(tops[0]) == sorted(tops[1]) and len(tops[0]) == 30
    # Where counts prove too few pairs, all are made.
    assert pair_candidates(with_longest(primers, 10**9, 80, 120), 80, 120).count() == every.count()


def test_fasta_lines_in_short_runs(spark, tmp_path, contigs):
    """Runs of lines may end anywhere: within contigs, before headers and at blank lines."""
    lines = []
    for name, seq in contigs:
        lines += [f">{name} note", *[seq[i:i + 60] for i in range(0, len(seq), 60)], ""]
    (tmp_path / "a.fa").write_text("\n".join(lines))
    want = sorted(_tiles(spark, contigs, tile=128, lead=16, overlap=24).select("chrom", "tile", "lead", "core_len", "seq").collect())
    for run in (1, 7):
        got = fasta_tile_scan(spark, str(tmp_path), tile=128, lead=16, overlap=24, lines_at_once=run)
        assert sorted(got.select("chrom", "tile", "lead", "core_len", "seq").collect()) == want


def test_no_primers_are_gathered_on_the_driver(spark):
    """A few templates give very many primers; the joins must not broadcast them by the size of the templates."""
    text = dna(240, 77)
    templates = spark.createDataFrame([("r", text, 110, 130)], "region_id string, template string, target_start_index int, target_end_index int")
    primers, probes = primer_candidates(templates, DESIGN_DEFAULTS, (52.0, 59.0)), probe_candidates(templates, DESIGN_DEFAULTS)
    made = [
        probe_primer_join(probes, primers, DESIGN_DEFAULTS, 80, 120), pair_candidates(primers, 80, 120),
        design_amplicons(templates, {**DESIGN_DEFAULTS, "n_probes": 2}),
    ]
    assert not [df for df in made if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]
