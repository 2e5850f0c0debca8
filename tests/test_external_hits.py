from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ampliq.operators.external_hits import resolve_hits
from ampliq.operators.search import seed_extend_hits
from ampliq.plans import pair_qc
from ampliq.plans.pair_qc import pair_oligos
from ampliq.profiles import ALL_FLAGS, STRICT_AMPLICON
from ampliq.sources import contig_tiles, hit_tsv_scan

from .plain import dna, rc

PAIRS = "pair_id long, f_name string, f_seq string, r_name string, r_seq string"


def _line(name, chrom, pident, length, sstart, send, texts=("ACGT", "ACGA")):
    fields = [name, chrom, pident, length, 0, 0, 1, length, sstart, send, 0.01, 30.2, *texts]
    return "\t".join(map(str, fields))


def test_external_hits_give_what_the_own_search_gives(spark, tmp_path):
    seq = dna(1500, 5)
    seq += rc(seq[100:120]) + dna(60, 6) + seq[400:420]
    rows = [(i, f"F{i}", seq[at:at + 20], f"R{i}", rc(seq[at + 90:at + 110])) for i, at in enumerate(range(100, 900, 100))]
    rows.append((50, "none", "ACACACACACACACACACAC", "nothing", "GTTGGTTGGTTGGTTGGTTG"))
    pairs = spark.createDataFrame(rows, PAIRS)
    tiles = contig_tiles(spark.createDataFrame([("c", seq)], "chrom string, seq string"), lead=32, overlap=32)
    names = {}
    for _, f_name, f, r_name, r in rows:
        names.setdefault(f, set()).add(f_name)
        names.setdefault(r, set()).add(r_name)
    found = seed_extend_hits(pair_oligos(pairs), tiles, min_length=0).collect()
    lines = [_line(n, h.chrom, h.pident, h.length, h.sstart, h.send, (h.qseq, h.sseq)) for h in found for n in names[h.sequence]]
    (tmp_path / "hits").write_text("\n".join(lines + ["too\tshort", _line("stranger", "c", 100.0, 20, 1, 20)]) + "\n")
    for profile in (STRICT_AMPLICON, ALL_FLAGS):
        own = pair_qc(pairs, tiles, profile).results
        other = pair_qc(pairs, None, profile, hits=hit_tsv_scan(spark, str(tmp_path / "hits"))).results
        order = sorted(own.columns)
        assert sorted(other.columns) == order
        assert sorted(other.select(order).collect(), key=lambda r: r.pair_id) == sorted(own.select(order).collect(), key=lambda r: r.pair_id)


def test_names_belong_to_pair_and_side(spark, tmp_path):
    """The same names in two pairs, searched apart; one name for both primers; a null name; a failed search."""
    a, b, c = (dna(20, s) for s in (1, 2, 3))
    pairs = spark.createDataFrame([(1, "F", a, "R", b), (2, "F", b, "R", c), (3, "both", a, "both", c), (4, None, a, "R4", b)], PAIRS)
    (tmp_path / "h").write_text("\n".join([
        _line("F", "x", 100.0, 20, 100, 119), _line("R", "x", 100.0, 20, 260, 241), _line("both", "x", 90.0, 20, 900, 881),
        _line("R4", "x", 79.9, 20, 5, 24), _line("both", "x", 90.0, 9, 5, 24),
    ]))
    read = hit_tsv_scan(spark, str(tmp_path / "h"))
    pair_of = F.when(F.col("qseqid") == "both", 3).when(F.col("qseqid") == "R4", 4).otherwise(1).cast("long")
    hits = read.withColumn("pair_id", pair_of)
    for max_rows in (200_000, 0):
        rows = {(r.pair_id, r.side, r.strand, r.anchor, r.begin) for r in resolve_hits(hits, pairs, max_rows).filter("pident >= 80 and length >= 10").collect()}
        assert rows == {(1, "F", "+", 119, 100), (1, "R", "-", 260, 241), (3, "F", "-", 900, 881), (3, "R", "-", 900, 881)}
    searched = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "pair_id long, ok boolean")
    got = {r.pair_id: r for r in pair_qc(pairs, None, STRICT_AMPLICON, hits=hits, searched=searched).results.collect()}
    assert [(got[i].f_hits, got[i].r_hits, got[i].amplicons) for i in (1, 2, 3, 4)] == [(1, 1, 1), (0, 0, 0), (1, 1, 0), (-1, -1, -1)]
    assert got[1].info == "FR:x:119(+)-260(-)(182bp)" and got[1].min_size == 142 + 40
    with pytest.raises(ValueError, match="several sequences"):
        resolve_hits(read, pairs)


def test_twelve_columns_and_no_hits(spark, tmp_path):
    a, b = dna(20, 1), dna(20, 2)
    pairs = spark.createDataFrame([(1, "F", a, "R", b), (2, "F", a, "R", b)], PAIRS)
    line = _line("F", "x", 100.0, 20, 100, 119, ())
    (tmp_path / "h").write_text("\n".join([line, line, _line("F", "x", 100.0, 20, 260, 241, ())]))
    got = pair_qc(pairs, None, STRICT_AMPLICON, hits=hit_tsv_scan(spark, str(tmp_path / "h"), 12)).results.collect()
    assert [(r.f_hits, r.r_hits, r.amplicons, r.min_size) for r in got] == [(2, 0, 1, 182)] * 2
    assert got[0].info == "F-SELF:x:119(+)-260(-)(182bp)|pident=100.0/100.0|qseq=|sseq_i=|sseq_j="
    (tmp_path / "none").write_text("")
    none = pair_qc(pairs, None, ALL_FLAGS, hits=hit_tsv_scan(spark, str(tmp_path / "none"))).results.collect()
    assert [(r.f_hits, r.amplicons, r.info) for r in none] == [(0, 0, "")] * 2
