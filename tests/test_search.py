from __future__ import annotations

import pytest

from ampliq.operators.search import (
    _packed_seeds, hit_cap, hit_counts, offtarget_counts, oligo_seeds, seed_extend_hits,
)
from ampliq.sources.fasta import contig_tiles

from .plain import dna, hits, rc


def _fixture(n: int):
    contigs = [("a", dna(700, 1)), ("b", dna(90, 2) + "NN" + dna(200, 3)), ("c", dna(n, 4))]
    a = contigs[0][1]
    bent = list(a[100:100 + n])
    bent[3] = "A" if bent[3] != "A" else "C"
    contigs.append(("d", dna(40, 5) + "".join(bent) + dna(9, 6) + rc(a[100:100 + n])))
    contigs.append(("e", "ACGTACGT" * 40))
    oligos = [a[100:100 + n], rc(a[300:300 + n]), a[50:50 + n - 2], ("ACGTACGT" * 6)[:n], contigs[2][1],
              "N" + a[101:100 + n], contigs[1][1][85:85 + n]]
    return oligos, contigs


@pytest.mark.parametrize("n", [20, 31, 40])
@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_search_matches_brute_force(spark, n, broadcast_rows):
    """Coded (to 31 bases) and letter-by-letter ways, with broadcast and with salted shuffle."""
    oligos, contigs = _fixture(n)
    tiles = contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), tile=64, lead=n, overlap=n)
    frame = spark.createDataFrame([(o,) for o in oligos], "sequence string")
    got = seed_extend_hits(frame, tiles, broadcast_rows=broadcast_rows).select(
        "sequence", "strand", "chrom", "start", "pident", "sseq").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == hits(oligos, contigs)


def test_one_long_oligo_among_short_ones(spark):
    oligos, contigs = _fixture(20)
    oligos.append(contigs[0][1][400:432])
    tiles = contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), tile=64, lead=32, overlap=32)
    got = seed_extend_hits(spark.createDataFrame([(o,) for o in oligos], "sequence string"), tiles)
    assert {tuple(r) for r in got.select("sequence", "strand", "chrom", "start", "pident", "sseq").collect()} == hits(oligos, contigs)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [20, 31])
def test_more_seeds_than_are_broadcast_at_once(spark, n):
    """Further seeds come in rounds; the bases of the reference meet no shuffled join, and the hits are the same."""
    oligos, contigs = _fixture(n)
    tiles = contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), tile=64, lead=n, overlap=n)
    got = seed_extend_hits(spark.createDataFrame([(o,) for o in oligos], "sequence string"), tiles, broadcast_rows=60)
    assert "Join" not in _plan(got)
    rows = [tuple(r) for r in got.select("sequence", "strand", "chrom", "start", "pident", "sseq").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == hits(oligos, contigs)


def test_a_packed_seed_is_one_number(spark):
    """What is broadcast takes eight bytes a seed, not a record."""
    frame = spark.createDataFrame([("ACGTTGCAAC" * 3 + "G",), ("GATTACAGATTACAGATTACA",)], "sequence string")
    packed = _packed_seeds(oligo_seeds(frame), 8, False)
    assert packed.schema["_seeds"].dataType.simpleString() == "array<bigint>"
    assert packed.selectExpr("sum(size(_seeds))").first()[0] == 2 * (24 + 14)


@pytest.mark.parametrize(("lengths", "kind"), [((20, 20), "int"), ((18, 20), "int"), ((18, 25), "bigint"), ((31, 31), "bigint")])
def test_a_seed_takes_four_bytes_where_it_fits(spark, lengths, kind):
    """Half as much goes through the driver; lengths, offsets and strands come back from either kind of number."""
    contigs = [("a", dna(700, 1)), ("b", rc(dna(700, 1)[200:400])), ("c", "ACGTACGT" * 40)]
    oligos = [contigs[0][1][at:at + n] for at, n in ((0, lengths[0]), (230, lengths[1]), (231, lengths[1]), (700 - lengths[0], lengths[0]))]
    oligos += [rc(oligos[1]), ("ACGTACGT" * 6)[:lengths[1]]]
    frame = spark.createDataFrame([(o,) for o in oligos], "sequence string")
    packed = _packed_seeds(oligo_seeds(frame), 8, False, *lengths)
    assert packed.schema["_seeds"].dataType.simpleString() == f"array<{kind}>"
    assert packed.selectExpr("min(array_min(_seeds)) >= 0").first()[0]
    tiles = contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), tile=64, lead=31, overlap=31)
    for longest in (None, 31):
        got = seed_extend_hits(frame, tiles, max_length=longest).select("sequence", "strand", "chrom", "start", "pident", "sseq").collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == hits(oligos, contigs)


def test_cap_ranks_once(spark):
    """Up to 1,000 alignments an oligo, one exchange and one ranking do, as every task cuts its own rows first."""
    found = spark.range(5000).selectExpr("concat('o', id div 9999) AS sequence", "double(90) AS pident", "'c' AS chrom", "id AS start", "'+' AS strand")
    assert _plan(hit_cap(found, 200)).count("Window [") == 1
    assert "WindowGroupLimit" in _plan(hit_cap(found, 200))
    for limit in (200, 1500):
        assert [r.start for r in hit_cap(found, limit).orderBy("start").collect()] == list(range(limit))


def test_cap_and_counts(spark):
    oligos, contigs = _fixture(20)
    tiles = contig_tiles(spark.createDataFrame(contigs, "chrom string, seq string"), tile=64, lead=20, overlap=20)
    frame = spark.createDataFrame([(o,) for o in oligos] + [("T" * 20,)], "sequence string")
    found = seed_extend_hits(frame, tiles)
    want = {}
    for h in hits(oligos, contigs):
        want[h[0]] = want.get(h[0], 0) + 1
    counts = {r.sequence: r.hits for r in hit_counts(found, frame).collect()}
    assert counts == {o: want.get(o, 0) for o in set(oligos) | {"T" * 20}}
    off = {r.sequence: r.offtargets for r in offtarget_counts(found, frame).collect()}
    assert off == {o: max(0, c - 1) for o, c in counts.items()}
    capped = {r.sequence: r.hits for r in hit_counts(hit_cap(found, 5), frame).collect()}
    assert capped == {o: min(5, c) for o, c in counts.items()}


def test_tiles_without_reach_are_refused(spark):
    tiles = spark.createDataFrame(
        [("c", 0, 0, 0, "ACGTACGTAC" * 3, 30), ("c", 1, 30, 0, "GGCCTTAAGG" * 3, 30)],
        "chrom string, tile int, tile_start long, lead int, seq string, core_len int",
    )
    oligos = spark.createDataFrame([("ACGTACGTACGGCCTTAAGG",)], "sequence string")
    with pytest.raises(ValueError, match="tiles need lead 12 and overlap 19"):
        seed_extend_hits(oligos, tiles)


def _longest_method(df) -> int:
    """Bytes of the longest method that Spark makes for a plan; the JVM does not compile one of more than 8,000."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    return max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size()))


@pytest.mark.parametrize(("sizes", "letters"), [((20,), "ACGT"), ((18, 20), "ACGT"), ((18, 25), "ACGT"), ((20,), "ACGN")])
def test_candidates_are_checked_by_compiled_code(spark, sizes, letters):
    """What a candidate goes through is compiled, and neighbouring places share what is read for them."""
    text = dna(300, 61)
    oligos = [text[40 + 7 * k:40 + 7 * k + n] for k in range(6) for n in sizes] + [rc(text[150:150 + sizes[0]])]
    if "N" in letters:
        text = text[:200] + "N" + text[201:]
        oligos = [o[:4] + "N" + o[5:] for o in oligos] + [text[195:215]]
    tiles = contig_tiles(spark.createDataFrame([("c", text), ("d", text[41:75]), ("e", text[100:107])], "chrom string, seq string"), tile=64, lead=32, overlap=32)
    got = seed_extend_hits(spark.createDataFrame([(o,) for o in oligos], "sequence string"), tiles)
    assert _longest_method(got) < 8000
    want = hits(oligos, [("c", text), ("d", text[41:75]), ("e", text[100:107])])
    assert want and {tuple(r) for r in got.select("sequence", "strand", "chrom", "start", "pident", "sseq").collect()} == want
