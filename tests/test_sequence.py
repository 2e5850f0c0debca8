from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ampliq.functions import hits as H
from ampliq.functions import sequence as S


def one(spark, schema, row, **exprs):
    df = spark.createDataFrame([row], schema)
    return df.select(*[v.alias(k) for k, v in exprs.items()]).first()


def test_revcomp_keeps_case_and_n_and_is_its_own_inverse(spark):
    s = F.col("s")
    row = one(spark, "s string", ("ACGTNacgtn",), rc=S.revcomp(s), back=S.revcomp(S.revcomp(s)))
    assert row.rc == "nacgtNACGT" and row.back == "ACGTNacgtn"


def test_gc_modes(spark):
    row = one(spark, "s string", ("GCNNATAT",), rm=S.gc_percent(F.col("s")), ig=S.gc_percent(F.col("s"), "ignore"))
    assert row.rm == pytest.approx(100 * 2 / 6) and row.ig == 25.0
    assert one(spark, "s string", ("NNN",), g=S.gc_percent(F.col("s"))).g == 0.0
    with pytest.raises(ValueError):
        S.gc_percent(F.col("s"), "other")


def test_locate_takes_the_literal_text_first(spark):
    # The oligo's own text stands before the place where it would bind as a reverse primer.
    a, b = S.locate_oligo(F.col("t"), F.col("o"))
    row = one(spark, "t string, o string", ("GGAACCTTTTGGTTCC", "AACC"), a=a, b=b)
    assert (row.a, row.b) == (2, 5)
    row = one(spark, "t string, o string", ("GGGGGGTT", "AACC"), a=a, b=b)
    assert (row.a, row.b) == (4, 7)
    row = one(spark, "t string, o string", ("GGGG", "AACC"), a=a, b=b)
    assert row.a is None and row.b is None


@pytest.mark.parametrize("strand,start,end,cpg,non", [
    ("forward", 0, 1, 1, 0),   # CG at the first base
    ("forward", 4, 5, 1, 1),   # the base after the span makes a CG: C at 5, G at 6
    ("reverse", 6, 7, 1, 0),   # the base before the span makes it
    ("reverse", 0, 1, 1, 0),   # no base before index 0: counted inside the span
])
def test_cpg_counts_reach_one_base_out(spark, strand, start, end, cpg, non):
    args = (F.col("r"), F.col("st"), F.col("a"), F.col("b"))
    row = one(spark, "r string, st string, a int, b int", ("CGAACCGTAA", strand, start, end),
              c=S.cpg_count(*args), n=S.non_cpg_c_count(*args))
    assert (row.c, row.n) == (cpg, non)


def test_bisulfite_drops_the_look_ahead_base(spark):
    row = one(spark, "s string", ("CCGTCACG",), m=S.bisulfite_convert(F.col("s")), u=S.bisulfite_convert(F.col("s"), "unmethyl"))
    assert row.m == "TCGTTAC" and row.u == "TTGTTAT"
    with pytest.raises(ValueError):
        S.bisulfite_convert(F.col("s"), "both")


def test_three_prime(spark):
    args = (F.col("r"), F.col("st"), F.col("a"), F.col("b"), F.col("t"))
    schema = "r string, st string, a int, b int, t string"
    assert one(spark, schema, ("AACCGGTA", "forward", 2, 5, "GG"), x=S.three_prime_is(*args)).x
    assert one(spark, schema, ("AACCGGTA", "reverse", 2, 5, "GG"), x=S.three_prime_is(*args)).x
    assert not one(spark, schema, ("AACCGGTA", "reverse", 2, 5, "CC"), x=S.three_prime_is(*args)).x


def test_strand_and_anchor(spark):
    a, b = F.col("a"), F.col("b")
    assert tuple(one(spark, "a int, b int", (10, 29), s=H.hit_strand(a, b), p=H.hit_anchor(a, b))) == ("+", 29)
    assert tuple(one(spark, "a int, b int", (29, 10), s=H.hit_strand(a, b), p=H.hit_anchor(a, b))) == ("-", 29)


def test_annotation_with_gap_and_offset(spark):
    full, mask = H.full_annotation(F.col("p"), F.col("q"), F.col("a"), F.col("b"))
    row = one(spark, "p string, q int, a string, b string", ("ACGTACGT", 2, "CG-TA", "CTATA"), f=full, m=mask)
    assert row.f == "ACgTACGT" and row.m == " |x||   "
    line = H.ref_aligned_line(F.col("a"), F.col("b"), F.lit(2), F.lit(8))
    assert one(spark, "a string, b string", ("CG-TA", "CTATA"), l=line).l == "  CgTA  "
