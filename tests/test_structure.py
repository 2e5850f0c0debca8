from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ampliq.operators.design import with_tm_gc
from ampliq.operators.structure import screen_by, stem_screen, thermo_catalog

from .plain import dna, melting, rc, stem


def _duplexes(n: int, kind: str):
    out = []
    for i in range(12):
        x = dna(n - i % 3, 100 + i)
        if i % 4 == 0:
            x = x[:10] + rc(x[:6]) + x[16:]
        out.append((x, dna(n, 300 + i) if kind == "heterodimer" else x))
    out += [("A" * n, "A" * n), ("ACGT" * 5, "ACGT" * 5)]
    if kind == "heterodimer":
        out.append(("ACGTNNCCGGTT", "AACCGGNACGTA"))
    return out


@pytest.mark.parametrize("kind", ["homodimer", "heterodimer", "hairpin"])
@pytest.mark.parametrize("n", [22, 31, 45])
def test_screen_matches_brute_force(spark, kind, n):
    duplexes = _duplexes(n, kind)
    got = {(r.x, r.y): r for r in stem_screen(spark.createDataFrame(duplexes, "x string, y string"), kind).collect()}
    assert set(got) == set(duplexes)
    for (x, y), r in got.items():
        best = stem(x, y, kind)
        if best is None or best[1] >= 0:
            assert (r.found, r.dg, r.tm) == (False, 0.0, 0.0)
            continue
        assert r.found and (r.dg, r.dh, r.ds) == pytest.approx(best[1:4], abs=1e-9)


def test_both_ways_of_screening_agree(spark):
    df = spark.createDataFrame(_duplexes(24, "heterodimer"), "x string, y string")
    coded = sorted(stem_screen(df, "heterodimer", 24).collect())
    assert coded == sorted(stem_screen(df, "heterodimer", 60).collect())
    assert coded == sorted(screen_by(df.distinct(), "heterodimer", False).collect())


@pytest.mark.parametrize("kind", ["heterodimer", "hairpin"])
def test_long_oligos_among_short_ones(spark, kind):
    long = dna(200, 77)
    duplexes = [(long, rc(dna(30, 5)) + long[:90] if kind == "heterodimer" else long), *_duplexes(24, kind)]
    got = {(r.x, r.y): r for r in stem_screen(spark.createDataFrame(duplexes, "x string, y string"), kind).collect()}
    assert set(got) == set(duplexes)
    for (x, y), r in got.items():
        best = stem(x, y, kind)
        assert r.found == (best is not None and best[1] < 0)
        if r.found:
            assert (r.dg, r.dh, r.ds) == pytest.approx(best[1:4], abs=1e-9)


def test_melting_temperature(spark):
    oligos = [dna(n, n) for n in range(2, 45)] + ["ACGCGT", "AAAAAAAAAA"]
    frame = spark.createDataFrame([(o,) for o in oligos], "sequence string")
    got = {r.sequence: r.tm for r in thermo_catalog(frame).collect()}
    assert got == pytest.approx({o: melting(o) for o in set(oligos)}, abs=1e-9)
    short = frame.filter(F.length("sequence") <= 31)
    coded = {r.sequence: r.tm for r in with_tm_gc(short, 31).collect()}
    assert coded == pytest.approx({o: melting(o) for o in coded}, abs=1e-9)
    assert with_tm_gc(frame, 60).count() == len(oligos)


def test_one_base_has_no_temperature_and_ambiguous_steps_add_nothing(spark):
    frame = spark.createDataFrame([("A",), ("ACGNACG",)], "sequence string")
    got = {r.sequence: r.tm for r in thermo_catalog(frame).collect()}
    assert got["A"] is None and got["ACGNACG"] is not None
