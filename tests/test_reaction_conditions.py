from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ampliq.constants import REACTION_CONDITIONS
from ampliq.operators import structure
from ampliq.operators.structure import hairpin_screen, homodimer_screen, reaction_catalog, thermo_catalog

from . import plain
from .plain import dna, rc

COLUMNS = "sequence string, salt_monovalent_conc double, salt_divalent_conc double, dntp_conc double, dna_conc double"


def _melting(s, ln_salt, molar):
    dh = sum(plain.NN_DH[s[j:j + 2]] for j in range(len(s) - 1))
    ds = sum(plain.NN_DS[s[j:j + 2]] for j in range(len(s) - 1))
    for end in (s[0], s[-1]):
        dh += 23 if end in "AT" else 1
        ds += 41 if end in "AT" else -28
    itself = s == rc(s)
    ds -= 14 if itself else 0
    return dh * 100 / (ds / 10 + 0.368 * (len(s) - 1) * ln_salt + 1.987 * math.log(molar if itself else molar / 4)) - 273.15


def test_several_conditions_in_one_table(spark, monkeypatch):
    oligos = [dna(20, k) for k in range(6)] + ["ACGTTGCAACGTTGCAACGT", "GGGGCCCCAAAAGGGGCCCC", dna(45, 9)]
    mixes = [(50.0, 1.5, 0.6, 50.0), (100.0, 0.0, 0.0, 250.0), (10.0, 3.0, 0.8, 900.0), (50.0, 0.2, 0.6, 50.0)]
    rows = [(s, *m) for s in oligos for m in mixes] * 2 + [(None, 1.0, 1.0, 1.0, 1.0)]
    got = reaction_catalog(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(oligos) * len(mixes)
    for r in got:
        mono, div, dntp, dna_nm = (r[c] for c in REACTION_CONDITIONS)
        ln_salt = math.log((mono + 120 * math.sqrt(max(0, div - dntp))) / 1000)
        molar = dna_nm * 1e-9
        assert r.tm == pytest.approx(_melting(r.sequence, ln_salt, molar)) and r.length == len(r.sequence)
        assert r.gc_percent == pytest.approx(100 * sum(b in "GC" for b in r.sequence) / r.length)
        monkeypatch.setattr(plain, "LN_NA", ln_salt)
        for kind in ("hairpin", "homodimer"):
            best = plain.stem(r.sequence, r.sequence, kind)
            if best is None or best[1] >= 0:
                assert not r[kind] and r[f"{kind}_dg"] == 0 and r[f"{kind}_tm"] == 0
                continue
            _, dg, dh, e, _ = best
            strands = 1.987 * math.log(molar) if kind == "homodimer" else 0.0
            assert r[kind] and (r[f"{kind}_dg"], r[f"{kind}_dh"], r[f"{kind}_ds"]) == pytest.approx((dg, dh, e / 1000))
            assert r[f"{kind}_tm"] == pytest.approx(dh * 1000 / (e + strands) - 273.15)


def test_missing_conditions_are_the_defaults(spark):
    oligos = [dna(20, k) for k in range(4)] + ["ANGTTGCAACGTTGCAACGT", "A", ""]
    df = spark.createDataFrame([(s, None) for s in oligos], "sequence string, dntp_conc double")
    got = {r.sequence: r for r in reaction_catalog(df).collect()}
    plain_one = thermo_catalog(df).join(hairpin_screen(df), "sequence").join(homodimer_screen(df), "sequence").collect()
    assert len(got) == len(plain_one) == len(oligos)
    for want in plain_one:
        r = got[want.sequence]
        assert {c: r[c] for c in REACTION_CONDITIONS} == REACTION_CONDITIONS
        for c in ("tm", "hairpin_dg", "hairpin_dh", "hairpin_tm", "homodimer_dg", "homodimer_tm"):
            assert r[c] == (None if want[c] is None else pytest.approx(want[c]))
        assert (r.hairpin, r.homodimer) == (want.hairpin, want.homodimer)
    bare = reaction_catalog(spark.createDataFrame([(oligos[0], 0.0, 0.0, 0.0, 0.0)], COLUMNS)).collect()
    assert len(bare) == 1 and bare[0].tm is None
    assert reaction_catalog(df.filter(F.lit(False))).count() == 0


def test_stems_are_made_once_for_all_conditions(spark, monkeypatch):
    oligos = [dna(22, k) for k in range(4)]
    rows = [(s, mono, None, None, None) for s in oligos for mono in (10.0, 50.0, 200.0)]
    seen, made = [], structure._coded_stems

    def watched(duplexes, hairpin):
        seen.append(duplexes.count())
        return made(duplexes, hairpin)

    monkeypatch.setattr(structure, "_coded_stems", watched)
    got = reaction_catalog(spark.createDataFrame(rows, COLUMNS), 22).collect()
    assert len(got) == len(rows) and seen == [len(oligos)] * 2
