"""Primer records read from text."""

from __future__ import annotations

import pytest

from ampliq.sources import bed_record_scan

GOOD = "chr1\t149\t169\tprimer_1\tac gT\t+\tg1\n"


def test_bed_records(spark, tmp_path):
    path = tmp_path / "good.bed"
    path.write_text(GOOD + "chr1\t 229\t249 \tprimer_2\tTTG\t-\tg1\n")
    rows = bed_record_scan(spark, str(path)).orderBy("start").collect()
    assert [tuple(r) for r in rows] == [
        ("chr1", 149, 169, "primer_1", "ACGT", "+", "g1"), ("chr1", 229, 249, "primer_2", "TTG", "-", "g1")]


@pytest.mark.parametrize("bad", ["x", "", "1e", "99999999999"])
def test_bad_numbers_are_refused(spark, tmp_path, bad):
    path = tmp_path / "bad.bed"
    path.write_text(GOOD + f"chr1\t{bad}\t249\tprimer_2\tTTG\t-\tg1\n")
    with pytest.raises(Exception, match="bad start in a primer record"):
        bed_record_scan(spark, str(path)).collect()
