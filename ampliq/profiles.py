"""The two rule sets of pair QC."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QcProfile:
    name: str
    min_identity: float
    min_length: int
    facing: bool
    add_oligo_lengths: bool
    self_amplicons: bool
    good: str
    bad: str
    count_hits_in_result: bool
    min_bp: int = 50
    max_bp: int = 300
    max_alignments: int = 200
    tm_min: float = 55.0
    tm_max: float = 70.0
    tm_diff_max: float = 3.0
    hairpin_dg: float = -5.0
    homodimer_dg: float = -6.0
    heterodimer_dg: float = -6.0
    max_hits: int = 1


STRICT_AMPLICON = QcProfile("strict_amplicon", 80.0, 10, True, True, True, "O", "X", False)
ALL_FLAGS = QcProfile("all_flags", 85.0, 12, False, False, False, "0", "x", True)
PROFILES = {p.name: p for p in (STRICT_AMPLICON, ALL_FLAGS)}
