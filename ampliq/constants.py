"""Published parameters, defaults and formats."""

from __future__ import annotations

# Unified nearest-neighbour parameters (SantaLucia 1998), in tenths of
# kcal/mol (dH) and cal/mol/K (dS), negated.  One row per step and its complement.
NEAREST_NEIGHBOUR = {
    ("AA", "TT"): (79, 222),
    ("AT",): (72, 204),
    ("TA",): (72, 213),
    ("CA", "TG"): (85, 227),
    ("GT", "AC"): (84, 224),
    ("CT", "AG"): (78, 210),
    ("GA", "TC"): (82, 222),
    ("CG",): (106, 272),
    ("GC",): (98, 244),
    ("GG", "CC"): (80, 199),
}
NN_DH = {step: -v[0] for steps, v in NEAREST_NEIGHBOUR.items() for step in steps}
NN_DS = {step: -v[1] for steps, v in NEAREST_NEIGHBOUR.items() for step in steps}

# Terminal and symmetry terms in tenths, same source.
TERMINAL_GC = (1, -28)
TERMINAL_AT = (23, 41)
SYMMETRY_DS = -14
HAIRPIN_LOOP_DS = -11.3
HAIRPIN_MIN_LOOP = 3
GAS_CONSTANT = 1.987
SALT_FACTOR = 0.368
KELVIN = 273.15
BODY_KELVIN = 310.15

# Reaction conditions (mM, mM, mM, nM).
MONOVALENT_MM = 50.0
DIVALENT_MM = 1.5
DNTP_MM = 0.6
DNA_NM = 50.0
# Names of these conditions in records.
REACTION_CONDITIONS = {
    "salt_monovalent_conc": MONOVALENT_MM,
    "salt_divalent_conc": DIVALENT_MM,
    "dntp_conc": DNTP_MM,
    "dna_conc": DNA_NM,
}

# Design defaults.
DESIGN_DEFAULTS = {
    "min_amplicon_length": 80,
    "max_amplicon_length": 120,
    "n_primers": 100,
    "primer_opt_length": 25,
    "primer_min_length": 20,
    "primer_max_length": 30,
    "primer_opt_tm": 60.0,
    "primer_min_tm": 50.0,
    "primer_max_tm": 70.0,
    "primer_opt_gc": 50.0,
    "primer_min_gc": 35.0,
    "primer_max_gc": 65.0,
    "max_tm_difference": 2.0,
    "n_probes": 100,
    "min_primer_probe_tm_diff": 6.0,
    "max_primer_probe_tm_diff": 8.0,
    "probe_opt_length": 25,
    "probe_min_length": 20,
    "probe_max_length": 30,
    "probe_opt_tm": 60.0,
    "probe_min_tm": 60.0,
    "probe_max_tm": 65.0,
    "probe_opt_gc": 50.0,
    "probe_min_gc": 35.0,
    "probe_max_gc": 65.0,
    "bisulfite": False,
    "cpg_default": "methyl",
}

# Amplicon acceptance thresholds.
AMPLICON_THRESHOLDS = {
    "hairpin_max_tm": 47.0,
    "hairpin_min_dg": -5.0,
    "homodimer_min_dg": -6.0,
    "heterodimer_min_dg": -6.0,
    "heterodimer_max_tm": 45.0,
}

# Settings of the scoring path.  It states sizes only; temperature, GC, the temperature difference and the
# limits of the internal oligo (the probe) are the solver's public defaults.
SCORING = {
    "opt_length": 22,
    "min_length": 18,
    "max_length": 30,
    "opt_tm": 60.0,
    "min_tm": 57.0,
    "max_tm": 63.0,
    "min_gc": 20.0,
    "max_gc": 80.0,
    "max_tm_difference": 100.0,
    "min_product": 80,
    "max_product": 180,
    "n_pairs": 10,
    "probe_opt_length": 20,
    "probe_min_length": 18,
    "probe_max_length": 27,
    "probe_opt_tm": 60.0,
    "probe_min_tm": 57.0,
    "probe_max_tm": 63.0,
    "probe_min_gc": 20.0,
    "probe_max_gc": 80.0,
    "primer_weight": 3,
    "probe_weight": 5,
    "dg_unit": 1000.0,
}

# Columns of the pair QC report, in order.
QC_REPORT_COLUMNS = [
    "Forward_Primer", "Forward_seq", "Reverse_Primer", "Reverse_seq",
    "F_Tm", "R_Tm", "F_GC%", "R_GC%",
    "F_Hairpin_dG_kcal", "R_Hairpin_dG_kcal", "F_Hairpin_Tm", "R_Hairpin_Tm",
    "F_Homodimer_dG_kcal", "R_Homodimer_dG_kcal", "F_Homodimer_Tm", "R_Homodimer_Tm",
    "Heterodimer_dG_kcal", "Heterodimer_Tm",
    "F_BLAST_hits", "R_BLAST_hits", "Nearby_amplicon_count", "Min_amplicon_size", "amplicon_info",
    "QC_Tm_range", "QC_Tm_diff", "QC_Hairpin", "QC_Homodimer", "QC_Heterodimer",
    "QC_BLAST_hit", "QC_BLAST_amplicon", "Final_Result",
]

BASES = "ACGT"
# IUPAC ambiguity letters.
AMBIGUOUS = "RYSWKMBDHVNU"
