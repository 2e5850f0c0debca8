"""Nearest-neighbour sums and melting temperature as built-in expressions.

Oligos of up to 31 clean bases are handled as two-bit codes: one mask per base, and a step XY is counted by
one AND and one bit_count.  Others fall back to string replacement: a step of two different letters cannot
overlap itself, and a step XX occurs once for every X that is neither last nor followed by another letter.
Both ways stay in generated code, and their pieces are kept small enough for the JVM to compile them.
Sums are written as SQL text, because they have too many terms to be put together call by call.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AMBIGUOUS, BASES, BODY_KELVIN, DIVALENT_MM, DNA_NM, DNTP_MM, GAS_CONSTANT, HAIRPIN_LOOP_DS,
    KELVIN, MONOVALENT_MM, NN_DH, NN_DS, SALT_FACTOR, SYMMETRY_DS, TERMINAL_AT, TERMINAL_GC,
)
from ..joins import once
from .sequence import PAIR_BITS, base_code


def sodium_molar(mono: float = MONOVALENT_MM, div: float = DIVALENT_MM, dntp: float = DNTP_MM) -> float:
    return (mono + 120.0 * math.sqrt(max(0.0, div - dntp))) / 1000.0


def _double(value: float) -> str:
    return f"{value!r}D"


def _step_sum(seq: str, values: dict[str, int], clean: bool) -> str:
    if not clean:
        seq = f"translate({seq}, '{AMBIGUOUS}', '{'N' * len(AMBIGUOUS)}')"
    terms = []
    for x in BASES:
        same = values[x + x]
        terms.append(f"{same} * (length({seq}) - length(replace({seq}, '{x}', '')) - int(right({seq}, 1) = '{x}'))")
        for y in BASES + ("" if clean else "N"):
            if x != y:
                weight = values.get(x + y, 0) - same
                terms.append(f"{weight} * ((length({seq}) - length(replace({seq}, '{x + y}', ''))) div 2)")
    return "(" + " + ".join(terms) + ")"


def step_sums(seq: str, clean: bool = False) -> tuple[Column, Column]:
    """(dH, dS) of all steps of the column, in tenths.  Steps with an ambiguous base add nothing.

    ``clean`` promises that only A, C, G and T occur.
    """
    return tuple(F.expr(_step_sum(seq, v, clean)).cast("int") for v in (NN_DH, NN_DS))


def _terminal_sum(seq: str, part: int) -> str:
    def end(base: str) -> str:
        return (
            f"(case when {base} in ('A', 'T') then {TERMINAL_AT[part]} "
            f"when {base} in ('C', 'G') then {TERMINAL_GC[part]} else 0 end)"
        )

    return f"({end(f'left({seq}, 1)')} + {end(f'right({seq}, 1)')})"


def terminal_sums(seq: str) -> tuple[Column, Column]:
    """(dH, dS) of both end terms of the column, in tenths."""
    return F.expr(_terminal_sum(seq, 0)), F.expr(_terminal_sum(seq, 1))


def _tm_text(
    seq: str, dh: str, ds: str, itself: str, ends: list[str], mono: float = MONOVALENT_MM, div: float = DIVALENT_MM,
    dntp: float = DNTP_MM, dna_nm: float = DNA_NM, logs: tuple[str, str, str] | None = None,
) -> str:
    """``logs`` names the logarithms of salt, strands and a quarter of the strands, where they differ by row."""
    molar = dna_nm * 1e-9
    salt, all_strands, quarter = logs or tuple(
        _double(math.log(x)) for x in (sodium_molar(mono, div, dntp), molar, molar / 4.0)
    )
    entropy = (
        f"({ds} + {ends[1]} + if({itself}, {SYMMETRY_DS}, 0)) / 10.0D"
        f" + {_double(SALT_FACTOR)} * (length({seq}) - 1) * {salt}"
        f" + {_double(GAS_CONSTANT)} * if({itself}, {all_strands}, {quarter})"
    )
    return f"if(length({seq}) >= 2, ({dh} + {ends[0]}) * 100.0D / ({entropy}) - {_double(KELVIN)}, null)"


def condition_logs(mono: str, div: str, dntp: str, dna: str) -> dict[str, Column]:
    """Logarithms that stand for a row's reaction conditions (columns in mM and nM); null where the mixture has none."""
    salt = f"({mono} + 120.0D * sqrt(greatest(0.0D, {div} - {dntp}))) / 1000.0D"
    return {
        "salt_ln": F.expr(f"ln({salt})"), "dna_ln": F.expr(f"ln({dna} * 1e-9D)"),
        "dna4_ln": F.expr(f"ln({dna} * 1e-9D / 4.0D)"),
    }


def with_melting_temperature(df: DataFrame, seq: str, **conditions: float) -> DataFrame:
    """Add ``tm``, the duplex melting temperature of any oligo in Celsius; null for fewer than two bases.

    Conditions are numbers for all rows, or ``logs`` names columns of ``condition_logs``.
    """
    dh, ds = step_sums(seq)
    known = once(df, _dh=dh, _ds=ds, _self=F.expr(f"{seq} = reverse(translate({seq}, 'ACGTN', 'TGCAN'))"))
    ends = [_terminal_sum(seq, 0), _terminal_sum(seq, 1)]
    return known.withColumn("tm", F.expr(_tm_text(seq, "_dh", "_ds", "_self", ends, **conditions))).drop("_dh", "_ds", "_self")


# --- up to 31 clean bases --------------------------------------------------------------------------

_MASKS = {base: f"_m{base}" for base in BASES}


def with_base_masks(df: DataFrame, seq: str) -> DataFrame:
    """Add the two-bit code of the column (unless there) and one mask per base (one bit per place, first highest)."""
    every = F.expr(f"(shiftleft(1L, 2 * length({seq})) - 1L) & {PAIR_BITS}L")
    code = {} if "_code" in df.columns else {"_code": base_code(F.col(seq))}
    coded = once(df, **code, _all=every)
    hi, lo = "(shiftrightunsigned(_code, 1) & _all)", "(_code & _all)"
    return once(
        coded, _mA=F.expr(f"_all & ~{hi} & ~{lo}"), _mC=F.expr(f"{lo} & ~{hi}"),
        _mG=F.expr(f"{hi} & ~{lo}"), _mT=F.expr(f"{hi} & {lo}"),
    )


def masked_gc_count() -> Column:
    return F.expr("bit_count(_mC) + bit_count(_mG)")


def with_masked_step_sums(df: DataFrame, dh: str, ds: str) -> DataFrame:
    """Add (dH, dS) of all steps in tenths, from the masks."""
    def total(values: dict[str, int]) -> Column:
        return F.expr(" + ".join(
            f"{values[x + y]} * bit_count({_MASKS[x]} & shiftleft({_MASKS[y]}, 2))" for x in BASES for y in BASES))

    return once(df, **{dh: total(NN_DH), ds: total(NN_DS)})


def drop_masks(df: DataFrame) -> DataFrame:
    return df.drop("_code", "_all", *_MASKS.values())


def with_masked_tm(df: DataFrame, seq: str) -> DataFrame:
    """Add ``tm`` from the masks.  Only an even oligo whose two outer bases pair at both ends can be its
    own reverse complement."""
    first, last = f"(shiftrightunsigned(_code, 2 * length({seq}) - 2) & 3L)", "(_code & 3L)"
    inner = f"(shiftrightunsigned(_code, 2 * length({seq}) - 4) & 3L) + (shiftrightunsigned(_code, 2) & 3L)"
    itself = F.expr(
        f"if(length({seq}) % 2 = 0 and {first} + {last} = 3L and {inner} = 3L, {seq} = reverse(translate({seq}, 'ACGT', 'TGCA')), false)")
    weak = F.expr(f"if({first} = 0L or {first} = 3L, 1, 0) + if({last} = 0L or {last} = 3L, 1, 0)")
    known = once(with_masked_step_sums(df, "_dh", "_ds"), _self=itself, _weak=weak)
    ends = [f"({TERMINAL_AT[i]} * _weak + {TERMINAL_GC[i]} * (2 - _weak))" for i in (0, 1)]
    return once(known, tm=F.expr(_tm_text(seq, "_dh", "_ds", "_self", ends))).drop("_dh", "_ds", "_self", "_weak")


def stem_entropy(ds: Column, pairs: Column, hairpin: bool, salt_ln: Column | float) -> Column:
    s = ds / F.lit(10.0) + F.lit(SALT_FACTOR) * (pairs - 1) * F.lit(salt_ln)
    return s + F.lit(HAIRPIN_LOOP_DS) if hairpin else s


def free_energy(dh: Column, entropy: Column) -> Column:
    """dG in kcal/mol at 37 degrees from dH in tenths."""
    return dh / F.lit(10.0) - F.lit(BODY_KELVIN) * entropy / F.lit(1000.0)
