"""Sequence expressions.  All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import AMBIGUOUS, BASES

_FROM, _TO = "ACGTNacgtn", "TGCANtgcan"


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def count_in(seq: Column, word: str) -> Column:
    """Occurrences of a word that cannot overlap itself."""
    gone = F.length(seq) - F.length(F.replace(seq, F.lit(word), F.lit("")))
    return gone if len(word) == 1 else (gone / F.lit(len(word))).cast("int")


def count_cg_pairs(seq: Column) -> Column:
    return count_in(seq, "CG")


def gc_percent(seq: Column, ambiguous: str = "remove") -> Column:
    """GC percentage.  ``remove`` leaves ambiguous bases out of the length, ``ignore`` keeps them in."""
    up = F.upper(seq)
    gc = F.length(F.regexp_replace(up, "[^GCS]", ""))
    if ambiguous == "remove":
        total = F.length(F.regexp_replace(up, "[^GCSATWU]", ""))
    elif ambiguous == "ignore":
        total = F.length(up)
    else:
        raise ValueError(f"unknown ambiguity mode: {ambiguous}")
    return F.when(total == 0, F.lit(0.0)).otherwise(gc * F.lit(100.0) / total)


def slice0(seq: Column, start: Column, end: Column) -> Column:
    """0-based half-open slice; indexes outside the string are clamped."""
    lo = F.greatest(start, F.lit(0))
    return F.substring(seq, lo + 1, F.greatest(end - lo, F.lit(0)))


def region_label(chrom: Column, start: Column, end: Column, given: Column | None = None) -> Column:
    label = F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return label if given is None else F.coalesce(given, label)


def locate_oligo(template: Column, seq: Column) -> tuple[Column, Column]:
    """0-based first and last index of an oligo: its text first, else its reverse complement."""
    as_is = F.nullif(F.instr(template, seq), F.lit(0))
    flipped = F.nullif(F.instr(template, revcomp(seq)), F.lit(0))
    start = F.coalesce(as_is, flipped) - 1
    return start, start + F.length(seq) - 1


def cpg_count(reference: Column, strand: Column, start: Column, end: Column) -> Column:
    """CG pairs of the oligo span in the unconverted template.

    The span takes one more base on its 3' side of the plus strand (forward) or before its first
    base (reverse).  A reverse oligo at index 0 has no base before it and is counted inside its span.
    """
    forward = slice0(reference, start, end + 2)
    reverse = slice0(reference, start - 1, end + 1)
    return count_cg_pairs(F.when(strand == "forward", forward).otherwise(reverse))


def non_cpg_c_count(reference: Column, strand: Column, start: Column, end: Column) -> Column:
    span = slice0(reference, start, end + 1)
    cytosines = F.when(strand == "forward", count_in(span, "C")).otherwise(count_in(span, "G"))
    return cytosines - cpg_count(reference, strand, start, end)


def three_prime_is(reference: Column, strand: Column, start: Column, end: Column, tail: Column) -> Column:
    n = F.length(tail)
    forward = slice0(reference, end + 1 - n, end + 1)
    reverse = revcomp(slice0(reference, start, start + n))
    return F.when(strand == "forward", forward).otherwise(reverse) == tail


def amplicon_sequence(template: Column, forward_start: Column, reverse_end: Column) -> Column:
    """Template from the forward start to the reverse end, null unless both are known."""
    return F.when(
        forward_start.isNotNull() & reverse_end.isNotNull(),
        slice0(template, forward_start, reverse_end + 1),
    )


def bisulfite_convert(seq_plus_one: Column, cpg_default: str = "methyl") -> Column:
    """Convert a sequence fetched with one base of look-ahead, which is dropped."""
    if cpg_default == "methyl":
        converted = F.regexp_replace(seq_plus_one, "C(?!G)", "T")
    elif cpg_default == "unmethyl":
        converted = F.replace(seq_plus_one, F.lit("C"), F.lit("T"))
    else:
        raise ValueError(f"cpg_default must be methyl or unmethyl, not {cpg_default!r}")
    return F.substring(converted, F.lit(1), F.length(converted) - 1)


# --- two-bit codes -------------------------------------------------------------------------------
# Up to 31 bases fit one BIGINT, two bits each, first base highest.  Comparing two codes is then one
# XOR, and a mismatch count one bit_count, all inside generated code.

MAX_CODED = 31
PAIR_BITS = 0x5555555555555555


def base_digits(seq: Column) -> Column:
    """A, C, G, T as digits 0..3; ambiguous letters as 0 (they are masked separately)."""
    return F.translate(seq, BASES + AMBIGUOUS, "0123" + "0" * len(AMBIGUOUS))


def ambiguity_digits(seq: Column) -> Column:
    return F.translate(seq, BASES + AMBIGUOUS, "0000" + "1" * len(AMBIGUOUS))


def digits_to_code(digits: Column) -> Column:
    return F.coalesce(F.conv(digits, 4, 10).cast("bigint"), F.lit(0).cast("bigint"))


def base_code(seq: Column) -> Column:
    return digits_to_code(base_digits(seq))


def ambiguity_code(seq: Column) -> Column:
    unclear = seq.rlike("[^ACGT]")
    return F.when(unclear, digits_to_code(ambiguity_digits(seq))).otherwise(F.lit(0).cast("bigint"))


def shl(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits.cast("int"))


def shr(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits.cast("int"))


def low_mask(bits: Column) -> Column:
    return shl(F.lit(1).cast("bigint"), bits) - F.lit(1).cast("bigint")


def mismatch_bits(diff: Column, unclear: Column) -> Column:
    """One bit per base that differs (``diff`` is the XOR of two codes) or is ambiguous."""
    either = diff.bitwiseOR(F.shiftrightunsigned(diff, 1)).bitwiseOR(unclear)
    return either.bitwiseAND(F.lit(PAIR_BITS))
