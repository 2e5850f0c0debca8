"""Expressions over search hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_strand(sstart: Column, send: Column) -> Column:
    return F.when(sstart <= send, "+").otherwise("-")


def hit_anchor(sstart: Column, send: Column) -> Column:
    """The coordinate taken as the 3' end: the greater one on either strand."""
    return F.greatest(sstart, send)


def _aligned(qseq: Column, sseq: Column) -> Column:
    """Aligned (query, subject) letters without query gaps."""
    q, s = F.split(qseq, ""), F.split(sseq, "")
    both = F.arrays_zip(q.alias("q"), s.alias("s"))
    shorter = F.least(F.length(qseq), F.length(sseq))
    return F.filter(F.slice(both, F.lit(1), shorter), lambda x: x["q"] != "-")


def full_annotation(primer: Column, qstart: Column, qseq: Column, sseq: Column) -> tuple[Column, Column]:
    """(primer with mismatches lower-cased, mask of ``|``, ``x`` and blank) over the whole primer."""
    pairs = _aligned(qseq, sseq)
    room = F.greatest(F.length(primer) - qstart + 1, F.lit(0))
    used = F.least(F.size(pairs), room)
    shown = F.slice(pairs, F.lit(1), used)
    marks = F.array_join(
        F.transform(shown, lambda x: F.when(F.upper(x["q"]) == F.upper(x["s"]), "|").otherwise("x")), ""
    )
    head, tail = qstart - 1, F.length(primer) - (qstart - 1) - used
    mask = F.concat(F.repeat(F.lit(" "), head), marks, F.repeat(F.lit(" "), tail))
    bases = F.array_join(
        F.zip_with(
            F.split(primer, ""), F.split(mask, ""), lambda b, m: F.when(m == "x", F.lower(b)).otherwise(b)
        ),
        "",
    )
    return bases, mask


def ref_aligned_line(qseq: Column, sseq: Column, offset: Column, width: Column) -> Column:
    """Query bases laid on a blank line of ``width`` from ``offset``; mismatches lower-cased."""
    letters = F.array_join(
        F.transform(
            _aligned(qseq, sseq),
            lambda x: F.when(F.upper(x["q"]) == F.upper(x["s"]), F.upper(x["q"])).otherwise(F.lower(x["q"])),
        ),
        "",
    )
    line = F.concat(F.repeat(F.lit(" "), offset), letters)
    return F.rpad(line, width, F.lit(" "))
