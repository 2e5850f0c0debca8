"""Oligo catalog: melting temperature and ungapped secondary-structure screens.

This is a screen for the most stable run of paired bases.  It does not align with gaps or bulges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DNA_NM, GAS_CONSTANT, HAIRPIN_MIN_LOOP, KELVIN, REACTION_CONDITIONS
from ..functions.sequence import (
    MAX_CODED, PAIR_BITS, ambiguity_code, base_code, complement, gc_percent, low_mask, mismatch_bits,
    revcomp, shl, shr,
)
from ..functions.thermo import (
    condition_logs, drop_masks, free_energy, sodium_molar, stem_entropy, step_sums, terminal_sums, with_base_masks,
    with_masked_step_sums, with_melting_temperature,
)
from ..joins import once, spread
from ..session import cut_lineage

# Stems are ranked by dG in millionths, then shift, then first base.  Those of short oligos fit one number, in which
# each of the last three fields takes eight bits; those of long ones are compared as structs.
_DG_UNIT = 1_000_000
_FIELD = 256
_SHIFT_ZERO = 128
#: Logarithms of a row's reaction conditions; a duplex without them has the default conditions.
_LOGS = ["salt_ln", "dna_ln", "dna4_ln"]


def _duplex_key(df: DataFrame) -> list[str]:
    return ["x", "y", *[c for c in _LOGS if c in df.columns]]


def _stem_key(df: DataFrame) -> list[str]:
    """What goes along with the stems: the duplex, and all its reaction conditions at once."""
    return ["x", "y", *[c for c in ("_mixtures",) if c in df.columns]]


def _rank(dg: Column, packed: bool) -> Column:
    """Rank of the stem (k, i, m); null without a stem."""
    scaled = F.floor(dg * _DG_UNIT + F.lit(0.5)).cast("bigint")
    if packed:
        rank = ((scaled * _FIELD + F.col("k") + _SHIFT_ZERO) * _FIELD + F.col("i")) * _FIELD + F.col("m")
    else:
        rank = F.struct(scaled.alias("dg"), "k", "i", "m")
    return F.when(F.col("m") > 0, rank)


def _unrank(packed: bool) -> dict[str, Column]:
    if not packed:
        return {name: F.col("rank")[name] for name in ("k", "i", "m")}
    return {
        "k": (F.pmod(F.shiftright("rank", 16), F.lit(_FIELD)) - _SHIFT_ZERO).cast("int"),
        "i": F.pmod(F.shiftright("rank", 8), F.lit(_FIELD)).cast("int"),
        "m": F.pmod("rank", F.lit(_FIELD)).cast("int"),
    }


def _coded_stems(df: DataFrame, hairpin: bool) -> DataFrame:
    """Stems of short oligos by bit operations: (x, y, k, i, m) and the code of each; a row with m = 0 per pair without any."""
    key = [*_stem_key(df), "n", "_forward"]
    ready = df.select(
        *_stem_key(df), F.length("x").alias("n"), base_code(F.col("x")).alias("_forward"), F.length("y").alias("ny"),
        base_code(F.reverse("x")).alias("xc"), ambiguity_code(F.reverse("x")).alias("xn"),
        base_code(complement(F.col("y"))).alias("yc"), ambiguity_code(complement(F.col("y"))).alias("yn"),
    )
    # One more shift below the first real one stands for "no stem".
    shifted = ready.select("*", F.explode(F.expr("sequence(-ny, n - 1)")).alias("k"))
    k, n, ny = F.col("k"), F.col("n"), F.col("ny")
    top = F.least(n, k + ny)
    if hairpin:
        top = F.least(top, F.expr(f"cast(floor((n + k - {HAIRPIN_MIN_LOOP}) / 2) as int)"))
    bounded = shifted.select("*", F.greatest(F.lit(1), k + 1).alias("lo"), top.alias("hi"))
    none = k == -ny
    bounded = bounded.filter(none | (F.col("hi") > F.col("lo")))

    def moved(name: str) -> Column:
        return F.when(k >= 0, shl(F.col(name), k * 2)).otherwise(shr(F.col(name), -k * 2))

    inside = shl(low_mask((F.col("hi") - F.col("lo") + 1) * 2), (F.col("lo") - 1) * 2)
    unclear = F.col("xn").bitwiseOR(moved("yn"))
    equal = F.bitwise_not(mismatch_bits(F.col("xc").bitwiseXOR(moved("yc")), unclear))
    equal = F.when(none, F.lit(0).cast("bigint")).otherwise(equal.bitwiseAND(F.lit(PAIR_BITS)).bitwiseAND(inside))
    paired = once(bounded, e=equal)
    paired = paired.filter(none | (F.col("e").bitwiseAND(F.shiftrightunsigned("e", 2)) != 0))
    first = F.when(none, F.array(F.lit(0))).otherwise(F.sequence(F.col("lo"), F.col("hi") - 1))
    at = paired.select(*key, "k", "ny", "e", F.explode(first).alias("i"))
    here = shr(F.col("e"), (F.col("i") - 1) * 2)
    begins = (
        (here.bitwiseAND(F.lit(5).cast("bigint")) == 5)
        & ((F.col("i") == 1) | (shr(F.col("e"), (F.col("i") - 2) * 2).bitwiseAND(F.lit(1).cast("bigint")) == 0))
    )
    runs = at.filter((F.col("k") == -F.col("ny")) | begins)
    filled = here.bitwiseOR(F.shiftleft(here, 1))
    lowest_zero = F.bitwise_not(filled).bitwiseAND(filled + F.lit(1).cast("bigint"))
    length = (F.bit_count(lowest_zero - F.lit(1).cast("bigint")) / 2).cast("int")
    found = runs.select(*key, "k", "i", F.when(F.col("i") == 0, 0).otherwise(length).alias("m"))
    return found.withColumn("_code", _stem_code()).drop("n", "_forward")


def _stem_code() -> Column:
    """Two-bit code of the stem's bases, out of that of the whole oligo."""
    behind = F.col("n") - F.col("i") - F.col("m") + 1
    return shr(F.col("_forward"), F.when(F.col("m") > 0, behind * 2).otherwise(0)).bitwiseAND(low_mask(F.col("m") * 2))


def _any_stems(df: DataFrame, hairpin: bool) -> DataFrame:
    """The same for oligos of any length, letter by letter."""
    key = _stem_key(df)
    ready = df.select(
        *key, F.length("x").alias("n"), F.length("y").alias("ny"),
        F.split("x", "").alias("xa"), F.split(revcomp(F.col("y")), "").alias("ya"),
    )
    shifted = ready.select("*", F.explode(F.expr("sequence(-ny, n - 1)")).alias("k"))
    top = "least(n, k + ny)"
    if hairpin:
        top = f"least({top}, cast(floor((n + k - {HAIRPIN_MIN_LOOP}) / 2) as int))"
    bounded = shifted.selectExpr("*", "greatest(1, k + 1) as lo", f"{top} as hi").filter("k = -ny or hi > lo")
    marks = (
        "if(k = -ny, '', array_join(transform(sequence(lo, greatest(lo, hi)), i -> "
        "if(xa[i - 1] = ya[i - k - 1] and xa[i - 1] in ('A', 'C', 'G', 'T'), '1', '0')), ''))"
    )
    # The runs of two or more, each with the text before it, give the first index and the length.
    marked = bounded.selectExpr(*key, "k", "ny", "lo", f"{marks} as marks").filter("k = -ny or instr(marks, '11') > 0")
    at = marked.selectExpr(*key, "k", "ny", "lo", "marks", "explode(sequence(0, length(marks))) as o")
    starts = at.filter(
        "(k = -ny) or (o > 0 and substr(marks, o, 2) = '11' and (o = 1 or substr(marks, o - 1, 1) = '0'))"
    )
    return starts.selectExpr(
        *key, "k", "if(k = -ny, 0, lo + o - 1) as i",
        "if(k = -ny, 0, length(regexp_extract(substr(marks, greatest(o, 1)), '^1*', 0))) as m",
    )


def stem_screen(duplexes: DataFrame, kind: str, max_length: int | None = None) -> DataFrame:
    """Most stable stem of every distinct (x, y): found, dg, dh, ds, tm.

    ``kind`` is homodimer (y = x), heterodimer or hairpin (y = x).  All stems of a duplex come from one
    input row that is already on the partition of its key, so picking the best needs no shuffle of its own.
    Oligos may have any length; each row takes the way for its own.  ``max_length`` promises that none is longer.
    Where the rows bring the logarithms of their reaction conditions, these belong to the key.
    """
    distinct = duplexes.select(*_duplex_key(duplexes)).distinct()
    if max_length is not None and max_length <= MAX_CODED:
        return screen_by(distinct, kind, True)
    short = F.greatest(F.length("x"), F.length("y")) <= MAX_CODED
    return screen_by(distinct.filter(short), kind, True).unionByName(screen_by(distinct.filter(~short), kind, False))


def screen_by(distinct: DataFrame, kind: str, coded: bool) -> DataFrame:
    """The screen by bit operations (``coded``, short oligos only) or letter by letter."""
    hairpin = kind == "hairpin"
    key = _duplex_key(distinct)
    by_row = "salt_ln" in key
    # Which bases pair does not depend on the reaction conditions, so stems and their sums are made once for all of them.
    duplexes = distinct.groupBy("x", "y").agg(F.collect_list(F.struct(*_LOGS)).alias("_mixtures")) if by_row else distinct
    stems = (_coded_stems if coded else _any_stems)(spread(duplexes, "x", "y"), hairpin)
    salt_ln = F.col("salt_ln") if by_row else F.lit(math.log(sodium_molar()))

    def with_sums(df: DataFrame) -> DataFrame:
        """Energies of the stem text ``s``; its bases are paired, hence never ambiguous."""
        if coded:
            df = drop_masks(with_masked_step_sums(with_base_masks(df, "s"), "_h", "_s"))
        else:
            h, e = step_sums("s", clean=True)
            df = once(df, _h=h, _s=e)
        if hairpin:
            return df.withColumnsRenamed({"_h": "dh", "_s": "ds"})
        end_h, end_s = terminal_sums("s")
        return once(df, dh=F.col("_h") + end_h, ds=F.col("_s") + end_s).drop("_h", "_s")

    scored = with_sums(once(stems, s=F.substring("x", F.col("i"), F.col("m"))))
    if by_row:
        scored = scored.select("x", "y", "k", "i", "m", "dh", "ds", F.inline("_mixtures"))
    dg = free_energy(F.col("dh"), stem_entropy(F.col("ds"), F.col("m"), hairpin, salt_ln))
    best = scored.groupBy(*key).agg(F.min(_rank(dg, coded)).alias("rank"))

    # Unpack the winner and work its energies out once more, now for one stem per duplex.
    won = once(best, **_unrank(coded))
    won = with_sums(once(won, s=F.coalesce(F.substring("x", F.col("i"), F.col("m")), F.lit(""))))
    won = once(won, _e=stem_entropy(F.col("ds"), F.col("m"), hairpin, salt_ln))
    dg = free_energy(F.col("dh"), F.col("_e"))
    molar = DNA_NM * 1e-9
    if hairpin:
        tm = F.lit(100.0) * F.col("dh") / F.col("_e") - F.lit(KELVIN)
    else:
        if by_row:
            strands = F.lit(GAS_CONSTANT) * F.col("dna_ln" if kind == "homodimer" else "dna4_ln")
        else:
            strands = F.lit(GAS_CONSTANT * (math.log(molar) if kind == "homodimer" else math.log(molar / 4.0)))
        tm = F.lit(100.0) * F.col("dh") / (F.col("_e") + strands) - F.lit(KELVIN)
    found = F.coalesce(dg < 0, F.lit(False))

    def when_found(value: Column) -> Column:
        return F.when(found, value).otherwise(F.lit(0.0))

    return won.select(
        *key, found.alias("found"),
        when_found(dg).alias("dg"), when_found(F.col("dh") / F.lit(10.0)).alias("dh"),
        when_found(F.col("_e")).alias("ds"), when_found(tm).alias("tm"),
    )


def _self_screen(oligos: DataFrame, kind: str, max_length: int | None) -> DataFrame:
    duplexes = oligos.select(F.col("sequence").alias("x"), F.col("sequence").alias("y"))
    got = stem_screen(duplexes, kind, max_length)
    names = [F.col(c).alias(f"{kind}_{c}") for c in ("dg", "dh", "ds", "tm")]
    return got.select(F.col("x").alias("sequence"), F.col("found").alias(kind), *names)


def homodimer_screen(oligos: DataFrame, max_length: int | None = None) -> DataFrame:
    return _self_screen(oligos, "homodimer", max_length)


def hairpin_screen(oligos: DataFrame, max_length: int | None = None) -> DataFrame:
    return _self_screen(oligos, "hairpin", max_length)


def heterodimer_screen(pairs: DataFrame, max_length: int | None = None) -> DataFrame:
    """Stems between the two primers of every distinct pair."""
    got = stem_screen(pairs.select(F.col("f_seq").alias("x"), F.col("r_seq").alias("y")), "heterodimer", max_length)
    names = [F.col(c).alias(f"heterodimer_{c}") for c in ("dg", "dh", "ds", "tm")]
    return got.select(F.col("x").alias("f_seq"), F.col("y").alias("r_seq"), F.col("found").alias("heterodimer"), *names)


def thermo_catalog(oligos: DataFrame) -> DataFrame:
    """Melting temperature and GC once per distinct oligo."""
    return with_melting_temperature(oligos.select("sequence").distinct(), "sequence").select(
        "sequence", F.length("sequence").alias("length"), "tm", gc_percent(F.col("sequence")).alias("gc"),
    )


def longest_oligo(oligos: DataFrame) -> int:
    return oligos.agg(F.max(F.length("sequence"))).first()[0] or 0


def oligo_catalog(oligos: DataFrame, max_length: int | None = None) -> DataFrame:
    """The full record per distinct oligo: Tm, GC, hairpin and homodimer."""
    return (
        thermo_catalog(oligos)
        .join(hairpin_screen(oligos, max_length), "sequence")
        .join(homodimer_screen(oligos, max_length), "sequence")
    )


def reaction_catalog(oligos: DataFrame, max_length: int | None = None) -> DataFrame:
    """The full record per distinct oligo and reaction condition.

    ``oligos`` has ``sequence`` and may have any of the columns of ``REACTION_CONDITIONS`` (mM, DNA in nM); missing
    ones and nulls mean the default.  One table may hold any number of conditions.  Columns: the key (sequence and all
    four conditions), ``length``, ``tm``, ``gc_percent`` (ambiguous letters count as bases), and for ``hairpin`` and
    ``homodimer`` whether one is found, with ``_tm``, ``_dg``, ``_dh`` (kcal/mol) and ``_ds`` (kcal/mol/K).
    Temperatures are null where a mixture has neither salt nor strands, or an oligo fewer than two bases; a null
    sequence gives no row.
    """
    key = ["sequence", *REACTION_CONDITIONS]
    given = [
        F.coalesce(F.col(c).cast("double") if c in oligos.columns else F.lit(None).cast("double"), F.lit(default)).alias(c)
        for c, default in REACTION_CONDITIONS.items()
    ]
    keyed = oligos.dropna(subset=["sequence"]).select("sequence", *given).distinct()
    # Temperatures and both screens read it, so what the oligos come from is worked out once.
    keyed = cut_lineage(once(keyed, **condition_logs(*REACTION_CONDITIONS)))
    known = with_melting_temperature(keyed, "sequence", logs=tuple(_LOGS))
    known = known.select(
        *key, *_LOGS, F.length("sequence").alias("length"), "tm", gc_percent(F.col("sequence"), "ignore").alias("gc_percent")
    )
    for kind in ("hairpin", "homodimer"):
        duplexes = keyed.select(F.col("sequence").alias("x"), F.col("sequence").alias("y"), *_LOGS)
        got = stem_screen(duplexes, kind, max_length)
        got = got.select(
            F.col("x").alias("_x"), *[F.col(c).alias(f"_{c}") for c in _LOGS], F.col("found").alias(kind),
            *[F.col(c).alias(f"{kind}_{c}") for c in ("tm", "dg", "dh")], (F.col("ds") / 1000.0).alias(f"{kind}_ds"),
        )
        same = F.col("sequence") == F.col("_x")
        for c in _LOGS:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        known = known.join(got, same, "left").drop("_x", *[f"_{c}" for c in _LOGS])
    return known.drop(*_LOGS)
