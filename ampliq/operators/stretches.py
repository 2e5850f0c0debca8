"""Temperature and GC of every stretch of many templates, from sums along each template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BASES, NN_DH, NN_DS, TERMINAL_AT, TERMINAL_GC
from ..functions.sequence import MAX_CODED, base_digits, digits_to_code
from ..functions.thermo import _tm_text
from ..joins import once, spread

#: Bits of one number that hold a stretch's dH and dS (as positive tenths), its G and C, and its unclear letters.
_DH_BITS, _DS_BITS, _COUNT_BITS = 12, 14, 6
_GC_AT, _UNCLEAR_AT = _DH_BITS + _DS_BITS, _DH_BITS + _DS_BITS + _COUNT_BITS
#: Longest stretch whose sums fit.
MAX_SUMMED = (1 << _DH_BITS) // max(-v for v in NN_DH.values())


def _step_values() -> str:
    """Packed dH and dS of each step, by 4 * first + second base."""
    return "array(" + ", ".join(f"{-NN_DH[x + y] - (NN_DS[x + y] << _DH_BITS)}L" for x in BASES for y in BASES) + ")"


def placed_stretches(templates: DataFrame, keys: list[str], low: int, high: int, first: str, last: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Stretches of ``low`` to ``high`` clean bases that start from ``first`` to ``last`` (SQL over the carried columns and
    the template's length ``_n``): keys, carried columns, start, len, plus.

    Where they fit, ``_code`` is the two-bit code of ``plus``: the longest stretch of a place is read once, and the codes
    of the shorter ones are its first bits.  The key of a template may repeat.
    """
    coded = high <= MAX_CODED
    unclear = F.col("template").rlike("[^ACGT]")
    clear_text = F.when(unclear, F.regexp_replace("template", "[^ACGT]", "A")).otherwise(F.col("template"))
    ready = templates.filter(F.length("template") >= low).select(
        *keys, *carried, "template", F.length("template").alias("_n"), unclear.alias("_unclear"), F.col("template").cast("binary").alias("_b"),
        *([base_digits(clear_text).cast("binary").alias("_digits")] if coded else []))
    ready = spread(ready, *keys).filter(f"{first} <= {last}")
    places = ready.select("*", F.explode(F.expr(f"sequence({first}, {last})")).alias("start"))
    cut = lambda name: F.substring(name, F.col("start") + 1, F.lit(high))
    # Bytes are cut where they are letters, so that no cut walks the template.
    made = {"_here": F.when(F.col("_unclear"), cut("template")).otherwise(cut("_b").cast("string"))}
    if coded:
        made["_all"] = digits_to_code(F.rpad(cut("_digits").cast("string"), high, F.lit("0")))
    kept = [*keys, *carried, "_n", "_unclear", "start"]
    rows = once(places.select(*kept, "template", "_b", *(["_digits"] if coded else [])), **made).select(
        *kept, *made, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("len")).filter("start + len <= _n")
    rows = rows.withColumn("plus", F.expr("left(_here, len)")).filter("not _unclear or not plus rlike '[^ACGT]'")
    code = [F.expr(f"shiftrightunsigned(_all, 2 * ({high} - len))").alias("_code")] if coded else []
    return rows.select(*keys, *carried, "start", "len", "plus", *code)


def scored_stretches(
    templates: DataFrame, keys: list[str], low: int, high: int, tm: tuple[float, float], gc: tuple[float, float],
    carried: tuple[str, ...] = (), wanted: Column | None = None,
) -> DataFrame:
    """Stretches of ``low`` to ``high`` clean bases within the limits: keys, carried columns, start, len, plus, gc, tm.

    ``keys`` tell the templates apart.  What a stretch adds up to is the running sum at its last base less that at its
    first, so each base of a template is looked at once, whatever the number of lengths; the running sums of all
    parts are one number.  ``wanted`` is a condition on start, len and the carried columns.
    """
    if high > MAX_SUMMED:
        raise ValueError(f"stretches of at most {MAX_SUMMED} bases, not {high}")
    ready = templates.filter(F.length("template") >= low).select(*keys, *carried, "template")
    bases = spread(ready, *keys).select(
        *keys, *carried, F.col("template").cast("binary").alias("_b"),
        F.explode(F.expr("sequence(0, length(template) - 1)")).alias("start"),
    )
    bases = bases.select(*keys, *carried, "start", F.substring("_b", F.col("start") + 1, F.lit(high)).cast("string").alias("_text"))
    at = lambda place: f"instr('{BASES}', substr(_text, {place}, 1)) - 1"
    bases = bases.withColumns({"_x": F.expr(at(1)), "_y": F.expr(at(2))})
    # The last base of a stretch opens no step of it, so what follows the template does not matter.
    step = F.expr(f"if(_x >= 0 and _y >= 0, get({_step_values()}, 4 * _x + _y), 0L)")
    counts = F.expr(f"if(_x between 1 and 2, {1 << _GC_AT}L, 0L) + if(_x < 0, {1 << _UNCLEAR_AT}L, 0L)")
    along = W.partitionBy(*keys).orderBy("start")
    before = F.coalesce(F.sum("_value").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = bases.withColumn("_value", step + counts).withColumn("_sum", before * 8 + F.when(F.col("_x") < 0, 4).otherwise(F.col("_x")))
    bases = bases.withColumn("_ends", F.array(*[F.lead("_sum", n - 1).over(along) for n in range(low, high + 1)]))
    rows = bases.select(*keys, *carried, "start", "_text", "_sum", F.posexplode("_ends").alias("_nth", "_end"))
    rows = rows.withColumn("len", F.col("_nth") + low).filter("_end is not null")
    if wanted is not None:
        rows = rows.filter(wanted)
    rows = rows.withColumns({
        "_run": F.expr("shiftright(_end, 3) - shiftright(_sum, 3)"), "_first": F.expr("int(_sum & 7L)"), "_last": F.expr("int(_end & 7L)"),
    }).filter(f"shiftright(_run, {_UNCLEAR_AT}) = 0 and _last < 4")
    share = F.expr(f"int(shiftright(_run, {_GC_AT}) & {(1 << _COUNT_BITS) - 1}L) + if(_last between 1 and 2, 1, 0)") * F.lit(100.0) / F.col("len")
    rows = once(rows, gc=share).filter(F.col("gc").between(*gc))
    rows = rows.withColumns({
        "plus": F.expr("left(_text, len)"), "_dh": F.expr(f"-int(_run & {(1 << _DH_BITS) - 1}L)"),
        "_ds": F.expr(f"-int(shiftright(_run, {_DH_BITS}) & {(1 << _DS_BITS) - 1}L)"),
        "_weak": F.expr("if(_first in (0, 3), 1, 0) + if(_last in (0, 3), 1, 0)"),
    })
    # Only an even stretch whose ends pair can be its own reverse complement.
    itself = "if(len % 2 = 0 and _first + _last = 3, plus = reverse(translate(plus, 'ACGT', 'TGCA')), false)"
    ends = [f"({TERMINAL_AT[i]} * _weak + {TERMINAL_GC[i]} * (2 - _weak))" for i in (0, 1)]
    rows = once(rows, tm=F.expr(_tm_text("plus", "_dh", "_ds", itself, ends))).filter(F.col("tm").between(*tm))
    return rows.select(*keys, *carried, "start", "len", "plus", "gc", "tm")
