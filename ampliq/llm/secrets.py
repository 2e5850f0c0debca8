"""Secret scan: three patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.joins import once
from ampliq.llm.common import text_of, with_columns

#: The patterns of the scan's contract and the least lengths of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of fewer letters fails whole, and no part of it can succeed, so the least length may stand in the pattern.
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Counts times their logarithm, in millionths, so that sums are whole numbers.
_MILLION = 1_000_000
#: Windows of a candidate that are judged together.
_PIECE = 1024
#: A count of 0 is written as this character code.
_RAISED = 32


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of these characters only are secrets where a window has at least so many bits a character."""

    pattern: str
    least_bits: float


#: Narrow classes come first; each candidate belongs to the first that fits.
CLASSES = (
    CharacterClass(r"^[0-9]+$", 99.0),
    CharacterClass(r"^[0-9a-fA-F]+$", 2.9),
    CharacterClass(r"^[0-9a-z]+$", 3.6),
    CharacterClass(r"^[0-9A-Z]+$", 3.6),
    CharacterClass(r"^[A-Za-z0-9+/_=-]+$", 3.75),
)
#: A word by its letters' case: camel case with at most a short part at the end, or capitals.
_WORD = r"(?:[A-Z]{0,5}[a-z]++(?:[A-Z][a-z]{2,})*+(?:[A-Z][a-z]?)?|[A-Z]++)"
#: Candidates that are no secrets: words and joined words, dashed or slashed words, ids in canonical form, and the keys
#: of documentation, which end in EXAMPLE.  All hold for whole candidates, so a word beside a secret hides nothing.
ALLOWED = (
    rf"^{_WORD}?[0-9]{{0,4}}$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    rf"^[-_/=+]*+(?:(?:{_WORD}|[0-9]++)(?:[-_/=+]++|$))*+$",
    r"^[A-Za-z0-9+/]*[A-Za-z0-9]EXAMPLE(KEY)?$",
)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in order, as (start, end, found); positions in code points, end exclusive.

    What lies between the matches comes from splitting, and the lengths of both add up to the positions.
    """
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("whole"), found.alias("found")
    )
    spans = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["gap"]) + F.length(p["whole"])).alias("at"),
            F.array_append(acc["spans"], F.struct(
                (acc["at"] + F.length(p["gap"])).alias("start"),
                (acc["at"] + F.length(p["gap"]) + F.length(p["whole"])).alias("end"), p["found"].alias("found"),
            )).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)"))


def _as_kind(spans: Column, kind: str, offset: Column | int = 0) -> Column:
    order = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(
        (s["start"] + offset).alias("start"), F.lit(order).alias("kind"), (s["end"] + offset).alias("end"),
    ))


def base_spans(text: Column) -> Column:
    """Assignments, access keys and long hexadecimal runs: sorted array of (start, kind, end)."""
    assign = F.filter(_matches(text, ASSIGN, 1), lambda s: F.length(s["found"]) >= ASSIGN_LEAST)
    access = F.filter(_matches(text, ACCESS), lambda s: F.length(s["found"]) >= ACCESS_LEAST)
    runs = F.filter(_matches(text, HEX), lambda s: F.length(s["found"]) >= HEX_LEAST)
    return F.sort_array(F.concat(_as_kind(assign, "assign"), _as_kind(access, "access"), _as_kind(runs, "hex")))


def _stretches(data: Column, begin: Column, most: Column, window: int) -> Column:
    """Stretches within one piece of a candidate; ``begin`` is the piece's place, ``most`` the largest sum a secret has.

    The counts of the window's characters are carried from place to place in a string: the character at place c tells
    the count of the character with code c, raised by ``_RAISED``.  A step changes the counts of the entering and the
    leaving character only, and with them the sum of count * log2(count).
    """
    weights = [round(c * math.log2(c) * _MILLION) if c else 0 for c in range(window + 2)]
    gains = F.lit([after - before for before, after in zip(weights, weights[1:])])
    code = lambda i: F.ascii(F.substr(data, i + 1, F.lit(1)).cast("string")) + 1
    last = F.length(data)
    # One step more than characters: a step judges the window that ended before it.
    places = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("i"), F.when(i < last, code(i)).alias("enters"), F.when(i >= window, code(i - window)).alias("leaves"),
    ))

    def step(acc: Column, x: Column) -> Column:
        count = lambda c: F.ascii(F.substr(acc["counts"], c, F.lit(1))) - _RAISED
        leaves = x["leaves"].isNotNull()
        same = F.coalesce(x["leaves"] == x["enters"], F.lit(False))
        less = F.when(leaves, F.get(gains, count(x["leaves"]) - 1)).otherwise(F.lit(0))
        more = F.get(gains, count(x["enters"]) - same.cast("int"))
        without = F.overlay(acc["counts"], F.char(count(x["leaves"]) - 1 + _RAISED), x["leaves"], F.lit(1))
        rest = F.when(leaves, without).otherwise(acc["counts"])
        counts = F.when(same, acc["counts"]).otherwise(
            F.overlay(rest, F.char(count(x["enters"]) + 1 + _RAISED), x["enters"], F.lit(1))
        )
        flagged = leaves & (acc["sum"] <= most)
        opens = flagged & (acc["to"] < x["i"] - window)
        return F.struct(
            (acc["sum"] - less + more).cast("long").alias("sum"), counts.alias("counts"),
            F.when(opens, x["i"] - window).otherwise(acc["from"]).alias("from"),
            F.when(flagged, x["i"]).otherwise(acc["to"]).alias("to"),
            F.when(opens, closed(acc)).otherwise(acc["spans"]).alias("spans"),
        )

    def closed(acc: Column) -> Column:
        span = F.struct((begin + acc["from"]).alias("start"), (begin + acc["to"]).alias("end"))
        return F.when(acc["to"] >= 0, F.array_append(acc["spans"], span)).otherwise(acc["spans"])

    start = F.struct(
        F.lit(0).cast("long").alias("sum"), F.lit(chr(_RAISED) * 128).alias("counts"), F.lit(-1).alias("from"),
        F.lit(-1).alias("to"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
    )
    return F.aggregate(places, start, step, closed)


def high_entropy(string: Column, least_bits: Column, window: int) -> Column:
    """Stretches of an ASCII string whose windows all have at least so many bits a character: array of (start, end).

    The window slides by one character at a time.  The string is cut into pieces that overlap by one character less
    than the window, so each window lies in one piece and the work grows with the length; touching stretches of
    neighbouring pieces are one.  The threshold is worked out once per string.  ``window`` is at most 200.
    """
    most = ((math.log2(window) - least_bits) * window * _MILLION).cast("long")
    given = F.array(F.struct(string.cast("binary").alias("data"), most.alias("most")))

    def whole(c: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.length(c["data"]) - window, F.lit(0)), F.lit(_PIECE))
        return F.flatten(F.transform(begins, lambda begin: _stretches(
            F.substr(c["data"], begin + 1, F.lit(_PIECE + window - 1)), begin, c["most"], window
        )))

    def joined(spans: Column) -> Column:
        first = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, F.greatest(i - 1, F.lit(0)))["end"] < s["start"]))
        final = F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i + 1)["start"] > s["end"], F.lit(True)))
        return F.zip_with(first, final, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

    # A one-element array binds what a lambda uses many times, so that it is worked out once.
    return F.flatten(F.transform(F.transform(given, whole), joined))


def entropy_spans(
    text: Column, window: int = 20, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED
) -> Column:
    """Stretches of high entropy inside candidate strings that no allow-list pattern fits: (start, kind, end)."""
    def suspicious(span: Column) -> Column:
        fits = F.lit(False)
        for pattern in allowed:
            fits = fits | span["found"].rlike(pattern)
        return ~fits

    def least(string: Column) -> Column:
        return F.coalesce(*[F.when(string.rlike(c.pattern), F.lit(c.least_bits)) for c in classes], F.lit(99.0))

    candidates = F.filter(_matches(text, CANDIDATE), suspicious)
    return F.flatten(F.transform(
        candidates, lambda s: _as_kind(high_entropy(s["found"], least(s["found"]), window), "entropy", s["start"])
    ))


def find_secrets(docs: DataFrame, text: str = "text", window: int = 20) -> DataFrame:
    """Every row with ``base`` and ``spans``: sorted arrays of (start, kind, end), kind as a place in ``KINDS``.

    Whole texts are scanned, each row on its own, in time that grows with their length, also where a text is one
    unbroken run.  ``spans`` holds all of ``base`` and those entropy stretches that no base span covers.  Null and
    empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result; input columns
    named ``base`` or ``spans`` are replaced.
    """
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), text_of(docs[text]).alias("text"))
    found = once(packed, base=base_spans(F.col("text")), more=entropy_spans(F.col("text"), window))
    more = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    return with_columns(found, "row", {"base": F.col("base"), "spans": F.sort_array(F.concat("base", more))})


def listed(spans: Column) -> Column:
    """Spans as text, like ``hex:3:43,entropy:50:90``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(KINDS), s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or stretch of overlapping spans, replaced by a mark."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (F.size(acc["parts"]) == 0)),
                F.concat(acc["parts"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))),
            ).otherwise(acc["parts"]).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1)),
    )


def masked_documents(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with their secrets masked and ``n_chars`` (where present) as the new text has; a null text stays null.

    Columns stay as they are, whatever their names; an empty table gives an empty result.
    """
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    found = find_secrets(docs.select(whole.alias("row"), F.col("text").alias("text")), "text", window)
    text = F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = once(found, shown=text)
    made = {"text": F.col("shown")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.size("spans") > 0, F.length("shown").cast("long")).otherwise(F.col("row")["n_chars"])
    return found.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
