"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliq.joins import once

#: The template.  A block is OPEN role NAMED text (AND text)* CLOSE; texts hold none of these after escaping.
OPEN, NAMED, AND, CLOSE = "### ", ": ", "<also>", "</turn>\n"
_BACK = "\\"
#: What stands for control strings inside texts and roles; the escape character itself comes first.
_TEXT_ESCAPES = [(_BACK, _BACK + "s"), ("###", _BACK + "h"), ("<also>", _BACK + "a"), ("</turn>", _BACK + "t")]
_ROLE_ESCAPES = [*_TEXT_ESCAPES, (": ", _BACK + "c")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, _TEXT_ESCAPES)


def unescaped(text: Column) -> Column:
    # In escaped text each escape character begins a pair, so these can be put back one after the other.
    return _replaced(text, [(new, old) for old, new in reversed(_ROLE_ESCAPES)])


def merged_blocks(turns: Column) -> Column:
    """Adjacent turns of the same role as one block: array of (role, texts), in time linear in the turns."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(turns, i).getField("role") != F.get(turns, i - 1).getField("role")),
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    return F.transform(F.arrays_zip(starts.alias("first"), ends.alias("after")), lambda b: F.struct(
        F.get(turns, b["first"]).getField("role").alias("role"),
        F.transform(F.slice(turns, b["first"] + 1, b["after"] - b["first"]), lambda t: t["text"]).alias("texts"),
    ))


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, ``formatted`` text and ``loss_spans``.

    Turns are sorted by (turn, role, text), nulls first; rows that are equal stay apart.  Null roles and texts count
    as empty; rows without a conv_id are one conversation.  Adjacent turns of one role share a block.  ``loss_spans``
    are (skip, take) lengths in code points: each text of the role ``learn``, without marks or separators.  Other
    columns are left out; an empty table gives an empty result.  A conversation is one text and thus one row.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = once(chats, blocks=merged_blocks(F.col("turns"))).drop("turns")
    safe = F.transform("blocks", lambda b: F.struct(
        (b["role"] == learn).alias("on"), _replaced(b["role"], _ROLE_ESCAPES).alias("role"),
        F.transform(b["texts"], escaped).alias("texts"),
    ))
    chats = once(chats.select("conv_id", safe.alias("blocks")), _formatted=F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), b["role"], F.lit(NAMED), F.array_join(b["texts"], AND), F.lit(CLOSE),
    )), ""))
    # Lengths in a row: what is skipped before each text, the text, and whether it is learnt from.
    runs = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.length(b["role"]) + len(OPEN) + len(NAMED)).otherwise(len(AND)).alias("before"),
        F.length(t).alias("chars"),
        F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("behind"),
        b["on"].alias("on"),
    ))))
    chats = chats.select("conv_id", F.col("_formatted").alias("formatted"), runs.alias("runs"))
    spans = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("skip"), F.expr("cast(array() as array<struct<skip:int,take:int>>)").alias("spans")),
        lambda acc, r: F.struct(
            F.when(r["on"], r["behind"]).otherwise(acc["skip"] + r["before"] + r["chars"] + r["behind"]).alias("skip"),
            F.when(r["on"], F.array_append(acc["spans"], F.struct(
                (acc["skip"] + r["before"]).alias("skip"), r["chars"].alias("take"),
            ))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, still escaped: array of its spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<string>)").alias("texts")),
        lambda acc, s: F.struct(
            (acc["at"] + s["skip"] + s["take"]).alias("at"),
            F.array_append(acc["texts"], F.substr(formatted, acc["at"] + s["skip"], s["take"])).alias("texts"),
        ),
        lambda acc: acc["texts"],
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    marked = F.filter(F.split(formatted, r"\Q</turn>\E\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substr(block, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, NAMED, 1)
        texts = F.split(F.substr(body, F.length(role) + len(NAMED) + 1), AND, -1)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(marked, turns))
