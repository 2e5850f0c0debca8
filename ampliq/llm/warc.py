"""WARC archives: pages written as response and revisit records, and archives of any origin read back by verifying
the chain of record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliq.joins import counted_lookup, fits_broadcast
from ampliq.session import cut_lineage

#: Fixed values of the format: what opens a record, what ends its header and its block, and a revisit's profile.
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROLS = [*map(chr, range(0x21)), "\x7f"]
_M, _E = len(MAGIC), len(END)


def _safe(value: Column) -> Column:
    """Control characters and blanks percent-encoded, so that a value stays on its line."""
    clean = value
    for sign in _CONTROLS:
        clean = F.replace(clean, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), clean).otherwise(value)


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 100,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row; each partition becomes one uncompressed archive in the folder ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id becomes a response;
    the others become revisits, which name it and hold no payload.  Smaller payloads are all responses.

    A null payload is empty and a null URL has no line; control characters and blanks of a URL are percent-encoded.
    Rows that repeat both the payload and its smallest id are all responses.  A null id is larger than any other;
    where all ids of a payload are null, all its rows are responses.  Other columns are not looked at, whatever their
    names; an empty table gives archives without records.

    Only payloads that come more than once are looked up: one small row each, broadcast up to a counted limit, so
    that payloads are not exchanged; beyond it joined by digest, with frequent digests dealt out.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    repeated = rows.where(F.col("bytes") >= least_bytes).groupBy("digest")
    repeated = repeated.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    rows = counted_lookup(rows, cut_lineage(repeated.drop("n")), ["digest"])
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    block = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END),
        F.when(again, "").otherwise(F.col("body")),
    )
    rows = rows.select("*", again.alias("again"), block.alias("block"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", named("id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _safe(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", named("first")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"), F.col("block"),
    )
    # What a record is followed by stands in for the line break of a text file.
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(path)


def _field(head: Column, name: str) -> Column:
    """Value of a header line, whatever the case of its name; null where it is missing."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", 1), F.lit(""))


def _chains(starts: np.ndarray, successors: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the candidates of one split, by rising offset: where each one's chain leaves the split (-1: nowhere), and an
    interval of numbers such that x follows from y exactly if x's interval holds y's first number.

    Following successors makes a forest whose roots are the last candidates of chains; numbering it root first gives
    each candidate the interval of all those that lead to it.
    """
    n = len(starts)
    into = np.searchsorted(starts, successors)
    inside = successors + _M < total
    parent = np.where(inside & (into < n) & (starts[np.minimum(into, n - 1)] == successors), into, -1).tolist()
    leaves = np.where(inside, -1, successors).tolist()
    held = [1] * n
    for i in range(n):
        if parent[i] >= 0:
            held[parent[i]] += held[i]
    first, free, cursor = [0] * n, [0] * n, 0
    for i in range(n - 1, -1, -1):
        up = parent[i]
        if up < 0:
            first[i], cursor = cursor, cursor + held[i]
        else:
            first[i], leaves[i] = free[up], leaves[up]
            free[up] += held[i]
        free[i] = first[i] + 1
    return np.array(leaves, dtype=np.int64), np.array(first, dtype=np.int64), np.array(first, dtype=np.int64) + held


def _linked(batches: list[pa.RecordBatch]) -> pa.Table:
    """The chunks of one split with their offsets from its first chunk and their chains."""
    table = pa.Table.from_batches(batches)
    size = table["size"].to_numpy()
    starts = np.concatenate([[0], np.cumsum(size + _M)])
    total, at = int(starts[-1]), starts[:-1] - _M
    head, block = table["head_bytes"].to_numpy(), table["block_bytes"].fill_null(-1).to_numpy()
    candidate = block >= 0
    if table["split"][0].as_py() == 0:
        candidate[0] = False  # what comes before the first mark of a file
    successors = np.where(candidate, starts[:-1] + head + block + 2 * _E, -1)
    leaves, first, after = (np.full(len(size), -1, dtype=np.int64) for _ in range(3))
    if candidate.any():
        leaves[candidate], first[candidate], after[candidate] = _chains(at[candidate], successors[candidate], total)
    made = {"total": np.full(len(size), total), "at": at, "successor": successors, "leaves": leaves, "first": first, "after": after}
    for name, values in made.items():
        table = table.append_column(name, pa.array(values.astype(np.int64)))
    return table


def _splits_linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come in order, split by split; one split at a time is held, which the reader's split size bounds."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        files = batch.column("file").dictionary_encode().indices.to_numpy()
        splits = batch.column("split").to_numpy()
        turns = np.nonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1]))[0] + 1
        for low, high in zip([0, *turns], [*turns, batch.num_rows]):
            part = batch.slice(low, high - low)
            if held and (held[0].column("file")[0] != part.column("file")[0] or held[0].column("split")[0] != part.column("split")[0]):
                yield from _linked(held).combine_chunks().to_batches()
                held = []
            held.append(part)
    if held:
        yield from _linked(held).combine_chunks().to_batches()


_CHUNK = (
    "file string, split long, size long, head_bytes long, block_bytes long, head string, http string, payload_bytes long, "
    "payload_digest string, piece binary"
)


def _chunk_table(spark: SparkSession, path: str, with_bytes: bool, files: DataFrame | None = None) -> DataFrame:
    """The stretches between marks with their absolute offsets: each is a candidate record (where its header can be read,
    ``successor`` is not null) or a piece of a payload.  Written, so that split numbers stay what they are.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    if files is not None and fits_broadcast(files):
        raw = raw.join(F.broadcast(files), "file", "left_semi")  # keeps the order, as nothing is exchanged
    size = F.octet_length("value").cast("long")
    head = F.substring_index("value", END, 1)
    raw = raw.select("file", "split", "value", size.alias("size"), head.alias("head"))
    headed = F.octet_length("head") < F.col("size")
    number = F.regexp_extract("head", r"(?im)^Content-Length[ \t]*:[ \t]*([0-9]{1,15})[ \t]*\r?$", 1)
    raw = raw.select(
        "file", "split", "value", "size", F.octet_length("head").cast("long").alias("head_bytes"),
        F.when(headed & (number != ""), number.cast("long")).alias("block_bytes"), F.when(headed & (number != ""), F.col("head")).alias("head"),
    )
    whole = F.col("head_bytes") + F.col("block_bytes") + 2 * _E == F.col("size")
    block = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + _E + 1).cast("int"), F.col("block_bytes").cast("int"))
    raw = raw.withColumn("block", F.when(whole, block.cast("string")))
    is_http = F.lower(_field(F.col("head"), "Content-Type")).startswith("application/http") & F.contains("block", F.lit(END))
    http = F.when(is_http, F.substring_index("block", END, 1))
    raw = raw.withColumn("http", http)
    before = F.coalesce(F.octet_length("http") + _E, F.lit(0))
    payload = F.substring(F.col("block").cast("binary"), before + 1, (F.col("block_bytes") - before).cast("int"))
    raw = raw.select(
        "file", "split", "size", "head_bytes", "block_bytes", "head", "http", (F.col("block_bytes") - before).alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"), F.col("value").cast("binary").alias("piece") if with_bytes else F.lit(None).cast("binary").alias("piece"),
    ).withColumn("payload_bytes", F.when(F.col("payload_digest").isNotNull(), F.col("payload_bytes")))
    added = ", ".join(f"{name} long" for name in ("total", "at", "successor", "leaves", "first", "after"))
    found = cut_lineage(raw.mapInArrow(_splits_linked, f"{_CHUNK}, {added}"))
    # How much of the file lies before each split: one row per split.
    before_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("file", "split").agg(F.max("total").alias("total"))
    bases = bases.select("file", "split", F.coalesce(F.sum("total").over(before_split), F.lit(0)).alias("base"))
    shifted = lambda name: F.when(F.col(name) >= 0, F.col("base") + F.col(name)).alias(name)
    placed = counted_lookup(found, cut_lineage(bases), ["file", "split"], "inner")
    return placed.select(
        "file", "split", (F.col("base") + F.col("at")).alias("at"), shifted("successor"), shifted("leaves"), "first", "after",
        "size", "head_bytes", "block_bytes", "head", "http", "payload_bytes", "payload_digest", "piece",
    )


def _entries(chunks: DataFrame) -> DataFrame:
    """Of each split the first record that the chain from the file's start reaches, as (file, split, entry).

    Only candidates on which the chain of another split lands, or which start a file, are nodes.  Each round joins
    the reached ones with pointers twice as long as in the round before.
    """
    candidates = chunks.where("successor is not null")
    nodes = candidates.select("file", F.col("at"), "split", "leaves", "first")
    landed = candidates.where("leaves is not null").select("file", F.col("leaves").alias("at")).distinct()
    nodes = cut_lineage(nodes.join(landed, ["file", "at"], "left_semi").unionByName(nodes.where("at = 0")).distinct())
    reached = cut_lineage(nodes.where("at = 0").select("file", "at"))
    jumps = cut_lineage(nodes.where("leaves is not null").select("file", "at", F.col("leaves").alias("to")))
    per_file = nodes.groupBy("file").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range(max(0, (per_file - 1).bit_length())):
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = cut_lineage(reached.unionByName(further).distinct())
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = cut_lineage(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")))
    return nodes.join(reached, ["file", "at"]).select("file", "split", F.col("first").alias("entry"))


def _stitched(records: pd.DataFrame) -> pd.DataFrame:
    """One record from its pieces, which may hold marks themselves."""
    records = records.sort_values("at")
    lead = records.iloc[0]
    data = MAGIC.encode().join(records["piece"])
    block = data[lead["head_bytes"] + _E :][: lead["block_bytes"]]
    if len(block) < lead["block_bytes"]:  # the archive ends within it
        return pd.DataFrame(columns=["file", "at", "head", "http", "payload_bytes", "payload_digest", "piece"])
    http, typed = None, [line for line in lead["head"].lower().split("\r\n") if line.replace(" ", "").startswith("content-type:application/http")]
    if typed and END.encode() in block:
        head, block = block.split(END.encode(), 1)
        http = head.decode("utf-8", "replace")
    return pd.DataFrame([{
        "file": lead["file"], "at": lead["at"], "head": lead["head"], "http": http, "payload_bytes": len(block),
        "payload_digest": hashlib.sha256(block).hexdigest(), "piece": block,
    }])


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of uncompressed WARC/1.1 archives: file, offset, record_type, record_id, target_uri, refers_to, header_digest,
    payload_bytes, payload_digest, intact and payload (null unless asked for).

    Splits are read anywhere in a file.  Each task takes every mark for a candidate record and emits its offset and
    that of its successor, which the header's length gives; pointers that double in length then run from the start of
    each file, and only records that they reach stay, so marks inside payloads count for nothing.  A record whose
    payload holds marks is put together from its pieces.  Records after a break in the chain are not returned.

    Of a response, length and digest are those of the payload as read, and ``intact`` says whether the header gives
    the same digest (null where it gives none); of a revisit, which holds no payload, they are those that its headers
    give.  Missing fields are null; an archive without records gives no rows.  A record is at most a row.
    """
    chunks = _chunk_table(spark, path, with_payload)
    entries = cut_lineage(_entries(chunks))
    reached = counted_lookup(chunks.where("successor is not null"), entries, ["file", "split"], "inner")
    kept = reached.where("first <= entry and entry < after")
    columns = ["file", "at", "head", "http", "payload_bytes", "payload_digest", "piece"]
    skipped = F.col("head_bytes") + _E + F.coalesce(F.octet_length("http") + _E, F.lit(0))
    payload = F.substring("piece", (skipped + 1).cast("int"), F.col("payload_bytes").cast("int")).alias("piece")
    whole = kept.where("payload_digest is not null").select(*columns[:-1], payload)

    # Records that hold marks: their owners are few numbers; pieces are read anew where bytes were not kept.
    owners = cut_lineage(kept.where("payload_digest is null").select("file", "at", F.col("successor").alias("end"), "head_bytes", "block_bytes", "head"))
    if owners.isEmpty():
        records = whole
    else:
        source = chunks if with_payload else _chunk_table(spark, path, True, cut_lineage(owners.select("file").distinct()))
        parts = source.select("file", "split", "at", "piece").join(owners.select("file", "at", "end"), ["file", "at"], "left")
        own = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        span = F.when(F.col("end").isNotNull(), F.struct("at", "end"))
        parts = parts.withColumn("owner", F.last(span, ignorenulls=True).over(own))
        # What a split's first pieces belong to is the last owner of the splits before: one row per split.
        last = parts.groupBy("file", "split").agg(F.max("owner").alias("owner"))
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        carried = cut_lineage(last.select("file", "split", F.last("owner", ignorenulls=True).over(earlier).alias("carried")))
        parts = counted_lookup(parts, carried, ["file", "split"], "left").withColumn("owner", F.coalesce("owner", "carried"))
        parts = parts.where(F.col("at") < F.col("owner.end")).select("file", F.col("owner.at").alias("record"), "at", "piece")
        parts = parts.join(owners.select("file", F.col("at").alias("record"), "head_bytes", "block_bytes", "head"), ["file", "record"])
        shape = "file string, at long, head string, http string, payload_bytes long, payload_digest string, piece binary"
        torn = parts.groupBy("file", "record").applyInPandas(_stitched, shape)
        records = whole.unionByName(torn)

    told = lambda name: _field(F.col("head"), name)
    named = lambda name: F.regexp_extract(told(name), r"^<(?:urn:page:)?(.*)>$", 1)
    revisit = F.col("record_type") == "revisit"
    records = records.select(
        "*", F.lower(told("WARC-Type")).alias("record_type"), named("WARC-Record-ID").alias("record_id"),
        told("WARC-Target-URI").alias("target_uri"), named("WARC-Refers-To").alias("refers_to"),
        F.lower(F.regexp_extract(told("WARC-Payload-Digest"), r"(?i)^sha256:(.*)$", 1)).alias("header_digest"),
    )
    length = _field(F.col("http"), "Content-Length").cast("long")
    return records.select(
        "file", F.col("at").alias("offset"), "record_type", "record_id", "target_uri", "refers_to", "header_digest",
        F.when(revisit, length).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(~revisit, F.nullif("header_digest", F.lit("")) == F.col("payload_digest")).alias("intact"),
        (F.col("piece") if with_payload else F.lit(None).cast("binary")).alias("payload"),
    )
