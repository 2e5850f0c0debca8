"""SimHash document fingerprints and the search for all fingerprints within a Hamming radius."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliq.joins import once
from ampliq.llm.common import rank_among, words

BITS = 64
_PAIR = (1 << 32) + 1


def weighted_terms(listed: Column | str) -> Column:
    """Terms of a word list: each word with its successor, weighing as much as both have letters.

    ``listed`` must be a column of its own, as it is looked into for each word.
    """
    listed = F.col(listed) if isinstance(listed, str) else listed

    def term(word: Column, place: Column) -> Column:
        after = F.get(listed, place + 1)
        weight = F.length(word) + F.coalesce(F.length(after), F.lit(0))
        return F.struct(F.xxhash64(word, after).alias("term"), weight.cast("long").alias("weight"))

    return F.transform(listed, term)


def _votes() -> list[Column]:
    """Sums of the weights that vote for each bit; bits i and i + 32 share one number."""
    return [
        F.sum(F.shiftrightunsigned("term", i).bitwiseAND(_PAIR) * F.col("weight")).alias(f"votes{i}") for i in range(32)
    ] + [F.sum("weight").alias("votes")]


def _fingerprint() -> Column:
    """The bits whose votes for outweigh the votes against; no bit for a document without terms."""
    bits = []
    for i in range(32):
        both = F.col(f"votes{i}")
        for bit, one in ((i, both.bitwiseAND((1 << 32) - 1)), (i + 32, F.shiftrightunsigned(both, 32))):
            bits.append(F.shiftleft((2 * one > F.col("votes")).cast("long"), bit))
    return F.coalesce(functools.reduce(Column.bitwiseOR, bits), F.lit(0).cast("long"))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text", name: str = "fingerprint") -> DataFrame:
    """One 64-bit SimHash for each combination of ``keys``, which must tell the rows apart.

    Each term votes with its weight for the bits that its hash has and against the others.  Null, empty and
    blank texts have the fingerprint 0; equal texts have equal fingerprints; other columns are left out.
    No exchange is needed where the rows are already partitioned by some of the keys.
    """
    listed = once(df.select(*keys, text), _words=words(F.col(text))).drop(text)
    terms = listed.select(*keys, F.inline_outer(weighted_terms("_words")))
    return terms.groupBy(*keys).agg(*_votes()).select(*keys, _fingerprint().alias(name))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def _tables(radius: int, blocks: int) -> list[int]:
    """Masks of the block tables: with ``radius`` bits changed, some choice of the other blocks is whole."""
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(ends)]
    masks = [sum(chosen) for chosen in itertools.combinations(block, blocks - radius)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]


def within_radius(
    searched: DataFrame, asked: DataFrame, fingerprint: str = "fingerprint", radius: int = 3, blocks: int = 6
) -> DataFrame:
    """All pairs (asked, found, distance) of different fingerprints at most ``radius`` bits apart.

    Both sides are made distinct first, so copies cost nothing.  Each table keys the fingerprints on some of their
    blocks; a pair counts in the first table in which it agrees, so that none comes twice.  Nulls take no part.
    """
    masks = _tables(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(fingerprint).alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = F.array(*[F.col(name).bitwiseAND(mask) for mask in masks])
        return one.select(name, F.posexplode(keys).alias("table", "key"))

    apart = F.col("asked").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(mask) == 0, F.lit(t)) for t, mask in enumerate(masks)])
    pairs = keyed(asked, "asked").join(keyed(searched, "found"), ["table", "key"])
    pairs = pairs.where((F.bit_count(apart) <= radius) & (apart != 0) & (F.col("table") == first))
    return pairs.select("asked", "found", F.bit_count(apart).alias("distance"))


def with_next(docs: DataFrame, rows_per_bucket: int = 500, max_buckets: int = 65_536) -> DataFrame:
    """Each document with the text of the next one by descending doc_id; after the last comes the first.

    Documents are dealt to id ranges between quantiles, and each range gets the head of the following one as an
    extra row (``real`` = 0), so one exchange serves the whole table.  Null ids come last; equal ids are ordered by
    text, and rows equal in both are interchangeable.  Result: bucket, place, real, doc_id, text, next_text.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_buckets = min(max_buckets, max(1, base.count() // rows_per_bucket))
    cuts = [k / n_buckets for k in range(1, n_buckets)]
    bounds = base.agg(F.percentile_approx("doc_id", cuts, 10 * n_buckets)).first()[0] if cuts else []
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(rank_among(F.col("doc_id"), sorted(set(bounds or []))))
    placed = base.withColumn("bucket", bucket)

    # One row per bucket, so at most max_buckets + 1 rows are broadcast.
    tops = placed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    row = Window.orderBy("bucket")
    tops = tops.select(
        "bucket", "top",
        F.coalesce(F.lead("bucket").over(row), F.first("bucket").over(row)).alias("above"),
    )
    heads = placed.join(F.broadcast(tops), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("above").agg(F.max("text").alias("text"))
    rows = placed.select("bucket", F.lit(1).alias("real"), "doc_id", "text").unionByName(
        heads.select(F.col("above").alias("bucket"), F.lit(0).alias("real"), F.lit(None).cast("long").alias("doc_id"), "text")
    )
    order = Window.partitionBy("bucket").orderBy(F.desc("real"), F.desc_nulls_last("doc_id"), F.desc("text"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order)})


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document's text and of an edited text, and how alike they and the next document's are.

    The edited text has its last half replaced by the beginning of the next document.  A null text counts as empty;
    a document alone in its table is its own next one; every row of the input gives one row.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - half), F.coalesce("next_text", F.lit("")).substr(F.lit(1), half)
    )
    rows = once(with_next(docs), edited=edited)
    keys = ["bucket", "place", "real", "doc_id", "n_chars", "edited_sha256", "version"]
    versions = rows.select(
        "bucket", "place", "real", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("version"), F.col("text").alias("words_of")),
            F.struct(F.lit(1).alias("version"), F.col("edited").alias("words_of")),
        )),
    )
    both = fingerprints(versions, keys, "words_of")
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("fingerprint")))
    each = both.groupBy(*keys[:-1]).agg(of(0).alias("own"), of(1).alias("edited"))
    order = Window.partitionBy("bucket").orderBy("place")
    each = each.withColumn("next", F.lead("own").over(order)).where("real = 1")
    return each.select(
        "doc_id", "n_chars", "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
