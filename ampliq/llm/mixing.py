"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliq.llm.common import SPACE, rank_among, words
from ampliq.session import cut_lineage

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Points of the golden-ratio sequence are multiples of 1 / 2^31; the step is odd, so all of them come up.
POINTS, STEP = 1 << 31, 1_327_217_885
#: Slots that are ranked together, and hexadecimal digits that split a source for its running sums.
CHUNK, DIGITS = 65_536, 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Target size of each source: ``weights`` repeat over the sources by code point, null last.

    Targets share the whole size by weight; none exceeds ``cap`` times its source, and what is over is shared among
    the others.  By ascending capacity per weight the capped sources come first, so running sums find the level at
    which the rest is shared.  The table has one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.get(F.lit(list(weights)), F.pmod("nth", F.lit(len(weights))))
    ranked = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    open_level = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level"))
    shared = F.first(open_level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most").cast("double"), F.coalesce(shared, F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "nth", "source_size", target.alias("target"))


def slots(targets: DataFrame, block_words: int) -> DataFrame:
    """The schedule: for each slot its source (``nth``) and how many slots that source had before (``block``).

    Slot k takes the k-th golden-ratio point through the cumulative targets, so every stretch of the schedule has
    nearly the right shares.  A source that gets fewer slots than its target has blocks, as small ones may, has the
    missing ones appended at the end.  Ranks are counted within chunks of slots and then carried over, so no source
    meets in one task.
    """
    spark = targets.sparkSession
    rows = targets.orderBy("nth").select("nth", F.round("target").cast("long").alias("wanted")).collect()
    total = sum(row.wanted for row in rows)
    if not total:
        return spark.createDataFrame([], "slot long, nth int, block long")
    ends, bounds = 0, []
    for row in rows[:-1]:
        ends += row.wanted
        bounds.append(math.floor(float(ends) / float(total) * POINTS))
    n_slots = -(-total // block_words) + 4 * len(rows)
    numbered = spark.range(n_slots).withColumnRenamed("id", "slot")
    point = (F.col("slot") % POINTS) * STEP % POINTS
    numbered = numbered.withColumn("nth", rank_among(point, bounds)).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    own = Window.partitionBy("chunk", "nth").orderBy("slot")
    earlier = Window.partitionBy("nth").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = numbered.groupBy("chunk", "nth").count().select(
        "chunk", "nth", "count", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("carried")
    )
    numbered = numbered.withColumn("within", F.row_number().over(own)).join(carried.drop("count"), ["chunk", "nth"])
    drawn = numbered.select("slot", "nth", (F.col("carried") + F.col("within") - 1).alias("block"))
    held = carried.groupBy("nth").agg(F.sum("count").alias("held"))
    blocks = F.ceil(F.round("target").cast("long") / block_words)
    short = targets.select("nth", blocks.alias("blocks")).join(held, "nth", "left")
    short = short.withColumn("held", F.coalesce("held", F.lit(0))).where("blocks > held")
    before = F.sum(F.col("blocks") - F.col("held")).over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    short = short.withColumn("before", F.coalesce(before, F.lit(0)))
    short = short.withColumn("block", F.explode(F.sequence("held", F.col("blocks") - 1)))
    added = short.select((n_slots + F.col("before") + F.col("block") - F.col("held")).alias("slot"), "nth", "block")
    return drawn.unionByName(added)


def laid_out(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Each row's place in the shuffled stream of its source: ``start`` is the number of words before it.

    The order is that of a digest of seed and doc_id; running sums go over digest ranges and then within them.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = sized.withColumn("mark", mark).withColumn("part", F.substring("mark", 1, DIGITS))
    named = targets.withColumnRenamed("source", "_source")
    rows = rows.join(named, rows.source.eqNullSafe(named._source)).drop("_source")
    earlier = Window.partitionBy("nth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("nth", "part").agg(F.sum("size").alias("part_size")).select(
        "nth", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before")
    )
    own = Window.partitionBy("nth", "part").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0))).join(parts, ["nth", "part"])
    return rows.withColumn("start", F.col("before") + F.col("own")).drop("own", "before", "part", "mark")


def scheduled_pieces(placed: DataFrame, schedule: DataFrame, block_words: int, cap: int = 3) -> DataFrame:
    """The mixture itself: which words of which document each slot takes.

    A source's stream is repeated up to ``cap`` times and cut into blocks of ``block_words``; slot and block are
    joined one to one, and a source's last block ends where its target is reached.
    Result: slot, nth, start, doc_id, from_word, to_word.
    """
    wanted = F.round("target").cast("long")
    again = F.sequence(F.lit(0), F.lit(cap - 1))
    passes = placed.where("size > 0").withColumn("turn", F.explode(again))
    passes = passes.withColumn("begin", F.col("start") + F.col("turn") * F.col("source_size"))
    passes = passes.withColumn("end", F.least(F.col("begin") + F.col("size"), wanted)).where("end > begin")
    block = F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))
    pieces = passes.withColumn("block", F.explode(block)).join(schedule, ["nth", "block"])
    first = F.greatest(F.col("begin"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return pieces.select(
        "slot", "nth", "start", "doc_id", (first - F.col("begin")).alias("from_word"), (last - F.col("begin")).alias("to_word")
    )


def mix(docs: DataFrame, block_words: int = 64, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """How many words the mixture takes of each document (doc_id, source, size, source_size, target, taken).

    Size is the number of words; null, empty and blank texts have none and are taken 0 times.  A null source is a
    source of its own; a null doc_id is ordered like an empty one.  Repeated rows are documents of their own.  The
    driver holds one number per source.  Only ids, sources and sizes are exchanged, never texts.
    """
    sized = cut_lineage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    targets = cut_lineage(source_targets(sized, weights, cap))
    placed = cut_lineage(laid_out(sized, targets, seed))
    pieces = scheduled_pieces(placed, slots(targets, block_words), block_words, cap)
    taken = pieces.groupBy("nth", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    keys = [placed.nth == taken.nth, placed.start == taken.start, placed.size > 0]
    return placed.join(taken, keys, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, block_words: int = 64, seed: int = 7) -> DataFrame:
    """The documents as the mixture takes them: one row for each whole pass, and one cut after its last word taken
    where a source's target ends within a document, so that each source has the words that the mixture gives it.

    A cut row's ``text`` ends with the last word taken, spaces before it as they were, and its ``n_chars`` (where
    present) tells its new length.  Rows that agree in doc_id, source and size share what is taken of them equally, to
    a word.  Documents without words, and those of which nothing is taken, have no row; an empty table gives an empty
    result.  Columns stay as they are.
    """
    keys = ["doc_id", "source", "size"]
    taken = mix(docs, block_words, seed).groupBy(*keys).agg(F.round(F.sum("taken") / F.count("taken")).cast("long").alias("taken"))
    taken = taken.where("taken > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "taken")
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = rows.join(taken, same).select("row", "size", F.explode(passes("taken", "size")).alias("n"))
    text = F.when(F.col("n") < F.col("size"), first_words(F.col("row")["text"], F.col("n"))).otherwise(F.col("row")["text"])
    rows = rows.select("row", "size", "n", text.alias("_text"))
    made = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("n") < F.col("size"), F.length("_text").cast(kind)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def passes(taken: str, size: str) -> Column:
    """Words of each pass over a document of which ``taken`` words are used: whole passes, then what is left."""
    whole = F.array_repeat(F.col(size), F.floor(F.col(taken) / F.col(size)).cast("int"))
    left = F.pmod(F.col(taken), F.col(size))
    return F.concat(whole, F.when(left > 0, F.array(left)).otherwise(F.expr("cast(array() as array<bigint>)")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"(?:{SPACE})?{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")
