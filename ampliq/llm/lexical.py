"""Ranked lexical search by pipelined term partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.joins import counted_lookup
from ampliq.llm.common import LOWER, UPPER, lower_ascii
from ampliq.session import cut_lineage

#: Fixed value: what separates terms.  In UTF-8 its complement is made of ASCII letters, digits and all bytes from 0x80.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TO_TERMS = bytes(_LETTERS[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Most distinct terms of the items, and bytes of them, that tasks are given to keep only those; beyond, a join keeps them.
_GIVEN_TERMS, _GIVEN_BYTES = 1_000_000, 64 << 20

_INDEX = (
    "segment long, term string, places array<int>, times array<int>, docs long, most long, shortest long, "
    "ids array<long>, lengths array<long>, nameless long"
)


def _inverted(part: int, number: int, rows: list, postings: dict) -> pa.RecordBatch:
    """A segment: one row per term, and one with its documents.  Places go by rising doc_id, null last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    place = np.empty(len(rows), dtype=np.int32)
    place[order] = np.arange(len(rows), dtype=np.int32)
    lengths = np.array([rows[i][1] for i in order], dtype=np.int64)
    columns: dict[str, list] = {name.split()[0]: [] for name in _INDEX.split(", ")}
    for term, (found, times) in postings.items():
        at = place[np.array(found)]
        by = np.argsort(at)
        at, times = at[by], np.array(times, dtype=np.int32)[by]
        for name, value in zip(columns, (
            (part << 20) + number, term, at, times, len(at), int(times.max()), int(lengths[at].min()), None, None, None,
        )):
            columns[name].append(value)
    for name, value in zip(columns, (
        (part << 20) + number, None, None, None, int((lengths > 0).sum()), int(lengths.sum()), 0,
        np.array([rows[i][0] or 0 for i in order], dtype=np.int64), lengths, sum(r[0] is None for r in rows),
    )):
        columns[name].append(value)
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(name, types[kind]) for name, kind in (f.split() for f in _INDEX.split(", "))]
    # Terms are the bytes of valid strings; only their type changes.
    arrays = [pa.array(columns[f.name], pa.binary()).cast(pa.string()) if f.name == "term" else pa.array(columns[f.name], f.type) for f in fields]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def inverted_index(docs: DataFrame, wanted: frozenset | None, segment_docs: int, segment_postings: int = 2_000_000) -> DataFrame:
    """Postings of the ``wanted`` terms (all, if None) by segments of at most ``segment_docs`` documents, whole texts read.

    A segment is a stretch of a task's input, so nothing is exchanged.  Rows with a term are postings; the row
    without one has the documents (``docs`` those with terms, ``most`` all their terms).
    """
    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, postings, size, part = 0, [], {}, 0, 0
        for batch in batches:
            for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
                terms = text.translate(_TO_TERMS).split()
                counted = Counter(terms if wanted is None else filter(wanted.__contains__, terms))
                for term, times in counted.items():
                    at = postings.get(term)
                    if at is None:
                        at = postings[term] = ([], [])
                    at[0].append(len(held))
                    at[1].append(times)
                held.append((doc_id, len(terms)))
                size += len(counted)
                if len(held) >= segment_docs or size >= segment_postings:
                    yield _inverted(part, number, held, postings)
                    number, held, postings, size = number + 1, [], {}, 0
        if held:
            yield _inverted(part, number, held, postings)

    return rows.mapInArrow(invert, _INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """Terms of each item with their repeats.  Rows equal in id and text count once; those that share an id are one item."""
    terms = F.split(lower_ascii(F.coalesce("text", F.lit(""))), SEPARATORS, -1)
    distinct = items.select("item_id", "text").distinct()
    return distinct.select("item_id", F.explode(terms).alias("term")).where("term != ''").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def measure(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length norm of documents, exactly, whatever the size of the collection."""
    if len(lengths) and 25 * int(lengths.max()) * n_docs >= 1 << 63:
        lengths = lengths.astype(object)
    return (75 + 25 * lengths * n_docs // max(n_terms, 1)).astype(np.int64)


def gain(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 12 * norm)


def _stage(stage: int, last: bool, k: int, n_docs: int, n_terms: int):
    """One term owner's work on a bundle in a segment: add what its terms give, and pass on what can still win."""

    def add(bundle: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        if bundle.empty:
            return bundle.assign(ids=pd.Series(dtype=object)) if last else bundle
        docs = owned[owned["lengths"].notna()].iloc[0]
        norm = measure(np.asarray(docs["lengths"]), n_docs, n_terms)
        rows = {item: i for i, item in enumerate(bundle["item"])}
        scores = np.zeros((len(rows), len(norm)), dtype=np.int64)
        for i, (places, found) in enumerate(zip(bundle["places"], bundle["scores"])):
            scores[i, places] = found
        for places, times, items, weights in owned[owned["places"].notna()][["places", "times", "items", "weights"]].itertuples(index=False):
            at = np.array([rows[item] for item in items])
            scores[np.ix_(at, places)] += np.asarray(weights)[:, None] * gain(times.astype(np.int64), norm[places])[None, :]
        rest = np.array([sum(bounds[stage + 1 :]) for bounds in bundle["bounds"]], dtype=np.int64)
        places_out, scores_out, ids_out = [], [], []
        known = len(norm) - int(docs["nameless"])
        for i in range(len(rows)):
            found = np.nonzero(scores[i])[0]
            got = scores[i, found]
            if len(found) > k:
                # At least k documents of the segment end at or above this, as nothing is ever taken away.
                least = np.partition(got, len(got) - k)[len(got) - k]
                going = got + rest[i] >= least
                found, got = found[going], got[going]
            if last:
                best = np.lexsort((found, -got))[:k]
                found, got = found[best], got[best]
                ids_out.append([int(docs["ids"][p]) if p < known else None for p in found])
            places_out.append(found.astype(np.int32))
            scores_out.append(got)
        done = bundle.assign(places=places_out, scores=scores_out)
        return done.assign(ids=ids_out) if last else done

    return add


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, owners: int = 4, segment_docs: int = 8_192, bundle_items: int = 256
) -> DataFrame:
    """The ``k`` documents that score highest for each item: item_id, rank, doc_id, score.

    The terms are dealt to ``owners``, rare ones first.  Items travel in bundles of about ``bundle_items``, one for each
    segment of documents, and carry their sparse accumulators from owner to owner by a cogroup with that owner's
    postings; each owner adds its whole-number contributions.  An accumulator is dropped where even the most that later
    owners can add leaves it below the k-th best of its segment, so no document that could be among the best is lost.

    Null and blank texts have no terms and do not count as documents; texts are read whole.  Repeated rows are documents
    of their own; null ids come last among equal scores; rows of items that share an id are one item, equal ones once;
    an item without known terms has no row; other columns are not looked at; empty tables give an empty result.

    A task holds one segment: its accumulators are ``segment_docs`` by the items of a bundle.  Only counts and at most
    a bounded set of the items' terms pass through the driver.
    """
    spark = docs.sparkSession
    told = cut_lineage(item_terms(items))
    names = cut_lineage(told.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")))
    n_items = names.count()
    n_bundles = max(1, -(-n_items // bundle_items))
    size = told.select("term").distinct().agg(F.count("term").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    wanted = None
    if size.n <= _GIVEN_TERMS and (size.bytes or 0) <= _GIVEN_BYTES:
        wanted = frozenset(r.term.encode() for r in told.select("term").distinct().collect())
    index = cut_lineage(inverted_index(docs, wanted, segment_docs))
    seen = index.where("term is null").agg(F.sum("docs").alias("docs"), F.sum("most").alias("terms")).first()
    n_docs, n_terms = seen.docs or 0, seen.terms or 0
    if not n_items or not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    held = index.where("term is not null").join(told.select("term").distinct(), "term", "left_semi") if wanted is None else index.where("term is not null")
    terms = held.groupBy("term").agg(F.sum("docs").alias("df"))
    terms = cut_lineage(terms.withColumn("level", F.floor(F.log2("df")).cast("int")))
    # Owners by rising document frequency; there is a row per power of two.
    levels = terms.groupBy("level").agg(F.sum("df").alias("n")).orderBy("level").collect()
    total, before, owner_of = sum(r.n for r in levels), 0, {}
    for row in levels:
        owner_of[row.level] = min(owners - 1, owners * before // max(total, 1))
        before += row.n
    owner = F.element_at(F.create_map(*[F.lit(x) for pair in owner_of.items() for x in pair]), F.col("level")) if owner_of else F.lit(0)
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    # One row per term and bundle, with at most a bundle's items.
    asked = told.join(names, told.item_id.eqNullSafe(names.item_id)).select("term", "repeats", "item")
    asked = asked.join(terms, "term").select(
        "term", owner.alias("owner"), F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int").alias("bundle"), "item", (weight * F.col("repeats")).alias("weight"),
    )
    asked = asked.groupBy("term", "owner", "bundle").agg(F.collect_list(F.struct("item", "weight")).alias("by"))
    asked = cut_lineage(asked.select("term", "owner", "bundle", F.col("by.item").alias("items"), F.col("by.weight").alias("weights")))

    norm = F.expr(f"75 + (25 * cast(shortest as decimal(38,0)) * {n_docs}) div {max(n_terms, 1)}")
    most = F.expr("(1000000000L * most) div (1000 * most + 12 * norm)")
    bounds = held.select("segment", "term", "most", norm.alias("norm")).withColumn("gain", most)
    bounds = counted_lookup(bounds, asked, ["term"], "inner").select("segment", "bundle", "owner", "gain", F.explode(F.arrays_zip("items", "weights")).alias("by"))
    bounds = bounds.select("segment", "bundle", F.col("by.items").alias("item"), "owner", (F.col("gain") * F.col("by.weights")).alias("bound"))
    state = bounds.groupBy("segment", "bundle", "item").agg(*[F.sum(F.when(F.col("owner") == o, F.col("bound")).otherwise(0)).alias(f"b{o}") for o in range(owners)])
    state = state.select(
        "segment", "bundle", "item", F.array(*[f"b{o}" for o in range(owners)]).alias("bounds"),
        F.expr("cast(array() as array<int>)").alias("places"), F.expr("cast(array() as array<long>)").alias("scores"),
    )
    shape = "segment long, bundle int, item long, bounds array<long>, places array<int>, scores array<long>"
    keys = ["segment", "bundle"]
    of_docs = index.where("term is null").select("segment", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"), "ids", "lengths", "nameless")
    for stage in range(owners):
        last = stage == owners - 1
        postings = counted_lookup(held.select("segment", "term", "places", "times"), asked.where(F.col("owner") == stage), ["term"], "inner")
        owned = postings.select(*keys, "places", "times", "items", "weights").unionByName(
            of_docs.select(*keys, *(["ids"] if last else []), "lengths", "nameless"), allowMissingColumns=True
        )
        owned = owned.select(*[F.col(c).alias(c) for c in owned.columns])  # told apart from the bundles, which come from the same index
        state = state.groupBy(*keys).cogroup(owned.groupBy(*keys)).applyInPandas(
            _stage(stage, last, k, n_docs, n_terms), shape + (", ids array<long>" if last else "")
        )
    found = state.select("item", "segment", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    found = found.select("item", "segment", F.col("hit.ids").alias("doc_id"), F.col("hit.scores").alias("score"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    partly = Window.partitionBy("item", F.pmod("segment", F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(partly)).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)).cast("int")).where(F.col("rank") <= k)
    return counted_lookup(found, names, ["item"], "inner").select("item_id", "rank", "doc_id", "score")
