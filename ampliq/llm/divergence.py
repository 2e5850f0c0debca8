"""Source divergence audit: how far the term shares of sources lie from each other and from their language's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.joins import counted_lookup
from ampliq.llm.common import LOWER, UPPER
from ampliq.session import cut_lineage

#: Fixed value: shares are whole numbers of this.
SCALE = 1_000_000_000
#: Every ASCII character that is no letter separates terms; A-Z are lower-cased.  Other bytes are parts of terms.
_LETTERS = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TO_TERMS = bytes(_LETTERS[b] if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _counted(most_entries: int, most_bytes: int):
    """Counts of the terms of a task, given out whenever they hold that many entries or come from that much text."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        seen, read = 0, 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                terms = list(times)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * (len(terms) + 1), pa.string()), "source": pa.array([source] * (len(terms) + 1), pa.string()),
                    # The row without a term says that the group occurs.
                    "term": pa.array([None, *terms], pa.binary()), "n": pa.array([0, *times.values()], pa.int64()),
                    "docs": pa.array([0, *(docs[t] for t in terms)], pa.int64()),
                })

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                times, docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_TO_TERMS).split()
                before = len(times)
                times.update(terms)
                docs.update(set(terms))
                seen, read = seen + len(times) - before, read + len(text)
                if seen > most_entries or read > most_bytes:
                    yield from given()
                    held, seen, read = {}, 0, 0
        yield from given()

    return count


def term_counts(docs: DataFrame, most_entries: int = 500_000, most_bytes: int = 1 << 28) -> DataFrame:
    """Occurrences ``n`` of each term in each (lang, source), and the documents ``docs`` that hold it.

    Whole texts are read; null text, lang and source are empty.  Tasks sum up before anything is exchanged and keep a
    bounded table.  Each occurring group also has a row whose term is null.
    """
    filled = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    counts = filled.mapInArrow(_counted(most_entries, most_bytes), "lang string, source string, term binary, n long, docs long")
    return counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), by long division in steps that stay within 64 bits; 0 / 0 gives 1."""
    rest, total = np.broadcast_arrays(count + 2, total)
    if total.size and int(total.max()) > (1 << 63) // 1000 - 1:
        rest, total = rest.astype(object), total.astype(object)  # Python's whole numbers
    total = np.where(total == 0, rest * 0 + SCALE * 1000, total)
    found, rest = rest // total, rest % total
    for _ in range(3):
        found, rest = found * 1000 + rest * 1000 // total, rest * 1000 % total
    return (1 + found).astype(np.int64)


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def block_rows(counts: pd.DataFrame, groups: pd.DataFrame, low: int, high: int, first: bool, top: int) -> pd.DataFrame:
    """What one block of terms adds for the groups ``low`` to ``high`` - 1 of a language.

    ``counts`` are the postings of the block's terms (term, idx, n, total), ``groups`` all groups of the language by
    idx (size, terms, lang_size).  Row-wise accumulation: a group walks its terms, and each term's postings, found by
    the term-major index, are scattered into one dense accumulator over the peers behind the group.

    With f(p, q) the distance, z the share of a count of 0, and sums over the terms, the distance of groups g and t is
      sum f(z_g, z_t)  +  sum over g's terms of f(p, z_t) - f(z_g, z_t)  +  the same for t's
      +  sum over common terms of f(p, q) - f(p, z_t) - f(z_g, q) + f(z_g, z_t).
    The first is added by the first block alone; a group's row holds the second, for all peers, and the last.
    """
    groups = groups.sort_values("idx")
    n_groups, n_terms = len(groups), int(groups["terms"].iloc[0])
    totals = groups["size"].to_numpy(np.int64) + 2 * n_terms
    zero = share(np.zeros(n_groups, np.int64), totals)
    codes, names = pd.factorize(counts["term"], sort=False)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], counts["idx"].to_numpy(np.int64)[order]
    p = share(counts["n"].to_numpy(np.int64)[order], totals[owner]) if len(counts) else np.zeros(0, np.int64)
    heads = np.searchsorted(codes, np.arange(len(names) + 1))  # the term-major index
    by_group = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_group], np.arange(n_groups + 1))
    rows, found = [], []
    for g in range(low, min(high, n_groups)):
        mine = by_group[starts[g] : starts[g + 1]]
        if not len(mine) and not first:
            continue
        acc = np.zeros(n_groups, dtype=np.int64)
        both = apart(zero[g], zero)
        if first:
            acc[g + 1 :] += n_terms * both[g + 1 :]
        values, times = np.unique(p[mine], return_counts=True)
        step = max(1, (1 << 20) // max(1, n_groups))
        for at in range(0, len(values), step):
            base = apart(values[at : at + step, None], zero[None, :]) - both[None, :]
            acc += (base * times[at : at + step, None]).sum(axis=0)
        terms = codes[mine]
        lengths = heads[terms + 1] - heads[terms]
        ends = np.cumsum(lengths)
        postings = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(heads[terms] - (ends - lengths), lengths)
        behind = owner[postings] > g
        postings, own = postings[behind], np.repeat(p[mine], lengths)[behind]
        peer, theirs = owner[postings], p[postings]
        np.add.at(acc, peer, apart(own, theirs) - apart(own, zero[peer]) - apart(zero[g], theirs) + both[peer])
        acc[g] = 0
        rows.append((g, acc))
    if len(counts):
        ordered = counts.iloc[order]
        lang_size = int(groups["lang_size"].iloc[0])
        q = share(ordered["total"].to_numpy(np.int64), np.full(len(ordered), lang_size + 2 * n_terms))
        more = (p > q) & (ordered["n"].to_numpy() > 0) & (owner >= low) & (owner < high)
        found = pd.DataFrame({"idx": owner[more], "term": ordered["term"].to_numpy()[more], "value": apart(p[more], q[more])})
        found = found.sort_values(["idx", "value", "term"], ascending=[True, False, True]).groupby("idx").head(top)
        found = list(found.itertuples(index=False, name=None))
    return pd.DataFrame({
        "idx": [g for g, _ in rows] + [r[0] for r in found], "acc": pd.Series([acc for _, acc in rows] + [None] * len(found), dtype=object),
        "term": pd.Series([None] * len(rows) + [r[1] for r in found], dtype=object), "value": pd.array([None] * len(rows) + [r[2] for r in found], dtype="Int64"),
    })


def source_divergence(
    docs: DataFrame, least_docs: int = 10, top: int = 10, block_postings: int = 50_000, group_rows: int = 1_024
) -> DataFrame:
    """Per source of a language the distance to each other source, and the terms that it uses more than the language
    does: lang, source, part (``pair`` or ``term``), item, value, rank.

    A language keeps the terms that at least ``least_docs`` of its documents hold.  All arithmetic is in whole numbers.
    Terms are dealt to blocks of about ``block_postings`` postings by a hash, so a frequent language or source is many
    blocks; each block's index serves all its groups, at most ``group_rows`` rows of accumulators a task, and the rows
    are summed over the blocks.  No pair of postings is ever a row.

    Null text, lang and source are empty; blank texts make their group occur without terms; repeated rows are documents
    of their own; other columns, whatever their names, are not looked at; an empty table gives an empty result.  Where a
    language keeps no term, its pairs have the value 0 and there are no terms.  Ties go to the smaller item.
    """
    counts = cut_lineage(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    kept = counts.where("term is not null").withColumns({
        "total": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term),
        "once": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"),
    })
    kept = cut_lineage(kept.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", "once"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("once").alias("once"), F.count("term").alias("postings"))
    occurring = counts.where("term is null").select("lang", "source")
    whole = Window.partitionBy("lang")
    groups = occurring.join(sizes, ["lang", "source"], "left").fillna(0, ["size", "once", "postings"]).select(
        "lang", "source", "size", (F.row_number().over(whole.orderBy("source")) - 1).alias("idx"),
        F.sum("once").over(whole).alias("terms"), F.sum("size").over(whole).alias("lang_size"),
        F.greatest(F.ceil(F.sum("postings").over(whole) / block_postings), F.lit(1)).alias("blocks"),
        F.expr(f"(count(1) over (partition by lang) - 1) div {group_rows}").alias("last_rows"),
    )
    groups = cut_lineage(groups)
    dealt = counted_lookup(kept.drop("once"), groups.select("lang", "source", "idx", "blocks", "last_rows"), ["lang", "source"], "inner")
    dealt = dealt.select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), "last_rows")).alias("rows"),
        "term", "idx", "n", "total",
    )
    offered = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    offered = offered.withColumn("rows", F.explode(F.sequence(F.lit(0).cast("long"), "last_rows")))
    # Both sides come from the groups; new names for its columns tell them apart.
    offered = offered.select(*[F.col(c).alias(c) for c in ("lang", "block", "rows", "idx", "size", "terms", "lang_size")])

    def accumulate(key: tuple, postings: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
        lang, block, rows = key
        found = block_rows(postings, peers, int(rows) * group_rows, (int(rows) + 1) * group_rows, int(block) == 0, top)
        return found.assign(lang=lang)[["lang", "idx", "acc", "term", "value"]]

    keys = ["lang", "block", "rows"]
    found = dealt.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(
        accumulate, "lang string, idx long, acc array<long>, term string, value long"
    )
    found = cut_lineage(found)
    cells = found.where("acc is not null").select("lang", "idx", F.posexplode("acc").alias("peer", "value")).where("peer != idx")
    pairs = cells.groupBy("lang", F.least("idx", "peer").alias("a"), F.greatest("idx", "peer").alias("b")).agg(F.sum("value").alias("value"))
    ways = pairs.select("lang", "value", F.inline(F.array(
        F.struct(F.col("a").alias("idx"), F.col("b").alias("peer")), F.struct(F.col("b").alias("idx"), F.col("a").alias("peer")),
    )))
    named = groups.select("lang", "idx", "source")
    peers = named.select("lang", F.col("idx").alias("peer"), F.col("source").alias("item"))
    pair_rows = counted_lookup(counted_lookup(ways, named, ["lang", "idx"], "inner"), peers, ["lang", "peer"], "inner")
    term_rows = counted_lookup(found.where("term is not null"), named, ["lang", "idx"], "inner").withColumn("item", F.col("term"))
    made = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = made(pair_rows, "pair").unionByName(made(term_rows, "term")).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
