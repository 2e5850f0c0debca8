"""Exact top-k search by inner product with block-at-a-time pruning."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliq.joins import once
from ampliq.llm.common import rank_among

#: Largest sum that float64 holds exactly.
_EXACT = 1 << 53


def quantised(embedding: Column, scale: int) -> Column:
    """Components as whole numbers; null for vectors that are null or have a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return F.when(embedding.isNotNull() & ~bad, whole)


def block_top_k(
    ids: np.ndarray, rows: np.ndarray, asked_ids: np.ndarray, asked: np.ndarray, k: int, block_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: places of the queries, ids and scores, ties to smaller ids.

    Rows are cut into blocks of an id range.  A block's bound for a query is the sum over the terms of the query's
    weight times the block's largest (for a negative weight: smallest) component.  Each query visits the blocks by
    falling bounds and stops when the next bound is below its k-th best score.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    starts = np.arange(0, len(ids), block_rows)
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    bounds = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    turns = np.argsort(-bounds, axis=1, kind="stable")
    none = -(1 << 62)
    best = np.full((len(asked), k), none, dtype=rows.dtype)
    best_ids = np.full((len(asked), k), np.iinfo(np.int64).max)
    open_queries = np.arange(len(asked))
    for turn in range(len(starts)):
        blocks = turns[open_queries, turn]
        going = (bounds[open_queries, blocks] >= best[open_queries, -1]).astype(bool)
        open_queries, blocks = open_queries[going], blocks[going]
        if not len(open_queries):
            break
        for block in np.unique(blocks):
            mine = open_queries[blocks == block]
            span = slice(starts[block], starts[block] + block_rows)
            scores = asked[mine] @ rows[span].T
            scores = np.where(ids[span][None, :] == asked_ids[mine][:, None], none, scores)
            scores = np.concatenate([best[mine], scores], axis=1)
            found = np.concatenate([best_ids[mine], np.broadcast_to(ids[span], (len(mine), len(ids[span])))], axis=1)
            found = np.where(scores == none, np.iinfo(np.int64).max, found)
            first = np.lexsort((found, -scores), axis=1)[:, :k]
            best[mine] = np.take_along_axis(scores, first, axis=1)
            best_ids[mine] = np.take_along_axis(found, first, axis=1)
    places, ranks = np.nonzero(best_ids != np.iinfo(np.int64).max)
    return places, best_ids[places, ranks], best[places, ranks]


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, one in enumerate(lists):
        out[i, : len(one)] = one
    return out


def top_k(
    vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, cell_rows: int = 16_384, cell_queries: int = 2_048,
    block_rows: int = 256, max_cells: int = 65_536,
) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: its k best other rows (query_id, rank, vec_id, score).

    Rows are dealt to id ranges between quantiles (cells) and queries to chunks; each pair of a cell and a chunk is
    one group of bounded size, which gives k rows per query, and these are merged.  Vectors that are null or hold
    null or non-finite components take no part, nor do null ids.  Rows equal in id and vector count once; a query is never matched with
    a row of its own id.  Vectors of different lengths are compared as if zeros followed the shorter ones.
    """
    clean = once(vectors.where("vec_id is not null"), _ints=quantised(F.col("embedding"), scale))
    clean = clean.where("_ints is not null").select("vec_id", F.col("_ints").alias("ints")).distinct()
    n = vectors.count()
    n_cells = min(max_cells, max(1, -(-n // cell_rows)))
    cuts = [i / n_cells for i in range(1, n_cells)]
    bounds = vectors.agg(F.percentile_approx("vec_id", cuts, 10 * n_cells)).first()[0] if cuts else []
    chosen = F.col("vec_id") % every == 0
    n_chunks = max(1, -(-vectors.where(chosen).count() // cell_queries))

    cells = clean.withColumn("cell", rank_among(F.col("vec_id"), sorted(set(bounds or []))))
    cells = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    asked = clean.where(chosen).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).cast("int"))
    asked = asked.withColumn("ask", F.xxhash64("ints"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(set(bounds or []))))))

    def best_of_cell(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "ask": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(max(map(len, rows.ints)), max(map(len, queries.ints)))
        have, want = _matrix(rows.ints.tolist(), width), _matrix(queries.ints.tolist(), width)
        most = max(1, width) * int(max(abs(int(have.max(initial=0))), abs(int(have.min(initial=0))))) * int(
            max(abs(int(want.max(initial=0))), abs(int(want.min(initial=0)))))
        kind = np.float64 if most < _EXACT else object  # Python's whole numbers where float64 would round
        asked_ids = queries.vec_id.to_numpy()
        place, ids, scores = block_top_k(rows.vec_id.to_numpy(), have.astype(kind), asked_ids, want.astype(kind), k, block_rows)
        return pd.DataFrame({
            "query_id": asked_ids[place], "ask": queries.ask.to_numpy()[place], "vec_id": ids,
            "score": [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores],
        }, dtype="int64")

    found = cells.groupBy("cell", "chunk").cogroup(asked.groupBy("cell", "chunk")).applyInPandas(
        best_of_cell, "query_id long, ask long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
