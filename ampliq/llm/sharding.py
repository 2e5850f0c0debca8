"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ampliq.llm.common import with_columns
from ampliq.session import cut_lineage

#: Numpy draws from urns of fewer balls than this.
_NUMPY_URN = 1_000_000_000
#: Samples of at most this size are drawn ball by ball from larger urns.
_FEW = 64
#: Entries of the communication matrix that may be broadcast (16 bytes each).
_BROADCAST_ENTRIES = 2_000_000
#: Slots of a shard that are laid down together.
_RUN = 1024


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` balls drawn without replacement are good; exact for urns of any size.

    Beyond numpy's limit every ball is first taken with the same chance, independently: two binomial draws.  Such a
    subset is uniform among those of its size.  What it holds too much, about the root of the sample, is taken out of
    it again, or what it lacks is taken from the others; both are the same question with a much smaller sample.
    """
    if not sample or not good:
        return 0
    if good + bad < _NUMPY_URN:
        return int(rng.hypergeometric(good, bad, sample))
    if sample <= _FEW:
        drawn = 0
        for taken in range(sample):
            drawn += int(rng.integers(good + bad - taken) < good - drawn)
        return drawn
    share = sample / (good + bad)
    a, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    over = a + b - sample
    return a - _draw(rng, a, b, over) if over > 0 else a + _draw(rng, good - a, bad - b, -over)


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard, drawn as a uniform shuffle would.

    Shard sizes differ by one at most; rows of the matrix sum to ``counts``, columns to the shard sizes.
    """
    total, rng = sum(counts), np.random.default_rng(seed)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = []
    for count in counts:
        row, open_rows, rest = [], sum(left), count
        for size in left:
            open_rows -= size
            row.append(_draw(rng, size, open_rows, rest))
            rest -= row[-1]
        left = [size - sent for size, sent in zip(left, row)]
        matrix.append(row)
    return matrix


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permutation(key: np.ndarray, index: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place of ``index`` in a random order of 0 .. size-1 that ``key`` selects, without building the order.

    A Feistel network over the next even power of two; places beyond the size are walked on.
    """
    key, place, size = (np.asarray(a, dtype=np.uint64) for a in (key, index, size))
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    place, todo = place.copy(), np.arange(len(place))
    while len(todo):
        half, low, word = bits[todo], mask[todo], place[todo]
        left, right = word >> half, word & low
        for turn in range(8):
            left, right = right, left ^ (_mixed(_mixed(right + key[todo]) + np.uint64(turn + 1)) & low)
        place[todo] = (left << half) | right
        todo = todo[place[todo] >= size[todo]]
    return place.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(key: pd.Series, index: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(permutation(key.to_numpy(), index.to_numpy(), size.to_numpy()))


def hypergeometric_shards(df: DataFrame, n_shards: int = 16, seed: int = 0) -> DataFrame:
    """All rows with their ``shard`` and their ``slot`` in it, both uniformly random; input columns are kept.

    The rows are written once to the shared folder with partition and position, so that recomputed tasks see the
    same ones.  The counts of the partitions give the matrix; a partition deals its rows in a random local order;
    each shard orders what arrives once more.  The driver holds one matrix row per input partition.

    Rows are never looked into: nulls, ties and repeated rows are rows like others.  An empty table gives an empty
    result; columns named ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    placed = cut_lineage(df.select(
        F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos"),
    ))
    counts = sorted(placed.groupBy("part").count().collect())
    matrix = communication_matrix([count for _, count in counts], n_shards, seed)
    sizes = [sum(column) for column in zip(*matrix)] or [0] * n_shards
    arrived, routes = [0] * n_shards, []
    for (part, count), row in zip(counts, matrix):
        ends = np.cumsum(row).tolist()
        # Rank r of the local order goes to shard s at arrival place r + shift[s].
        routes.append((part, count, ends, [a - (e - n) for a, e, n in zip(arrived, ends, row)]))
        arrived = [a + n for a, n in zip(arrived, row)]
    sent = spark.createDataFrame(routes, "part int, n long, ends array<long>, shift array<long>")
    sent = F.broadcast(sent) if len(routes) * n_shards <= _BROADCAST_ENTRIES else sent

    dealt = placed.join(sent, "part").withColumn(
        "rank", _permuted(F.xxhash64(F.lit(seed), F.lit("deal"), "part").bitwiseAND((1 << 62) - 1), "pos", "n")
    )
    shard: Column = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    dealt = dealt.withColumn("shard", shard).select(
        "row", "shard", (F.col("rank") + F.get("shift", F.col("shard"))).alias("arrival"),
        F.get(F.lit(sizes), F.col("shard")).cast("long").alias("size"),
    )
    dealt = dealt.withColumn(
        "slot", _permuted(F.xxhash64(F.lit(seed), F.lit("lay"), "shard").bitwiseAND((1 << 62) - 1), "arrival", "size")
    )
    laid = dealt.repartition("shard", F.floor(F.col("slot") / _RUN)).sortWithinPartitions("shard", "slot")
    return with_columns(laid, "row", {"shard": F.col("shard"), "slot": F.col("slot")})
