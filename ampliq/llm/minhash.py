"""Near-duplicate documents by MinHash, banding, verification and connected components by large-star and small-star."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from xxhash import xxh3_64_intdigest

from ampliq.llm.common import with_columns
from ampliq.session import cut_lineage

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class MinHashPlan:
    """Words a shingle, least similarity in hundredths, and the banding.

    A pair at similarity s shares no band with probability (1 - s^rows)^bands: 3e-6 at 0.85 with the defaults, which
    miss 6e-4 at 0.80, so a lower ``percent`` needs a banding of its own.
    ``least_agreement`` is four standard deviations below the share of equal minima that a pair at the least similarity
    has, so the signatures turn away 3 of 100,000 such pairs; components mostly have other links as well.
    """

    words: int = 5
    percent: int = 85
    bands: int = 40
    rows: int = 8
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreement(self) -> float:
        s = self.percent / 100
        return s - 4 * (s * (1 - s) / self.hashes) ** 0.5

    @property
    def most_unequal_bits(self) -> int:
        """Unequal ones of the minima's bits that are still let through, 4.5 deviations above those of a pair
        at the least similarity: about 1 of 100,000 such pairs has more, however small the sets are."""
        p = (1 - self.percent / 100) / 2
        return int(self.hashes * p + 4.5 * (self.hashes * p * (1 - p)) ** 0.5 + 1)

    def family(self) -> tuple[np.ndarray, np.ndarray]:
        """Multipliers (odd) and shifts of the universal hash functions h -> a * h + b modulo 2^64."""
        rng = np.random.default_rng(self.seed)
        draw = lambda: rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2)
        return draw() + np.uint64(1), draw() + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_list(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split separates at exactly the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n, len(words))
    window = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        window = _mixed(window * np.uint64(0x9E3779B97F4A7C15) + hashed[i : len(words) - n + 1 + i])
    return np.unique(window)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash function over the set, in blocks so that memory stays small."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * a + b).min(axis=0))
    return least


def _bands(least: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    rows = least.reshape(plan.bands, plan.rows)
    band = _mixed(np.arange(plan.bands, dtype=np.uint64))
    for i in range(plan.rows):
        band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return band.astype(np.int64)


def signatures(docs: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Per row: doc_id, key of the word sequence, set size, band hashes, and one byte and one bit of each minimum."""
    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family = plan.family()
        for frame in frames:
            keys, sizes, bands, bytes_, bits = [], [], [], [], []
            for text in frame["text"]:
                words = word_list(text)
                shingles = shingle_set(words, plan.words)
                least = minima(shingles, family)
                keys.append(hashlib.md5(b" ".join(words)).hexdigest())
                sizes.append(len(shingles))
                bands.append(_bands(least, plan) if len(shingles) else None)
                bytes_.append(_packed(least) if len(shingles) else None)
                bits.append(_bits(least) if len(shingles) else None)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "key": keys, "n_shingles": sizes, "bands": bands, "signature": bytes_, "bits": bits
            })

    return docs.select("doc_id", "text").mapInPandas(
        signed,
        "doc_id long, key string, n_shingles long, bands array<long>, signature array<long>, bits array<long>",
    )


def _packed(least: np.ndarray) -> np.ndarray:
    """The lowest byte of each minimum, eight to a number; what fills the last number up is equal in all signatures.

    The lowest byte, as the highest ones of a large set's minima are mostly zero."""
    return _filled(least.astype(np.uint8))


def _bits(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, 64 to a number.

    The minima are mixed first: the lowest bit of a * h + b with an odd a comes from that of h alone, so in a small
    set the bits of all minima would stand or fall together."""
    return _filled(np.packbits((_mixed(least) & np.uint64(1)).astype(np.uint8)))


def _filled(bytes_: np.ndarray) -> np.ndarray:
    return np.concatenate([bytes_, np.zeros(-len(bytes_) % 8, np.uint8)]).view(np.int64)


def _agreement(a: str, b: str, hashes: int) -> Column:
    """Share of equal minima, less what single bytes have in common by chance."""
    def unequal(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for step in (1, 2, 4):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
        return F.bit_count(bits.bitwiseAND(0x0101010101010101))

    other = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda total, n: total + n)
    return (1 - other / hashes - 1 / 256) / (1 - 1 / 256)


def _linked(percent: int):
    @F.pandas_udf(BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                out.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def confirmed(pairs: DataFrame, signed: DataFrame | None, sets: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Of the pairs (a, b) those that are linked: first by their signatures, then on the full sets.

    ``signed`` is None for pairs whose signatures have been compared already.
    """
    def both(frame: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for end in ("a", "b"):
            side = table.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}"))
            frame = frame.join(side, end)
        return frame

    if signed is not None:
        alike = _agreement("signature_a", "signature_b", plan.hashes) >= plan.least_agreement
        pairs = cut_lineage(both(pairs, signed, "signature").where(alike).select("a", "b"))
    return both(pairs, sets, "shingles").where(_linked(plan.percent)("shingles_a", "shingles_b")).select("a", "b")


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components (node, component) of the edges (a, b), component being the smallest node.

    Large-star links a node's larger neighbours to the smallest one, small-star its smaller neighbours; both are
    repeated, each time from written edges, until nothing changes.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        to = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        near = to.unionByName(back) if large else to.unionByName(back).where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        moved = joined.where("v > u") if large else joined.where("v <> m")
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.where("m <> u").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while True:
        edges = cut_lineage(star(star(edges, large=True), large=False))
        now = state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _joined_up(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the graph between the present components is worked through again.

    ``label`` names every node but the smallest of a component, so what the contracted graph adds are nodes of its own.
    """
    ends = links
    for end in ("a", "b"):
        side = label.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
        ends = ends.join(side, end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).drop(f"{end}_component")
    over = components(ends.where("a <> b"))
    wider = over.select(F.col("node").alias("component"), F.col("component").alias("wider"))
    moved = label.join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return cut_lineage(moved.unionByName(over))


def near_duplicates(docs: DataFrame, plan: MinHashPlan = MinHashPlan(), star_rounds: int = 2) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept.

    Equal word sequences are one class, named by its smallest doc_id, so copies are never compared.  Classes
    that share a band's bucket are candidates; a bucket first pairs all its classes with one of them only (twice,
    with another one), which joins nearly all that belong together.  Only where a bucket still holds classes of
    several components are the untested pairs between these components tried as well, so no link is lost.

    A text without words has an empty set, no link and is its own component.  Rows with a null doc_id have a null component
    and are kept.  Rows of one doc_id count as one document: its texts are all reached from it.  Extra columns
    are left out; an empty table gives an empty result.
    """
    signed_docs = cut_lineage(signatures(docs, plan))
    filled = signed_docs.where("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(filled.groupBy("key").agg(F.min("doc_id").alias("node")))
    first = filled.join(classes, [filled.key == classes.key, filled.doc_id == classes.node]).select(
        "node", classes.key, "n_shingles", "bands", "signature", "bits"
    ).dropDuplicates(["node", "key"])

    buckets = first.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    buckets = cut_lineage(buckets.join(shared.where("low < high").select("band", "bucket"), ["band", "bucket"]))

    asked = buckets.select("node").distinct()
    signed = cut_lineage(first.join(asked, "node", "left_semi").select("node", "key", "n_shingles", "bands", "signature", "bits"))
    sets = cut_lineage(_sets(docs, signed, plan))

    tested = label = None
    for turn in range(star_rounds + 1):
        last = turn == star_rounds  # its pairs come with their signatures compared
        open_buckets = _unresolved(buckets, label)
        pairs = _between(open_buckets, signed, plan) if last else _stars(open_buckets, turn)
        pairs = _distinct_pairs(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        if turn and not pairs.take(1):
            if not last:
                continue  # the last turn looks at what stars cannot see
            break
        found = cut_lineage(confirmed(pairs, None if last else signed, sets, plan))
        tested = pairs if tested is None else tested.unionByName(pairs)
        label = components(found) if label is None else _joined_up(label, found)

    # A doc_id that stands for several classes links them, as a class names its smallest doc_id only.
    named = filled.select("doc_id", "key").distinct().join(classes, "key").select("doc_id", "node")
    several = named.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    if several.take(1):
        ids = several.select("doc_id").join(named, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        label = _joined_up(label, ids.where("a <> b"))
    found = classes.join(label, "node", "left").select("key", F.coalesce("component", "node").alias("found"))
    rows = signed_docs.join(found, "key", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.least("found", "doc_id")).otherwise(F.col("doc_id"))
    )
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _sets(docs: DataFrame, signed: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Full shingle sets of the classes that have a candidate at all."""
    def full(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes, sets = [], []
            for node, key, text in zip(frame["node"], frame["key"], frame["text"]):
                words = word_list(text)
                if hashlib.md5(b" ".join(words)).hexdigest() == key:
                    nodes.append(node)
                    sets.append(shingle_set(words, plan.words).tobytes())
            yield pd.DataFrame({"node": nodes, "shingles": sets})

    texts = docs.select(F.col("doc_id").alias("node"), "text").join(signed.select("node", "key"), "node")
    return texts.mapInPandas(full, "node long, shingles binary")


def _unresolved(buckets: DataFrame, label: DataFrame | None) -> DataFrame:
    """Buckets that hold more than one component, with each class's component."""
    if label is None:
        return buckets.withColumn("component", F.col("node"))
    rows = buckets.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = rows.groupBy("band", "bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
    )
    # Two classes were compared with each other in the first turn.
    return rows.join(several.where("low < high and n > 2").select("band", "bucket"), ["band", "bucket"])


def _stars(rows: DataFrame, turn: int) -> DataFrame:
    """Each class of a bucket with one of them; not within a component.

    In the first turn the buckets of a group mostly choose the same class.  Later each bucket chooses on its own, so
    a class meets as many others as it has open buckets, still with one row for each class and bucket.
    """
    choice = F.xxhash64("node", F.lit(turn)) if turn == 0 else F.xxhash64("node", "band", F.lit(turn))
    hubs = rows.groupBy("band", "bucket").agg(
        F.min_by("node", choice).alias("hub"), F.min_by("component", choice).alias("hub_component")
    )
    pairs = rows.join(hubs, ["band", "bucket"]).where("component <> hub_component")
    return pairs.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _between(rows: DataFrame, signed: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Pairs of classes of one bucket that lie in different components and whose sizes and signatures allow a link.

    Each pair comes from its first common band only: the hashes of the earlier ones, each made with its band's number,
    have none in common.  The bits stand as plain numbers and are compared first, in
    generated code: most pairs of a bucket end there, before the functions over whole arrays.
    """
    bits = {f"bits_{i}": F.get("bits", i) for i in range(-(-plan.hashes // 64))}
    signed = signed.select("node", "n_shingles", "bands", "signature", *[value.alias(name) for name, value in bits.items()])
    rows = rows.join(signed, "node").withColumn("earlier", F.slice("bands", 1, F.col("band"))).drop("bands")
    other = rows.select("band", "bucket", *[
        F.col(c).alias(f"other_{c}") for c in ("node", "component", "n_shingles", "earlier", "signature", *bits)
    ])
    unequal = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in bits), F.lit(0))
    small, large = F.least("n_shingles", "other_n_shingles"), F.greatest("n_shingles", "other_n_shingles")
    pairs = rows.join(other, ["band", "bucket"]).where(
        (F.col("component") < F.col("other_component")) & (100 * small >= plan.percent * large)
        & (unequal <= plan.most_unequal_bits)
        & ~F.arrays_overlap("earlier", "other_earlier")
        & (_agreement("signature", "other_signature", plan.hashes) >= plan.least_agreement)
    )
    return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b"))


def deduplicated(docs: DataFrame, plan: MinHashPlan = MinHashPlan()) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest doc_id stays, and rows without an id."""
    judged = near_duplicates(docs, plan)
    gone = judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_id"))
    rows = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return with_columns(rows, "row", {})
