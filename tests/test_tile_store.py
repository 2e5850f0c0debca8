from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from ampliq.operators.windows import fetch_intervals, subseq_fetch
from ampliq.sources import contig_tiles
from ampliq.sources.tile_store import TileStore

from .plain import dna

#: Contigs of very different lengths, with names whose order is not that of their numbers.
CONTIGS = [(f"c{i}", dna(90 if i % 3 else 3_000 + 700 * i, i)) for i in range(14)] + [("é", dna(500, 99)), ("big", dna(20_000, 100))]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    tiles = contig_tiles(spark.createDataFrame(CONTIGS, "chrom string, seq string"), tile=64)
    return TileStore.write(tiles, str(tmp_path_factory.mktemp("store") / "ref"), file_bases=2_000)


def _files_read(df) -> int:
    """The scan's own number of files."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_few_intervals_open_few_files(spark, store):
    files = sum(f.endswith(".parquet") for _, _, names in os.walk(store.path + "/tiles") for f in names)
    assert files > 15 and len(store.firsts) > 15
    wanted = spark.createDataFrame([("big", 100), ("big", 101), ("c5", 0), ("nowhere", 3), (None, 1)], "chrom string, tile int")
    got = store.holding(wanted)
    assert 2 <= _files_read(got) <= 4 and got.where("chrom = 'big' and tile in (100, 101)").count() == 2
    assert _files_read(store.tiles()) == files


def test_any_tile_is_found(store):
    """Every stored tile lies in the part that the search over first tiles names."""
    got = store.holding(store.tiles().select("chrom", "tile"))
    assert got.count() == store.tiles().count()
    for part in range(len(store.firsts)):
        held = store.spark.read.parquet(f"{store.path}/tiles").where(F.col("part") == part)
        some = held.select("chrom", "tile").limit(3)
        assert some.join(store.holding(some), ["chrom", "tile"], "left_anti").count() == 0


def test_fetch_from_a_store(spark, store):
    rng, text = random.Random(4), dict(CONTIGS)
    rows = [(i, c := rng.choice([*text, "x"]), s := rng.randrange(-5, 21_000), s + rng.randrange(0, 400)) for i in range(200)]
    wanted = spark.createDataFrame(rows, "id int, chrom string, s long, e long")
    opened = TileStore.open(spark, store.path)
    got = {r.id: r.seq for r in fetch_intervals(wanted, opened, ["id"], "s", "e", tile=64).collect()}
    assert got == {i: (text[c][s:e] or None) if c in text and 0 <= s < e else None for i, c, s, e in rows}
    one = spark.createDataFrame([("big", 19_990, 20_100)], "chrom string, start long, end long")
    assert subseq_fetch(one, opened, [], tile=64).first().seq == text["big"][19_989:]


def test_nothing_wanted_and_nothing_stored(spark, store, tmp_path):
    none = spark.createDataFrame([], "chrom string, tile int")
    assert store.holding(none).count() == 0
    empty = TileStore.write(store.tiles().limit(0), str(tmp_path / "e"))
    assert empty.firsts == () and empty.holding(store.tiles().select("chrom", "tile")).count() == 0
