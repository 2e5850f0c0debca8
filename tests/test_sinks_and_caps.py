from __future__ import annotations

import os

from pyspark.sql import functions as F

from ampliq.operators.search import hit_cap
from ampliq.sinks import ranked_json_read, ranked_json_write


def test_many_jobs_in_a_bounded_number_of_files(spark, tmp_path):
    jobs = spark.range(0, 20_000).select(F.concat(F.lit("job-"), F.col("id")).alias("job_id"), F.lit(1).alias("position"), (F.col("id") / 7).alias("score"))
    path = str(tmp_path / "ranked")
    ranked_json_write(jobs, path, 16)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".json")]
    assert len(files) == 16
    schema = "job_id string, position int, score double"
    assert ranked_json_read(spark, path, schema).count() == 20_000
    one = ranked_json_read(spark, path, schema, "job-777")
    assert [tuple(r) for r in one.collect()] == [("job-777", 1, 111.0)]
    plan = one._jdf.queryExecution().executedPlan()
    one._jdf.queryExecution().toRdd().count()
    assert plan.collectLeaves().apply(0).metrics().apply("numFiles").value() == 1
    assert ranked_json_read(spark, path, schema, "unknown").count() == 0


def test_cap_of_an_oligo_with_very_many_hits(spark):
    """A hundred thousand places of one oligo, most of equal identity, among others; the same rows as one plain ranking."""
    rows = spark.range(0, 100_000).select(
        F.when(F.col("id") % 1000 == 0, F.concat(F.lit("o"), F.col("id") % 7)).otherwise("hot").alias("sequence"),
        F.when(F.col("id") % 977 == 3, 100.0).otherwise(90.0).alias("pident"), F.concat(F.lit("c"), F.col("id") % 13).alias("chrom"),
        (F.col("id") * 31 % 5_000).alias("start"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), "id",
    ).dropDuplicates(["sequence", "pident", "chrom", "start", "strand"])
    got = sorted(r.id for r in hit_cap(rows, 50).collect())
    plain = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.pident, r.chrom, r.start, r.strand)):
        plain.setdefault(r.sequence, []).append(r.id)
    assert got == sorted(i for found in plain.values() for i in found[:50])
