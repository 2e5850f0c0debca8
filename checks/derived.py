"""DNA tables derived from the whole ``documents`` table.

No given table holds DNA, so the letters of every text are mapped onto A, C, G and T.  Copies and near
copies among the documents become repeats and mismatched off-targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.functions.sequence import revcomp
from ampliq.joins import once
from ampliq.sources.fasta import contig_tiles

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MAPPED = "ACGTACGTACGTACGTACGTACGTAC"
REACH = 32


def spread(df: DataFrame) -> DataFrame:
    """Use every core even when the input is a single small file; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only A-Z and a-z are left, so capitals are mapped with the others.
    text = F.regexp_replace("text", "[^A-Za-z]+", "")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    named = once(docs, seq=F.translate(text, LETTERS + LETTERS.upper(), MAPPED * 2)).select(
        F.concat(F.lit("doc"), F.col("doc_id")).alias("chrom"), "doc_id", "seq"
    )
    return named.filter(F.length("seq") > 0)


def _cut(start: int, size: int):
    return F.substring("seq", start, size)


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contigs, and two short ones per long one in which a primer meets its own reverse complement."""
    inv = F.concat(_cut(100, 50), _cut(150, 20), _cut(170, 40), revcomp(_cut(150, 20)), _cut(300, 50))
    ivr = F.concat(_cut(100, 50), revcomp(_cut(230, 20)), _cut(170, 40), _cut(230, 20), _cut(300, 50))

    def contig(prefix: str, seq):
        return F.struct(F.concat(F.lit(prefix), F.col("doc_id")).alias("chrom"), seq.alias("seq"))

    itself = contig("doc", F.col("seq"))
    made = F.when(
        F.length("seq") >= 349, F.array(itself, contig("inv", inv), contig("ivr", ivr))
    ).otherwise(F.array(itself))
    return contigs(spark, sf_dir).select(F.inline(made))


def search_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contig_tiles(genome(spark, sf_dir), lead=REACH, overlap=REACH)


def genome_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contig_tiles(genome(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).filter(F.length("seq") >= 249).select(
        F.col("doc_id").alias("pair_id"),
        F.concat(F.lit("F"), F.col("doc_id")).alias("f_name"), _cut(150, 20).alias("f_seq"),
        F.concat(F.lit("R"), F.col("doc_id")).alias("r_name"), revcomp(_cut(230, 20)).alias("r_seq"),
    )


def pair_oligos(pr: DataFrame) -> DataFrame:
    return pr.select(F.explode(F.array("f_seq", "r_seq")).alias("sequence")).distinct()


def oligos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct primers, and one hairpin former per contig that is long enough."""
    cg = contigs(spark, sf_dir)
    former = cg.filter(F.length("seq") >= 165).select(
        F.concat(_cut(150, 16), revcomp(_cut(150, 9))).alias("sequence")
    )
    return pair_oligos(pairs(spark, sf_dir)).unionByName(former).distinct()


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target of 20 bases per contig that reaches beyond its window."""
    return contigs(spark, sf_dir).filter(F.length("seq") >= 310).select(
        F.lit(None).cast("string").alias("region_id"), "chrom",
        F.lit(190).cast("bigint").alias("start"), F.lit(209).cast("bigint").alias("end"),
        F.when(F.length("seq") > 1000, F.concat(F.lit("long-"), F.col("doc_id"))).otherwise(F.lit(" ")).alias("name"),
    )


def edge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contig a region too near its start and one at its end."""
    n = F.length("seq").cast("bigint")
    cg = contigs(spark, sf_dir).filter(F.length("seq") >= 150)
    both = F.array(
        F.struct(F.lit(60).cast("bigint").alias("start"), F.lit(79).cast("bigint").alias("end")),
        F.struct((n - 10).alias("start"), n.alias("end")),
    )
    return cg.select(F.lit(None).cast("string").alias("region_id"), "chrom", F.inline(both), F.lit("").alias("name"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding records per pair; contigs of odd length have no second primer."""
    def rec(start: int, end: int, name: str, seq, strand: str):
        return F.struct(
            F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(name).alias("name"),
            seq.alias("sequence"), F.lit(strand).alias("strand"),
        )

    records = F.array(
        rec(149, 169, "primer_1", _cut(150, 20), "+"), rec(189, 209, "target", _cut(190, 20), "+"),
        rec(195, 196, "missmatch", _cut(196, 1), "+"), rec(229, 249, "primer_2", revcomp(_cut(230, 20)), "-"),
    )
    cg = contigs(spark, sf_dir).filter(F.length("seq") >= 249)
    rows = cg.select("chrom", F.length("seq").alias("n"), F.concat(F.lit("g"), F.col("doc_id")).alias("grp"), F.inline(records))
    return rows.filter((F.col("name") != "primer_2") | (F.col("n") % 2 == 0)).select(
        "chrom", "start", "end", "name", "sequence", "strand", "grp"
    )


def methylation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CG sites of every contig: methylated, not methylated or not stated, by position."""
    cg = contigs(spark, sf_dir).filter(F.length("seq") >= 2)
    tiles = contig_tiles(cg, overlap=1)
    sites = tiles.select(
        "chrom", "tile_start", "seq", F.explode(F.sequence(F.lit(1), F.col("core_len"))).alias("i")
    ).filter(F.substring("seq", F.col("i"), F.lit(2)) == "CG")
    pos = (F.col("tile_start") + F.col("i") - 1).cast("bigint")
    return sites.select("chrom", pos.alias("pos")).filter("pos % 3 < 2").withColumn("methylated", F.col("pos") % 3 == 0)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oligo spans per contig: two inside, one at its start and one at its end."""
    cg = contigs(spark, sf_dir).filter(F.length("seq") >= 249).withColumn("n", F.length("seq"))

    def span(strand: str, start, end):
        return F.struct(F.lit(strand).alias("strand"), start.cast("int").alias("start"), end.cast("int").alias("end"))

    rows = F.array(
        span("forward", F.lit(149), F.lit(168)), span("reverse", F.lit(229), F.lit(248)),
        span("reverse", F.lit(0), F.lit(19)), span("forward", F.col("n") - 20, F.col("n") - 1),
    )
    return cg.select("chrom", "seq", F.inline(rows))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contig a forward primer set against a neighbouring place, once with a gap in the query."""
    cg = contigs(spark, sf_dir).filter(F.length("seq") >= 249)
    primer = _cut(150, 20)

    def row(label: str, qstart: int, qseq, sseq, start: int, minus: bool):
        size = 20
        first, last = (start + size - 1, start) if minus else (start, start + size - 1)
        return F.struct(
            F.lit(label).alias("label"), F.lit(qstart).alias("qstart"), qseq.alias("qseq"), sseq.alias("sseq"),
            F.lit(first).alias("sstart"), F.lit(last).alias("send"),
        )

    rows = F.array(
        row("near", 1, primer, _cut(154, 20), 154, False),
        row("part", 4, F.substring("seq", 153, 17), _cut(157, 17), 157, True),
        row("gap", 1, F.concat(_cut(150, 6), F.lit("-"), _cut(156, 10)), _cut(150, 17), 150, False),
    )
    return cg.select("chrom", primer.alias("primer"), F.inline(rows))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One design request per document with some values given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("n_chars")
    return docs.select(
        "doc_id",
        F.when(n % 2 == 0, (60 + n % 30).cast("int")).alias("min_amplicon_length"),
        F.when(n % 3 == 0, (100 + n % 50).cast("int")).alias("max_amplicon_length"),
        F.when(n % 5 == 0, (40 + n % 10).cast("double")).alias("primer_min_gc"),
        F.when(n % 7 == 0, F.lit(True)).alias("bisulfite"),
        F.when(n % 7 == 0, F.lit("unmethyl")).alias("cpg_default"),
    )
