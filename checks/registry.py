"""Registered queries: name -> (Spark job, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.constants import AMPLICON_THRESHOLDS, DESIGN_DEFAULTS, QC_REPORT_COLUMNS, SCORING
from ampliq.functions import hits as H
from ampliq.functions import sequence as S
from ampliq.joins import counted_lookup
from ampliq.operators import amplicons as AM
from ampliq.operators import binding as B
from ampliq.operators import design as DS
from ampliq.operators import qc as QC
from ampliq.operators import ranking as R
from ampliq.operators import search as SE
from ampliq.operators import structure as ST
from ampliq.operators.bisulfite import methylation_join
from ampliq.operators.untargeted import CORE, pieces_of_tiles
from ampliq.operators.windows import region_windows, subseq_fetch, template_window_fetch
from ampliq.plans import binding_alignment, design_amplicons, pair_qc, region_design, score_rank_pieces
from ampliq.plans.pair_qc import profile_hits
from ampliq.plans.region_design import region_templates
from ampliq.profiles import ALL_FLAGS, STRICT_AMPLICON, QcProfile
from ampliq.session import cut_lineage, scratch_path
from ampliq.sinks import design_bundle_write, qc_report_write, ranked_json_read, ranked_json_write
from ampliq.sources import (
    bed_record_scan, contig_tiles, fasta_contig_scan, fasta_tile_scan, hit_tsv_scan, pair_tsv_scan, region_table_scan,
)
from ampliq.sources.tile_store import TileStore

from . import derived as D
from .oracle import RICH, rc, with_ctes

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, deps: list[str] | None = None, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[name] = job
        if sql is not None:
            SQL[name] = with_ctes(deps or [], sql)
        return job

    return register


def r6(name: str):
    return F.round(name, 6).alias(name)


def r6s(*names: str) -> str:
    return ", ".join(f"round({n},6) AS {n.split('.')[-1]}" for n in names)


# --- sources --------------------------------------------------------------------------------------

@query("pair_tsv_scan", ["pair", "contig"], """
  SELECT f_name, f_seq, r_name, r_seq FROM pair JOIN contig ON doc_id=pair_id WHERE length(seq)%5<>0 AND length(seq)%7<>0""")
def _(spark, sf):
    pairs = D.pairs(spark, sf).join(D.contigs(spark, sf).select(F.col("doc_id").alias("pair_id"), F.length("seq").alias("n")), "pair_id")
    tab = F.lit("\t")
    start = F.concat("f_name", tab, F.lit(" "), F.lower("f_seq"), F.when(F.col("n") % 5 == 0, "+").otherwise(""), tab, F.col("r_name"))
    line = F.when(F.col("n") % 7 == 0, start).otherwise(F.concat(start, tab, F.col("r_seq"), F.lit(" "), tab, F.lit("note")))
    head = spark.createDataFrame([("Forward_Primer\tForward_seq\tReverse_Primer\tReverse_seq",)], "value string")
    path = scratch_path(spark, "pairs")
    pairs.select(line.alias("value")).unionByName(head).write.text(path)
    return pair_tsv_scan(spark, path).drop("pair_id")


@query("bed_record_scan", ["bed"], """SELECT chrom, "start", "end", name, sequence, strand, grp FROM bed""")
def _(spark, sf):
    path = scratch_path(spark, "bed")
    rows = D.bed(spark, sf)
    blank = F.concat(F.lit(" "), F.lower(F.left("sequence", F.lit(1))), F.lit(" "), F.substring("sequence", F.lit(2), F.length("sequence")))
    rows.withColumn("sequence", blank).write.csv(path, sep="\t", header=False, ignoreLeadingWhiteSpace=False)
    return bed_record_scan(spark, path)


@query("region_table_scan", ["region"], """SELECT region_id, chrom, "start", "end", coalesce(name,'-') AS name FROM region""")
def _(spark, sf):
    return region_table_scan(D.regions(spark, sf)).withColumn("name", F.coalesce("name", F.lit("-")))


def _write_fasta(spark, sf) -> str:
    path = scratch_path(spark, "fasta")
    body = F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n")
    D.genome(spark, sf).select(F.concat(F.lit(">"), F.col("chrom"), F.lit(" derived\n"), body).alias("value")).write.text(path)
    return path


@query("fasta_contig_scan", ["genome"], "SELECT chrom, length(seq) AS bases, md5(seq) AS digest FROM genome")
def _(spark, sf):
    return fasta_contig_scan(spark, _write_fasta(spark, sf)).select(
        "chrom", F.length("seq").cast("bigint").alias("bases"), F.md5("seq").alias("digest"))


def _tiles_sql(lead: int, overlap: int) -> str:
    return f"""
  SELECT chrom, (first//1024)::INTEGER AS tile, first AS tile_start, least(first,{lead})::INTEGER AS lead,
         least(1024,length(seq)-first)::INTEGER AS core_len,
         md5(substr(seq,first-least(first,{lead})+1,least(first,{lead})+1024+{overlap})) AS digest
  FROM (SELECT chrom, seq, unnest(range(0,length(seq),1024)) AS first FROM genome)"""


_TILE_COLUMNS = ["chrom", "tile", "tile_start", "lead", "core_len"]


@query("contig_tiles", ["genome"], _tiles_sql(0, 0))
def _(spark, sf):
    return contig_tiles(D.genome(spark, sf)).select(*_TILE_COLUMNS, F.md5("seq").alias("digest"))


@query("fasta_tile_scan", ["genome"], _tiles_sql(32, 32))
def _(spark, sf):
    return fasta_tile_scan(spark, _write_fasta(spark, sf), lead=32, overlap=32).select(*_TILE_COLUMNS, F.md5("seq").alias("digest"))


@query("hit_tsv_scan", ["contig"], f"""
  SELECT 'F'||doc_id AS qseqid, chrom AS sseqid, (80+length(seq)%20)::DOUBLE AS pident, 20 AS length, 150 AS sstart, 169 AS send,
         0.5::DOUBLE AS evalue, 30.25::DOUBLE AS bitscore, substr(seq,150,20) AS qseq, substr(seq,150,20) AS sseq
  FROM contig WHERE length(seq)>=249 AND length(seq)%4<>0""")
def _(spark, sf):
    n = F.length("seq")
    base = [F.concat(F.lit("F"), F.col("doc_id")), F.col("chrom"), (80 + n % 20).cast("string"), F.lit("20"), F.lit("0"), F.lit("0"),
            F.lit("1"), F.lit("20"), F.lit("150"), F.lit("169"), F.lit("0.5"), F.lit("30.25")]
    short = F.concat_ws("\t", *base)
    full = F.concat_ws("\t", *base, F.substring("seq", 150, 20), F.substring("seq", 150, 20))
    path = scratch_path(spark, "hits")
    D.contigs(spark, sf).filter(n >= 249).select(F.when(n % 4 == 0, short).otherwise(full).alias("value")).write.text(path)
    return hit_tsv_scan(spark, path).select(
        "qseqid", "sseqid", "pident", "length", "sstart", "send", "evalue", "bitscore", "qseq", "sseq")


# --- sequence expressions -------------------------------------------------------------------------

@query("revcomp", ["contig"], f"SELECT chrom, md5({rc('seq')}) AS digest, {rc('substr(seq,1,20)')} AS tail FROM contig")
def _(spark, sf):
    return D.contigs(spark, sf).select(
        "chrom", F.md5(S.revcomp(F.col("seq"))).alias("digest"), S.revcomp(F.substring("seq", 1, 20)).alias("tail"))


@query("complement", ["contig"], "SELECT chrom, md5(translate(seq,'ACGTNacgtn','TGCANtgcan')) AS digest FROM contig")
def _(spark, sf):
    return D.contigs(spark, sf).select("chrom", F.md5(S.complement(F.col("seq"))).alias("digest"))


@query("gc_percent", ["contig"], """
  SELECT chrom, CASE WHEN length(regexp_replace(s,'[^GCSATWU]','','g'))=0 THEN 0 ELSE
           round(length(regexp_replace(s,'[^GCS]','','g'))*100.0::DOUBLE/length(regexp_replace(s,'[^GCSATWU]','','g')),6) END AS gc_remove,
         round(length(regexp_replace(s,'[^GCS]','','g'))*100.0::DOUBLE/length(s),6) AS gc_ignore
  FROM (SELECT chrom, replace(seq,'CAT','NNT') AS s FROM contig)""")
def _(spark, sf):
    s = F.replace("seq", F.lit("CAT"), F.lit("NNT"))
    return D.contigs(spark, sf).select(
        "chrom", F.round(S.gc_percent(s), 6).alias("gc_remove"), F.round(S.gc_percent(s, "ignore"), 6).alias("gc_ignore"))


@query("region_id", ["region"], """SELECT chrom, coalesce(name, region_id) AS region_id FROM region""")
def _(spark, sf):
    name = F.nullif(F.trim("name"), F.lit(""))
    return D.regions(spark, sf).select("chrom", S.region_label(F.col("chrom"), F.col("start"), F.col("end"), name).alias("region_id"))


_SPAN_SQL = """(SELECT chrom, seq, 'forward' AS strand, 149 AS s, 168 AS e FROM contig UNION ALL SELECT chrom, seq, 'reverse', 229, 248 FROM contig
   UNION ALL SELECT chrom, seq, 'reverse', 0, 19 FROM contig UNION ALL SELECT chrom, seq, 'forward', length(seq)-20, length(seq)-1 FROM contig)"""
_CPG_SPAN = "CASE WHEN strand='forward' THEN substr(seq,s+1,e-s+2) WHEN s=0 THEN substr(seq,1,e+1) ELSE substr(seq,s,e-s+2) END"
_CPG_SQL = f"((length({_CPG_SPAN})-length(replace({_CPG_SPAN},'CG','')))//2)"


def _span_args():
    return F.col("seq"), F.col("strand"), F.col("start"), F.col("end")


@query("cpg_count", ["contig"], f"""
  SELECT chrom, strand, s::INTEGER AS "start", {_CPG_SQL}::INTEGER AS cpg FROM {_SPAN_SQL} WHERE length(seq)>=249""")
def _(spark, sf):
    return D.spans(spark, sf).select("chrom", "strand", "start", S.cpg_count(*_span_args()).alias("cpg"))


_NON_SQL = f"""(length(substr(seq,s+1,e-s+1))-length(replace(substr(seq,s+1,e-s+1),CASE WHEN strand='forward' THEN 'C' ELSE 'G' END,''))-{_CPG_SQL})"""


@query("non_cpg_c_count", ["contig"], f"""
  SELECT chrom, strand, s::INTEGER AS "start", {_NON_SQL}::INTEGER AS non_cpg FROM {_SPAN_SQL} WHERE length(seq)>=249""")
def _(spark, sf):
    return D.spans(spark, sf).select("chrom", "strand", "start", S.non_cpg_c_count(*_span_args()).alias("non_cpg"))


@query("three_prime_is", ["contig"], f"""
  SELECT chrom, strand, s::INTEGER AS "start", tail, CASE WHEN strand='forward' THEN substr(seq,e+2-length(tail),length(tail))
         ELSE {rc("substr(seq,s+1,length(tail))")} END = tail AS ends_with
  FROM (SELECT *, unnest(['A','CG','TTA']) AS tail FROM {_SPAN_SQL}) WHERE length(seq)>=249""")
def _(spark, sf):
    tails = D.spans(spark, sf).withColumn("tail", F.explode(F.array(F.lit("A"), F.lit("CG"), F.lit("TTA"))))
    return tails.select("chrom", "strand", "start", "tail", S.three_prime_is(*_span_args(), F.col("tail")).alias("ends_with"))


@query("amplicon_sequence_length", ["contig"], """
  SELECT chrom, CASE WHEN length(seq)>=249 THEN substr(seq,150,100) ELSE '' END AS amplicon,
         CASE WHEN length(seq)>=249 THEN 100 ELSE -1 END AS amplicon_length FROM contig""")
def _(spark, sf):
    known = F.length("seq") >= 249
    amplicon = S.amplicon_sequence(F.col("seq"), F.when(known, 149), F.when(known, 248))
    return D.contigs(spark, sf).select(
        "chrom", F.coalesce(amplicon, F.lit("")).alias("amplicon"), F.coalesce(F.length(amplicon), F.lit(-1)).alias("amplicon_length"))


@query("locate_oligo", ["contig", "pair"], f"""
  SELECT pair_id, oligo, coalesce(nullif(strpos(seq,oligo),0),nullif(strpos(seq,{rc('oligo')}),0),0)-1 AS first_index,
         CASE WHEN coalesce(nullif(strpos(seq,oligo),0),nullif(strpos(seq,{rc('oligo')}),0)) IS NULL THEN -1
         ELSE coalesce(nullif(strpos(seq,oligo),0),nullif(strpos(seq,{rc('oligo')}),0))-2+length(oligo) END AS last_index
  FROM (SELECT pair_id, seq, unnest([f_seq,r_seq,'NNNNN'||f_seq]) AS oligo FROM pair JOIN contig ON doc_id=pair_id)""")
def _(spark, sf):
    rows = D.pairs(spark, sf).join(D.contigs(spark, sf).select(F.col("doc_id").alias("pair_id"), "seq"), "pair_id")
    rows = rows.select("pair_id", "seq", F.explode(F.array("f_seq", "r_seq", F.concat(F.lit("NNNNN"), F.col("f_seq")))).alias("oligo"))
    first, last = S.locate_oligo(F.col("seq"), F.col("oligo"))
    return rows.select("pair_id", "oligo", F.coalesce(first, F.lit(-1)).cast("bigint").alias("first_index"),
                       F.coalesce(last, F.lit(-1)).cast("bigint").alias("last_index"))


_ALIGN_SQL = """(SELECT chrom, substr(seq,150,20) AS primer, 'near' AS label, 1 AS qstart, substr(seq,150,20) AS q, substr(seq,154,20) AS s, 154 AS ss, 173 AS se FROM contig WHERE length(seq)>=249
   UNION ALL SELECT chrom, substr(seq,150,20), 'part', 4, substr(seq,153,17), substr(seq,157,17), 176, 157 FROM contig WHERE length(seq)>=249
   UNION ALL SELECT chrom, substr(seq,150,20), 'gap', 1, substr(seq,150,6)||'-'||substr(seq,156,10), substr(seq,150,17), 150, 169 FROM contig WHERE length(seq)>=249)"""


@query("hit_strand_anchor", ["contig"], f"""
  SELECT chrom, label, CASE WHEN ss<=se THEN '+' ELSE '-' END AS strand, CASE WHEN ss<=se THEN se ELSE ss END AS anchor FROM {_ALIGN_SQL}""")
def _(spark, sf):
    return D.alignments(spark, sf).select(
        "chrom", "label", H.hit_strand(F.col("sstart"), F.col("send")).alias("strand"), H.hit_anchor(F.col("sstart"), F.col("send")).alias("anchor"))


# Positions of the aligned letters after query gaps are taken out: one text per side.
_DEGAP = f"""(SELECT *, list_aggregate([substr(q,i,1) FOR i IN range(1,length(q)+1) IF substr(q,i,1)<>'-'],'string_agg','') AS qd,
   list_aggregate([substr(s,i,1) FOR i IN range(1,length(q)+1) IF substr(q,i,1)<>'-'],'string_agg','') AS sd FROM {_ALIGN_SQL})"""


@query("full_annotation", ["contig"], f"""
  SELECT chrom, label,
    list_aggregate([CASE WHEN i>=qstart AND i<qstart+length(qd) AND substr(qd,i-qstart+1,1)<>substr(sd,i-qstart+1,1) THEN lower(substr(primer,i,1)) ELSE substr(primer,i,1) END FOR i IN range(1,21)],'string_agg','') AS primer_full,
    list_aggregate([CASE WHEN i<qstart OR i>=qstart+length(qd) THEN ' ' WHEN substr(qd,i-qstart+1,1)=substr(sd,i-qstart+1,1) THEN '|' ELSE 'x' END FOR i IN range(1,21)],'string_agg','') AS match_mask
  FROM {_DEGAP}""")
def _(spark, sf):
    full, mask = H.full_annotation(F.col("primer"), F.col("qstart"), F.col("qseq"), F.col("sseq"))
    return D.alignments(spark, sf).select("chrom", "label", full.alias("primer_full"), mask.alias("match_mask"))


@query("ref_aligned_line", ["contig"], f"""
  SELECT chrom, label, rpad(repeat(' ',(least(ss,se)-148)::INTEGER)||list_aggregate([CASE WHEN substr(qd,i,1)=substr(sd,i,1) THEN substr(qd,i,1) ELSE lower(substr(qd,i,1)) END FOR i IN range(1,length(qd)+1)],'string_agg',''),24,' ') AS line
  FROM {_DEGAP}""")
def _(spark, sf):
    offset = F.least("sstart", "send") - 148
    return D.alignments(spark, sf).select(
        "chrom", "label", H.ref_aligned_line(F.col("qseq"), F.col("sseq"), offset, F.lit(24)).alias("line"))


@query("bisulfite_convert", ["contig"], """
  SELECT chrom, md5(left(m,length(m)-1)) AS methyl, md5(replace(left(seq,length(seq)-1),'C','T')) AS unmethyl
  FROM (SELECT chrom, seq, replace(replace(replace(seq,'CG','#'),'C','T'),'#','CG') AS m FROM contig)""")
def _(spark, sf):
    return D.contigs(spark, sf).select(
        "chrom", F.md5(S.bisulfite_convert(F.col("seq"))).alias("methyl"), F.md5(S.bisulfite_convert(F.col("seq"), "unmethyl")).alias("unmethyl"))


@query("param_defaults", [], """
  SELECT doc_id, CASE WHEN n_chars%2=0 THEN (60+n_chars%30)::INTEGER ELSE 80 END AS min_amplicon_length,
         CASE WHEN n_chars%3=0 THEN (100+n_chars%50)::INTEGER ELSE 120 END AS max_amplicon_length,
         CASE WHEN n_chars%5=0 THEN (40+n_chars%10)::DOUBLE ELSE 35 END AS primer_min_gc, n_chars%7=0 AS bisulfite,
         CASE WHEN n_chars%7=0 THEN 'unmethyl' ELSE 'methyl' END AS cpg_default, 100 AS n_primers, 65.0::DOUBLE AS probe_max_tm FROM documents""")
def _(spark, sf):
    return DS.param_defaults(D.requests(spark, sf)).select(
        "doc_id", "min_amplicon_length", "max_amplicon_length", "primer_min_gc", "bisulfite", "cpg_default", "n_primers", "probe_max_tm")


# --- search ---------------------------------------------------------------------------------------

def _oligos(spark, sf) -> DataFrame:
    return D.pair_oligos(D.pairs(spark, sf))


def _hits(spark, sf) -> DataFrame:
    return SE.seed_extend_hits(_oligos(spark, sf), D.search_tiles(spark, sf))


_HIT = ["sequence", "strand", "chrom", "start", "pident", "sstart", "send", "sseq"]
_HIT_SQL = 'sequence, strand, chrom, start, pident, sstart, send, sseq'


@query("seed_extend_hits", ["hit_any"], f"SELECT {_HIT_SQL} FROM hit_any")
def _(spark, sf):
    return _hits(spark, sf).select(*_HIT)


@query("hit_filter", ["hit_any"], f"SELECT {_HIT_SQL} FROM hit_any WHERE pident>=85 AND n>=12")
def _(spark, sf):
    return SE.hit_filter(_hits(spark, sf), 85.0, 12).select(*_HIT)


@query("hit_cap", ["hit_any"], f"""SELECT {_HIT_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pident DESC, chrom, start, strand) AS rnk FROM hit_any) WHERE rnk<=200""")
def _(spark, sf):
    return SE.hit_cap(_hits(spark, sf)).select(*_HIT)


@query("known_query_semi", ["hit_any", "pair"], f"""
  SELECT {_HIT_SQL} FROM hit_any WHERE sequence IN (SELECT f_seq FROM pair)""")
def _(spark, sf):
    return SE.known_query_semi(_hits(spark, sf), D.pairs(spark, sf).select(F.col("f_seq").alias("sequence"))).select(*_HIT)


@query("hit_counts", ["count_strict"], "SELECT sequence, hits FROM count_strict")
def _(spark, sf):
    return SE.hit_counts(profile_hits(_hits(spark, sf), STRICT_AMPLICON), _oligos(spark, sf))


@query("offtarget_counts", ["pair_oligo", "hit_any"], """
  SELECT o.sequence, greatest(count(h.sequence)-1,0) AS offtargets FROM pair_oligo o LEFT JOIN hit_any h ON h.sequence=o.sequence GROUP BY o.sequence""")
def _(spark, sf):
    return SE.offtarget_counts(_hits(spark, sf), _oligos(spark, sf))


# --- amplicons ------------------------------------------------------------------------------------

def _pair_hits(spark, sf, profile: QcProfile) -> DataFrame:
    return AM.hits_by_pair(profile_hits(_hits(spark, sf), profile), D.pairs(spark, sf))


_AMP = ["f_seq", "r_seq", "kind", "chrom", "size", "i_anchor", "j_anchor", "info"]
_AMP_SQL = ", ".join(_AMP)


@query("fr_amplicon_join", ["fr"], f"SELECT {_AMP_SQL} FROM fr")
def _(spark, sf):
    return AM.fr_amplicons(_pair_hits(spark, sf, STRICT_AMPLICON), STRICT_AMPLICON).select(*_AMP)


@query("fr_amplicon_join_unoriented", ["fr_flags"], f"SELECT {_AMP_SQL} FROM fr_flags")
def _(spark, sf):
    return AM.fr_amplicons(_pair_hits(spark, sf, ALL_FLAGS), ALL_FLAGS).select(*_AMP)


@query("self_amplicon_join", ["self_f", "self_r"], f"SELECT {_AMP_SQL} FROM self_f UNION ALL SELECT {_AMP_SQL} FROM self_r")
def _(spark, sf):
    return AM.self_amplicons(_pair_hits(spark, sf, STRICT_AMPLICON), STRICT_AMPLICON).select(*_AMP)


@query("amplicon_union", ["amplicon_strict"], """
  SELECT f_seq, r_seq, kind, count(*) AS amplicons, sum(size)::BIGINT AS bases, md5(string_agg(info,';' ORDER BY info)) AS digest
  FROM amplicon_strict GROUP BY f_seq, r_seq, kind""")
def _(spark, sf):
    hits = _pair_hits(spark, sf, STRICT_AMPLICON)
    every = AM.amplicon_union([AM.fr_amplicons(hits, STRICT_AMPLICON), AM.self_amplicons(hits, STRICT_AMPLICON)])
    return every.groupBy("f_seq", "r_seq", "kind").agg(
        F.count("*").alias("amplicons"), F.sum("size").alias("bases"),
        F.md5(F.array_join(F.array_sort(F.collect_list("info")), ";")).alias("digest"))


@query("amplicon_rollup", ["rollup_strict"], "SELECT f_seq, r_seq, kind, amplicons, min_size, info FROM rollup_strict")
def _(spark, sf):
    every = AM.all_amplicons(_pair_hits(spark, sf, STRICT_AMPLICON), STRICT_AMPLICON)
    return AM.amplicon_rollup(every).drop("kind_order")


@query("amplicon_total", ["total_strict"], "SELECT f_seq, r_seq, amplicons, min_size, info FROM total_strict")
def _(spark, sf):
    every = AM.all_amplicons(_pair_hits(spark, sf, STRICT_AMPLICON), STRICT_AMPLICON)
    return AM.amplicon_total(AM.amplicon_rollup(every))


# --- thermodynamics -------------------------------------------------------------------------------

@query("thermo_catalog", ["thermo"], f"SELECT sequence, length::INTEGER AS length, {r6s('tm', 'gc')} FROM thermo")
def _(spark, sf):
    return ST.thermo_catalog(D.oligos(spark, sf)).select("sequence", "length", r6("tm"), r6("gc"))


def _screen(kind: str):
    return [F.round(f"{kind}_{c}", 6).alias(c) for c in ("dg", "dh", "ds", "tm")]


@query("homodimer_screen", ["homo"], f"SELECT x AS sequence, found, {r6s('dg', 'dh', 'ds', 'tm')} FROM homo")
def _(spark, sf):
    return ST.homodimer_screen(D.oligos(spark, sf)).select("sequence", F.col("homodimer").alias("found"), *_screen("homodimer"))


@query("hairpin_screen", ["hair"], f"SELECT x AS sequence, found, {r6s('dg', 'dh', 'ds', 'tm')} FROM hair")
def _(spark, sf):
    return ST.hairpin_screen(D.oligos(spark, sf)).select("sequence", F.col("hairpin").alias("found"), *_screen("hairpin"))


@query("heterodimer_screen", ["hetero"], f"SELECT x AS f_seq, y AS r_seq, found, {r6s('dg', 'dh', 'ds', 'tm')} FROM hetero")
def _(spark, sf):
    return ST.heterodimer_screen(D.pairs(spark, sf)).select("f_seq", "r_seq", F.col("heterodimer").alias("found"), *_screen("heterodimer"))


_REACTION = ["tm", "gc_percent", *[f"{k}_{c}" for k in ("hairpin", "homodimer") for c in ("tm", "dg", "dh", "ds")]]
_MIXED = ["sequence", *RICH, "length", "hairpin", "homodimer"]


@query("reaction_catalog", ["reaction"], f"SELECT {', '.join(_MIXED)}, {r6s(*_REACTION)} FROM reaction")
def _(spark, sf):
    mixtures = [F.struct(*[F.lit(v if rich else None).cast("double").alias(c) for c, v in RICH.items()]) for rich in (True, False)]
    asked = D.oligos(spark, sf).select("sequence", F.inline(F.array(*mixtures)))
    return ST.reaction_catalog(asked).select(*_MIXED, *[r6(c) for c in _REACTION])


# --- pair QC --------------------------------------------------------------------------------------

def _qc(spark, sf, profile: QcProfile, searched: DataFrame | None = None) -> DataFrame:
    return pair_qc(D.pairs(spark, sf), D.search_tiles(spark, sf), profile, searched=searched).results


_NUM = ["f_tm", "r_tm", "f_gc", "r_gc", "f_hairpin_dg", "r_hairpin_dg", "f_homodimer_dg", "r_homodimer_dg", "heterodimer_dg", "heterodimer_tm"]
_FLAGS = [f"qc_{f}" for f in QC.FLAGS]


@query("qc_pair_assembly", ["qc_strict"], f"""
  SELECT pair_id, f_seq, r_seq, {r6s(*_NUM)}, f_hits, r_hits, amplicons, coalesce(min_size,-1) AS min_size, info FROM qc_strict""")
def _(spark, sf):
    return _qc(spark, sf, STRICT_AMPLICON).select(
        "pair_id", "f_seq", "r_seq", *[r6(c) for c in _NUM], "f_hits", "r_hits", "amplicons",
        F.coalesce("min_size", F.lit(-1)).alias("min_size"), "info")


@query("external_pair_qc", ["flag_strict"], f"""
  SELECT pair_id, f_hits, r_hits, amplicons, coalesce(min_size,-1) AS min_size, info, {', '.join(_FLAGS)}, final_result FROM flag_strict""")
def _(spark, sf):
    """The hits go out as an external search writes them, one line per pair and primer, and come back by name."""
    pairs = D.pairs(spark, sf)
    # Such a search caps the alignments of each query; the limits are applied by whoever reads them.
    hits = cut_lineage(SE.hit_cap(_hits(spark, sf), STRICT_AMPLICON.max_alignments))
    named = pairs.select(F.inline(F.array(*[
        F.struct(F.col(f"{p}_name").alias("qseqid"), F.col(f"{p}_seq").alias("sequence")) for p in "fr"])))
    columns = ["qseqid", "chrom", "pident", "length", "mismatch", F.lit(0), "qstart", "qend", "sstart", "send",
               F.lit("0.01"), F.lit("30.2"), "qseq", "sseq"]
    path = scratch_path(spark, "external")
    counted_lookup(named, hits, ["sequence"], "inner").select(F.concat_ws("\t", *columns).alias("value")).write.text(path)
    return pair_qc(pairs, None, STRICT_AMPLICON, hits=hit_tsv_scan(spark, path)).results.select(
        "pair_id", "f_hits", "r_hits", "amplicons", F.coalesce("min_size", F.lit(-1)).alias("min_size"), "info", *_FLAGS, "final_result")


@query("qc_flags", ["flag_strict"], f"SELECT pair_id, {', '.join(_FLAGS)} FROM flag_strict")
def _(spark, sf):
    return _qc(spark, sf, STRICT_AMPLICON).select("pair_id", *_FLAGS)


@query("qc_flags_all", ["flag_flags"], f"SELECT pair_id, {', '.join(_FLAGS)} FROM flag_flags")
def _(spark, sf):
    return _qc(spark, sf, ALL_FLAGS).select("pair_id", *_FLAGS)


@query("final_result", ["flag_strict", "flag_flags"], """
  SELECT pair_id, s.final_result AS strict_result, f.final_result AS flags_result FROM flag_strict s JOIN flag_flags f USING (pair_id)""")
def _(spark, sf):
    strict = _qc(spark, sf, STRICT_AMPLICON).select("pair_id", F.col("final_result").alias("strict_result"))
    return strict.join(_qc(spark, sf, ALL_FLAGS).select("pair_id", F.col("final_result").alias("flags_result")), "pair_id")


@query("search_status", ["flag_strict", "contig"], """
  SELECT pair_id, CASE WHEN ok THEN f_hits ELSE -1 END AS f_hits, CASE WHEN ok THEN r_hits ELSE -1 END AS r_hits,
         CASE WHEN ok THEN amplicons ELSE -1 END AS amplicons, CASE WHEN ok THEN qc_hit ELSE 'X' END AS qc_hit,
         CASE WHEN ok THEN qc_amplicon ELSE 'X' END AS qc_amplicon, CASE WHEN ok THEN final_result ELSE 'FAIL' END AS final_result
  FROM (SELECT f.*, length(seq)%3<>0 AS ok FROM flag_strict f JOIN contig ON doc_id=pair_id)""")
def _(spark, sf):
    searched = D.contigs(spark, sf).select(F.col("doc_id").alias("pair_id"), (F.length("seq") % 3 != 0).alias("ok"))
    return _qc(spark, sf, STRICT_AMPLICON, searched).select(
        "pair_id", "f_hits", "r_hits", "amplicons", "qc_hit", "qc_amplicon", "final_result")


def _p2(name: str) -> str:
    return f"printf('%.2f',{name})"


_REPORT_SQL = ["f_name", "f_seq", "r_name", "r_seq", *map(_p2, (
    "f_tm", "r_tm", "f_gc", "r_gc", "f_hairpin_dg", "r_hairpin_dg", "f_hairpin_tm", "r_hairpin_tm", "f_homodimer_dg", "r_homodimer_dg",
    "f_homodimer_tm", "r_homodimer_tm", "heterodimer_dg", "heterodimer_tm")), "f_hits::VARCHAR", "r_hits::VARCHAR", "amplicons::VARCHAR",
    "coalesce(min_size::VARCHAR,'')", "info", "qc_tm_range", "qc_tm_diff", "qc_hairpin", "qc_homodimer", "qc_heterodimer", "qc_hit",
    "qc_amplicon", "final_result"]


@query("qc_report_write", ["flag_strict"], "SELECT " + ", ".join(
    f'{e} AS "{c}"' for e, c in zip(_REPORT_SQL, QC_REPORT_COLUMNS)) + " FROM flag_strict")
def _(spark, sf):
    path = scratch_path(spark, "report")
    qc_report_write(_qc(spark, sf, STRICT_AMPLICON), path)
    back = spark.read.csv(path, sep="\t", header=True, quote="")
    return back.na.fill("")


# --- region design --------------------------------------------------------------------------------

def _regions(spark, sf) -> DataFrame:
    return region_table_scan(D.regions(spark, sf))


def _templates(spark, sf) -> DataFrame:
    return region_templates(_regions(spark, sf), D.genome_tiles(spark, sf), DESIGN_DEFAULTS)


@query("template_window_fetch", ["region_in", "edge_region", "contig"], """
  SELECT region_id, window_start, window_end, coalesce(error,'') AS error, CASE WHEN error IS NULL THEN substr(seq,window_start+1,window_end-window_start) ELSE '' END AS template,
         (s-1-window_start)::INTEGER AS target_start_index, (e-window_start)::INTEGER AS target_end_index
  FROM (SELECT chrom||':'||s||'-'||e AS region_id, seq, s, e, e-120 AS window_start, s+120 AS window_end,
               CASE WHEN e<120 THEN 'window starts before the contig' END AS error
        FROM (SELECT chrom, "start" AS s, "end" AS e FROM region_in UNION ALL SELECT chrom, "start", "end" FROM edge_region) JOIN contig USING (chrom))""")
def _(spark, sf):
    every = D.regions(spark, sf).unionByName(D.edge_regions(spark, sf))
    got = template_window_fetch(region_table_scan(every), D.genome_tiles(spark, sf), 120)
    return got.select("region_id", "window_start", "window_end", F.coalesce("error", F.lit("")).alias("error"),
                      F.coalesce("template", F.lit("")).alias("template"), "target_start_index", "target_end_index")


@query("tile_store_fetch", ["region_in", "contig"], """
  SELECT r.chrom, r."start", r."end", substr(seq,("end"-119)::BIGINT,(2*120-("end"-"start"+1)+1)::BIGINT) AS template FROM region_in r JOIN contig USING (chrom)""")
def _(spark, sf):
    """Windows read from a stored reference, of which only the files with wanted tiles are opened."""
    store = TileStore.write(D.genome_tiles(spark, sf), scratch_path(spark, "store"), file_bases=100_000)
    return template_window_fetch(_regions(spark, sf), store, 120).select("chrom", "start", "end", "template")


@query("subseq_fetch", ["contig"], """
  SELECT chrom, md5(substr(seq,2,length(seq)-2)) AS digest FROM contig WHERE length(seq)>2""")
def _(spark, sf):
    n = F.length("seq").cast("bigint")
    ranges = D.contigs(spark, sf).filter(n > 2).select("chrom", F.lit(2).cast("bigint").alias("start"), (n - 1).alias("end"))
    return subseq_fetch(ranges, D.genome_tiles(spark, sf), ["chrom"]).select("chrom", F.md5("seq").alias("digest"))


@query("methylation_join", ["template", "methyl"], """
  SELECT region_id, string_agg(CASE WHEN b<>'C' THEN b WHEN nxt<>'G' THEN 'T' WHEN coalesce(methylated,true) THEN 'C' ELSE 'T' END,'' ORDER BY i) AS converted
  FROM (SELECT region_id, chrom, i, substr(template_plus,i::BIGINT,1) AS b, substr(template_plus,(i+1)::BIGINT,1) AS nxt, window_start+i-1 AS pos
        FROM (SELECT *, unnest(range(1,length(template_plus))) AS i FROM template)) t
  LEFT JOIN methyl m ON m.chrom=t.chrom AND m.pos=t.pos GROUP BY region_id""")
def _(spark, sf):
    windows = template_window_fetch(_regions(spark, sf), D.genome_tiles(spark, sf), 120, look_ahead=1)
    return methylation_join(windows, D.methylation(spark, sf)).select("region_id", "converted")


@query("oligo_candidates", ["template"], f"""
  SELECT region_id, role, count(*) AS oligos, sum(start)::BIGINT AS starts, sum(len)::BIGINT AS lens, count(DISTINCT s) AS texts, min(s) AS least_text
  FROM (SELECT region_id, role, start, len, CASE WHEN role='left' THEN p ELSE {rc('p')} END AS s FROM (
    SELECT region_id, start, len, unnest(['left','right']) AS role, substr(template,start+1,len) AS p FROM (
      SELECT *, unnest(range(0,length(template)-len+1)) AS start FROM (SELECT *, unnest(range(20,31)) AS len FROM template))))
  GROUP BY region_id, role""")
def _(spark, sf):
    return DS.oligo_candidates(_templates(spark, sf), 20, 30).groupBy("region_id", "role").agg(
        F.count("*").alias("oligos"), F.sum("start").alias("starts"), F.sum("len").alias("lens"),
        F.countDistinct("sequence").alias("texts"), F.min("sequence").alias("least_text"))


@query("oligo_filter", ["cand"], """
  SELECT region_id, count(*) AS oligos, sum(start)::BIGINT AS starts, round(min(tm),6) AS min_tm, round(max(tm),6) AS max_tm, round(max(gc),6) AS max_gc
  FROM cand WHERE tm BETWEEN 50 AND 70 GROUP BY region_id""")
def _(spark, sf):
    oligos = DS.with_tm_gc(DS.oligo_candidates(_templates(spark, sf), 20, 30, ("left",)), 30, 35, 65)
    return DS.oligo_filter(oligos, 20, 30, 50, 70, 35, 65).groupBy("region_id").agg(
        F.count("*").alias("oligos"), F.sum("start").alias("starts"), F.round(F.min("tm"), 6).alias("min_tm"),
        F.round(F.max("tm"), 6).alias("max_tm"), F.round(F.max("gc"), 6).alias("max_gc"))


@query("probe_candidates", ["probe"], f"SELECT region_id, start::INTEGER AS start, len::INTEGER AS len, sequence, {r6s('tm', 'gc')} FROM probe")
def _(spark, sf):
    return DS.probe_candidates(_templates(spark, sf), DESIGN_DEFAULTS).select("region_id", "start", "len", "sequence", r6("tm"), r6("gc"))


@query("probe_covers_target", ["cand"], """
  SELECT region_id, count(*) AS covering, sum(len)::BIGINT AS lens FROM cand WHERE start<=t_start AND start+len>=t_end GROUP BY region_id""")
def _(spark, sf):
    templates = _templates(spark, sf)
    oligos = DS.with_tm_gc(DS.oligo_candidates(templates, 20, 30, ("left",)), 30, 35, 65)
    where = oligos.join(templates.select("region_id", "target_start_index", "target_end_index"), "region_id")
    return where.filter(DS.probe_covers_target(F.col("start"), F.col("len"))).groupBy("region_id").agg(
        F.count("*").alias("covering"), F.sum("len").alias("lens"))


@query("pair_candidates", ["all_pair"], """
  SELECT region_id, count(*) AS pairs, sum(product_size)::BIGINT AS sizes, sum(l_start*7+l_len*3+r_start*5+r_len)::BIGINT AS places,
         round(min(penalty),6) AS least, round(max(penalty),6) AS most FROM all_pair GROUP BY region_id""")
def _(spark, sf):
    # Both sides of the join read the primers, so they are worked out once and written.
    primers = cut_lineage(DS.primer_candidates(_templates(spark, sf), DESIGN_DEFAULTS))
    pairs = DS.pair_candidates(primers, 80, 120)
    return pairs.groupBy("region_id").agg(
        F.count("*").alias("pairs"), F.sum("product_size").alias("sizes"),
        F.sum(F.col("l_start") * 7 + F.col("l_len") * 3 + F.col("r_start") * 5 + F.col("r_len")).alias("places"),
        F.round(F.min("penalty"), 6).alias("least"), F.round(F.max("penalty"), 6).alias("most"))


@query("probe_primer_join", ["triple"], """
  SELECT region_id, p_start::INTEGER AS p_start, p_len::INTEGER AS p_len, count(*) AS pairs, sum(l_start*7+l_len*3+r_start*5+r_len)::BIGINT AS places,
         round(min(penalty),6) AS least, round(max(penalty),6) AS most FROM triple GROUP BY region_id, p_start, p_len""")
def _(spark, sf):
    templates = cut_lineage(_templates(spark, sf))
    p = DESIGN_DEFAULTS
    probes = DS.probe_candidates(templates, p)
    triples = DS.probe_primer_join(probes, cut_lineage(DS.primer_candidates(templates, p, (52.0, 59.0))), p, 80, 120)
    return triples.groupBy("region_id", "p_start", "p_len").agg(
        F.count("*").alias("pairs"), F.sum(F.col("l_start") * 7 + F.col("l_len") * 3 + F.col("r_start") * 5 + F.col("r_len")).alias("places"),
        F.round(F.min("penalty"), 6).alias("least"), F.round(F.max("penalty"), 6).alias("most"))


def _best(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = {**DESIGN_DEFAULTS, "n_probes": 0}
    templates = cut_lineage(_templates(spark, sf))
    return templates, design_amplicons(templates, p)


@query("pair_topn", ["all_pair"], """
  SELECT region_id, rank, l_start::INTEGER AS l_start, l_len::INTEGER AS l_len, r_start::INTEGER AS r_start, r_len::INTEGER AS r_len, l_seq, r_seq, product_size, round(penalty,6) AS penalty
  FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(penalty,6), l_start, l_len, r_start, r_len) AS rank FROM all_pair) WHERE rank<=100""")
def _(spark, sf):
    _, best = _best(spark, sf)
    return best.select("region_id", F.col("rank").cast("bigint").alias("rank"), "l_start", "l_len", "r_start", "r_len", "l_seq", "r_seq", "product_size", r6("penalty"))


@query("returned_counts", ["primer", "probe", "all_pair"], """
  SELECT region_id, n_left, n_right, n_probe, n_pair, greatest(n_left,n_right,n_probe,n_pair) AS n_designed FROM (
    SELECT region_id, sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, sum(q)::BIGINT AS n_probe, sum(p)::BIGINT AS n_pair FROM (
      SELECT region_id, CASE WHEN role='left' THEN 1 ELSE 0 END AS l, CASE WHEN role='right' THEN 1 ELSE 0 END AS r, 0 AS q, 0 AS p FROM primer
      UNION ALL SELECT region_id, 0, 0, 1, 0 FROM probe UNION ALL SELECT region_id, 0, 0, 0, 1 FROM all_pair) GROUP BY region_id)""")
def _(spark, sf):
    templates = cut_lineage(_templates(spark, sf))
    primers = cut_lineage(DS.primer_candidates(templates, DESIGN_DEFAULTS))
    return DS.returned_counts(
        primers.filter("role = 'left'"), primers.filter("role = 'right'"), DS.probe_candidates(templates, DESIGN_DEFAULTS),
        DS.pair_candidates(primers, 80, 120))


@query("amplicon_row", ["best_row"], """
  SELECT region_id, rank, template AS template_sequence, t_start::INTEGER AS target_start_index, t_end::INTEGER AS target_end_index, amplicon_sequence,
         length(amplicon_sequence)::INTEGER AS amplicon_length, l_seq AS forward_sequence, r_seq AS reverse_sequence, l_start::INTEGER AS forward_start_index,
         (l_start+l_len-1)::INTEGER AS forward_end_index, r_start::INTEGER AS reverse_start_index, (r_start+r_len-1)::INTEGER AS reverse_end_index,
         round(l_tm,6) AS forward_tm, round(r_tm,6) AS reverse_tm, round(l_gc,6) AS forward_gc_percent, f_cpg::INTEGER AS forward_cpg_count, r_cpg::INTEGER AS reverse_cpg_count
  FROM best_row""")
def _(spark, sf):
    templates, best = _best(spark, sf)
    return DS.amplicon_row(best, templates).select(
        "region_id", F.col("rank").cast("bigint").alias("rank"), "template_sequence", "target_start_index", "target_end_index", "amplicon_sequence",
        "amplicon_length", "forward_sequence", "reverse_sequence", "forward_start_index", "forward_end_index", "reverse_start_index",
        "reverse_end_index", r6("forward_tm"), r6("reverse_tm"), r6("forward_gc_percent"), "forward_cpg_count", "reverse_cpg_count")


@query("cpg_range", ["best_row"], """
  SELECT region_id, rank, f_cpg::INTEGER AS forward_cpg_count, r_cpg::INTEGER AS reverse_cpg_count FROM best_row WHERE f_cpg BETWEEN 1 AND 2 AND r_cpg BETWEEN 0 AND 3""")
def _(spark, sf):
    templates, best = _best(spark, sf)
    rows = DS.amplicon_row(best, templates)
    kept = rows.filter(DS.cpg_range(F.col("forward_cpg_count"), 1, 2) & DS.cpg_range(F.col("reverse_cpg_count"), 0, 3))
    return kept.select("region_id", F.col("rank").cast("bigint").alias("rank"), "forward_cpg_count", "reverse_cpg_count")


@query("non_cpg_range", ["contig"], f"""
  SELECT chrom, strand, s::INTEGER AS "start", {_NON_SQL}::INTEGER AS non_cpg FROM {_SPAN_SQL} WHERE length(seq)>=249 AND {_NON_SQL} BETWEEN 3 AND 5""")
def _(spark, sf):
    counted = D.spans(spark, sf).select("chrom", "strand", "start", S.non_cpg_c_count(*_span_args()).alias("non_cpg"))
    return counted.filter(DS.cpg_range(F.col("non_cpg"), 3, 5))


def _design(spark, sf, **params) -> DataFrame:
    return region_design(_regions(spark, sf), D.genome_tiles(spark, sf), {"n_probes": 0, **params})


_DESIGN_NUM = {
    "forward_hairpin_dg": "f_hair_dg", "reverse_hairpin_tm": "r_hair_tm", "forward_homodimer_dg": "f_homo_dg", "reverse_homodimer_dg": "r_homo_dg",
    "heterodimer_dg": "het_dg", "heterodimer_tm": "het_tm",
}
_DESIGN_SQL = ", ".join(f"round({v},6) AS {k}" for k, v in _DESIGN_NUM.items())


@query("bed_batch_design", ["designed"], f"""
  SELECT region_id, rank, l_seq AS forward_sequence, r_seq AS reverse_sequence, {_DESIGN_SQL}, selected FROM designed""")
def _(spark, sf):
    return _design(spark, sf).select("region_id", F.col("rank").cast("bigint").alias("rank"), "forward_sequence", "reverse_sequence",
                                     *[r6(c) for c in _DESIGN_NUM], "selected")


@query("amplicon_threshold_qc", ["designed"], "SELECT region_id, rank, l_seq AS forward_sequence, r_seq AS reverse_sequence FROM designed WHERE selected")
def _(spark, sf):
    return QC.amplicon_threshold_qc(_design(spark, sf), AMPLICON_THRESHOLDS).select(
        "region_id", F.col("rank").cast("bigint").alias("rank"), "forward_sequence", "reverse_sequence")


@query("qc_pass_count", ["designed"], "SELECT region_id, count(*) AS candidates, count(*) FILTER (selected) AS passing FROM designed GROUP BY region_id")
def _(spark, sf):
    return QC.qc_pass_count(_design(spark, sf), AMPLICON_THRESHOLDS)


@query("candidate_view", ["designed"], """
  SELECT region_id, rank::INTEGER AS rank, product_size, l_seq AS forward_seq, round(l_tm,6) AS forward_tm, round(l_gc,6) AS forward_gc, r_seq AS reverse_seq,
         round(r_tm,6) AS reverse_tm, round(r_gc,6) AS reverse_gc, '' AS probe_seq, f_cpg::INTEGER AS forward_cpg_count, r_cpg::INTEGER AS reverse_cpg_count FROM designed WHERE selected""")
def _(spark, sf):
    view = R.candidate_view(_design(spark, sf).filter("selected"))
    return view.select("region_id", "rank", "product_size", "forward_seq", r6("forward_tm"), r6("forward_gc"), "reverse_seq", r6("reverse_tm"), r6("reverse_gc"),
                       F.coalesce("probe_seq", F.lit("")).alias("probe_seq"), "forward_cpg_count", "reverse_cpg_count")


@query("candidate_rank_top10", ["all_pair"], """
  SELECT region_id, rank, l_seq AS forward_seq, r_seq AS reverse_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY product_size, l_start, l_len, r_start, r_len) AS rank FROM all_pair) WHERE rank<=10""")
def _(spark, sf):
    # Ten pairs need few product sizes, so the others are not made and sorted.
    primers = cut_lineage(DS.primer_candidates(_templates(spark, sf), DESIGN_DEFAULTS))
    pairs = DS.pair_candidates(DS.with_longest(primers, 10, 80, 120), 80, 120)
    top = R.candidate_rank_top(pairs, ["product_size", *DS.PAIR_ORDER])
    return top.select("region_id", F.col("rank").cast("bigint").alias("rank"), F.col("l_seq").alias("forward_seq"), F.col("r_seq").alias("reverse_seq"))


@query("best_per_region", ["region_in", "edge_region", "designed"], """
  SELECT r.region_id, coalesce(d.l_seq,'') AS forward_sequence, coalesce(d.r_seq,'') AS reverse_sequence FROM (
    SELECT chrom||':'||"start"||'-'||"end" AS region_id FROM region_in UNION ALL SELECT chrom||':'||"start"||'-'||"end" FROM edge_region) r
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY rank) AS nth FROM designed WHERE selected) d ON d.region_id=r.region_id AND nth=1""")
def _(spark, sf):
    every = region_table_scan(D.regions(spark, sf).unionByName(D.edge_regions(spark, sf))).select("region_id")
    best = R.best_per_region(every, _design(spark, sf).filter("selected"), ["rank"])
    return best.select("region_id", F.coalesce("forward_sequence", F.lit("")).alias("forward_sequence"),
                       F.coalesce("reverse_sequence", F.lit("")).alias("reverse_sequence"))


_PROBE_RANK_SQL = """(SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(abs(tm-60)+abs(len-25),6), start, len) AS probe_rank FROM probe)"""


@query("probe_primer_append", ["triple", "probe", "best_pair"], f"""
  SELECT t.region_id, probe_rank, rank, p_seq AS probe_sequence, l_seq AS forward_sequence, r_seq AS reverse_sequence FROM (
    SELECT *, row_number() OVER (PARTITION BY region_id, p_start, p_len ORDER BY round(penalty,6), l_start, l_len, r_start, r_len) AS rank FROM triple) t
  JOIN {_PROBE_RANK_SQL} q ON q.region_id=t.region_id AND q.start=p_start AND q.len=p_len AND probe_rank<=100 WHERE rank<=100
  UNION ALL SELECT region_id, 0, rank, '', l_seq, r_seq FROM best_pair""")
def _(spark, sf):
    templates = cut_lineage(_templates(spark, sf))
    with_probe, without = design_amplicons(templates, DESIGN_DEFAULTS), design_amplicons(templates, {**DESIGN_DEFAULTS, "n_probes": 0})
    return DS.probe_primer_append(with_probe, without).select(
        "region_id", F.coalesce("probe_rank", F.lit(0)).cast("bigint").alias("probe_rank"), F.col("rank").cast("bigint").alias("rank"),
        F.coalesce("p_seq", F.lit("")).alias("probe_sequence"), F.col("l_seq").alias("forward_sequence"), F.col("r_seq").alias("reverse_sequence"))


@query("design_bundle_write", ["designed"], """
  SELECT 'all_primers' AS part, region_id AS a, l_seq AS b, r_seq AS c FROM designed UNION ALL SELECT 'selected_primers', region_id, l_seq, r_seq FROM designed WHERE selected
  UNION ALL SELECT 'thresholds', 'min_amplicon_length', '80', '' UNION ALL SELECT 'thresholds', 'reference', 'derived', ''""")
def _(spark, sf):
    rows = cut_lineage(_design(spark, sf))
    given = spark.range(1).select(F.lit("derived").alias("reference"), F.lit(80).alias("min_amplicon_length"), F.lit(None).cast("int").alias("n_primers"))
    out = design_bundle_write(rows, rows.filter("selected"), given, scratch_path(spark, "bundle"))
    parts = [
        spark.read.parquet(out[name]).select(F.lit(name).alias("part"), F.col("region_id").alias("a"), F.col("forward_sequence").alias("b"), F.col("reverse_sequence").alias("c"))
        for name in ("all_primers", "selected_primers")
    ]
    last = spark.read.parquet(out["thresholds"]).select(F.lit("thresholds").alias("part"), F.col("parameter").alias("a"), F.col("value").alias("b"), F.lit("").alias("c"))
    return parts[0].unionByName(parts[1]).unionByName(last)


# --- scoring --------------------------------------------------------------------------------------

@query("penalty_score", ["pair", "homo", "hair", "hetero", "pair_oligo", "hit_any"], """
  SELECT pair_id, round((abs(fo.dg)+abs(fh.dg)+abs(ro.dg)+abs(rh.dg)+abs(x.dg))*1000+3*fc.n+3*rc.n,4) AS score
  FROM pair p JOIN homo fo ON fo.x=f_seq JOIN homo ro ON ro.x=r_seq JOIN hair fh ON fh.x=f_seq JOIN hair rh ON rh.x=r_seq JOIN hetero x ON x.x=f_seq AND x.y=r_seq
  JOIN (SELECT o.sequence, greatest(count(h.sequence)-1,0) AS n FROM pair_oligo o LEFT JOIN hit_any h ON h.sequence=o.sequence GROUP BY o.sequence) fc ON fc.sequence=f_seq
  JOIN (SELECT o.sequence, greatest(count(h.sequence)-1,0) AS n FROM pair_oligo o LEFT JOIN hit_any h ON h.sequence=o.sequence GROUP BY o.sequence) rc ON rc.sequence=r_seq""")
def _(spark, sf):
    pairs = D.pairs(spark, sf)
    oligos = _oligos(spark, sf)
    record = ST.homodimer_screen(oligos).join(ST.hairpin_screen(oligos), "sequence").join(SE.offtarget_counts(_hits(spark, sf), oligos), "sequence")
    rows = pairs
    for p in ("f", "r"):
        rows = rows.join(record.select(
            F.col("sequence").alias(f"{p}_seq"), F.col("homodimer_dg").alias(f"{p}_self_dimer"), F.col("hairpin_dg").alias(f"{p}_hairpin"),
            F.col("offtargets").alias(f"{p}_offtarget")), f"{p}_seq")
    rows = rows.join(ST.heterodimer_screen(pairs).select("f_seq", "r_seq", F.col("heterodimer_dg").alias("hetero_dimer")), ["f_seq", "r_seq"])
    scored = rows.withColumn("probe_offtarget", F.lit(0)).withColumn("score", R.penalty_score())
    return scored.select("pair_id", F.round("score", 4).alias("score"))


def _ranked(spark, sf, mode: str) -> DataFrame:
    """Whole contigs as templates, taken from tiles that overlap by the longest product."""
    pieces = pieces_of_tiles(contig_tiles(D.contigs(spark, sf), tile=CORE, overlap=SCORING["max_product"] - 1))
    return score_rank_pieces(pieces, D.search_tiles(spark, sf), mode=mode)


def _named(rows: DataFrame, *more) -> DataFrame:
    return rows.select("job_id", F.col("position").cast("bigint").alias("position"), "forward", "reverse", *more)


@query("score_rank", ["ranked_probe"], """
  SELECT job_id, position, forward, reverse, probe, f_offtarget, r_offtarget, probe_offtarget, round(score,4) AS score FROM ranked_probe""")
def _(spark, sf):
    return _named(_ranked(spark, sf, "probe"), "probe", "f_offtarget", "r_offtarget", "probe_offtarget", F.round("score", 4).alias("score"))


@query("score_rank_primer", ["ranked_primer"], "SELECT job_id, position, forward, reverse, f_offtarget, r_offtarget, round(score,4) AS score FROM ranked_primer")
def _(spark, sf):
    return _named(_ranked(spark, sf, "primer"), "f_offtarget", "r_offtarget", F.round("score", 4).alias("score"))


@query("ranked_json_write", ["ranked_probe"], "SELECT job_id, position, forward, reverse, probe, round(score,4) AS score FROM ranked_probe")
def _(spark, sf):
    path = scratch_path(spark, "ranked")
    ranked_json_write(_ranked(spark, sf, "probe"), path)
    back = ranked_json_read(spark, path, "job_id string, position int, forward string, reverse string, probe string, score double")
    return _named(back, "probe", F.round("score", 4).alias("score"))


# --- binding --------------------------------------------------------------------------------------

_WINDOW_SQL = """(SELECT grp, coalesce(max(chrom) FILTER (name='primer_1'),min(chrom)) AS chrom,
    coalesce(max("start") FILTER (name='primer_1'),min("start"))-30 AS s, coalesce(max("end") FILTER (name='primer_2'),max("end"))+30 AS e,
    max(sequence) FILTER (name='primer_1') AS p1, max(reverse(sequence)) FILTER (name='primer_2') AS p2 FROM bed GROUP BY grp)"""


@query("binding_window", ["bed"], f"""SELECT grp, chrom, s::BIGINT AS win_start, e::BIGINT AS win_end FROM {_WINDOW_SQL}""")
def _(spark, sf):
    return B.binding_window(D.bed(spark, sf)).select("grp", "chrom", "win_start", "win_end")


@query("highlight_spans", ["bed"], """SELECT grp, chrom, "start", "end" FROM bed WHERE name IN ('target','missmatch')""")
def _(spark, sf):
    return B.highlight_spans(D.bed(spark, sf))


@query("pair_alignment_rows", ["bed", "contig"], f"""
  SELECT grp, ref_seq, ref_complement, rpad(repeat(' ',30)||p1,length(ref_seq)::INTEGER,' ') AS line_1,
    CASE WHEN p2 IS NULL THEN '' ELSE rpad(repeat(' ',110)||p2,length(ref_seq)::INTEGER,' ') END AS line_2,
    CASE WHEN p2 IS NULL THEN '' ELSE rpad(repeat(' ',110)||list_aggregate([CASE WHEN substr(p2,i,1)=substr(ref_complement,110+i,1) THEN '|' ELSE ' ' END FOR i IN range(1,21)],'string_agg',''),length(ref_seq)::INTEGER,' ') END AS match_2
  FROM (SELECT grp, p1, p2, substr(seq,s+1,e-s) AS ref_seq, translate(substr(seq,s+1,e-s),'ACGT','TGCA') AS ref_complement FROM {_WINDOW_SQL} JOIN contig USING (chrom))""")
def _(spark, sf):
    rows = binding_alignment(D.bed(spark, sf), D.genome_tiles(spark, sf))
    return rows.select("grp", "ref_seq", "ref_complement", "line_1", F.coalesce("line_2", F.lit("")).alias("line_2"), F.coalesce("match_2", F.lit("")).alias("match_2"))
