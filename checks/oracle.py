"""The derived tables and the shared steps as DuckDB SQL."""

from __future__ import annotations

import math

BASES = "ACGT"

# Unified nearest-neighbour parameters (SantaLucia 1998), in tenths of kcal/mol (dH) and cal/mol/K (dS),
# stated here anew so that the SQL does not depend on what it checks.
NN_DH = {
    "AA": -79, "AC": -84, "AG": -78, "AT": -72, "CA": -85, "CC": -80, "CG": -106, "CT": -78,
    "GA": -82, "GC": -98, "GG": -80, "GT": -84, "TA": -72, "TC": -82, "TG": -85, "TT": -79,
}
NN_DS = {
    "AA": -222, "AC": -224, "AG": -210, "AT": -204, "CA": -227, "CC": -199, "CG": -272, "CT": -210,
    "GA": -222, "GC": -244, "GG": -199, "GT": -224, "TA": -213, "TC": -222, "TG": -227, "TT": -222,
}

# 50 mM monovalent, 1.5 mM divalent, 0.6 mM dNTP as molar sodium.
LN_NA = repr(math.log((50.0 + 120.0 * math.sqrt(1.5 - 0.6)) / 1000.0))
LN_C = repr(math.log(50.0 * 1e-9))
LN_C4 = repr(math.log(50.0 * 1e-9 / 4.0))


def rc(s: str) -> str:
    return f"reverse(translate({s},'ACGTNacgtn','TGCANtgcan'))"


def gc_pct(s: str) -> str:
    return f"(length({s})-length(replace(replace({s},'G',''),'C','')))*100.0::DOUBLE/length({s})"


def steps(s: str) -> tuple[str, str]:
    """Sums over the steps of a sequence by looking up each position."""
    def total(values: dict[str, int]) -> str:
        table = "[" + ",".join(str(values[a + b]) for a in BASES for b in BASES) + "]"
        at = f"(strpos('ACGT',substr({s},i::BIGINT,1))-1)*4+strpos('ACGT',substr({s},(i+1)::BIGINT,1))"
        return f"coalesce(list_sum(list_transform(range(1,length({s})),lambda i: {table}[{at}])),0)"

    return total(NN_DH), total(NN_DS)


def ends(s: str) -> tuple[str, str]:
    def one(e: str, at: int, gc: int) -> str:
        return f"(CASE WHEN {e} IN ('A','T') THEN {at} ELSE {gc} END)"

    first, last = f"substr({s},1,1)", f"substr({s},length({s}),1)"
    return (
        f"({one(first, 23, 1)}+{one(last, 23, 1)})",
        f"({one(first, 41, -28)}+{one(last, 41, -28)})",
    )


def tm(s: str, salt: str = LN_NA, all_strands: str = LN_C, quarter: str = LN_C4) -> str:
    (dh, ds), (eh, es) = steps(s), ends(s)
    self_ = f"{s}={rc(s)}"
    return (
        f"(({dh}+{eh})*100.0::DOUBLE/(({ds}+{es}+CASE WHEN {self_} THEN -14 ELSE 0 END)/10.0::DOUBLE"
        f"+0.368::DOUBLE*(length({s})-1)*({salt})::DOUBLE"
        f"+1.987::DOUBLE*(CASE WHEN {self_} THEN ({all_strands})::DOUBLE ELSE ({quarter})::DOUBLE END))-273.15::DOUBLE)"
    )


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(deps: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + body


cte("contig", [], """
  SELECT 'doc'||doc_id AS chrom, doc_id,
         translate(lower(regexp_replace(text,'[^A-Za-z]','','g')),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') AS seq
  FROM documents WHERE length(regexp_replace(text,'[^A-Za-z]','','g'))>0""")
cte("genome", ["contig"], f"""
  SELECT chrom, seq FROM contig
  UNION ALL SELECT 'inv'||doc_id, substr(seq,100,50)||substr(seq,150,20)||substr(seq,170,40)||{rc('substr(seq,150,20)')}||substr(seq,300,50)
  FROM contig WHERE length(seq)>=349
  UNION ALL SELECT 'ivr'||doc_id, substr(seq,100,50)||{rc('substr(seq,230,20)')}||substr(seq,170,40)||substr(seq,230,20)||substr(seq,300,50)
  FROM contig WHERE length(seq)>=349""")
cte("pair", ["contig"], f"""
  SELECT doc_id AS pair_id, 'F'||doc_id AS f_name, substr(seq,150,20) AS f_seq, 'R'||doc_id AS r_name, {rc('substr(seq,230,20)')} AS r_seq
  FROM contig WHERE length(seq)>=249""")
cte("pair_oligo", ["pair"], "SELECT f_seq AS sequence FROM pair UNION SELECT r_seq FROM pair")
cte("oligo", ["contig", "pair_oligo"], f"""
  SELECT sequence FROM pair_oligo
  UNION SELECT substr(seq,150,16)||{rc('substr(seq,150,9)')} FROM contig WHERE length(seq)>=165""")
cte("region_in", ["contig"], """
  SELECT chrom, 190::BIGINT AS "start", 209::BIGINT AS "end", CASE WHEN length(seq)>1000 THEN 'long-'||doc_id ELSE ' ' END AS name
  FROM contig WHERE length(seq)>=310""")
cte("edge_region", ["contig"], """
  SELECT chrom, 60::BIGINT AS "start", 79::BIGINT AS "end" FROM contig WHERE length(seq)>=150
  UNION ALL SELECT chrom, length(seq)-10, length(seq) FROM contig WHERE length(seq)>=150""")
cte("bed", ["contig"], f"""
  SELECT chrom, s AS "start", e AS "end", name, sequence, strand, 'g'||doc_id AS grp FROM (
    SELECT chrom, doc_id, seq, 149 AS s, 169 AS e, 'primer_1' AS name, substr(seq,150,20) AS sequence, '+' AS strand FROM contig
    UNION ALL SELECT chrom, doc_id, seq, 189, 209, 'target', substr(seq,190,20), '+' FROM contig
    UNION ALL SELECT chrom, doc_id, seq, 195, 196, 'missmatch', substr(seq,196,1), '+' FROM contig
    UNION ALL SELECT chrom, doc_id, seq, 229, 249, 'primer_2', {rc('substr(seq,230,20)')}, '-' FROM contig WHERE length(seq)%2=0)
  WHERE length(seq)>=249""")
cte("methyl", ["contig"], """
  SELECT chrom, (p-1)::BIGINT AS pos, (p-1)%3=0 AS methylated
  FROM (SELECT chrom, seq, unnest(range(1,length(seq))) AS p FROM contig WHERE length(seq)>=2)
  WHERE substr(seq,p,2)='CG' AND (p-1)%3<2""")

# --- search -------------------------------------------------------------------------------------
cte("seed", ["pair_oligo"], f"""
  SELECT sequence, strand, t, length(t) AS n, off, substr(t,off+1,8) AS w FROM (
    SELECT sequence, strand, t, unnest(range(0,length(t)-7)) AS off FROM (
      SELECT sequence, '+' AS strand, sequence AS t FROM pair_oligo
      UNION ALL SELECT sequence, '-', {rc('sequence')} FROM pair_oligo))""")
# Contigs in pieces, only because SQL cuts short texts faster than long ones.
cte("piece", ["genome"], """
  SELECT row_number() OVER () AS pid, chrom, base, first, substr(seq,base+1,first-base+256+32) AS s FROM (
    SELECT chrom, seq, first, greatest(first-32,0) AS base FROM (SELECT chrom, seq, unnest(range(0,length(seq),256)) AS first FROM genome))""")
cte("place", ["piece"], """
  SELECT pid, p, substr(s,p-base,8) AS w FROM (
    SELECT pid, base, s, unnest(range(first+1,least(first+256,base+length(s)-7)+1)) AS p FROM piece)""")


def hits_for(seed: str) -> str:
    return f"""
  SELECT sequence, strand, chrom, start, n, hamming(t,here) AS mm, 100.0::DOUBLE*(n-hamming(t,here))/n AS pident,
         CASE WHEN strand='+' THEN start ELSE start+n-1 END AS sstart, CASE WHEN strand='+' THEN start+n-1 ELSE start END AS send,
         CASE WHEN strand='+' THEN here ELSE {rc('here')} END AS sseq
  FROM (SELECT DISTINCT x.sequence, x.strand, x.t, x.n, g.chrom, x.start, here FROM (
          SELECT s.sequence, s.strand, s.t, s.n, s.off, q.pid, q.p-s.off AS start FROM {seed} s JOIN place q USING (w)) x
        JOIN (SELECT pid, chrom, base, s FROM piece) g USING (pid), LATERAL (SELECT substr(g.s,x.start-g.base,x.n) AS here) h
        WHERE x.start>g.base AND length(here)=x.n AND hamming(x.t,here)*5<=x.n)"""


cte("hit_any", ["seed", "place", "piece"], hits_for("seed"))
for _profile, _identity, _length in (("strict", 80, 10), ("flags", 85, 12)):
    cte(f"hit_{_profile}", ["hit_any"], f"""
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pident DESC, chrom, start, strand) AS rnk FROM hit_any)
      WHERE rnk<=200 AND pident>={_identity} AND n>={_length}""")
cte("anchored", ["hit_strict"], "SELECT *, greatest(sstart,send) AS anchor, least(sstart,send) AS beg FROM hit_strict")
cte("anchored_flags", ["hit_flags"], "SELECT *, greatest(sstart,send) AS anchor, least(sstart,send) AS beg FROM hit_flags")
cte("upair", ["pair"], "SELECT DISTINCT f_seq, r_seq FROM pair")
cte("fr", ["upair", "anchored"], """
  SELECT f_seq, r_seq, 'FR' AS kind, 0 AS kind_order, f.chrom, size,
         f.anchor AS i_anchor, f.strand AS i_strand, f.beg AS i_begin, r.anchor AS j_anchor, r.strand AS j_strand, r.beg AS j_begin,
         'FR:'||f.chrom||':'||f.anchor||'('||f.strand||')-'||r.anchor||'('||r.strand||')('||size||'bp)' AS info
  FROM upair JOIN anchored f ON f.sequence=f_seq JOIN anchored r ON r.sequence=r_seq AND r.chrom=f.chrom AND r.strand<>f.strand,
       LATERAL (SELECT (abs(r.anchor-f.anchor)+1+length(f_seq)+length(r_seq))::INTEGER AS size) z
  WHERE ((f.strand='+' AND f.anchor<r.anchor) OR (f.strand='-' AND r.anchor<f.anchor)) AND size BETWEEN 50 AND 300""")
cte("fr_flags", ["upair", "anchored_flags"], """
  SELECT f_seq, r_seq, 'FR' AS kind, 0 AS kind_order, f.chrom, size,
         f.anchor AS i_anchor, f.strand AS i_strand, f.beg AS i_begin, r.anchor AS j_anchor, r.strand AS j_strand, r.beg AS j_begin,
         f.chrom||':'||f.anchor||'-'||r.anchor||'('||size||'bp)' AS info
  FROM upair JOIN anchored_flags f ON f.sequence=f_seq JOIN anchored_flags r ON r.sequence=r_seq AND r.chrom=f.chrom AND r.strand<>f.strand,
       LATERAL (SELECT (abs(r.anchor-f.anchor)+1)::INTEGER AS size) z
  WHERE size BETWEEN 50 AND 300""")
cte("numbered", ["anchored"], "SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY chrom, beg, strand) AS hit_no FROM anchored")
for _side, _seq, _order in (("F", "f_seq", 1), ("R", "r_seq", 2)):
    cte(f"self_{_side.lower()}", ["upair", "numbered"], f"""
      SELECT f_seq, r_seq, '{_side}-SELF' AS kind, {_order} AS kind_order, i.chrom, size,
             i.anchor AS i_anchor, i.strand AS i_strand, i.beg AS i_begin, j.anchor AS j_anchor, j.strand AS j_strand, j.beg AS j_begin,
             '{_side}-SELF:'||i.chrom||':'||i.anchor||'('||i.strand||')-'||j.anchor||'('||j.strand||')('||size||'bp)|pident='
             ||printf('%.1f',i.pident)||'/'||printf('%.1f',j.pident)||'|qseq='||{_seq}||'|sseq_i='||i.sseq||'|sseq_j='||j.sseq AS info
      FROM upair JOIN numbered i ON i.sequence={_seq} JOIN numbered j ON j.sequence=i.sequence AND j.chrom=i.chrom AND i.hit_no<j.hit_no AND i.strand<>j.strand,
           LATERAL (SELECT (abs(j.anchor-i.anchor)+1+2*length({_seq}))::INTEGER AS size) z
      WHERE ((i.strand='+' AND i.anchor<j.anchor) OR (i.strand='-' AND j.anchor<i.anchor)) AND size BETWEEN 50 AND 300""")
cte("amplicon_strict", ["fr", "self_f", "self_r"], "SELECT * FROM fr UNION ALL SELECT * FROM self_f UNION ALL SELECT * FROM self_r")
for _name, _src in (("strict", "amplicon_strict"), ("flags", "fr_flags")):
    cte(f"rollup_{_name}", [_src], f"""
      SELECT f_seq, r_seq, kind, kind_order, count(*) AS amplicons, min(size) AS min_size,
             string_agg(info,';' ORDER BY chrom,i_begin,i_strand,j_begin,j_strand,info) AS info
      FROM {_src} GROUP BY f_seq, r_seq, kind, kind_order""")
    cte(f"total_{_name}", [f"rollup_{_name}"], f"""
      SELECT f_seq, r_seq, sum(amplicons)::BIGINT AS amplicons, min(min_size) AS min_size, string_agg(info,';' ORDER BY kind_order) AS info
      FROM rollup_{_name} GROUP BY f_seq, r_seq""")
    cte(f"count_{_name}", ["pair_oligo", f"hit_{_name}"], f"""
      SELECT o.sequence, count(h.sequence) AS hits FROM pair_oligo o LEFT JOIN hit_{_name} h ON h.sequence=o.sequence GROUP BY o.sequence""")


# --- structures ---------------------------------------------------------------------------------
def stems(
    name: str, source: str, kind: str, deps: list[str], salt: str = LN_NA, all_strands: str = LN_C, quarter: str = LN_C4
) -> None:
    """Best stem per (x, y) of ``source`` by runs of paired cells."""
    hairpin = kind == "hairpin"
    loop = "AND 2*i<=length(x)+k-3" if hairpin else ""
    cte(f"{name}_cell", deps, f"""
      SELECT x, y, k, i, i-row_number() OVER (PARTITION BY x,y,k ORDER BY i) AS g FROM (
        SELECT x, y, yr, k, unnest(range(1,length(x)+1)) AS i FROM (
          SELECT x, y, {rc('y')} AS yr, unnest(range(1-length(y),length(x))) AS k FROM (SELECT DISTINCT x, y FROM ({source}))))
      WHERE i-k BETWEEN 1 AND length(y) AND substr(x,i::BIGINT,1)=substr(yr,(i-k)::BIGINT,1) {loop}""")
    (dh, ds), (eh, es) = steps("s"), ends("s")
    if hairpin:
        eh = es = "0"
    loop_cost = "-11.3::DOUBLE" if hairpin else ""
    strands = "0" if hairpin else (f"1.987::DOUBLE*({all_strands})::DOUBLE" if kind == "homodimer" else f"1.987::DOUBLE*({quarter})::DOUBLE")
    cte(f"{name}_best", [f"{name}_cell"], f"""
      SELECT x, y, dg, h/10.0::DOUBLE AS dh, e AS ds, 100.0::DOUBLE*h/(e+{strands})-273.15::DOUBLE AS tm FROM (
        SELECT *, row_number() OVER (PARTITION BY x,y ORDER BY floor(dg*1000000+0.5::DOUBLE), k, i) AS rnk FROM (
          SELECT *, h/10.0::DOUBLE-310.15::DOUBLE*e/1000.0::DOUBLE AS dg FROM (
            SELECT x, y, k, i, m, {dh}+{eh} AS h, ({ds}+{es})/10.0::DOUBLE+0.368::DOUBLE*(m-1)*({salt})::DOUBLE{loop_cost} AS e FROM (
              SELECT x, y, k, min(i) AS i, count(*) AS m, substr(x,min(i)::BIGINT,count(*)) AS s FROM {name}_cell GROUP BY x,y,k,g HAVING count(*)>=2))))
      WHERE rnk=1""")
    cte(name, [f"{name}_best", *deps], f"""
      SELECT p.x, p.y, coalesce(b.dg<0,false) AS found, CASE WHEN b.dg<0 THEN b.dg ELSE 0 END AS dg, CASE WHEN b.dg<0 THEN b.dh ELSE 0 END AS dh,
             CASE WHEN b.dg<0 THEN b.ds ELSE 0 END AS ds, CASE WHEN b.dg<0 THEN b.tm ELSE 0 END AS tm
      FROM (SELECT DISTINCT x, y FROM ({source})) p LEFT JOIN {name}_best b ON b.x=p.x AND b.y=p.y""")


stems("homo", "SELECT sequence AS x, sequence AS y FROM oligo", "homodimer", ["oligo"])
stems("hair", "SELECT sequence AS x, sequence AS y FROM oligo", "hairpin", ["oligo"])
stems("hetero", "SELECT f_seq AS x, r_seq AS y FROM pair", "heterodimer", ["pair"])
cte("thermo", ["oligo"], f"SELECT sequence, length(sequence) AS length, {tm('sequence')} AS tm, {gc_pct('sequence')} AS gc FROM oligo")

# Two mixtures in one table: the default one, which is not stated, and a richer one.
RICH = {"salt_monovalent_conc": 100.0, "salt_divalent_conc": 3.0, "dntp_conc": 0.2, "dna_conc": 250.0}
_RICH_LOGS = [repr(math.log(v)) for v in ((100.0 + 120.0 * math.sqrt(3.0 - 0.2)) / 1000.0, 250.0e-9, 250.0e-9 / 4.0)]
stems("homo_rich", "SELECT sequence AS x, sequence AS y FROM oligo", "homodimer", ["oligo"], *_RICH_LOGS)
stems("hair_rich", "SELECT sequence AS x, sequence AS y FROM oligo", "hairpin", ["oligo"], *_RICH_LOGS)
cte("reaction", ["oligo", "homo", "hair", "homo_rich", "hair_rich"], " UNION ALL ".join(
    f"""SELECT sequence, {mono}::DOUBLE AS salt_monovalent_conc, {div}::DOUBLE AS salt_divalent_conc, {dntp}::DOUBLE AS dntp_conc,
      {dna}::DOUBLE AS dna_conc, length(sequence)::INTEGER AS length, {melting} AS tm,
      length(regexp_replace(sequence,'[^GC]','','g'))*100.0::DOUBLE/length(sequence) AS gc_percent,
      h.found AS hairpin, h.tm AS hairpin_tm, h.dg AS hairpin_dg, h.dh AS hairpin_dh, h.ds/1000.0::DOUBLE AS hairpin_ds,
      o.found AS homodimer, o.tm AS homodimer_tm, o.dg AS homodimer_dg, o.dh AS homodimer_dh, o.ds/1000.0::DOUBLE AS homodimer_ds
      FROM oligo JOIN hair{mix} h ON h.x=sequence JOIN homo{mix} o ON o.x=sequence"""
    for mix, (mono, div, dntp, dna), melting in (
        ("", (50.0, 1.5, 0.6, 50.0), tm("sequence")), ("_rich", RICH.values(), tm("sequence", *_RICH_LOGS)),
    )))

# --- pair QC ------------------------------------------------------------------------------------
for _name in ("strict", "flags"):
    cte(f"qc_{_name}", ["pair", "thermo", "homo", "hair", "hetero", f"count_{_name}", f"total_{_name}"], f"""
      SELECT p.*, ft.tm AS f_tm, rt.tm AS r_tm, ft.gc AS f_gc, rt.gc AS r_gc,
             fh.dg AS f_hairpin_dg, rh.dg AS r_hairpin_dg, fh.tm AS f_hairpin_tm, rh.tm AS r_hairpin_tm,
             fo.dg AS f_homodimer_dg, ro.dg AS r_homodimer_dg, fo.tm AS f_homodimer_tm, ro.tm AS r_homodimer_tm,
             x.dg AS heterodimer_dg, x.tm AS heterodimer_tm, fc.hits AS f_hits, rc.hits AS r_hits,
             coalesce(t.amplicons,0) AS amplicons, t.min_size, coalesce(t.info,'') AS info
      FROM pair p JOIN thermo ft ON ft.sequence=p.f_seq JOIN thermo rt ON rt.sequence=p.r_seq
      JOIN hair fh ON fh.x=p.f_seq JOIN hair rh ON rh.x=p.r_seq JOIN homo fo ON fo.x=p.f_seq JOIN homo ro ON ro.x=p.r_seq
      JOIN hetero x ON x.x=p.f_seq AND x.y=p.r_seq
      JOIN count_{_name} fc ON fc.sequence=p.f_seq JOIN count_{_name} rc ON rc.sequence=p.r_seq
      LEFT JOIN total_{_name} t ON t.f_seq=p.f_seq AND t.r_seq=p.r_seq""")
    _g, _b = ("O", "X") if _name == "strict" else ("0", "x")
    cte(f"flag_{_name}", [f"qc_{_name}"], f"""
      SELECT *, CASE WHEN '{_b}' IN (qc_tm_range,qc_tm_diff,qc_hairpin,qc_homodimer,qc_heterodimer,qc_amplicon{'' if _name == 'strict' else ',qc_hit'}) THEN 'FAIL' ELSE 'PASS' END AS final_result
      FROM (SELECT *, CASE WHEN f_tm BETWEEN 55 AND 70 AND r_tm BETWEEN 55 AND 70 THEN '{_g}' ELSE '{_b}' END AS qc_tm_range,
        CASE WHEN abs(f_tm-r_tm)<=3 THEN '{_g}' ELSE '{_b}' END AS qc_tm_diff,
        CASE WHEN f_hairpin_dg>=-5 AND r_hairpin_dg>=-5 THEN '{_g}' ELSE '{_b}' END AS qc_hairpin,
        CASE WHEN f_homodimer_dg>=-6 AND r_homodimer_dg>=-6 THEN '{_g}' ELSE '{_b}' END AS qc_homodimer,
        CASE WHEN heterodimer_dg>=-6 THEN '{_g}' ELSE '{_b}' END AS qc_heterodimer,
        CASE WHEN f_hits<=1 AND r_hits<=1 THEN '{_g}' ELSE '{_b}' END AS qc_hit,
        CASE WHEN amplicons=0 THEN '{_g}' ELSE '{_b}' END AS qc_amplicon FROM qc_{_name})""")

# --- region design ------------------------------------------------------------------------------
cte("region", ["region_in"], """
  SELECT chrom||':'||"start"||'-'||"end" AS region_id, chrom, "start", "end", nullif(trim(name),'') AS name FROM region_in""")
cte("template", ["region", "contig"], """
  SELECT r.region_id, r.chrom, r.name, r."start" AS reg_start, r."end" AS reg_end, "end"-120 AS window_start, "start"+120 AS window_end, "start"-1-("end"-120) AS t_start, 120 AS t_end,
         substr(seq,"end"-120+1,"start"+120-("end"-120)) AS template,
         substr(seq,"end"-120+1,"start"+121-("end"-120)) AS template_plus
  FROM region r JOIN contig USING (chrom)""")


def tm_parts(dh: str, ds: str, s: str) -> str:
    eh, es = ends(s)
    self_ = f"{s}={rc(s)}"
    return (
        f"(({dh}+{eh})*100.0::DOUBLE/(({ds}+{es}+CASE WHEN {self_} THEN -14 ELSE 0 END)/10.0::DOUBLE"
        f"+0.368::DOUBLE*(length({s})-1)*({LN_NA})::DOUBLE"
        f"+1.987::DOUBLE*(CASE WHEN {self_} THEN ({LN_C})::DOUBLE ELSE ({LN_C4})::DOUBLE END))-273.15::DOUBLE)"
    )


def running(name: str, source: str, deps: list[str]) -> None:
    """Running sums of the steps along each template of ``source``, as lists."""
    def value(values: dict[str, int]) -> str:
        return "CASE substr(template,i::BIGINT,2) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"

    cte(name, deps, f"""
      SELECT region_id, [0]||list(ch ORDER BY i) AS lh, [0]||list(cs ORDER BY i) AS ls FROM (
        SELECT region_id, i, sum(h) OVER (PARTITION BY region_id ORDER BY i)::INTEGER AS ch, sum(s) OVER (PARTITION BY region_id ORDER BY i)::INTEGER AS cs FROM (
          SELECT region_id, i, {value(NN_DH)} AS h, {value(NN_DS)} AS s FROM (
            SELECT region_id, template, unnest(range(1,length(template))) AS i FROM {source})))
      GROUP BY region_id""")


def candidates(name: str, source: str, low: int, high: int, deps: list[str], where: str = "true", gc=(35, 65)) -> None:
    """Oligos of every template with gc and tm."""
    running(f"{name}_run", source, deps)
    cte(name, [*deps, f"{name}_run"], f"""
      SELECT region_id, t_start, t_end, start, len, s, gc, {tm_parts('lh[start+len]-lh[start+1]', 'ls[start+len]-ls[start+1]', 's')} AS tm FROM (
        SELECT *, {gc_pct('s')} AS gc FROM (
          SELECT region_id, t_start, t_end, start, len, substr(template,start+1,len) AS s FROM (
            SELECT *, unnest(range(0,length(template)-len+1)) AS start FROM (
              SELECT *, unnest(range({low},{high}+1)) AS len FROM {source}))
          WHERE {where})) JOIN {name}_run USING (region_id)
      WHERE gc BETWEEN {gc[0]} AND {gc[1]}""")


candidates("cand", "template", 20, 30, ["template"])
candidates("flank", "template", 20, 30, ["template"], "start+len<=t_start OR start>=t_end+1")
cte("primer", ["flank"], f"""
  SELECT region_id, CASE WHEN start+len<=t_start THEN 'left' ELSE 'right' END AS role, start, len, tm, gc,
         CASE WHEN start+len<=t_start THEN s ELSE {rc('s')} END AS sequence
  FROM flank WHERE tm BETWEEN 50 AND 70""")
candidates("probe_all", "template", 20, 30, ["template"], "start<=t_start AND start+len>=t_end")
cte("probe", ["probe_all"], "SELECT region_id, start, len, tm, gc, s AS sequence FROM probe_all WHERE tm BETWEEN 60 AND 65")
cte("all_pair", ["primer"], """
  SELECT l.region_id, l.start AS l_start, l.len AS l_len, l.tm AS l_tm, l.gc AS l_gc, l.sequence AS l_seq,
         r.start AS r_start, r.len AS r_len, r.tm AS r_tm, r.gc AS r_gc, r.sequence AS r_seq,
         (r.start+r.len-l.start)::INTEGER AS product_size, (abs(l.tm-60)+abs(l.len-25))+(abs(r.tm-60)+abs(r.len-25)) AS penalty
  FROM primer l JOIN primer r ON l.region_id=r.region_id AND l.role='left' AND r.role='right'
  WHERE r.start+r.len-l.start BETWEEN 80 AND 120 AND abs(l.tm-r.tm)<=2""")


def top_pairs(n: int) -> str:
    """Ranks of the best n pairs per region."""
    return f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY round(penalty,6), l_start, l_len, r_start, r_len) AS rank FROM all_pair)
  WHERE rank<={n}"""


cte("best_pair", ["all_pair"], top_pairs(100))
cte("best_row", ["best_pair", "template"], f"""
  SELECT p.*, t.template, t_start, t_end, substr(template,l_start+1,r_start+r_len-l_start) AS amplicon_sequence,
         (length(substr(template,l_start+1,l_len+1))-length(replace(substr(template,l_start+1,l_len+1),'CG','')))//2 AS f_cpg,
         (length(substr(template,r_start,r_len+1))-length(replace(substr(template,r_start,r_len+1),'CG','')))//2 AS r_cpg
  FROM best_pair p JOIN template t USING (region_id)""")
stems("best_homo", "SELECT l_seq AS x, l_seq AS y FROM best_pair UNION SELECT r_seq, r_seq FROM best_pair", "homodimer", ["best_pair"])
stems("best_hair", "SELECT l_seq AS x, l_seq AS y FROM best_pair UNION SELECT r_seq, r_seq FROM best_pair", "hairpin", ["best_pair"])
stems("best_hetero", "SELECT l_seq AS x, r_seq AS y FROM best_pair", "heterodimer", ["best_pair"])
cte("designed", ["best_row", "best_homo", "best_hair", "best_hetero"], """
  SELECT w.*, fh.dg AS f_hair_dg, fh.tm AS f_hair_tm, rh.dg AS r_hair_dg, rh.tm AS r_hair_tm, fo.dg AS f_homo_dg, ro.dg AS r_homo_dg,
         x.dg AS het_dg, x.tm AS het_tm,
         fh.tm<=47 AND rh.tm<=47 AND fh.dg>=-5 AND rh.dg>=-5 AND fo.dg>=-6 AND ro.dg>=-6 AND x.dg>=-6 AND x.tm<=45 AS selected
  FROM best_row w JOIN best_hair fh ON fh.x=l_seq JOIN best_hair rh ON rh.x=r_seq JOIN best_homo fo ON fo.x=l_seq JOIN best_homo ro ON ro.x=r_seq
  JOIN best_hetero x ON x.x=l_seq AND x.y=r_seq""")
cte("triple", ["probe", "flank"], f"""
  SELECT q.region_id, q.start AS p_start, q.len AS p_len, q.tm AS p_tm, q.sequence AS p_seq,
         l.start AS l_start, l.len AS l_len, l.s AS l_seq, r.start AS r_start, r.len AS r_len, {rc('r.s')} AS r_seq,
         (abs(l.tm-(q.tm-6))+abs(l.len-25))+(abs(r.tm-(q.tm-6))+abs(r.len-25)) AS penalty
  FROM probe q JOIN flank l ON l.region_id=q.region_id AND l.tm BETWEEN q.tm-8 AND q.tm-6 AND l.start+l.len<=q.start-1
  JOIN flank r ON r.region_id=q.region_id AND r.tm BETWEEN q.tm-8 AND q.tm-6 AND r.start>=q.start+q.len+1
  WHERE r.start+r.len-l.start BETWEEN 80 AND 120 AND abs(l.tm-r.tm)<=2""")

# --- scoring ------------------------------------------------------------------------------------
# Whole contigs: sums along each contig, read off ``len`` places further on, give every stretch its steps and its GC.
cte("score_text", ["contig"], """
  SELECT chrom, first//128 AS block, first, substr(seq,first+1,128+30) AS t FROM (SELECT chrom, seq, unnest(range(0,length(seq),128)) AS first FROM contig)""")
cte("score_base", ["score_text"], """
  SELECT chrom, first+j AS pos, substr(t,(j+1)::BIGINT,1) AS b, substr(t,(j+1)::BIGINT,2) AS d
  FROM (SELECT *, unnest(range(0,least(128,length(t)))) AS j FROM score_text)""")


def _value(values: dict[str, int]) -> str:
    return "CASE d " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


cte("score_sum", ["score_base"], f"""
  SELECT *, sum(h) OVER w::BIGINT AS ch, sum(e) OVER w::BIGINT AS ce, sum(g) OVER w::BIGINT AS cg
  FROM (SELECT chrom, pos, b, {_value(NN_DH)} AS h, {_value(NN_DS)} AS e, (b IN ('G','C'))::INTEGER AS g FROM score_base)
  WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING)""".replace("OVER w::BIGINT", "OVER w"))


def _ahead(name: str, less: int) -> str:
    return "[" + ",".join(f"lead({name},{n - less}) OVER w" for n in range(18, 31)) + "]"


_EDGE = "(CASE WHEN {0} IN ('A','T') THEN {1} ELSE {2} END)"
_DH = f"(h+{_EDGE.format('b', 23, 1)}+{_EDGE.format('z', 23, 1)})*100.0::DOUBLE"


def _melting(symmetry: int, strands: str) -> str:
    ds = f"(e+{_EDGE.format('b', 41, -28)}+{_EDGE.format('z', 41, -28)}+{symmetry})/10.0::DOUBLE"
    return f"({_DH}/({ds}+0.368::DOUBLE*(len-1)*({LN_NA})::DOUBLE+1.987::DOUBLE*({strands})::DOUBLE)-273.15::DOUBLE)"


cte("score_stretch", ["score_sum"], f"""
  SELECT chrom, pos AS start, len, {_melting(0, LN_C4)} AS tm, {_melting(-14, LN_C)} AS tm_self FROM (
    SELECT chrom, pos, b, len, hs[len-17]-ch+h AS h, es[len-17]-ce+e AS e, gs[len-17]-cg+g AS g, zs[len-17] AS z FROM (
      SELECT *, unnest(range(18,31)) AS len FROM (
        SELECT *, {_ahead('ch', 2)} AS hs, {_ahead('ce', 2)} AS es, {_ahead('cg', 1)} AS gs, {_ahead('b', 1)} AS zs
        FROM score_sum WINDOW w AS (PARTITION BY chrom ORDER BY pos)))
    WHERE zs[len-17] IS NOT NULL)
  WHERE g*100.0::DOUBLE/len BETWEEN 20 AND 80 AND (tm BETWEEN 57 AND 63 OR tm_self BETWEEN 57 AND 63)""")
cte("score_oligo", ["score_stretch", "score_text"], f"""
  SELECT *, abs(tm-60)+abs(len-22) AS pen, abs(tm-60)+abs(len-20) AS cost FROM (
    SELECT chrom, start, len, s, CASE WHEN s={rc('s')} THEN tm_self ELSE tm END AS tm FROM (
      SELECT q.*, substr(t,(start-first+1)::BIGINT,len::BIGINT) AS s FROM score_stretch q JOIN score_text x ON x.chrom=q.chrom AND x.block=q.start//128))
  WHERE tm BETWEEN 57 AND 63""")
# The cheapest probe of each start, for each length that it may have at most.
cte("score_probe", ["score_oligo"], """
  SELECT chrom, start, most, min(struct_pack(cost := round(cost,6), at := start, len := len, s := s)) AS best
  FROM (SELECT *, unnest(range(len,28)) AS most FROM score_oligo WHERE len<=27) GROUP BY chrom, start, most""")


# So many of the best oligos of a contig that ten pairs among them are likely.
cte("score_some", ["score_oligo", "contig"], """
  SELECT o.* FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pen) AS nth FROM score_oligo) o
  JOIN (SELECT chrom, 30+length(seq)//20 AS most FROM contig) USING (chrom) WHERE nth<=most""")


def score_pairs(source: str, limit: str = "") -> str:
    return f"""
  SELECT l.chrom, l.start AS l_start, l.len AS l_len, r.start AS r_start, r.len AS r_len, l.pen+r.pen AS penalty
  FROM (SELECT *, unnest(list_distinct([(start+80)//180,(start+180)//180])) AS zone FROM {source}) l
  JOIN (SELECT *, (start+len)//180 AS zone FROM {source}) r ON l.chrom=r.chrom AND l.zone=r.zone AND l.start+l.len<=r.start
       AND r.start+r.len-l.start BETWEEN 80 AND 180 {limit}"""


def scoring(mode: str) -> None:
    """Best ten pairs of each contig by penalty (with their cheapest probe), scored and ranked."""
    p = f"score_{mode}"

    def pairs_of(name: str, source: str, limit: str = "") -> None:
        """Pairs, in probe mode those with a probe between them: the cheapest of each gap."""
        cte(f"{name}_all", [source], score_pairs(source, limit))
        if mode == "primer":
            cte(name, [f"{name}_all"], f"SELECT *, NULL::VARCHAR AS p_seq FROM {name}_all")
            return
        cte(f"{name}_gap", [f"{name}_all", "score_probe"], f"""
          SELECT g.chrom, a, b, min(best).s AS p_seq FROM (
            SELECT *, unnest(range(a,b-17)) AS at FROM (SELECT DISTINCT chrom, l_start+l_len AS a, r_start AS b FROM {name}_all)) g
          JOIN score_probe q ON q.chrom=g.chrom AND q.start=g.at AND q.most=least(27,g.b-g.at) GROUP BY g.chrom, a, b""")
        cte(name, [f"{name}_all", f"{name}_gap"], f"""
          SELECT p.*, p_seq FROM {name}_all p JOIN {name}_gap g ON g.chrom=p.chrom AND g.a=p.l_start+p.l_len AND g.b=p.r_start""")

    # Ten pairs among the best oligos bound the tenth best of all; a contig without ten such pairs has no bound.
    pairs_of(f"{p}_some", "score_some")
    cte(f"{p}_bound", [f"{p}_some"], f"""
      SELECT chrom, penalty AS bound FROM (SELECT chrom, penalty, row_number() OVER (PARTITION BY chrom ORDER BY penalty) AS nth FROM {p}_some) WHERE nth=10""")
    cte(f"{p}_near", ["score_oligo", f"{p}_bound"], f"""
      SELECT o.*, coalesce(bound,1e9::DOUBLE)+0.001 AS bound FROM score_oligo o LEFT JOIN {p}_bound USING (chrom) WHERE pen<=coalesce(bound,1e9::DOUBLE)+0.001""")
    pairs_of(f"{p}_pair", f"{p}_near", "AND l.pen+r.pen<=l.bound")
    cte(f"{p}_best", [f"{p}_pair"], f"""
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY round(penalty,6), l_start, l_len, r_start, r_len) AS rank FROM {p}_pair) WHERE rank<=10""")
    cte(f"{p}_top", [f"{p}_best", f"{p}_near"], f"""
      SELECT b.*, l.s AS l_seq, {rc('r.s')} AS r_seq FROM {p}_best b
      JOIN {p}_near l ON l.chrom=b.chrom AND l.start=l_start AND l.len=l_len JOIN {p}_near r ON r.chrom=b.chrom AND r.start=r_start AND r.len=r_len""")
    cte(f"{p}_seq", [f"{p}_top"], f"""
      SELECT l_seq AS sequence FROM {p}_top UNION SELECT r_seq FROM {p}_top UNION SELECT p_seq FROM {p}_top WHERE p_seq IS NOT NULL""")
    cte(f"{p}_seed", [f"{p}_seq"], CTES["seed"][1].replace("pair_oligo", f"{p}_seq"))
    cte(f"{p}_hit", [f"{p}_seed", "place", "piece"], hits_for(f"{p}_seed"))
    cte(f"{p}_off", [f"{p}_seq", f"{p}_hit"], f"""
      SELECT o.sequence, greatest(count(h.sequence)-1,0) AS off FROM {p}_seq o LEFT JOIN {p}_hit h ON h.sequence=o.sequence GROUP BY o.sequence""")
    stems(f"homo_{p}", f"SELECT sequence AS x, sequence AS y FROM {p}_seq", "homodimer", [f"{p}_seq"])
    stems(f"hair_{p}", f"SELECT sequence AS x, sequence AS y FROM {p}_seq", "hairpin", [f"{p}_seq"])
    stems(f"hetero_{p}", f"SELECT l_seq AS x, r_seq AS y FROM {p}_top", "heterodimer", [f"{p}_top"])
    cte(f"ranked_{mode}", [f"{p}_top", f"{p}_off", f"homo_{p}", f"hair_{p}", f"hetero_{p}"], f"""
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY round(score,6), forward, reverse, probe NULLS FIRST) AS position FROM (
        SELECT p.chrom AS job_id, l_seq AS forward, r_seq AS reverse, p_seq AS probe, fo.off AS f_offtarget, ro.off AS r_offtarget,
               coalesce(po.off,0) AS probe_offtarget,
               (abs(fd.dg)+abs(fh.dg)+abs(rd.dg)+abs(rh.dg)+abs(x.dg))*1000.0::DOUBLE+3*fo.off+3*ro.off+5*coalesce(po.off,0) AS score
        FROM {p}_top p JOIN {p}_off fo ON fo.sequence=l_seq JOIN {p}_off ro ON ro.sequence=r_seq LEFT JOIN {p}_off po ON po.sequence=p_seq
        JOIN homo_{p} fd ON fd.x=l_seq JOIN homo_{p} rd ON rd.x=r_seq JOIN hair_{p} fh ON fh.x=l_seq JOIN hair_{p} rh ON rh.x=r_seq
        JOIN hetero_{p} x ON x.x=l_seq AND x.y=r_seq)""")


for _mode in ("primer", "probe"):
    scoring(_mode)
