"""Candidate oligos, primer pairs and probe sets for many regions in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import DESIGN_DEFAULTS
from ..functions.sequence import (
    MAX_CODED, amplicon_sequence, count_in, cpg_count, non_cpg_c_count, revcomp,
)
from ..functions.thermo import drop_masks, masked_gc_count, with_base_masks, with_masked_tm, with_melting_temperature
from ..joins import counted_lookup, once, shuffled, spread
from ..session import cut_lineage
from .bounds import Cells, sure_bounds
from .stretches import MAX_SUMMED, placed_stretches, scored_stretches


def param_defaults(requests: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Requested values where given, configured ones elsewhere, one column per parameter."""
    values = DESIGN_DEFAULTS if defaults is None else defaults
    kept = [c for c in requests.columns if c not in values]
    filled = [
        (F.coalesce(F.col(name), F.lit(v)) if name in requests.columns else F.lit(v)).alias(name)
        for name, v in values.items()
    ]
    return requests.select(*kept, *filled)


_TEMPLATE = ["region_id", "template", "target_start_index", "target_end_index"]


def _places(templates: DataFrame, min_length: int, max_length: int, flanking: bool) -> DataFrame:
    """All clean stretches of each template: (region_id, start, len, plus), the target, and the two-bit code of short ones."""
    placed = placed_stretches(
        templates, ["region_id"], min_length, max_length, "0", f"_n - {min_length}", ("target_start_index", "target_end_index"))
    return placed.filter(before_target() | after_target()) if flanking else placed


def oligo_candidates(
    templates: DataFrame, min_length: int, max_length: int, roles: tuple[str, ...] = ("left", "right"),
) -> DataFrame:
    """All oligos of each template: (region_id, role, start, len, sequence), without ambiguous bases; short ones with
    the two-bit code of their place, from which ``with_tm_gc`` takes both, as they are the same on either strand."""
    rows = _places(templates, min_length, max_length, False)
    return _oriented(rows.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles]))))


def _oriented(rows: DataFrame) -> DataFrame:
    text = F.when(F.col("role") == "right", revcomp(F.col("plus"))).otherwise(F.col("plus"))
    scores = [c for c in ("gc", "tm", "_code") if c in rows.columns]
    return rows.select("region_id", "role", "start", "len", text.alias("sequence"), *scores)


def before_target() -> Column:
    return F.col("start") + F.col("len") <= F.col("target_start_index")


def after_target() -> Column:
    return F.col("start") >= F.col("target_end_index") + 1


def with_tm_gc(oligos: DataFrame, max_length: int, min_gc: float = 0.0, max_gc: float = 100.0, text: str = "sequence") -> DataFrame:
    """Add gc and tm to clean oligos; the cheap GC limit is applied before the costlier temperature."""
    if max_length <= MAX_CODED:
        masked = with_base_masks(oligos, text)
        some = once(masked, gc=masked_gc_count() * F.lit(100.0) / F.length(text)).filter(F.col("gc").between(min_gc, max_gc))
        return drop_masks(with_masked_tm(some, text))
    gc = (count_in(F.col(text), "G") + count_in(F.col(text), "C")) * F.lit(100.0) / F.length(text)
    return with_melting_temperature(once(oligos, gc=gc).filter(F.col("gc").between(min_gc, max_gc)), text)


def oligo_filter(
    oligos: DataFrame, min_length: int, max_length: int, min_tm: float, max_tm: float, min_gc: float, max_gc: float
) -> DataFrame:
    return oligos.filter(
        F.col("len").between(min_length, max_length) & F.col("tm").between(min_tm, max_tm)
        & F.col("gc").between(min_gc, max_gc)
    )


def primer_candidates(templates: DataFrame, p: dict, tm_range: tuple[float, float] | None = None) -> DataFrame:
    """Primers that flank the target and pass the filters.

    Temperature and GC are the same on both strands, so they are worked out on the template's own strand and
    only what passes is turned round.
    """
    lo, hi = tm_range or (p["primer_min_tm"], p["primer_max_tm"])
    sizes = p["primer_min_length"], p["primer_max_length"]
    limits = p["primer_min_gc"], p["primer_max_gc"]
    if sizes[1] <= MAX_SUMMED:
        kept = scored_stretches(
            templates, ["region_id"], *sizes, (lo, hi), limits, ("target_start_index", "target_end_index"), before_target() | after_target())
        return _oriented(kept.withColumn("role", F.when(before_target(), "left").otherwise("right")))
    scored = with_tm_gc(_places(templates, *sizes, True), sizes[1], *limits, text="plus")
    kept = oligo_filter(scored, *sizes, lo, hi, *limits)
    return _oriented(kept.withColumn("role", F.when(before_target(), "left").otherwise("right")))


def any_primers(templates: DataFrame, sizes: tuple[int, int], tm: tuple[float, float], gc: tuple[float, float]) -> DataFrame:
    """Primers of templates without a target: every stretch that passes, in both roles."""
    scored = with_tm_gc(_places(templates, *sizes, False), sizes[1], *gc, text="plus")
    kept = oligo_filter(scored, *sizes, *tm, *gc)
    return _oriented(kept.withColumn("role", F.explode(F.array(F.lit("left"), F.lit("right")))))


def probe_covers_target(start: Column, length: Column) -> Column:
    return (start <= F.col("target_start_index")) & (start + length >= F.col("target_end_index"))


def probe_candidates(templates: DataFrame, p: dict) -> DataFrame:
    """Probes that cover the target and pass the filters."""
    shortest, longest = p["probe_min_length"], p["probe_max_length"]
    placed = placed_stretches(
        templates, ["region_id"], shortest, longest, f"greatest(0, target_end_index - {longest})",
        f"least(target_start_index, _n - {shortest})", ("target_start_index", "target_end_index"))
    clean = placed.filter(probe_covers_target(F.col("start"), F.col("len"))).withColumnRenamed("plus", "sequence").drop(
        "target_start_index", "target_end_index")
    return oligo_filter(
        with_tm_gc(clean, p["probe_max_length"], p["probe_min_gc"], p["probe_max_gc"]), p["probe_min_length"], p["probe_max_length"],
        p["probe_min_tm"], p["probe_max_tm"], p["probe_min_gc"], p["probe_max_gc"],
    )


def _penalty(tm: Column, length: Column, opt_tm: Column, opt_length: int) -> Column:
    return F.abs(tm - opt_tm) + F.abs(length - opt_length)


def _side(oligos: DataFrame, role: str, prefix: str) -> DataFrame:
    return oligos.filter(F.col("role") == role).select(
        "region_id", F.col("start").alias(f"{prefix}start"), F.col("len").alias(f"{prefix}len"),
        F.col("tm").alias(f"{prefix}tm"), F.col("gc").alias(f"{prefix}gc"), F.col("sequence").alias(f"{prefix}seq"),
        *[c for c in ("bound", "longest") if role == "left" and c in oligos.columns],
    )


def pair_candidates(
    primers: DataFrame, min_product: int, max_product: int, max_tm_difference: float = 2.0,
    opt_tm: float = 60.0, opt_length: int = 25, one_target: bool = True,
) -> DataFrame:
    """Left and right primers of a region that make a product of allowed size at like temperatures.

    Both range conditions become equi-join keys: the temperature is binned by the allowed difference and
    the product end by the longest product, so a group stays bounded however long a template is.
    Where the primers bring a ``bound``, only pairs whose penalty lies within it are made (null: all); where they
    bring ``longest``, only products of at most that size.
    """
    step = float(max_tm_difference) or 1.0
    tm_bin = F.floor(F.col("l_tm") / step).cast("int")
    left = _side(primers, "left", "l_").withColumn("tm_bin", F.explode(F.array(tm_bin - 1, tm_bin, tm_bin + 1)))
    right = _side(primers, "right", "r_").withColumn("tm_bin", F.floor(F.col("r_tm") / step).cast("int"))
    keys = ["region_id", "tm_bin"]
    if not one_target:
        keys.append("end_bin")
        first, last = f"(l_start + {min_product}) div {max_product}", f"(l_start + {max_product}) div {max_product}"
        left = left.withColumn("end_bin", F.explode(F.sequence(F.expr(first), F.expr(last))))
        right = right.withColumn("end_bin", F.expr(f"(r_start + r_len) div {max_product}"))
    size = F.col("r_start") + F.col("r_len") - F.col("l_start")
    met = left.join(shuffled(right), keys).filter(
        size.between(min_product, max_product) & (F.abs(F.col("l_tm") - F.col("r_tm")) <= max_tm_difference)
        & (F.col("l_start") + F.col("l_len") <= F.col("r_start"))
    )
    if "longest" in met.columns:
        met = met.filter(F.col("longest").isNull() | (size <= F.col("longest"))).drop("longest")
    optimum = F.lit(float(opt_tm))
    cost = _penalty(F.col("l_tm"), F.col("l_len"), optimum, opt_length) + _penalty(
        F.col("r_tm"), F.col("r_len"), optimum, opt_length)
    if "bound" in met.columns:
        met = met.filter(F.col("bound").isNull() | (cost <= F.col("bound") + F.lit(1e-6))).drop("bound")
    return met.drop("tm_bin", "end_bin").withColumns({"product_size": size.cast("int"), "penalty": cost})


def with_longest(
    primers: DataFrame, n: int, min_product: int, max_product: int, max_tm_difference: float = 2.0
) -> DataFrame:
    """Add ``longest``, a product size within which a region surely has ``n`` pairs; null where counts prove none.

    Primers are counted by start or end and temperature bin.  Temperatures in one bin differ by less than allowed, so
    counts of a start and an end multiply to pairs that surely exist; their running sum by size gives the limit.
    """
    if max_tm_difference <= 0:
        return primers.withColumn("longest", F.lit(None).cast("int"))
    binned = primers.withColumn("_bin", F.floor(F.col("tm") / float(max_tm_difference)))

    def counted(role: str, at: Column, name: str) -> DataFrame:
        return binned.filter(F.col("role") == role).groupBy("region_id", "_bin", at.alias(name)).agg(
            F.count(F.lit(1)).alias(f"n_{name}"), F.max("len").alias(f"len_{name}"))

    size = F.col("end") - F.col("begin")
    met = counted("left", F.col("start"), "begin").join(
        counted("right", F.col("start") + F.col("len"), "end"), ["region_id", "_bin"]
    ).filter(size.between(min_product, max_product) & (F.col("len_begin") + F.col("len_end") <= size))
    sums = met.groupBy("region_id", size.cast("int").alias("size")).agg(F.sum(F.col("n_begin") * F.col("n_end")).alias("pairs"))
    upto = F.sum("pairs").over(W.partitionBy("region_id").orderBy("size"))
    limits = sums.withColumn("upto", upto).filter(F.col("upto") >= n).groupBy("region_id").agg(F.min("size").alias("longest"))
    return counted_lookup(primers, cut_lineage(limits), ["region_id"])


def probe_primer_join(probes: DataFrame, primers: DataFrame, p: dict, min_product: int, max_product: int) -> DataFrame:
    """Primer pairs for every probe: cooler than the probe by the wanted difference and clear of it.

    Temperatures are binned as in ``pair_candidates``; both primers lie in the probe's band, so their own
    difference needs no further rule when the band is not wider than the allowed one.
    """
    near, far = p["min_primer_probe_tm_diff"], p["max_primer_probe_tm_diff"]
    step = float(far - near) or 1.0
    cut = probes.select(
        "region_id", F.col("start").alias("p_start"), F.col("len").alias("p_len"), F.col("tm").alias("p_tm"),
        F.col("gc").alias("p_gc"), F.col("sequence").alias("p_seq"),
    )
    bands = F.sequence(
        F.floor((F.col("p_tm") - far) / step).cast("int"), F.floor((F.col("p_tm") - near) / step).cast("int"))

    def binned(role: str, prefix: str) -> DataFrame:
        return shuffled(_side(primers, role, prefix).withColumn("tm_bin", F.floor(F.col(f"{prefix}tm") / step).cast("int")))

    def in_band(tm: Column) -> Column:
        return tm.between(F.col("p_tm") - far, F.col("p_tm") - near)

    lefts = cut.withColumn("tm_bin", F.explode(bands)).join(binned("left", "l_"), ["region_id", "tm_bin"]).filter(
        in_band(F.col("l_tm")) & (F.col("l_start") + F.col("l_len") <= F.col("p_start") - 1)
    ).drop("tm_bin")
    size = F.col("r_start") + F.col("r_len") - F.col("l_start")
    met = lefts.withColumn("tm_bin", F.explode(bands)).join(binned("right", "r_"), ["region_id", "tm_bin"]).filter(
        in_band(F.col("r_tm")) & (F.col("r_start") >= F.col("p_start") + F.col("p_len") + 1)
        & size.between(min_product, max_product)
        & (F.abs(F.col("l_tm") - F.col("r_tm")) <= p["max_tm_difference"])
    ).drop("tm_bin")
    optimum = F.col("p_tm") - near
    cost = _penalty(F.col("l_tm"), F.col("l_len"), optimum, p["primer_opt_length"]) + _penalty(
        F.col("r_tm"), F.col("r_len"), optimum, p["primer_opt_length"])
    return met.withColumns({"product_size": size.cast("int"), "penalty": cost})


PAIR_ORDER = ["l_start", "l_len", "r_start", "r_len"]


def pair_topn(pairs: DataFrame, n: int, keys: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Best ``n`` pairs per region (or per region and probe) with their rank.

    Spark keeps only the best ``n`` of each partition before the shuffle, so a region with very many pairs
    does not gather them in one task.
    """
    order = W.partitionBy(*keys).orderBy(F.round("penalty", 6), *PAIR_ORDER)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def bounded_pairs(
    primers: DataFrame, n: int, min_product: int, max_product: int, max_tm_difference: float, opt_tm: float, opt_length: int,
) -> DataFrame:
    """The same rows as ``pair_topn`` over all pairs of targeted regions, without making all pairs.

    Primers are worked out once and written.  Counts of primers per place, temperature and penalty prove a penalty
    within which a region has ``n`` pairs; both primers of a pair lie within the pair's penalty, so only those are
    joined.  Regions in which the counts prove nothing have all their pairs made.
    """
    cost = _penalty(F.col("tm"), F.col("len"), F.lit(float(opt_tm)), opt_length)
    primers = cut_lineage(primers.withColumn("cost", cost))
    step = float(max_tm_difference) or 1.0
    # Temperatures in one bin differ by less than its width.
    sides = primers.withColumns({"tm_bin": F.floor(F.col("tm") / step).cast("int"), "end": F.col("start") + F.col("len")})
    cells, keys = Cells.of(min_product, max_product), ["region_id", "tm_bin"]
    if max_tm_difference <= 0 or not cells.apart:
        return pair_topn(pair_candidates(primers, min_product, max_product, max_tm_difference, opt_tm, opt_length), n)
    bounds = cut_lineage(sure_bounds(
        sides.filter("role = 'left'"), sides.filter("role = 'right'"), cells, n, ["region_id"], keys, "start", "end", "cost", 1.0, 12))
    # The bound goes along with the left primer, so that no pair is looked up, and none beyond it is made.
    near = counted_lookup(primers, bounds, ["region_id"]).filter("bound is null or cost <= bound + 1e-6")
    return pair_topn(pair_candidates(near, min_product, max_product, max_tm_difference, opt_tm, opt_length), n)


def probe_topn(probes: DataFrame, n: int, opt_tm: float, opt_length: int) -> DataFrame:
    cost = _penalty(F.col("tm"), F.col("len"), F.lit(float(opt_tm)), opt_length)
    order = W.partitionBy("region_id").orderBy(F.round(cost, 6), "start", "len")
    return probes.withColumn("probe_rank", F.row_number().over(order)).filter(F.col("probe_rank") <= n)


def probe_primer_append(with_probe: DataFrame, without_probe: DataFrame | None = None) -> DataFrame:
    """Amplicons of all probes, and of the regions designed without one, in one list."""
    if without_probe is None:
        return with_probe
    return with_probe.unionByName(without_probe, allowMissingColumns=True)


def returned_counts(
    lefts: DataFrame, rights: DataFrame, probes: DataFrame, pairs: DataFrame, key: str = "region_id"
) -> DataFrame:
    """Left, right, probe and pair candidates per region, and their maximum."""
    kinds = {"n_left": lefts, "n_right": rights, "n_probe": probes, "n_pair": pairs}
    # Each kind is counted where it is; only the counts are brought together.
    counted = [
        df.groupBy(key).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, df in kinds.items()
    ]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in kinds]
    out = rows.groupBy(key).agg(*sums)
    return out.withColumn("n_designed", F.greatest(*kinds))


def amplicon_row(
    pairs: DataFrame, templates: DataFrame, catalog: DataFrame | None = None
) -> DataFrame:
    """The wide row of a designed amplicon: template, target, and each oligo under its prefix.

    Probe columns are always there, null without a probe.
    """
    extra = [c for c in ("reference_template",) if c in templates.columns]
    joined = pairs.join(templates.select(*_TEMPLATE, *extra), "region_id")
    reference = F.col("reference_template") if extra else F.col("template")
    has_probe = "p_seq" in pairs.columns
    out = {
        "region_id": F.col("region_id"), "rank": F.col("rank"),
        "reference_template_sequence": reference, "template_sequence": F.col("template"),
        "target_start_index": F.col("target_start_index"), "target_end_index": F.col("target_end_index"),
    }
    if "probe_rank" in pairs.columns:
        out["probe_rank"] = F.col("probe_rank")
    r_end = F.col("r_start") + F.col("r_len") - 1
    out["amplicon_sequence"] = amplicon_sequence(F.col("template"), F.col("l_start"), r_end)
    out["amplicon_length"] = F.length(out["amplicon_sequence"])
    for name, prefix, strand in (("forward", "l_", "forward"), ("reverse", "r_", "reverse"), ("probe", "p_", "forward")):
        there = name != "probe" or has_probe
        start = F.col(f"{prefix}start") if there else F.lit(None).cast("int")
        length = F.col(f"{prefix}len") if there else F.lit(None).cast("int")
        end = start + length - 1
        out |= {
            f"{name}_sequence": F.col(f"{prefix}seq") if there else F.lit(None).cast("string"),
            f"{name}_strand": F.when(start.isNotNull(), F.lit(strand)),
            f"{name}_length": length, f"{name}_start_index": start, f"{name}_end_index": end,
            f"{name}_tm": F.col(f"{prefix}tm") if there else F.lit(None).cast("double"),
            f"{name}_gc_percent": F.col(f"{prefix}gc") if there else F.lit(None).cast("double"),
            f"{name}_cpg_count": F.when(start.isNotNull(), cpg_count(reference, F.lit(strand), start, end)),
            f"{name}_non_cpg_c_count": F.when(start.isNotNull(), non_cpg_c_count(reference, F.lit(strand), start, end)),
        }
    out["penalty"] = F.col("penalty")
    wide = joined.select(*[v.alias(k) for k, v in out.items()])
    return wide if catalog is None else with_structures(wide, catalog, has_probe)


def with_structures(wide: DataFrame, catalog: DataFrame, has_probe: bool) -> DataFrame:
    """Add hairpin and homodimer records of each oligo from a catalog of distinct oligos."""
    names = [c for c in catalog.columns if c.startswith(("hairpin", "homodimer"))]
    catalog = cut_lineage(catalog)
    for side in ("forward", "reverse", *(["probe"] if has_probe else [])):
        table = catalog.select(
            F.col("sequence").alias(f"{side}_sequence"), *[F.col(c).alias(f"{side}_{c}") for c in names])
        wide = counted_lookup(wide, table, [f"{side}_sequence"])
    return wide


def cpg_range(count: Column, low: int, high: int) -> Column:
    return count.between(low, high)
