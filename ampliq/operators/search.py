"""Off-target search for short oligos: seeds, ungapped extension, hit filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BASES
from ..functions.sequence import (
    MAX_CODED, PAIR_BITS, ambiguity_code, ambiguity_digits, base_code, base_digits, digits_to_code,
    low_mask, mismatch_bits, revcomp, shl, shr,
)
from ..joins import SALTS, code_ends, counted_lookup, once
from ..session import cut_lineage, scratch_path

WORD = 8
#: Seeds broadcast at once: packed ones take 4 or 8 bytes each (those of oligos with unclear letters some eight times that, so
#: fewer go at once), the rows of the way letter by letter twenty times that.
SEEDS_AT_ONCE, SEED_ROWS_AT_ONCE, UNCLEAR_SHARE = 3_000_000, 150_000, 8
#: Places whose bases are read together, and the bases on either side of a word that fit one number.
PLACES_AT_ONCE, MAX_AROUND = 16, 16


def oligo_seeds(oligos: DataFrame, word: int = WORD) -> DataFrame:
    """Every word of every distinct oligo and of its reverse complement, with its 0-based offset."""
    both = oligos.select("sequence").filter(F.length("sequence") >= word).distinct().select(
        "sequence", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand")
    )
    text = F.when(F.col("strand") == "+", F.col("sequence")).otherwise(revcomp(F.col("sequence")))
    seeds = both.select("sequence", "strand", text.alias("text"), F.length("sequence").alias("n")).select(
        "*", F.explode(F.expr(f"sequence(0, n - {word})")).alias("off")
    )
    piece = F.substring("text", F.col("off") + 1, F.lit(word))
    return seeds.filter(~piece.rlike("[^ACGT]")).withColumn("word", base_code(piece))


def _check_reach(tiles: DataFrame, before: int, behind: int) -> None:
    """Raise unless every tile holds that many bases on both sides of its core, or all there are in its contig."""
    core_end = F.col("tile_start") + F.col("core_len")
    seen = core_end + F.length("seq") - F.col("lead") - F.col("core_len")
    # One row per contig: where it ends, and the least end of a tile that sees less than it should.
    contig = tiles.groupBy("chrom").agg(
        F.max(core_end).alias("end"), F.min(F.when(seen < core_end + behind, seen)).alias("seen"),
        F.max(F.col("lead") < F.least(F.col("tile_start"), F.lit(before))).alias("short"),
    )
    if contig.filter("short or seen < end").take(1):
        raise ValueError(f"tiles need lead {before} and overlap {behind} for these oligos")


def seed_extend_hits(
    oligos: DataFrame, tiles: DataFrame, word: int = WORD, min_identity: float = 80.0, min_length: int = 10,
    max_length: int | None = None, broadcast_rows: int = SEEDS_AT_ONCE,
) -> DataFrame:
    """Hits of distinct oligos (column ``sequence``) on both strands of a tiled reference.

    A hit is a place where some ``word`` bases of the oligo match exactly and the whole ungapped oligo
    reaches the identity limit.  The reference is not shuffled: the seeds of oligos of up to 31 bases are packed, by word,
    into arrays of numbers and broadcast, ``broadcast_rows`` of them at most.  Beyond that the oligos are dealt into
    rounds of so many seeds, which are searched one after the other and written, so that neither the driver nor a task
    holds more however many oligos there are.  With ``broadcast_rows`` 0, and for many long oligos, both sides are
    joined on a salted word.  A place is found by several seeds; only its first one is kept, which
    is checked row by row, so no de-duplication shuffle follows.
    Tiles need a ``lead`` of the longest oligo less one word and an ``overlap`` of the longest oligo less one base;
    shorter ones would lose hits at the borders of tiles and are refused.
    """
    seeds = oligo_seeds(oligos, word)
    stats = seeds.agg(
        F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("n"), F.max(F.col("text").rlike("[^ACGT]")).alias("unclear"),
        F.min(F.col("text").rlike("[^ACGT]")).alias("all_unclear"),
    ).first()
    longest = max(max_length or stats["n"] or word, word)
    coded = longest <= MAX_CODED
    if stats["n"] and stats["least"] <= MAX_CODED < longest:
        # A few long oligos must not put all others on the way letter by letter.
        short = F.length("sequence") <= MAX_CODED
        parts = [
            seed_extend_hits(part, tiles, word, min_identity, min_length, None, broadcast_rows)
            for part in (oligos.filter(short), oligos.filter(~short))
        ]
        return parts[0].unionByName(parts[1])
    if coded and broadcast_rows and stats["unclear"] and not stats["all_unclear"]:
        # Nor a few unclear ones make records of all seeds.
        unclear = F.col("sequence").rlike("[^ACGT]")
        parts = [
            seed_extend_hits(part, tiles, word, min_identity, min_length, max_length, broadcast_rows)
            for part in (oligos.filter(~unclear), oligos.filter(unclear))
        ]
        return parts[0].unionByName(parts[1])
    reach = longest - word
    _check_reach(tiles, reach, longest - 1)
    if coded and broadcast_rows and 2 * reach + sum(_tag_bits(word, word, longest)) <= 64:
        limits = (word, min(stats["least"] or word, longest), longest, min_identity, min_length, bool(stats["unclear"]))
        at_once = max(broadcast_rows // UNCLEAR_SHARE, 1) if stats["unclear"] else broadcast_rows
        rounds = -(-stats["rows"] // at_once)
        if rounds < 2:
            return _packed_hits(seeds, tiles, *limits)
        oligos = cut_lineage(oligos.select("sequence").distinct())
        path = scratch_path(tiles.sparkSession, "hits")
        for nth in range(rounds):
            part = oligos.filter(F.pmod(F.xxhash64("sequence"), F.lit(rounds)) == nth)
            found = _packed_hits(oligo_seeds(part, word), tiles, *limits)
            found.write.mode("append").parquet(path)
        return tiles.sparkSession.read.schema(found.schema).parquet(path)

    at = F.col("lead") + F.col("i")
    coded_tiles = [
        base_digits(F.col("seq")).cast("binary").alias("_d"),
        ambiguity_digits(F.col("seq")).cast("binary").alias("_u"),
        F.col("seq").rlike("[^ACGT]").alias("_unclear"),
    ] if coded else []
    # Whole-tile work is done here, once per tile; what follows the generator is done once per base.
    places = tiles.select(
        "chrom", "tile_start", "lead", F.col("seq").cast("binary").alias("_b"), *coded_tiles,
        F.length("seq").alias("_len"), "core_len",
    )
    places = places.select("*", F.explode(F.sequence(F.lit(1), F.col("core_len"))).alias("i")).filter(
        at + word - 1 <= F.col("_len")
    )
    before = F.least(F.lit(reach), at - 1)

    def piece(column: str, start: Column, size: Column) -> Column:
        return F.substring(F.col(column), start.cast("int"), size.cast("int")).cast("string")

    def right_code(column: str) -> Column:
        return digits_to_code(F.rpad(piece(column, at, F.lit(longest)), longest, F.lit("0")))

    def left_code(column: str) -> Column:
        return digits_to_code(piece(column, at - before, before))

    zero = F.lit(0).cast("bigint")
    codes = {
        "rc": right_code("_d"), "lc": left_code("_d"),
        "rn": F.when(F.col("_unclear"), right_code("_u")).otherwise(zero),
        "ln": F.when(F.col("_unclear"), left_code("_u")).otherwise(zero),
    } if coded else {}
    places = once(
        places.select(
            "chrom", (F.col("tile_start") + F.col("i")).alias("p"), before.alias("nl"),
            F.least(F.lit(longest), F.col("_len") - at + 1).alias("nr"),
            piece("_b", at - before, before + longest).alias("ctx"),
            *[F.col(c) for c in ("lead", "i", "_d", "_u", "_unclear") if coded],
        ), **codes,
    ) if coded else places.select(
        "chrom", (F.col("tile_start") + F.col("i")).alias("p"), before.alias("nl"),
        F.least(F.lit(longest), F.col("_len") - at + 1).alias("nr"),
        piece("_b", at - before, before + longest).alias("ctx"),
    )
    if coded:
        beyond = F.lit(2 * (longest - word))
        places = places.filter(shr(F.col("rn"), beyond) == 0).withColumn("word", shr(F.col("rc"), beyond))
        places = places.drop("lead", "i", "_d", "_u", "_unclear")
        seeds = seeds.withColumns({"oc": base_code(F.col("text")), "on": ambiguity_code(F.col("text"))}).drop("text")
    else:
        first = F.substring("ctx", F.col("nl") + 1, F.lit(word))
        places = places.filter(~first.rlike("[^ACGT]")).withColumn("word", base_code(first))

    if stats["rows"] <= min(broadcast_rows, SEED_ROWS_AT_ONCE):
        met = places.join(F.broadcast(seeds), "word")
    else:
        salted = places.withColumn("_salt", F.pmod(F.col("p"), F.lit(SALTS)).cast("int"))
        copies = seeds.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.join(copies, ["word", "_salt"]).drop("_salt")

    # The oligo must lie inside the contig.
    met = met.filter("off <= nl and n - off <= nr")
    n, off = F.col("n"), F.col("off")
    if coded:
        def window(left: str, right: str) -> Column:
            head = shl(F.col(left).bitwiseAND(low_mask(off * 2)), (n - off) * 2)
            return head.bitwiseOR(shr(F.col(right), (F.lit(longest) - n + off) * 2))

        diff = window("lc", "rc").bitwiseXOR(F.col("oc"))
        bits = mismatch_bits(diff, window("ln", "rn").bitwiseOR(F.col("on")))
        mism = F.bit_count(bits)
        equal = F.bitwise_not(bits).bitwiseAND(F.lit(PAIR_BITS)).bitwiseAND(low_mask(n * 2))
        runs = F.lpad(F.conv(equal, 10, 4), n, F.lit("0"))
    else:
        here = F.substring("ctx", F.col("nl") - off + 1, n)
        met = once(met, _marks=F.expr(
            "array_join(zip_with(split(text, ''), split(here, ''), (a, b) -> "
            "if(a = b and a in ('A', 'C', 'G', 'T'), '1', '0')), '')".replace("here", "substr(ctx, nl - off + 1, n)")
        ))
        runs = F.col("_marks")
        mism = F.length(F.replace(runs, F.lit("1"), F.lit("")))
    pident = F.lit(100.0) * (n - mism) / n
    close = met.filter((pident >= min_identity) & (n >= min_length))
    # The first seed of a place is the one at the first run of ``word`` equal bases.
    kept = once(close, _first=F.instr(runs, F.lit("1" * word)), _mism=mism).filter(F.col("_first") == off + 1)
    mism = F.col("_mism")
    pident = F.lit(100.0) * (n - mism) / n
    found = F.substring("ctx", F.col("nl") - off + 1, n)
    start = F.col("p") - off
    plus = F.col("strand") == "+"
    return kept.select(
        "sequence", "chrom", "strand", start.cast("bigint").alias("start"),
        pident.alias("pident"), n.alias("length"), mism.cast("int").alias("mismatch"),
        F.lit(1).alias("qstart"), n.alias("qend"),
        F.when(plus, start).otherwise(start + n - 1).cast("bigint").alias("sstart"),
        F.when(plus, start + n - 1).otherwise(start).cast("bigint").alias("send"),
        F.lit(None).cast("double").alias("evalue"), F.lit(None).cast("double").alias("bitscore"),
        F.col("sequence").alias("qseq"),
        F.when(plus, found).otherwise(revcomp(found)).alias("sseq"),
    )


def _behind_word(n: Column, off: Column, word: int) -> Column:
    """Bits of the bases that follow the word."""
    return (n - off - word) * 2


def _without_word(code: Column, n: Column, off: Column, word: int) -> Column:
    """A code of ``n`` bases less the bases of the word, which are known."""
    behind = _behind_word(n, off, word)
    return shl(shr(code, behind + 2 * word), behind).bitwiseOR(code.bitwiseAND(low_mask(behind)))


def _with_word(rest: Column, here: Column, n: Column, off: Column, word: int) -> Column:
    """The reverse: ``here`` are the bits of the word."""
    behind = _behind_word(n, off, word)
    return shl(shr(rest, behind), behind + 2 * word).bitwiseOR(shl(here, behind)).bitwiseOR(rest.bitwiseAND(low_mask(behind)))


def _tag_bits(word: int, least: int, longest: int) -> tuple[int, int, int]:
    """Low bits of a packed seed: strand of its oligo, offset, and by how much the oligo is longer than the shortest."""
    return 1, (longest - word).bit_length(), (longest - least).bit_length()


def _packed_seeds(seeds: DataFrame, word: int, unclear: bool, least: int | None = None, longest: int = MAX_CODED) -> DataFrame:
    """One row per word with its seeds, each of them one number: the oligo's bases beside the word, then its length, offset
    and strand, in 4 bytes where all oligos (of ``least`` to ``longest`` bases) fit them.  Only if any oligo is unclear
    a seed is a record, with its unclear letters and the texts of those."""
    n, off, least = F.col("n"), F.col("off"), word if least is None else least
    tags = _tag_bits(word, least, longest)
    tag = F.shiftleft(n - least, sum(tags[:2])) + F.shiftleft("off", tags[0]) + F.when(F.col("strand") == "+", 0).otherwise(1)
    seed = shl(_without_word(base_code(F.col("text")), n, off, word), F.lit(sum(tags))).bitwiseOR(tag.cast("bigint"))
    # One bit less than an int has, so that no number is negative.
    if not unclear and 2 * (longest - word) + sum(tags) <= 31:
        seed = seed.cast("int")
    if unclear:
        seed = F.struct(
            seed.alias("_seed"), _without_word(ambiguity_code(F.col("text")), n, off, word).alias("on"),
            F.when(F.col("text").rlike("[^ACGT]"), F.col("text")).alias("text"))
    return seeds.groupBy("word").agg(F.collect_list(seed).alias("_seeds"))


def _coded_places(tiles: DataFrame, word: int, reach: int) -> DataFrame:
    """Every place of the tiles' cores with a clear word: the two-bit codes of the word, of the ``reach`` bases before it
    (``lc``) and behind it (``rc``), zeros beyond the tile; ``ln`` and ``rn`` mark unclear letters among them; ``nl`` and ``nr`` are
    the bases there are (at most ``reach``) before the word, and from its first base on (at most ``word + reach``).

    Letters are turned into numbers once for ``PLACES_AT_ONCE`` neighbouring places, which take theirs by a shift.
    """
    zero = F.lit(0).cast("bigint")
    many = max(1, min(PLACES_AT_ONCE, MAX_CODED + 1 - max(word, reach)))
    at = F.col("lead") + F.col("i")

    def padded(digits: Column) -> Column:
        # As if zeros stood before and behind the tile, so that all pieces are of one length.
        return F.concat(F.lit("0" * reach), digits, F.lit("0" * (word + reach + many))).cast("binary")

    unclear = F.col("seq").rlike("[^ACGT]")
    cut = tiles.select(
        "chrom", "tile_start", "lead", "core_len", F.col("seq").cast("binary").alias("_b"), F.length("seq").alias("_len"),
        padded(base_digits(F.col("seq"))).alias("_d"), unclear.alias("_unclear"), F.when(unclear, padded(ambiguity_digits(F.col("seq")))).alias("_u"),
    )
    blocks = cut.select("*", F.explode(F.expr(f"sequence(1, core_len, {many})")).alias("_from")).filter("_from <= core_len")

    def piece(column: str, skip: int, size: int) -> Column:
        cut = F.substring(F.col(column), F.col("lead") + F.col("_from") + skip, F.lit(size + many - 1))
        return digits_to_code(cut.cast("string")) if size else zero

    parts = {"l": (0, reach), "w": (reach, word), "r": (reach + word, reach)}
    codes = {f"_{name}": piece("_d", *where) for name, where in parts.items()}
    codes |= {f"_{name}u": F.coalesce(F.when(F.col("_unclear"), piece("_u", *where)), zero) for name, where in parts.items()}
    blocks = once(blocks.select("chrom", "tile_start", "lead", "core_len", "_b", "_len", "_d", "_u", "_unclear", "_from"), **codes)
    places = blocks.drop("_d", "_u").select(
        "*", F.explode(F.expr(f"sequence(0, least({many - 1}, core_len - _from))")).alias("_k")).withColumn("i", F.col("_from") + F.col("_k"))

    def part(name: str, size: int) -> Column:
        return shr(F.col(name), (F.lit(many - 1) - F.col("_k")) * 2).bitwiseAND(F.lit((1 << 2 * size) - 1).cast("bigint"))

    places = places.filter((at + word - 1 <= F.col("_len")) & (~F.col("_unclear") | (part("_wu", word) == 0)))
    return places.select(
        "chrom", "tile_start", "lead", "_b", "_unclear", "i", part("_w", word).alias("word"), part("_l", reach).alias("lc"), part("_r", reach).alias("rc"),
        part("_lu", reach).alias("ln"), part("_ru", reach).alias("rn"),
        F.least(F.lit(reach), at - 1).alias("nl"), F.least(F.lit(word + reach), F.col("_len") - at + 1).alias("nr"))


def _packed_hits(
    seeds: DataFrame, tiles: DataFrame, word: int, least: int, longest: int, min_identity: float, min_length: int, unclear: bool
) -> DataFrame:
    """Hits of oligos of up to 31 bases by bit operations; each seed is a few numbers of a broadcast array.

    What is done once a candidate is kept short and free of nulls, or its code would be too long to be compiled.
    """
    zero, reach = F.lit(0).cast("bigint"), longest - word
    at = F.col("lead") + F.col("i")
    whole = reach <= MAX_AROUND
    places = _coded_places(tiles, word, reach).select(
        "chrom", "tile_start", "lead", "_b", "_unclear", "i", "word", "lc", "rc", "ln", "rn", "nl", "nr")
    if whole:
        # What lies on both sides of the word is one number.
        def around(left: str, right: str) -> Column:
            return F.shiftleft(left, 2 * reach).bitwiseOR(F.col(right))

        places = once(places, _c=around("lc", "rc"), _u=around("ln", "rn")).drop("lc", "rc", "ln", "rn")
    met = places.join(F.broadcast(_packed_seeds(seeds, word, unclear, least, longest)), "word")
    met = met.select("*", F.inline("_seeds") if unclear else F.explode("_seeds").alias("_seed")).drop("_seeds")
    tags = _tag_bits(word, least, longest)
    kind = dict(met.dtypes)["_seed"]

    def field(nth: int) -> Column:
        mask = F.lit((1 << tags[nth]) - 1).cast(kind)
        return F.shiftright("_seed", sum(tags[:nth])).bitwiseAND(mask).cast("int")

    # Oligos of one length have it as a constant.
    n = field(2) + least if tags[2] else F.lit(longest)
    off, rest = field(1), F.shiftrightunsigned("_seed", sum(tags)).cast("bigint")

    if not whole:
        # The longer way needs them so often that they are worked out beforehand.
        met = once(met, _n0=n, _off0=off, _rest0=rest)
        n, off, rest = F.col("_n0"), F.col("_off0"), F.col("_rest0")

    def window(name: str) -> Column:
        """The place's bases that the oligo covers beside the word: what lies before it, moved up, and what follows."""
        if whole:
            up = F.shiftleft(off, 1) if not tags[2] else (F.lit(longest) - n + off) * 2
            return shr(F.col("_c" if name == "c" else "_u"), up).bitwiseAND(low_mask((n - word) * 2))
        behind = _behind_word(n, off, word)
        head = shl(F.col(f"l{name}").bitwiseAND(low_mask(off * 2)), behind)
        return head.bitwiseOR(shr(F.col(f"r{name}"), (F.lit(longest) - n + off) * 2).bitwiseAND(low_mask(behind)))

    # The oligo must lie inside the contig.
    inside = met.filter((off <= F.col("nl")) & (n - off <= F.col("nr")) & (n >= min_length))
    bad = window("n").bitwiseOR(F.col("on")) if unclear else window("n")
    # Most places have clear letters only, and most candidates fail here.
    bits = mismatch_bits(window("c").bitwiseXOR(rest), F.when(F.col("_unclear"), bad).otherwise(F.col("on") if unclear else zero))
    mism = F.bit_count(bits)
    if tags[2]:
        kept = inside.filter(F.lit(100.0) * (n - mism) / n >= min_identity)
    else:
        kept = inside.filter(mism <= max((m for m in range(longest + 1) if 100.0 * (longest - m) / longest >= min_identity), default=-1))
    kept = once(kept, _bits=_with_word(bits, zero, n, off, word), _n=n, _off=off)
    # A bit for each place with ``word`` equal bases in a row; the first seed is the one at the highest of them.
    n, off = F.col("_n"), F.col("_off")
    kept = once(kept, _runs=F.bitwise_not("_bits").bitwiseAND(F.lit(PAIR_BITS)).bitwiseAND(low_mask(n * 2)))
    have = 1
    while have < word:
        step = min(have, word - have)
        kept = once(kept, _runs2=F.col("_runs").bitwiseAND(F.shiftrightunsigned("_runs", 2 * step))).drop("_runs").withColumnRenamed("_runs2", "_runs")
        have += step
    kept = kept.filter(shr(F.col("_runs"), (n - word - off) * 2) == 1)
    # The JVM compiles no method of more than 8,000 bytes of code, so the candidates' ends here.
    kept = code_ends(kept.select(
        "chrom", (F.col("tile_start") + F.col("i") - off).cast("bigint").alias("start"), "word", rest.alias("_rest"), "_bits", "_n", "_off",
        (F.col("_seed").bitwiseAND(F.lit(1).cast(kind)) == 0).alias("_plus"), F.substring("_b", at - off, n).cast("string").alias("_found"),
        *(["text"] if unclear else [])), "start")
    kept = once(kept, _oc=_with_word(F.col("_rest"), F.col("word"), n, off, word))

    text = F.translate(F.lpad(F.conv("_oc", 10, 4), n, F.lit("0")), "0123", BASES)
    hits = once(kept, _text=F.coalesce("text", text) if unclear else text, _mism=F.bit_count("_bits"))
    plus, start, mism = F.col("_plus"), F.col("start"), F.col("_mism")
    sequence = F.when(plus, F.col("_text")).otherwise(revcomp(F.col("_text")))
    return hits.select(
        sequence.alias("sequence"), "chrom", F.when(plus, "+").otherwise("-").alias("strand"), "start",
        (F.lit(100.0) * (n - mism) / n).alias("pident"), n.alias("length"), mism.cast("int").alias("mismatch"),
        F.lit(1).alias("qstart"), n.alias("qend"),
        F.when(plus, start).otherwise(start + n - 1).cast("bigint").alias("sstart"),
        F.when(plus, start + n - 1).otherwise(start).cast("bigint").alias("send"),
        F.lit(None).cast("double").alias("evalue"), F.lit(None).cast("double").alias("bitscore"),
        sequence.alias("qseq"), F.when(plus, F.col("_found")).otherwise(revcomp(F.col("_found"))).alias("sseq"),
    )


def hit_filter(hits: DataFrame, min_identity: float, min_length: int) -> DataFrame:
    return hits.filter((F.col("pident") >= min_identity) & (F.col("length") >= min_length))


def hit_cap(hits: DataFrame, limit: int = 200, key: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """At most ``limit`` alignments per oligo, best first.

    Up to the limit that Spark's own optimizer takes (1,000), each task keeps only its best ``limit`` rows of an oligo before
    the exchange, so the last ranking meets at most that many of each.  For higher ones an oligo's hits are first ranked
    in ``SALTS`` parts by place and cut there.
    """
    order = [F.desc("pident"), "chrom", "start", "strand"]
    part = F.pmod(F.xxhash64("chrom", "start"), F.lit(SALTS))
    for parts in ([part], []) if limit > 1000 else ([],):
        rank = F.row_number().over(W.partitionBy(*key, *parts).orderBy(*order))
        hits = hits.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")
    return hits


def known_query_semi(hits: DataFrame, oligos: DataFrame, key: str = "sequence") -> DataFrame:
    """Hits whose query is one of the oligos."""
    return counted_lookup(hits, oligos.select(key).distinct(), [key], "left_semi")


def hit_counts(hits: DataFrame, oligos: DataFrame, key: str = "sequence") -> DataFrame:
    """Hits per distinct oligo, zero when there are none."""
    counted = hits.groupBy(key).agg(F.count("*").alias("hits"))
    return oligos.select(key).distinct().join(counted, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def offtarget_counts(hits: DataFrame, oligos: DataFrame, key: str = "sequence") -> DataFrame:
    """Hits beyond the intended one."""
    counted = hit_counts(hits, oligos, key)
    return counted.select(key, F.greatest(F.col("hits") - 1, F.lit(0)).alias("offtargets"))
