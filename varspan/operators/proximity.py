"""Joins by distance: breakpoints near breakends, insertions near duplications, calls near truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.functions.alleles import length_similarity
from varspan.functions.info import set_info_field
from varspan.functions.similarity import edit_distance_within, edits_allowed, may_be_similar, own_sequence
from varspan.operators.intervals import overlap_join
from varspan.operators.rewrite import chromosome_number


def points(df: DataFrame, chrom: str, pos: str, keep: list[str]) -> DataFrame:
    """Points as intervals of one base."""
    return df.select(F.col(chrom).alias("chrom"), F.col(pos).alias("start"), (F.col(pos) + 1).alias("end"), *keep)


def near(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """Pairs of points (chrom, start, end of one base) at most distance apart."""
    return overlap_join(a, b, slack=distance, longest=(1, 1))


def close_pairs(df: DataFrame, distance: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (columns a_* and b_*) of points of one table, at most distance apart and alike in the columns `also`; in both orders, and
    each with itself. As near(df, df, distance), but rows are shuffled once: both sides of the join ask for the same exchange."""
    width = 1 << (8 * distance).bit_length()
    own, last = F.floor(F.col("start") / width), F.floor((F.col("start") + distance) / width)
    keyed = df.where("chrom is not null and start is not null").withColumn("_own", own).withColumn("_bin", F.explode(F.sequence(own, last)))
    a, b = (keyed.select(*[F.col(c).alias(f"{side}_{c}") for c in keyed.columns]).hint("merge") for side in "ab")
    pairs = a.join(b, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*also, "chrom", "_bin")])
    # a pair meets in the bin of the later one, and perhaps in the next: it counts where one of both is at home
    close = (F.abs(F.col("a_start") - F.col("b_start")) <= distance) & (F.col("a__bin") == F.greatest("a__own", "b__own"))
    return pairs.where(close).select(*[f"{side}_{c}" for side in "ab" for c in df.columns])


def ends_near(bnd: DataFrame, breakpoints: DataFrame, distance: int, both: bool, key: str = "id") -> DataFrame:
    """Breakends (key, chrom, pos, other_chrom, other_pos) of which one end, or both, lies near a breakpoint."""
    ends = points(bnd, "chrom", "pos", [key]).withColumn("side", F.lit(1)).unionByName(
        points(bnd, "other_chrom", "other_pos", [key]).withColumn("side", F.lit(2))
    )
    hit = near(ends, points(breakpoints, "chrom", "pos", []), distance).groupBy(F.col(f"a_{key}").alias(key)).agg(F.count_distinct("a_side").alias("sides"))
    return bnd.join(hit.where(F.col("sides") >= (2 if both else 1)), key, "left_semi")


def two_ended(bnd: DataFrame, breakpoints: DataFrame, distance: int, key: str = "id") -> DataFrame:
    """key, type of the best breakpoint of each breakend that has one. A breakpoint that agrees on the mate too beats
    one that is near one end; the record's own order beats the swapped one; then the nearest, and the least type."""
    straight = bnd.select(key, "chrom", "pos", "other_chrom", "other_pos", F.lit(0).alias("swapped"))
    swapped = bnd.select(key, F.col("other_chrom").alias("chrom"), F.col("other_pos").alias("pos"), F.col("chrom").alias("other_chrom"), F.col("pos").alias("other_pos"), F.lit(1).alias("swapped"))
    pairs = near(
        points(straight.unionByName(swapped), "chrom", "pos", [key, "other_chrom", "other_pos", "swapped"]),
        points(breakpoints, "chrom", "pos", ["other_chrom", "other_pos", "type"]),
        distance,
    )
    mate = (F.col("a_other_chrom") == F.col("b_other_chrom")) & (F.abs(F.col("a_other_pos") - F.col("b_other_pos")) <= distance)
    ranked = pairs.where(mate | (F.col("b_other_pos") == -1)).withColumn("two", mate.cast("int"))
    best = F.min_by(
        F.struct(F.col("b_type").alias("type"), F.col("two").alias("two")),
        F.struct(-F.col("two"), "a_swapped", F.abs(F.col("a_start") - F.col("b_start")), "b_type", "b_start"),
    )
    return ranked.groupBy(F.col(f"a_{key}").alias(key)).agg(best.alias("best")).select(key, "best.type", "best.two")


def inside_similar(ins: DataFrame, dup: DataFrame, similarity: float, slack: int) -> DataFrame:
    """Pairs (i_id, d_id) of insertions inside duplications (with slack) of similar length. Both: id, chrom, pos, svlen."""
    spans = dup.select("id", "chrom", (F.col("pos") - slack).alias("start"), (F.col("pos") + F.col("svlen") + slack + 1).alias("end"), "svlen")
    at = points(ins, "chrom", "pos", ["id", "svlen"])
    pairs = overlap_join(at, spans, longest=(1, None))
    return pairs.where(length_similarity(F.col("a_svlen"), F.col("b_svlen")) >= similarity).select(F.col("a_id").alias("i_id"), F.col("b_id").alias("d_id"))


def single_matches(pairs: DataFrame, side: str) -> DataFrame:
    """The ids of one side with exactly one partner."""
    return pairs.groupBy(side).agg(F.count("*").alias("n")).where("n = 1").select(side)


def first_gap(ins: DataFrame, gaps: DataFrame, slack: int, ratio: float) -> DataFrame:
    """For each insertion the first gap from slack before its start to slack behind its end (both included) whose length the
    insertion's covers by ratio: id, start, end."""
    pairs = overlap_join(points(ins, "chrom", "pos", ["id", "svlen"]), gaps.select("chrom", "start", "end"), slack + 1, longest=(1, None))
    near_gap = F.col("a_start").between(F.col("b_start") - slack, F.col("b_end") + slack)
    good = pairs.where(near_gap & (F.col("a_svlen") >= ratio * (F.col("b_end") - F.col("b_start"))))
    return good.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("b_start", "b_end")).alias("g")).select("id", F.col("g.b_start").alias("start"), F.col("g.b_end").alias("end"))


def gaps_to_duplications(ins: DataFrame, gaps: DataFrame, slack: int, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(duplications, insertions): insertions (chrom, pos, id, alt, qual, info; svlen) that first_gap finds a gap for become the
    gap's duplication, and remember in INFO what they were; the others stay. Contigs that are no standard chromosomes have no gaps."""
    own = gaps.where(chromosome_number(F.col("chrom")).isNotNull())
    found = first_gap(ins, own, slack, ratio).select("id", F.col("start").alias("_start"), F.col("end").alias("_end"))
    info = F.col("info")
    for field, value in (("SVLEN", (F.col("_end") - F.col("_start")).cast("string")), ("SVTYPE", F.lit("DUP")), ("END", F.col("_end").cast("string"))):
        info = set_info_field(info, field, value)
    kept = F.concat(info, F.lit(";INS_POS="), F.col("pos").cast("string"), F.lit(";INS_ALT="), "alt", F.lit(";INS_QUAL="), F.coalesce(F.col("qual").cast("string"), F.lit(".")))
    dups = ins.join(found, "id").withColumns({"info": kept, "pos": F.col("_start"), "alt": F.lit("<DUP>"), "svlen": F.col("_end") - F.col("_start")})
    return dups.select(*ins.columns), ins.join(found, "id", "left_anti")


def truth_candidates(
    base: DataFrame, comp: DataFrame, distance: int, size: float, sequence: float | None = None, overlap: float = 0.0, both_ends: bool = False
) -> DataFrame:
    """Pairs of like type that start within distance and have similar lengths: base_id, comp_id, score, dstart, dend.

    both_ends: the ends (pos + svlen) lie within distance too. overlap: of the longer footprint, the share that both cover is
    at least that. sequence: the alleles' sequences, of any length, are similar by edit distance (records without a
    sequence on either side are judged by length alone); ref and alt must be there then. score is the length similarity."""
    keep = ["id", "svtype", "svlen"]
    seq = [own_sequence(F.col("ref"), F.col("alt")).alias("seq")] if sequence else []
    sides = [points(df.select("chrom", "pos", *keep, *seq), "chrom", "pos", keep + ["seq"] * bool(sequence)) for df in (base, comp)]
    pairs = overlap_join(*sides, slack=distance, also=("svtype",), longest=(1, 1))
    sim = length_similarity(F.col("a_svlen"), F.col("b_svlen"))
    dstart = F.abs(F.col("a_start") - F.col("b_start"))
    a_end, b_end = (F.col(f"{x}_start") + F.col(f"{x}_svlen") for x in "ab")
    good = pairs.where(sim >= size)
    if both_ends:
        good = good.where(F.abs(a_end - b_end) <= distance)
    if overlap:
        shared = F.least(a_end, b_end) - F.greatest("a_start", "b_start")
        good = good.where(shared >= overlap * F.greatest("a_svlen", "b_svlen"))
    if sequence:
        good = with_similar_sequences(good, sequence)
    return good.select(F.col("a_id").alias("base_id"), F.col("b_id").alias("comp_id"), sim.alias("score"), dstart.alias("dstart"), F.abs(a_end - b_end).alias("dend"))


def with_similar_sequences(pairs: DataFrame, sequence: float) -> DataFrame:
    """The pairs (a_seq, b_seq) whose sequences are similar, and those that lack one. Pairs are computed once, and only what lengths
    and letters leave open goes to Python with its sequences."""
    a, b = F.col("a_seq"), F.col("b_seq")
    easy, limit = F.coalesce(a == b, F.lit(True)), edits_allowed(a, b, sequence)
    hard = ~easy & may_be_similar(a, b, sequence)
    edits = edit_distance_within(F.when(hard, a), F.when(hard, b), limit)
    return pairs.withColumn("_edits", edits).where(easy | (F.col("_edits") <= limit)).drop("_edits")


def match_multi(base: DataFrame, comp: DataFrame, candidates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """side, id, the columns keep, and state: tp where any candidate names it, else fn (base) or fp (comp). Candidates are computed once."""
    named = [F.struct(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id")) for side in ("base", "comp")]
    hit = candidates.select(F.inline(F.array(*named))).distinct().withColumn("tp", F.lit(1))
    both = base.select(F.lit("base").alias("side"), "id", *keep).unionByName(comp.select(F.lit("comp").alias("side"), "id", *keep))
    miss = F.when(F.col("side") == "base", "fn").otherwise("fp")
    return both.join(hit, ["side", "id"], "left").select("side", "id", *keep, F.when(F.col("tp") == 1, "tp").otherwise(miss).alias("state"))


def _twins(candidates: DataFrame, side: str, other: str) -> DataFrame:
    """side_id, side_class, side_rank: ids with the same candidates form a class (its least id), ranked by id within it."""
    links = F.struct(F.col(f"{other}_id"), "score", "dstart", "dend")
    same = candidates.groupBy(f"{side}_id").agg(F.sort_array(F.collect_list(links)).alias("links"))
    w = Window.partitionBy(F.sha2(F.to_json(F.struct("links")), 256)).orderBy(f"{side}_id")
    return same.select(f"{side}_id", F.first(f"{side}_id").over(w).alias(f"{side}_class"), F.row_number().over(w).alias(f"{side}_rank"))


def match_single(candidates: DataFrame, materialize) -> DataFrame:
    """One-to-one pairs by greedy choice: a pair that is best for both its ends is taken, its ends leave, and again, until
    no pair is left. Raises where a pair without identifiers could never be taken.

    That is the sequential greedy by (score, nearness, ids), run in rounds over all pairs at once; ties are broken by
    identifiers, so the result is unique. Ends with the same candidates tie as a block: where two blocks have no best
    candidate but each other, their ends are paired in the order of ids in one round. materialize(df) returns df as a
    table (it cuts the plan between rounds).
    """
    if not candidates.where("base_id is null or comp_id is null").isEmpty():
        raise ValueError("candidates without identifier")
    classed = candidates.join(_twins(candidates, "base", "comp"), "base_id").join(_twins(candidates, "comp", "base"), "comp_id")
    left, taken, rounds = materialize(classed), None, 0
    while not left.isEmpty():
        level = F.struct(-F.col("score"), "dstart", "dend")
        best = left.withColumn("level", level).withColumn("rank", F.struct("level", "base_id", "comp_id"))
        for side, other in (("base", "comp"), ("comp", "base")):
            w = Window.partitionBy(f"{side}_id")
            best = best.withColumns({f"{side}_level": F.min("level").over(w), f"{side}_best": F.min("rank").over(w)})
            top = F.when(F.col("level") == F.col(f"{side}_level"), F.col(f"{other}_class"))
            best = best.withColumn(f"{side}_one", F.min(top).over(w) == F.max(top).over(w))
        best = best.withColumn("block", F.expr("level = base_level and level = comp_level and base_one and comp_one"))
        for side in ("base", "comp"):  # the place of an end among those left of its block
            best = best.withColumn(f"{side}_at", F.dense_rank().over(Window.partitionBy("base_class", "comp_class", "block").orderBy(f"{side}_rank")))
        mutual = materialize(best.where("(block and base_at = comp_at) or (rank = base_best and rank = comp_best)").select(*candidates.columns))
        taken = mutual if taken is None else taken.unionByName(mutual)
        rounds += 1
        if rounds % 20 == 0:
            taken = materialize(taken)
        left = materialize(left.join(mutual.select("base_id"), "base_id", "left_anti").join(mutual.select("comp_id"), "comp_id", "left_anti"))
    return candidates.limit(0) if taken is None else taken


def close_breakpoints(matches: DataFrame, distance: int) -> DataFrame:
    return matches.where(F.abs("dstart").between(0, distance) & F.abs("dend").between(0, distance))


def shared_clips(left: DataFrame, right: DataFrame, slack: int) -> DataFrame:
    """Per record, reads clipped at both breakpoints, and those whose clips are adjacent or spaced within slack in read
    coordinates. Both: record_id, read_id, is_rc, read_pos, read_len. Read positions are turned to the read's strand."""

    def turned(df: DataFrame, side: str) -> DataFrame:
        at = F.when(F.col("is_rc"), F.col("read_len") - F.col("read_pos")).otherwise(F.col("read_pos"))
        return df.select("record_id", "read_id", at.alias(f"{side}_at"))

    both = turned(left, "l").join(turned(right, "r"), ["record_id", "read_id"])
    close = F.abs(F.col("l_at") - F.col("r_at")) <= slack
    return both.groupBy("record_id").agg(F.count_distinct("read_id").alias("reads"), F.count_distinct(F.when(close, F.col("read_id"))).alias("close_reads"))


def nearest_rank(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
