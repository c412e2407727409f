"""Gaps and islands over ordered records, runs of equal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.operators.filters import standard_chromosome
from varspan.operators.scan import BLOCK, carried, previous_value, running_sum, with_carry


def islands(df: DataFrame, first: str, last: str, buffer: int, order: list[str]) -> DataFrame:
    """df with island: a number within chrom that grows where first lies beyond all earlier lasts by over buffer.

    Both scans run over the same blocks, so rows are dealt to them once. What blocks carry over is a row for a million
    positions, and is broadcast."""
    reached = carried(df, ["chrom"], first, F.col(last), "max")
    w = Window.partitionBy("chrom", "_block").orderBy(F.asc_nulls_last(first), *order)
    reach = F.greatest(F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    tagged = reached.withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col(first) > F.col("_reach") + buffer)).cast("int"))
    tagged = tagged.withColumn("_here", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_carry")
    numbered = with_carry(tagged, ["chrom"], F.col("_new"), "sum")
    return numbered.withColumn("island", F.coalesce("_carry", F.lit(0)) + F.col("_here")).drop("_block", "_carry", "_reach", "_new", "_here")


def island_totals(tagged: DataFrame, first: str, last: str) -> DataFrame:
    return tagged.groupBy("chrom", "island").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.count("*").alias("n"))


def label_runs(df: DataFrame, part: list[str], order: list[str], label: str, value: str, block: int = BLOCK) -> DataFrame:
    """Runs of equal labels in order: part, label, run, first, last (least and greatest value), n. In two levels, by blocks
    `block` wide of the first order column (a number), so a part may hold any share of the rows."""
    before = previous_value(df, part, order[0], order[1:], label, "_last", block)
    new = (F.col("_last_first") | ~F.col(label).eqNullSafe(F.col("_last"))).cast("int")
    tagged = running_sum(before, part, order[0], order[1:], new, "run", block)
    return tagged.groupBy(*part, label, "run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def composite_variants(df: DataFrame, part: list[str], gap: int, least: int) -> DataFrame:
    """Per haplotype, runs of at least `least` alternative calls with gaps of at most `gap` (columns start, end, id); a run's
    key is its members' ids in order: part, key, n. part holds one haplotype of one sample, so groups stay small."""
    w = Window.partitionBy(*part).orderBy("start", "end", "id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach + gap)).cast("int")
    tagged = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = tagged.groupBy(*part, "run").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id"))).alias("m"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= least).select(*part, F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("key"), "n")


def isolated_ends(df: DataFrame, distance: int) -> DataFrame:
    """Clip ends (read_id, first, last) far from every earlier last and every later first of their read."""
    w = Window.partitionBy("read_id").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("first").over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({"start_alone": F.coalesce(F.col("first") - before > distance, F.lit(True)), "end_alone": F.coalesce(after - F.col("last") > distance, F.lit(True))})


def concordance(df: DataFrame, distance: int) -> DataFrame:
    """Alignments of a read (read_id, read_first, read_last, chrom, strand), with class: 0 on the read's modal contig and strand
    and near both neighbours, 1 modal but far from one, 2 modal contig only, 3 elsewhere. Distances are between the places
    in the read; a neighbour on another contig or strand is not far. Ties of the mode go to the least name; reads whose modal
    contig is no standard chromosome are left out."""
    counts = df.groupBy("read_id", "chrom", "strand").agg(F.count("*").alias("n"))
    modal = counts.groupBy("read_id").agg(F.min_by(F.struct("chrom", "strand"), F.struct(-F.col("n"), "chrom", "strand")).alias("m"))
    w = Window.partitionBy("read_id").orderBy("read_first", "read_last", "chrom")

    def far(step, gap: Column) -> Column:
        same = step("chrom").over(w).eqNullSafe(F.col("chrom")) & step("strand").over(w).eqNullSafe(F.col("strand"))
        return F.coalesce(same & (F.abs(gap) > distance), F.lit(False))

    before, after = F.col("read_first") - F.lag("read_last").over(w), F.lead("read_first").over(w) - F.col("read_last")
    out = df.join(modal.where(standard_chromosome(F.col("m.chrom"))), "read_id").withColumn("far", far(F.lag, before) | far(F.lead, after))
    same_chrom, same = F.col("chrom") == F.col("m.chrom"), F.col("strand") == F.col("m.strand")
    return out.withColumn("class", F.when(~same_chrom, 3).when(~same, 2).when(F.col("far"), 1).otherwise(0)).drop("m", "far")


def neighbours(df: DataFrame, distance: int, block: int = 1 << 16) -> DataFrame:
    """df (chrom, pos) with n_neighbours: other records within distance. Positions are counted first, and each block of
    positions gets those of a distance around it, so windows hold a block and not a contig."""
    counts = df.groupBy("chrom", "pos").agg(F.count("*").alias("_n"))
    spread = counts.withColumn("_block", F.explode(F.sequence(F.floor((F.col("pos") - distance) / block), F.floor((F.col("pos") + distance) / block))))
    w = Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-distance, distance)
    around = spread.withColumn("_around", F.sum("_n").over(w)).where(F.floor(F.col("pos") / block) == F.col("_block")).select("chrom", "pos", "_around")
    return df.join(around, ["chrom", "pos"]).withColumn("n_neighbours", F.col("_around") - 1).drop("_around")


def depth_steps(
    depth: DataFrame, bases: int, ratio: float, top: int, least_step: float, least_median: float, known: DataFrame | None = None, tolerance: int = 0
) -> DataFrame:
    """The longest interval between a step up and a later step down of the depth, in each window: window, up_pos, down_pos,
    median. depth: window, pos (each once, without holes), depth.

    A step is where the mean depths of `bases` positions on both sides differ by `ratio` or more, the lower one at least
    least_step; the `top` steps of each kind by ratio are tried (all, if not more). An interval's upper median must reach
    least_median, and the lower of its two outer means times the ratio. Intervals whose both ends lie within `tolerance` of a
    known one's (window, start, end) are left out. A step up is at the last position before it and a step down at the first one
    behind it, but at the window's first and last place of a step it is inside. Of equal lengths the better steps come first."""
    w = Window.partitionBy("window").orderBy("pos")
    mean = lambda a, b: F.avg("depth").over(w.rowsBetween(a, b))
    whole = Window.partitionBy("window")
    sided = depth.withColumns({"l": mean(-bases, -1), "r": mean(0, bases - 1), "seen": F.count("*").over(w.rowsBetween(-bases, bases - 1))})
    sided = sided.withColumns({"i": F.col("pos") - F.min("pos").over(whole), "n": F.count("*").over(whole)}).where(F.col("seen") == 2 * bases)
    up = F.when(F.col("i") == bases, F.col("pos")).otherwise(F.col("pos") - 1)
    down = F.when(F.col("i") == F.col("n") - bases, F.col("pos") - 1).otherwise(F.col("pos"))
    steps = []
    for side, place, low, high, turn in (("up", up, "l", "r", F.col("pos")), ("down", down, "r", "l", -F.col("pos"))):
        score = F.try_divide(F.col(high), F.col(low))
        found = sided.where((F.col(low) >= least_step) & (score >= ratio)).withColumns({"score": score, "many": F.count("*").over(whole) > top})
        ranked = found.withColumn("k", F.row_number().over(whole.orderBy(F.when(F.col("many"), -F.col("score")), turn))).where(F.col("k") <= top)
        steps.append(ranked.select("window", place.alias(f"{side}_pos"), F.col(low).alias(f"{side}_low"), F.col("k").alias(f"{side}_k")))
    pairs = steps[0].join(steps[1], "window").where("up_pos < down_pos")
    if known is not None:
        close = (F.col("up_pos") - F.col("start")).between(-tolerance, tolerance) & (F.col("down_pos") - F.col("end")).between(-tolerance, tolerance)
        known = known.select(F.col("window").alias("_w"), "start", "end")
        pairs = pairs.join(known, (F.col("window") == F.col("_w")) & close, "left_anti")
    ends = ["window", "up_pos", "down_pos"]
    spans = pairs.select(*ends).distinct()
    inside = spans.join(depth, "window").where("pos between up_pos and down_pos").groupBy(*ends).agg(F.sort_array(F.collect_list("depth")).alias("d"))
    medians = inside.select(*ends, F.element_at("d", F.expr("cast(size(d) div 2 as int) + 1")).alias("median"))
    good = (F.col("median") >= least_median) & (F.col("median") >= F.least("up_low", "down_low") * ratio)
    best = F.min_by(F.struct("up_pos", "down_pos", "median"), F.struct(F.col("up_pos") - F.col("down_pos"), "up_k", "down_k"))
    judged = pairs.join(medians, ends).where(good).groupBy("window").agg(best.alias("b"))
    return judged.select("window", "b.up_pos", "b.down_pos", "b.median")
