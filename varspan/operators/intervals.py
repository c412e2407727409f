"""Interval joins and interval algebra. Intervals are (chrom, start, end), 0-based half-open.

The join cuts intervals into bins, joins on (chrom, level, bin) and reports a pair only in the later of its two first
bins, so no pair comes twice and no distinct is needed. Long intervals would fill many narrow bins, so intervals get a
level by length, whose bins (BIN * STEP^level wide) are as long as they are or longer: two bins at most. A pair is
found at the higher level of the two: its longer interval is binned at its own level alone, the shorter one at those
levels from its own up that the other side has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.operators.scan import running_max_before, running_sum

#: Width of the narrowest bins, and by how much each level widens them.
BIN, STEP, LEVELS = 1 << 12, 8, 5


def _level(start: Column, end: Column) -> Column:
    length = F.greatest(end - start, F.lit(1))
    case = F.when(length <= BIN, 0)
    for level in range(1, LEVELS):
        case = case.when(length <= BIN * STEP**level, level)
    return case.otherwise(LEVELS)


def _binned(df: DataFrame, side: str, levels) -> DataFrame:
    """Rows with <side>_key (chrom, level, bin) and <side>_first, the first bin, at each of levels(own level)."""
    start, end = F.col(f"{side}_start"), F.col(f"{side}_end")
    df = df.withColumn("_level", F.explode(levels(_level(start, end))))
    width = F.call_function("shiftleft", F.lit(BIN).cast("long"), (F.col("_level") * 3).cast("int"))
    first, last = F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)
    keyed = df.withColumn(f"{side}_first", first).withColumn(f"{side}_bin", F.explode(F.sequence(first, last)))
    return keyed.withColumnRenamed("_level", f"{side}_level")


def _meet(x: DataFrame, y: DataFrame, also: tuple[str, ...]) -> DataFrame:
    # rows grow by their bins, which size estimates of the tables don't see: a broadcast by these would not fit the driver
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in also]
    same += [F.col("a_chrom") == F.col("b_chrom"), F.col("a_level") == F.col("b_level"), F.col("a_bin") == F.col("b_bin")]
    pairs = x.hint("merge").join(y.hint("merge"), same)
    return pairs.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("a_bin") == F.greatest("a_first", "b_first")))


def _levels(df: DataFrame, side: str, longest: int | None) -> list[int]:
    """The levels that a side's intervals have; of intervals up to a known length, all that they may have."""
    if longest is not None:
        return [level for level in range(LEVELS + 1) if level == 0 or longest > BIN * STEP ** (level - 1)]
    return sorted(r[0] for r in df.select(_level(F.col(f"{side}_start"), F.col(f"{side}_end"))).distinct().collect())


def overlap_join(a: DataFrame, b: DataFrame, slack: int = 0, also: tuple[str, ...] = (), longest: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Pairs of rows of a and b (columns a_* and b_*; each with chrom, start, end) that share a base, or lie within
    slack bases, and agree on the columns `also`, which are keys of the join. Empty intervals overlap what holds their
    point inside. Rows with a null bound match nothing.

    Rows go only to the levels that the other side has. longest: the greatest length there is in a and in b, if it is known
    (1 for points); if not, one pass over that side finds its levels before the join."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).where("a_chrom is not null and a_start is not null and a_end is not null")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).where("b_chrom is not null and b_start is not null and b_end is not null")
    if slack:
        right = right.withColumns({"b_start": F.col("b_start") - slack, "b_end": F.col("b_end") + slack})
    in_a, in_b = _levels(left, "a", longest[0]), _levels(right, "b", None if longest[1] is None else longest[1] + 2 * slack)

    def own(level: Column) -> Column:
        return F.array(level)

    def of(levels: list[int], least: int):
        return lambda level: F.filter(F.array(*map(F.lit, levels)), lambda x: x >= level + least)

    parts = [_meet(_binned(left, "a", own), _binned(right, "b", of(in_a, 0)), also)] if in_a and in_b else []
    if in_a and in_b and in_b[-1] > in_a[0]:
        parts.append(_meet(_binned(left, "a", of(in_b, 1)), _binned(right, "b", own), also))
    if not parts:  # one side has no rows
        parts = [left.join(right, F.lit(False))]
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if slack:
        pairs = pairs.withColumns({"b_start": F.col("b_start") + slack, "b_end": F.col("b_end") - slack})
    return pairs.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns])


def overlap_length() -> Column:
    """Bases that a pair of overlap_join shares."""
    return F.least("a_end", "b_end") - F.greatest("a_start", "b_start")


def in_track(a: DataFrame, track: DataFrame, key: str, flag: str, least_share: float = 0.0) -> DataFrame:
    """a with flag 1 where a row overlaps the track (by least_share of its own length at least), else 0.

    key identifies rows of a; the track's pairs are reduced to one row a key before they meet a again."""
    pairs = overlap_join(a.select(key, "chrom", "start", "end"), track.select("chrom", "start", "end"))
    if least_share:
        pairs = pairs.where(overlap_length() >= least_share * (F.col("a_end") - F.col("a_start")))
    hit = pairs.groupBy(F.col(f"a_{key}").alias(key)).agg(F.lit(1).alias(flag))
    return a.join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def restrict(df: DataFrame, regions: DataFrame, key: str, mode: str) -> DataFrame:
    """Rows (with first, last, pos: 1-based inclusive footprint and position) in the regions. mode: 'pos' by position,
    'record' by any base of the footprint, 'targets' as 'pos' (a full scan instead of an index, the same rows)."""
    start, end = (F.col("first") - 1, F.col("last")) if mode == "record" else (F.col("pos") - 1, F.col("pos"))
    spans = df.select(key, "chrom", start.alias("start"), end.alias("end"))
    hit = overlap_join(spans, regions.select("chrom", "start", "end")).select(F.col(f"a_{key}").alias(key)).distinct()
    return df.join(hit, key, "left_semi")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The shared piece of every overlapping pair."""
    return overlap_join(a.select("chrom", "start", "end"), b.select("chrom", "start", "end")).select(
        F.col("a_chrom").alias("chrom"), F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end")
    )


def merge(df: DataFrame, distance: int = 0) -> DataFrame:
    """Islands of intervals that overlap, touch, or lie within distance: chrom, start, end, n."""
    before = running_max_before(df.select("chrom", "start", "end"), ["chrom"], "start", ["end"], F.col("end"), "_reach")
    new = (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + distance)).cast("int")
    tagged = running_sum(before.withColumn("_new", new), ["chrom"], "start", ["end"], F.col("_new"), "_island")
    return tagged.groupBy("chrom", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def slop(df: DataFrame, contigs: DataFrame, bases: int) -> DataFrame:
    """Intervals wider by `bases` on both sides, clamped to the contig."""
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    return df.join(sizes, "chrom").withColumns({"start": F.greatest(F.col("start") - bases, F.lit(0)), "end": F.least(F.col("end") + bases, F.col("_length"))}).drop("_length")


def complement(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """The gaps between the merged intervals, and to the contigs' ends. Islands are few, so one window a contig will do."""
    islands = merge(df).select("chrom", "start", "end")
    edges = contigs.select("chrom", F.lit(0).alias("start"), F.lit(0).alias("end")).unionByName(
        contigs.select("chrom", F.col("length").cast("int").alias("start"), F.col("length").cast("int").alias("end"))
    )
    w = Window.partitionBy("chrom").orderBy("start", "end")
    gaps = islands.unionByName(edges).select("chrom", F.lag("end").over(w).alias("start"), F.col("start").alias("end"))
    return gaps.where("start < end")


def tiles(contigs: DataFrame, width: int) -> DataFrame:
    """Fixed tiling of each contig, the last tile shorter."""
    return contigs.select("chrom", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(width))).alias("start")).select(
        "chrom", "start", F.least(F.col("start") + width, F.col("length")).alias("end")
    )


def coverage_bins(df: DataFrame, contigs: DataFrame, parts: int, width: int) -> DataFrame:
    """Bins of each interval (id, chrom, pos, svlen): 'bin0' to 'bin<parts - 1>' inside, 'before' and 'after' of one part's
    length, 'left' and 'right' of `width` bases around the edges; clamped to the contig, none left out (so those off it are
    empty). Without parts the two edges alone. chrom, start, end, name ('id_bin')."""
    pos, size = F.col("pos").cast("long"), F.col("svlen").cast("long")
    half = width // 2
    edges = [("left", pos - half, pos - half + width), ("right", pos + size - half, pos + size - half + width)]
    inner = []
    if parts:
        quantum = F.call_function("div", size, F.lit(parts))
        inner = [("before", pos - quantum, pos), ("after", pos + size, pos + size + quantum)]
        inner += [(f"bin{i}", pos + F.call_function("div", size * i, F.lit(parts)), pos + F.call_function("div", size * (i + 1), F.lit(parts))) for i in range(parts)]
    bins = [F.struct(F.lit(name).alias("bin"), lo.alias("lo"), hi.alias("hi")) for name, lo, hi in (*edges, *inner)]
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    found = df.join(sizes, "chrom").select("id", "chrom", "_length", F.inline(F.array(*bins)))
    name = F.concat_ws("_", F.col("id").cast("string"), "bin")
    return found.select("chrom", F.greatest("lo", F.lit(0)).alias("start"), F.least("hi", "_length").alias("end"), name.alias("name"))


def around(df: DataFrame, contigs: DataFrame, slack: int) -> DataFrame:
    """Windows around records (pos, svlen, svtype): the footprint and slack on both sides; insertions by their length."""
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    insertion = F.col("svtype") == "INS"
    before, after = F.when(insertion, F.col("svlen")).otherwise(slack), F.when(insertion, F.col("svlen")).otherwise(F.col("svlen") + slack)
    return df.join(sizes, "chrom").select(
        "id", "chrom", F.greatest(F.col("pos") - before, F.lit(0)).alias("start"), F.least(F.col("pos") + after, F.col("_length")).alias("end")
    )


def hard_filter_regions(
    contigs: DataFrame, centromeres: DataFrame, gaps: DataFrame, bases: int | None = None, share: float | None = None, least: int = 1000
) -> DataFrame:
    """The arms of each contig between its telomeres and its centromere, without a buffer at all four ends, in pieces of
    `least` bases: chrom, start, end. The buffer is `bases`, or a `share` of the contig (rounded up).

    gaps: chrom, start, end, type (in any case). Telomeres reach from the contig's start or to its end, or it is an error.
    Heterochromatin and short arms widen the centromere, but on chrY heterochromatin is where the far telomere begins.
    Contigs without all four bounds, and those shorter than four buffers, stay whole."""
    known = gaps.join(contigs.select("chrom", F.col("length").alias("_length")), "chrom")
    kind, first, last = F.lower("type"), F.col("start"), F.col("end")
    off = F.when((kind == "telomere") & (first != 0) & (last != F.col("_length")), F.raise_error(F.concat(F.lit("telomere inside "), "chrom")))
    hetero, on_y = kind == "heterochromatin", F.lower("chrom") == "chry"
    ends = known.select(
        "chrom",
        F.when((kind == "telomere") & (first == 0), last).alias("near_end"),
        F.when(((kind == "telomere") & (first != 0)) | (hetero & on_y), first + F.coalesce(off.cast("int"), F.lit(0))).alias("far_start"),
        F.when((hetero & ~on_y) | (kind == "short_arm"), first).alias("c_start"),
        F.when(hetero & ~on_y, last).alias("c_end"),
    )
    nothing = F.lit(None).cast("int")
    ends = ends.unionByName(centromeres.select("chrom", nothing.alias("near_end"), nothing.alias("far_start"), first.alias("c_start"), last.alias("c_end")))
    bounds = ends.groupBy("chrom").agg(F.max("near_end").alias("t1"), F.min("far_start").alias("t0"), F.min("c_start").alias("c0"), F.max("c_end").alias("c1"))
    length = F.col("length")
    buffer = F.lit(bases) if share is None else F.ceil(length * share).cast("int")
    full = F.col("t0").isNotNull() & F.col("t1").isNotNull() & F.col("c0").isNotNull() & F.col("c1").isNotNull() & (length >= 4 * buffer)
    piece = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    arms = F.array(piece(F.col("t1") + buffer, F.col("c0") - buffer), piece(F.col("c1") + buffer, F.col("t0") - buffer))
    arms = F.filter(arms, lambda x: x["end"] - x["start"] >= least)
    pieces = F.when(full, arms).otherwise(F.array(piece(F.lit(0), length)))
    return contigs.join(bounds, "chrom", "left").select("chrom", F.inline(pieces))
