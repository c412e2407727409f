"""Cohort statistics: trios, Hardy-Weinberg, histograms, truth tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.functions import genotypes as G
from varspan.functions.binning import clamp, quantum_bin


def trios(cells: DataFrame, pedigree: DataFrame, coverage: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(variant_id, child, father, mother, gt and depths of child c_, father f_, mother m_) of every complete trio, and the
    columns `keep` of the child's cell. pedigree: child, father, mother; with coverage (id), all three must have some and no
    parent is 0. Cells meet the pedigree by sample and shuffle once by trio, where incomplete ones leave."""
    members, kind = ("child", "father", "mother"), cells.schema["sample_id"].dataType
    ped = pedigree.where((F.col("father").cast("string") != "0") & (F.col("mother").cast("string") != "0"))
    if coverage is not None:
        for role in members:
            ped = ped.join(coverage.select(F.col("id").alias(role)).distinct(), role, "left_semi")
    lines = ped.select(*[F.col(m).cast(kind).alias(m) for m in members]).groupBy(*members).agg(F.count("*").cast("int").alias("_lines"))
    roles = lines.withColumn("_r", F.explode(F.array(*[F.struct(F.col(m).alias("sample_id"), F.lit(1 << i).alias("role")) for i, m in enumerate(members)])))
    own = cells.where("variant_id is not null").select("variant_id", "sample_id", "gt", "ad_ref", "ad_alt", *keep)
    met = own.join(roles.select(*members, "_lines", "_r.sample_id", F.col("_r.role").alias("_role")), "sample_id").drop("sample_id")
    whole = met.withColumn("_all", F.bit_or("_role").over(Window.partitionBy("variant_id", *members))).where("_all = 7")
    listed = [F.collect_list(F.when(F.col("_role") == 1 << i, F.struct("gt", "ad_ref", "ad_alt", *keep))).alias(f"_{m}") for i, m in enumerate(members)]
    out = whole.groupBy("variant_id", *members, "_lines").agg(*listed)
    for m in members:
        out = out.withColumn(f"_{m}", F.explode(f"_{m}"))
    values = [F.col(f"_{m}.{c}").alias(f"{m[0]}_{c[c.find('_') + 1:]}") for m in members for c in ("gt", "ad_ref", "ad_alt")]
    return out.withColumn("_line", F.explode(F.array_repeat(F.lit(0), F.col("_lines")))).select("variant_id", *members, *values, *[F.col(f"_child.{c}").alias(c) for c in keep])


def eligible() -> Column:
    """The child carries the variant, all three are called and diploid."""
    gts = [F.col(f"{p}_gt") for p in "cfm"]
    whole = [~G.has_missing(g) & G.is_diploid(g) for g in gts]
    return (G.n_alts(gts[0]) > 0) & whole[0] & whole[1] & whole[2]


def is_de_novo() -> Column:
    return eligible() & (G.n_alts(F.col("f_gt")) == 0) & (G.n_alts(F.col("m_gt")) == 0)


def de_novo_rate(table: DataFrame, *by: str | Column) -> DataFrame:
    """den, num and rate of de novo calls by the given columns."""
    return table.groupBy(*by).agg(F.count_if(eligible()).alias("den"), F.count_if(is_de_novo()).alias("num")).withColumn("rate", F.try_divide(F.col("num").cast("double"), F.col("den")))


def mean_depth_bin(most: int) -> Column:
    """Integer mean of the trio's three depths, capped."""
    total = sum((F.col(f"{p}_ref") + F.col(f"{p}_alt") for p in "cfm"), F.lit(0))
    return F.least(F.floor(total / 3), F.lit(most)).cast("int")


def depth_histogram(table: DataFrame, most: int) -> DataFrame:
    """Counts by alternative depth of child and of both parents, capped, and whether the call is de novo."""
    return table.where(eligible()).groupBy(
        is_de_novo().alias("de_novo"), F.least("c_alt", F.lit(most)).alias("child_alt"), F.least(F.col("f_alt") + F.col("m_alt"), F.lit(most)).alias("parents_alt")
    ).agg(F.count("*").alias("n"))


def mendelian_error() -> Column:
    """Whether the child's alleles can't be one of each parent's (all called, diploid)."""
    c, f, m = (G.alleles(F.col(f"{p}_gt")) for p in "cfm")
    a, b = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    fine = (F.array_contains(f, a) & F.array_contains(m, b)) | (F.array_contains(f, b) & F.array_contains(m, a))
    return ~fine


def mendelian(table: DataFrame, *by: str) -> DataFrame:
    """good_alt (consistent calls with an alternative allele), errors, and errors' share."""
    called = ~(G.has_missing(F.col("c_gt")) | G.has_missing(F.col("f_gt")) | G.has_missing(F.col("m_gt")))
    called = called & G.is_diploid(F.col("c_gt")) & G.is_diploid(F.col("f_gt")) & G.is_diploid(F.col("m_gt"))
    some = (G.n_alts(F.col("c_gt")) + G.n_alts(F.col("f_gt")) + G.n_alts(F.col("m_gt"))) > 0
    out = table.groupBy(*by).agg(F.count_if(called & some & ~mendelian_error()).alias("good_alt"), F.count_if(called & mendelian_error()).alias("errors"))
    return out.withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("errors") + F.col("good_alt")))


def hardy_weinberg_counts(cells: DataFrame, keep_any_diploid: bool = False) -> DataFrame:
    """aa, ab, bb of diploid called cells by variant; variants with an alternative allele, or with any diploid cell."""
    gt = F.col("gt")
    diploid = G.is_diploid(gt) & ~G.has_missing(gt)
    out = cells.groupBy("variant_id").agg(
        F.count_if(diploid & (G.n_alts(gt) == 0)).alias("aa"), F.count_if(diploid & (G.n_alts(gt) == 1)).alias("ab"), F.count_if(diploid & (G.n_alts(gt) == 2)).alias("bb")
    )
    return out.where("aa + ab + bb > 0" if keep_any_diploid else "ab + bb > 0")


def chi_square() -> Column:
    """Hardy-Weinberg statistic (one degree of freedom) of aa, ab, bb; null where only one allele is seen."""
    n = (F.col("aa") + F.col("ab") + F.col("bb")).cast("double")
    p = (2 * F.col("aa") + F.col("ab")) / (2 * n)
    q = 1 - p
    parts = [F.try_divide(F.pow(o - e, F.lit(2)), e) for o, e in ((F.col("aa"), n * p * p), (F.col("ab"), 2 * n * p * q), (F.col("bb"), n * q * q))]
    return parts[0] + parts[1] + parts[2]


def hardy_weinberg_classes(counts: DataFrame) -> DataFrame:
    """class: 'pass' (also where the statistic is null), 'nominal' (p < 0.05), 'corrected' (p < 0.05 / tests).

    p < a is the same as statistic > the chi-square quantile of 1 - a, which is the square of a normal quantile; one
    driver-side number for each threshold, no p values by row."""
    from statistics import NormalDist

    n = max(counts.count(), 1)
    cut = [NormalDist().inv_cdf(1 - a / 2) ** 2 for a in (0.05, 0.05 / n)]
    x = chi_square()
    return counts.withColumn("chi2", x).withColumn("class", F.when(x > cut[1], "corrected").when(x > cut[0], "nominal").otherwise("pass"))


def histogram(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Counts by named expressions, in long form."""
    return df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"))


def dense(counts: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """A histogram with a row for every combination of the axes' values, 0 where nothing was counted; the axes are fixed
    lists, so the grid's size does not depend on the data."""
    spark = counts.sparkSession
    grid = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name]).withColumn("_g", F.lit(1))
        grid = axis if grid is None else grid.join(axis, "_g")
    return grid.drop("_g").join(counts, list(axes), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pivot_counts(counts: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return counts.groupBy(row).pivot(column, list(values)).agg(F.sum("n")).na.fill(0, list(values))


def allele_balance(cells: DataFrame, quantum: float, most: int) -> DataFrame:
    """Histograms of alternative depth and of its share by number of alternative alleles; cells without depth are left out."""
    depth = F.col("ad_ref") + F.col("ad_alt")
    return cells.where((depth > 0) & ~G.has_missing(F.col("gt"))).groupBy(
        G.n_alts(F.col("gt")).alias("n_alts"), clamp(F.col("ad_alt"), 0, most).alias("alt_depth"), quantum_bin(F.col("ad_alt") / depth, quantum).alias("share_bin")
    ).agg(F.count("*").alias("n"))


def genotyping_priors(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """P(alternative depth | depth, true genotype): truth (match_id, gt) joined with calls (match_id, ad_ref, ad_alt)."""
    both = truth.select("match_id", G.n_alts(F.col("gt")).alias("n_alts")).join(calls.where("ad_ref is not null and ad_alt is not null"), "match_id")
    counts = both.groupBy("n_alts", (F.col("ad_ref") + F.col("ad_alt")).alias("depth"), "ad_alt").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("n_alts", "depth"))
    return counts.withColumn("p", F.col("n") / total)


def transitions(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Counts of genotype classes (., 0, 1, ./., 0/0, 0/1, 1/1) before and after, by the given columns of before."""

    def simple(gt: Column) -> Column:
        plain = F.regexp_replace(gt, "\\|", "/")
        return F.when(plain == "1/0", "0/1").when(plain.isin("./0", "0/.", "./1", "1/."), "./.").otherwise(plain)

    both = before.select("variant_id", "sample_id", *by, simple(F.col("gt")).alias("before")).join(
        after.select("variant_id", "sample_id", simple(F.col("gt")).alias("after")), ["variant_id", "sample_id"]
    )
    return both.groupBy(*by, "before", "after").agg(F.count("*").alias("n"))


def precision_recall(states: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 from (side, state) rows; calls count for precision, truth for recall."""
    out = states.groupBy(*by).agg(
        F.count_if((F.col("side") == "base") & (F.col("state") == "tp")).alias("tp_base"),
        F.count_if((F.col("side") == "comp") & (F.col("state") == "tp")).alias("tp_comp"),
        F.count_if(F.col("state") == "fp").alias("fp"),
        F.count_if(F.col("state") == "fn").alias("fn"),
    )
    p = F.try_divide(F.col("tp_comp").cast("double"), F.col("tp_comp") + F.col("fp"))
    r = F.try_divide(F.col("tp_base").cast("double"), F.col("tp_base") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)})


def call_counts(df: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Calls by caller, type and track with all subtotals (null: all), one column a length threshold."""
    return df.cube("caller", "svtype", "in_track").agg(*[F.count_if(F.abs("svlen") >= n).alias(f"n_{n}") for n in lengths])


def same_position(df: DataFrame) -> DataFrame:
    """Records of one (chrom, pos): how many, and how they differ. Types are a key of the first of two aggregations, quals
    differ where least and greatest do: distinct counts would write each row three times."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("qual", "svlen") for f in (F.min, F.max)]
    types = df.groupBy("chrom", "pos", "svtype").agg(F.count("*").alias("n"), *ends)
    least, most = F.min("min_svlen"), F.max("max_svlen")
    return types.groupBy("chrom", "pos").agg(
        F.sum("n").alias("n"),
        (F.count("svtype") > 1).alias("types_differ"),
        F.coalesce(F.min("min_qual") < F.max("max_qual"), F.lit(False)).alias("quals_differ"),
        (most - least).alias("length_range"),
        F.try_divide(most.cast("double"), least).alias("length_ratio"),
    ).where("n > 1")


def reverse_cdf(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Share of rows in this bin of [0, 1] or a higher one. The window runs over the bins' totals, a fixed number."""
    counts = df.groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("share", F.sum("n").over(up) / F.sum("n").over(everything))


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Exact area under the ROC curve by ranks of distinct scores: pos, neg, auc."""
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(w), F.lit(0))
    won = counts.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    out = won.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"), F.sum("won").alias("won"))
    return out.withColumn("auc", F.try_divide("won", F.col("pos").cast("double") * F.col("neg"))).drop("won")


def bin_coverage(cov: DataFrame, mean_coverage: float) -> DataFrame:
    """Wide rows of normalised coverage by bin from (chrom, start, end, bin_key 'id_bin', cov): id, bin, value."""
    at = F.regexp_extract("bin_key", "^(.*)_([0-9]+)$", 1), F.regexp_extract("bin_key", "^(.*)_([0-9]+)$", 2).cast("int")
    return cov.select(at[0].alias("id"), at[1].alias("bin"), F.round(F.col("cov") / (F.col("end") - F.col("start")) / mean_coverage, 4).alias("value"))


def mapping_quality(reads: DataFrame, *by: str) -> DataFrame:
    """Mean mapping quality and share of secondary alignments; 0 where there is none."""
    secondary = F.col("flag").bitwiseAND(256) != 0
    return reads.groupBy(*by).agg(F.coalesce(F.avg("mapq"), F.lit(0.0)).alias("mean_mapq"), F.coalesce(F.try_divide(F.count_if(secondary).cast("double"), F.count("*")), F.lit(0.0)).alias("secondary"))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    n = F.col("n")
    return chunks.agg(F.count("*").alias("count"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("max"))


def de_novo_multiallelic(rows: DataFrame, least: int) -> DataFrame:
    """Alleles of a child's multiallelic records (ref, child_alts, parent_alts: arrays) by two definitions of a structural
    allele (longest of both alleles, or their difference, `least` or more): how many there are and how many no parent has."""
    one = rows.select("ref", "parent_alts", F.explode("child_alts").alias("a"))
    long = F.greatest(F.length("ref"), F.length("a")) >= least
    differs = F.abs(F.length("ref") - F.length("a")) >= least
    new = ~F.array_contains("parent_alts", F.col("a"))
    return one.agg(
        F.count_if(long).alias("long"), F.count_if(long & new).alias("long_new"), F.count_if(differs).alias("differs"), F.count_if(differs & new).alias("differs_new")
    )


def position_histogram(df: DataFrame, quantum: int, *by: str) -> DataFrame:
    """How many intervals (start, end) cover each position bin; an interval counts once in every bin it touches."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / quantum), F.floor((F.col("end") - 1) / quantum)))
    return df.where("start < end").select(*by, bins.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def grouped_margins(df: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Counts by each of the given sets of columns, in one pass (GROUPING SETS); columns outside a set are null."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias("n"))


def read_features(reads: DataFrame, records: DataFrame, distance: int) -> DataFrame:
    """Per record (id, chrom, start, end): reads near it, their mean quality, share on the reverse strand, share clipped, and
    the median absolute deviation of quality over its mean. reads: read_id, chrom, start, end, mapq, flag, clipped."""
    from varspan.operators.intervals import overlap_join

    pairs = overlap_join(records.select("id", "chrom", "start", "end"), reads.select("chrom", "start", "end", "mapq", "flag", "clipped"), distance)
    q = F.col("b_mapq")
    middle = pairs.groupBy("a_id").agg(F.percentile(q, 0.5).alias("_m"))
    spread = pairs.join(middle, "a_id").groupBy(F.col("a_id").alias("id")).agg(
        F.count("*").alias("reads"),
        F.avg(q).alias("mean_mapq"),
        (F.count_if(F.col("b_flag").bitwiseAND(16) != 0) / F.count("*")).alias("reverse_share"),
        (F.count_if(F.col("b_clipped")) / F.count("*")).alias("clipped_share"),
        F.try_divide(F.percentile(F.abs(q - F.col("_m")), 0.5), F.avg(q)).alias("deviation"),
    )
    return spread


def contig_layout(contigs: DataFrame) -> DataFrame:
    """Contigs in natural order with the sum of the lengths before them and its share of the whole, for circular plots.
    Contigs are few, so one window over all of them will do."""
    from varspan.operators.rewrite import chromosome_number

    rank = F.coalesce(chromosome_number(F.col("chrom")), F.lit(99))
    w = Window.orderBy(rank, "chrom")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return contigs.select("chrom", "length", before.alias("before"), (before / F.sum("length").over(Window.partitionBy(F.lit(0)))).alias("share"))


def score_histograms(df: DataFrame, most: int = 100) -> DataFrame:
    """How many cells have each score: score (0 to most, none left out), present, present_1, present_2, absent, absent_1,
    absent_2. df: gt, scores ('a', 'a,b' or '.', which counts nowhere). A cell is present if its genotype has an allele 1; one
    score counts in the plain column, the first and second of two in columns of their own. Scores out of range are an error."""
    parts = F.split("scores", ",")
    side = F.when(F.contains("gt", F.lit("1")), "present").otherwise("absent")
    one = F.array(F.struct(side.alias("kind"), parts[0].cast("int").alias("score")))
    two = F.array(*[F.struct(F.concat(side, F.lit(f"_{i + 1}")).alias("kind"), F.get(parts, F.lit(i)).cast("int").alias("score")) for i in (0, 1)])
    rows = df.where("scores != '.'").select(F.inline(F.when(F.size(parts) == 1, one).otherwise(two)))
    checked = F.when(F.col("score").between(0, most), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("score out of range: "), F.col("score").cast("string"))).cast("int"))
    kinds = ["present", "present_1", "present_2", "absent", "absent_1", "absent_2"]
    counts = rows.select("kind", checked.alias("score")).groupBy("score").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    every = df.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("score"))
    return every.join(counts, "score", "left").select("score", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def reference_cells(cells: DataFrame) -> DataFrame:
    """The cells of diploid reference genotypes (phased or not), to list their depths."""
    return cells.where(F.col("gt").rlike("^0[/|]0$"))


def between_depths(df: DataFrame, key: str, mean: int, deviation: int) -> DataFrame:
    """key, mean, deviation (of the sample) of depths (dp, whole numbers), where the mean is above `mean` and the deviation below
    `deviation`. From sums of whole numbers, so neither figure nor bound depends on the order in which tasks' parts meet."""
    dp = F.col("dp").cast("long")
    sums = df.groupBy(key).agg(F.count("dp").alias("_n"), F.sum(dp).alias("_s"), F.sum(dp * dp).alias("_q"))
    n, spread = F.col("_n"), F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")
    kept = sums.where((F.col("_s") > mean * n) & (n > 1) & (spread < deviation**2 * n * (n - 1)))
    return kept.select(key, (F.col("_s") / n).alias("mean"), F.sqrt(spread / (n * (n - 1))).alias("deviation"))
