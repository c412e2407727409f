"""Cohorts in long form: a genotype is a row (variant, sample), so merging N samples is a union and one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.functions import genotypes as G

SITE = ["chrom", "pos", "ref", "alt"]


def merge_samples(cells: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One cell for each (site, sample) of rows (chrom, pos, ref, alt, sample_id, gt): of several, the one that knows most,
    then the least text. With samples (sample_id), sites that a sample lacks get './.': the site list and the sample list
    are multiplied, so that is for a sink that needs the dense form."""
    best = F.min_by("gt", F.struct(-G.called(F.col("gt")), F.col("gt")))
    merged = cells.groupBy(*SITE, "sample_id").agg(best.alias("gt"))
    if samples is None:
        return merged
    dense = merged.select(*SITE).distinct().withColumn("_all", F.lit(1)).join(samples.select("sample_id").distinct().withColumn("_all", F.lit(1)), "_all").drop("_all")
    return dense.join(merged, [*SITE, "sample_id"], "left").withColumn("gt", F.coalesce("gt", F.lit("./.")))


def merge_by_id(cells: DataFrame) -> DataFrame:
    """As merge_samples by variant_id alone; variants without an alternative cell are dropped."""
    best = F.min_by("gt", F.struct(-G.called(F.col("gt")), F.col("gt")))
    merged = cells.groupBy("variant_id", "sample_id").agg(best.alias("gt"))
    return merged.join(merged.where(G.n_alts(F.col("gt")) > 0).select("variant_id").distinct(), "variant_id", "left_semi")


def prefer(datasets: list[DataFrame], key: str, pinned: dict[str, int] | None = None) -> DataFrame:
    """The union of data sets; of a key in several, the last data set's rows stay, unless pinned names another."""
    union = reduce(DataFrame.unionByName, [d.withColumn("dataset", F.lit(i)) for i, d in enumerate(datasets)])
    first = F.max("dataset")
    if pinned:
        chosen = F.element_at(F.create_map(*[F.lit(x) for kv in pinned.items() for x in kv]), F.col(key).cast("string"))
        first = F.coalesce(F.max(F.when(F.col("dataset") == chosen, F.col("dataset"))), first)
    winner = union.groupBy(key).agg(first.alias("dataset"))
    return union.join(winner, [key, "dataset"], "left_semi")


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state: 'old' in a alone, 'new' in b alone, 'both'."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_b").isNull(), "old").when(F.col("_a").isNull(), "new").otherwise("both")
    return x.join(y, keys, "full").select(*keys, state.alias("state"))


def union_distinct(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames, one a key: the earliest frame's, then the least of its other columns."""
    union = reduce(DataFrame.unionByName, [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)])
    rest = [c for c in frames[0].columns if c not in keys]
    return union.groupBy(*keys).agg(F.min(F.struct("_from", *rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def collapse_cells(cells: DataFrame) -> DataFrame:
    """One record for each site of rows (site, ordinal, gt, ft, supp): the genotype with most called alleles, the first
    filter that isn't missing, and a bit for each ordinal that has an alternative allele."""
    return cells.groupBy(*SITE).agg(
        F.min_by("gt", F.struct(-G.called(F.col("gt")), "ordinal")).alias("gt"),
        F.min_by("ft", F.when(F.col("ft") != ".", F.col("ordinal"))).alias("ft"),
        F.bit_or(F.when(G.n_alts(F.col("gt")) > 0, F.call_function("shiftleft", F.lit(1), F.col("ordinal").cast("int"))).otherwise(0)).alias("supp"),
    )


def annotate(variants: DataFrame, notes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """variants with columns of notes by keys; null where there is none."""
    return variants.join(notes.select(*keys, *columns), keys, "left")


def discovery(cells: DataFrame, key: str) -> DataFrame:
    """n_discovery (samples with an alternative allele), allele_count and called alleles of each variant."""
    gt = F.col("gt")
    return cells.groupBy(key).agg(F.count_if(G.n_alts(gt) > 0).alias("n_discovery"), F.sum(G.n_alts(gt)).alias("allele_count"), F.sum(G.called(gt)).alias("called"))


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables side by side by key. Raises where a key of one is not in the other."""
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full")
    if not both.where("_a is null or _b is null").isEmpty():
        raise ValueError("keys of the two tables differ")
    return both.drop("_a", "_b")


def haplotypes(members: DataFrame, window: list[str], blocks: DataFrame) -> DataFrame:
    """Haplotype sequences: per window, sample and haplotype its records (first, last, alt: 0-based reference bases
    [first, last) replaced by alt) laid in order over the window's reference (start, seq); a record that overlaps an
    earlier one is left out. window, sample_id, hap, seq, record_ids."""
    key = [*window, "sample_id", "hap"]
    listed = members.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "last", "record_id", "alt"))).alias("m"))
    start = F.struct(F.col("start").alias("at"), F.lit("").alias("seq"), F.array().cast("array<string>").alias("ids"))

    def lay(acc, r):
        fits = r["first"] >= acc["at"]
        gap = F.substring(F.col("ref_seq"), (acc["at"] - F.col("start") + 1).cast("int"), (r["first"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(fits, r["last"]).otherwise(acc["at"]).alias("at"),
            F.when(fits, F.concat(acc["seq"], gap, r["alt"])).otherwise(acc["seq"]).alias("seq"),
            F.when(fits, F.concat(acc["ids"], F.array(r["record_id"].cast("string")))).otherwise(acc["ids"]).alias("ids"),
        )

    laid = listed.join(blocks.select(*window, "start", F.col("seq").alias("ref_seq")), window).withColumn("f", F.aggregate("m", start, lay))
    rest = F.substring(F.col("ref_seq"), (F.col("f.at") - F.col("start") + 1).cast("int"), F.length("ref_seq"))
    return laid.select(*key, F.concat("f.seq", rest).alias("seq"), F.col("f.ids").alias("record_ids"))


def distinct_haplotypes(haps: DataFrame, window: list[str]) -> DataFrame:
    """Sequences of a window, case ignored, with multiplicity; the least spelling stands for its class."""
    return haps.groupBy(*window, F.upper("seq").alias("_u")).agg(F.min("seq").alias("seq"), F.count("*").alias("n")).drop("_u")


def haplotype_calls(hap_gts: DataFrame, hap_map: DataFrame) -> DataFrame:
    """Record genotypes from haplotype genotypes (hap_id, sample_id, h1, h2) by the haplotypes' members (hap_id, record_ids)."""
    one = hap_gts.join(hap_map.select("hap_id", F.explode("record_ids").alias("record_id")), "hap_id")
    merged = one.groupBy("record_id", "sample_id").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    return merged.select("record_id", "sample_id", F.concat_ws("|", "h1", "h2").alias("gt"))
