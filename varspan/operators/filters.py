"""Predicates over variants and genotypes. User expressions are Spark SQL strings, given to DataFrame.where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.functions import genotypes as G
from varspan.functions.info import info_field

#: The types that count as structural variants.
SV_TYPES = ("DEL", "DEL:ME", "INV", "DUP", "DUP:TANDEM", "DUP:INT", "INS", "INS:ME", "INS:NOVEL")


def length_between(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.where(F.abs("svlen").between(least, most))


def of_types(df: DataFrame, *types: str) -> DataFrame:
    return df.where(F.col("svtype").isin(*types))


def standard_chromosome(chrom: Column) -> Column:
    return chrom.rlike("^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)$")


def clean_truth(df: DataFrame) -> DataFrame:
    """Without single-base and same-length substitutions, '*' and missing ALTs, and what is filtered."""
    same = F.length("ref") == F.length("alt")
    return df.where(~same & ~F.col("alt").isin("*", ".") & F.col("filter").isin("PASS", "."))


def present(df: DataFrame, genotypes: DataFrame, key: str = "variant_id") -> DataFrame:
    """Variants that some sample carries; half-missing cells count."""
    return df.join(genotypes.where(G.n_alts(F.col("gt")) > 0).select(key).distinct(), key, "left_semi")


def mask_cells(genotypes: DataFrame, least_dp: int, most_dp: int, least_alt: int, key: str = "variant_id") -> DataFrame:
    """Alternative cells of a depth out of range, or of too few alternative reads, become missing; records that lose their
    last alternative cell are dropped."""
    bad = (G.n_alts(F.col("gt")) > 0) & ((F.col("dp") < least_dp) | (F.col("dp") > most_dp) | (F.col("ad_alt") < least_alt))
    masked = genotypes.withColumn("gt", F.when(bad, "./.").otherwise(F.col("gt")))
    return present(masked, masked, key)


def by_frequency(df: DataFrame, samples: int, share: float) -> DataFrame:
    """frequent: found in share of the samples or more."""
    return df.withColumn("frequent", F.col("n_discovery") >= share * samples)


def by_class(df: DataFrame, least: int) -> DataFrame:
    """route: 'sv' for known types (in any case) of `least` bases or more, 'small' for the rest."""
    sv = F.upper("svtype").isin(*SV_TYPES) & (F.abs("svlen") >= least)
    return df.withColumn("route", F.when(F.coalesce(sv, F.lit(False)), "sv").otherwise("small"))


def usable_reads(reads: DataFrame, least_mapq: int, mask: int, window: int) -> DataFrame:
    """Reads with a sequence, mapped well, without masked flags, that reach the window around `at`."""
    return reads.where((F.length("seq") > 0) & (F.col("mapq") >= least_mapq) & (F.col("flag").bitwiseAND(mask) == 0) & (F.col("pos") <= F.col("at") + window) & (F.col("ref_end") >= F.col("at") - window))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the finished ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def train_test_by_parity(df: DataFrame) -> DataFrame:
    """split: 'train' for the larger of parities 0 and 2, 'test' for the other, null for mixed ones."""
    n = {r["parity"]: r["n"] for r in df.groupBy("parity").agg(F.count("*").alias("n")).collect()}
    train = 0 if n.get(0, 0) >= n.get(2, 0) else 2
    return df.withColumn("split", F.when(F.col("parity") == train, "train").when(F.col("parity") == 2 - train, "test"))


def sample_band(df: DataFrame, tag: str, least: float, most: float) -> DataFrame:
    """Records whose INFO number `tag` (samples that have it; 1 where it is missing) lies between least and most."""
    return df.where(F.coalesce(info_field(F.col("info"), tag).try_cast("double"), F.lit(1.0)).between(least, most))


def without_chain_ends(df: DataFrame, tag: str = "TRUTH_BND_TYPE") -> DataFrame:
    """Training rows but those that were matched to an end of a chain (type 4) alone."""
    return df.where(F.coalesce(info_field(F.col("info"), tag), F.lit("")) != "4")
