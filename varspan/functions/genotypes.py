"""Genotype cells such as 0/1, 1|0, ./., ., 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alleles(gt: Column) -> Column:
    return F.split(gt, "[/|]")


def n_alts(gt: Column) -> Column:
    """Alleles called and not 0."""
    return F.size(F.filter(alleles(gt), lambda a: ~a.isin("0", ".", "")))


def is_missing(gt: Column) -> Column:
    """No allele called."""
    return F.forall(alleles(gt), lambda a: a == ".")


def has_missing(gt: Column) -> Column:
    return F.exists(alleles(gt), lambda a: a == ".")


def is_diploid(gt: Column) -> Column:
    return F.size(alleles(gt)) == 2


def is_het(gt: Column) -> Column:
    a = alleles(gt)
    return is_diploid(gt) & ~has_missing(gt) & (F.element_at(a, 1) != F.element_at(a, -1))


def is_hom_alt(gt: Column) -> Column:
    return is_diploid(gt) & ~has_missing(gt) & ~is_het(gt) & (n_alts(gt) > 0)


def gt_count(gt: Column) -> Column:
    """0, 1 or 2 copies; a half-missing cell counts by the allele it has; -1 where none is called."""
    return F.when(is_missing(gt), -1).otherwise(n_alts(gt))


def called(gt: Column) -> Column:
    """Number of called alleles: which of two cells knows more."""
    return F.size(F.filter(alleles(gt), lambda a: a != "."))


def pair_or_missing(value: Column, i: int) -> Column:
    """The i-th of a comma pair, -1 where it is missing."""
    return F.coalesce(F.get(F.split(value, ","), F.lit(i)).try_cast("int"), F.lit(-1))


def genotype_quality(log10_likelihoods: Column) -> Column:
    """10 times the gap between the two best log10 likelihoods."""
    best = F.sort_array(log10_likelihoods, asc=False)
    return F.round(10 * (F.get(best, F.lit(0)) - F.get(best, F.lit(1)))).cast("int")


def reference_phred(p_ref: Column, most: int = 100) -> Column:
    """-10 log10 of the probability of 0/0, at most `most`."""
    return F.round(-10 * F.log10(F.greatest(p_ref, F.lit(10.0 ** (-most / 10))))).cast("int")
