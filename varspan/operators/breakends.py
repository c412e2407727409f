"""Pairing and tables of breakends (chrom1, pos1, dir1, chrom2, pos2, dir2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _end(i: int) -> Column:
    return F.concat_ws("@", f"chrom{i}", f"pos{i}", f"dir{i}")


def is_canonical() -> Column:
    """Whether a record's own end comes first."""
    one, two = F.struct("chrom1", "pos1", "dir1"), F.struct("chrom2", "pos2", "dir2")
    return one <= two


def canonical_key() -> Column:
    return F.when(is_canonical(), F.concat_ws("@", _end(1), _end(2))).otherwise(F.concat_ws("@", _end(2), _end(1)))


def canonize(df: DataFrame, total: str | None = None) -> DataFrame:
    """One record for each adjacency, the canonical one where there is one: key, id, canonical, n, singles, and the sum of
    column `total`. Records of one key pair off; an odd one is a single, to be symmetrized by its reader."""
    aggs = [
        F.min_by("id", F.struct(~is_canonical(), "id")).alias("id"),
        F.max(is_canonical()).alias("canonical"),
        F.count("*").alias("n"),
        (F.count("*") % 2).alias("singles"),
    ]
    if total:
        aggs.append(F.sum(total).alias(f"sum_{total}"))
    return df.groupBy(canonical_key().alias("key")).agg(*aggs)


def orientation_table(df: DataFrame) -> DataFrame:
    """Counts by orientation (++, +-, -+, --) and place of the mate: same contig after, same contig before, other."""
    sign = [F.when(F.col(f"dir{i}") == 1, "+").otherwise("-") for i in (1, 2)]
    place = F.when(F.col("chrom1") != F.col("chrom2"), "other").when(F.col("pos2") > F.col("pos1"), "after").otherwise("before")
    placed = df.select(F.concat(*sign).alias("orientation"), place.alias("place"))
    return placed.groupBy("orientation").pivot("place", ["after", "before", "other"]).count()


def chromosome_matrix(df: DataFrame) -> DataFrame:
    """Counts by the two contigs, in long form."""
    return df.groupBy("chrom1", "chrom2").agg(F.count("*").alias("n"))
