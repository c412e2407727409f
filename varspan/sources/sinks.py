"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vcf_lines(df: DataFrame) -> DataFrame:
    """One column, value: the eight site columns joined by tabs, '.' for nulls."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos", "id", "ref", "alt")]
    qual = F.coalesce(F.format_string("%.2f", "qual"), F.lit("."))
    return df.select(F.concat_ws("\t", *cells, F.when(F.col("qual").isNull(), ".").otherwise(qual), F.coalesce("filter", F.lit(".")), F.coalesce("info", F.lit("."))).alias("value"))


def write_vcf(df: DataFrame, path: str) -> None:
    """Site lines in coordinate order over the part files."""
    sorted_by_site(df).transform(vcf_lines).write.text(path)


def sorted_by_site(df: DataFrame) -> DataFrame:
    """By contig (numbers, X, Y, M, others by name) and position: a range shuffle and a sort, no single task."""
    from varspan.operators.rewrite import chromosome_number

    return df.withColumn("_rank", F.coalesce(chromosome_number(F.col("chrom")), F.lit(99))).orderBy("_rank", "chrom", "pos", "ref", "alt").drop("_rank")


def write_bed(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chrom", "start", "end").alias("value")).write.text(path)


def write_split(df: DataFrame, path: str, *columns: str) -> None:
    """A folder for each value of the columns (chunk, class, sample); rows of a value are spread over tasks, as a value may
    hold most rows."""
    df.write.partitionBy(*columns).parquet(path)


def allele_sequences(df: DataFrame, pad: int) -> DataFrame:
    """FASTA lines of each locus' alleles with `pad` N on both sides: chrom, pos, value (header and sequence)."""
    side = F.repeat(F.lit("N"), F.lit(pad))
    alleles = df.select("chrom", "pos", F.explode(F.array_union(F.array("ref"), F.split("alt", ","))).alias("a")).distinct()
    return alleles.select("chrom", "pos", F.concat(F.lit(">"), F.concat_ws("_", "chrom", "pos", F.crc32("a")), F.lit("\n"), side, "a", side).alias("value"))
