"""Readers of genomics text formats as DataFrames. Compressed files are read by suffix; gzip does not split, so large
inputs should be turned into Parquet once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str | None = "#") -> DataFrame:
    reader = spark.read.schema(schema).option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of the header: chrom, length, rank (order of appearance in the file's name order is not kept by Spark, so
    rank is by the number in the name, X, Y, M after)."""
    lines = spark.read.text(path).where(F.col("value").startswith("##contig="))
    return lines.select(
        F.regexp_extract("value", "ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract("value", "length=([0-9]+)", 1).try_cast("int").alias("length")
    )


def vcf_sites(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info, and cells: the rest of the line as an array (format, then samples)."""
    t = F.split("value", "\t")
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.col("value") != ""))
        .select(
            t[0].alias("chrom"), t[1].try_cast("int").alias("pos"), t[2].alias("id"), t[3].alias("ref"), t[4].alias("alt"),
            t[5].try_cast("double").alias("qual"), t[6].alias("filter"), t[7].alias("info"), F.slice(t, 9, F.greatest(F.size(t) - 8, F.lit(0))).alias("cells"),
        )
    )


def vcf_genotypes(sites: DataFrame, samples: list[str]) -> DataFrame:
    """Long form of vcf_sites: a row for each site and sample, with format's fields as a map."""
    fields = F.split(F.get("cells", F.lit(0)), ":")
    rows = sites.where(F.size("cells") > 1).select(
        "chrom", "pos", "id", "ref", "alt", fields.alias("_f"), F.posexplode(F.slice("cells", 2, F.size("cells") - 1)).alias("_i", "_cell")
    )
    names = F.array(*[F.lit(s) for s in samples])
    values = F.split("_cell", ":")
    n = F.least(F.size("_f"), F.size(values))
    return rows.select(
        "chrom", "pos", "id", "ref", "alt", F.get(names, F.col("_i")).alias("sample_id"), F.map_from_arrays(F.slice("_f", 1, n), F.slice(values, 1, n)).alias("fields")
    ).withColumn("gt", F.col("fields")["GT"])


def bed(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, start int, end int, name string")


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index: chrom, length."""
    return _table(spark, path, "chrom string, length int, at long, bases int, width int", comment=None).select("chrom", "length")


def contig_lengths_from_records(variants: DataFrame) -> DataFrame:
    """Where no header tells: the largest position of each contig."""
    return variants.groupBy("chrom").agg(F.max("pos").alias("length"))


def fasta_blocks(spark: SparkSession, path: str, block_size: int) -> DataFrame:
    """chrom, block, seq: reference bases in blocks. Each file is one contig or several; lines keep their order because a
    file's records come as one text split at '>', in one row a contig, cut into blocks in the same task."""
    whole = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n", ""), "\\s+", "")
    rows = whole.select(F.regexp_extract("value", "^(\\S+)", 1).alias("chrom"), body.alias("_s"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("_s") - 1) / block_size), F.lit(0)).cast("int"))
    return rows.withColumn("block", F.explode(starts)).select("chrom", "block", F.substring(F.col("_s"), F.col("block") * block_size + 1, F.lit(block_size)).alias("seq"))


def assembly_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Gap rows (type N or U) of an AGP file as 0-based intervals."""
    rows = _table(spark, path, "chrom string, first int, last int, part int, type string, rest string")
    return rows.where(F.col("type").isin("N", "U")).select("chrom", (F.col("first") - 1).alias("start"), F.col("last").alias("end"))


def alignments(spark: SparkSession, path: str) -> DataFrame:
    schema = "read_id string, flag int, chrom string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, quals string"
    return _table(spark, path, schema, comment="@").select("read_id", "flag", "chrom", "pos", "mapq", "cigar", "seq")


def depth(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, pos int, depth int")


def breakpoints(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "chrom string, pos int, other_chrom string, other_pos int, type int", sep=",")


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "family string, child bigint, father bigint, mother bigint, sex string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header line."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def repeat_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON catalogue of repeats as typed columns; absent optional numbers are -1."""
    from varspan.functions.binning import motif_fraction

    schema = (
        "ReferenceRegion string, CanonicalMotif string, NumRepeatsInReference int, ReferenceRepeatPurity double, TRsInRegion int, "
        "VariationClusterSizeDiff int, LPSLengthStdevFromHPRC100 double, LPSMotifFractionFromHPRC100 string, StdevFromIllumina174k double, StdevFromT2TAssemblies double"
    )
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    region = [F.regexp_extract("ReferenceRegion", "^(.+):([0-9]+)-([0-9]+)$", i) for i in (1, 2, 3)]

    def number(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(-1.0))

    return rows.select(
        region[0].alias("chrom"), region[1].try_cast("int").alias("start"), region[2].try_cast("int").alias("end"), F.col("CanonicalMotif").alias("motif"),
        number("NumRepeatsInReference").alias("repeats"), number("ReferenceRepeatPurity").alias("purity"), number("TRsInRegion").alias("in_region"),
        number("VariationClusterSizeDiff").alias("cluster_diff"), number("LPSLengthStdevFromHPRC100").alias("length_stdev"),
        motif_fraction(F.col("LPSMotifFractionFromHPRC100")).alias("motif_share"), number("StdevFromIllumina174k").alias("short_read_stdev"),
        number("StdevFromT2TAssemblies").alias("assembly_stdev"),
    )


def benchmark_summaries(spark: SparkSession, path: str) -> DataFrame:
    """summary.json files of a folder tree: file, precision, recall, f1, gt_concordance."""
    rows = spark.read.schema("precision double, recall double, f1 double, gt_concordance double").option("multiLine", True).json(path)
    return rows.withColumn("file", F.input_file_name())


def expect_files(listed: DataFrame, manifest_df: DataFrame, key: str) -> None:
    """Raises where the manifest names files that a listing lacks."""
    missing = manifest_df.join(listed, key, "left_anti")
    n = missing.count()
    if n:
        raise ValueError(f"{n} expected files are missing, {missing.first()[key]} among them")
