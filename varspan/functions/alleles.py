"""Alleles: kinds of ALT, symbolic lengths, breakends, footprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varspan.functions.info import info_field

#: The IUPAC nucleotide alphabet.
IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
DNA, SYMBOLIC, BREAKEND, UNKNOWN = 0, 1, 2, -1


def alt_kind(alt: Column) -> Column:
    """0 sequence, 1 symbolic, 2 breakend (brackets, or a single one with a dot), -1 other."""
    return (
        F.when(alt.rlike(f"^[{IUPAC}]+$"), DNA)
        .when(alt.rlike("^<.*>$"), SYMBOLIC)
        .when(alt.rlike(r"[\[\]]") | alt.rlike(rf"^\.[{IUPAC}]+$") | alt.rlike(rf"^[{IUPAC}]+\.$"), BREAKEND)
        .otherwise(UNKNOWN)
    )


def symbolic_length(pos: Column, info: Column) -> Column:
    """|SVLEN|, else END - POS where positive, else -1."""
    span = info_field(info, "END").try_cast("int") - pos
    return F.coalesce(F.abs(info_field(info, "SVLEN").try_cast("int")), F.when(span > 0, span), F.lit(-1))


def svtype(ref: Column, alt: Column, kind: Column | None = None) -> Column:
    """INS, DEL, SUB by allele lengths; a symbolic ALT's first three letters; BND; UNK. kind: a column that has ALT's kind,
    which else is computed at each use."""
    kind, r, a = alt_kind(alt) if kind is None else kind, F.length(ref), F.length(alt)
    return (
        F.when(kind == SYMBOLIC, F.substring(alt, 2, 3))
        .when(kind == BREAKEND, "BND")
        .when((kind == DNA) & (r == 1) & (a > 1), "INS")
        .when((kind == DNA) & (r > 1) & (a == 1), "DEL")
        .when((kind == DNA) & (r > 1) & (a > 1), "SUB")
        .otherwise("UNK")
    )


def svlen(pos: Column, ref: Column, alt: Column, info: Column) -> Column:
    """len(alt) - 1 of insertions, len(ref) - 1 of other sequences, the symbolic length, null of breakends."""
    kind = alt_kind(alt)
    return (
        F.when(kind == SYMBOLIC, symbolic_length(pos, info))
        .when(kind == BREAKEND, F.lit(None).cast("int"))
        .when(svtype(ref, alt) == "INS", F.length(alt) - 1)
        .otherwise(F.length(ref) - 1)
    )


MATE = r"([\[\]])(.+):([0-9]+)[\[\]]"


def breakend(chrom: Column, pos: Column, alt: Column) -> Column:
    """Struct (chrom1, pos1, dir1, chrom2, pos2, dir2, error). dir1 is 1 where the sequence left of the break is kept,
    dir2 where the mate's is; error: 0 none, 1 not a paired breakend, 2 inserted sequence, 3 both ends at one place."""
    mate_chrom = F.regexp_extract(alt, MATE, 2)
    mate_pos = F.regexp_extract(alt, MATE, 3).try_cast("int")
    error = (
        F.when(~alt.rlike(MATE), 1)
        .when(~alt.rlike(r"^(?:[\[\]].+:[0-9]+[\[\]].|.[\[\]].+:[0-9]+[\[\]])$"), 2)
        .when((mate_chrom == chrom) & (mate_pos == pos), 3)
        .otherwise(0)
    )
    return F.struct(
        chrom.alias("chrom1"),
        pos.alias("pos1"),
        F.when(alt.rlike(r"^[\[\]]"), 0).otherwise(1).alias("dir1"),
        mate_chrom.alias("chrom2"),
        mate_pos.alias("pos2"),
        F.when(F.regexp_extract(alt, MATE, 1) == "]", 1).otherwise(0).alias("dir2"),
        error.alias("error"),
    )


def repair_zero_pos(pos: Column) -> Column:
    """Telomeric breakends may have position 0: it becomes 1."""
    return F.when(pos == 0, 1).otherwise(pos)


def repair_zero_mate(alt: Column) -> Column:
    return F.regexp_replace(alt, r":0([\[\]])", ":1$1")


def footprint(pos: Column, ref: Column, alt: Column, length: Column) -> Column:
    """Struct (first, last), 1-based inclusive: insertions and breakends touch two bases, others what they replace;
    symbolic records use length."""
    point = (F.length(ref) == 1) & (F.length(alt) > 1)
    kind = alt_kind(alt)
    plain = (kind == BREAKEND) | (kind == DNA) & point | (kind == SYMBOLIC) & alt.startswith("<INS")
    last = F.when(kind == SYMBOLIC, pos + length - 1).otherwise(pos + F.length(ref) - 1)
    return F.struct(
        F.when(plain, pos).otherwise(pos + 1).alias("first"), F.when(plain, pos + 1).otherwise(last).alias("last")
    )


def length_similarity(a: Column, b: Column) -> Column:
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double"))
