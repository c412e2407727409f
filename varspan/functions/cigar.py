"""CIGAR strings and flags of alignments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """Array of (n, op)."""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)),
        lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")),
    )


def _sum(ops: Column, which: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin(*which), o["n"]).otherwise(0))


def walk(pos: Column, cigar: Column, min_indel: int) -> Column:
    """Struct (ref_end, read_span, clip_left, clip_right, indels): last reference base, read bases aligned, clipped bases
    at both ends, and (ref_pos, op, n) of inner insertions and deletions of min_indel or more."""
    ops = operations(cigar)
    start = F.struct(pos.alias("at"), F.array().cast("array<struct<ref_pos:int,op:string,n:int>>").alias("found"))

    def step(acc: Column, o: Column) -> Column:
        big = o["op"].isin("I", "D") & (o["n"] >= min_indel)
        hit = F.array(F.struct(acc["at"].alias("ref_pos"), o["op"].alias("op"), o["n"].alias("n")))
        return F.struct(
            (acc["at"] + F.when(o["op"].isin(*"MDN=X"), o["n"]).otherwise(0)).alias("at"),
            F.when(big, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"),
        )

    def clip(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(cigar, pattern, 1).try_cast("int"), F.lit(0))

    return F.struct(
        (pos + _sum(ops, "MDN=X") - 1).alias("ref_end"),
        _sum(ops, "MI=X").alias("read_span"),
        clip("^([0-9]+)[SH]").alias("clip_left"),
        clip("([0-9]+)[SH]$").alias("clip_right"),
        F.aggregate(ops, start, step)["found"].alias("indels"),
    )


def read_length(cigar: Column, seq: Column) -> Column:
    """The read's bases and those that hard clips took away."""
    return _sum(operations(cigar), "H") + F.length(seq)


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(16) != 0


def is_secondary(flag: Column) -> Column:
    return flag.bitwiseAND(256) != 0
