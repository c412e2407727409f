"""Records against the reference: REF checked, set or swapped, and indels moved to their leftmost place.

The reference is a table of blocks (chrom, block, seq). Records ask for the spans they need, spans travel to their blocks,
and what they find comes back by span, so records that ask for the same span share it and no task holds a contig.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from varspan.operators.rewrite import sequences_of
from varspan.shared import compiled, written

#: Bases to the left of a record that the first round of left alignment fetches; each round fetches four times as many.
WINDOW = 256
BASES = "^[ACGTNacgtn]+$"


def check_reference(df: DataFrame, blocks: DataFrame, block_size: int, contigs: DataFrame) -> DataFrame:
    """df with REF as the reference has it, and ref_state: 'same' (but for case), 'swapped' where an ALT is the reference's
    sequence (it and REF change places; swapped_allele is its number), 'set' where none is (REF gives way to the
    reference), 'off' for records that don't lie on their contig (left as they are).

    ref of any length across blocks; alt may hold several alleles; symbolic ones and breakends can't be swapped. A missing REF
    ('.') counts as one base. Columns of df stay; repeated rows stay repeated."""
    sizes = contigs.select("chrom", F.col("length").alias("_length"))
    alts = F.split("alt", ",")
    longest = F.aggregate(alts, F.length("ref"), lambda m, a: F.greatest(m, F.when(a.rlike(BASES), F.length(a)).otherwise(0)))
    asked = df.join(sizes, "chrom", "left").withColumn("_to", F.least(F.col("pos") + longest - 1, F.col("_length")))
    found = sequences_of(asked.select("chrom", F.col("pos").alias("first"), F.col("_to").alias("last")), blocks, block_size)
    found = found.select("chrom", F.col("first").alias("pos"), F.col("last").alias("_to"), F.upper("seq").alias("_seq"))
    seen = asked.join(found, ["chrom", "pos", "_to"], "left")

    def matches(allele: Column) -> Column:
        return allele.rlike(BASES) & (F.upper(allele) == F.substring(F.col("_seq"), F.lit(1), F.length(allele)))

    own = F.substring(F.col("_seq"), F.lit(1), F.length("ref"))
    there = F.coalesce(F.length(own) == F.length("ref"), F.lit(False))
    swap = F.array_position(F.transform(alts, lambda a: F.coalesce(matches(a), F.lit(False))), True).cast("int")
    state = F.when(~there, "off").when(matches(F.col("ref")), "same").when(swap > 0, "swapped").otherwise("set")
    out = seen.withColumns({"ref_state": state, "_own": own}).withColumn("swapped_allele", F.when(F.col("ref_state") == "swapped", swap).otherwise(0))
    k = F.col("swapped_allele")
    turned = F.transform(alts, lambda a, i: F.when(i + 1 == k, F.col("ref")).otherwise(a))
    new_ref = F.when(F.col("ref_state") == "set", F.col("_own")).when(F.col("ref_state") == "swapped", F.element_at(alts, k)).otherwise(F.col("ref"))
    new_alt = F.when(F.col("ref_state") == "swapped", F.array_join(turned, ",")).otherwise(F.col("alt"))
    seen = out.withColumns({"_ref": new_ref, "_alt": new_alt}).withColumns({"ref": F.col("_ref"), "alt": F.col("_alt")})
    return seen.select(*[c for c in df.columns if c not in ("ref_state", "swapped_allele")], "ref_state", "swapped_allele")


def swapped_genotype(gt: Column, allele: Column) -> Column:
    """A genotype after its record's REF and the allele of that number changed places (0: none did)."""
    name = allele.cast("string")
    turned = F.transform(F.split(gt, "[/|]"), lambda a: F.when(a == "0", name).when(a == name, "0").otherwise(a))
    joined = F.when(gt.contains("|"), F.array_join(turned, "|")).otherwise(F.array_join(turned, "/"))
    return F.when(allele > 0, joined).otherwise(gt)


def moved_left(pos: int, ref: str, alt: str, left: str) -> tuple[int, str, str, bool]:
    """(pos, ref, alt, done): the alleles as far left as the bases to their left allow. done is False where these run out
    before a contig's start; then an allele may be empty, until more bases come."""
    at = len(left)
    while ref != alt:
        if not ref or not alt:
            if not at:
                return pos, ref, alt, False
            at, pos = at - 1, pos - 1
            ref, alt = left[at] + ref, left[at] + alt
        elif ref[-1] == alt[-1] and (pos > 1 or min(len(ref), len(alt)) > 1):
            ref, alt = ref[:-1], alt[:-1]
        else:
            break
    start = 0
    while start < min(len(ref), len(alt)) - 1 and ref[start] == alt[start]:
        start += 1
    return pos + start, ref[start:], alt[start:], True


MOVED = StructType().add("pos", IntegerType()).add("ref", StringType()).add("alt", StringType()).add("done", BooleanType())


@F.arrow_udf(MOVED)
def _moved(pos: pa.Array, ref: pa.Array, alt: pa.Array, left: pa.Array) -> pa.Array:
    rows = [moved_left(*x) for x in zip(pos.to_pylist(), ref.to_pylist(), alt.to_pylist(), left.to_pylist())]
    types = (pa.int32(), pa.string(), pa.string(), pa.bool_())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["pos", "ref", "alt", "done"])


def _steady(ref: Column, alt: Column) -> Column:
    """Whether alignment leaves a record of upper-case alleles as it is, wherever it lies: their last bases differ, so it can't
    move, and so do the first ones, or one allele is one base, so nothing can be trimmed."""
    short = F.least(F.length(ref), F.length(alt)) == 1
    apart = F.substring(ref, -1, 1) != F.substring(alt, -1, 1)
    return (ref == F.upper(ref)) & (alt == F.upper(alt)) & ((ref == alt) & short | apart & (short | (F.substring(ref, 1, 1) != F.substring(alt, 1, 1))))


def _from_blocks(moving: DataFrame, blocks: DataFrame, block_size: int, window: int) -> DataFrame:
    """moving with _left, the bases to the left of each record as far as window and the block of the base before it reach (null
    off the contig): records meet their blocks in one join, and no sequence travels."""
    at = F.col("pos") - 2
    asked = moving.withColumn("_block", F.floor(at / block_size).cast("int"))
    # bytes: a place in them is found without a walk through the block's letters
    sequences = blocks.select("chrom", F.col("block").alias("_block"), F.col("seq").cast("binary").alias("_seq"))
    # size estimates don't see the blocks' sequences: a broadcast by these would bring the whole reference to the driver
    met = asked.hint("merge").join(sequences.hint("merge"), ["chrom", "_block"], "left")
    reach = at - F.col("_block") * block_size + 1
    n = F.least(reach, F.lit(window))
    left = F.when(F.length("_seq") >= reach, F.upper(F.substring(F.col("_seq"), (reach - n + 1).cast("int"), n.cast("int")).cast("string")))
    return met.withColumn("_left", left).drop("_block", "_seq")


def _from_spans(moving: DataFrame, blocks: DataFrame, block_size: int, window: int) -> DataFrame:
    """moving with _left, window bases to the left of each record, over as many blocks as they take."""
    asked = moving.withColumns({"_from": F.greatest(F.col("pos") - window, F.lit(1)), "_to": F.col("pos") - 1})
    found = sequences_of(asked.select("chrom", F.col("_from").alias("first"), F.col("_to").alias("last")), blocks, block_size)
    found = found.select("chrom", F.col("first").alias("_from"), F.col("last").alias("_to"), F.upper("seq").alias("_left"))
    return asked.join(found, ["chrom", "_from", "_to"], "left").drop("_from", "_to")


def left_align(df: DataFrame, blocks: DataFrame, block_size: int, window: int = WINDOW) -> DataFrame:
    """df with the alleles of sequence records trimmed and moved to their leftmost place; others (symbolic, breakends, several
    ALTs, off the contig) stay as they are. Records must agree with the reference (check_reference).

    Records that alignment can't change ask for nothing. The others go to their block once; those that move out of it (or by
    more than window) fetch bases in rounds, four times as many as the one before, and a record leaves when it stops. Rounds
    are tables; their number grows with the logarithm of the longest repeat."""
    compiled(df.sparkSession)
    plain = F.col("ref").rlike(BASES) & F.col("alt").rlike(BASES) & (F.col("pos") >= 1)
    marked = written(df.withColumn("_moves", F.coalesce(plain & ~_steady(F.col("ref"), F.col("alt")), F.lit(False))), "left-align")
    out = marked.where("not _moves").select(*df.columns)
    moving, lookup = marked.where("_moves").drop("_moves").withColumn("_was", F.struct("pos", "ref", "alt")), _from_blocks
    while True:
        seen = lookup(moving, blocks, block_size, window)
        known = F.col("_left").isNotNull() | (F.col("pos") == 1)
        new = F.when(known, _moved(F.col("pos").cast("int"), F.upper("ref"), F.upper("alt"), F.coalesce("_left", F.lit(""))))
        step = written(seen.withColumn("_new", new).drop("_left"), "left-align")
        still = F.coalesce(~F.col("_new.done"), F.lit(False))
        place = {c: F.coalesce(F.col(f"_new.{c}"), F.col(f"_was.{c}")) for c in ("pos", "ref", "alt")}
        out = out.unionByName(step.where(~still).withColumns(place).select(*df.columns))
        moving = written(step.where(still).withColumns(place).drop("_new"), "left-align")
        if moving.isEmpty():
            return out
        window, lookup = window * 4, _from_spans
