"""Similarity collapse: of similar records near each other, the best stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.functions.alleles import length_similarity
from varspan.functions.similarity import own_sequence
from varspan.operators.proximity import close_pairs, points, with_similar_sequences


def _rank(side: str = "") -> Column:
    return F.struct((-F.col(f"{side}qual")).alias("qual"), F.col(f"{side}pos").alias("pos"), F.col(f"{side}id").alias("id"))


def similar_pairs(df: DataFrame, distance: int, size: float, sequence: float | None = None, ranked: bool = False) -> DataFrame:
    """(better, worse) ids of records of one type within distance whose lengths are similar, and, if asked, their alleles'
    sequences of any length by edit distance (records without a sequence by length alone); better by quality, then position,
    then id; ranked: with the better one's rank. df: id, chrom, pos, svtype, svlen, qual, and ref and alt for sequences."""
    keep = ["id", "svtype", "svlen", "qual", "pos"]
    if sequence:
        df = df.withColumn("seq", own_sequence(F.col("ref"), F.col("alt")))
    at = points(df, "chrom", "pos", keep + ["seq"] * bool(sequence))
    pairs = close_pairs(at, distance, also=("svtype",))
    better = _rank("a_") < _rank("b_")
    pairs = pairs.where((length_similarity(F.col("a_svlen"), F.col("b_svlen")) >= size) & better)
    if sequence:
        pairs = with_similar_sequences(pairs, sequence)
    return pairs.select(F.col("a_id").alias("better"), F.col("b_id").alias("worse"), *[_rank("a_").alias("rank")] * ranked)


def collapse(df: DataFrame, pairs: DataFrame, materialize) -> DataFrame:
    """id, keeper: the greedy collapse by rank. A record that no undecided better record is similar to is kept, and takes
    its similar, still undecided ones; rounds go on until all are decided. That is the sequential rule (best first, each
    collapses what it is similar to), found for all neighbourhoods at once; materialize(df) returns df as a table. Raises
    where the pairs run in a circle, so that none of the undecided is best, or lack an identifier.

    Only pairs go through the rounds: a record in no pair, or whose pairs all left, keeps itself. pairs: better, worse, and the
    better one's rank; without it, it is looked up in df."""
    if "rank" not in pairs.columns:
        pairs = pairs.join(df.select(F.col("id").alias("better"), _rank().alias("rank")).distinct(), "better")
    open_pairs, decided, rounds = materialize(pairs), None, 0
    if not open_pairs.where("better is null or worse is null").isEmpty():
        raise ValueError("similar pairs without identifier")
    while not open_pairs.isEmpty():
        beaten = open_pairs.select(F.col("worse").alias("better")).distinct()
        # of several keepers that a record is similar to, the best comes first in rank: the least by its own order
        best = open_pairs.join(beaten, "better", "left_anti").groupBy(F.col("worse").alias("id")).agg(F.min_by("better", "rank").alias("keeper"))
        taken = materialize(best)
        if taken.isEmpty():
            raise ValueError("similar pairs run in a circle")
        decided = taken if decided is None else decided.unionByName(taken)
        rounds += 1
        if rounds % 20 == 0:  # keeps the plan of the union short
            decided = materialize(decided)
        gone = taken.select("id")  # a keeper's pairs leave with what it took
        open_pairs = materialize(
            open_pairs.join(gone.withColumnRenamed("id", "better"), "better", "left_anti").join(gone.withColumnRenamed("id", "worse"), "worse", "left_anti")
        )
    if decided is None:
        return df.select("id", F.col("id").alias("keeper"))
    return df.select("id").join(decided, "id", "left").select("id", F.coalesce("keeper", "id").alias("keeper"))
