"""Sequence complexity and orientation, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Letters other than ACGT (either case) become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgt", "TGCAtgca"))


def clean_sequence(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def changed_sequence(ref: Column, alt: Column) -> Column:
    """What a record adds or removes: REF of deletions, else ALT, without the anchor base; null when nothing is left."""
    deletion = (F.length(ref) > 1) & (F.length(alt) == 1)
    seq = F.substring(F.when(deletion, ref).otherwise(alt), 2, 1 << 30)
    return F.when(F.length(seq) > 0, F.lower(seq))


def _letters(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def entropy(seq: Column, k: int = 0) -> Column:
    """k-th order empirical entropy over acgt in nats; other letters are ignored; -1 if k letters or fewer are left.

    Single letters are counted by what removing them takes from the length; longer words from the array of all words of
    k + 1 letters. There are 4^(k + 1) of them, so k is meant to be small.
    """
    from itertools import product

    letters = F.regexp_replace(F.lower(seq), "[^acgt]", "")
    n = F.length(letters)

    def plogp(count: Column, total: Column) -> Column:
        return F.when(count > 0, -count / n * F.log(count / total)).otherwise(0.0)

    def of_counts(count) -> Column:
        total = F.lit(0.0)
        for context in map("".join, product("acgt", repeat=k)):
            counts = [count(context + c).cast("double") for c in "acgt"]
            seen = counts[0] + counts[1] + counts[2] + counts[3]
            for c in counts:
                total = total + plogp(c, seen)
        return total

    if k == 0:
        value = of_counts(lambda c: n - F.length(F.replace(letters, F.lit(c), F.lit(""))))
    else:
        words = F.transform(F.sequence(F.lit(1), n - k), lambda i: F.substring(letters, i, F.lit(k + 1)))
        value = F.element_at(F.transform(F.array(words), lambda w: of_counts(lambda x: F.size(F.filter(w, _same(x))))), 1)
    return F.when((n > k) & seq.isNotNull(), value).otherwise(-1.0)


def _same(word: str):
    return lambda g: g == word


def runs(seq: Column) -> Column:
    """Struct (runs, longest): number of runs of one letter, and the longest, over the length."""
    found = F.regexp_extract_all(seq, F.lit(r"(.)\1*"), F.lit(0))
    n = F.length(seq)
    return F.struct(
        F.try_divide(F.size(found).cast("double"), n).alias("runs"),
        F.try_divide(F.array_max(F.transform(found, F.length)).cast("double"), n).alias("longest"),
    )


def autocorrelation(seq: Column, lag: int) -> Column:
    """Positions equal to the one `lag` later, over the length."""
    letters = _letters(seq)
    n = F.length(seq)
    pairs = F.zip_with(letters, F.slice(letters, lag + 1, n), lambda a, b: (a == b).cast("int"))
    hits = F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(n > lag, hits.cast("double") / n)


def gc_fraction(seq: Column) -> Column:
    return F.try_divide((F.length(seq) - F.length(F.translate(seq, "GCgc", ""))).cast("double"), F.length(seq))


def low_complexity(seq: Column) -> Column:
    """1 where two different letters or fewer occur."""
    return (F.size(F.array_distinct(_letters(F.lower(seq)))) <= 2).cast("int")
