"""Sequence similarity of alleles of any length, by edit distance within a limit.

A pair is settled by the cheapest thing that can: lengths and letter counts (each edit changes a count of either side by one
at most) and equality as columns; then, in Arrow batches, what two sequences share at both ends is cut off, the counts of
their words of Q letters bound the distance (an edit touches Q words of either side at most), and only then it is computed,
bit-parallel over the shorter sequence, until it can no longer stay within the limit. All bounds are exact: none drops a pair
that is similar.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

Q = 6


def distance_within(a: str, b: str, limit: int) -> int:
    """The edit distance of two strings, or limit + 1 if it is larger."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    shared = 0
    while shared < len(a) and a[shared] == b[shared]:
        shared += 1
    a, b, shared = a[shared:], b[shared:], 0
    while shared < len(a) and a[-1 - shared] == b[-1 - shared]:
        shared += 1
    a, b = a[: len(a) - shared], b[: len(b) - shared]
    if not a:
        return min(len(b), limit + 1)
    if len(b) - len(a) > limit or _word_bound(a, b) > limit:
        return limit + 1
    return _bit_parallel(a, b, limit)


def _word_bound(a: str, b: str) -> int:
    """What the counts of words of Q letters say of the least distance."""
    from collections import Counter

    if len(a) < 4 * Q:
        return 0
    x, y = (Counter(s[i : i + Q] for i in range(len(s) - Q + 1)) for s in (a, b))
    apart = sum(abs(n - y[w]) for w, n in x.items()) + sum(n for w, n in y.items() if w not in x)
    return -(-apart // (2 * Q))


def _bit_parallel(a: str, b: str, limit: int) -> int:
    """Columns of the distance matrix as two bit vectors over a (steps up and down); b letter by letter."""
    m, left = len(a), len(b)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | 1 << i
    up, down, distance = full, 0, m
    for letter in b:
        left -= 1
        match = at.get(letter, 0)
        across = (((match & up) + up) ^ up) | match
        rises, falls = down | ~(across | up) & full, up & across
        if rises & top:
            distance += 1
        elif falls & top:
            distance -= 1
        if distance - left > limit:
            return limit + 1
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        match |= down
        up, down = falls | ~(match | rises) & full, rises & match
    return min(distance, limit + 1)


@F.arrow_udf(LongType())
def edit_distance_within(a: pa.Array, b: pa.Array, limit: pa.Array) -> pa.Array:
    """limit + 1 for pairs beyond the limit; null for null."""
    rows = zip(a.to_pylist(), b.to_pylist(), limit.to_pylist())
    return pa.array([None if x is None or y is None else distance_within(x, y, n) for x, y, n in rows], pa.int64())


def own_sequence(ref: Column, alt: Column) -> Column:
    """The longer allele, upper case; null for symbolic records and breakends."""
    dna = ref.rlike("^[A-Za-z]+$") & alt.rlike("^[A-Za-z]+$")
    return F.when(dna, F.upper(F.when(F.length(alt) >= F.length(ref), alt).otherwise(ref)))


def edits_allowed(a: Column, b: Column, similarity: float) -> Column:
    """Edits within which 1 - edits / (len(a) + len(b)) is `similarity` or more."""
    return F.floor((F.length(a) + F.length(b)) * (1 - similarity) + 1e-9)


def may_be_similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether lengths and letter counts leave room for the similarity."""
    counts = [[F.length(s) - F.length(F.replace(s, F.lit(x))) for s in (a, b)] for x in "ACGT"]
    more = [x - y for x, y in counts]
    gains, losses = (sum((F.greatest(sign * d, F.lit(0)) for d in more), F.lit(0)) for sign in (1, -1))
    return (F.abs(F.length(a) - F.length(b)) <= edits_allowed(a, b, similarity)) & (F.greatest(gains, losses) <= edits_allowed(a, b, similarity))


def similar(a: Column, b: Column, similarity: float) -> Column:
    """1 - edits / (len(a) + len(b)) is `similarity` or more. The distance is asked for in the column's own expression, so rows
    should be filtered by may_be_similar first."""
    limit = edits_allowed(a, b, similarity)
    return edit_distance_within(a, b, limit) <= limit
