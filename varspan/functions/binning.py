"""Binning rules and small numeric helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log10_bin(x: Column) -> Column:
    return F.when(x > 0, F.floor(F.log10(x))).cast("int")


def quantum_bin(x: Column, quantum: float) -> Column:
    return F.floor(x / quantum).cast("int")


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are below x: bins closed on the right, 0 up to the first edge."""
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def exact_edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """The position of x among the edges if it is one, else 0 (what a bare binary search gives for values between)."""
    at = F.array_position(F.array(*[F.lit(float(e)) for e in edges]), x.cast("double"))
    return F.greatest(at.cast("int") - 1, F.lit(0))


def lower_edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Half-open bins [edge, next edge), numbered from 1; 0 below the first edge."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def clamp(x: Column, least: int, most: int) -> Column:
    return F.least(F.greatest(x, F.lit(least)), F.lit(most))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def motif_fraction(text: Column) -> Column:
    """The share of 'motif: a/b', -1 where it can't be read."""
    a, b = (F.regexp_extract(text, ": *([0-9]+)/([0-9]+)", i).try_cast("double") for i in (1, 2))
    return F.coalesce(F.try_divide(a, b), F.lit(-1.0))


def four_decimals(x: Column) -> Column:
    return F.format_string("%.4f", x)


def subsample_factor(coverage: Column, target: float) -> Column:
    """The share of reads that brings a sample to the target coverage, 1 at most."""
    return F.least(F.try_divide(F.lit(float(target)), coverage), F.lit(1.0))
