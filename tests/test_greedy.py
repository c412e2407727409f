"""Greedy packing by links and pointer doubling against plain loops; scans with nulls."""

import random

import pytest

from varspan.operators import greedy, islands, rewrite, scan
from pyspark.sql import functions as F


def plain_plan(totals, least):
    out, part, n, first, last = [], 0, 0, None, None
    for _, _, f, e, size in sorted(totals):
        if n >= least:
            out.append((part + 1, first, last, n))
            part, n, first, last = part + 1, 0, None, None
        first, last, n = f if first is None else min(first, f), e if last is None else max(last, e), n + size
    return out + [(part + 1, first, last, n)]


@pytest.mark.parametrize("seed", [1])
def test_chunk_plan(spark, seed):
    rnd = random.Random(seed)
    rows = [(c, i + 1, 100 * i, 100 * i + rnd.randrange(400), rnd.choice([1, 1, 2, 5, 300])) for c in ("a", "b", "c") for i in range(rnd.choice([1, 7, 150]))]
    df = spark.createDataFrame(rows, "chrom string, island long, first long, last long, n long").repartition(3)
    for least in (4, 1000):
        got = sorted(map(tuple, greedy.chunk_plan(df, least).collect()))
        assert got == sorted((c, *x) for c in {r[0] for r in rows} for x in plain_plan([r for r in rows if r[0] == c], least))


def sequential_chunks(records, buffer, least):
    """(chunk, least first, greatest last, n) of records in order, a running maximum reset at each break."""
    out, n, lo, hi = [], 0, 0, 0
    for first, last in records:
        if first > hi + buffer and n >= least:
            out.append((lo, hi, n))
            n, lo, hi = 1, first, last
        else:
            n, lo, hi = n + 1, lo or first, max(hi, last)
    return out + [(lo, hi, n)]


def test_islands_and_plan_are_the_sequential_rule(spark):
    rnd = random.Random(7)
    rows = sorted((rnd.randrange(1, 60000), i) for i in range(900))
    records = [(p, p + rnd.choice([1, 3, 40, 700]), i) for p, i in rows]
    df = spark.createDataFrame([("c", *r) for r in records], "chrom string, first long, last long, id long")
    totals = islands.island_totals(islands.islands(df, "first", "last", 50, ["id"]), "first", "last")
    plan = greedy.chunk_plan(totals, 25)
    got = [tuple(r)[2:] for r in plan.orderBy("chunk").collect()]
    assert got == sequential_chunks([r[:2] for r in records], 50, 25) and len(got) > 5
    lines = greedy.region_lines(greedy.expect_total(plan, 900)).orderBy("chunk_id").first()
    assert tuple(lines) == (f"c:{got[0][0] - 5}-{got[0][1] + 5}", 0)
    with pytest.raises(ValueError):
        greedy.expect_total(plan, 901)


def span_loop(chunks, length, span, slack):
    """chunks: (start, end) in order."""
    out, at, reach = [], 0, 0
    for i, (_, end) in enumerate(chunks):
        reach = max(reach, end)
        if reach - at >= span:
            reach = length if i == len(chunks) - 1 else reach
            out.append((at, reach + slack))
            at = reach = reach + slack
    return out + [(at, length)] if reach < length else out


@pytest.mark.parametrize("seed", range(2))
def test_pack_by_span(spark, seed):
    rnd = random.Random(seed)
    chunks, lengths = {}, {}
    for c in "abcd":
        at, rows = rnd.randrange(500), []
        for _ in range(rnd.choice([1, 3, 60, 200])):
            rows.append((at, at + rnd.choice([10, 90, 400, 900])))
            at += rnd.choice([5, 100, 450])
        chunks[c], lengths[c] = sorted(rows), max(e for _, e in rows) + rnd.choice([-50, 0, 1, 2000])
    df = spark.createDataFrame([(c, s, e) for c, rows in chunks.items() for s, e in rows], "chrom string, start long, end long").repartition(3)
    contigs = spark.createDataFrame([*lengths.items(), ("empty", 100)], "chrom string, length int")
    for span, slack in ((300, 10), (10**6, 5)):
        got = sorted(map(tuple, greedy.pack_by_span(df, contigs, span, slack).collect()))
        assert got == sorted((c, *x) for c, rows in chunks.items() for x in span_loop(rows, lengths[c], span, slack))


def test_next_piece_starts_behind_the_slack(spark):
    df = spark.createDataFrame([("c", 0, 120), ("c", 130, 300), ("c", 310, 450), ("c", 460, 470)], "chrom string, start long, end long")
    contigs = spark.createDataFrame([("c", 1000)], "chrom string, length int")
    got = sorted(map(tuple, greedy.pack_by_span(df, contigs, 100, 10).collect()))
    assert got == [("c", 0, 130), ("c", 130, 310), ("c", 310, 460), ("c", 460, 1000)]


def test_no_task_by_contig(spark):
    df = spark.createDataFrame([("c", 1, 5, 9, 2)], "chrom string, island long, first long, last long, n long")
    plan = greedy.chunk_plan(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_chunk_bounds(spark):
    df = spark.createDataFrame([("c", 10, 20), ("c", 25, 400), ("c", 405, 406), ("c", 1500, 1501), ("d", 0, 1)], "chrom string, start int, end int")
    assert sorted(map(tuple, greedy.chunk_bounds(df, 1000).collect())) == [("c", 10, 406, 3), ("c", 1500, 1501, 1), ("d", 0, 1, 1)]


def test_label_runs_over_blocks(spark):
    rnd = random.Random(1)
    rows = [("u" if i % 5 else None, i, rnd.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "who string, at long, label string")
    expected = {}
    for who in ("u", None):
        run, before = 0, object()
        for _, at, label in [r for r in rows if r[0] == who]:
            run, before = (run + 1 if label != before or not run else run), label
            n, lo = expected.get((who, run, label), (0, at))
            expected[who, run, label] = (n + 1, lo)
    for block in (7, 10**6):
        got = {(r.who, r.run, r.label): (r.n, r["first"]) for r in islands.label_runs(df, ["who"], ["at"], "label", "at", block).collect()}
        assert got == expected


def test_null_positions_stay_and_move_nothing(spark):
    rows = [("chr1", p, "A", "T", i) for i, p in (("a", 100), ("b", None), ("c", 200), ("d", 2_500_000))] + [(None, 5, "A", "T", "e"), ("chr1", None, "A", "T", "f")]
    df = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, id string")
    got = {r.id: r.new_id for r in rewrite.rekey(df).collect()}
    assert got == {"a": "chr1_1", "c": "chr1_2", "d": "chr1_3", "b": "chr1_4", "f": "chr1_5", "e": "1"}
    reach = scan.running_max_before(df, ["chrom"], "pos", ["id"], F.col("pos"), "r")
    assert {r.id: r.r for r in reach.collect()} == {"a": None, "c": 100, "d": 200, "b": 2_500_000, "f": 2_500_000, "e": None}
    last = scan.previous_value(df, ["chrom"], "pos", ["id"], "id", "before", 50)
    assert {r.id: r.before for r in last.collect()} == {"a": None, "c": "a", "d": "c", "b": "d", "f": "b", "e": None}
