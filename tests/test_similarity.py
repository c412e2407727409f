"""Edit distance within a limit, sequence similarity of alleles, matching and collapse against plain rules."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varspan.functions import similarity as SM
from varspan.operators import proximity
from varspan.operators.collapse import collapse, similar_pairs
from varspan.shared import written


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


dna = st.text("ACGT", max_size=80)


@settings(max_examples=300, deadline=None)
@given(dna, dna, st.integers(0, 80))
def test_distance(a, b, limit):
    assert SM.distance_within(a, b, limit) == min(plain_distance(a, b), limit + 1)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=60, max_size=200), st.lists(st.tuples(st.integers(0, 199), st.sampled_from(["", "A", "CG"])), max_size=12))
def test_distance_of_edited_copies(a, edits):
    b = a
    for at, new in edits:
        b = b[:at] + new + b[at + 1 :]
    true = plain_distance(a, b)
    assert SM.distance_within(a, b, 500) == true and SM._word_bound(a, b) <= true
    assert true == 0 or SM.distance_within(a, b, true - 1) == true


def mutated(rnd, seq, rate):
    return "".join(rnd.choice(["", x + rnd.choice("ACGT"), rnd.choice("ACGT")]) if rnd.random() < rate else x for x in seq)


def test_long_alleles(spark):
    """Beyond any limit of length: copies of 5 and 30 kb, equal, near and far."""
    rnd = random.Random(3)
    rows = []
    for k, length in enumerate((5000, 30000)):
        seq = "".join(rnd.choices("ACGT", k=length))
        for n, alt in enumerate([seq, seq, mutated(rnd, seq, 0.03), mutated(rnd, seq, 0.6), "".join(rnd.choices("ACGT", k=length)), "<INS>"]):
            rows.append((f"v{k}{n}", "c", 1000 * k + n, "INS", length, n, "A", "A" + alt if n < 5 else alt))
    df = spark.createDataFrame(rows, "id string, chrom string, pos int, svtype string, svlen int, qual int, ref string, alt string")
    got = {(r.better, r.worse) for r in similar_pairs(df, 100, 0.9, 0.95).collect()}
    near = {(f"v{k}{a}", f"v{k}{b}") for k in (0, 1) for a, b in ((1, 0), (2, 0), (2, 1))}
    symbolic = {(f"v{k}5", f"v{k}{n}") for k in (0, 1) for n in range(5)}  # by length alone
    assert got == near | symbolic


def plain_seq_similar(x, y, least):
    if x is None or y is None:
        return True
    return (len(x) + len(y) - plain_distance(x, y)) >= least * (len(x) + len(y))


@pytest.mark.parametrize("options", [dict(), dict(sequence=0.8), dict(overlap=0.6), dict(both_ends=True), dict(sequence=0.9, overlap=0.3, both_ends=True)])
def test_truth_candidates(spark, options):
    rnd, rows = random.Random(11), []
    base = "".join(rnd.choices("ACGT", k=200))
    for i in range(70):
        kind, n = rnd.choice(["INS", "DEL", "DUP"]), rnd.choice([40, 44, 60, 150])
        seq = mutated(rnd, base[:n], rnd.choice([0, 0.05, 0.5]))
        ref, alt = ("a", "a" + seq) if kind == "INS" else ("A" + seq, "A") if kind == "DEL" else ("N", "<DUP>")
        rows.append((f"v{i:02}", rnd.choice("cd"), rnd.randrange(1, 300), kind, n, ref, alt))
    schema = "id string, chrom string, pos int, svtype string, svlen int, ref string, alt string"
    left, right = rows[:35], rows[35:]
    got = {(r.base_id, r.comp_id) for r in proximity.truth_candidates(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 40, 0.7, **options).collect()}

    def fits(a, b):
        seqs = [None if r[6] == "<DUP>" else max(r[6].upper(), r[5].upper(), key=len) for r in (a, b)]
        ends = [r[2] + r[4] for r in (a, b)]
        shared = min(ends) - max(a[2], b[2])
        return (
            a[1] == b[1] and a[3] == b[3] and abs(a[2] - b[2]) <= 40 and min(a[4], b[4]) / max(a[4], b[4]) >= 0.7
            and (not options.get("both_ends") or abs(ends[0] - ends[1]) <= 40)
            and shared >= options.get("overlap", -9) * max(a[4], b[4])
            and (not options.get("sequence") or plain_seq_similar(*seqs, options["sequence"]))
        )

    expected = {(a[0], b[0]) for a in left for b in right if fits(a, b)}
    assert expected and got == expected


def test_bounds_never_drop_a_similar_pair(spark):
    rnd, rows = random.Random(5), []
    for _ in range(300):
        a = "".join(rnd.choices("ACGTN", k=rnd.randrange(1, 60)))
        rows.append((a, mutated(rnd, a, rnd.random() * 0.4) or "A"))
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", SM.may_be_similar(a, b, 0.9).alias("maybe"), SM.similar(a, b, 0.9).alias("yes")).collect()
    for r in got:
        assert r.yes == plain_seq_similar(r.a, r.b, 0.9) and (r.maybe or not r.yes)


def test_collapse_query_is_the_sequential_rule(spark, sf):
    """The registered query over its whole table, best record first."""
    from varspan.plans.catalog import QUERIES
    from varspan.plans.proxies import Tables

    rows = sorted(map(tuple, Tables(spark, sf).v.select("qual", "pos", "id", "chrom", "svtype", "svlen").collect()), key=lambda r: (-r[0], *r[1:3]))
    near, keeper = {}, {}
    for r in rows:
        kept = near.setdefault((r[3], r[4]), [])
        best = next((k for k in kept if abs(k[1] - r[1]) <= 100 and min(k[5], r[5]) >= 0.9 * max(k[5], r[5])), None)
        keeper[r[2]] = best[2] if best else r[2]
        if not best:
            kept.append(r)
    assert {r.id: r.keeper for r in QUERIES["wn18_collapse"](spark, sf).collect()} == keeper


def test_single_match_query_is_the_sequential_rule(spark, sf):
    from varspan.plans.catalog import QUERIES
    from varspan.plans.proxies import Tables

    v = Tables(spark, sf).v
    found = proximity.truth_candidates(v.where("caller = 'F'"), v.where("caller = 'O'"), 100, 0.7).collect()
    expected, used = set(), (set(), set())
    for r in sorted(found, key=lambda r: (-r.score, r.dstart, r.dend, r.base_id, r.comp_id)):
        if r.base_id not in used[0] and r.comp_id not in used[1]:
            expected.add((r.base_id, r.comp_id)), used[0].add(r.base_id), used[1].add(r.comp_id)
    assert {(r.base_id, r.comp_id) for r in QUERIES["jn21_truth_single"](spark, sf).collect()} == expected


def test_collapse_with_sequences(spark):
    rows = [("a", "c", 10, "INS", 4, 5, "A", "AACGT"), ("b", "c", 12, "INS", 4, 4, "A", "AACGT"), ("d", "c", 14, "INS", 4, 3, "A", "AGGGG")]
    df = spark.createDataFrame(rows, "id string, chrom string, pos int, svtype string, svlen int, qual int, ref string, alt string")
    got = {r.id: r.keeper for r in collapse(df, similar_pairs(df, 10, 0.9, 0.9), written).collect()}
    assert got == {"a": "a", "b": "a", "d": "d"}


def executed(df):
    """The final plan of a query that has run."""
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]


def test_similar_sequences_shuffles_rows_once(spark, sf):
    """One exchange for both sides of the join, and pairs are made once for easy and hard sequences."""
    from varspan.plans.catalog import QUERIES

    out = QUERIES["wn18_similar_sequences"](spark, sf)
    assert len(out.collect()) > 0
    text = executed(out)
    assert text.count("SortMergeJoin") == 1 and "Union" not in text
    assert text.count("ReusedExchange") == 1 and text.count("Exchange hashpartitioning") == 2  # one of them is the reused one's name


@pytest.mark.parametrize("distance", [0, 1, 30, 5000])
def test_close_pairs(spark, distance):
    """Against all pairs: bin borders, positions below zero, repeated rows and nulls."""
    rnd = random.Random(distance)
    rows = [(rnd.choice(["c", "d"]), rnd.choice([rnd.randrange(-40, 60), 1024 * rnd.randrange(-2, 9) + rnd.randrange(-3, 3)]), rnd.choice("xy"), i) for i in range(150)]
    rows += rows[:3] + [(None, 5, "x", 900), ("c", None, "x", 901), ("c", 5, None, 902)]
    df = spark.createDataFrame(rows, "chrom string, start int, kind string, n int")
    got = sorted((r.a_n, r.b_n) for r in proximity.close_pairs(df, distance, ("kind",)).collect())
    kept = [r for r in rows if None not in r]
    assert got == sorted((x[3], y[3]) for x in kept for y in kept if x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) <= distance)


def test_collapse_rounds_hold_pairs_alone(spark):
    """Records in no pair are in no table of the rounds; ranks come from the pairs or from the records; repeated rows stay."""
    rows = [(f"n{i:03}", "c", 10000 * i, "INS", 50, i % 9) for i in range(300)]
    rows += [("a", "d", 10, "DEL", 50, 1), ("b", "d", 15, "DEL", 50, 5), ("e", "d", 20, "DEL", 50, 3), ("f", "d", 25, "DEL", 50, 5), ("g", "d", 32, "DEL", 50, 2), rows[0]]
    df = spark.createDataFrame(rows, "id string, chrom string, pos int, svtype string, svlen int, qual int")
    expected = sorted([(r[0], r[0]) for r in rows if r[0][0] == "n"] + [("a", "b"), ("b", "b"), ("e", "b"), ("f", "f"), ("g", "f")])
    for options in ({}, {"ranked": True}):
        sizes = []

        def counted(x):
            out = written(x)
            sizes.append(out.count())
            return out

        got = sorted(map(tuple, collapse(df, similar_pairs(df, 8, 0.9, **options), counted).collect()))
        assert got == expected and max(sizes) <= 4, sizes
    none = collapse(df, similar_pairs(df, 8, 2.0, ranked=True), written)
    assert sorted(map(tuple, none.collect())) == sorted((r[0], r[0]) for r in rows)


@pytest.mark.parametrize("pairs, message", [([("a", "b"), ("b", "c"), ("c", "a")], "circle"), ([("a", None)], "identifier"), ([(None, "a")], "identifier")])
def test_collapse_raises(spark, pairs, message):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1), (None, 1, 1)], "id string, pos int, qual int")
    with pytest.raises(ValueError, match=message):
        collapse(df, spark.createDataFrame([(*p, (1, 1, "x")) for p in pairs], "better string, worse string, rank struct<qual: int, pos: int, id: string>"), written)


def test_collapse_is_the_sequential_rule_where_chains_are_long(spark):
    """Dense records, many rounds, ties in quality."""
    rnd = random.Random(8)
    rows = [(f"r{i:03}", "c", rnd.randrange(0, 900), "INS", rnd.choice([50, 52, 90]), rnd.randrange(4)) for i in range(250)]
    df = spark.createDataFrame(rows, "id string, chrom string, pos int, svtype string, svlen int, qual int")
    kept, keeper = [], {}
    for r in sorted(rows, key=lambda r: (-r[5], r[2], r[0])):
        best = next((k for k in kept if abs(k[2] - r[2]) <= 6 and min(k[4], r[4]) >= 0.9 * max(k[4], r[4])), None)
        keeper[r[0]] = best[0] if best else r[0]
        kept += [] if best else [r]
    assert {r.id: r.keeper for r in collapse(df, similar_pairs(df, 6, 0.9, ranked=True), written).collect()} == keeper
