"""REF checks and left alignment against plain rules, over block borders, repeats and contig starts."""

import random

import pytest
from pyspark.sql import functions as F

from varspan.operators import reference as RF

CALL = "chrom string, pos int, id string, ref string, alt string, ref_state string"


@pytest.fixture(scope="module")
def genome():
    rnd = random.Random(2)
    repeat = "".join(rnd.choices("ACGT", k=13))
    return {"c1": "".join(rnd.choices("ACGT", k=90)) + "CA" * 160 + "GATTACA", "c2": "A" * 300 + "C" + "T" * 40, "c3": repeat * 30}


def tables(spark, genome, size):
    blocks = [(c, k, s[size * k : size * (k + 1)]) for c, s in genome.items() for k in range((len(s) - 1) // size + 1)]
    return spark.createDataFrame(blocks, "chrom string, block int, seq string"), spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chrom string, length int")


def plain_check(genome, chrom, pos, ref, alt):
    seq = genome.get(chrom, "")
    own = seq[pos - 1 : pos - 1 + len(ref)] if pos >= 1 else ""
    if len(own) < len(ref):
        return ref, alt, "off", 0
    if own == ref.upper():
        return ref, alt, "same", 0
    alts = alt.split(",")
    for k, a in enumerate(alts, 1):
        if a.isalpha() and set(a.upper()) <= set("ACGTN") and seq[pos - 1 : pos - 1 + len(a)] == a.upper():
            return a, ",".join(ref if i == k else x for i, x in enumerate(alts, 1)), "swapped", k
    return own, alt, "set", 0


@pytest.mark.parametrize("size", [7, 4096])
def test_check_reference(spark, genome, size):
    rnd, rows = random.Random(size), []
    for i in range(200):
        c = rnd.choice(list(genome) + ["cX"])
        seq = genome.get(c, "ACGT" * 20)
        pos = rnd.randrange(0, len(seq) + 3)
        true = seq[max(pos, 1) - 1 : max(pos, 1) - 1 + rnd.choice([1, 2, 9, 30])] or "A"
        other = "".join(rnd.choices("ACGTN", k=rnd.choice([1, 1, 4, 12])))
        ref, alt = rnd.choice([(true, other), (other, true), (true.lower(), other), ("N", "<DEL>"), (".", other), (other, f"{other[::-1]},{true}"), (other, "N[c1:5[")])
        rows.append((c, pos, f"i{i}", ref, alt, "clash"))
    rows.append(rows[0])
    blocks, contigs = tables(spark, genome, size)
    got = RF.check_reference(spark.createDataFrame(rows, CALL), blocks, size, contigs).collect()
    expected = sorted((c, p, i, *plain_check(genome, c, p, r, a)) for c, p, i, r, a, _ in rows)
    assert sorted((r.chrom, r.pos, r.id, r.ref, r.alt, r.ref_state, r.swapped_allele) for r in got) == expected
    assert {e[5] for e in expected} == {"off", "same", "swapped", "set"}


def test_swapped_genotypes(spark):
    rows = [("0/1", 1), ("0|2", 2), ("1/2", 2), ("./0", 1), ("1", 1), ("0/1", 0)]
    got = [r.g for r in spark.createDataFrame(rows, "gt string, k int").select(RF.swapped_genotype(F.col("gt"), F.col("k")).alias("g")).collect()]
    assert got == ["1/0", "2|0", "1/0", "./1", "0", "0/1"]


def plain_align(seq, pos, ref, alt):
    """One base at a time over the whole contig."""
    while ref != alt:
        if ref[-1] == alt[-1] and (min(len(ref), len(alt)) > 1 or pos > 1):
            ref, alt = ref[:-1], alt[:-1]
            if not ref or not alt:
                pos -= 1
                ref, alt = seq[pos - 1] + ref, seq[pos - 1] + alt
        else:
            break
    while min(len(ref), len(alt)) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


@pytest.mark.parametrize("size, window", [(7, 3), (64, 256)])
def test_left_align(spark, genome, size, window):
    rnd, rows, expected = random.Random(size), [], []
    for i in range(150):
        c = rnd.choice(list(genome))
        seq = genome[c]
        pos = rnd.randrange(1, len(seq) - 30)
        n, kind = rnd.choice([1, 2, 4, 13, 26]), rnd.choice(["del", "ins", "copy", "sub", "both"])
        ref, alt = {
            "del": (seq[pos - 1 : pos + n], seq[pos - 1]), "ins": (seq[pos - 1], seq[pos - 1] + "".join(rnd.choices("ACGT", k=n))),
            "copy": (seq[pos - 1], seq[pos - 1] + seq[pos : pos + n]), "sub": (seq[pos - 1], rnd.choice("ACGT")), "both": (seq[pos - 1 : pos + 5], seq[pos - 1 : pos + 2] + seq[pos + 4]),
        }[kind]
        rows.append((c, pos, f"i{i}", ref.lower() if i % 9 == 0 else ref, alt, "s"))
        expected.append((c, *plain_align(seq, pos, ref, alt), f"i{i}"))
    others = [("c1", 5, "s1", "N", "<DEL>", "s"), ("c1", 5, "s2", "A", "C,G", "s"), ("c1", 9999, "s3", "A", "AC", "s"), ("c1", 0, "s4", "A", "AC", "s"), rows[0]]
    blocks, _ = tables(spark, genome, size)
    got = sorted((r.chrom, r.pos, r.ref, r.alt, r.id) for r in RF.left_align(spark.createDataFrame(rows + others, CALL), blocks, size, window).collect())
    assert got == sorted(expected + [(c, p, r, a, i) for c, p, i, r, a, _ in others[:4]] + expected[:1])
    assert any(e[1] == 1 for e in expected)


def test_left_align_query(spark, sf):
    """The registered query over its whole table."""
    from varspan.plans import records
    from varspan.plans.catalog import QUERIES
    from varspan.plans.proxies import Tables

    def letter(p):
        return "ACGT"[((p // 6) ** 2 // 7 + p % 2 * 3) % 4]

    t = Tables(spark, sf)
    seqs = {r.chrom: "".join(map(letter, range(1, r.length + 1))) for r in t.contigs.collect()}
    expected = sorted((r.id, r.chrom, *plain_align(seqs[r.chrom], r.pos, r.ref, r.alt)) for r in records._indels(t).collect())
    got = sorted(map(tuple, QUERIES["pr32_left_align"](spark, sf).collect()))
    assert got == expected and len({g[2] for g in got}) > 50


def test_steady_records_are_those_that_stay(spark):
    """Whatever the bases to the left are: what counts as steady stays, and so no lookup is missed."""
    rnd = random.Random(4)
    rows = [("".join(rnd.choices("ACa", k=rnd.randrange(1, 5))), "".join(rnd.choices("ACa", k=rnd.randrange(1, 5)))) for _ in range(600)]
    got = spark.createDataFrame(rows, "ref string, alt string").withColumn("steady", RF._steady(F.col("ref"), F.col("alt"))).collect()
    for r in got:
        ends = [RF.moved_left(9, r.ref.upper(), r.alt.upper(), left) for left in ("GGGGGGGG", "AAAAAAAA", "ACACACAC", "CACACACA")]
        assert r.steady == all(e == (9, r.ref, r.alt, True) for e in ends), r


def test_left_align_sends_no_sequences_where_a_block_will_do(spark, genome, monkeypatch):
    """Steady records ask for nothing, others look into their block; only what moves out of it fetches spans."""
    asked, inner = [], RF.sequences_of
    monkeypatch.setattr(RF, "sequences_of", lambda spans, *a: (asked.append(spans.count()), inner(spans, *a))[1])
    blocks, _ = tables(spark, genome, 4096)
    rows = [("c1", 98, "m1", "ACA", "A", "s"), ("c1", 99, "m2", "CAC", "C", "s"), ("c2", 20, "m3", "A", "AA", "s"), ("c2", 305, "s1", "T", "TC", "s")]
    got = {r.id: (r.pos, r.ref, r.alt) for r in RF.left_align(spark.createDataFrame(rows, CALL), blocks, 4096).collect()}
    assert got == {i: plain_align(genome[c], p, r, a) for c, p, i, r, a, _ in rows} and asked == []
    blocks, _ = tables(spark, genome, 8)
    again = RF.left_align(spark.createDataFrame(rows, CALL), blocks, 8, 4)
    assert {r.id: (r.pos, r.ref, r.alt) for r in again.collect()} == got and asked and max(asked) < len(rows)
