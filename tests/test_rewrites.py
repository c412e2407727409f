"""Rewrites, routes and bins by hand-made cases: every branch of each rule."""

import pytest
from pyspark.sql import functions as F

from varspan.functions import info as I
from varspan.operators import filters, intervals, islands, proximity, rewrite

CALL = "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string"


def calls(spark, *rows):
    """rows: pos, ref, alt, info."""
    return spark.createDataFrame([("chr1", p, f"i{k}", r, a, 5.0, "PASS", i) for k, (p, r, a, i) in enumerate(rows)], CALL)


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("chr1", 24)], "chrom string, length int")


def test_materialize(spark, contigs):
    seq = "ACGTTGCAACGGTTAACCATGCAT"
    blocks = spark.createDataFrame([("chr1", k, seq[7 * k : 7 * k + 7]) for k in range(4)], "chrom string, block int, seq string")
    rows = [
        (3, "N", "<DEL>", "SVTYPE=DEL;SVLEN=9"), (3, "N", "<DEL>", "SVTYPE=DEL;SVLEN=9"),  # repeated rows stay
        (5, "N", "<inv>", "SVTYPE=INV;SVLEN=4"), (7, "N", "<DUP:TANDEM>", "SVTYPE=DUP;END=10;SVLEN=3;CIEND=0"),
        (1, "A", "ACG", "SVLEN=2"), (9, "N", "N[chr1:5[", "."),  # pass as they are
        (2, "N", "<INS>", "SVLEN=4"), (2, "N", "<CNV>", "SVLEN=4"), (2, "N", "<DEL>", "SVTYPE=DEL"), (2, "N", "<BND>", "SVLEN=1"),  # not enough to go by
        (20, "N", "<DEL>", "SVLEN=9"), (0, "A", "AC", "."), (25, "A", "AC", "."),  # over the end, off the contig
    ]
    got = sorted((r.id, r.ref, r.alt, r.info) for r in rewrite.materialize(calls(spark, *rows), blocks, 7, contigs).collect())
    assert got == [
        ("i0", seq[2:12], "G", "SVTYPE=DEL;SVLEN=9"), ("i1", seq[2:12], "G", "SVTYPE=DEL;SVLEN=9"),
        ("i2", "TGCAA", "TTTGC", "SVTYPE=INV;SVLEN=4"), ("i3", "C", "CAAC", "SVTYPE=INS;END=7;SVLEN=3;CIEND=0"),
        ("i4", "A", "ACG", "SVLEN=2"), ("i5", "N", "N[chr1:5[", "."),
    ]


def test_drop_orientation(spark):
    rows = [(1, "N", a, ".") for a in ("T]chr2:5]", "[chr2:5[GT", "]chr2:5]A", "GT[chr2:5[")]
    got = [r.alt for r in rewrite.drop_orientation(calls(spark, *rows)).orderBy("id").collect()]
    assert got == ["T[chr2:5[", "GT[chr2:5[", "A[chr2:5[", "GT[chr2:5["]


def test_end_on_every_record(spark, contigs):
    rows = [(3, "a", "acc", "SVLEN=2"), (3, "N", "<del-9>", "SVLEN=9;END=5"), (4, "N", "<ins>", "SVLEN=50"), (20, "N", "<DEL>", "SVLEN=9"), (25, "A", "AC", "SVLEN=1")]
    df = calls(spark, *rows).withColumn("svlen", I.info_field(F.col("info"), "SVLEN").cast("int"))
    got = [(r.ref, r.alt, r.info) for r in rewrite.fit_to_contigs(df, contigs).orderBy("id").collect()]
    assert got == [("A", "ACC", "SVLEN=2;END=3"), ("N", "<DEL>", "SVLEN=9;END=12"), ("N", "<INS>", "SVLEN=50;END=4")]


def test_clean_breakends_keep_letters(spark):
    rows = [(1, "ry", "gR[chrUn:5[", "."), (1, "n", "]chrx:7]yA", ".")]
    got = [(r.ref, r.alt, r.qual, r["filter"]) for r in rewrite.clean_breakends(calls(spark, *rows), 9).orderBy("id").collect()]
    assert got == [("RY", "GR[chrUn:5[", 9.0, "PASS"), ("N", "]chrx:7]YA", 9.0, "PASS")]


def test_restore_insertions(spark):
    rows = [
        (50, "N", "<DUP>", "SVTYPE=DUP;SVLEN=40;END=90;INSDUP;INS_POS=45;INS_ALT=ACGT;INS_SVLEN=3;INS_QUAL=7"),
        (50, "N", "<DUP>", "SVLEN=40;INS_POS=45;INS_ALT=ACGT;INS_QUAL=7;INSDUP"),
        (50, "N", "<DUP>", "SVTYPE=DUP;SVLEN=40;INS_POS=45"),
    ]
    got = [(r.pos, r.alt, r.qual, r.info) for r in rewrite.restore_insertions(calls(spark, *rows)).orderBy("id").collect()]
    assert got == [
        (45, "ACGT", 7.0, "SVTYPE=INS;SVLEN=3;END=45;INSDUP;INSDUP_POS=50;INSDUP_SVLEN=40"),
        (45, "ACGT", 7.0, "SVLEN=4;INSDUP;SVTYPE=INS;END=45;INSDUP_POS=50;INSDUP_SVLEN=40"),
        (50, "<DUP>", 5.0, "SVTYPE=DUP;SVLEN=40;INS_POS=45"),
    ]


def test_there_and_back(spark):
    """Insertions at gaps become duplications, and those insertions again."""
    ins = calls(spark, (230, "A", "ACCC", "SVTYPE=INS;SVLEN=120"), (231, "A", "AC", "SVTYPE=INS;SVLEN=120"), (70, "A", "AC", "SVTYPE=INS;SVLEN=100"), (69, "A", "AC", "SVTYPE=INS;SVLEN=100"), (150, "A", "AC", "SVTYPE=INS;SVLEN=9"))
    ins = ins.withColumn("svlen", I.info_field(F.col("info"), "SVLEN").cast("int"))
    gaps = spark.createDataFrame([("chr1", 100, 200), ("chrUn", 0, 9000)], "chrom string, start int, end int")
    dups, rest = proximity.gaps_to_duplications(ins, gaps, 30, 1.0)
    got = {r.id: (r.pos, r.alt, r.info) for r in dups.collect()}
    assert got["i0"] == (100, "<DUP>", "SVTYPE=DUP;SVLEN=100;END=200;INS_POS=230;INS_ALT=ACCC;INS_QUAL=5.0") and set(got) == {"i0", "i2"}
    assert {r.id for r in rest.collect()} == {"i1", "i3", "i4"}
    back = rewrite.restore_insertions(dups.withColumn("info", F.concat("info", F.lit(";INSDUP"))))
    assert {r.id: (r.pos, r.alt) for r in back.collect()} == {"i0": (230, "ACCC"), "i2": (70, "AC")}


def test_length_into_alt(spark):
    rows = [(1, "N", "<CN0>", "SVTYPE=DEL;SVLEN=-30"), (1, "N", "<INS>", "SVTYPE=INS;SVLEN=7"), (1, "N", "<DEL>", "SVLEN=7"), (1, "A", "AC", "SVTYPE=INS;SVLEN=1"), (1, "N", "<DUP>", "SVTYPE=DUP")]
    df = calls(spark, *rows)
    assert [r.alt for r in rewrite.length_into_alt(df).orderBy("id").collect()] == ["<DEL--30>", "<INS>", "<DEL>", "AC", "<DUP>"]
    assert [r.alt for r in rewrite.length_into_alt(df, True).orderBy("id").collect()] == ["<DEL--30>", "<INS-7>", "<DEL>", "AC", "<DUP>"]


def test_assembly_calls(spark):
    df = calls(spark, (1, "A", "ACCCC", "X=1"), (1, "ACCCC", "A", "."), (1, "AC", "GT", "."), (1, "A", "ACCCC", "."))
    df = df.withColumn("filter", F.when(F.col("id") == "i0", "pass").when(F.col("id") == "i3", "LowQual").otherwise("."))
    got = [(r.id, r["filter"], r.info) for r in rewrite.assembly_calls(df, 4).orderBy("id").collect()]
    assert got == [("i0", "PASS", "SVTYPE=INS;SVLEN=4"), ("i1", "PASS", "SVTYPE=DEL;SVLEN=4")]


def test_routes(spark):
    rows = [("del", 60), ("DUP:Tandem", -60), ("INS:NOVEL", 60), ("CNV", 60), ("BND", 60), ("INVDUP", 60), ("INV", 49), (None, 60)]
    got = {r.svtype: r.route for r in filters.by_class(spark.createDataFrame(rows, "svtype string, svlen int"), 50).collect()}
    assert {k for k, v in got.items() if v == "sv"} == {"del", "DUP:Tandem", "INS:NOVEL"}


def test_concordance(spark):
    rows = [  # read, first, last, contig, strand
        ("r", 0, 100, "chr1", True), ("r", 110, 200, "chr1", True), ("r", 500, 600, "chr1", True), ("r", 610, 700, "chr1", False), ("r", 710, 720, "chr2", True),
        ("u", 0, 9, "chrUn", True),
    ]
    df = spark.createDataFrame(rows, "read_id string, read_first int, read_last int, chrom string, strand boolean")
    got = {(r.read_id, r.read_first): r["class"] for r in islands.concordance(df, 50).collect()}
    assert got == {("r", 0): 0, ("r", 110): 1, ("r", 500): 1, ("r", 610): 2, ("r", 710): 3}


def test_coverage_bins(spark):
    contigs = spark.createDataFrame([("c", 1000)], "chrom string, length int")
    df = spark.createDataFrame([("a", "c", 100, 401)], "id string, chrom string, pos int, svlen int")
    got = {r.name: (r.start, r.end) for r in intervals.coverage_bins(df, contigs, 4, 51).collect()}
    assert got == {
        "a_before": (0, 100), "a_left": (75, 126), "a_bin0": (100, 200), "a_bin1": (200, 300), "a_bin2": (300, 400), "a_bin3": (400, 501), "a_right": (476, 527), "a_after": (501, 601),
    }
    assert {r.name for r in intervals.coverage_bins(df, contigs, 0, 51).collect()} == {"a_left", "a_right"}
    edge = {r.name: (r.start, r.end) for r in intervals.coverage_bins(df.withColumn("pos", F.lit(990)), contigs, 2, 20).collect()}
    assert edge["a_after"] == (1391, 1000) and edge["a_left"] == (980, 1000)


def test_nested_info_rewrites_stay_small(spark):
    info = F.lit(".")
    for k in range(12):
        info = I.set_info_field(info, f"K{k % 5}", F.lit(str(k)))
    df = spark.range(1).select(info.alias("i"))
    assert df.first().i == "K0=10;K1=11;K2=7;K3=8;K4=9"
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_hard_filter(spark):
    contigs = spark.createDataFrame([("chr1", 100000), ("chrY", 90000), ("chr13", 80000), ("small", 1900), ("bare", 50000)], "chrom string, length int")
    telomeres = [(c, 0, 100, "telomere") for c in ("chr1", "chrY", "chr13", "small")] + [(c, n - 50, n, "Telomere") for c, n in (("chr1", 100000), ("chrY", 90000), ("chr13", 80000), ("small", 1900))]
    others = [("chr1", 39000, 42500, "heterochromatin"), ("chrY", 60000, 89000, "heterochromatin"), ("chr13", 90, 30000, "short_arm"), ("elsewhere", 5, 6, "telomere")]
    schema = "chrom string, start int, end int, type string"
    gaps = spark.createDataFrame(telomeres + others, schema)
    centromeres = spark.createDataFrame([(c, 40000, 41000) for c in ("chr1", "chrY", "chr13")] + [("chr1", 40900, 42000), ("small", 900, 950)], "chrom string, start int, end int")
    got = sorted(map(tuple, intervals.hard_filter_regions(contigs, centromeres, gaps, bases=500).collect()))
    assert got == [
        ("bare", 0, 50000), ("chr1", 600, 38500), ("chr1", 43000, 99450), ("chr13", 41500, 79450), ("chrY", 600, 39500), ("chrY", 41500, 59500), ("small", 0, 1900),
    ]
    shares = sorted(map(tuple, intervals.hard_filter_regions(contigs, centromeres, gaps, share=0.1).where("chrom = 'chr1'").collect()))
    assert shares == [("chr1", 10100, 29000), ("chr1", 52500, 89950)]
    with pytest.raises(Exception, match="telomere inside"):
        intervals.hard_filter_regions(contigs, centromeres, spark.createDataFrame([("chr1", 5, 9, "telomere")], schema), bases=1).collect()


def plain_depth_steps(depth, known, b, ratio, top, least_step, least_median, tolerance):
    """A walk over one window; depth: a list, positions from 0."""
    n, ups, downs = len(depth), [], []
    for s in range(b, n - b + 1):
        left, right = sum(depth[s - b : s]), sum(depth[s : s + b])
        if left >= b * least_step and right / left >= ratio:
            ups.append((s if s == b else s - 1, left / b, right / left))
    for s in range(n - b, b - 1, -1):
        left, right = sum(depth[s - b : s]), sum(depth[s : s + b])
        if right >= b * least_step and left / right >= ratio:
            downs.append((s - 1 if s == n - b else s, right / b, left / right))
    ups, downs = (sorted(x, key=lambda y: -y[2])[:top] if len(x) > top else x for x in (ups, downs))
    best = None
    for u, low1, _ in ups:
        for d, low2, _ in downs:
            if d <= u or any(abs(s - u) <= tolerance and abs(e - d) <= tolerance for s, e in known):
                continue
            median = sorted(depth[u : d + 1])[(d - u + 1) // 2]
            if median >= least_median and median >= min(low1, low2) * ratio and (best is None or d - u > best[1] - best[0]):
                best = (u, d, median)
    return best


def test_depth_steps(spark):
    import random

    rnd, rows, expected, known = random.Random(8), [], [], []
    for w in range(12):
        level = [10] * rnd.randrange(15, 40) + [rnd.choice([14, 25, 40])] * rnd.randrange(20, 60) + [rnd.choice([2, 10, 12])] * rnd.randrange(15, 50)
        depth = [max(0, x + rnd.randrange(-2, 3)) for x in level]
        mine = []
        if w % 3 == 0 and (found := plain_depth_steps(depth, [], 6, 1.4, 8, 4, 12, 0)):
            mine = [found[:2]]
        known += [(w, *x) for x in mine]
        rows += [(w, p + 500, d) for p, d in enumerate(depth)]
        if best := plain_depth_steps(depth, mine, 6, 1.4, 8, 4, 12, 2):
            expected.append((w, best[0] + 500, best[1] + 500, best[2]))
    df = spark.createDataFrame(rows, "window int, pos int, depth int")
    meis = spark.createDataFrame([(w, s + 500, e + 500) for w, s, e in known], "window int, start int, end int")
    got = sorted(map(tuple, islands.depth_steps(df, 6, 1.4, 8, 4, 12, meis, 2).collect()))
    assert got == expected and known and len(expected) > 4
