"""Hand-made cases with known answers, and properties on random tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varspan.functions import alleles as A
from varspan.functions import binning as B
from varspan.functions import genotypes as G
from varspan.functions import info as I
from varspan.functions import sequence as S
from varspan.operators import breakends, cohort, collapse, filters, greedy, intervals, islands, proximity, rewrite, scoring, statistics
from varspan.operators.chains import chain_breakpoints
from varspan.shared import written
from varspan.sources import sinks, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "pos,ref,alt,info,kind,size",
    [
        (1, "A", "ACGT", ".", "INS", 3),
        (1, "ACGT", "A", ".", "DEL", 3),
        (1, "ACG", "TTTT", ".", "SUB", 2),
        (100, "N", "<DUP:TANDEM>", "END=150", "DUP", 50),
        (100, "N", "<DEL>", "X;SVLEN=-7", "DEL", 7),
        (100, "N", "<INV>", "END=90", "INV", -1),
        (1, "A", "N]chr5:200]", ".", "BND", None),
        (1, "A", ".ACGT", ".", "BND", None),
        (1, "A", "*", ".", "UNK", 0),
    ],
)
def test_types_and_lengths(spark, pos, ref, alt, info, kind, size):
    cols = [F.lit(x) for x in (pos, ref, alt, info)]
    row = one(spark, A.svtype(cols[1], cols[2]).alias("k"), A.svlen(*cols).alias("n"))
    assert (row.k, row.n) == (kind, size)


def test_type_annotation_is_idempotent(spark):
    df = spark.createDataFrame([("c", 1, "i", "A", "ACG", 1.0, ".", "."), ("c", 2, "j", "N", "<DEL>", 1.0, ".", "SVLEN=-9;P")], "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string")
    once = rewrite.add_type_and_length(df)
    assert once.select("info").collect() == rewrite.add_type_and_length(once).select("info").collect()
    assert [r.info for r in once.collect()] == ["SVTYPE=INS;SVLEN=2", "SVLEN=9;P;SVTYPE=DEL"]


def test_type_that_is_there_stays(spark):
    rows = [("A", "ACGT", "SVTYPE=DUP;SVLEN=3"), ("A", "<DEL>", "SVTYPE=DELETION"), ("N", "<INS>", "."), ("A", "A[chr2:5[", "SVLEN=7"), ("AC", "GT", ".")]
    df = spark.createDataFrame([(10, *r) for r in rows], "pos int, ref string, alt string, info string")
    assert [r.info for r in rewrite.add_type_and_length(df).collect()] == ["SVTYPE=DUP;SVLEN=0", "SVTYPE=DEL", "SVTYPE=INS", "SVLEN=0;SVTYPE=BND", "SVTYPE=SUB;SVLEN=1"]
    assert [r.info for r in rewrite.fix_replacement_length(df).collect()][-1] == "."
    cells = spark.createDataFrame([("0|1", 9, 1), ("1|1", 0, 3), ("0/1", 9, 1), ("1", 9, 1), (".|1", 0, 0)], "gt string, ad_ref int, ad_alt int")
    assert [r.new_gt for r in rewrite.correct_genotypes(cells, 8, True).collect()] == ["0|0", "0|1", "0/0", "0", ".|1"]


def test_info_bag(spark):
    info = F.lit("A=1;FLAG;AB=2;A=3")
    row = one(spark, I.info_field(info, "A").alias("a"), I.info_field(info, "B").alias("b"), I.delete_info_field(F.lit("A=1"), "A").alias("d"), I.info_map(info).alias("m"), I.set_info_field(F.lit("."), "K", F.lit("v")).alias("s"))
    assert (row.a, row.b, row.d, row.s) == ("1", None, ".", "K=v") and row.m == {"A": "1", "FLAG": None, "AB": "2"}


def test_symmetrize_twice_is_the_same_adjacency(spark):
    df = spark.createDataFrame([(f"i{k}", "chr1", 100, "A", alt, ".") for k, alt in enumerate(["N]chr5:200]", "N[chr5:200[", "]chr5:200]N", "[chr5:200[N"])], "id string, chrom string, pos int, ref string, alt string, info string")
    once = rewrite.symmetrize(df)
    assert [r.alt for r in once.orderBy("id").collect()][0] == "N]chr1:100]" and {r.chrom for r in once.collect()} == {"chr5"}
    keys = []
    for d in (df, once, rewrite.symmetrize(once)):
        b = d.select("id", A.breakend(F.col("chrom"), F.col("pos"), F.col("alt")).alias("b")).select("id", "b.*")
        keys.append({r.id: r.key for r in b.select("id", breakends.canonical_key().alias("key")).collect()})
    assert keys[0] == keys[1] == keys[2]


def test_sequence_functions(spark):
    row = one(
        spark, S.entropy(F.lit("acgtacgt")).alias("e4"), S.entropy(F.lit("aaaa")).alias("e0"), S.entropy(F.lit("")).alias("none"), S.entropy(F.lit("acacacac"), 1).alias("k1"),
        S.runs(F.lit("aaccca")).alias("r"), S.reverse_complement(F.lit("ACGTx")).alias("rc"), S.autocorrelation(F.lit("abab"), 2).alias("ac"), S.changed_sequence(F.lit("A"), F.lit("G")).alias("cs"),
    )
    assert abs(row.e4 - math.log(4)) < 1e-9 and row.e0 == 0 and row.none == -1 and abs(row.k1) < 1e-9
    assert (row.r.runs, row.r.longest) == (0.5, 0.5) and row.rc == "NACGT" and row.ac == 0.5 and row.cs is None


@pytest.mark.parametrize("gt,n,het,miss,count", [("0/1", 1, True, False, 1), ("1|0", 1, True, False, 1), ("./1", 1, False, True, 1), (".", 0, False, True, -1), ("1", 1, False, False, 1), ("1/1", 2, False, False, 2), ("./.", 0, False, True, -1)])
def test_genotypes(spark, gt, n, het, miss, count):
    g = F.lit(gt)
    row = one(spark, G.n_alts(g).alias("n"), G.is_het(g).alias("h"), G.has_missing(g).alias("m"), G.gt_count(g).alias("c"))
    assert (row.n, row.h, row.m, row.c) == (n, het, miss, count)


def test_tiles_and_bins(spark):
    contigs = spark.createDataFrame([("c", 25)], "chrom string, length int")
    assert [(r.start, r.end) for r in intervals.tiles(contigs, 10).orderBy("start").collect()] == [(0, 10), (10, 20), (20, 25)]
    row = one(spark, B.edge_bin(F.lit(50), (50, 100)).alias("a"), B.lower_edge_bin(F.lit(50), (50, 100)).alias("b"), B.motif_fraction(F.lit("AC: 3/4")).alias("m"), B.motif_fraction(F.lit(None).cast("string")).alias("z"))
    assert (row.a, row.b, row.m, row.z) == (0, 1, 0.75, -1.0)


spans = st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40000), st.sampled_from([0, 1, 3, 50, 3000, 9000, 70000])), max_size=25)


@settings(max_examples=12, deadline=None)
@given(a=spans, b=spans, slack=st.sampled_from([0, 7]))
def test_overlap_join_equals_brute_force(spark, a, b, slack):
    schema = "id long, chrom string, start int, end int"
    x = [(i, c, s, s + n) for i, (c, s, n) in enumerate(a)]
    y = [(i, c, s, s + n) for i, (c, s, n) in enumerate(b)]
    got = intervals.overlap_join(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), slack)
    expected = sorted((i, j) for i, c, s, e in x for j, d, u, v in y if c == d and s < v + slack and u - slack < e)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == expected


def test_overlap_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([("a", 1, 2)], "chrom string, start int, end int")
    plan = intervals.overlap_join(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=10, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 300), st.integers(1, 30)), min_size=1, max_size=40), block=st.sampled_from([7, 50, 10**6]))
def test_merge_in_blocks_equals_one_scan(spark, rows, block):
    from varspan.operators import scan

    df = spark.createDataFrame([("c", s, s + n, i) for i, (s, n) in enumerate(rows)], "chrom string, start int, end int, id long")
    reach = scan.running_max_before(df, ["chrom"], "start", ["end", "id"], F.col("end"), "r", block)
    got = {r.id: r.r for r in reach.collect()}
    count = {r.id: r.n for r in scan.running_sum(df, ["chrom"], "start", ["end", "id"], F.lit(1), "n", block).collect()}
    most = None
    for k, (s, e, i) in enumerate(sorted((s, s + n, i) for i, (s, n) in enumerate(rows))):
        assert got[i] == most and count[i] == k + 1
        most = e if most is None else max(most, e)


def test_chunk_plan_keeps_records(spark):
    rows = [("c", k, f * 100, f * 100 + 10, n) for k, (f, n) in enumerate([(1, 3), (2, 1), (3, 5), (4, 2), (5, 1)])]
    totals = spark.createDataFrame(rows, "chrom string, island long, first long, last long, n long")
    got = [(r.chunk, r.first, r.last, r.n) for r in greedy.chunk_plan(totals, 4).orderBy("chunk").collect()]
    assert got == [(1, 100, 210, 4), (2, 300, 310, 5), (3, 400, 510, 3)]


def greedy_collapse(rows, similar):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[0])):
        keeper = next((k for k in sorted((k for k in rows if out.get(k[0]) == k[0]), key=lambda k: (-k[4], k[2], k[0])) if similar(k, r)), None)
        out[r[0]] = keeper[0] if keeper else r[0]
    return out


def test_collapse_is_the_sequential_rule(spark):
    import random

    rnd = random.Random(4)
    rows = [(f"v{i:02}", "c", rnd.randrange(400), rnd.choice([50, 52, 80]), rnd.randrange(5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, chrom string, pos int, svlen int, qual int").withColumn("svtype", F.lit("DEL"))
    pairs = collapse.similar_pairs(df, 20, 0.9)
    got = {r.id: r.keeper for r in collapse.collapse(df, pairs, written).collect()}
    assert got == greedy_collapse(rows, lambda a, b: abs(a[2] - b[2]) <= 20 and min(a[3], b[3]) / max(a[3], b[3]) >= 0.9)


def test_single_match_is_the_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    rows = [(b, c, rnd.choice([0.8, 0.9, 1.0]), rnd.randrange(3), 0) for b in range(12) for c in range(12) if rnd.random() < 0.4]
    df = spark.createDataFrame(rows, "base_id long, comp_id long, score double, dstart int, dend int")
    got = {(r.base_id, r.comp_id) for r in proximity.match_single(df, written).collect()}
    expected, used_b, used_c = set(), set(), set()
    for b, c, s, d, e in sorted(rows, key=lambda r: (-r[2], r[3], r[4], r[0], r[1])):
        if b not in used_b and c not in used_c:
            expected.add((b, c))
            used_b.add(b)
            used_c.add(c)
    assert got == expected


def test_single_match_pairs_large_tied_groups(spark):
    rows = [(b, c, 1.0, 0, 0) for b in range(60) for c in range(100, 155)]
    df = spark.createDataFrame(rows, "base_id long, comp_id long, score double, dstart int, dend int")
    assert sorted((r.base_id, r.comp_id) for r in proximity.match_single(df, lambda x: x.localCheckpoint()).collect()) == [(i, 100 + i) for i in range(55)]


def test_collapse_loses_no_record_silently(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "id string, pos int, qual int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "better string, worse string")
    with pytest.raises(ValueError):
        collapse.collapse(df, pairs, lambda x: x.localCheckpoint()).collect()


def test_trios_and_hardy_weinberg(spark):
    cells = spark.createDataFrame(
        [("v1", "c", "0/1", 5, 5), ("v1", "f", "0/0", 9, 0), ("v1", "m", "0/0", 9, 0), ("v2", "c", "0/1", 5, 5), ("v2", "f", "0/1", 5, 5), ("v2", "m", "./.", 0, 0), ("v3", "c", "1/1", 0, 9), ("v3", "f", "1/1", 0, 9), ("v3", "m", "0/0", 9, 0)],
        "variant_id string, sample_id string, gt string, ad_ref int, ad_alt int",
    )
    ped = spark.createDataFrame([("c", "f", "m"), ("x", "0", "m")], "child string, father string, mother string")
    table = statistics.trios(cells, ped)
    r = statistics.de_novo_rate(table, "child").first()
    assert (r.den, r.num, r.rate) == (2, 1, 0.5)
    m = statistics.mendelian(table, "child").first()
    assert (m.good_alt, m.errors) == (0, 2)
    hw = spark.createDataFrame([("a", 25, 50, 25), ("b", 50, 0, 50), ("c", 10, 0, 0)], "variant_id string, aa long, ab long, bb long")
    got = {r.variant_id: (r.chi2, r["class"]) for r in statistics.hardy_weinberg_classes(hw).collect()}
    assert got["a"] == (0.0, "pass") and got["b"] == (100.0, "corrected") and got["c"] == (None, "pass")


def test_haplotypes(spark):
    members = spark.createDataFrame([("w", "s", 0, "r1", 2, 4, "T"), ("w", "s", 0, "r2", 3, 5, "G"), ("w", "s", 0, "r3", 6, 6, "CC")], "w string, sample_id string, hap int, record_id string, first int, last int, alt string")
    block = spark.createDataFrame([("w", 0, "ACGTACGT")], "w string, start int, seq string")
    row = cohort.haplotypes(members, ["w"], block).first()
    assert (row.seq, row.record_ids) == ("ACTACCCGT", ["r1", "r3"])
    haps = spark.createDataFrame([("w", "acg"), ("w", "ACG"), ("w", "T")], "w string, seq string")
    assert {(r.seq, r.n) for r in cohort.distinct_haplotypes(haps, ["w"]).collect()} == {("ACG", 2), ("T", 1)}


def test_chains(spark):
    rows = [("r", 0, 500, "chr1", 1000, 1500, False), ("r", 500, 900, "chr2", 100, 500, False), ("r", 900, 1200, "chr2", 505, 805, False), ("r", 100, 200, "chr9", 1, 101, True)]
    df = spark.createDataFrame(rows, "read_id string, read_start int, read_end int, chrom string, start int, end int, reverse boolean")
    got = sorted((r.type, r.chrom, r.pos, r.other_chrom, r.other_pos) for r in chain_breakpoints(df, 50).collect())
    assert got == [(1, "chr1", 1500, "chr2", 100), (4, "chr1", 1000, None, -1), (4, "chr2", 805, None, -1)]


def test_scoring(spark):
    rows = [(i, float(i % 10) if i % 7 else None, float(i % 3), int(i % 10 > 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = scoring.train_scorer(df, ["a", "b"], maxIter=3)
    scored = scoring.score(model, df, ["a", "b"])
    assert statistics.auc(scored, "score", "label").first().auc > 0.9
    table = scoring.calibration_table(scored)
    assert table.agg(F.max("sensitivity")).first()[0] == 1.0
    assert scoring.add_sensitivity(scored, table).where("sensitivity is null").count() == 0
    with pytest.raises(ValueError):
        scoring.train_scorer(df.withColumn("a", F.lit(None).cast("double")), ["a", "b"])
    with pytest.raises(ValueError):
        scoring.score(model, df, ["b", "a"])
    cells = spark.createDataFrame([(20 - k, k) for k in [0] * 60 + [10] * 60 + [20] * 60], "ad_ref int, ad_alt int")
    means = scoring.mixture_genotypes(cells)["means"]
    assert means[0] < 0.1 and 0.4 < means[1] < 0.6 and means[2] > 0.9


def test_mixture_keeps_the_ratio_of_deep_cells(spark):
    cells = spark.createDataFrame([(1000 - k, k) for k in [0] * 6 + [500] * 6 + [1000] * 6], "ad_ref int, ad_alt int")
    got = scoring.mixture_genotypes(cells, rounds=8)
    assert all(abs(w - 1 / 3) < 0.02 for w in got["weights"][:3]) and abs(got["means"][1] - 0.5) < 0.01


def test_text_sources(spark, tmp_path):
    vcf = tmp_path / "a.vcf"
    vcf.write_text("##contig=<ID=chr1,length=500>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t5\tx\tA\tACG\t.\tPASS\tK=1\tGT:DP\t0/1:7\t./.\n")
    assert text.vcf_header(spark, str(vcf)).first().length == 500
    sites = text.vcf_sites(spark, str(vcf))
    r = sites.first()
    assert (r.chrom, r.pos, r.alt, r.qual, r.info) == ("chr1", 5, "ACG", None, "K=1")
    cells = {c.sample_id: c for c in text.vcf_genotypes(sites, ["s1", "s2"]).collect()}
    assert cells["s1"].fields == {"GT": "0/1", "DP": "7"} and cells["s2"].gt == "./."
    sinks.write_vcf(sites, str(tmp_path / "out"))
    assert text.vcf_sites(spark, str(tmp_path / "out")).first().alt == "ACG"
    (tmp_path / "g.agp").write_text("chr1\t1\t10\t1\tW\tx\nchr1\t11\t20\t2\tN\t10\n")
    assert [(g.start, g.end) for g in text.assembly_gaps(spark, str(tmp_path / "g.agp")).collect()] == [(10, 20)]
    (tmp_path / "r.fa").write_text(">c1 d\nACGTA\nCGT\n>c2\nTT\n")
    blocks = {(b.chrom, b.block): b.seq for b in text.fasta_blocks(spark, str(tmp_path / "r.fa"), 5).collect()}
    assert blocks == {("c1", 0): "ACGTA", ("c1", 1): "CGT", ("c2", 0): "TT"}
    (tmp_path / "j.json").write_text('[{"ReferenceRegion": "chr1:10-20", "CanonicalMotif": "AC", "NumRepeatsInReference": 5}]')
    j = text.repeat_catalog(spark, str(tmp_path / "j.json")).first()
    assert (j.chrom, j.start, j.end, j.repeats, j.purity, j.motif_share) == ("chr1", 10, 20, 5.0, -1.0, -1.0)


def test_parity_and_filters(spark):
    for a, b, p in (("chr2", "chr4", 0), ("chr2", "chr3", 1), ("chr1", "chrX", 2), ("chr1", "chrUn", 3)):
        assert one(spark, rewrite.mate_parity(F.lit(a), F.lit(b)).alias("p")).p == p
    for name, standard in (("chr1", True), ("chr23", False), ("chrM", True), ("1", False)):
        assert one(spark, filters.standard_chromosome(F.lit(name)).alias("s")).s is standard
