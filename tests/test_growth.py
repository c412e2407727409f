"""What grows with the tables stays in shuffled joins: rows, levels and blocks that size estimates don't see."""

import pytest
from pyspark.sql import functions as F

from varspan.operators import intervals as IV
from varspan.operators import proximity as PX
from varspan.operators import rewrite as R
from varspan.plans import records
from varspan.plans.catalog import QUERIES
from varspan.plans.proxies import Tables

DRIVER_MEMORY = "calls_by_track jn04_overlap_share jn05_intersect jn10_first_gap jn10_gaps_to_duplications so06_first_match ag13_call_counts fl10_region_modes pr05_materialize".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start int, end int")


@pytest.mark.parametrize("name", DRIVER_MEMORY)
def test_exploded_rows_are_not_broadcast(spark, sf, name):
    """The join on bins or blocks itself is a sort-merge join, whatever the files' sizes are."""
    text = plan(QUERIES[name](spark, sf))
    joins = [line for line in text.splitlines() if "Join" in line and ("_bin#" in line or "block#" in line)]
    assert joins and all("SortMergeJoin" in j for j in joins), joins


def test_rows_go_to_levels_in_use_alone(spark):
    points = PX.points(spark.range(100).select(F.lit("c").alias("chrom"), F.col("id").cast("int").alias("pos")), "chrom", "pos", [])
    joined = PX.near(points, points, 10)
    assert plan(joined).count("SortMergeJoin") == 1 and "Union" not in plan(joined)
    assert joined.count() == sum(abs(x - y) <= 10 for x in range(100) for y in range(100))


@pytest.mark.parametrize("slack", [0, 7, 5000])
def test_overlap_join_over_levels(spark, slack):
    """Every mix of levels, empty sides too, against all pairs."""
    sizes = [0, 1, 50, 4096, 4097, 40000, 300000, 3_000_000, 200_000_000]
    a = [("c", 1000 * i, 1000 * i + n) for i, n in enumerate(sizes)]
    b = [("c", 500 * i + 3, 500 * i + 3 + n) for i, n in enumerate(reversed(sizes))]
    for left, right in ((a, b), (a[:3], b[:1]), (a[-1:], b[-3:]), (a[4:5], b), (a, []), ([], b)):
        got = sorted(map(tuple, IV.overlap_join(spans(spark, left), spans(spark, right), slack).collect()))
        assert got == sorted(x + y for x in left for y in right if x[1] < y[2] + slack and y[1] - slack < x[2])


def test_match_multi_computes_candidates_once(spark):
    ids = spark.createDataFrame([("a", "DEL"), ("b", "INS"), (None, "DUP")], "id string, svtype string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "base_id string, comp_id string")
    out = PX.match_multi(ids, ids, pairs, ("svtype",))
    assert sorted((r.side, str(r.id), r.svtype, r.state) for r in out.collect()) == [
        ("base", "None", "DUP", "fn"), ("base", "a", "DEL", "tp"), ("base", "b", "INS", "fn"),
        ("comp", "None", "DUP", "fp"), ("comp", "a", "DEL", "tp"), ("comp", "b", "INS", "tp"),
    ]
    out = QUERIES["jn21_truth_multi"](spark, "/root/testdata/sf0.001")
    assert plan(out).count("SortMergeJoin") + plan(out).count("BroadcastHashJoin") == 2


def test_reference_blocks(spark, sf):
    t = Tables(spark, sf)
    for size in (100, 4096):
        blocks = records.reference_blocks(t, size)
        assert "RoundRobin" in plan(blocks) or "hashpartitioning(chrom" in plan(blocks)  # not all in the one task of the contigs
        one = blocks.where("chrom = 'chr3'").orderBy("block").collect()
        length = t.contigs.where("chrom = 'chr3'").first().length
        places = spark.range(1, length + 1).selectExpr(f"collect_list({records.letter('id')}) as x").first().x
        assert "".join(r.seq for r in one) == "".join(places) and [r.block for r in one] == list(range(len(one)))


def test_sequences_of_shuffles_blocks(spark):
    blocks = spark.createDataFrame([("c", 0, "ACGT"), ("c", 1, "TTA")], "chrom string, block int, seq string")
    wanted = spark.createDataFrame([("c", 2, 6), ("c", 7, 7), ("c", 7, 8), ("d", 1, 1)], "chrom string, first int, last int")
    out = R.sequences_of(wanted, blocks, 4)
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [("c", 2, 6, "CGTTT"), ("c", 7, 7, "A")]


@pytest.mark.parametrize("nodes", [3, 8, 1 << 13])
def test_followed_over_blocks(spark, monkeypatch, nodes):
    """Only the nodes where paths enter a block go through the rounds; every path, ends inside blocks too."""
    import random

    from varspan.operators import greedy as GR

    monkeypatch.setattr(GR, "NODES", nodes)
    rnd, rows, expected, doubled = random.Random(nodes), [], [], []
    for chrom, n in (("a", 60), ("b", 1), ("c", 37)):
        to = {i: rnd.randrange(i + 1, i + 6) for i in range(-1, n)}
        to = {i: min(j, n - 1) for i, j in to.items() if i < n - 1}
        rows += [(chrom, i, j) for i, j in to.items()]
        at = GR.START
        while at in to:
            at = to[at]
            expected.append((chrom, at))
    inner = GR._doubled
    monkeypatch.setattr(GR, "_doubled", lambda links: (doubled.append(links.count()), inner(links))[1])
    got = GR.followed(spark.createDataFrame(rows, "chrom string, node long, next long"))
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert doubled[0] < len(rows) / (2 if nodes > 3 else 1)


def test_islands_deal_rows_once(spark, sf):
    """No second full shuffle or join by sort for the numbers: one exchange of rows to blocks for each of two branches."""
    text = plan(QUERIES["wn01_islands"](spark, sf))
    assert "SortMergeJoin" not in text
    assert sum("Exchange hashpartitioning(chrom" in line and "_block" in line and "ENSURE" in line for line in text.splitlines()) <= 4


def test_depth_bounds_are_exact(spark):
    """A deviation of exactly 11 is not below 11, whatever the order of the rows; floating point says so for some only."""
    from varspan.operators import statistics as ST

    rows = [(f"v{x}", x + step) for x in range(32, 332) for step in [0] + [-11, 11] * (x % 9 + 2)] + [("one", 50), ("low", 20), ("low", 20), ("in", 21), ("in", 22), ("none", None)]
    df = spark.createDataFrame(rows, "variant_id string, dp int").repartition(3, "dp")
    assert df.groupBy("variant_id").agg(F.stddev_samp("dp").alias("d")).where("variant_id like 'v%' and d < 11").count() > 0
    got = ST.between_depths(df, "variant_id", 20, 11).collect()
    assert [(r.variant_id, r.mean, round(r.deviation, 6)) for r in got] == [("in", 21.5, 0.707107)]


def test_training_rows_are_spread(spark, monkeypatch):
    """However few splits the table has, no task trains on more than its share; small tables stay as they are."""
    from pyspark.ml.classification import GBTClassifier

    from varspan.operators import scoring as SC

    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows, *a: (seen.append(rows.rdd.glom().map(len).collect()), fit(self, rows, *a))[1])
    df = spark.range(0, 1000, 1, 1).selectExpr("id % 10 as a", "if(id % 7 = 0, null, id % 3) as b", "cast(id % 10 > 4 as int) as label")
    whole = SC.train_scorer(df, ["a", "b"], maxIter=2)
    monkeypatch.setattr(SC, "TRAINING_ROWS", 100, raising=False)
    spread = SC.train_scorer(df, ["a", "b"], maxIter=2)
    assert seen[0] == [1000] and sum(seen[1]) == 1000 and max(seen[1]) <= 101
    one, other = (sorted(map(tuple, SC.score(m, df, ["a", "b"]).selectExpr("a", "b", "round(score, 9)").distinct().collect()), key=str) for m in (whole, spread))
    assert one == other and len(one) > 1


def test_same_position_without_expansion(spark):
    """No row is written once a distinct count; nulls are no value."""
    from varspan.operators import statistics as ST

    rows = [
        ("a", 1, "DEL", 5, 10), ("a", 1, None, 5, 40), ("a", 2, "DEL", None, 7), ("a", 2, "INS", 3, 7), ("a", 3, "DEL", 1, 7), ("a", 4, None, None, None), ("a", 4, None, None, None),
        ("b", 1, "DEL", 1, 0), ("b", 1, "DEL", 2, 5), ("b", 1, "DUP", 2, 9), (None, None, "DEL", 1, 2), (None, None, "DEL", 1, 4),
    ]
    out = ST.same_position(spark.createDataFrame(rows, "chrom string, pos int, svtype string, qual int, svlen int"))
    assert "Expand" not in plan(out) and "SortAggregate" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        ("a", 1, 2, False, False, 30, 4.0), ("a", 2, 2, True, False, 0, 1.0), ("a", 4, 2, False, False, None, None),
        ("b", 1, 3, True, True, 9, None), (None, None, 2, False, False, 2, 2.0),
    ], key=str)


def test_trios_shuffle_cells_once(spark, sf):
    """Cells go to their samples, then to their trios; a join a role would send them again and again."""
    for name in ("ag01_de_novo_rate", "ag02_depth_histogram", "ag03_de_novo_by_depth", "ag09_mendelian"):
        moved = [line for line in plan(QUERIES[name](spark, sf)).splitlines() if "Exchange hashpartitioning(variant_id" in line or "REPARTITION_BY_COL" in line]
        assert len(moved) == 2, moved


def test_trios_of_repeated_rows(spark):
    """A trio for each choice of a child's, father's and mother's cell and of a line of the pedigree; one person may be both parents."""
    from varspan.operators import statistics as ST

    cells = [("v", "c", "0/1", 1, 2, 7), ("v", "c", "1/1", 3, 4, 8), ("v", "f", "0/0", 5, 6, 9), ("v", "m", None, None, 8, 9), ("v", "m", "0/1", 9, 9, 9), ("v", "d", "0/1", 2, 2, None)]
    cells += [("w", "c", "0/1", 1, 1, 1), ("w", "f", "0/1", 1, 1, 1), (None, "c", "0/1", 1, 1, 1), (None, "f", "0/1", 1, 1, 1), (None, "m", "0/1", 1, 1, 1), ("v", None, "0/1", 1, 1, 1)]
    lines = [("c", "f", "m"), ("c", "f", "m"), ("d", "f", "f"), ("m", "f", "0"), ("d", "f", None), ("f", "x", "m"), (None, "f", "m")]
    df = spark.createDataFrame(cells, "variant_id string, sample_id string, gt string, ad_ref int, ad_alt int, svlen int")
    out = ST.trios(df, spark.createDataFrame(lines, "child string, father string, mother string"), keep=["svlen"])
    expected = [
        (c[0], *line, *c[2:5], *f[2:5], *m[2:5], c[5])
        for line in lines if "0" not in line and None not in line
        for c in cells for f in cells for m in cells if c[0] and c[0] == f[0] == m[0] and (c[1], f[1], m[1]) == line
    ]
    columns = ["variant_id", "child", "father", "mother", *(f"{p}_{x}" for p in "cfm" for x in ("gt", "ref", "alt")), "svlen"]
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(expected, key=str) and len(expected) == 9


def test_type_and_length_name_steps(spark, sf):
    """No interpreted lambdas, alleles and INFO matched a few times a row, and row code that HotSpot compiles."""
    out = QUERIES["pr01_type_and_length"](spark, sf)
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.maxToStringFields")
    assert "lambda" not in text and text.count("RLIKE") <= 30
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_info_set_by_type(spark):
    """Signs of replacement patterns, repeated keys, keys that others end in, empty values and no INFO."""
    from varspan.functions import info as I

    infos = [".", None, "", "K=1", "A=1;K=2;K=3;F", "XK=1", "A;XK=2;K=", "K", "k=1;B=$1\\", "K=1;;A=2", "A=1\nK=2"]
    values = ["v", "$1", "a\\b$", ""]
    df = spark.createDataFrame([(i, v) for i in infos for v in values], "info string, v string")
    pair = df.select(I.set_info_field(F.col("info"), "K", F.col("v")).alias("x"), I.set_in_column(F.col("info"), "K", F.col("v")).alias("y")).collect()
    assert all(r.x == r.y for r in pair) and len(pair) == 44
    rows = [("A", "AC", "K=1;SVTYPE=$1x;SVLEN=9"), ("A", "<DEL>", "SVLEN=-5;XSVTYPE=INV"), ("AC", "A", None), (None, "A", "."), ("A", None, "SVTYPE=;A"), ("A", "<DUP>", "END=30")]
    df = spark.createDataFrame([(20, *r) for r in rows], "pos int, ref string, alt string, info string")
    assert [tuple(r)[3:] for r in R.add_type_and_length(df).collect()] == [
        ("K=1;SVTYPE=$1x;SVLEN=0", "$1x", 0), ("SVLEN=5;XSVTYPE=INV;SVTYPE=DEL", "DEL", 5), ("SVTYPE=DEL;SVLEN=1", "DEL", 1),
        ("SVTYPE=UNK", "UNK", 0), ("SVTYPE=UNK;A", "UNK", 0), ("END=30;SVTYPE=DUP;SVLEN=10", "DUP", 10),
    ]
