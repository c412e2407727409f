"""Queries of the smaller operators: cell rewrites, counts, set operations, layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varspan.functions import binning as B
from varspan.functions import genotypes as G
from varspan.operators import cohort as CO
from varspan.operators import filters as FL
from varspan.operators import islands as IS
from varspan.operators import rewrite as R
from varspan.operators import scoring as SC
from varspan.operators import statistics as ST
from varspan.plans.proxies import register


@register("pr17_force_duplication", "v", "select id, '<DUP>' as alt, 'DUP' as svtype, concat('SVTYPE=DUP;SVLEN=', svlen) as info from v where svtype = 'INS'")
def _(t):
    ins = t.v.where("svtype = 'INS'").withColumn("info", F.concat(F.lit("SVTYPE=INS;SVLEN="), "svlen"))
    return R.force_duplication(ins).select("id", "alt", "svtype", "info")


@register(
    "pr21_copy_fields", "",
    """select l_partkey as k, max(case when l_linenumber = 1 then l_suppkey end)::varchar as own, max(case when l_linenumber = 2 then l_suppkey end)::varchar as copied
from lineitem group by 1 having count(*) filter (where l_linenumber = 1) > 0""",
)
def _(t):
    rows = t.table("lineitem").groupBy(F.col("l_partkey").alias("k"), "l_linenumber").agg(F.max("l_suppkey").cast("string").alias("s"))
    target = rows.where("l_linenumber = 1").select("k", F.create_map(F.lit("A"), "s").alias("fields"))
    source = rows.where("l_linenumber = 2").select("k", F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.col("s")).alias("fields"))
    return R.copy_fields(target, source, ["k"]).select("k", F.col("fields")["A"].alias("own"), F.col("fields")["B"].alias("copied"))


@register(
    "pr31_set_genotypes", "g",
    """select gt, case when contains(gt, '1') then gt else '0/1' end as carrier, case when regexp_full_match(gt, '[./|]+') then replace(gt, '.', '0') else gt end as reference, count(*) as n from g group by all""",
)
def _(t):
    gt = F.col("gt")
    return t.g.groupBy("gt", R.set_genotypes(gt, "carrier").alias("carrier"), R.set_genotypes(gt, "reference").alias("reference")).agg(F.count("*").alias("n"))


@register("pr29_sites_only", "calls", "select distinct chrom, pos, id, ref, alt, '0/1' as gt from calls")
def _(t):
    return R.sites_only(t.calls)


@register(
    "pr36_range_grid", "",
    "select least(p_size // 10, 4)::int as x, (p_retailprice > 1200)::int + (p_retailprice > 1500)::int as y, count(*) as n from part group by 1, 2",
)
def _(t):
    x, y = B.clamp(B.quantum_bin(F.col("p_size"), 10), 0, 4), B.edge_bin(F.col("p_retailprice"), (1200, 1500))
    return ST.histogram(t.table("part"), {"x": x, "y": y})


@register(
    "pr39_caller_table", "calls",
    """select id, coalesce(try_cast(nullif(regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1), '') as double), -1) as svlen, coalesce(try_cast(nullif(regexp_extract(info, '(?:^|;)END=([^;]*)', 1), '') as double), -1) as "end"
from calls where contains(id, '_7_')""",
)
def _(t):
    return R.caller_table(t.calls, "_7_", ["SVLEN", "END"])


@register(
    "fl03_presence", "g",
    """select variant_id, count(*) filter (where contains(gt, '1')) as carriers, count(*) filter (where replace(gt, '|', '/') in ('0/1', '1/0')) as hets from g group by 1 having count(*) filter (where contains(gt, '1')) >= 12""",
)
def _(t):
    gt = F.col("gt")
    counts = t.g.groupBy("variant_id").agg(F.count_if(G.n_alts(gt) > 0).alias("carriers"), F.count_if(G.is_het(gt)).alias("hets"))
    return FL.present(counts, t.g).where("carriers >= 12")


@register("fl05_expression", "v", "select id from v where svlen >= 200 and qual <= 5 and svtype in ('DEL', 'DUP')")
def _(t):
    return FL.of_types(t.v.where("svlen >= 200 and qual <= 5"), "DEL", "DUP").select("id")


@register(
    "fl06_frequency_split", "g",
    """, d as (select variant_id, count(*) filter (where contains(gt, '1')) as n from g group by 1), s as (select count(distinct sample_id) as s from g) select variant_id, n as n_discovery, n >= 0.02 * s as frequent from d, s""",
)
def _(t):
    samples = t.g.agg(F.count_distinct("sample_id")).first()[0]
    return FL.by_frequency(CO.discovery(t.g, "variant_id"), samples, 0.02).select("variant_id", "n_discovery", "frequent")


@register("fl09_depth_statistics", "g", "select variant_id, round(avg(dp), 6) as mean, round(stddev_samp(dp), 6) as deviation from g group by 1 having avg(dp) > 20 and stddev_samp(dp) < 11")
def _(t):
    return ST.between_depths(t.g, "variant_id", 20, 11).withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@register(
    "fl15_sample_subset", "g",
    """, s as (select * from g where sample_id in (select c_custkey::varchar from customer where c_nationkey = 3)) select variant_id, count(*) as cells from s group by 1 having count(*) filter (where contains(gt, '1')) > 0""",
)
def _(t):
    wanted = t.table("customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("sample_id"))
    cells = FL.listed(t.g, wanted, "sample_id")
    return FL.present(cells, cells).groupBy("variant_id").agg(F.count("*").alias("cells"))


@register(
    "jn11_split_remapped", "v",
    """, r as (select id, svlen, case qual % 3 when 0 then 'tandem_x' when 1 then 'partial' else 'novel' end as class, line * 100 as hit_distance from v where svtype = 'INS')
select 'dup' as kind, count(*) as n from r where class = 'tandem_x' or (class = 'partial' and hit_distance <= svlen) union all select 'ins', count(*) from r where class <> 'tandem_x'""",
)
def _(t):
    kind = F.when(F.col("qual") % 3 == 0, "tandem_x").when(F.col("qual") % 3 == 1, "partial").otherwise("novel")
    parts = R.split_remapped(t.v.where("svtype = 'INS'").withColumns({"class": kind, "hit_distance": F.col("line") * 100}))
    counted = [p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("dup", "ins"), parts)]
    return counted[0].unionByName(counted[1])


@register(
    "jn18_pedigree_coverage", "ped",
    """, c as (select c_custkey::varchar as id from customer where c_custkey % 5 <> 0) select child, father, mother from ped where child in (from c) and father in (from c) and mother in (from c)""",
)
def _(t):
    coverage = t.table("customer").where("c_custkey % 5 != 0").select(F.col("c_custkey").cast("string").alias("id"))
    ped = t.ped
    for role in ("child", "father", "mother"):
        ped = ped.join(coverage.withColumnRenamed("id", role), role, "left_semi")
    return ped.select("child", "father", "mother")


@register(
    "jn23_haplotype_calls", "",
    """, h as (select o_orderkey % 40 as hap, o_custkey % 30 as s, (o_orderkey % 3 = 0)::int as h1, (o_orderkey % 5 = 0)::int as h2 from orders), m as (select unnest(range(0, 40)) as hap),
e as (select hap, unnest([hap % 7, 100 + hap % 3]) as r from m) select r as record_id, s as sample_id, max(h1) || '|' || max(h2) as gt from h join e using (hap) group by 1, 2""".replace(", h as", "with h as", 1),
)
def _(t):
    o = t.table("orders")
    cells = o.select((F.col("o_orderkey") % 40).alias("hap_id"), (F.col("o_custkey") % 30).alias("sample_id"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("h1"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("h2"))
    members = t.spark.range(40).select(F.col("id").alias("hap_id"), F.array(F.col("id") % 7, 100 + F.col("id") % 3).alias("record_ids"))
    return CO.haplotype_calls(cells, members)


@register(
    "ag08_de_novo_multiallelic", "",
    """with a as (select repeat('A', p_size) as ref, unnest([repeat('C', p_size + p_partkey::int % 40), repeat('G', p_partkey::int % 90 + 1)]) as a, [repeat('C', p_size + p_partkey::int % 20)] as parents from part)
select count(*) filter (where greatest(len(ref), len(a)) >= 30) as long, count(*) filter (where greatest(len(ref), len(a)) >= 30 and not list_contains(parents, a)) as long_new,
  count(*) filter (where abs(len(ref) - len(a)) >= 30) as differs, count(*) filter (where abs(len(ref) - len(a)) >= 30 and not list_contains(parents, a)) as differs_new from a""",
)
def _(t):
    k, n = F.col("p_partkey").cast("int"), F.col("p_size")
    rows = t.table("part").select(
        F.repeat(F.lit("A"), n).alias("ref"), F.array(F.repeat(F.lit("C"), n + k % 40), F.repeat(F.lit("G"), k % 90 + 1)).alias("child_alts"), F.array(F.repeat(F.lit("C"), n + k % 20)).alias("parent_alts")
    )
    return ST.de_novo_multiallelic(rows, 30)


@register("ag15_sample_types", "v", "select caller, svtype, count(*) as n, max(svlen) as longest from v group by 1, 2")
def _(t):
    return t.v.groupBy("caller", "svtype").agg(F.count("*").alias("n"), F.max("svlen").alias("longest"))


@register(
    "ag26_position_histogram", "tr",
    """select chrom, unnest(range(start // 500, ("end" - 1) // 500 + 1)) as bin, count(*) as n from tr where start < "end" group by all""".replace("group by all", "group by 1, 2"),
)
def _(t):
    return ST.position_histogram(t.tr, 500, "chrom")


@register(
    "ag29_grouped_margins", "",
    "select p_brand, p_size, p_type, count(*) as n from part group by grouping sets ((p_brand, p_size), (p_type), (p_brand, p_type))",
)
def _(t):
    return ST.grouped_margins(t.table("part"), [["p_brand", "p_size"], ["p_type"], ["p_brand", "p_type"]], ["p_brand", "p_size", "p_type"])


@register("ag31_sum_list", "", "select o_orderkey, (o_custkey % 10 + o_orderkey % 7 + 5)::double as total from orders")
def _(t):
    listed = F.concat_ws(",", F.col("o_custkey") % 10, F.col("o_orderkey") % 7, F.lit(5))
    total = F.aggregate(F.split(listed, ","), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.table("orders").select("o_orderkey", total.alias("total"))


@register("ag34_crosstab", "v", "select svtype, count(*) filter (where caller = 'F') as F, count(*) filter (where caller = 'O') as O from v group by 1")
def _(t):
    counts = t.v.groupBy("svtype", "caller").agg(F.count("*").alias("n"))
    return ST.pivot_counts(counts, "svtype", "caller", ["F", "O"])


@register("ag38_above_cap", "g", "select line, round(avg((ad_alt > 20)::int), 6) as above, count(*) filter (where gt in ('0/0', '0|0') and ad_alt > 0) as odd_reference from g group by 1")
def _(t):
    gt = F.regexp_replace("gt", "\\|", "/")
    return t.g.groupBy("line").agg(F.round(F.avg((F.col("ad_alt") > 20).cast("int")), 6).alias("above"), F.count_if((gt == "0/0") & (F.col("ad_alt") > 0)).alias("odd_reference"))


@register("ag41_distinct_haplotypes", "seqs", "select left(seq, 1) as w, min(s) as seq, count(*) as n from (select seq, case when doc_id % 2 = 0 then upper(left(seq, 3)) else left(seq, 3) end as s from seqs) group by 1, upper(s)")
def _(t):
    short = F.substring("seq", 1, 3)
    haps = t.seqs.select(F.substring("seq", 1, 1).alias("w"), F.when(F.col("doc_id") % 2 == 0, F.upper(short)).otherwise(short).alias("seq"))
    return CO.distinct_haplotypes(haps, ["w"])


@register(
    "wn02_symbolic_islands", "v",
    """, f as (select *, pos + 1 as first, pos + svlen - 1 as last from v where svtype = 'DUP' and svlen <= 300),
o as (select *, max(last) over (partition by chrom order by first, id rows between unbounded preceding and 1 preceding) as reach from f),
i as (select *, sum(case when reach is null or first > reach + 25 then 1 else 0 end) over (partition by chrom order by first, id) as island from o)
select chrom, island, min(first) as first, max(last) as last, count(*) as n from i group by 1, 2""",
)
def _(t):
    from varspan.functions.alleles import footprint

    dup = t.v.where("svtype = 'DUP' and svlen <= 300").withColumns({"ref": F.lit("N"), "alt": F.concat(F.lit("<DUP-"), "svlen", F.lit(">"))})
    size = F.regexp_extract("alt", "-([0-9]+)>", 1).cast("int")
    spans = dup.withColumn("f", footprint(F.col("pos"), F.col("ref"), F.col("alt"), size)).select("id", "chrom", "f.first", "f.last")
    return IS.island_totals(IS.islands(spans, "first", "last", 25, ["id"]), "first", "last")


@register("wn19_first_of_pairs", "v", "select chrom, pos, min(id) as id, count(*) as n from v group by 1, 2")
def _(t):
    return t.v.groupBy("chrom", "pos").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@register(
    "wn20_contig_layout", "contigs",
    "select chrom, length, coalesce(sum(length) over (order by substr(chrom, 4)::int rows between unbounded preceding and 1 preceding), 0)::bigint as before, round(coalesce(sum(length) over (order by substr(chrom, 4)::int rows between unbounded preceding and 1 preceding), 0) / sum(length) over (), 6) as share from contigs",
)
def _(t):
    return ST.contig_layout(t.contigs).withColumn("share", F.round("share", 6))


@register("so06_first_match", "v tr", """select v.id, min(tr.start) as start from v join tr on tr.chrom = v.chrom and v.pos - 1 < tr."end" and tr.start < v.pos group by 1""")
def _(t):
    from varspan.operators.intervals import overlap_join
    from varspan.operators.proximity import points

    at = t.v.withColumn("p", F.col("pos") - 1)
    pairs = overlap_join(points(at, "chrom", "p", ["id"]), t.tr.select("chrom", "start", "end"), longest=(1, None))
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.min("b_start").alias("start"))


@register("so08_natural_order", "contigs", "select chrom, (row_number() over (order by substr(chrom, 4)::int))::int as place from contigs")
def _(t):
    from varspan.operators.rewrite import chromosome_number

    return t.contigs.select("chrom", F.row_number().over(Window.orderBy(chromosome_number(F.col("chrom")))).alias("place"))  # one row a contig


@register("st05_distinct", "v", "select distinct chrom, svtype, svlen from v")
def _(t):
    return t.v.select("chrom", "svtype", "svlen").distinct()


@register("st07_labelled_union", "v", "select id, 1 as y from v where caller = 'F' union all select id, 0 from v where caller = 'O' and svtype <> 'INS'")
def _(t):
    return t.v.where("caller = 'F'").select("id", F.lit(1).alias("y")).unionByName(t.v.where("caller = 'O' and svtype != 'INS'").select("id", F.lit(0).alias("y")))


@register(
    "fn23_phred", "g",
    """select ad_ref, ad_alt, round(10 * (greatest(ad_ref, ad_alt) - case when ad_ref = ad_alt then ad_ref else least(ad_ref, ad_alt) end) / 4.0)::int as gq, round(-10 * log10(greatest(1.0 / (1 + ad_alt), 1e-10)))::int as sq, count(*) as n from g group by all""",
)
def _(t):
    g = t.g
    gq = G.genotype_quality(F.array(F.col("ad_ref") / 4.0, F.col("ad_alt") / 4.0))
    return g.groupBy("ad_ref", "ad_alt", gq.alias("gq"), G.reference_phred(1.0 / (1 + F.col("ad_alt"))).alias("sq")).agg(F.count("*").alias("n"))


@register(
    "fn24_read_features", "reads",
    """, q as (select s_suppkey as id, concat('chr', s_suppkey % 22 + 1) as chrom, (s_suppkey * 150)::int as s, (s_suppkey * 150 + 400)::int as e from supplier),
p as (select q.id, mapq, flag, contains(cigar, 'S') as clipped from q join reads r on r.chrom = q.chrom and r.pos < q.e + 50 and r.pos + 100 > q.s - 50), m as (select id, quantile_cont(mapq, 0.5) as m from p group by 1)
select id, count(*) as reads, round(avg(mapq), 6) as mean_mapq, round(count(*) filter (where (flag & 16) <> 0) / count(*), 6) as reverse_share, round(count(*) filter (where clipped) / count(*), 6) as clipped_share,
  round(quantile_cont(abs(mapq - m), 0.5) / nullif(avg(mapq), 0), 6) as deviation from p join m using (id) group by 1""",
)
def _(t):
    s = F.col("s_suppkey")
    records = t.table("supplier").select(s.alias("id"), F.concat(F.lit("chr"), s % 22 + 1).alias("chrom"), (s * 150).cast("int").alias("start"), (s * 150 + 400).cast("int").alias("end"))
    reads = t.reads.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 100).alias("end"), "mapq", "flag", F.col("cigar").contains("S").alias("clipped"))
    out = ST.read_features(reads, records, 50)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_mapq", "reverse_share", "clipped_share", "deviation")})


@register(
    "fn25_small_numbers", "",
    """select o_orderkey, case when o_custkey % 4 = 0 then -1.0 else round((o_orderkey % 9) / (o_custkey % 4)::double, 6) end as motif, printf('%.4f', o_totalprice / 3) as text, round(least(20 / (o_custkey % 40 + 1)::double, 1), 6) as factor,
  case when o_custkey % 3 = 0 then 0.0 else round((o_orderkey % 5) / (o_custkey % 3)::double, 6) end as ratio from orders""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.table("orders").select(
        "o_orderkey", F.round(B.motif_fraction(F.concat(F.lit("AC: "), k % 9, F.lit("/"), c % 4)), 6).alias("motif"), B.four_decimals(F.col("o_totalprice") / 3).alias("text"),
        F.round(B.subsample_factor(c % 40 + 1, 20.0), 6).alias("factor"), F.round(B.safe_ratio(k % 5, c % 3), 6).alias("ratio"),
    )


@register(
    "ml07_assign_genotypes", "g",
    """, p as (select *, case when ad_alt < 8 then 0.9 else 0.05 end as p0, case when ad_alt between 8 and 18 then 0.9 else 0.05 end as p1, case when ad_alt > 18 then 0.9 else 0.05 end as p2 from g)
select gt, case when dp = 0 then gt when len(gt) = 3 then case when p0 = 0.9 then '0/0' when p1 = 0.9 then case when gt in ('0|1', '1|0') then gt else '0/1' end else '1/1' end when p0 = 0.9 then '0' else '1' end as new_gt, count(*) as n from p group by 1, 2""",
)
def _(t):
    a = F.col("ad_alt")
    p = t.g.withColumns({"p0": F.when(a < 8, 0.9).otherwise(0.05), "p1": F.when(a.between(8, 18), 0.9).otherwise(0.05), "p2": F.when(a > 18, 0.9).otherwise(0.05), "depth": F.col("dp")})
    return R.assign_genotypes(p).groupBy("gt", "new_gt").agg(F.count("*").alias("n"))


@register("ml01_medians", "", "select round(quantile_disc(l_tax, 0.5), 6) as l_tax, round(quantile_disc(l_discount, 0.5), 6) as l_discount from lineitem where l_tax > 0.01")
def _(t):
    rows = t.table("lineitem").where("l_tax > 0.01")
    return rows.agg(*[F.round(F.expr(f"percentile_disc(0.5) within group (order by {c})"), 6).alias(c) for c in ("l_tax", "l_discount")])


@register("ml04_calibration", "v", ", c as (select qual / 10.0 as score, count(*) as n from v where caller = 'F' group by 1) select round(score, 6) as score, round(sum(n) over (order by score desc) / sum(n) over (), 6) as sensitivity from c")
def _(t):
    cal = SC.calibration_table(t.v.select((F.col("qual") / 10.0).alias("score"), (F.col("caller") == "F").cast("int").alias("label")))
    return cal.select(F.round("score", 6).alias("score"), F.round("sensitivity", 6).alias("sensitivity"))


SCORES = "case when line = 1 then '.' when line <= 3 then cast(ad_alt as string) else concat(cast(ad_ref as string), ',', cast(ad_alt as string)) end"


@register(
    "ag28_score_histograms", "g",
    f""", c as (select contains(gt, '1') as p, string_split({SCORES}, ',') as s from g where line <> 1),
k as (select p, 0 as i, s[1]::int as v from c where len(s) = 1 union all select p, 1, s[1]::int from c where len(s) = 2 union all select p, 2, s[2]::int from c where len(s) = 2)
select r.v::int as score, count(*) filter (where p and i = 0) as present, count(*) filter (where p and i = 1) as present_1, count(*) filter (where p and i = 2) as present_2,
  count(*) filter (where not p and i = 0) as absent, count(*) filter (where not p and i = 1) as absent_1, count(*) filter (where not p and i = 2) as absent_2
from range(101) r(v) left join k on k.v = r.v group by 1""",
)
def _(t):
    return ST.score_histograms(t.g.withColumn("scores", F.expr(SCORES)))


@register("ag39_reference_cells", "g", "select dp, ad_ref, ad_alt, count(*) as n from g where gt in ('0/0', '0|0') group by all")
def _(t):
    return ST.reference_cells(t.g).groupBy("dp", "ad_ref", "ad_alt").agg(F.count("*").alias("n"))


SITE_INFO = "concat('SUPP_PAV=', cast(line % 2 as string), case when line = 3 then ';SCORE=.' when line = 4 then '' else concat(';SCORE=0.', cast(qual as string)) end, ';OTHER=1')"


@register(
    "pr26_info_to_format", "v",
    f""", s as (select id, {SITE_INFO} as info, line from v where line <> 7)
select v.id, coalesce(regexp_extract(s.info, 'SUPP_PAV=([^;]*)', 1), '9') as supp_pav, nullif(nullif(regexp_extract(s.info, 'SCORE=([^;]*)', 1), ''), '.') as score, '0/1' as gt from v left join s using (id)""",
)
def _(t):
    v = t.v.withColumns({"ref": F.col("id"), "alt": F.lit("A")})
    sites = v.where("line != 7").withColumn("info", F.expr(SITE_INFO))
    cells = v.withColumn("fields", F.expr("map('GT', '0/1', 'SUPP_PAV', '9')"))
    f = R.info_to_format(cells, sites, ["SUPP_PAV", "SCORE"])
    return f.select("id", F.col("fields")["SUPP_PAV"].alias("supp_pav"), F.col("fields")["SCORE"].alias("score"), F.col("fields")["GT"].alias("gt"))


SAMPLES_INFO = "concat('K=1', case when line = 1 then '' else concat(';N_SAMPLES=', cast(qual * 3 as string)) end, ';TRUTH_BND_TYPE=', cast(line as string))"


@register("fl18_sample_band", "v", "select id from v where line = 1 or qual * 3 between 1 and 9")
def _(t):
    return FL.sample_band(t.v.withColumn("info", F.expr(SAMPLES_INFO)), "N_SAMPLES", 1, 9).select("id")


@register("fl21_without_chain_ends", "v", "select id from v where line <> 4")
def _(t):
    return FL.without_chain_ends(t.v.withColumn("info", F.expr(SAMPLES_INFO))).select("id")
