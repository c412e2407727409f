"""Queries of cohort statistics, histograms, benchmarks, sampling and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from varspan.functions import genotypes as G
from varspan.functions.binning import clamp, log10_bin, quantum_bin
from varspan.operators import intervals as IV
from varspan.operators import scoring as SC
from varspan.operators import statistics as ST
from varspan.operators.chains import chain_breakpoints
from varspan.plans.proxies import register
from varspan.plans.relations import CANDIDATES, _truth, spans
from varspan.sources.sinks import allele_sequences, vcf_lines

GT = "replace({0}, '|', '/')"
ALTS = "(len({0}) - len(replace({0}, '1', '')))"
TRIO = """, u as (select variant_id, sample_id, gt, ad_ref, ad_alt, svlen, line from g qualify row_number() over (partition by variant_id, sample_id order by line, gt, ad_ref, ad_alt, svlen) = 1),
s as (select variant_id, ((sample_id::int // 60) * 3 + sample_id::int % 3)::varchar as sample_id, gt, ad_ref, ad_alt, svlen, line from u
  qualify row_number() over (partition by variant_id, (sample_id::int // 60) * 3 + sample_id::int % 3 order by sample_id::int) = 1),
t as (select c.variant_id, p.child, p.father, p.mother, c.gt as c_gt, f.gt as f_gt, m.gt as m_gt, c.ad_ref + c.ad_alt + f.ad_ref + f.ad_alt + m.ad_ref + m.ad_alt as depth,
    c.ad_alt as c_alt, f.ad_alt + m.ad_alt as p_alt, c.svlen as svlen from s c join ped p on c.sample_id = p.child join s f on f.variant_id = c.variant_id and f.sample_id = p.father join s m on m.variant_id = c.variant_id and m.sample_id = p.mother),
e as (select *, contains(c_gt, '1') and not contains(c_gt || f_gt || m_gt, '.') and len(c_gt) = 3 and len(f_gt) = 3 and len(m_gt) = 3 as el, not contains(f_gt || m_gt, '1') as dn from t)"""


def _trio(t):
    """Samples folded into fewer, so that trios share variants; one cell a variant and sample."""
    from pyspark.sql import Window

    n = F.col("sample_id").cast("int")
    folded = t.g.withColumn("s", (F.floor(n / 60) * 3 + n % 3).cast("string")).where("s is not null").repartition("s")  # the pedigree's key too
    w = Window.partitionBy("variant_id", "s").orderBy(n, "line", "gt", "ad_ref", "ad_alt", "svlen")
    cells = folded.withColumn("r", F.row_number().over(w)).where("r = 1").drop("sample_id").withColumnRenamed("s", "sample_id")
    return ST.trios(cells, t.ped, keep=["svlen"])


@register(
    "ag01_de_novo_rate", "g ped",
    TRIO + "select child, count(*) filter (where el) as den, count(*) filter (where el and dn) as num, round(count(*) filter (where el and dn) / nullif(count(*) filter (where el), 0), 6) as rate from e group by child",
)
def _(t):
    return ST.de_novo_rate(_trio(t), "child").withColumn("rate", F.round("rate", 6))


@register(
    "ag02_depth_histogram", "g ped",
    TRIO + "select dn as de_novo, least(c_alt, 12) as child_alt, least(p_alt, 12)::int as parents_alt, count(*) as n from e where el group by 1, 2, 3",
)
def _(t):
    return ST.depth_histogram(_trio(t), 12)


@register(
    "ag03_de_novo_by_depth", "g ped",
    TRIO + "select least(depth // 3, 30)::int as depth, (svlen > 100)::int + (svlen > 500)::int as len_bin, count(*) filter (where el) as den, count(*) filter (where el and dn) as num from e group by 1, 2",
)
def _(t):
    from varspan.functions.binning import edge_bin

    return ST.de_novo_rate(_trio(t), ST.mean_depth_bin(30).alias("depth"), edge_bin(F.col("svlen"), (100, 500)).alias("len_bin")).drop("rate")


@register(
    "ag09_mendelian", "g ped",
    TRIO + """, a as (select *, not contains(c_gt || f_gt || m_gt, '.') and len(c_gt) = 3 and len(f_gt) = 3 and len(m_gt) = 3 as ok, contains(c_gt || f_gt || m_gt, '1') as carried,
  not ((contains(f_gt, c_gt[1:1]) and contains(m_gt, c_gt[3:3])) or (contains(f_gt, c_gt[3:3]) and contains(m_gt, c_gt[1:1]))) as bad from e)
select child, count(*) filter (where ok and carried and not bad) as good_alt, count(*) filter (where ok and bad) as errors,
  round(count(*) filter (where ok and bad) / nullif(count(*) filter (where ok and bad) + count(*) filter (where ok and carried and not bad), 0), 6) as error_rate from a group by child""",
)
def _(t):
    return ST.mendelian(_trio(t), "child").withColumn("error_rate", F.round("error_rate", 6))


HW = """, h as (select variant_id, count(*) filter (where len(gt) = 3 and not contains(gt, '.') and not contains(gt, '1')) as aa,
  count(*) filter (where len(gt) = 3 and not contains(gt, '.') and len(replace(gt, '1', '')) = 2) as ab, count(*) filter (where len(gt) = 3 and len(replace(gt, '1', '')) = 1) as bb from g group by 1)"""


@register("ag06_hardy_weinberg_counts", "g", HW + " select * from h where ab + bb > 0")
def _(t):
    return ST.hardy_weinberg_counts(t.g)


@register(
    "ag07_hardy_weinberg_test", "g",
    HW + """, k as (select *, (aa + ab + bb)::double as n, (2 * aa + ab) / (2.0 * (aa + ab + bb)) as p from h where ab + bb > 0),
x as (select variant_id, case when p > 0 and p < 1 then pow(aa - n * p * p, 2) / (n * p * p) + pow(ab - 2 * n * p * (1 - p), 2) / (2 * n * p * (1 - p)) + pow(bb - n * (1 - p) * (1 - p), 2) / (n * (1 - p) * (1 - p)) end as chi2 from k)
select variant_id, round(chi2, 6) as chi2, chi2 > 3.841458820694124 as nominal from x""",
)
def _(t):
    out = ST.hardy_weinberg_classes(ST.hardy_weinberg_counts(t.g))
    return out.select("variant_id", F.round("chi2", 6).alias("chi2"), F.when(F.col("chi2").isNotNull(), F.col("class") != "pass").alias("nominal"))


@register(
    "ag11_region_errors", "v",
    """, o as (select *, caller as label, case when lag(caller) over w is distinct from caller then 1 else 0 end as new from v window w as (partition by chrom order by pos, id)),
r as (select *, sum(new) over (partition by chrom order by pos, id rows unbounded preceding) as run from o)
select chrom, label, run, min(pos) as first, max(pos + svlen) as last, count(*) as n, count(*) filter (where qual > 7) as errors from r group by 1, 2, 3 having max(pos + svlen) - min(pos) >= 500""",
)
def _(t):
    from varspan.operators.scan import previous_value, running_sum

    seen = previous_value(t.v, ["chrom"], "pos", ["id"], "caller", "before")
    tagged = seen.withColumn("new", (F.col("before_first") | ~F.col("caller").eqNullSafe(F.col("before"))).cast("int"))
    runs = running_sum(tagged, ["chrom"], "pos", ["id"], F.col("new"), "run")
    out = runs.groupBy("chrom", F.col("caller").alias("label"), "run").agg(
        F.min("pos").alias("first"), F.max(F.col("pos") + F.col("svlen")).alias("last"), F.count("*").alias("n"), F.count_if(F.col("qual") > 7).alias("errors")
    )
    return out.where(F.col("last") - F.col("first") >= 500)


def _cube():
    hit = 'case when exists (select 1 from tr where tr.chrom = v.chrom and v.pos - 1 < tr."end" and tr.start < v.pos - 1 + v.svlen) then 1 else 0 end'
    return f", f as (select *, {hit} as in_track from v) select caller, svtype, in_track, count(*) filter (where svlen >= 20) as n_20, count(*) filter (where svlen >= 500) as n_500 from f group by cube (caller, svtype, in_track)"


@register("ag13_call_counts", "v tr", _cube())
def _(t):
    v = t.v.withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + F.col("svlen")})
    return ST.call_counts(IV.in_track(v, t.tr, "id", "in_track"), (20, 500))


@register(
    "ag18_allele_balance", "g",
    """select len(gt) - len(replace(gt, '1', '')) as n_alts, least(ad_alt, 25) as alt_depth, floor(ad_alt / (ad_ref + ad_alt) / 0.01)::int as share_bin, count(*) as n
from g where ad_ref + ad_alt > 0 and not contains(gt, '.') group by 1, 2, 3""",
)
def _(t):
    return ST.allele_balance(t.g, 0.01, 25)


@register(
    "ag19_genotyping_priors", "g",
    """, t as (select variant_id || '@' || sample_id || '@' || line as k, len(gt) - len(replace(gt, '1', '')) as n_alts, ad_ref, ad_alt from g), c as (select n_alts, ad_ref + ad_alt as depth, ad_alt, count(*) as n from t group by all)
select n_alts, depth, ad_alt, n, round(n / sum(n) over (partition by n_alts, depth), 6) as p from c""",
)
def _(t):
    from pyspark.sql import Window

    keyed = t.g.withColumn("match_id", F.concat_ws("@", "variant_id", "sample_id", "line", F.row_number().over(Window.partitionBy("variant_id", "sample_id", "line").orderBy("gt", "ad_ref", "ad_alt"))))
    return ST.genotyping_priors(keyed.select("match_id", "gt"), keyed.select("match_id", "ad_ref", "ad_alt")).withColumn("p", F.round("p", 6))


@register(
    "ag20_bin_coverage", "tr",
    """select concat('r_', id % 100) as id, (id // 100)::int as bin, round(id / ("end" - start) / 7.3, 4) as value from tr""",
)
def _(t):
    cov = t.tr.select("chrom", "start", "end", F.concat(F.lit("r_"), F.col("id") % 100, F.lit("_"), F.floor(F.col("id") / 100)).alias("bin_key"), F.col("id").cast("double").alias("cov"))
    return ST.bin_coverage(cov, 7.3)


@register(
    "ag21_same_position", "v",
    """select chrom, pos, count(*) as n, count(distinct svtype) > 1 as types_differ, count(distinct qual) > 1 as quals_differ, max(svlen) - min(svlen) as length_range, round(max(svlen) / min(svlen), 6) as length_ratio
from v group by 1, 2 having count(*) > 1""",
)
def _(t):
    return ST.same_position(t.v).withColumn("length_ratio", F.round("length_ratio", 6))


@register(
    "ag25_length_histograms", "v",
    """, c as (select chrom, pos, svtype, svlen from v) select svtype, floor(log10(svlen))::int as length_bin, least(pos // 20000, 9)::int as pos_bin, count(*) as n from c group by 1, 2, 3""",
)
def _(t):
    return ST.histogram(t.v, {"svtype": F.col("svtype"), "length_bin": log10_bin(F.col("svlen")), "pos_bin": clamp(quantum_bin(F.col("pos"), 20000), 0, 9)})


@register(
    "ag27_dense_histogram", "v",
    """select s.svtype, b.length_bin::int as length_bin, coalesce(n, 0) as n from (select unnest(['DEL', 'DUP', 'INS', 'INV']) as svtype) s, (select unnest(range(0, 5)) as length_bin) b
left join (select svtype, floor(log10(svlen))::int as length_bin, count(*) as n from v group by 1, 2) c on c.svtype = s.svtype and c.length_bin = b.length_bin""",
)
def _(t):
    counts = ST.histogram(t.v, {"svtype": F.col("svtype"), "length_bin": log10_bin(F.col("svlen"))})
    return ST.dense(counts, {"svtype": ["DEL", "DUP", "INS", "INV"], "length_bin": list(range(5))}).withColumn("length_bin", F.col("length_bin").cast("int"))


@register(
    "ag30_genotype_transitions", "g",
    """, p as (select variant_id, sample_id, line, floor(svlen / 200)::int as bin, ad_alt, case when replace(gt, '|', '/') = '1/0' then '0/1' when gt in ('./0', './1') then './.' else replace(gt, '|', '/') end as before from g),
q as (select *, case when ad_alt < 8 and before in ('0/1') then '0/0' when ad_alt < 8 and before = '1' then '0' else before end as after from p)
select bin, before, after, count(*) as n from q group by 1, 2, 3""",
)
def _(t):
    from pyspark.sql import Window

    from varspan.operators.rewrite import correct_genotypes

    k = F.row_number().over(Window.partitionBy("variant_id", "sample_id", "line").orderBy("gt", "ad_ref", "ad_alt", "svlen"))
    keyed = t.g.withColumns({"k": k, "bin": quantum_bin(F.col("svlen"), 200)}).withColumn("variant_id", F.concat_ws("@", "variant_id", "line", "k"))
    after = correct_genotypes(keyed, 8, False).select("variant_id", "sample_id", F.col("new_gt").alias("gt"))
    return ST.transitions(keyed, after, ["bin"])


@register(
    "ag32_mapping_quality", "reads",
    """select chrom, round(avg(mapq), 6) as mean_mapq, round(count(*) filter (where (flag & 256) <> 0) / count(*), 6) as secondary from reads group by 1""",
)
def _(t):
    return ST.mapping_quality(t.reads, "chrom").select("chrom", F.round("mean_mapq", 6).alias("mean_mapq"), F.round("secondary", 6).alias("secondary"))


@register(
    "ag35_reverse_cdf", "v",
    """, c as (select least(floor(qual / 10.0 * 20), 19)::bigint as bin, count(*) as n from v group by 1) select bin, n, round(sum(n) over (order by bin desc) / sum(n) over (), 6) as share from c""",
)
def _(t):
    return ST.reverse_cdf(t.v.withColumn("af", F.col("qual") / 10.0), "af", 20).withColumn("share", F.round("share", 6))


@register(
    "ag36_auc", "v",
    """, r as (select svtype, (caller = 'F')::int as y, qual, svlen from v where svtype <> 'INS'), c as (select svtype, svlen, sum(y) as p, count(*) - sum(y) as q from r group by 1, 2),
w as (select *, coalesce(sum(q) over (partition by svtype order by svlen rows between unbounded preceding and 1 preceding), 0) as below from c)
select svtype, sum(p)::bigint as pos, sum(q)::bigint as neg, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0)::double, 6) as auc from w group by 1""",
)
def _(t):
    rows = t.v.where("svtype != 'INS'").withColumn("y", (F.col("caller") == "F").cast("int"))
    return ST.auc(rows, "svlen", "y", "svtype").withColumn("auc", F.round("auc", 6))


@register(
    "ag45_precision_recall", "v",
    CANDIDATES + """, s as (select 'base' as side, svtype, (svlen >= 200)::int + (svlen >= 600)::int as bin, case when id in (select base_id from m) then 'tp' else 'fn' end as state from b
union all select 'comp', svtype, (svlen >= 200)::int + (svlen >= 600)::int, case when id in (select comp_id from m) then 'tp' else 'fp' end from c),
a as (select svtype, bin, count(*) filter (where side = 'base' and state = 'tp') as tp_base, count(*) filter (where side = 'comp' and state = 'tp') as tp_comp, count(*) filter (where state = 'fp') as fp, count(*) filter (where state = 'fn') as fn from s group by 1, 2),
p as (select *, tp_comp / nullif(tp_comp + fp, 0) as p, tp_base / nullif(tp_base + fn, 0) as r from a)
select svtype, bin, tp_base, tp_comp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / nullif(p + r, 0), 6) as f1 from p""",
)
def _(t):
    from varspan.functions.binning import lower_edge_bin
    from varspan.operators.proximity import match_multi

    base, comp, candidates = _truth(t)
    states = match_multi(base, comp, candidates, ("svtype", "svlen"))
    out = ST.precision_recall(states, "svtype", lower_edge_bin(F.col("svlen"), (200, 600)).alias("bin"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register(
    "ag43_chunk_summary", "v",
    """, c as (select chrom, count(*) as n from v group by 1) select count(*) as count, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as std, min(n) as min, quantile_cont(n, 0.5) as median, max(n) as max from c""",
)
def _(t):
    out = ST.chunk_summary(t.v.groupBy("chrom").agg(F.count("*").alias("n")))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@register(
    "so01_coordinate_sort", "v",
    """select id, chrom, pos, (row_number() over (order by substr(chrom, 4)::int, pos, id) <= 100) as first_100 from v qualify first_100""",
)
def _(t):
    from varspan.operators.rewrite import chromosome_number

    top = t.v.orderBy(chromosome_number(F.col("chrom")), "pos", "id").limit(100)  # a top-k report
    return top.select("id", "chrom", "pos", F.lit(True).alias("first_100"))


@register(
    "so05_top_by_group", "v",
    """select svtype, chrom, id from v qualify row_number() over (partition by svtype, chrom order by svlen desc, pos, id) <= 3""",
)
def _(t):
    # the k best of a group fold into an array of k in the map tasks: no window over a whole group
    rank = F.struct((-F.col("svlen")).alias("l"), "pos", "id")
    w = t.v.withColumn("rank", rank)
    from pyspark.sql import Window

    salted = w.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(16)))
    local = salted.withColumn("r", F.row_number().over(Window.partitionBy("svtype", "chrom", "s").orderBy("rank"))).where("r <= 3")
    best = local.withColumn("r", F.row_number().over(Window.partitionBy("svtype", "chrom").orderBy("rank"))).where("r <= 3")
    return best.select("svtype", "chrom", "id")


@register(
    "sk01_vcf_lines", "calls",
    r"""select concat_ws(chr(9), chrom, pos, id, ref, alt, printf('%.2f', qual), filter, info) as value from calls""",
)
def _(t):
    return vcf_lines(t.calls)


@register("sk04_allele_sequences", "calls")
def _(t):
    return allele_sequences(t.calls, 5)


@register("ml02_boosted_scores", "")
def _(t):
    li = t.table("lineitem").select("l_orderkey", "l_quantity", "l_discount", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    features = ["l_quantity", "l_discount", "l_tax"]
    held_out = F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0  # trained on the others, calibrated on these, all are scored
    scored = SC.score(SC.train_scorer(li.where(~held_out), features, maxIter=3, maxDepth=3), li, features)
    table = SC.calibration_table(scored.where(held_out))
    return SC.add_sensitivity(scored, table).select("l_orderkey", F.round("score", 4).alias("score"), F.round("sensitivity", 4).alias("sensitivity"))


@register("ml06_mixture_genotypes", "g")
def _(t):
    m = SC.mixture_genotypes(t.g)
    return t.spark.createDataFrame([(k, float(w), float(mu), float(nu)) for k, (w, mu, nu) in enumerate(zip(m["weights"], m["means"], m["concentrations"]))], "copies int, weight double, mean double, concentration double")


@register("ml08_hash_sample", "reads")
def _(t):
    return SC.hash_sample(t.reads, "read_id", 0.25, 1).select("read_id", "chrom", "pos")


@register("ml09_class_sample", "v")
def _(t):
    return SC.class_sample(t.v, "svtype", "id", 400, 1).select("svtype", "id")


@register("wn09_chain_breakpoints", "reads")
def _(t):
    n = F.col("read_id").cast("long")
    df = t.reads.select(
        (n % 700).cast("string").alias("read_id"), (F.col("mapq") * 20).alias("read_start"), (F.col("mapq") * 20 + 300).alias("read_end"), "chrom",
        F.col("pos").alias("start"), (F.col("pos") + 300).alias("end"), (F.col("flag").bitwiseAND(16) != 0).alias("reverse"),
    )
    return chain_breakpoints(df, 100)
