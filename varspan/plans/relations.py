"""Queries over several relations: intervals, distances, cohorts, breakends."""

from __future__ import annotations

from pyspark.sql import functions as F

from varspan.functions import alleles as A
from varspan.functions import genotypes as G
from varspan.operators import breakends as BE
from varspan.operators import cohort as CO
from varspan.operators import filters as FL
from varspan.operators import greedy as GR
from varspan.operators import intervals as IV
from varspan.operators import islands as IS
from varspan.operators import proximity as PX
from varspan.operators.collapse import collapse, similar_pairs
from varspan.plans.proxies import register
from varspan.shared import written


def spans(v):
    """Variants as 0-based intervals of their length."""
    return v.select("id", "chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.col("svlen")).alias("end"), "svtype", "svlen")


HIT = 'exists (select 1 from tr where tr.chrom = v.chrom and v.pos - 1 < tr."end" and tr.start < v.pos - 1 + v.svlen)'


@register(
    "calls_by_track", "v tr",
    f"""select svtype, case when {HIT} then 1 else 0 end as in_track, (svlen >= 100)::int + (svlen >= 500)::int as len_bin, count(*) as n from v group by 1, 2, 3""",
)
def _(t):
    flagged = IV.in_track(spans(t.v), t.tr, "id", "in_track")
    return flagged.groupBy("svtype", "in_track", ((F.col("svlen") >= 100).cast("int") + (F.col("svlen") >= 500).cast("int")).alias("len_bin")).agg(F.count("*").alias("n"))


@register(
    "jn04_overlap_share", "v tr",
    """select id, max(case when least(v.pos - 1 + svlen, tr."end") - greatest(v.pos - 1, tr.start) >= 0.5 * svlen then 1 else 0 end) as half_in
from v left join tr using (chrom) group by id""".replace("select id,", "select v.id,").replace("group by id", "group by v.id"),
)
def _(t):
    return IV.in_track(spans(t.v), t.tr, "id", "half_in", 0.5).select("id", "half_in")


@register(
    "jn05_intersect", "v tr",
    """select chrom, greatest(v.pos - 1, tr.start) as start, least(v.pos - 1 + svlen, tr."end") as "end", count(*) as n from v join tr using (chrom)
where v.pos - 1 < tr."end" and tr.start < v.pos - 1 + svlen group by 1, 2, 3""",
)
def _(t):
    return IV.intersect(spans(t.v), t.tr).groupBy("chrom", "start", "end").agg(F.count("*").alias("n"))


@register(
    "fl10_region_modes", "v tr",
    """select svtype, count(*) filter (where exists (select 1 from tr where tr.chrom = v.chrom and pos - 1 < tr."end" and tr.start < pos)) as by_pos,
  count(*) filter (where exists (select 1 from tr where tr.chrom = v.chrom and pos < tr."end" and tr.start < pos + svlen)) as by_record from v group by svtype""",
)
def _(t):
    v = t.v.withColumns({"first": F.col("pos") + 1, "last": F.col("pos") + F.col("svlen")})
    by_pos = IV.restrict(v, t.tr, "id", "pos").groupBy("svtype").agg(F.count("*").alias("by_pos"))
    return by_pos.join(IV.restrict(v, t.tr, "id", "record").groupBy("svtype").agg(F.count("*").alias("by_record")), "svtype")


@register(
    "wn17_merge_complement", "tr contigs",
    """, o as (select *, max("end") over (partition by chrom order by start, "end" rows between unbounded preceding and 1 preceding) as reach from tr),
i as (select *, sum(case when reach is null or start > reach + 40 then 1 else 0 end) over (partition by chrom order by start, "end") as island from o),
m as (select chrom, min(start) as start, max("end") as "end", count(*) as n from i group by chrom, island),
o2 as (select *, max("end") over (partition by chrom order by start, "end" rows between unbounded preceding and 1 preceding) as reach from tr),
i2 as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by chrom order by start, "end") as island from o2),
m2 as (select chrom, min(start) as start, max("end") as "end" from i2 group by chrom, island
  union all select chrom, 0, 0 from contigs union all select chrom, length, length from contigs),
c as (select chrom, lag("end") over (partition by chrom order by start, "end") as start, start as "end" from m2)
select 'merged' as kind, chrom, start, "end", n from m union all select 'gap', chrom, start, "end", 1 from c where start < "end" """,
)
def _(t):
    merged = IV.merge(t.tr, 40).select(F.lit("merged").alias("kind"), "chrom", "start", "end", "n")
    return merged.unionByName(IV.complement(t.tr, t.contigs).select(F.lit("gap").alias("kind"), "chrom", "start", "end", F.lit(1).cast("long").alias("n")))


@register(
    "wn05_tiles_and_slop", "contigs tr",
    """select 'tile' as kind, chrom, s::int as start, least(s + 40000, length)::int as "end" from (select chrom, length, unnest(range(0, length, 40000)) as s from contigs)
union all select 'slop', chrom, greatest(start - 100, 0), least("end" + 100, length) from tr join contigs using (chrom)""",
)
def _(t):
    return IV.tiles(t.contigs, 40000).select(F.lit("tile").alias("kind"), "chrom", "start", "end").unionByName(
        IV.slop(t.tr, t.contigs, 100).select(F.lit("slop").alias("kind"), "chrom", "start", "end")
    )


@register(
    "wn12_coverage_bins", "v contigs",
    """, x as (select id, chrom, pos, svlen, length, svlen // 6 as q from v join contigs using (chrom)),
b as (select id, chrom, length, unnest(['before', 'left', 'bin0', 'bin1', 'bin2', 'bin3', 'bin4', 'bin5', 'right', 'after']) as bin,
  unnest([pos - q, pos - 25, pos, pos + svlen // 6, pos + 2 * svlen // 6, pos + 3 * svlen // 6, pos + 4 * svlen // 6, pos + 5 * svlen // 6, pos + svlen - 25, pos + svlen]) as lo,
  unnest([pos, pos + 26, pos + svlen // 6, pos + 2 * svlen // 6, pos + 3 * svlen // 6, pos + 4 * svlen // 6, pos + 5 * svlen // 6, pos + svlen, pos + svlen + 26, pos + svlen + q]) as hi from x)
select chrom, greatest(lo, 0)::bigint as start, least(hi, length)::bigint as "end", concat(id, '_', bin) as name from b""",
)
def _(t):
    return IV.coverage_bins(t.v, t.contigs, 6, 51)


@register(
    "wn13_windows", "v contigs",
    """select id, chrom, greatest(pos - case when svtype = 'INS' then svlen else 75 end, 0)::int as start, least(pos + case when svtype = 'INS' then svlen else svlen + 75 end, length)::int as "end" from v join contigs using (chrom)""",
)
def _(t):
    return IV.around(t.v, t.contigs, 75)


#: Gaps and centromeres of contigs: telomeres at both ends (chr5 lacks one), heterochromatin, a short arm, others.
GAPS = """select chrom, 0 as s, 300 as e, 'telomere' as type from {contigs} union all select chrom, length - 200, length, 'TELOMERE' from {contigs} where chrom <> 'chr5'
union all select chrom, cast(floor(length * 0.4) as int) - 500, cast(floor(length * 0.4) as int) + 900, 'heterochromatin' from {contigs} where chrom in ('chr1', 'chr9')
union all select chrom, 300, 2000, 'short_arm' from {contigs} where chrom in ('chr13', 'chr14') union all select chrom, 50, 60, 'contig' from {contigs}"""
CENTROMERES = "select chrom, cast(floor(length * 0.4) as int) as s, cast(floor(length * 0.4) as int) + 100 as e from {contigs} union all select chrom, cast(floor(length * 0.4) as int) + 150, cast(floor(length * 0.4) as int) + 260 from {contigs}"


def _hard_filter(buffer: str) -> str:
    return f""", g as ({GAPS.format(contigs='contigs')}), m as ({CENTROMERES.format(contigs='contigs')}),
b as (select chrom, length, {buffer} as buffer, (select max(e) from g where g.chrom = contigs.chrom and s = 0 and lower(type) = 'telomere') as t1, (select min(s) from g where g.chrom = contigs.chrom and s > 0 and lower(type) = 'telomere') as t0,
  (select min(s) from (select chrom, s from m union all select chrom, s from g where type in ('heterochromatin', 'short_arm')) x where x.chrom = contigs.chrom) as c0,
  (select max(e) from (select chrom, e from m union all select chrom, e from g where type = 'heterochromatin') x where x.chrom = contigs.chrom) as c1 from contigs)
select chrom, 0 as start, length as "end" from b where t0 is null or length < 4 * buffer
union all select chrom, t1 + buffer, c0 - buffer from b where t0 is not null and length >= 4 * buffer and c0 - t1 - 2 * buffer >= 1000
union all select chrom, c1 + buffer, t0 - buffer from b where t0 is not null and length >= 4 * buffer and t0 - c1 - 2 * buffer >= 1000"""


def _hard_filter_tables(t):
    gaps, centromeres = (t.spark.sql(sql, contigs=t.contigs).withColumnsRenamed({"s": "start", "e": "end"}) for sql in (GAPS, CENTROMERES))
    return t.contigs, centromeres, gaps


@register("wn16_hard_filter", "contigs", _hard_filter("500"))
def _(t):
    return IV.hard_filter_regions(*_hard_filter_tables(t), bases=500)


@register("wn16_hard_filter_share", "contigs", _hard_filter("ceil(length * 0.03)::int"))
def _(t):
    return IV.hard_filter_regions(*_hard_filter_tables(t), share=0.03)


@register(
    "jn06_ends_near", "bnd bp",
    """select id, (exists (select 1 from bp where bp.chrom = bnd.chrom and abs(bp.pos - bnd.pos) <= 400) and
  exists (select 1 from bp where bp.chrom = bnd.other_chrom and abs(bp.pos - bnd.other_pos) <= 400)) as both from bnd
where exists (select 1 from bp where bp.chrom = bnd.chrom and abs(bp.pos - bnd.pos) <= 400) or exists (select 1 from bp where bp.chrom = bnd.other_chrom and abs(bp.pos - bnd.other_pos) <= 400)""",
)
def _(t):
    either = PX.ends_near(t.bnd, t.bp, 400, False).select("id")
    both = PX.ends_near(t.bnd, t.bp, 400, True).select("id", F.lit(True).alias("both"))
    return either.join(both, "id", "left").select("id", F.coalesce("both", F.lit(False)).alias("both"))


@register(
    "jn07_two_ended", "bnd bp",
    """, e as (select id, chrom, pos, other_chrom, other_pos, 0 as sw from bnd union all select id, other_chrom, other_pos, chrom, pos, 1 from bnd),
p as (select e.id, bp.type, (e.other_chrom = bp.other_chrom and abs(e.other_pos - bp.other_pos) <= 900)::int as two, bp.other_pos as bo, sw, abs(e.pos - bp.pos) as d, bp.pos as bpos
  from e join bp on e.chrom = bp.chrom and abs(e.pos - bp.pos) <= 900),
r as (select *, row_number() over (partition by id order by -two, sw, d, type, bpos) as k from p where two = 1 or bo = -1)
select id, type, two from r where k = 1""",
)
def _(t):
    return PX.two_ended(t.bnd, t.bp, 900)


@register(
    "jn08_insertions_in_duplications", "v",
    """, p as (select i.id as i_id, d.id as d_id from v i join v d on i.chrom = d.chrom and i.svtype = 'INS' and d.svtype = 'DUP' and i.pos between d.pos - 20 and d.pos + d.svlen + 20
  and least(i.svlen, d.svlen) / greatest(i.svlen, d.svlen) >= 0.9)
select i_id, count(*) as n, count(*) filter (where d_id in (select d_id from p group by d_id having count(*) = 1)) as single from p group by i_id""",
)
def _(t):
    pairs = PX.inside_similar(t.v.where("svtype = 'INS'"), t.v.where("svtype = 'DUP'"), 0.9, 20)
    single = PX.single_matches(pairs, "d_id").withColumn("one", F.lit(1))
    return pairs.join(single, "d_id", "left").groupBy("i_id").agg(F.count("*").alias("n"), F.count("one").alias("single"))


@register(
    "jn10_first_gap", "v tr",
    """select id, start, "end" from (select v.id, tr.start, tr."end", row_number() over (partition by v.id order by tr.start, tr."end") as k from v join tr using (chrom)
where v.svtype = 'INS' and v.pos between tr.start - 30 and tr."end" + 30 and v.svlen >= 2 * (tr."end" - tr.start)) where k = 1""",
)
def _(t):
    return PX.first_gap(t.v.where("svtype = 'INS'"), t.tr, 30, 2.0)


@register(
    "jn10_gaps_to_duplications", "v tr",
    """, i as (select *, concat('SVTYPE=INS;SVLEN=', svlen) as info from v where svtype = 'INS'),
f as (select i.id, tr.start, tr."end" as e, row_number() over (partition by i.id order by tr.start, tr."end") as k from i join tr using (chrom)
  where i.pos between tr.start - 30 and tr."end" + 30 and i.svlen >= 2 * (tr."end" - tr.start))
select 'dup' as kind, i.id, f.start as pos, '<DUP>' as alt, concat('SVTYPE=DUP;SVLEN=', e - start, ';END=', e, ';INS_POS=', i.pos, ';INS_ALT=ACGT;INS_QUAL=', i.qual) as info from i join f on i.id = f.id and k = 1
union all select 'ins', id, pos, 'ACGT', info from i where id not in (select id from f)""",
)
def _(t):
    ins = t.v.where("svtype = 'INS'").withColumns({"alt": F.lit("ACGT"), "info": F.concat(F.lit("SVTYPE=INS;SVLEN="), "svlen")})
    dups, rest = PX.gaps_to_duplications(ins, t.tr, 30, 2.0)
    named = [df.select(F.lit(kind).alias("kind"), "id", "pos", "alt", "info") for kind, df in (("dup", dups), ("ins", rest))]
    return named[0].unionByName(named[1])


CANDIDATES = """, b as (select * from v where caller = 'F'), c as (select * from v where caller = 'O'),
m as (select b.id as base_id, c.id as comp_id, least(b.svlen, c.svlen) / greatest(b.svlen, c.svlen) as score, abs(b.pos - c.pos) as dstart, abs(b.pos + b.svlen - c.pos - c.svlen) as dend
  from b join c on b.chrom = c.chrom and b.svtype = c.svtype and abs(b.pos - c.pos) <= 100 and least(b.svlen, c.svlen) / greatest(b.svlen, c.svlen) >= 0.7)"""


def _truth(t):
    base, comp = t.v.where("caller = 'F'"), t.v.where("caller = 'O'")
    return base, comp, PX.truth_candidates(base, comp, 100, 0.7)


STATES = """select 'base' as side, id, case when id in (select base_id from m) then 'tp' else 'fn' end as state from b
union all select 'comp', id, case when id in (select comp_id from m) then 'tp' else 'fp' end from c"""


@register("jn21_truth_multi", "v", CANDIDATES + STATES)
def _(t):
    return PX.match_multi(*_truth(t))


#: Similarity of the longer alleles, upper case, of records s and t; symbolic ones have none.
SEQUENCES = """(s.alt = '<DUP>' or t.alt = '<DUP>' or
  1 - levenshtein(upper(case when len(s.alt) >= len(s.ref) then s.alt else s.ref end), upper(case when len(t.alt) >= len(t.ref) then t.alt else t.ref end))
    / (greatest(len(s.alt), len(s.ref)) + greatest(len(t.alt), len(t.ref))) >= 0.9)"""


@register(
    "jn21_truth_sequences", "alleles",
    f""", b as (select * from alleles where caller = 'F'), c as (select * from alleles where caller = 'O'),
m as (select s.id as base_id, t.id as comp_id from b s join c t on s.chrom = t.chrom and s.svtype = t.svtype and abs(s.pos - t.pos) <= 100 and least(s.svlen, t.svlen) / greatest(s.svlen, t.svlen) >= 0.7
  and abs(s.pos + s.svlen - t.pos - t.svlen) <= 100 and least(s.pos + s.svlen, t.pos + t.svlen) - greatest(s.pos, t.pos) >= 0.5 * greatest(s.svlen, t.svlen) and {SEQUENCES})
""" + STATES,
)
def _(t):
    base, comp = t.alleles.where("caller = 'F'"), t.alleles.where("caller = 'O'")
    return PX.match_multi(base, comp, PX.truth_candidates(base, comp, 100, 0.7, sequence=0.9, overlap=0.5, both_ends=True))


@register("jn21_truth_single", "v")
def _(t):
    return PX.match_single(_truth(t)[2], written)


@register("jn22_close_breakpoints", "v", CANDIDATES + "select base_id, comp_id, dstart, dend from m where dstart <= 50 and dend <= 80 and dend <= 50")
def _(t):
    return PX.close_breakpoints(_truth(t)[2], 50).select("base_id", "comp_id", "dstart", "dend")


@register(
    "jn14_shared_clips", "reads",
    """, l as (select chrom, read_id::bigint % 500 as r, case when (flag & 16) <> 0 then 100 - mapq else mapq end as a from reads where read_id::bigint % 2 = 0),
r as (select chrom, read_id::bigint % 500 as r, case when (flag & 16) <> 0 then 100 - mapq else mapq end as b from reads where read_id::bigint % 2 = 1 or read_id::bigint % 10 = 0)
select chrom as record_id, count(distinct r) as reads, count(distinct case when abs(a - b) <= 10 then r end) as close_reads from l join r using (chrom, r) group by chrom""",
)
def _(t):
    n = F.col("read_id").cast("long")
    clips = t.reads.select("read_id", F.col("chrom").alias("record_id"), (F.col("flag").bitwiseAND(16) != 0).alias("is_rc"), F.col("mapq").alias("read_pos"), F.lit(100).alias("read_len"))
    left, right = clips.where(n % 2 == 0), clips.where((n % 2 == 1) | (n % 10 == 0))
    return PX.shared_clips(left.withColumn("read_id", n % 500), right.withColumn("read_id", n % 500), 10)


@register(
    "jn01_annotate", "v",
    """select v.id, s.s_name as note from v left join (select s_name, concat('chr', s_suppkey % 22 + 1) as chrom, (s_suppkey * 100 + 3)::int as pos from supplier) s using (chrom, pos)""",
)
def _(t):
    notes = t.table("supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1).alias("chrom"), (F.col("s_suppkey") * 100 + 3).cast("int").alias("pos"), F.col("s_name").alias("note"))
    return CO.annotate(t.v, notes, ["chrom", "pos"], ["note"]).select("id", "note")


BEST = "min_by(gt, struct_pack(a := -(len(list_filter(string_split(replace(gt, '|', '/'), '/'), lambda x: x <> '.'))), b := gt))"


@register(
    "jn15_merge_samples", "g",
    f""", m as (select variant_id, sample_id, {BEST} as gt from g where line < 4 or line > 4 group by all)
select variant_id as ref, count(*) as samples, count(*) filter (where contains(gt, '1')) as carriers, sum(len(gt) - len(replace(gt, '1', '')))::bigint as ac from m group by 1""",
)
def _(t):
    cells = t.g.where("line != 4").select(F.lit("chr1").alias("chrom"), F.lit(1).alias("pos"), F.col("variant_id").alias("ref"), F.lit("A").alias("alt"), "sample_id", "gt")
    gt = F.col("gt")
    return CO.merge_samples(cells).groupBy("ref").agg(F.count("*").alias("samples"), F.count_if(G.n_alts(gt) > 0).alias("carriers"), F.sum(G.n_alts(gt)).alias("ac"))


@register(
    "jn16_merge_by_id", "g",
    f""", m as (select variant_id, sample_id, {BEST} as gt from g group by all)
select variant_id, sample_id, gt from m where variant_id in (select variant_id from m where contains(gt, '1'))""",
)
def _(t):
    return CO.merge_by_id(t.g)


@register(
    "jn19_prefer_dataset", "",
    """, u as (select l_suppkey as k, 0 as dataset, l_orderkey as o from lineitem where l_linestatus = 'F' and l_suppkey % 3 <> 0
union all select l_suppkey, 1, l_orderkey from lineitem where l_linestatus = 'O' and l_suppkey % 4 <> 0),
w as (select k, case when k = 5 then coalesce(max(case when dataset = 0 then 0 end), max(dataset)) else max(dataset) end as d from u group by k)
select u.k, dataset, count(*) as n from u join w on u.k = w.k and dataset = d group by 1, 2""".replace(", u as", "with u as", 1),
)
def _(t):
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("k"), "l_linestatus", F.col("l_orderkey").alias("o"))
    sets = [rows.where("l_linestatus = 'F' and k % 3 != 0").drop("l_linestatus"), rows.where("l_linestatus = 'O' and k % 4 != 0").drop("l_linestatus")]
    return CO.prefer(sets, "k", {"5": 0}).groupBy("k", "dataset").agg(F.count("*").alias("n"))


@register(
    "jn20_compare_calls", "v",
    """select chrom, pos, case when o = 0 then 'old' when f = 0 then 'new' else 'both' end as state
from (select chrom, pos, count(*) filter (where caller = 'F') as f, count(*) filter (where caller = 'O') as o from v group by 1, 2)""",
)
def _(t):
    return CO.compare_keys(t.v.where("caller = 'F'"), t.v.where("caller = 'O'"), ["chrom", "pos"])


@register(
    "st02_union_distinct", "v",
    """select chrom, pos, svtype, svlen from (select *, row_number() over (partition by chrom, pos order by caller, svtype, svlen) as k from v) where k = 1""",
)
def _(t):
    parts = [t.v.where(f"caller = '{c}'").select("chrom", "pos", "svtype", "svlen") for c in "FO"]
    return CO.union_distinct(parts, ["chrom", "pos"])


@register(
    "st04_set_operations", "v",
    """select chrom, pos, 'both' as kind from (select chrom, pos from v where caller = 'F' intersect select chrom, pos from v where caller = 'O')
union all select chrom, pos, 'rest' from (select chrom, pos from v where caller = 'F' except all select chrom, pos from v where caller = 'O')""",
)
def _(t):
    f, o = (t.v.where(f"caller = '{c}'").select("chrom", "pos") for c in "FO")
    return f.intersect(o).withColumn("kind", F.lit("both")).unionByName(f.exceptAll(o).withColumn("kind", F.lit("rest")))


@register(
    "ag42_collapse_cells", "g",
    """, k as (select variant_id, line, gt, case when ad_alt % 4 = 0 then '.' else concat('F', ad_alt) end as ft, len(list_filter(string_split(replace(gt, '|', '/'), '/'), lambda x: x <> '.')) as c, sample_id::bigint * 10 + line as o from g)
select variant_id as ref, min_by(gt, struct_pack(a := -c, b := o, d := gt)) as gt, min_by(ft, case when ft <> '.' then o end) as ft, bit_or(case when contains(gt, '1') then 1 << line else 0 end)::int as supp
from (select * from k qualify row_number() over (partition by variant_id, o order by gt, ft) = 1) group by 1""",
)
def _(t):
    from pyspark.sql import Window

    o = F.col("sample_id").cast("long") * 10 + F.col("line")
    k = t.g.withColumns({"o": o, "ft": F.when(F.col("ad_alt") % 4 == 0, ".").otherwise(F.concat(F.lit("F"), "ad_alt"))})
    k = k.withColumn("r", F.row_number().over(Window.partitionBy("variant_id", "o").orderBy("gt", "ft"))).where("r = 1")
    gt = F.col("gt")
    best = F.min_by("gt", F.struct(-G.called(gt), "o"))
    return k.groupBy(F.col("variant_id").alias("ref")).agg(
        best.alias("gt"), F.min_by("ft", F.when(F.col("ft") != ".", F.col("o"))).alias("ft"),
        F.bit_or(F.when(G.n_alts(gt) > 0, F.call_function("shiftleft", F.lit(1), F.col("line"))).otherwise(0)).alias("supp"),
    )


@register(
    "ag16_discovery", "g",
    """select variant_id, count(*) filter (where contains(gt, '1')) as n_discovery, sum(len(gt) - len(replace(gt, '1', '')))::bigint as allele_count,
  sum(len(list_filter(string_split(replace(gt, '|', '/'), '/'), lambda x: x <> '.')))::bigint as called from g group by 1""",
)
def _(t):
    return CO.discovery(t.g, "variant_id")


@register(
    "ag22_canonize_breakends", "adj",
    """, k as (select *, concat_ws('@', chrom1, pos1, dir1) as e1, concat_ws('@', chrom2, pos2, dir2) as e2, (chrom1, pos1, dir1) <= (chrom2, pos2, dir2) as canon from adj)
select case when canon then e1 || '@' || e2 else e2 || '@' || e1 end as key, min_by(id, struct_pack(a := not canon, b := id)) as id, bool_or(canon) as canonical, count(*) as n, count(*) % 2 as singles, sum(support)::bigint as sum_support
from k group by 1""",
)
def _(t):
    return BE.canonize(t.adj, "support")


@register(
    "ag23_orientation_table", "adj",
    """select case dir1 when 1 then '+' else '-' end || case dir2 when 1 then '+' else '-' end as orientation, nullif(count(*) filter (where chrom1 = chrom2 and pos2 > pos1), 0) as "after",
  nullif(count(*) filter (where chrom1 = chrom2 and pos2 <= pos1), 0) as "before", nullif(count(*) filter (where chrom1 <> chrom2), 0) as other from adj group by 1""",
)
def _(t):
    return BE.orientation_table(t.adj)


@register("ag24_chromosome_matrix", "adj", "select chrom1, chrom2, count(*) as n from adj group by 1, 2")
def _(t):
    return BE.chromosome_matrix(t.adj)


ISLANDS = """, f as (select *, pos + svlen % 97 * 2 as last from v),
o as (select *, max(last) over (partition by chrom order by pos, id rows between unbounded preceding and 1 preceding) as reach from f),
i as (select *, sum(case when reach is null or pos > reach + 5 then 1 else 0 end) over (partition by chrom order by pos, id) as island from o),
t as (select chrom, island, min(pos) as first, max(last) as last, count(*) as n from i group by 1, 2)"""


def plan(least: int) -> str:
    """Chunks c1 of islands t, one island after the other."""
    return f""",
c as (select chrom, island, 1 as chunk, first, last, n from t where island = 1 union all
  select t.chrom, t.island, case when c.n >= {least} then c.chunk + 1 else c.chunk end, case when c.n >= {least} then t.first else c.first end,
    case when c.n >= {least} then t.last else greatest(c.last, t.last) end, case when c.n >= {least} then t.n else c.n + t.n end
  from c join t on t.chrom = c.chrom and t.island = c.island + 1),
c1 as (select chrom, chunk, arg_max(first, island) as first, arg_max(last, island) as last, arg_max(n, island) as n from c group by 1, 2)"""


def _islands(t):
    df = t.v.withColumn("last", F.col("pos") + F.col("svlen") % 97 * 2)
    return IS.island_totals(IS.islands(df, "pos", "last", 5, ["id"]), "pos", "last")


@register("wn01_islands", "v", ISLANDS + " select * from t")
def _(t):
    return _islands(t)


@register("wn01_chunk_plan", "v", ISLANDS + plan(40) + " select * from c1")
def _(t):
    return GR.chunk_plan(_islands(t), 40)


@register(
    "wn01_region_lines", "v",
    ISLANDS + plan(40) + " select concat(chrom, ':', first - 5, '-', last + 5) as region, chunk - 1 as chunk_id from c1",
)
def _(t):
    plan = written(GR.chunk_plan(_islands(t), 40), "plan")
    return GR.region_lines(GR.expect_total(plan, t.v.count()))


#: A walk over chunks k (chrom, i, e, n, length) as a packer by span 20000 with slack 500 makes it; a row with f says what it emits.
SPAN_WALK = """,
k as (select chrom, row_number() over (partition by chrom order by first, last) as i, count(*) over (partition by chrom) as n, last as e, length from c1 join contigs using (chrom)),
w as (select chrom, 0 as i, 0::bigint as begun, 0::bigint as reach, null::bigint as f, null::bigint as g from k where i = 1 union all
  select k.chrom, k.i, case when greatest(reach, e) - begun >= 20000 then case when k.i = n then length else greatest(reach, e) end + 500 else begun end,
    case when greatest(reach, e) - begun >= 20000 then case when k.i = n then length else greatest(reach, e) end + 500 else greatest(reach, e) end,
    case when greatest(reach, e) - begun >= 20000 then begun end,
    case when greatest(reach, e) - begun >= 20000 then case when k.i = n then length else greatest(reach, e) end + 500 end
  from w join k on k.chrom = w.chrom and k.i = w.i + 1)
select chrom, f as start, g as "end" from w where f is not null
union all select chrom, begun, length from w join k using (chrom, i) where k.i = n and reach < length"""


@register("wn03_pack_by_span", "v contigs", ISLANDS + plan(10) + SPAN_WALK)
def _(t):
    chunks = GR.chunk_plan(_islands(t), 10).select("chrom", F.col("first").alias("start"), F.col("last").alias("end"))
    return GR.pack_by_span(chunks, t.contigs, 20000, 500)


@register(
    "wn06_chunk_bounds", "v",
    """, f as (select chrom, pos - 1 as start, pos + svlen % 97 * 2 as e from v),
o as (select *, max(e) over (partition by chrom order by start, e rows between unbounded preceding and 1 preceding) as reach from f),
i as (select *, sum(case when reach is null or start > reach + 10 then 1 else 0 end) over (partition by chrom order by start, e) as island from o)
select chrom, min(start) as start, max(e) as "end", count(*) as n from i group by chrom, island""",
)
def _(t):
    return GR.chunk_bounds(t.v.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + F.col("svlen") % 97 * 2).alias("end")), 10)


@register(
    "wn04_label_runs", "labelled",
    """, o as (select *, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as new from labelled window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from o)
select user_id, event_type, run, min(event_id) as first, max(event_id) as last, count(*) as n from r group by 1, 2, 3""",
)
def _(t):
    timed = t.labelled.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return IS.label_runs(timed, ["user_id"], ["at", "event_id"], "event_type", "event_id", block=86_400_000_000)


@register(
    "wn07_composite_variants", "g",
    """, h as (select sample_id, variant_id::int * 100 as s, variant_id::int * 100 + svlen as e, variant_id as id from g where contains(gt, '1')),
o as (select *, max(e) over (partition by sample_id order by s, e, id rows between unbounded preceding and 1 preceding) as reach from h),
r as (select *, sum(case when reach is null or s > reach + 3000 then 1 else 0 end) over (partition by sample_id order by s, e, id rows unbounded preceding) as run from o)
select sample_id, string_agg(id, ',' order by s, e, id) as key, count(*) as n from r group by sample_id, run having count(*) >= 2""",
)
def _(t):
    p = F.col("variant_id").cast("int") * 100
    alt = t.g.where(G.n_alts(F.col("gt")) > 0).select("sample_id", p.alias("start"), (p + F.col("svlen")).alias("end"), F.col("variant_id").alias("id"))
    return IS.composite_variants(alt, ["sample_id"], 3000, 2)


@register(
    "wn08_isolated_ends", "reads",
    """, e as (select read_id::bigint // 32 as r, pos as first, pos + mapq as last from reads)
select r as read_id, first, last, coalesce(first - max(last) over (partition by r order by first, last rows between unbounded preceding and 1 preceding) > 60, true) as start_alone,
  coalesce(min(first) over (partition by r order by first, last rows between 1 following and unbounded following) - last > 60, true) as end_alone from e""",
)
def _(t):
    e = t.reads.select(F.floor(F.col("read_id").cast("long") / 32).alias("read_id"), F.col("pos").alias("first"), (F.col("pos") + F.col("mapq")).alias("last"))
    return IS.isolated_ends(e, 60)


@register(
    "wn10_concordance", "reads",
    """, a as (select read_id::bigint // 32 as r, read_id::bigint as q, case read_id::bigint // 2 % 5 when 0 then 'chr1' when 1 then 'chr1' when 2 then 'chr2' when 3 then 'chrUn' else 'chr1' end as chrom, (flag & 2) <> 0 as strand,
  read_id::bigint * 37 % 1000 as f, read_id::bigint * 37 % 1000 + mapq as l from reads),
m as (select r, chrom as mc, strand as ms from (select r, chrom, strand, count(*) as n from a group by all) qualify row_number() over (partition by r order by n desc, chrom, strand) = 1),
w as (select *, lag(l) over z as pl, lag(chrom) over z as pc, lag(strand) over z as ps, lead(f) over z as nf, lead(chrom) over z as nc, lead(strand) over z as ns from a window z as (partition by r order by f))
select q, case when chrom <> mc then 3 when strand <> ms then 2 when (pl is null or pc <> chrom or ps <> strand or abs(f - pl) <= 60) and (nf is null or nc <> chrom or ns <> strand or abs(nf - l) <= 60) then 0 else 1 end as class
from w join m using (r) where mc <> 'chrUn'""",
)
def _(t):
    n = F.col("read_id").cast("long")
    chrom = F.when(F.floor(n / 2) % 5 == 2, "chr2").when(F.floor(n / 2) % 5 == 3, "chrUn").otherwise("chr1")
    a = t.reads.select(F.floor(n / 32).alias("read_id"), n.alias("q"), (n * 37 % 1000).alias("read_first"), (n * 37 % 1000 + F.col("mapq")).alias("read_last"), chrom.alias("chrom"), (F.col("flag").bitwiseAND(2) != 0).alias("strand"))
    return IS.concordance(a, 60).select("q", "class")


@register(
    "wn15_neighbours", "v",
    """, c as (select chrom, pos, count(*) as n from v group by 1, 2), w as (select chrom, pos, sum(n) over (partition by chrom order by pos range between 150 preceding and 150 following) as a from c)
select id, (a - 1)::bigint as n_neighbours from v join w using (chrom, pos)""",
)
def _(t):
    return IS.neighbours(t.v, 150).select("id", "n_neighbours")


@register(
    "wn11_depth_steps", "dep",
    """, s as (select "window" as w, pos, depth, avg(depth) over z1 as l, avg(depth) over z2 as r, count(*) over z3 as seen, pos - min(pos) over z as i, count(*) over z as n from dep
  window z as (partition by "window"), z1 as (partition by "window" order by pos rows between 10 preceding and 1 preceding), z2 as (partition by "window" order by pos rows between current row and 9 following),
    z3 as (partition by "window" order by pos rows between 10 preceding and 9 following)),
u0 as (select *, count(*) over (partition by w) > 12 as many from s where seen = 20 and l >= 3 and r / l >= 1.2),
u as (select w, case when i = 10 then pos else pos - 1 end as up_pos, l as ul, row_number() over (partition by w order by case when many then - r / l end, pos) as uk from u0 qualify uk <= 12),
d0 as (select *, count(*) over (partition by w) > 12 as many from s where seen = 20 and r >= 3 and l / r >= 1.2),
d as (select w, case when i = n - 10 then pos - 1 else pos end as down_pos, r as dl, row_number() over (partition by w order by case when many then - l / r end, -pos) as dk from d0 qualify dk <= 12),
p as (select u.w, up_pos, down_pos, least(ul, dl) as low, uk, dk from u join d on u.w = d.w and up_pos < down_pos where not (u.w % 2 = 0 and abs(up_pos - 99) <= 4 and abs(down_pos - 200) <= 4)),
m as (select p.*, list_sort(list(depth))[count(*) // 2 + 1] as median from p join dep on dep."window" = p.w and dep.pos between up_pos and down_pos group by all)
select w as "window", up_pos, down_pos, median from m where median >= 10 and median >= low * 1.2 qualify row_number() over (partition by w order by up_pos - down_pos, uk, dk) = 1""",
)
def _(t):
    known = t.dep.where("`window` % 2 = 0").select("window", F.lit(99).alias("start"), F.lit(200).alias("end")).distinct()
    return IS.depth_steps(t.dep, 10, 1.2, 12, 3, 10, known, 4)


@register("wn18_collapse", "v")
def _(t):
    return collapse(t.v, similar_pairs(t.v, 100, 0.9, ranked=True), written)


@register(
    "wn18_similar_pairs", "v",
    """select a.id as better, b.id as worse from v a join v b on a.chrom = b.chrom and a.svtype = b.svtype and abs(a.pos - b.pos) <= 100 and least(a.svlen, b.svlen) / greatest(a.svlen, b.svlen) >= 0.9
where (-a.qual, a.pos, a.id) < (-b.qual, b.pos, b.id)""",
)
def _(t):
    return similar_pairs(t.v, 100, 0.9)


@register(
    "wn18_similar_sequences", "alleles",
    f"""select s.id as better, t.id as worse from alleles s join alleles t on s.chrom = t.chrom and s.svtype = t.svtype and abs(s.pos - t.pos) <= 100 and least(s.svlen, t.svlen) / greatest(s.svlen, t.svlen) >= 0.9
where (-s.qual, s.pos, s.id) < (-t.qual, t.pos, t.id) and {SEQUENCES}""",
)
def _(t):
    return similar_pairs(t.alleles, 100, 0.9, 0.9)


@register(
    "wn14_haplotypes", "",
    """with o as (select o_orderkey % 5 as w, o_custkey % 7 as s, o_orderkey as id, o_orderkey % 40 as first, o_orderkey % 40 + o_custkey % 3 as last, repeat('T', (o_custkey % 2)::int) as alt from orders)
select w, count(distinct s) as haps from o group by w""",
)
def _(t):
    o = t.table("orders")
    members = o.select(
        (F.col("o_orderkey") % 5).alias("w"), (F.col("o_custkey") % 7).alias("sample_id"), F.lit(0).alias("hap"), F.col("o_orderkey").alias("record_id"),
        (F.col("o_orderkey") % 40).alias("first"), (F.col("o_orderkey") % 40 + F.col("o_custkey") % 3).alias("last"), F.repeat(F.lit("T"), (F.col("o_custkey") % 2).cast("int")).alias("alt"),
    )
    blocks = t.spark.range(5).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("start"), F.repeat(F.lit("ACGTG"), F.lit(10)).alias("seq"))
    return CO.haplotypes(members, ["w"], blocks).groupBy("w").agg(F.count("*").alias("haps"))
