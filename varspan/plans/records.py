"""Queries over single records: functions, rewrites and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from varspan.functions import alleles as A
from varspan.functions import binning as B
from varspan.functions import cigar as C
from varspan.functions import genotypes as G
from varspan.functions import info as I
from varspan.functions import sequence as S
from varspan.operators import filters as FL
from varspan.operators import reference as RF
from varspan.operators import rewrite as R
from varspan.plans.proxies import register

KIND = """case when regexp_full_match(alt, '[ACGTRYSWKMBDHVNacgtryswkmbdhvn]+') then 0 when regexp_full_match(alt, '<.*>') then 1
  when contains(alt, '[') or contains(alt, ']') then 2 else -1 end"""
TYPED = f"""k as (select *, {KIND} as kind, regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1) as sl, regexp_extract(info, '(?:^|;)END=([^;]*)', 1) as en from calls),
t as (select *, case when kind = 1 then substr(alt, 2, 3) when kind = 2 then 'BND' when kind = 0 and len(ref) = 1 and len(alt) > 1 then 'INS'
    when kind = 0 and len(ref) > 1 and len(alt) = 1 then 'DEL' when kind = 0 and len(ref) > 1 and len(alt) > 1 then 'SUB' else 'UNK' end as svtype from k),
s as (select *, case when kind = 1 then coalesce(abs(try_cast(sl as int)), case when try_cast(en as int) - pos > 0 then try_cast(en as int) - pos end, -1)
    when kind = 2 then null when svtype = 'INS' then len(alt) - 1 else len(ref) - 1 end as svlen from t)"""

#: With the type that info has, if it has one, and lengths of 0 for what has none.
ANNOTATED = f"""{TYPED}, y as (select * exclude (svtype, svlen), coalesce(nullif(substr(regexp_extract(info, '(?:^|;)SVTYPE=([^;]*)', 1), 1, 3), ''), svtype) as svtype, svlen as alleles from s),
a as (select *, case when svtype = 'BND' then 0 when kind = 0 and svtype = 'INS' then len(alt) - 1 when kind = 0 then len(ref) - 1
    when kind = 1 then greatest(alleles, 0) else 0 end as svlen from y)"""


def _set(expr: str, key: str, value: str) -> str:
    return (
        f"case when {expr} = '.' then concat('{key}=', {value}) when regexp_matches({expr}, '(?:^|;){key}=') then "
        f"regexp_replace({expr}, '(^|;){key}=[^;]*', concat('\\1{key}=', {value})) else concat({expr}, ';{key}=', {value}) end"
    )


@register(
    "pr01_type_and_length", "calls",
    f", {ANNOTATED} select id, svtype, svlen, case when svlen > 0 or regexp_matches(info, '(?:^|;)SVLEN=') then "
    f"{_set('(' + _set('info', 'SVTYPE', 'svtype') + ')', 'SVLEN', 'svlen::varchar')} else {_set('info', 'SVTYPE', 'svtype')} end as info from a",
)
def _(t):
    return R.add_type_and_length(t.calls).select("id", "svtype", "svlen", "info")


#: Types in INFO that need not be those of ALT.
INFO_TYPE = "concat('SVTYPE=', case cast(qual as int) % 6 when 0 then 'DEL' when 1 then 'INV' when 2 then 'DUP' when 3 then 'INS' when 4 then 'CNV' else 'BND' end, ';', info)"


def _length_in_alt(types: str) -> str:
    return f""", k as (select id, alt, regexp_extract(i, 'SVTYPE=([A-Z]+)', 1) as k, try_cast(regexp_extract(i, '(?:^|;)SVLEN=([^;]*)', 1) as int) as n from (select *, {INFO_TYPE} as i from calls)),
a as (select id, case when alt like '<%' and k in ({types}) and n is not null then concat('<', k, '-', n, '>') else alt end as alt from k)
select id, alt, case when alt like '<%' then concat(substr(alt, 1, 4), '>') else alt end as back from a"""


@register("pr02_length_in_alt", "calls", _length_in_alt("'DEL', 'INV', 'DUP', 'CNV'"))
def _(t):
    long = R.length_into_alt(t.calls.withColumn("info", F.expr(INFO_TYPE)))
    return long.select("id", "alt").join(R.length_out_of_alt(long).select("id", F.col("alt").alias("back")), "id")


@register("pr03_length_in_alt_with_insertions", "calls", _length_in_alt("'DEL', 'INV', 'DUP', 'INS', 'CNV'"))
def _(t):
    long = R.length_into_alt(t.calls.withColumn("info", F.expr(INFO_TYPE)), with_insertions=True)
    return long.select("id", "alt").join(R.length_out_of_alt(long).select("id", F.col("alt").alias("back")), "id")


@register(
    "pr07_fix_and_fit", "calls contigs",
    f""", {TYPED}, f as (select * exclude (info), case when regexp_full_match(ref, '[ACGTNacgtn]{{2,}}') and regexp_full_match(alt, '[ACGTNacgtn]{{2,}}')
  and regexp_matches(info, '(?:^|;)SVLEN=') then {_set('info', 'SVLEN', '(len(ref) - 1)::varchar')} else info end as info from s)
select id, upper(ref) as ref, upper(regexp_replace(alt, '^(<...).*$', '\\1>')) as alt,
  {_set('info', 'END', "(case when alt like '<%' and alt not like '<INS%' then pos + svlen else pos end)::varchar")} as info
from f join contigs using (chrom) where pos between 1 and length and not (alt like '<%' and alt not like '<INS%' and pos + svlen > length)""",
)
def _(t):
    typed = t.calls.withColumn("svlen", A.svlen(F.col("pos"), F.col("ref"), F.col("alt"), F.col("info")))
    return R.fit_to_contigs(R.fix_replacement_length(typed), t.contigs).select("id", "ref", "alt", "info")


@register(
    "pr09_compress_alleles", "v contigs",
    """select v.id, concat('<', svtype, '-', svlen, '>') as alt, 'N' as ref, 1.0::double as qual, 'PASS' as filter from v join contigs using (chrom)
where svtype <> 'INS' and pos between 1 and length union all
select id, 'ACGT' as alt, 'A' as ref, 1.0::double, 'PASS' from v join contigs using (chrom) where svtype = 'INS' and pos between 1 and length""",
)
def _(t):
    v = t.v.withColumns({"ref": F.lit("A"), "alt": F.lit("ACGT"), "filter": F.lit(".")})
    return R.compress_alleles(v, t.contigs, 1.0).select("id", "alt", "ref", "qual", "filter")


@register(
    "pr11_clean_alleles", "calls",
    r""", c as (select * replace (case when regexp_matches(alt, '[\[\]]') then replace(alt, 'N', 'gR') else alt end as alt, case when regexp_matches(alt, '[\[\]]') then 'y' else ref end as ref) from calls)
select id, case when regexp_matches(alt, '[\[\]]') then upper(ref) else regexp_replace(upper(ref), '[^ACGT]', 'N', 'g') end as ref, case when alt like '<%' then alt
  when regexp_matches(alt, '[\[\]]') then concat(upper(regexp_extract(alt, '^([^\[\]]*)', 1)), regexp_extract(alt, '([\[\]].*[\[\]])', 1), upper(regexp_extract(alt, '([^\[\]]*)$', 1)))
  else regexp_replace(upper(alt), '[^ACGT]', 'N', 'g') end as alt, 9.0::double as qual, 'PASS' as filter from c""",
)
def _(t):
    bnd = F.col("alt").rlike(r"[\[\]]")
    ends = t.calls.where(bnd).withColumns({"ref": F.lit("y"), "alt": F.expr("replace(alt, 'N', 'gR')")})
    out = R.clean_alleles(t.calls.where(~bnd), 9).unionByName(R.clean_breakends(ends, 9))
    return out.select("id", "ref", "alt", "qual", "filter")


@register(
    "pr13_parity_and_id", "adj",
    """select id, case when a % 2 + b % 2 = 0 then 0 when a % 2 <> b % 2 then 1 else 2 end as parity, concat('<DEL-', id, '>') as alt
from (select id, substr(chrom1, 4)::int as a, substr(chrom2, 4)::int as b from adj)""",
)
def _(t):
    return R.id_into_alt(t.adj).select("id", R.mate_parity(F.col("chrom1"), F.col("chrom2")).alias("parity"), "alt")


BND = r"""b as (select *, regexp_extract(alt, '[\[\]](.+):([0-9]+)[\[\]]', 1) as mc, regexp_extract(alt, '[\[\]](.+):([0-9]+)[\[\]]', 2)::varchar as mps, try_cast(regexp_extract(alt, '[\[\]](.+):([0-9]+)[\[\]]', 2) as int) as mp,
  case when alt like '[%' or alt like ']%' then 0 else 1 end as d1, case when contains(alt, ']') then 1 else 0 end as d2 from calls where regexp_matches(alt, '[\[\]]'))"""


@register(
    "pr15_symmetrize", "calls",
    f""", {BND} select id, mc as chrom, mp as pos, 'N' as ref, case when d2 = 1 then concat('N', m) else concat(m, 'N') end as alt,
  case when info = '.' then 'SYMMETRIZED' else info || ';SYMMETRIZED' end as info
from (select *, concat(case when d1 = 1 then ']' else '[' end, chrom, ':', pos, case when d1 = 1 then ']' else '[' end) as m from b)""",
)
def _(t):
    return R.symmetrize(t.calls.where(F.col("alt").rlike(r"[\[\]]"))).select("id", "chrom", "pos", "ref", "alt", "info")


#: Breakends of one base and of several.
MORE_BASES = "replace(alt, 'N', case when cast(qual as int) % 2 = 0 then 'gT' else 'A' end)"


@register(
    "pr14_drop_orientation", "calls",
    f""", {BND}, p as (select id, string_split(replace({MORE_BASES}, ']', '['), '[') as p from b)
select id, concat(p[1], p[3], '[', p[2], '[') as alt from p""",
)
def _(t):
    return R.drop_orientation(t.calls.where(F.col("alt").rlike(r"[\[\]]")).withColumn("alt", F.expr(MORE_BASES))).select("id", "alt")


@register(
    "pr16_shift_duplications", "v contigs",
    """select id, least(pos + svlen, length)::int as forward, greatest(pos - svlen, 1)::int as backward from v join contigs using (chrom) where svtype = 'DUP'""",
)
def _(t):
    dup = t.v.where("svtype = 'DUP'")
    there = R.shift_duplications(dup, t.contigs, True).select("id", F.col("pos").alias("forward"))
    back = R.shift_duplications(dup, t.contigs, False).select("id", F.col("pos").alias("backward"))
    return there.join(back, "id")


#: A duplication that was an insertion, with and without the insertion's length; others have a place but no mark.
WAS_INSERTION = """case when svtype = 'INS' then concat('SVTYPE=DUP;SVLEN=', cast(svlen as string), ';END=', cast(pos + svlen as string), ';INSDUP;INS_POS=', cast(pos - 5 as string), ';INS_ALT=ACG;K=1;',
  case when line % 2 = 0 then 'INS_SVLEN=7;' else '' end, 'INS_QUAL=3') else concat('SVLEN=', cast(svlen as string), ';INS_POS=4') end"""


@register(
    "pr18_restore_insertions", "v",
    """select id, case when svtype = 'INS' then pos - 5 else pos end as pos, case when svtype = 'INS' then 'ACG' else '<DUP>' end as alt, case when svtype = 'INS' then 3.0::double else qual::double end as qual,
  case when svtype = 'INS' then concat('SVTYPE=INS;SVLEN=', case when line % 2 = 0 then 7 else 3 end, ';END=', pos - 5, ';INSDUP;K=1;INSDUP_POS=', pos, ';INSDUP_SVLEN=', svlen)
    else concat('SVLEN=', svlen, ';INS_POS=4') end as info from v""",
)
def _(t):
    v = t.v.withColumns({"alt": F.lit("<DUP>"), "info": F.expr(WAS_INSERTION), "qual": F.col("qual").cast("double")})
    return R.restore_insertions(v).select("id", "pos", "alt", "qual", "info")


@register(
    "pr19_intervals_to_records", "tr",
    """select chrom, start + 1 as pos, concat_ws('_', chrom, start, "end") as id, 'N' as ref, '<DEL>' as alt, 'DEL' as svtype, "end" - start as svlen from tr""",
)
def _(t):
    return R.intervals_to_records(t.tr, "DEL")


@register(
    "pr20_assembly_calls", "calls",
    """select id, case when len(alt) > len(ref) then 'INS' when len(alt) < len(ref) then 'DEL' else 'SUB' end as svtype, abs(len(alt) - len(ref)) as svlen,
  concat('SVTYPE=', case when len(alt) > len(ref) then 'INS' when len(alt) < len(ref) then 'DEL' else 'SUB' end, ';SVLEN=', abs(len(alt) - len(ref))) as info, 'PASS' as filter
from calls where filter in ('.', 'PASS') and abs(len(alt) - len(ref)) >= 6""",
)
def _(t):
    return R.assembly_calls(t.calls, 6).select("id", "svtype", "svlen", "info", "filter")


@register(
    "pr23_correct_genotypes", "g",
    """, n as (select *, replace(gt, '|', '/') as p from g), m as (select gt, replace(case when p = '0/0' and ad_ref < 8 then '0/1' when p in ('0/1', '1/0') and ad_alt < 8 then '0/0'
  when p in ('0/1', '1/0') and ad_ref < 8 then '1/1' when p = '1/1' and ad_alt < 8 then '0/1' when p = '0' and ad_ref < 8 then '1' when p = '1' and ad_alt < 8 then '0' else p end, '/', case when contains(gt, '|') then '|' else '/' end) as new_gt from n)
select gt, new_gt, count(*) as n from m group by gt, new_gt""",
)
def _(t):
    return R.correct_genotypes(t.g, 8, True).groupBy("gt", "new_gt").agg(F.count("*").alias("n"))


@register(
    "pr24_caller_flags", "v",
    """select id, (line & 1)::int as pav, ((line >> 1) & 1)::int as pbsv, ((line >> 2) & 1)::int as sniffles from v""",
)
def _(t):
    return t.v.select("id", *R.caller_flags(F.col("line")).values())


@register(
    "pr25_genotype_features", "g",
    r"""select gt, ad_ref, ad_alt, case when regexp_full_match(gt, '[./|]+') then -1 else len(gt) - len(replace(gt, '1', '')) end as gt_count,
  case when ad_ref = 3 then -1 else ad_ref end as ks_1, -1 as ks_2, count(*) as n from g group by all""",
)
def _(t):
    g = t.g.withColumns({"ks": F.when(F.col("ad_ref") == 3, ".").otherwise(F.concat("ad_ref", F.lit(",."))), "ad": F.concat_ws(",", "ad_ref", "ad_alt")})
    return R.genotype_features(g.drop("ad_ref", "ad_alt")).groupBy("gt", "ad_ref", "ad_alt", "gt_count", "ks_1", "ks_2").agg(F.count("*").alias("n"))


@register(
    "pr27_rekey", "calls",
    """select id, concat_ws('_', chrom, row_number() over (partition by chrom order by pos, ref, alt, id)) as new_id from calls""",
)
def _(t):
    return R.rekey(t.calls).select("id", "new_id")


@register(
    "pr32_split_alleles", "g",
    r"""select variant_id, sample_id, 'A' as alt, gt, line from g where line <> 5 union all
select variant_id, sample_id, 'C', regexp_replace(gt, '1', '0', 'g'), line from g where line <> 5""",
)
def _(t):
    return R.split_alleles(t.g.where("line != 5").withColumn("alt", F.lit("A,C"))).select("variant_id", "sample_id", "alt", "gt", "line")


def letter(p: str) -> str:
    """The base of a made-up reference at place p: stretches of two letters in turn, the same again after 168 bases."""
    return f"substring('ACGT', cast((floor(floor(({p}) / 6.0) * floor(({p}) / 6.0) / 7.0) + ({p}) % 2 * 3) % 4 as int) + 1, 1)"


#: Bases 0 to 167 of that reference: what letter(p) gives at each place.
PERIOD = "".join("ACGT"[((p // 6) ** 2 // 7 + p % 2 * 3) % 4] for p in range(168))


def letters(first, n):
    """The bases from place first on, n of them: a piece of the repeated period, the same as letter place by place."""
    turns = F.call_function("div", n, F.lit(len(PERIOD))) + 2
    return F.substring(F.repeat(F.lit(PERIOD), turns.cast("int")), (first % len(PERIOD) + 1).cast("int"), n.cast("int"))


def _blocks(contigs, size: int):
    """chrom, length, block: the blocks of each contig, dealt over tasks by themselves (contigs are few)."""
    numbered = contigs.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))))
    return numbered.repartition("chrom", "block")


def reference_blocks(t, size: int):
    first = F.col("block") * size + 1
    return _blocks(t.contigs, size).select("chrom", "block", letters(first, F.least(F.lit(size), F.col("length") - first + 1)).alias("seq"))


#: Alleles that agree with the reference by chance: of one base, several, small letters, symbolic, two at once.
ONE_REF = "case line when 1 then 'A' when 2 then 'c' when 3 then 'N' when 4 then 'ACA' when 5 then 'ga' else 'T' end"
ONE_ALT = "case qual % 4 when 0 then 'G' when 1 then 'T,A' when 2 then '<DEL>' else 'c' end"


@register(
    "pr32_check_reference", "v contigs",
    f""", r as (select *, {ONE_REF} as ref, {ONE_ALT} as alt from v),
o as (select r.*, case when pos >= 1 and pos + len(ref) - 1 <= length then array_to_string(list_transform(range(pos, pos + len(ref)), lambda p: {letter('p')}), '') end as own,
  {letter('pos')} as one, string_split(alt, ',') as alts from r left join contigs using (chrom)),
s as (select *, case when own is null then 'off' when own = upper(ref) then 'same' when upper(alts[1]) = one or upper(alts[2]) = one then 'swapped' else 'set' end as state,
  case when upper(alts[1]) = one then 1 else 2 end as k from o)
select id, case state when 'set' then own when 'swapped' then alts[k] else ref end as ref,
  case when state <> 'swapped' then alt when k = 1 then concat_ws(',', ref, alts[2]) else concat(alts[1], ',', ref) end as alt, state as ref_state from s""",
)
def _(t):
    v = t.v.withColumns({"ref": F.expr(ONE_REF), "alt": F.expr(ONE_ALT)})
    return RF.check_reference(v, reference_blocks(t, 4096), 4096, t.contigs).select("id", "ref", "alt", "ref_state")


def _indels(t):
    """Deletions and insertions of 1 to 50 bases, as the reference of records.letter has them."""
    size = F.expr("cast(svlen / 20 as int)")
    body = letters(F.col("pos") + 1, size)
    v = t.v.join(t.contigs, "chrom").where(F.col("pos") + size <= F.col("length")).withColumn("one", letters(F.col("pos"), F.lit(1)))
    long = F.concat("one", body)
    return v.withColumns({"ref": F.when(F.col("svtype") == "INS", F.col("one")).otherwise(long), "alt": F.when(F.col("svtype") == "INS", long).otherwise(F.col("one"))})


@register("pr32_left_align", "v contigs")  # tests hold it against a loop over each contig
def _(t):
    return RF.left_align(_indels(t).select("id", "chrom", "pos", "ref", "alt"), reference_blocks(t, 4096), 4096)


@register(
    "pr34_fill_manifest", "",
    """select c_custkey, case when trim(m) <> '' then m else concat('gs/', c_custkey, '.bam') end as bam, coalesce(cov, 'NA') as coverage
from (select c_custkey, case when c_custkey % 2 = 0 then '  ' else c_mktsegment end as m from customer)
left join (select s_suppkey as c_custkey, s_nationkey::varchar as cov from supplier) using (c_custkey)""",
)
def _(t):
    m = t.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("bam"))
    cov = t.table("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("coverage"))
    return R.with_coverage(R.fill_manifest(m, "bam", "gs/", ".bam", "c_custkey"), cov, "c_custkey")


#: Records with sequences, of types that have none, without a length, in small letters.
GIVEN_ALT = "case when line = 1 then 'AC' when line = 2 then '<CNV>' when line = 3 then concat('<', lower(svtype), '>') when line = 4 then 'N[chr1:5[' when line = 6 then '<BND>' else concat('<', svtype, '>') end"
GIVEN_INFO = "concat('SVTYPE=', svtype, case when line = 5 then '' else concat(';SVLEN=', cast(svlen as string)) end, ';END=', cast(pos + svlen as string), ';K=1')"


@register(
    "pr05_materialize", "v contigs",
    f""", g as (select *, {GIVEN_ALT} as alt, {GIVEN_INFO} as info from v union all select *, {GIVEN_ALT}, {GIVEN_INFO} from v where svlen < 200),
x as (select g.*, length, repeat('ACGTTGCAAC', 102)[(pos - 1) % 10 + 1:(pos - 1) % 10 + 1 + svlen] as s from g join contigs using (chrom) where pos between 1 and length)
select id, 'N' as ref, alt, info, svtype from x where alt not like '<%'
union all select id, case when svtype = 'DUP' then s[1:1] else s end, case when svtype = 'DEL' then s[1:1] else s end,
  case when svtype = 'DUP' then concat('SVTYPE=INS;SVLEN=', svlen, ';END=', pos, ';K=1') else info end, case when svtype = 'DUP' then 'INS' else svtype end
from x where upper(alt) in ('<DEL>', '<DUP>') and line <> 5 and pos + svlen <= length""",
)
def _(t):
    size = 4096
    at = F.col("block") * size
    blocks = _blocks(t.contigs, size).select("chrom", "block", F.substring(F.repeat(F.lit("ACGTTGCAAC"), F.lit(412)), at % 10 + 1, F.least(F.lit(size), F.col("length") - at)).alias("seq"))
    v = t.v.withColumns({"ref": F.lit("N"), "alt": F.expr(GIVEN_ALT), "info": F.expr(GIVEN_INFO)})
    v = v.unionByName(v.where("svlen < 200"))
    return R.materialize(v, blocks, size, t.contigs).select("id", "ref", "alt", "info", "svtype")


@register(
    "fn01_info_fields", "calls",
    r"""select id, nullif(regexp_extract(info, '(?:^|;)SVLEN=([^;]*)', 1), '') as svlen, regexp_matches(info, '(?:^|;)END=') as has_end,
  case when info like 'SVLEN=%;PRECISE' then 'PRECISE' when regexp_matches(info, ';SVLEN=') then regexp_replace(info, ';SVLEN=[^;]*', '') else info end as without,
  case when regexp_matches(info, '(?:^|;)END=') then regexp_replace(info, 'END=[^;]*', 'END=7') else info end as replaced, len(list_filter(string_split(info, ';'), lambda x: x <> '.')) as n_keys
from calls""",
)
def _(t):
    i = F.col("info")
    return t.calls.select(
        "id", I.info_field(i, "SVLEN").alias("svlen"), I.has_info_field(i, "END").alias("has_end"), I.delete_info_field(i, "SVLEN").alias("without"),
        I.replace_info_field(i, "END", F.lit("7")).alias("replaced"), F.size(I.info_map(i)).cast("long").alias("n_keys"),
    )


@register("fn06_alt_kinds", "calls", f"select {KIND} as kind, count(*) as n from calls group by 1")
def _(t):
    return t.calls.groupBy(A.alt_kind(F.col("alt")).alias("kind")).agg(F.count("*").alias("n"))


@register("fn08_breakend_parse", "calls", f", {BND} select id, chrom as chrom1, pos as pos1, d1 as dir1, mc as chrom2, mp as pos2, d2 as dir2, case when mc = chrom and mp = pos then 3 else 0 end as error from b")
def _(t):
    b = A.breakend(F.col("chrom"), F.col("pos"), A.repair_zero_mate(F.col("alt")))
    return t.calls.where(F.col("alt").rlike(r"[\[\]]")).select("id", b.alias("b")).select("id", "b.*")


@register(
    "fn10_sequence_features", "seqs",
    """, x as (select doc_id, seq, len(seq) as n from seqs),
c as (select *, [n - len(replace(seq, 'a', '')), n - len(replace(seq, 'c', '')), n - len(replace(seq, 'g', '')), n - len(replace(seq, 't', ''))] as k from x)
select doc_id, upper(reverse(translate(seq, 'acgt', 'tgca'))) as rc, case when n > 0 then round(list_sum(list_transform(k, lambda z: case when z > 0 then -(z / n) * ln(z / n) else 0.0 end)), 6) else -1.0 end as entropy0,
  case when n > 0 then round((k[2] + k[3]) / n, 6) end as gc, (len(list_filter(k, lambda z: z > 0)) <= 2)::int as low,
  case when n > 3 then round(len(list_filter(range(1, n - 2), lambda i: seq[i:i] = seq[i + 3:i + 3])) / n, 6) end as auto3,
  case when n > 0 then round((1 + len(list_filter(range(2, n + 1), lambda i: seq[i:i] <> seq[i - 1:i - 1]))) / n, 6) end as runs from c""",
)
def _(t):
    s = F.col("seq")
    return t.seqs.select(
        "doc_id", F.upper(S.reverse_complement(s)).alias("rc"), F.round(S.entropy(s, 0), 6).alias("entropy0"), F.round(S.gc_fraction(s), 6).alias("gc"),
        S.low_complexity(s).alias("low"), F.round(S.autocorrelation(s, 3), 6).alias("auto3"), F.round(S.runs(s)["runs"], 6).alias("runs"),
    )


@register(
    "fn16_cigar_walk", "reads",
    r""", o as (select read_id, pos, cigar, seq, flag, list_transform(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), lambda x: struct_pack(n := x[:-2]::int, op := x[-1:])) as ops from reads)
select read_id, (pos - 1 + coalesce(list_sum(list_transform(ops, lambda x: case when x.op in ('M', 'D', 'N', '=', 'X') then x.n else 0 end)), 0))::int as ref_end,
  list_sum(list_transform(ops, lambda x: case when x.op in ('M', 'I', '=', 'X') then x.n else 0 end))::int as read_span,
  coalesce(try_cast(regexp_extract(cigar, '^([0-9]+)[SH]', 1) as int), 0) as clip_left, coalesce(try_cast(regexp_extract(cigar, '([0-9]+)[SH]$', 1) as int), 0) as clip_right,
  len(list_filter(ops, lambda x: x.op in ('I', 'D') and x.n >= 20)) as n_indels, (list_sum(list_transform(ops, lambda x: case when x.op = 'H' then x.n else 0 end)) + len(seq))::int as read_len,
  (flag & 16) <> 0 as is_rc from o""",
)
def _(t):
    w = C.walk(F.col("pos"), F.col("cigar"), 20)
    return t.reads.select("read_id", w.alias("w"), C.read_length(F.col("cigar"), F.col("seq")).alias("read_len"), C.is_reverse(F.col("flag")).alias("is_rc")).select(
        "read_id", "w.ref_end", "w.read_span", "w.clip_left", "w.clip_right", F.size("w.indels").cast("long").alias("n_indels"), "read_len", "is_rc"
    )


@register(
    "fn20_footprints", "calls",
    f""", {TYPED} select id, case when p then pos else pos + 1 end as first, case when p then pos + 1 when kind = 1 then pos + svlen - 1 else pos + len(ref) - 1 end as last
from (select *, kind = 2 or (kind = 0 and len(ref) = 1 and len(alt) > 1) or (kind = 1 and alt like '<INS%') as p from s)""",
)
def _(t):
    size = A.svlen(F.col("pos"), F.col("ref"), F.col("alt"), F.col("info"))
    return t.calls.select("id", A.footprint(F.col("pos"), F.col("ref"), F.col("alt"), size).alias("f")).select("id", "f.*")


@register(
    "fn21_genotype_helpers", "g",
    r"""select gt, len(gt) - len(replace(gt, '1', '')) as n_alts, regexp_full_match(replace(gt, '|', '/'), '0/1|1/0') as het, regexp_full_match(replace(gt, '|', '/'), '1/1') as hom,
  len(string_split(replace(gt, '|', '/'), '/')) = 2 as diploid, contains(gt, '.') as missing, count(*) as n from g group by all""",
)
def _(t):
    gt = F.col("gt")
    cols = {"n_alts": G.n_alts(gt), "het": G.is_het(gt), "hom": G.is_hom_alt(gt), "diploid": G.is_diploid(gt), "missing": G.has_missing(gt)}
    return t.g.withColumns(cols).groupBy("gt", *cols).agg(F.count("*").alias("n"))


@register(
    "fn22_binning_rules", "v",
    """select svlen, floor(log10(svlen))::int as log_bin, floor(svlen / 150)::int as quantum, (svlen > 50)::int + (svlen > 200)::int + (svlen > 800)::int as edge,
  case svlen when 200 then 1 when 800 then 2 else 0 end as exact, (svlen >= 50)::int + (svlen >= 200)::int + (svlen >= 800)::int as lower_edge, count(*) as n from v group by all""",
)
def _(t):
    x, edges = F.col("svlen"), (50, 200, 800)
    cols = {"log_bin": B.log10_bin(x), "quantum": B.quantum_bin(x, 150), "edge": B.edge_bin(x, edges), "exact": B.exact_edge_bin(x, edges), "lower_edge": B.lower_edge_bin(x, edges)}
    return t.v.withColumns(cols).groupBy("svlen", *cols).agg(F.count("*").alias("n"))


@register(
    "fl01_class_filters", "calls",
    f""", {ANNOTATED} select svtype, case when svtype in ('DEL', 'INS', 'DUP', 'INV') and abs(svlen) >= 20 then 'sv' else 'small' end as route,
  count(*) as n, count(*) filter (where len(ref) <> len(alt) and filter in ('PASS', '.')) as truth, count(*) filter (where abs(svlen) between 10 and 100) as mid,
  count(*) filter (where regexp_full_match(chrom, 'chr([1-9]|1[0-9]|2[0-2]|X|Y|M)')) as standard from a group by 1, 2""",
)
def _(t):
    typed = R.add_type_and_length(t.calls)
    routed = FL.by_class(typed, 20)
    clean = FL.clean_truth(typed).select("id").withColumn("_t", F.lit(1))
    mid = FL.length_between(typed, 10, 100).select("id").withColumn("_m", F.lit(1))
    return routed.join(clean, "id", "left").join(mid, "id", "left").groupBy("svtype", "route").agg(
        F.count("*").alias("n"), F.count("_t").alias("truth"), F.count("_m").alias("mid"), F.count_if(FL.standard_chromosome(F.col("chrom"))).alias("standard")
    )


@register(
    "fl07_mask_cells", "g",
    r""", m as (select *, case when contains(gt, '1') and (dp < 5 or dp > 40 or ad_alt < 4) then './.' else gt end as new from g),
k as (select distinct variant_id from m where contains(new, '1'))
select variant_id, count(*) as cells, count(*) filter (where contains(new, '1')) as alt_cells from m where variant_id in (from k) group by 1""",
)
def _(t):
    return FL.mask_cells(t.g, 5, 40, 4).groupBy("variant_id").agg(F.count("*").alias("cells"), F.count_if(G.n_alts(F.col("gt")) > 0).alias("alt_cells"))


@register(
    "fl16_usable_reads", "reads",
    """select read_id from reads where len(seq) > 0 and mapq >= 20 and (flag & 1796) = 0 and pos <= 5000 + 2000 and pos + 100 >= 5000 - 2000""",
)
def _(t):
    return FL.usable_reads(t.reads.withColumns({"at": F.lit(5000), "ref_end": F.col("pos") + 100}), 20, 1796, 2000).select("read_id")


@register(
    "fl20_not_done", "v",
    """select id from v where orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""",
)
def _(t):
    done = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("orderkey"))
    return FL.not_done(t.v, done, "orderkey").select("id")


@register(
    "fl19_split_by_parity", "adj",
    """, p as (select id, case when substr(chrom1, 4)::int % 2 <> substr(chrom2, 4)::int % 2 then 1 else 2 * (substr(chrom1, 4)::int % 2) end as parity from adj),
c as (select count(*) filter (where parity = 0) as e, count(*) filter (where parity = 2) as o from p)
select id, parity, case when parity = 1 then null when (parity = 0) = (e >= o) then 'train' else 'test' end as split from p, c""",
)
def _(t):
    return FL.train_test_by_parity(t.adj.select("id", R.mate_parity(F.col("chrom1"), F.col("chrom2")).alias("parity")))
