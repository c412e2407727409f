"""Domain relations derived from the star-schema tables, in SQL that both engines read alike.

v variants; calls variants with alleles and info; g genotype cells; ped pedigree; tr track; contigs; bp breakpoints;
bnd breakends; reads alignments; dep depth; base and comp two call sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHROM = "concat('chr', cast({} % 22 + 1 as string))"
ID = (
    "concat_ws('_', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), "
    "cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(cast(l_shipdate as date) as string))"
)
MATE = "concat('chr', cast(l_partkey % 22 + 1 as string), ':', cast(l_suppkey * 100 + 7 as string))"

PROXIES = {
    "v": f"""
select {ID} as id, {CHROM.format('l_suppkey')} as chrom, cast(l_partkey * 100 + l_linenumber as int) as pos,
  case l_returnflag when 'A' then 'DEL' when 'N' then 'INS' else 'DUP' end as svtype,
  cast(l_quantity as int) * 20 as svlen, cast(round(l_discount * 100) as int) as qual, l_linestatus as caller,
  cast(l_orderkey as bigint) as orderkey, cast(l_linenumber as int) as line
from {{lineitem}}""",
    "alleles": f"""
select *, case when svtype = 'DEL' then concat('a', seq) else 'A' end as ref, case svtype when 'DEL' then 'A' when 'INS' then concat('A', seq) else '<DUP>' end as alt
from (select {ID} as id, {CHROM.format('l_suppkey')} as chrom, cast(l_partkey * 100 + l_linenumber as int) as pos,
  case l_returnflag when 'A' then 'DEL' when 'N' then 'INS' else 'DUP' end as svtype, cast(l_quantity as int) * 20 as svlen,
  cast(round(l_discount * 100) as int) as qual, l_linestatus as caller,
  substring(case l_orderkey % 4 when 0 then repeat('ACGTTGCA', 9) when 1 then repeat('ACGTTGCC', 9) when 2 then repeat('GATTACAG', 9) else repeat('ACGTTACAGT', 7) end,
    cast(l_linenumber as int), cast(l_quantity as int)) as seq
from {{lineitem}})""",
    "calls": f"""
select {ID} as id, {CHROM.format('l_suppkey')} as chrom, cast(l_partkey * 100 + l_linenumber as int) as pos,
  case l_orderkey % 9 when 0 then 'A' when 1 then concat('A', repeat('GAT', cast(l_linenumber as int)))
    when 2 then repeat('AC', cast(l_linenumber + 1 as int)) when 8 then 'an' else 'N' end as ref,
  case l_orderkey % 9 when 0 then concat('A', repeat('CGT', cast(l_linenumber as int))) when 1 then 'A'
    when 2 then repeat('T', cast(l_linenumber + 1 as int)) when 3 then '<DEL>' when 4 then '<DUP:TANDEM>' when 5 then '<INV>'
    when 6 then case l_linenumber % 4 when 0 then concat('N[', {MATE}, '[') when 1 then concat('N]', {MATE}, ']')
      when 2 then concat(']', {MATE}, ']N') else concat('[', {MATE}, '[N') end
    when 7 then 'G' else 'aRyt' end as alt,
  cast(round(l_discount * 100) as double) as qual,
  case l_linenumber % 3 when 0 then 'PASS' when 1 then '.' else 'LowQual' end as filter,
  case l_orderkey % 9 when 3 then concat('SVLEN=-', cast(cast(l_quantity as int) * 20 as string), ';PRECISE')
    when 4 then concat('END=', cast(l_partkey * 100 + l_linenumber + cast(l_quantity as int) as string), ';X=1')
    when 5 then concat('PRECISE;SVLEN=', cast(cast(l_quantity as int) as string), ';END=5') when 0 then 'SVTYPE=OLD;A=1'
    else '.' end as info
from {{lineitem}}""",
    "g": """
select cast(l_partkey as string) as variant_id, cast(o_custkey as string) as sample_id,
  case when l_linenumber = 7 then './.' when l_linenumber = 6 then concat('./', cast((l_orderkey + l_partkey) % 2 as string))
    when l_linenumber = 5 then cast(l_orderkey % 2 as string)
    else concat(cast((l_orderkey + l_partkey) % 2 as string), case when l_linenumber = 4 then '|' else '/' end,
      cast(cast(floor(l_orderkey / 2.0) as bigint) % 2 as string)) end as gt,
  cast(l_linenumber * 3 as int) as ad_ref, cast(cast(l_quantity as int) % 30 as int) as ad_alt,
  cast(l_linenumber * 3 + cast(l_quantity as int) % 30 as int) as dp, cast(l_linenumber as int) as line,
  cast(l_quantity as int) * 20 as svlen
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "ped": """
select cast(c_custkey as string) as child, cast(c_custkey + 1 as string) as father, cast(c_custkey + 2 as string) as mother
from {customer} where c_custkey % 3 = 0""",
    "tr": f"""
select {CHROM.format('p_partkey')} as chrom, cast(p_partkey * 97 as int) as start, cast(p_partkey * 97 + p_size * 10 as int) as `end`,
  cast(p_partkey as bigint) as id from {{part}}""",
    "contigs": """
select concat('chr', cast(n_nationkey + 1 as string)) as chrom, cast((select max(p_partkey) from {part}) * (98 - n_nationkey) as int) as length
from {nation} where n_nationkey < 22""",
    "bp": f"""
select {CHROM.format('s_suppkey')} as chrom, cast(s_suppkey * 211 as int) as pos, {CHROM.format('s_suppkey * 7')} as other_chrom,
  case when s_suppkey % 3 = 0 then -1 else cast(s_suppkey * 101 as int) end as other_pos, cast(s_suppkey % 5 + 1 as int) as type
from {{supplier}}""",
    "bnd": f"""
select cast(o_orderkey as bigint) as id, {CHROM.format('o_custkey')} as chrom, cast(o_custkey * 211 % 30000 + o_orderkey % 50 as int) as pos,
  {CHROM.format('o_custkey * 7')} as other_chrom, cast(o_custkey * 101 % 30000 + o_orderkey % 3 as int) as other_pos from {{orders}}""",
    "adj": f"""
select cast(o_orderkey as bigint) as id, case when o_orderkey % 2 = 0 then {CHROM.format('o_custkey')} else {CHROM.format('o_custkey * 5')} end as chrom1,
  case when o_orderkey % 2 = 0 then cast(o_custkey * 10 as int) else cast(o_custkey * 30 as int) end as pos1,
  case when o_orderkey % 2 = 0 then {CHROM.format('o_custkey * 5')} else {CHROM.format('o_custkey')} end as chrom2,
  case when o_orderkey % 2 = 0 then cast(o_custkey * 30 as int) else cast(o_custkey * 10 as int) end as pos2,
  cast(o_custkey % 2 as int) as dir1, cast(o_custkey % 2 as int) as dir2, cast(o_orderkey % 7 as int) as support from {{orders}}""",
    "reads": f"""
select cast(o_orderkey as string) as read_id, cast(o_orderkey % 4096 as int) as flag, {CHROM.format('o_custkey')} as chrom,
  cast(o_custkey * 10 as int) as pos, cast(o_orderkey % 61 as int) as mapq,
  case o_orderkey % 4 when 0 then concat(cast(o_custkey % 40 + 1 as string), 'S50M10D40M', cast(o_custkey % 7 + 1 as string), 'H')
    when 1 then concat('3H20M', cast(o_custkey % 60 + 1 as string), 'I30M') when 2 then '100M'
    else concat('10=5X', cast(o_custkey % 90 + 1 as string), 'D5N10M4S') end as cigar,
  case when o_orderkey % 11 = 0 then '' else repeat('ACGTT', 4) end as seq from {{orders}}""",
    "dep": """
select cast(l_suppkey % 10 as int) as `window`, cast(l_partkey % 300 as int) as pos,
  cast(count(*) * (1 + 3 * max(case when l_partkey % 300 between 100 and 199 then 1 else 0 end)) as int) as depth
from {lineitem} group by l_suppkey % 10, l_partkey % 300""",
    "seqs": """
select doc_id, regexp_replace(lower(coalesce(text, '')), '[^acgt]', ''__G__) as seq from {documents}""",
    "labelled": """
select user_id, event_id, event_type, ts from {events}""",
}
SOURCES = "lineitem orders customer part supplier nation events documents".split()


def spark_proxy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = PROXIES[name].replace("__G__", "")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


class Tables:
    """The proxies of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PROXIES:
            raise AttributeError(name)
        return spark_proxy(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def duck(name: str) -> str:
    sql = PROXIES[name].replace("__G__", ", 'g'").replace("`", '"')
    for t in SOURCES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"{name} as ({sql})"


def register(name: str, uses: str, sql: str | None = None):
    """Registers a query over Tables and, if SQL can say the same, its oracle over the proxies it uses."""

    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = "with recursive " + ", ".join(map(duck, uses.split())) + "\n" + sql if uses else sql
        return build

    return add

