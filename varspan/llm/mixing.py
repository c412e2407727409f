"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a target weight; its mean repetition rate is what brings its characters to that share of the budget.
A document's number of copies is a Poisson quantile at a uniform number hashed from seed and identifier, so a run
again gives the same mix. Copies are exploded and shuffled globally by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import fresh, unit_hash, written

#: Largest mean that one quantile is taken of; a larger rate is the sum of several independent parts.
PART = 8.0
#: Sources whose rates are broadcast to the documents' tasks; more are joined by a shuffle, which adaptive execution
#: splits where one source holds much of the table.
BROADCAST_SOURCES = 100_000
#: A Poisson of mean PART or less exceeds this with a probability below 1e-17, under the 52 bits of a hash.
MOST = 48


def _quantile(u: Column, rate: Column) -> Column:
    """The Poisson quantile of u at mean rate: how many values of the distribution function are u or less."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(
            p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + (acc["cdf"] <= u).cast("int")).alias("n")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda acc: acc["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """source, rate: weights (default: equal for all sources) of budget times the characters of docs, over a source's own.

    Sources that weights doesn't name get rate 0; so do sources without a character. A null source is a source.
    """
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        totals = size.where("chars > 0").agg(F.sum("chars").alias("total"), F.count("*").alias("n")).first()
        weight, total = F.lit(1.0 / max(totals["n"], 1)), totals["total"] or 0.0
    else:
        total = size.agg(F.sum("chars")).first()[0] or 0.0
        share = sum(weights.values())
        pairs = [F.lit(x) for k, w in weights.items() for x in (k, w / share)]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    rate = F.when(F.col("chars") > 0, weight * F.lit(total * budget) / F.col("chars")).otherwise(0.0)
    return size.select("source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 1) -> DataFrame:
    """The columns of docs and copy_no (0, 1, ...), a row per copy, in a global random order within and over partitions.

    Rates are means, so shares are met in expectation. Null identifiers hash as empty text; repeated rows and
    rows of one identifier get equal counts; texts and other columns pass unchanged; an empty table stays empty.
    """
    source, rate, key, copies = (fresh(x, docs) for x in ("mix_source", "mix_rate", "mix_key", "mix_copies"))
    found = written(rates(docs, weights, budget).select(F.col("source").alias(source), F.col("rate").alias(rate)), "rates")
    if found.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    parts = F.greatest(F.ceil(F.col(rate) / PART), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda n, k: n + _quantile(unit_hash(F.lit(seed), k, F.col("doc_id")), F.col(rate) / parts),
    )
    copy_no = fresh("copy_no", docs)
    out = (
        docs.join(found, docs["source"].eqNullSafe(found[source]))
        .withColumn(copies, F.when(F.col(rate) > 0, drawn).otherwise(0))
        .where(F.col(copies) > 0)
        .withColumn(copy_no, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        .withColumn(key, F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(copy_no)))
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, key).sortWithinPartitions(key).select(*docs.columns, copy_no)


def op1_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs)


#: DuckDB has no fold with several values; the distribution function's terms come from prefix sums of logarithms,
#: which differ from the running product by rounding alone.
ORACLE = """
with size as (select source, sum(length(coalesce(text, '')))::double as chars from documents group by source),
total as (select sum(chars) as total, count(*) as n from size where chars > 0),
rates as (select source, case when chars > 0 then (1.0 / n) * total / chars else 0.0 end as rate from size, total),
drawn as (
  select d.*, list_sum(list_transform(range(1, greatest(ceil(rate / 8.0), 1)::bigint + 1), lambda j:
    len(list_filter(range(0, 48), lambda k:
      list_sum(list_transform(range(0, k + 1), lambda i:
        exp(i * ln(rate / greatest(ceil(rate / 8.0), 1)) - rate / greatest(ceil(rate / 8.0), 1) - lgamma(i + 1))))
      <= ('0x' || substr(md5('1|' || j || '|' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0
    ))))::bigint as copies
  from documents d join rates r on d.source is not distinct from r.source where rate > 0
)
select doc_id, text, lang, source, n_chars, unnest(range(0, copies))::int as copy_no from drawn where copies > 0
"""
