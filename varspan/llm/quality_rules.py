"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is a Boolean column that is true where a text fails. On a bounded sample the operator measures what a rule
costs (seconds of a pass that evaluates it alone) and what it rejects, and orders the rules by rejections per
second. The cascade is one CASE expression in that order, so a row pays only for the rules up to its first failure.
The order changes the time and the name of the first rule that fails, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import SPACE, WORD, fresh, written

#: Rows of the sample that costs and selectivities are measured on, in expectation.
SAMPLE = 2000
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def symbols(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words in windows of `window` words that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes. Only a text in which a hash repeats sorts its windows; the covered words
    are then counted from the sorted starts of the repeated windows. All steps are linear or n log n in the text.
    """
    n = F.size(tokens)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(window)))
    )

    def starts(all_hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(all_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twin(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            return F.transform(
                F.filter(
                    F.transform(
                        pairs,
                        lambda p, j: F.struct(
                            p["i"].alias("i"),
                            (
                                ((j > 0) & (F.get(pairs, F.greatest(j - 1, F.lit(0)))["h"] == p["h"]))
                                | ((j < last) & (F.get(pairs, F.least(j + 1, last))["h"] == p["h"]))
                            ).alias("twin"),
                        ),
                    ),
                    lambda p: p["twin"],
                ),
                lambda p: p["i"],
            )

        return _let(ranked, twin)

    def covered(at: Column) -> Column:
        """Words under windows that start at the sorted positions: each adds what the one before doesn't cover."""
        return F.aggregate(
            F.array_sort(at),
            F.struct(F.lit(-window).alias("before"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("before"), (acc["n"] + F.least(i - acc["before"], F.lit(window))).alias("n")),
            lambda acc: acc["n"],
        )

    def count(all_hashes: Column) -> Column:
        again = F.size(F.array_distinct(all_hashes)) < F.size(all_hashes)
        return F.when(again, covered(starts(all_hashes))).otherwise(0)

    return F.when(n > window, _let(hashes, count)).otherwise(0).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rules(text: Column, tokens: Column) -> dict[str, Column]:
    """Name to condition of failure. tokens: the text's words. The first two are the base rules."""
    n = F.size(tokens)
    return {
        "few_words": n < 20,
        "repeated_words": 100 * repeated_words(tokens) > 30 * n,
        "symbols": 4 * symbols(text) > n,
        "duplicate_lines": 100 * duplicate_lines(text) > 30 * F.size(F.split(F.coalesce(text, F.lit("")), "\n")),
        "word_length": (word_chars(text) < 2 * n) | (word_chars(text) > 15 * n),
        "shouting": 100 * F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^!]", "")) > 15 * n,
    }


def measured_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Rule names by rejections per second, measured on a random sample of about `sample` rows."""
    rows = docs.count()
    share = min(1.0, sample / max(rows, 1))
    picked = docs.select("text").sample(share, seed=1) if share < 1 else docs.select("text")
    tokens = written(picked.withColumn("tokens", words(F.col("text"))), "rule-sample")
    tokens.agg(F.sum(F.size("tokens"))).collect()  # read once, so that no rule pays for the first read
    worth = {}
    for name, fails in rules(F.col("text"), F.col("tokens")).items():
        began = time.perf_counter()
        rejected = tokens.agg(F.count_if(fails)).first()[0]
        worth[name] = rejected / max(time.perf_counter() - began, 1e-6)
    return sorted(worth, key=lambda name: (-worth[name], name))


def cascade(text: Column, tokens: Column, order: list[str]) -> Column:
    """The name of the first rule in order that a text fails, else null; later rules are not evaluated."""
    found = rules(text, tokens)
    case = F.when(found[order[0]], F.lit(order[0]))
    for name in order[1:]:
        case = case.when(found[name], F.lit(name))
    return case


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """docs with first_failed: the first rule of the measured order that a row fails, null if it passes them all.

    Null text is empty and fails few_words. Repeated rows are judged alike; an empty table gets an empty result;
    a column first_failed of docs makes the new one first_failed_.
    """
    order = order or measured_order(docs)
    tokens = fresh("tokens", docs)
    out = docs.withColumn(tokens, words(F.col("text")))
    return out.withColumn(fresh("first_failed", docs), cascade(F.col("text"), F.col(tokens), order)).drop(tokens)


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    order = measured_order(docs)
    base = docs.select("doc_id", "text", words(F.col("text")).alias("tokens"))
    text, tokens = F.col("text"), F.col("tokens")
    counted = base.select(
        "doc_id",
        "text",
        "tokens",
        F.size("tokens").cast("long").alias("n_words"),
        word_chars(text).alias("word_chars"),
        symbols(text).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        repeated_words(tokens).alias("n_repeat_words"),
    )
    # the contract returns the base counts of every row, so the cascade's rules read them instead of counting again
    n = F.col("n_words")
    fails = rules(text, tokens) | {
        "few_words": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 4 * F.col("n_symbols") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.size(F.split(F.coalesce(text, F.lit("")), "\n")),
    }
    case = F.when(fails[order[0]], F.lit(order[0]))
    for name in order[1:]:
        case = case.when(fails[name], F.lit(name))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (fails["few_words"] | fails["repeated_words"]).alias("base_failed"),
        case.isNull().alias("kept"),
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), u as (
  select *, len(w) as n, case when len(w) >= 8 then
    list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) else [] end as g,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t
), e as (select doc_id, unnest(g) as s, unnest(range(1, len(g) + 1)) as i from u),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from e) where c > 1),
r as (select doc_id, count(distinct j) as rep from (select doc_id, unnest(range(i, i + 8)) as j from d) group by doc_id),
m as (
  select u.doc_id, n, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as sym,
    len(lines) - len(list_distinct(lines)) as dup, coalesce(rep, 0) as rep,
    len(string_split(text, chr(10))) as n_lines, len(text) - len(replace(text, '!', '')) as bang
  from u left join r using (doc_id)
)
select doc_id, n as n_words, chars as word_chars, sym as n_symbols, dup as n_dup_lines, rep as n_repeat_words,
  n < 20 or 100 * rep > 30 * n as base_failed,
  not (n < 20 or 100 * rep > 30 * n or 4 * sym > n or 100 * dup > 30 * n_lines or chars < 2 * n or chars > 15 * n
    or 100 * bang > 15 * n) as kept
from m
"""
