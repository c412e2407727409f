"""The thin registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from varspan.llm import (
    exact_dedup,
    fim,
    hard_negatives,
    html_text,
    langid,
    minhash,
    mixing,
    packing,
    pii,
    quality_model,
    quality_rules,
    simhash,
    toxicity,
)
from varspan.llm.common import read_table

TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark, sf_dir):
    return mixing.op1_mixing(read_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return quality_model.op2_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html(spark, sf_dir):
    return html_text.op3_html(read_table(spark, sf_dir, "pages"))


def op4_langid(spark, sf_dir):
    return langid.op4_langid(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.op5_quality_rules(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.op6_simhash(read_table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.op7_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_toxicity(spark, sf_dir):
    return toxicity.op8_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_pii(spark, sf_dir):
    return pii.op9_pii(read_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.op10_exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_fim(spark, sf_dir):
    return fim.op11_fim(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.op12_hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op13_minhash(spark, sf_dir):
    return minhash.op13_minhash(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_quality,
        op3_html,
        op4_langid,
        op5_quality_rules,
        op6_simhash,
        op7_packing,
        op8_toxicity,
        op9_pii,
        op10_exact_dedup,
        op11_fim,
        op12_hard_negatives,
        op13_minhash,
    )
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_fim": fim.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
