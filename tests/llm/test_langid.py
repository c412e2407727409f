"""Language identification against a plain version of its vectors, letters, rejection."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from varspan.llm import langid as L
from varspan.llm import queries as Q

MASK = (1 << 64) - 1


def plain_grams(text):
    """Counts by slot, one n-gram at a time, or None."""
    clean = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not clean:
        return None
    code, out = [ord(c) for c in f" {clean} "], Counter()
    for i in range(len(code) - 1):
        two = (code[i] * 0x9E3779B1 + code[i + 1] * 0x85EBCA77) & MASK
        out[(two & 0xFFFFFFFF) >> 19] += 1
        if i + 2 < len(code):
            three = (two * 0xC2B2AE3D + code[i + 2] * 0x27D4EB2F) & MASK
            out[(three & 0xFFFFFFFF) >> 19] += 1
    return out


def test_predictions_against_plain_cosines(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(L._training(df))
    got = L.predict(df, model).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        grams = plain_grams(text)
        vector = {s: math.log1p(n) * float(model["idf"][s]) for s, n in grams.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[s]) for s, v in vector.items()) / norm for c in model["centres"]]
        best = int(np.argmax(cosines))
        assert got.score[i] == pytest.approx(cosines[best], abs=1e-4) and got.lang_pred[i] == model["langs"][best]
        limit = model["floors"][best][int(math.log2(sum(grams.values())))]
        assert got.rejected[i] == (cosines[best] < limit) or abs(cosines[best] - limit) < 1e-4


@pytest.mark.parametrize("block", [1 << 18, 7, 2])
def test_grams_in_blocks(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abç ß1½_.") for _ in range(rng.randint(0, 60)))
        got, expected = L._grams(text, L._not_letters()), plain_grams(text)
        assert (got is None) == (expected is None)
        assert got is None or {int(s): int(got[s]) for s in np.flatnonzero(got)} == expected


def test_texts_without_a_letter(spark):
    texts = ["½ ²", "Ⅷ", "①", "١٢٣", "_", "12 !", "", None, "é", "字", "ª"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, "some english words here", "en") for i in range(8)]
    got = {r.doc_id: r for r in L.op4_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in range(11)] == ["und"] * 8 + ["en"] * 3
    assert all(got[i].rejected and got[i].score == 0 for i in range(8))


def test_junk_is_rejected_and_prose_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    got = Q.op4_langid(spark, sf).toPandas().merge(docs, on="doc_id").merge(labels, on="doc_id", how="left")
    assert not got.rejected[got.quality == 1].any()
    words = got.text.str.split()
    again = words.map(lambda w: len(w) >= 60 and sum(a == b for a, b in zip(w, w[1:])) > 0.8 * len(w))
    assert again.sum() >= 5 and got.rejected[again].mean() > 0.7  # 0.83 here, 0.96 on ten times the rows


def test_without_labels_and_with_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, score string, rejected string, held_out int"
    rows = [(1, "a text", None, "s", "r", 1), (1, "a text", None, "s", "r", 1), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    assert [r.lang_pred for r in L.op4_langid(docs).collect()] == ["und"] * 3
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    assert L.op4_langid(docs.limit(0)).count() == 0 and L.keep_identified(docs.limit(0)).count() == 0
