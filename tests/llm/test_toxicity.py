"""The toxicity grammar: worked sentences, and its transducers against a plain reading of each clause."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from varspan.llm import queries as Q
from varspan.llm import toxicity as T

SCORE = T.scorer({})


@pytest.mark.parametrize(
    "text, column",
    [
        ("I will kill you.", 2),
        ("we are going to hurt them all", 2),
        ("you will be killed", 2),
        ("ich werde dich töten", 2),
        ("je vais te tuer", 2),
        ("voy a matarte a ti, tu", 2),
        ("you are an idiot", 0),
        ("du bist ein Trottel", 0),
        ("what a moron", 0),
        ("you are not an idiot", 1),
        ("I will not kill you", 1),
        ("'idiot', he said", 1),
        ("he said: you wrote idiot", 1),
    ],
)
def test_sentences(text, column):
    got = SCORE(text)[:3]
    assert got[column] > 0 and all(x == 0 for i, x in enumerate(got) if i != column), got


@pytest.mark.parametrize("text", ["they killed time", "kill the process", "the word is out", "you are here", "", None, "!!! ...", "42"])
def test_no_match(text):
    assert SCORE(text) == [0.0] * T.FEATURES


def test_order_of_factors():
    one = [SCORE(t)[0] for t in ("idiot", "idiot, you", "you are an idiot")]
    assert one == sorted(one) and len(set(one)) == 3
    assert SCORE("you are an idiot. not here")[1] == 0  # a break ends the clause


def plain(words):
    """Features of class words, clause by clause, by looking at the words around each match."""
    sums, best, n = [0.0, 0.0, 0.0], 0.0, 0
    clauses, now = [], []
    for w in words:
        if w == ".":
            clauses.append(now)
            now = []
        else:
            now.append(w)
    kinds = {"idiot": T.INSULT, "kill": T.THREAT, "you": T.TARGET, "are": T.COPULA, "will": T.INTENT, "not": T.NEGATION, "said": T.REPORT}
    for clause in [*clauses, now]:
        c = [kinds.get(w, T.OTHER) for w in clause]
        total = 0.0
        for i, x in enumerate(c):
            before = {k: k in c[max(0, i - r) : i] for k, r in T.BEFORE.items()}
            after = {k: k in c[i + 1 : i + 1 + r] for k, r in T.AFTER.items()}
            discount = before[T.NEGATION] or after[T.NEGATION], before[T.REPORT] or after[T.REPORT]
            scale = (0.3 if discount[0] else 1) * (0.5 if discount[1] else 1) * T.SEED_WEIGHT
            if x == T.INSULT:
                f = 1.5 if before[T.TARGET] and before[T.COPULA] else 1.25 if before[T.TARGET] or after[T.TARGET] else 1
            elif x == T.THREAT and after[T.TARGET]:
                f = 1.0 if before[T.INTENT] else 0.6
            elif x == T.THREAT and before[T.TARGET] and before[T.INTENT]:
                f = 1.0
            else:
                continue
            sums[1 if any(discount) else 0 if x == T.INSULT else 2] += f * scale
            total += f * scale
            n += 1
        best = max(best, total)
    return [math.log1p(x) for x in (*sums, best, 100 * n / max(len(words), 1))]


def test_transducers_against_plain_reading():
    rng = random.Random(4)
    words = ["idiot", "kill", "you", "are", "will", "not", "said", "x", "y", "z", "."]
    for _ in range(2000):
        text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        assert SCORE(" ".join(text)) == pytest.approx(plain(text)), text


def test_long_text_is_linear():
    SCORE("idiot " * 200_000)
    assert SCORE("x " * 200_000) == [0.0] * T.FEATURES


def test_held_out(spark):
    """Texts of good quality alone: labels mark some junk texts that hold no marked word."""
    sf = "/root/testdata/sf0.01"
    got = Q.op8_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out & (got.quality == 1)]
    yes, no = held.score[held.toxic == 1].values, held.score[held.toxic == 0].values
    assert len(yes) and (yes[:, None] > no[None, :]).mean() > 0.95
    assert np.mean(held.predicted == held.toxic) > 0.97


def test_clashing_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "you are an idiot", 9.0, True, 5), (1, "you are an idiot", 9.0, True, 5), (None, None, 0.0, False, 1)], "doc_id long, text string, score double, held_out boolean, predicted int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.op8_toxicity(docs, labels).collect()
    assert len(rows) == 3 and len({r.score for r in rows if r.doc_id == 1}) == 1 and rows[0].score != 9.0
