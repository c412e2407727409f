"""Groups of near copies against brute force, with and without large buckets, clusters and blocks."""

import random
import re
from collections import Counter
from itertools import combinations

import pandas as pd
import pytest
import xxhash

from varspan.llm import simhash as S


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}


def word_fingerprint(text):
    votes = {xxhash.xxh64(w.encode(), seed=42).intdigest(): n**S.WORD_POWER for w, n in Counter(words(text)).items()}
    return sum(1 << b for b in range(64) if 2 * sum(x for h, x in votes.items() if h >> b & 1) > sum(votes.values())) if votes else 0


def groups_brute(texts, distance=S.DISTANCE, similarity=0.8):
    """Smallest identifier to the set of identifiers, of all texts (identifier to text)."""
    sets, fps = {i: shingles(t) for i, t in texts.items()}, {i: word_fingerprint(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        shared = len(sets[a] & sets[b])
        if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) and (fps[a] ^ fps[b]).bit_count() <= distance:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i in texts:
        out.setdefault(find(i), set()).add(i)
    return out


def found(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "node long, text string")
    rows = S.similar_groups(df, **options).collect()
    out = {}
    for r in rows:
        out.setdefault(r.root, set()).add(r.node)
    return {k: v for k, v in out.items()}


def corpus(seed, n_groups, copies, length=60, edits=3):
    """Texts of random words, and edited copies of each: copies of the first text by the hundred, near and less near."""
    rng, vocabulary, texts = random.Random(seed), [f"w{i}" for i in range(400)], []
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies * 6 if g == 0 else rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return dict(enumerate(texts + ["", " ", None, "one two", "ONE two", "two one"]))


@pytest.mark.parametrize("bucket, block", [(48, 1024), (4, 1024), (2, 16)])
def test_groups_against_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    texts = corpus(bucket, 25, 8)
    expected = {k: v for k, v in groups_brute(texts).items() if len(v) > 1}
    assert len(expected) > 8 and found(spark, texts, bucket=bucket) == expected


def test_recall_against_all_similar_pairs(spark):
    """Distance is a filter before the similarity: hardly any similar pair differs in more bits."""
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    texts = dict(zip(docs.doc_id, docs.text))
    wide = groups_brute(texts, distance=64)
    got = found(spark, texts)
    lost = sum(len(v) - 1 for v in wide.values()) - sum(len(v) - 1 for v in got.values())
    assert lost <= 1 and all(any(v <= w for w in wide.values()) for v in got.values())


def test_rows_that_stay(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(9, text, "z"), (3, f"{text} more", "y"), (None, f"more {text}", "x"), (3, f"{text} more", "y"), (5, "quite another text of a few words", "w"), (None, None, "v"), (None, "", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node_of_row string")
    got = sorted(map(tuple, S.drop_near_duplicates(df).collect()), key=str)
    assert len(got) == 3 and (3, f"{text} more", "y") in got and (5, "quite another text of a few words", "w") in got
    assert S.drop_near_duplicates(df.limit(0)).count() == 0 and S.drop_near_duplicates(df).columns == df.columns


def test_wider_distance_and_other_similarity(spark):
    texts = corpus(7, 12, 5, edits=8)
    for distance, similarity in ((3, 0.9), (9, 0.6)):
        expected = {k: v for k, v in groups_brute(texts, distance, similarity).items() if len(v) > 1}
        assert found(spark, texts, distance=distance, similarity=similarity, bucket=6) == expected
