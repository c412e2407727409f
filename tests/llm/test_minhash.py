"""MinHash near-dedup against all pairs, with hot buckets and small blocks; the sequential test's chances; edge cases."""

import random
from itertools import combinations
from math import comb

import pytest

from varspan.llm import minhash as M

SCHEMA = "doc_id long, text string, n int, id int, digest string, component int, key int, bands string, sig int"


def shingles(text, k=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain_version(rows, k=2, least=80):
    """All pairs. rows: doc_id, text."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return sorted(((rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows))), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, "d", 3, 4, "b", 5) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, M.near_duplicates(df, **options).collect()), key=repr)


def corpus(seed, groups, copies, length=40, edits=6, vocabulary=60):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
        for _ in range(rng.randrange(1, copies)):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed, block_rows", [(1, M.BLOCK_ROWS), (2, 4)])
def test_against_all_pairs(spark, seed, block_rows):
    rows = corpus(seed, 12, 12)
    assert found(spark, rows, block_rows=block_rows) == plain_version(rows)


def test_large_group_of_near_copies(spark):
    """One text edited 150 times, so that copies are linked through each other and some not at all."""
    rows = corpus(3, 1, 2) + [(1000 + i, t) for i, (_, t) in enumerate(corpus(4, 1, 600, edits=9))][:150]
    expected = plain_version(rows)
    assert len({r[2] for r in expected}) > 3
    assert found(spark, rows, block_rows=16) == expected


def test_five_words(spark):
    rows = corpus(5, 8, 8, edits=3)
    assert found(spark, rows, k=5) == plain_version(rows, 5)


def test_edge_cases(spark):
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  TWO"), (8, "É one"), (9, "é one"), (10, long), (11, long), (11, long)]
    rows += [(None, "null id alone"), (None, long), (12, "spam spam"), (13, "spam spam spam spam"), (14, "a\x00b a\x00b"), (15, "😀 ß ﬁ"), (3, "one two")]
    assert found(spark, rows) == plain_version(rows)
    assert found(spark, []) == []


def test_query_columns(spark):
    docs = spark.createDataFrame([(2, "a b c"), (1, "a b c"), (None, "x y"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in M.op13_minhash(docs).collect()}
    assert got == {2: (2, 1, False), 1: (2, 1, True), None: (1, None, True), 5: (0, 5, True)}
    assert sorted(r[0] for r in M.drop_near_duplicates(docs.where("doc_id is not null"), 2).collect()) == [1, 5]


def test_chances():
    """The chance that the sequential test drops a pair of similarity 0.8 is below one in a hundred thousand (each batch counted), pairs of
    similarity 0.3 nearly always go, and so do bands that share nothing."""
    limits = M.allowed(M.BANDS, M.ROWS, 0.8, M.MISS)
    assert limits == sorted(limits) and len(limits) == M.ROWS
    tail = lambda n, most, p: sum(comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(most + 1, n + 1))
    sizes = range(M.BANDS, M.BANDS * M.ROWS + 1, M.BANDS)
    assert sum(tail(n, d, 0.1) for n, d in zip(sizes, limits)) < 1e-5
    assert tail(sizes[-1], limits[-1], 0.35) > 0.999
    assert (1 - 0.8**M.ROWS) ** M.BANDS < 1e-6


def test_known_posterior():
    """Against the incomplete beta function, by a plain sum."""
    limit = M.allowed(48, 1, 0.8, 1e-3)[0]

    def chance(d, steps=100_000):
        agree = [0.5 + 0.5 * (i + 0.5) / steps for i in range(steps)]
        weights = [p ** (48 - d) * (1 - p) ** d for p in agree]
        return sum(w for p, w in zip(agree, weights) if p >= 0.9) / sum(weights)

    assert chance(limit) >= 1e-3 > chance(limit + 1)


def test_two_steps_of_verification(spark, monkeypatch):
    """Pairs that the leader's links don't connect are found across components."""
    seen = []
    real = M._across
    monkeypatch.setattr(M, "_across", lambda *a: seen.append(real(*a)) or seen[-1])
    rows = [(i, t) for i, (_, t) in enumerate(corpus(9, 3, 40, edits=8))]
    assert found(spark, rows) == plain_version(rows)
    assert seen and all(set(r.columns) == {"a", "b"} for r in seen)
