"""Hard negatives against a plain search, with several blocks, shards and buckets, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from varspan.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, q int, row int, score string, windows int, part int, rank int"


def plain_version(rows, every=50, positives=5, negatives=3, least=50, most=95):
    """rows: vec_id, embedding, label. All pairs, in Python numbers."""
    kept = []
    for row, (i, x, label) in enumerate(rows):
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            kept.append((i, [math.floor(256 * v) for v in x], label, row))
    out = []
    for i, x, label, _ in kept:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, row, j, other) for j, y, other, row in kept), key=lambda r: r[:4])
        for p in [r for r in scored if r[5] == label and r[4] != i][:positives]:
            fits = [r for r in scored if r[5] != label and least * -p[0] <= 100 * -r[0] <= most * -p[0]]
            out += [(i, p[4], k + 1, r[4], -p[0], -r[0]) for k, r in enumerate(fits[:negatives])]
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5) for r in rows], SCHEMA).coalesce(1)
    return sorted(map(tuple, H.op12_hard_negatives(df).collect()), key=repr)


def vectors(seed, n, dim=6, labels=4, scale=1.0, grid=None):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * scale * rng.uniform(0.2, 2, (n, 1))
    x = np.round(x * grid) / grid if grid else x
    return [(int(i), [float(np.float32(v)) for v in x[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block, shard, bucket", [(1024, 16384, 512), (4, 64, 8)])
@pytest.mark.parametrize("options", [dict(), dict(grid=2), dict(labels=40), dict(labels=2, scale=30)])
def test_against_all_pairs(spark, monkeypatch, block, shard, bucket, options):
    monkeypatch.setattr(H, "BLOCK", block), monkeypatch.setattr(H, "SHARD", shard), monkeypatch.setattr(H, "BUCKET", bucket)
    rows = vectors(1, 400, **options)
    expected = plain_version(rows)
    assert expected and found(spark, rows) == expected


def test_hot_label_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 32), monkeypatch.setattr(H, "BUCKET", 8)
    rows = [(i, [1.0, 0.5 * (i % 3)], 1 if i % 3 else i % 5) for i in range(300)]
    assert found(spark, rows) == plain_version(rows)


def test_rows_that_take_no_part(spark):
    rows = vectors(2, 120)
    nan, inf = float("nan"), float("inf")
    rows += [(150, [nan] * 6, 1), (200, [inf] + [0.0] * 5, 1), (250, None, 1), (300, [None] + [1.0] * 5, 1), (350, [1.0] * 6, None)]
    rows += [(None, [0.5] * 6, 2), (None, [0.9] * 6, 1), (121, [0.7] * 6, 2), (121, [0.7] * 6, 2), (122, [0.7] * 6, 3)]
    assert found(spark, rows) == plain_version(rows)


def test_lengths_and_large_numbers(spark):
    rows = [(50, [2.0, 1.0, 1.0], 1), (1, [2.0], 1), (2, [], 1), (3, [1.5, 0.0], 2), (4, [1.0, 1.0, 1.0, 9.0], 2), (5, [1.2], 3)]
    assert found(spark, rows) == plain_version(rows)
    large = [(50, [3e5, 1.0], 1), (1, [2e6, 1.0], 1), (2, [1.2e6, 0.5], 2), (3, [1.7e6, 0.0], 2)]
    assert plain_version(large)[0][4] > 1 << 53 and found(spark, large) == plain_version(large)


def test_negative_scores_have_no_window(spark):
    assert found(spark, [(50, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2), (3, [0.0], 2)]) == []


def test_empty_and_anchorless(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_pruned_buckets_are_not_scored(spark):
    """A bucket whose longest vector can't reach the window's lower limit is not multiplied."""
    import numpy as np
    import pyarrow as pa

    q = lambda n, x: pa.array([[x, 0]] * n, pa.list_(pa.int64()))
    left = pa.table({"row": [0], "vec_id": [50], "label": [1], "q": q(1, 100), "norm": [100.0], "windows": [[{"lo": 5000, "hi": 9000}]]})
    n = H.BUCKET
    lists = pa.concat_arrays([q(n, 80), q(n, 10)])
    right = pa.table({"row": range(2 * n), "vec_id": range(2 * n), "label": [2] * 2 * n, "q": lists, "norm": np.repeat([80.0, 10.0], n)})
    got = H._searcher(3, False)(left, right)
    assert got.column("c_id").to_pylist() == [2, 1, 0] and set(got.column("score").to_pylist()) == {8000}
    bad = right.set_column(4, "norm", pa.array(np.repeat([40.0, 10.0], n)))  # norms that hide what would fit: nothing is scored
    assert H._searcher(3, False)(left, bad).num_rows == 0


def test_general_interface(spark):
    df = spark.createDataFrame(vectors(3, 100), "vec_id long, embedding array<double>, label int")
    got = H.mine(df, F.col("vec_id") < 3, 2, 1, 10, 90)
    assert {r["anchor_id"] for r in got.collect()} <= {0, 1, 2} and got.agg(F.max("rank")).first()[0] == 1
