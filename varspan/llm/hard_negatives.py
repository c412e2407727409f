"""Hard-negative mining by norm-bucketed exact search.

Two searches over the same rows: first each anchor's best rows of its own label (its positives), then, for each positive, the
best rows of other labels inside a window of scores below it. A search is a grid: blocks of anchors meet shards of
candidates, both of bounded size and dealt by hash, so no label or block of rows is too large for a task. In a shard the
candidates are sorted by norm and cut into buckets. From the longest bucket on, an anchor meets a bucket only where the
Cauchy-Schwarz bound, its norm times the bucket's longest, reaches the window's lower limit and the anchor's running
k-th score; norms fall, so an anchor that has left meets no later bucket. What is pruned can't be in the result: the search is exact.
Scores are integers, computed exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from varspan.llm.common import written

#: Anchors of a block, candidates of a shard, and candidates of a norm bucket.
BLOCK, SHARD, BUCKET = 1024, 16384, 512
#: Slack of bounds made from rounded norms.
SLACK = 1 + 1e-9
LONG = (1 << 63) - 1


def _searcher(k: int, same: bool):
    """For a block of anchors and a shard of candidates: each anchor's k best for each of its windows."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        def matrix(table, dim):
            lists = table.column("q").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), dim), np.int64)
            out[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy()
            return out

        def numbers(table, name, missing=0):
            return table.column(name).combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)

        empty = pa.table({c: pa.array([], pa.int64()) for c in ("a_row", "slot", "c_row", "c_id", "score")})
        if not left.num_rows or not right.num_rows:
            return empty
        right = right.take(np.argsort(-numbers(right, "norm"), kind="stable"))  # sorted by norm, longest first
        norms, labels, rows = numbers(right, "norm"), numbers(right, "label"), numbers(right, "row")
        no_id, ids = right.column("vec_id").combine_chunks().is_null().to_numpy(zero_copy_only=False), numbers(right, "vec_id")
        place = np.empty(len(rows), np.int64)
        place[np.lexsort((rows, ids, no_id))] = np.arange(len(rows))  # order of ties: vec_id, null last, then the row
        by_place = np.argsort(place)

        dim = max(int(max(len(x) for x in t.column("q"))) for t in (left, right))
        a, c = matrix(left, dim), matrix(right, dim)
        most = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
        n = len(rows)
        if most * n < 1 << 52:
            a, c, kind, low = a.astype(np.float64), c.astype(np.float64), np.int64, -(1 << 62)  # sums below 2^53: exact
        else:
            a, c, kind, low = a.astype(object), c.astype(object), object, -(1 << 200)
        windows = [[(w["lo"], w["hi"]) for w in x] for x in left.column("windows").to_pylist()]
        slots = max(map(len, windows))
        lo, hi = (np.array([[w[s] for w in x] + [1 - 2 * s] * (slots - len(x)) for x in windows], kind) for s in (0, 1))
        a_norms, a_labels, a_ids, a_rows = (numbers(left, x) for x in ("norm", "label", "vec_id", "row"))

        best = np.full((len(a), slots, k), low, kind)  # keys: score and place in one number, rising
        for start in range(0, n, BUCKET):
            end = min(start + BUCKET, n)
            kth = np.where(best[:, :, 0] > low, best[:, :, 0] // n, lo)
            limit = np.maximum(kth, lo).astype(np.float64)
            bound = a_norms[:, None] * norms[start] * SLACK
            active = np.flatnonzero(((bound >= limit) & (lo <= hi)).any(axis=1))
            if not len(active):
                break
            score = (a[active] @ c[start:end].T).astype(kind)
            alike = a_labels[active][:, None] == labels[None, start:end]
            allowed = alike & (no_id[None, start:end] | (a_ids[active][:, None] != ids[None, start:end])) if same else ~alike
            key = score * n + (n - 1 - place[start:end])
            for slot in range(slots):
                fits = allowed & (score >= lo[active, slot, None]) & (score <= hi[active, slot, None])
                fits = np.flatnonzero(fits.any(axis=1)), fits
                if len(fits[0]):
                    at = active[fits[0]]
                    both = np.concatenate([best[at, slot], np.where(fits[1][fits[0]], key[fits[0]], low)], axis=1)
                    best[at, slot] = np.sort(both, axis=1)[:, -k:] if kind is object else np.sort(np.partition(both, -k, axis=1)[:, -k:], axis=1)
        at, slot, rank = np.nonzero(best > low)
        if not len(at):
            return empty
        found = best[at, slot, rank]
        chosen = by_place[(n - 1 - found % n).astype(np.int64)]
        scores = [max(-LONG - 1, min(LONG, int(x))) for x in found // n]
        return pa.table(
            {
                "a_row": pa.array(a_rows[at]),
                "slot": pa.array(slot.astype(np.int64)),
                "c_row": pa.array(rows[chosen]),
                "c_id": pa.array(ids[chosen], mask=no_id[chosen]),
                "score": pa.array(scores, pa.int64()),
            }
        )

    return run


def _search(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """a_row, slot, c_row, c_id, score: the k best of all rows for each window of each anchor.

    anchors: row, vec_id, label, q, norm, windows. same: rows of the anchor's label, else of other labels. The grid is laid
    for each label by itself, or over all labels at once.
    """
    key = F.col("label") if same else F.lit(0)
    left, right = anchors.withColumn("part", key), rows.withColumn("part", key)
    blocks = left.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shards = right.groupBy("part").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    if same:
        sizes = written(blocks.join(shards, "part"), "mining-sizes")
        left, right = left.join(sizes, "part"), right.join(sizes, "part")
    else:  # one part, so two numbers
        n_blocks, n_shards = (x.first() for x in (blocks, shards))
        each = {"blocks": F.lit(n_blocks[1] if n_blocks else 0), "shards": F.lit(n_shards[1] if n_shards else 0)}
        left, right = left.withColumns(each), right.withColumns(each)
    dealt = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    left = left.withColumns({"block": (dealt % F.col("blocks")).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1))})
    right = right.withColumns({"shard": (dealt % F.col("shards")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    grid = ["part", "block", "shard"]
    # new names of the same columns, as both sides come from one table
    left = left.select(*[F.col(c).alias(c) for c in (*grid, "row", "vec_id", "label", "q", "norm", "windows")]).groupBy(*grid)
    right = right.select(*grid, "row", "vec_id", "label", "q", "norm").groupBy(*grid)
    found = left.cogroup(right).applyInArrow(_searcher(k, same), "a_row long, slot long, c_row long, c_id long, score long")
    order = Window.partitionBy("a_row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("c_id"), "c_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, label, q (floor of scale times each component), norm of the rows that take part: label and vector are
    there, all components are finite. Components beyond the range of long are held at its ends."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))))
    kept = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))
    length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return kept.withColumn("norm", length)


def mine(vectors: DataFrame, anchor: Column, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding (others are ignored). Each row where `anchor` holds (a condition on vec_id) gets its first `positives` other
    rows of its label, and for each of these the first `negatives` rows of other labels whose score lies between `least` and
    `most` hundredths of the positive's. Higher scores come first, ties by smaller vec_id (null last, then the row).

    Rows with a null label or vector, or a null or non-finite component, take no part; of vectors of different lengths the
    shorter one counts as ending in zeros; an empty one scores zero. Repeated rows are rows of their own, but rows of the
    anchor's own vec_id are not its positives. A row without vec_id is no anchor. Scores beyond the range of long are held at its ends.
    An anchor without positives or negatives gives no row; an empty table gives none.
    """
    rows = written(quantised(vectors), "mining-rows")
    anchors = rows.where(anchor)
    everything = F.array(F.struct(F.lit(-LONG).alias("lo"), F.lit(LONG).alias("hi")))
    near = written(_search(anchors.withColumn("windows", everything), rows, positives, True), "mining-positives")
    score = F.col("score").cast("decimal(38,0)")
    lo, hi = F.ceil(score * least / 100).cast("long"), F.floor(score * most / 100).cast("long")
    wanted = near.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    slot = F.struct("rank", "lo", "hi", F.col("c_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = wanted.groupBy(F.col("a_row").alias("row")).agg(F.sort_array(F.collect_list(slot)).alias("windows"))
    wanted = written(anchors.join(wanted, "row"), "mining-anchors")
    # no window can be reached by rows shorter than this
    need = wanted.select("norm", F.explode("windows").alias("w")).agg(F.min(F.col("w.lo") / F.col("norm"))).first()[0]
    long_enough = rows if need is None else rows.where(F.col("norm") * SLACK >= need)
    hard = _search(wanted, long_enough, negatives, False)
    named = wanted.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"), "windows")
    positive = F.get("windows", F.col("slot").cast("int"))
    return hard.join(named, "a_row").select(
        "anchor_id",
        positive["positive_id"].alias("positive_id"),
        "rank",
        F.col("c_id").alias("negative_id"),
        positive["positive_score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(vectors: DataFrame) -> DataFrame:
    """mine with every 50th row as anchor, 5 positives and 3 negatives between 50 and 95 hundredths; where vec_id is divisible by 7
    the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0, 5, 3, 50, 95)


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select a.vec_id as anchor_id, c.vec_id as positive_id, list_dot_product(a.q, c.q)::bigint as positive_score
  from v a join v c on a.label = c.label and a.vec_id <> c.vec_id
  where a.vec_id % 50 = 0
  qualify row_number() over (partition by a.vec_id order by positive_score desc, c.vec_id) <= 5
), n as (
  select a.vec_id as anchor_id, c.vec_id as negative_id, list_dot_product(a.q, c.q)::bigint as negative_score
  from v a join v c on a.label <> c.label
  where a.vec_id % 50 = 0
)
select p.anchor_id, p.positive_id,
  row_number() over (partition by p.anchor_id, p.positive_id order by n.negative_score desc, n.negative_id)::int as rank,
  n.negative_id, p.positive_score, n.negative_score
from p join n on p.anchor_id = n.anchor_id and 50 * p.positive_score <= 100 * n.negative_score
  and 100 * n.negative_score <= 95 * p.positive_score
qualify rank <= 3
"""
