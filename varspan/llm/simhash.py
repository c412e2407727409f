"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: 64 bits, each set where over half of the hashes (XXH64, seed 42) of a text's shingles set it.

Candidates: bits that vary together over the table are grouped into m partitions; thresholds t_1..t_m with
sum t_i = k - m + 1 suffice, for two fingerprints that differ in k bits at most must differ in t_i at most in some
partition i (-1: the partition is left out). For each m, dynamic programming chooses the thresholds from estimated
candidate counts, and the cheapest m is used: fewer, wider partitions with thresholds above zero as tables grow. A
threshold t becomes the masks that leave t bits of its partition out; fingerprints equal under a mask share a bucket.

Probe and verify. `near_duplicates` links fingerprints by distance alone (two bits): buckets of at most BUCKET emit their
pairs, verified by Hamming distance; the members of larger ones take an exact way that has no large groups: each emits
itself and its 64 one-bit neighbours as keys, and two fingerprints are within two bits exactly if they share a key; a
key has 65 members at most.

`similar_groups` links rows by distance (any k) and by the Jaccard similarity of their word shingles. Rows that agree on two
partitions, if over BUCKET do, are held against three of them: those near one form a cluster, those similar a group. Then all that is
left is compared, exactly: rows of a bucket in different clusters by a join on the bucket, in which a large bucket's main
cluster stands on one side only; rows of one cluster in different groups block by block, with the similarity in the join's
condition, and the cluster's main group on one side only. So copies of a text are never paired with each other, pairs
that are not similar are never written, and no task holds more than a block.

Components come from alternating large-star and small-star steps, in tables; nothing of a size that grows with the corpus
reaches the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import fresh, sliced, small_batches, value_filter, where_held, written

BITS = 64
MAX_DISTANCE = 2
#: Distinct fingerprints of a bucket whose pairs are listed; larger buckets take the one-bit-neighbour way.
BUCKET = 48
#: Near copies of texts (similar_groups): words of a shingle, their least similarity, and the bits that fingerprints of a
#: text's words may differ in. A copy of similarity 0.8 differs in few words, so in few bits: 7 hold 98 in a hundred. A word
#: weighs its count to a power so low that the words every text has don't make texts alike.
WORDS, SIMILARITY, DISTANCE, WORD_POWER = 5, 0.8, 7, 0.25
#: Comparisons of a bucket that cost as much as a probe; rows of a block of a cluster; numbers of partitions tried.
PROBE_COST, BLOCK_ROWS, PARTITIONS = 200.0, 1024, (4, 5, 6)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shingles(text: str | None, k: int, word, lower) -> list[str]:
    """The word shingles of a text in turn: its whole sequence if it has fewer words."""
    words = word.findall((text or "").translate(lower))
    return [" ".join(words)] if len(words) < k else list(map(" ".join, zip(*(words[i:] for i in range(k)))))


def _reader():
    """What `_shingles` takes: the words' pattern, and the table that lower-cases A to Z."""
    import re

    return re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def _fingerprinter(shingle: int, power: float, kept: list[str]):
    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        word, lower = _reader()
        block = 1 << 16
        shift = np.arange(64, dtype=np.uint64)

        def fingerprint(text: str | None) -> int:
            rows, weights = _shingles(text, shingle, word, lower), None
            if rows == [""]:
                return 0
            if power != 1:
                counts = Counter(rows)
                rows, weights = list(counts), np.fromiter(counts.values(), np.float64, len(counts)) ** power
            n = len(rows)
            hashes = np.fromiter((xxh64_intdigest(x, 42) for x in rows), np.uint64, n)
            votes = np.zeros(64)
            for at in range(0, n, block):  # bits of a block of hashes, little-endian
                part = np.ascontiguousarray(hashes[at : at + block])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                votes += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[at : at + block] @ bits
            total = n if weights is None else weights.sum()
            return int(((2 * votes > total).astype(np.uint64) << shift).sum(dtype=np.uint64))

        for batch in batches:
            for part in sliced(batch, "text"):
                got = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64)
                rest = [part.column(c).cast(pa.int64()) for c in kept]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(got.view(np.int64))], names=[*kept, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, power: float = 1.0, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns kept (numbers) and fp (the 64 bits as a signed long) of every row; null and wordless texts have fp 0.
    A shingle's weight is how often it occurs, to that power."""
    schema = ", ".join(f"{c} long" for c in (*kept, "fp"))
    return small_batches(docs.select(*kept, "text")).mapInArrow(_fingerprinter(shingle, power, list(kept)), schema)


def _bit_sums(batches):
    """How often each pair of bits is set together, summed over a task's rows: 64 x 64 counts in one row."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros((64, 64), np.int64)
    for batch in batches:
        values = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64))
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "n"]
    )


def correlated_groups(together, rows: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal size, each grown from a bit by the bits most correlated with it."""
    import numpy as np

    p = np.diag(together) / max(rows, 1)
    cov = together / max(rows, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    # a bit that never varies tells nothing: it counts as wholly correlated with every other such bit
    flat = p * (1 - p) < 1e-9
    corr = np.abs(cov / np.outer(sd, sd))
    corr[np.ix_(flat, flat)] = 1.0
    left, groups = set(range(64)), []
    for g in range(parts):
        size = len(left) // (parts - g)
        free = sorted(left)
        seed = max(free, key=lambda b: (corr[b, free].sum(), -b))
        group = [seed]
        while len(group) < size:
            free = sorted(left - set(group))
            group.append(max(free, key=lambda b: (corr[b, group].mean(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, one for each partition, that sum to budget at the least total cost: dynamic programming over
    (partition, budget used). costs[i][t] is the estimated cost of threshold t in partition i."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t, c in cost.items():
                if used + t not in step or total + c < step[used + t][0]:
                    step[used + t] = (total + c, [*chosen, t])
        best = step
    return best[budget]


def plan_masks(fps: DataFrame, k: int = MAX_DISTANCE, options: tuple[int, ...] = (2, 3, 4), probe_cost: float = 1.0) -> list[int]:
    """The masks of the cheapest allocation. fps: distinct fingerprints. Counts cover all of them. probe_cost: comparisons
    that cost as much as a probe."""
    import math

    import numpy as np

    together = np.zeros(4096, np.int64)
    for r in fps.select("fp").mapInArrow(_bit_sums, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        together[r["cell"]] = r["n"]
    together, rows = together.reshape(64, 64), fps.count()
    layouts = {m: correlated_groups(together, rows, m) for m in options}
    keys = [
        F.struct(F.lit(100 * m + i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in group)))).alias("key"))
        for m, groups in layouts.items()
        for i, group in enumerate(groups)
    ]
    counted = fps.select(F.inline(F.array(*keys))).groupBy("part", "key").count()
    pairs = {
        r["part"]: float(r["pairs"])
        for r in counted.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    }
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, group in enumerate(groups):
            cost = {-1: 0.0}
            for t in range(min(k, len(group) - 1) + 1):
                # a probe for each mask, and the pairs equal under it: about as many under each as under none
                masks = math.comb(len(group), t)
                cost[t] = masks * (probe_cost * max(rows, 1) + pairs.get(100 * m + i, 0.0) * 2.0**t)
            costs.append(cost)
        total, chosen = allocate(costs, k - m + 1)
        if best is None or total < best[0]:
            best = (total, groups, chosen)
    _, groups, chosen = best
    return [
        _signed(sum(1 << b for b in group if b not in left))
        for group, t in zip(groups, chosen)
        if t >= 0
        for left in map(set, combinations(group, t))
    ]


def partitions_of(masks: list[int]) -> list[int]:
    """The partitions that masks leave bits out of: unions of the masks that share bits."""
    parts: list[int] = []
    for mask in masks:
        for other in [p for p in parts if p & mask]:
            parts.remove(other)
            mask |= other
        parts.append(mask)
    return parts


def _star(keyed: DataFrame) -> DataFrame:
    """Links of each key's least fingerprint to its others: enough for components, as all of a key are linked."""
    return (
        keyed.groupBy("key")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a != b")
    )


def links(fps: DataFrame, masks: list[int], bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all within two bits of each other."""
    # the masks are one constant array, so the plan stays small however many there are
    probes = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "bits"))
    keyed = written(probes.select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key")), "simhash-probes")
    sizes = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    members = written(keyed.join(sizes, ["mask", "key"]), "simhash-members")

    def later(x: Column, i: Column, all_fps: Column) -> Column:
        near = F.filter(F.slice(all_fps, i + 2, F.lit(bucket)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_DISTANCE)
        return F.transform(near, lambda y: F.struct(x.alias("a"), y.alias("b")))

    small = (
        members.where(F.col("n") <= bucket)
        .groupBy("mask", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.flatten(F.transform("fps", lambda x, i: later(x, i, F.col("fps")))).alias("pairs"))
        .select(F.inline("pairs"))
    )
    large = members.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(BITS)])
    exact = _star(large.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key")))
    return small.unionByName(exact).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges (a, b), but the least of its component, with that one.

    Alternating stars: large-star hangs a node's larger neighbours on its least neighbour, small-star its smaller
    ones; the end is a star for each component. Each step is a table, so plans stay short and lost executors cost
    one step.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "cc-least")
        large = written(
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc-large"
        )
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id of the rows whose fingerprints are linked in any number of steps of two
    bits or fewer. Null, empty and wordless texts have fingerprint zero and link like any other; rows repeated or of
    one fingerprint share a component; null doc_ids are never smallest unless alone; an empty table gives no row.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    edges = written(links(fps, plan_masks(fps)), "simhash-links")
    roots = written(components(edges), "simhash-components")
    joined = written(
        fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    ids = written(joined.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-ids")
    named = written(joined.join(ids, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _sets(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        word, lower = _reader()
        for batch in batches:
            for part in sliced(batch, "text"):
                found = [
                    np.array([xxh64_intdigest(x, 42) for x in set(_shingles(t, shingle, word, lower))], np.uint64).view(np.int64)
                    for t in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    return run


def _held(nodes: DataFrame) -> tuple[DataFrame, int]:
    found, bits = value_filter(nodes, "node")
    return written(found, "near-filter"), bits


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, set: the shingle hashes of the rows in nodes, and of the few more that the filter lets through."""
    some = where_held(docs.select("node", "text"), "node", _held(nodes)).repartition("node")  # few rows are left of many tasks
    return written(some.mapInArrow(_sets(shingle), "node long, set array<long>"), "near-sets")


def _alike(x: str, y: str, least: float) -> Column:
    """Whether two sets' Jaccard similarity is `least` or more; sizes alone settle it where they are too different."""
    n, m = F.size(x), F.size(y)
    shared = F.size(F.array_intersect(x, y))
    return (F.least(n, m) >= least * F.greatest(n, m)) & (shared >= least * (n + m - shared))


def _similar(docs: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of rows (column node of docs) whose shingle sets are similar."""
    pairs = written(pairs.select("a", "b").distinct(), "near-pairs")
    sets = _shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
    )
    return written(both.where(_alike("x", "y", least)).select("a", "b"), "near-links")


def _rooted(edges: DataFrame, name: str) -> DataFrame:
    """node and the least node of its component, which itself is there too, in a column of that name."""
    found = written(components(edges), "near-roots")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", name)


def _main(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """keys, main: the largest part of each key."""
    shares = df.groupBy(*keys, part).agg(F.count("*").alias("share"))
    return shares.groupBy(*keys).agg(F.max_by(part, F.struct("share", part)).alias("main"))


def _close(x: str, y: str, distance: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance


def _within_clusters(members: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Links (a, b) between the groups of each cluster. members: cluster, node, fp, group, set. Blocks of about BLOCK_ROWS
    rows meet each other; rows of the cluster's main group are on the right side only."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocked = members.join(sizes, "cluster").join(_main(members, ["cluster"], "group"), "cluster")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocked.where("group != main").select("cluster", F.col("block").alias("i"), each.alias("j"), F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("group").alias("group_a"), F.col("set").alias("x"))
    right = blocked.select("cluster", each.alias("i"), F.col("block").alias("j"), F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("group").alias("group_b"), F.col("set").alias("y"), "main")
    once = (F.col("a") < F.col("b")) | (F.col("group_b") == F.col("main"))
    apart = F.col("group_a") != F.col("group_b")
    return left.join(right, ["cluster", "i", "j"]).where(apart & once & _close("fp_a", "fp_b", distance) & _alike("x", "y", similarity)).select("a", "b")


def similar_groups(
    docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, distance: int = DISTANCE, bucket: int = BUCKET
) -> DataFrame:
    """node, root: every row (column node, a number of its own; text) that is similar to another, and the least node of its
    group. Two rows are linked where their words' fingerprints differ in `distance` bits at most and the Jaccard similarity
    of their shingles is `similarity` or more; a group is what links connect.

    Null and wordless texts are alike (similarity 1); texts of fewer words than a shingle are similar if equal. No bound
    on rows of a fingerprint, a bucket or a group; an empty table gives none. docs must be a table or file scan.
    """
    rows = written(fingerprints(docs, 1, WORD_POWER, ("node",)), "near-fingerprints")
    masks = plan_masks(written(rows.select("fp").distinct(), "near-distinct"), distance, PARTITIONS, PROBE_COST)

    def keyed(df: DataFrame, masks: list[int] = masks) -> DataFrame:
        probes = df.select("*", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "bits"))
        return probes.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("bits")))).drop("mask", "bits")

    # under two partitions at once a bucket is large only by copies, so any of its rows is one of them
    wide = [a | b for a, b in combinations(partitions_of(masks), 2)]
    row = F.struct("node", "fp")
    hot = keyed(rows, wide).groupBy("bucket").agg(F.count("*").alias("n"), F.array(F.min(row), F.max(row), F.min_by(row, F.xxhash64("node"))).alias("ends"))
    hot = written(hot.where(F.col("n") > bucket).select("bucket", F.explode("ends").alias("end")).select("bucket", F.col("end.node").alias("a"), F.col("end.fp").alias("fp_a")), "near-hot")
    star = keyed(rows, wide).join(hot, "bucket").where((F.col("node") != F.col("a")) & _close("fp", "fp_a", distance))
    star = written(star.select("a", F.col("node").alias("b")).distinct(), "near-star")
    clusters = written(_rooted(star, "cluster"), "near-clusters")
    links_ = _similar(docs, star, shingle, similarity)

    tagged = written(rows.join(clusters, "node", "left"), "near-tagged")
    main = written(_main(keyed(tagged.where("cluster is not null")), ["bucket"], "cluster"), "near-main")
    left = keyed(tagged).join(main, "bucket", "left").where("main is null or cluster is null or cluster != main")
    left = left.select("bucket", F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.col("cluster").alias("cluster_a"), "main")
    right = keyed(tagged).select("bucket", F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.col("cluster").alias("cluster_b"))
    apart = F.coalesce(F.col("cluster_a") != F.col("cluster_b"), F.lit(True))
    once = (F.col("a") < F.col("b")) | F.coalesce(F.col("cluster_b") == F.col("main"), F.lit(False))
    across = left.join(right, "bucket").where(apart & once & (F.col("a") != F.col("b")) & _close("fp_a", "fp_b", distance))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links_ = written(links_.unionByName(_similar(docs, across, shingle, similarity)), "near-links")

    groups = _rooted(links_, "group")
    sets = _shingle_sets(docs, clusters.select("node"), shingle)
    members = tagged.where("cluster is not null").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    within = _within_clusters(written(members.join(sets, "node"), "near-members"), distance, similarity)
    return _rooted(links_.unionByName(within), "root")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group of near copies (similar_groups), all columns as they were: the row with the smallest
    doc_id, null last (of repeated ones the first). Rows that have no near copy are not shuffled; an empty table stays empty."""
    node = fresh("node_of_row", docs)
    numbered = docs.withColumn(node, F.monotonically_increasing_id())
    found = written(similar_groups(numbered.select(F.col(node).alias("node"), "text"), similarity=similarity, distance=distance), "near-roots")
    ids = where_held(numbered.select(F.col(node).alias("node"), F.col("doc_id").cast("long").alias("id")), "node", _held(found))
    grouped = ids.join(found, "node")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"))
    dropped = written(found.join(best, "root").where(F.col("node") != F.col("best.node")).select("node"), "near-drops")
    mark, gone = fresh("near_mark", docs), fresh("near_gone", docs)
    marked = where_held(numbered, node, _held(dropped), mark)
    doubtful = marked.where(F.col(mark)).join(dropped.select(F.col("node").alias(gone)), F.col(node) == F.col(gone), "left_anti")
    return marked.where(~F.col(mark)).unionByName(doubtful).select(*docs.columns)


def op6_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
