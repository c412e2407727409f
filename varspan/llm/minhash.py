"""MinHash near-dedup with sequential Bayesian verification.

Texts of the same words are one node, found by a digest. A node's distinct two-word shingles give BANDS x ROWS minimum
hashes. ROWS of them make a band; nodes that agree on a band share a bucket. One bit of each hash makes the signature, in
ROWS batches of a bit from every band. A pair of a bucket is compared by one, then two, then three batches more: with n bits seen, d of them different,
the posterior of its similarity (even prior; bits of different hashes agree half of the time) gives the chance that it
reaches the threshold, and the pair is dropped as soon as that chance is below MISS. What is left meets an exact bound: each
node has a bitmap of PARITY bits, each set where an odd number of shingles hash to it; a shingle that only one of two sets has
turns one bit, so the bits that differ are at most the shingles that differ. Both tests are longs compared in the join's own
condition, so a dropped pair is never a row. Survivors are verified on their full shingle sets.

Groups are what links connect, so not all pairs of a bucket are needed. First each node meets its bucket's least node; the
links found make components. Then, in each bucket, the nodes outside the bucket's largest component meet all nodes of other components.
Every pair of a bucket is compared or already connected: copies by the thousand cost a comparison each. Large buckets are dealt in blocks, so no task holds one.

With BANDS and ROWS as they are, a pair of similarity 0.8 shares no bucket in 5 of ten million cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import fresh, sliced, small_batches, value_filter, where_held, written
from varspan.llm.simhash import components

WORDS, SIMILARITY_100 = 2, 80
BANDS, ROWS = 48, 6
#: The chance of being similar below which a pair is dropped.
MISS = 1e-6
#: Bits of a node's parity bitmap.
PARITY = 1024
#: Nodes of a block of a large bucket.
BLOCK_ROWS = 2048


def _shingle_hashes(words: list[bytes], k: int):
    """The distinct hashes of the word shingles: of the whole sequence if it has fewer words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    shingles = {b" ".join(words)} if len(words) < k else set(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    return np.fromiter((xxh64_intdigest(x, 42) for x in shingles), np.uint64, len(shingles))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A to Z, and ASCII white space


def _node(words: list[bytes]) -> bytes:
    from hashlib import sha256

    return sha256(b" ".join(words)).digest()[:16]


def _sketcher(k: int, bands: int, rows: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(13)
        factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        block, width = 2048, np.arange(bands, dtype=np.uint64)
        odd = np.uint64(0x9E3779B97F4A7C15)

        def sketch(hashes):
            low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
            least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
            for at in range(0, len(hashes), block):
                mixed = low[at : at + block, None] * factors + high[at : at + block, None]
                np.minimum(least, mixed.min(axis=0), out=least)
            table = least.reshape(bands, rows).astype(np.uint64)
            key = width * odd
            for row in range(rows):
                key = (key ^ table[:, row]) * odd
                key ^= key >> np.uint64(32)
            bits = (table * odd) >> np.uint64(63)
            batches = (bits << width[:, None]).sum(axis=0, dtype=np.uint64)
            parity = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
            parity = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)
            return key.view(np.int64), np.concatenate([batches, parity]).view(np.int64)

        for batch in batches:
            for part in sliced(batch, "text"):
                sizes, nodes, keys, signatures = [], [], [], []
                for text in part.column("text").to_pylist():
                    words = _words(text or "")
                    if not words:
                        sizes.append(0), nodes.append(None), keys.append(None), signatures.append(None)
                        continue
                    hashes = _shingle_hashes(words, k)
                    key, signature = sketch(hashes)
                    sizes.append(len(hashes)), nodes.append(_node(words)), keys.append(key), signatures.append(signature)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, longs), pa.array(signatures, longs)],
                    names=["doc_id", "text_key", "n", "digest", "bands", "sig"],
                )

    return run


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in sliced(batch, "text"):
                words = [_words(t) for t in part.column("text").to_pylist()]
                found = [_shingle_hashes(w, k).view("int64") for w in words]
                yield pa.RecordBatch.from_arrays([pa.array([_node(w) for w in words], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["digest", "set"])

    return run


def allowed(bits: int, batches: int, similarity: float, miss: float) -> list[int]:
    """For 1 to `batches` batches of `bits` bits: the most different bits with which the posterior chance of `similarity` or
    more is still at least `miss`."""
    import numpy as np

    s = (np.arange(20000) + 0.5) / 20000
    agree, differ = np.log((1 + s) / 2), np.log((1 - s) / 2)
    out = []
    for n in range(bits, bits * batches + 1, bits):
        d = 0
        while d < n:
            likely = (n - d - 1) * agree + (d + 1) * differ
            likely = np.exp(likely - likely.max())
            if likely[s >= similarity].sum() < miss * likely.sum():
                break
            d += 1
        out.append(d)
    return out


def _may_be_similar(x: str, y: str, limits: list[int], similarity: int) -> Column:
    """Whether two sketches (structs of n, the batches and the bitmap's longs) let a pair through. The sequential test looks
    after 1, 3, 6, ... batches, each time only if the looks before let the pair through; then the bitmaps: of sets of n and
    m shingles that are similar, at most (n + m) (100 - similarity) / (100 + similarity) shingles are in one set only."""
    differ = [F.bit_count(F.col(x)[f"s{i}"].bitwiseXOR(F.col(y)[f"s{i}"])) for i in range(len(limits) + PARITY // 64)]
    looks, step = [], 1
    while sum(range(1, step + 1)) < len(limits):
        looks.append(sum(range(1, step + 1)))
        step += 1
    passes = F.lit(True)
    for n in [*looks, len(limits)]:
        passes = passes & (sum(differ[1:n], differ[0]) <= limits[n - 1])
    one_sided = sum(differ[len(limits) + 1 :], differ[len(limits)])
    return passes & ((100 + similarity) * one_sided <= (100 - similarity) * (F.col(x)["n"] + F.col(y)["n"]))


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = written(sketches.select("id", "digest", "text_key").join(nodes, "id"), "minhash-wanted")
    filters, bits = value_filter(wanted, "text_key")
    held = where_held(docs.select("text_key", "text"), "text_key", (written(filters, "minhash-filter"), bits))
    sets = held.mapInArrow(_sets(k), "digest binary, set array<long>").groupBy("digest").agg(F.first("set").alias("set"))
    sets = written(wanted.join(sets, "digest").select("id", "set"), "minhash-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    n, m, shared = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    alike = (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & (100 * shared >= similarity * (n + m - shared))
    return both.where(alike).select("a", "b")


def _across(members: DataFrame, sketches: DataFrame, limits: list[int], similarity: int, block_rows: int) -> DataFrame:
    """The pairs (a, b) of a bucket that are in different components and may be similar, but those with the leader, which have
    been verified. members: key, id, leader, component; sketches, with id, join the rows of buckets with several components alone."""
    shares = members.groupBy("key", "component").agg(F.count("*").alias("share"))
    most = F.max(F.struct("share", "component"))
    main = shares.groupBy("key").agg(most["component"].alias("main"), F.sum("share").alias("n"), F.count("*").alias("parts"), most["share"].alias("in_main"))
    blocks = lambda n: F.ceil(n / block_rows).cast("int")
    main = main.where("parts > 1").select("key", "main", blocks(F.col("n")).alias("right_blocks"), blocks(F.col("n") - F.col("in_main")).alias("left_blocks"))
    open_ = written(members.join(main, "key"), "minhash-open").join(sketches.select("id", "sketch"), "id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    side = lambda i, x: [F.col("id").alias(i), F.col("sketch").alias(x), F.col("component").alias(f"part_{i}")]
    left = open_.where("component != main").select("key", dealt("left_blocks").alias("i"), each("right_blocks").alias("j"), *side("a", "x"), "leader")
    right = open_.select("key", each("left_blocks").alias("i"), dealt("right_blocks").alias("j"), *side("b", "y"), "main")
    once = (F.col("a") < F.col("b")) | (F.col("part_b") == F.col("main"))
    new = (F.col("part_a") != F.col("part_b")) & (F.col("a") != F.col("leader")) & (F.col("b") != F.col("leader"))
    found = left.join(right, ["key", "i", "j"]).where(new & once & _may_be_similar("x", "y", limits, similarity))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(links: DataFrame, name: str) -> DataFrame:
    found = written(components(links), "minhash-roots")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias(name))


def near_duplicates(
    docs: DataFrame, k: int = WORDS, similarity: int = SIMILARITY_100, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """doc_id, n, component_id for every row of docs (columns doc_id, text; others are ignored).

    n: distinct shingles of k words (64-bit hashes; with fewer words the whole sequence is one; none: 0). component_id: the
    smallest doc_id that can be reached by links of a Jaccard similarity of `similarity` hundredths or more. Null, empty and
    wordless texts are linked with nothing: their component is their own doc_id. A null doc_id is smallest only if its component
    has no other; repeated rows share a component; an empty table gives no row. No bound on copies, buckets or links.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    schema = "doc_id long, text_key long, n long, digest binary, bands array<long>, sig array<long>"
    table = written(small_batches(keyed).mapInArrow(_sketcher(k, bands, rows), schema), "minhash-table")
    nodes = table.where("digest is not null").groupBy("digest")
    nodes = nodes.agg(F.min("doc_id").alias("least_id"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sketch = F.struct("n", *[F.get("sig", F.lit(i)).alias(f"s{i}") for i in range(rows + PARITY // 64)])  # one column each: longs without bounds to check
    nodes = nodes.select("digest", "least_id", "text_key", "bands", sketch.alias("sketch"), F.monotonically_increasing_id().alias("id"))
    sketches = written(nodes, "minhash-sketches")  # so the numbers are those of a table

    limits = allowed(bands, rows, similarity / 100, miss)
    banded = sketches.select("id", F.explode("bands").alias("key"))
    shared = written(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("key", "leader"), "minhash-buckets")
    filters, bits = value_filter(shared, "key")
    members = written(where_held(banded, "key", (written(filters, "minhash-filter"), bits)).join(shared, "key"), "minhash-members")

    signed = sketches.select("id", "sketch")
    star = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = star.join(signed.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(signed.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
    star = written(star.where(_may_be_similar("x", "y", limits, similarity)).select("a", "b"), "minhash-star")
    links = written(_verified(star, keyed, sketches, k, similarity), "minhash-links")

    tagged = members.join(_rooted(links, "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rest = written(_across(tagged, sketches, limits, similarity, block_rows), "minhash-rest")
    if not rest.isEmpty():
        links = written(links.unionByName(_verified(rest, keyed, sketches, k, similarity)), "minhash-links")
    roots = sketches.select("id", "digest", "least_id").join(_rooted(links, "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    roots = written(roots, "minhash-named")
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(roots.join(least, "root").select("digest", "component_id"), "minhash-components")
    worded = table.where("digest is not null").join(named, "digest").select("doc_id", "n", "component_id")
    return worded.unionByName(table.where("digest is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: int = SIMILARITY_100) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component (near_duplicates), all columns as they were. Identifiers
    must be there and unique."""
    found = near_duplicates(docs, k, similarity).where("doc_id = component_id")
    mine = fresh("kept_id", docs)
    return docs.join(found.select(F.col("doc_id").alias(mine)), docs["doc_id"] == F.col(mine), "left_semi")


def op13_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
