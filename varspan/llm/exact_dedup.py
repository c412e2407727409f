"""Exact dedup with a log-structured merge index of text digests.

A batch of rows fills memtables (Spark's partial aggregation: one entry per digest and task), which flush into
digest-sorted runs, written as Parquet with a Bloom filter on the digest. Compaction merges runs level by level and
keeps the smallest identifier of each digest. The digests of two rows or more make a filter of bounded size; the texts it
lets through, and no others, are verified byte by byte: the different texts of a digest, gathered before each shuffle,
must be one. So texts without a copy never leave their task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from varspan.llm.common import SPACE, fresh, shared_dir, value_filter, where_held, written

#: Runs that one ingest flushes, and that one compaction merges.
FAN_IN = 4
#: Reduce tasks that a digest's rows are first aggregated in.
SALTS = 16


def normal_text(text: Column) -> Column:
    """Each run of white space as one space; null as empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _rank(doc_id: str, row: str) -> Column:
    """Orders rows by identifier, null last, then by row number, so exactly one row is least."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row_no"))


class DigestIndex:
    """Sorted runs (digest, keeper, copies) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, rows: int, path: str | None = None):
        """rows: about how many rows all ingests bring; it sizes the filters."""
        self.spark = spark
        self.rows = rows
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.runs: list[str] = []

    def _flush(self, entries: DataFrame, level: int) -> str:
        """Writes entries as a run: sorted by digest within each hash partition of the digest, with Bloom filters made
        for as many digests as a file gets on average (unsized, each file's filter would take a megabyte)."""
        run = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        filters = {
            "parquet.bloom.filter.enabled#digest": "true",
            "parquet.bloom.filter.expected.ndv#digest": str(max(64, self.rows // (files * FAN_IN))),
        }
        entries.sortWithinPartitions("digest").write.options(**filters).parquet(run)
        return run

    def ingest(self, rows: DataFrame) -> None:
        """rows: digest, doc_id, row_no. Memtables fill in the map tasks and flush as one level-0 run."""
        self.runs.append(
            self._flush(
                rows.groupBy("digest").agg(F.min(_rank("doc_id", "row_no")).alias("keeper"), F.count("*").alias("copies")),
                0,
            )
        )

    def compact(self) -> None:
        """Merges the runs, FAN_IN at a time, until one is left; the smallest keeper of a digest stays."""
        level = 0
        while len(self.runs) > 1:
            level += 1
            groups = [self.runs[i : i + FAN_IN] for i in range(0, len(self.runs), FAN_IN)]
            self.runs = [
                group[0]
                if len(group) == 1
                else self._flush(
                    self.spark.read.parquet(*group)
                    .groupBy("digest")
                    .agg(F.min("keeper").alias("keeper"), F.sum("copies").alias("copies")),
                    level,
                )
                for group in groups
            ]

    def entries(self) -> DataFrame:
        self.compact()
        return self.spark.read.parquet(self.runs[0])

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests in all runs; Parquet's Bloom filters and statistics skip what can't hold them."""
        found = self.spark.read.parquet(*self.runs).where(F.col("digest").isin(digests))
        return found.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.sum("copies").alias("copies"))


def _collisions(texts: DataFrame) -> DataFrame | None:
    """Byte verification. texts: digest, body of all rows that share a digest with another row (and perhaps others). None
    if every digest stands for one text, else the digests that don't. The set of a digest's different texts (one, but for a
    collision of SHA-256) is made in the map tasks, then by digest and salt, then by digest, so a group of copies of any
    size sends a text a task."""
    salt = fresh("salt", texts)
    wrong = (
        texts.withColumn(salt, F.spark_partition_id() % SALTS)
        .groupBy("digest", salt)
        .agg(F.collect_set("body").alias("bodies"))
        .groupBy("digest")
        .agg(F.array_distinct(F.flatten(F.collect_list("bodies"))).alias("bodies"))
        .where(F.size("bodies") > 1)
        .select("digest")
    )
    wrong = written(wrong, "digest-collisions")
    return None if wrong.isEmpty() else wrong


def _indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, int]]:
    """(rows, entries, filter): digest of each row, the compacted index, and the filter of the digests of two rows or more."""
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(normal_text(F.col("text")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    index = DigestIndex(docs.sparkSession, rows.count())
    for part in range(FAN_IN):  # row_no's upper bits are the scan's partition: each ingest gets every fourth of them
        index.ingest(rows.where(F.shiftright("row_no", 33) % FAN_IN == part))
    entries = index.entries()
    filters, bits = value_filter(entries.where("copies > 1"), "digest")
    return rows, entries, (written(filters, "digest-filter"), bits)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (columns doc_id, text; others are ignored): doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays (a null doc_id is largest;
    of repeated rows with that doc_id, one stays). An empty table gives an empty result.
    """
    rows, entries, found = _indexed(docs)
    body = normal_text(F.col("text"))
    texts = docs.select(body.alias("body"), F.unhex(F.sha2(body, 256)).alias("digest"))
    wrong = _collisions(where_held(texts, "digest", found))
    if wrong is not None:  # a collision of SHA-256: the digest of these rows is made from text and digest alike
        salted = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            body.alias("body"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ).join(wrong, "digest", "left_semi")
        by_text = salted.groupBy("digest", "body").agg(
            F.min(_rank("doc_id", "row_no")).alias("keeper"), F.count("*").alias("copies")
        )
        apart = salted.join(by_text, ["digest", "body"]).select("doc_id", "digest", "row_no", "keeper", "copies")
        joined = rows.join(wrong, "digest", "left_anti").join(entries, "digest").select(*apart.columns).unionByName(apart)
    else:
        joined = rows.join(entries, "digest")
    return joined.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row_no") == F.col("keeper.row_no")).alias("kept"),
        "digest",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, all columns as they were.

    Texts are equal as in exact_duplicates (null as empty). The row with the smallest doc_id stays (null is largest); of
    rows with that doc_id the one with the least hash of its columns, so which one stays doesn't depend on the run (map and
    variant columns apart). A row whose text no other row has passes through without a
    shuffle; an empty table stays empty; columns may have any names.
    """
    found = _indexed(docs)[2]
    key, mark, body = (fresh(x, docs) for x in ("digest_of_text", "may_repeat", "body_of_text"))
    keyed = docs.withColumn(key, F.unhex(F.sha2(normal_text(F.col("text")), 256)))
    repeated = written(where_held(keyed, key, found), "exact-candidates")
    wrong = _collisions(repeated.select(normal_text(F.col("text")).alias("body"), F.col(key).alias("digest")))
    keys = [key] if wrong is None else [key, body]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*hashed).alias("hash"))
    salt = fresh("salt", docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = (
        repeated.withColumns({salt: F.spark_partition_id() % SALTS, body: normal_text(F.col("text"))})
        .groupBy(*keys, salt)
        .agg(F.min_by(whole, rank).alias("row"), F.min(rank).alias("rank"))
        .groupBy(*keys)
        .agg(F.min_by("row", "rank").alias("row"))
        .select("row.*")
    )
    return where_held(keyed, key, found, mark).where(~F.col(mark)).select(*docs.columns).unionByName(first)


def op10_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents
), g as (select h, min(doc_id) as keep_id, count(*) as group_size from t group by h)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.h as text_sha256 from t join g using (h)
"""
