"""What the corpus operators share: hashes, column names, bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varspan.shared import shared_dir, written

__all__ = [
    "SPACE", "WORD", "crc_bucket", "fresh", "read_table", "shared_dir", "sliced", "small_batches", "unit_hash", "value_filter", "where_held", "written"
]

#: ASCII white space of the contracts: space and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: Bits of a filter of values: 4 kB at least, 32 MB at most.
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name none of the frames has (Spark compares names without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by '|' (null: empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / float(1 << 52)


def crc_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the identifier as text, modulo buckets (null: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % buckets


def value_filter(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(slot, bitmap) and the number of bits of a filter over a column's values: 16 bits a value, LEAST_BITS at least and
    MOST_BITS at most, in rows of 4 kB. Beyond that it lets more values through; what it holds it never loses."""
    n, bits = df.count(), LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = df.select(F.bitmap_bucket_number(at).alias("slot"), F.bitmap_bit_position(at).alias("bit"))
    return rows.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bitmap")), bits


def where_held(df: DataFrame, column: str, found: tuple[DataFrame, int], mark: str | None = None) -> DataFrame:
    """The rows whose value in a column the filter may hold; with mark: all rows, and a column that says so. The filter is
    broadcast: MOST_BITS bound it at 32 MB. Nothing of df is shuffled."""
    filters, bits = found
    slot, bit, bitmap = (fresh(x, df) for x in ("filter_slot", "filter_bit", "filter_map"))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    probe = df.withColumns({slot: F.bitmap_bucket_number(at), bit: F.bitmap_bit_position(at).cast("int")})
    filters = F.broadcast(filters.select(F.col("slot").alias(slot), F.col("bitmap").alias(bitmap)))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, F.col(bit) % 8) == 1, F.lit(False))
    out = probe.join(filters, slot, "left" if mark else "inner")
    return (out.withColumn(mark, held) if mark else out.where(held)).drop(slot, bit, bitmap)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in batches of BATCH_ROWS rows from now on, unless the session has a number of its own:
    Spark's 10,000 rows of texts are tens of MB for each buffer on either side."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def sliced(batch, text_column: str, limit: int = 4 << 20):
    """Pieces of an Arrow batch of about `limit` bytes of text, at least a row each, so that memory stays bounded."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = batch.column(text_column)
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) // limit).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield batch.slice(start, end - start)
