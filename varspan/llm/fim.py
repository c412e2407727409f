"""Fill-in-middle transformation over an index of distinct texts.

Texts whose digest another row has are grouped by digest and content (bytes compared by the grouping itself), pre-aggregated
where they are read, so a group of copies of any size sends a text a task. Each distinct text gets the list of its line ends
once, in Elias-Fano form. Documents join the index by digest, without their text; an index entry of many copies is dealt to
one task for each COPIES of them. A text that no other row has is its own entry: list and document are in one row already,
so it isn't shuffled. Each document's seeded cuts are then selected from the list, and the output is put together in Spark.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from varspan.llm.common import small_batches, value_filter, where_held, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text that a task joins with a copy of its index entry.
COPIES = 20_000
SEED, RATE, SPM_RATE = 7, 100, 50
LIST = StructType().add("n", LongType()).add("ends", BinaryType())


def encode(values, universe: int) -> bytes:
    """Rising numbers below or equal to universe in Elias-Fano form: the count and the number of low bits of each, the low
    bits, and a bitmap in which the i-th one stands at place (i-th number without its low bits) + i."""
    import numpy as np

    n = len(values)
    if not n:
        return b""
    low = max((universe // n).bit_length() - 1, 0)
    values = np.asarray(values, np.int64)
    lows = (values[:, None] >> np.arange(low)) & 1
    high = np.zeros((universe >> low) + n, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    packed = [np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes() for x in (lows, high)]
    return n.to_bytes(8, "little") + bytes([low]) + packed[0] + packed[1]


def select(data: bytes, i: int) -> int:
    """The i-th number (from 0) of an encoded list."""
    import numpy as np

    n, low = int.from_bytes(data[:8], "little"), data[8]
    split = 9 + (n * low + 7) // 8
    high = np.frombuffer(data, np.uint8, offset=split)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    byte = int(np.searchsorted(ones, i + 1))
    seen = int(ones[byte - 1]) if byte else 0
    place = [b for b in range(8) if high[byte] >> b & 1][i - seen]
    first, last = i * low, (i + 1) * low
    bits = int.from_bytes(data[9 + first // 8 : 9 + (last + 7) // 8], "little") >> (first % 8)
    return ((8 * byte + place - i) << low) | (bits & ((1 << low) - 1))


def line_ends(text: str):
    """Where each line of a text ends, in code points: after each line feed, and at the end of a last line without one."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    return np.append(ends, len(points)) if len(points) and (not len(ends) or ends[-1] < len(points)) else ends


@F.arrow_udf(LIST)
def boundary_list(texts: pa.Array) -> pa.Array:
    counts, lists = [], []
    for x in texts:
        text = x.as_py()
        ends = line_ends(text)
        counts.append(len(ends))
        lists.append(encode(ends, len(text)))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lists, pa.binary())], names=["n", "ends"])


@F.arrow_udf(LongType())
def boundary(lists: pa.Array, units: pa.Array) -> pa.Array:
    """Where the first `units` lines end."""
    return pa.array([select(x.as_py(), k - 1) if k else 0 for x, k in zip(lists, units.to_pylist())], pa.int64())


def _seeded(doc_id: Column, part: int, seed: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part - 7, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. No text that was cut contains a mark, so the first of each is it."""

    def between(opening: str, closing: str) -> Column:
        start = F.locate(opening, output) + len(opening)
        return F.substr(output, start, F.locate(closing, output) - start)

    def after(opening: str) -> Column:
        return F.substr(output, F.locate(opening, output) + len(opening))

    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE)))
        .otherwise(F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX)))
    )


def _with_cuts(rows: DataFrame, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """rows: doc_id, text, n, ends. Adds form and, where the text is cut, the two ends; then the output."""
    text, n, doc_id = F.col("text"), F.col("n"), F.col("doc_id")
    first, second = (F.pmod(_seeded(doc_id, i, seed), n + 1) for i in (1, 2))
    plain = (n == 0) | (F.pmod(_seeded(doc_id, 3, seed), F.lit(100)) >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(_seeded(doc_id, 4, seed), F.lit(100)) < spm_rate, "spm").otherwise("psm")
    cut = rows.withColumns({"form": form, "units_1": F.least(first, second), "units_2": F.greatest(first, second)})
    cut = cut.withColumns({"end_1": boundary("ends", "units_1"), "end_2": boundary("ends", "units_2")})
    prefix, middle = F.substr(text, F.lit(1), F.col("end_1")), F.substr(text, F.col("end_1") + 1, F.col("end_2") - F.col("end_1"))
    suffix = F.substr(text, F.col("end_2") + 1)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    is_cut = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(is_cut, F.col("end_1")).alias("prefix_chars"),
        F.when(is_cut, F.col("end_2") - F.col("end_1")).alias("middle_chars"),
        output.alias("output"),
    )


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The index of docs (digest, text): digest, text, n (lines), ends (their Elias-Fano list), copies. One row for each
    distinct text, in whose grouping digests are compared first and texts byte by byte."""
    groups = docs.groupBy("digest", "text").agg(F.count("*").alias("copies"))
    return groups.withColumn("list", boundary_list("text")).select("digest", "text", "list.n", "list.ends", "copies")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of docs (columns doc_id, text; others are ignored).

    A text is cut after two seeded numbers of its n lines. `rate` of 100 documents are cut, `spm_rate` of 100 of those put
    the suffix first. Null text is empty; empty texts and texts that contain a mark stay plain, their two lengths null. A
    null doc_id seeds as an empty one; repeated rows give equal rows; an empty table gives none. No bound on copies.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest")))
    repeated = written(keyed.groupBy("digest").count().where("count > 1").select("digest"), "fim-repeated")
    filters, bits = value_filter(repeated, "digest")
    found = (written(filters, "fim-filter"), bits)
    several = where_held(keyed, "digest", found)
    alone = where_held(keyed, "digest", found, "held").where("not held").withColumn("list", boundary_list("text"))
    alone = alone.select("doc_id", "text", "list.n", "list.ends")

    index = written(distinct_texts(several.select("digest", "text")), "fim-index").withColumn("parts", F.ceil(F.col("copies") / COPIES).cast("int"))
    # two texts of one digest (a collision of SHA-256): the documents then bring their text to the join
    keys = ["digest"] if index.groupBy("digest").count().where("count > 1").isEmpty() else ["digest", "text"]
    placed = several.select("doc_id", *keys).join(index.where("parts > 1").select(*keys, "parts"), keys, "left")
    placed = placed.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    joined = placed.join(dealt, [*keys, "part"]).select("doc_id", "text", "n", "ends")
    return _with_cuts(alone, seed, rate, spm_rate).unionByName(_with_cuts(joined, seed, rate, spm_rate))


def op11_fim(docs: DataFrame) -> DataFrame:
    """fill_in_middle with digests for the outputs and for the texts rebuilt from them."""
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
    sha256('7:' || doc_id) as h
  from documents
), s as (
  select doc_id, text, lines, len(lines) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
    ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from s
), p as (
  select *, coalesce(array_to_string(lines[1:a], ''), '') as pre, coalesce(array_to_string(lines[a + 1:b], ''), '') as mid,
    coalesce(array_to_string(lines[b + 1:n], ''), '') as suf
  from c
)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars,
  case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
