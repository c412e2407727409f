"""Language identification by nearest centroid.

A text is a vector of hashed character 2- and 3-grams of its letters, weighted by log frequency and inverse document
frequency and brought to length one. Each language has several centroids, found by spherical k-means over a bounded
sample of its labelled texts, so that varieties of one language don't blur into one mean. The language of the nearest
centroid by cosine wins. A text is rejected where it lies far out: how near a language's texts come to its centroids grows
with their length, so medians and spreads by length are taken of training texts that k-means has not seen, and a
cosine REJECT spreads under the median of its length is too far. (Prose keeps to the upper side of the median; the spread
is that side's, so junk among the training texts doesn't widen it.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import crc_bucket, sliced, small_batches, written

DIMENSIONS = 1 << 13
#: Labelled texts of a language that its centroids and spreads are fitted on, in expectation; every HELD-th is for the spreads.
SAMPLE = 1200
HELD = 4
CENTROIDS = 3
#: Spreads under the median that are too far; the least spread that is believed, and the texts of a length that it takes.
REJECT, LEAST_SPREAD, LEAST_TEXTS = 8.0, 0.03, 8
#: Lengths are binned by the bits of their number of n-grams.
LENGTHS = 48
#: Characters of a text that are counted at a time, and texts whose vectors are compared at a time.
BLOCK, ROWS = 1 << 18, 64


def _not_letters():
    """Patterns of what is no letter: number signs such as a half, which are word characters to `re` (those of two code
    units apart, as `re` looks classes with them up sign by sign), and all else."""
    import re
    import sys

    signs = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    near, far = ("".join(c for c in signs if (c > "\uffff") == high) for high in (False, True))
    return re.compile(f"[{near}]"), re.compile("[\U00010000-\U0010ffff]"), re.compile(f"[{far}]"), re.compile(r"[\W\d_]+")


def _grams(text: str | None, not_letters):
    """Counts of the hashed n-grams of a whole text, or None if it has no letter."""
    import numpy as np

    near, high, far, others = not_letters
    clean = (text or "").lower()
    if not clean.isascii():
        clean = near.sub(" ", clean)
        if high.search(clean):
            clean = far.sub(" ", clean)
    clean = others.sub(" ", clean).strip()
    if not clean:
        return None
    padded, total, shift = f" {clean} ", np.zeros(DIMENSIONS, np.int64), np.uint64(19)
    for at in range(0, len(padded), BLOCK):
        part = padded[max(at - 2, 0) : at + BLOCK]
        code = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        two = code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)
        three = two[:-1] * np.uint64(0xC2B2AE3D) + code[2:] * np.uint64(0x27D4EB2F)
        for grams in (two[1:] if at else two, three):  # the first pair is the last of the block before
            total += np.bincount(((grams & np.uint64(0xFFFFFFFF)) >> shift).astype(np.int64), minlength=DIMENSIONS)
    return total


def _sparse(batches):
    import numpy as np
    import pyarrow as pa

    not_letters = _not_letters()
    for batch in batches:
        for part in sliced(batch, "text"):
            langs, slots, counts = [], [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                got = _grams(text, not_letters)
                if got is not None:
                    at = np.flatnonzero(got)
                    langs.append(lang)
                    slots.append(at.astype(np.int32))
                    counts.append(got[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["lang", "slots", "counts"],
            )


def _kmeans(x, k: int, rounds: int = 12):
    """Spherical k-means of unit rows, started from rows far apart; returns unit centroids."""
    import numpy as np

    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    while len(chosen) < min(k, len(x)):
        nearest = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(nearest)))
    centres = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        members = (own == np.arange(len(centres))[:, None]).astype(np.float32)  # sums by a product: no copies of rows
        new = np.where(members.any(axis=1, keepdims=True), members @ x, centres)
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def floors(cosines, sizes) -> list[float]:
    """The least cosine that is accepted, for each bin of lengths. Bins of too few texts take the next shorter one's."""
    import numpy as np

    bins, out = np.floor(np.log2(np.maximum(sizes, 1))).astype(int), []
    for b in range(LENGTHS):
        own = cosines[bins == b]
        if len(own) >= LEAST_TEXTS:
            middle = float(np.median(own))
            spread = (float(np.quantile(own, 0.9)) - middle) / 1.2816  # of a normal distribution, from its upper side
            out.append(middle - REJECT * max(spread, LEAST_SPREAD))
        else:
            out.append(out[-1] if out else -1.0)
    return out


def _language(idf, centroids: int):
    """The centroids and floors of one language from its sample."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        order = sorted(range(len(pdf)), key=lambda i: (pdf.slots[i].tobytes(), pdf.counts[i].tobytes()))
        order = [i for n, i in enumerate(order) if n % HELD != HELD - 1] + order[HELD - 1 :: HELD]  # the held back come last
        fitted = len(order) - len(order) // HELD
        x = np.zeros((len(order), DIMENSIONS), np.float32)
        for row, i in enumerate(order):
            x[row, pdf.slots[i]] = pdf.counts[i]
        sizes = x.sum(axis=1)
        np.log1p(x, out=x)
        x *= idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]  # in place: no second matrix
        centres = _kmeans(x[:fitted], centroids)
        limits = floors((x[fitted:] @ centres.T).max(axis=1), sizes[fitted:]) if fitted < len(x) else [-1.0] * LENGTHS
        return pd.DataFrame({"lang": [pdf.lang[0]], "centres": [centres.astype(np.float32).ravel()], "floors": [np.array(limits)]})

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> dict | None:
    """A model from rows with text and non-null lang; about `sample` rows of each language are fitted on, chosen by a hash
    of identifier and text, a language a task. Repeated rows count once, so that they can't swell the sample. The
    driver gets centroids alone, about 100 kB a language. None without a usable row."""
    import numpy as np

    labelled = labelled.where("lang is not null").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.element_at(
        F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))]), F.col("lang")
    )
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    found = written(chosen.select("lang", "text").mapInArrow(_sparse, "lang string, slots array<int>, counts array<int>"), "langid-sample")
    rows = found.count()
    if not rows:
        return None
    seen = np.zeros(DIMENSIONS)
    for r in found.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():
        seen[r["slot"]] = r["count"]
    idf = (np.log((1 + rows) / (1 + seen)) + 1).astype(np.float32)
    fitted = found.groupBy("lang").applyInPandas(_language(idf, centroids), "lang string, centres array<float>, floors array<double>").collect()
    names, centres, limits = [], [], []
    for r in sorted(fitted, key=lambda r: r["lang"]):
        got = np.array(r["centres"], np.float32).reshape(-1, DIMENSIONS)
        names += [r["lang"]] * len(got)
        limits += [r["floors"]] * len(got)
        centres.append(got)
    return {"idf": idf, "centres": np.concatenate(centres), "langs": names, "floors": np.array(limits)}


def _predictor(model: dict | None):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        not_letters = _not_letters()
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                for at in range(0, len(texts), ROWS):
                    found = [(i, g) for i, t in enumerate(texts[at : at + ROWS], at) if (g := _grams(t, not_letters)) is not None]
                    if not found or model is None:
                        continue
                    x = np.stack([g for _, g in found]).astype(np.float32)
                    length = np.floor(np.log2(x.sum(axis=1))).astype(int)
                    x = np.log1p(x) * model["idf"]
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    cosine = x @ model["centres"].T
                    for (i, _), j, c, n in zip(found, cosine.argmax(axis=1), cosine.max(axis=1), length):
                        lang[i], score[i] = model["langs"][j], min(max(float(c), 0.0), 1.0)
                        rejected[i] = c < model["floors"][j, n]
                rest = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                    names=[*[c for c in part.schema.names if c != "text"], "lang_pred", "score", "rejected"],
                )

    return run


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs; only its doc_id and text are read.

    lang_pred is a language of the model, or und (rejected, score 0) where text is null or has no letter or there is
    no model; score is the cosine of the nearest centroid. Equal texts get equal rows; an empty table gives none.
    """
    return small_batches(docs.select("doc_id", "text")).mapInArrow(
        _predictor(model), "doc_id long, lang_pred string, score double, rejected boolean"
    )


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(crc_bucket(F.col("doc_id"), 4) != 2)


def op4_langid(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    found = predict(docs, fit(_training(docs)))
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects: no letters, or too far from every centroid. All columns.

    The model is fitted on docs' own labelled rows (docs needs doc_id, text and lang). Null texts and those without a letter go; if no row is
    labelled, all go. Repeated rows and ties are judged alike; an empty table stays empty; other columns may have any names.
    """
    model = fit(_training(docs))

    def run(batches):
        import pyarrow as pa

        judge = _predictor(model)
        for batch in batches:
            for part in sliced(batch, "text"):
                view = pa.RecordBatch.from_arrays([part.column("text")], names=["text"])
                verdicts = [r for got in judge([view]) for r in got.column("rejected").to_pylist()]
                yield part.filter(pa.array([not r for r in verdicts]))

    return small_batches(docs).mapInArrow(run, docs.schema)
