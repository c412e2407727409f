"""Quality by hierarchical empirical Bayes.

A logistic model of a document's surface gives its own evidence. Hosts and paths get posteriors: a host's mean
evidence is shrunk towards the global mean, a path's towards its host's posterior, each by a strength estimated from
how much means differ between sites over and above chance. So a host or path with few documents follows its prior,
one with many its own record. A document's quality adds the log-odds of its path (its own part left out) to its own.

All site statistics are grouped sums over the whole table, pre-aggregated in the map tasks; three joins of counts
by site follow, of columns without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import sliced, written

#: Labelled rows of each class that the document model is fitted on, in expectation.
SAMPLE = 10_000
FEATURES = ("log_words", "mean_length", "symbols", "bars", "bangs", "upper", "repeats", "distinct", "top_word", "same_lines")


def _surface(text: str | None, word) -> list[float]:
    import math
    from collections import Counter

    words = word.findall(text or "")
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, words))
    return [
        math.log1p(n),
        min(chars / n, 40.0),
        sum(map(text.count, "#*$%&<>")) / n,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(str.isupper, words)) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(counts) / n**0.8,
        counts.most_common(1)[0][1] / n,
        1 - len(set(lines)) / len(lines) + (1 - letters / n) * 0.1,
    ]


def _featurize(columns: list[str]):
    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = [_surface(t, word) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "features"]
                )

    return run


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(clipped / (1 - clipped))


def _strength(sites: DataFrame, mean: Column) -> float:
    """How many documents the prior is worth: by moments, from sums over sites (n, s: documents and summed evidence)."""
    r = sites.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("within"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    spread, noise = r["between"] / r["n"], r["within"] / r["n"]
    excess = spread - noise * r["k"] / r["n"]  # what chance alone would give: one document's variance a site
    return float(min(max(noise / excess - 1 if excess > 1e-9 else 1e4, 2.0), 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, evidence, host_quality, path_quality, quality, keep for every row of docs.

    labels: doc_id, quality (1 good, 0 bad); about SAMPLE of each class fit the document model, each for as many labels
    as it stands for (fixed weights if a class is missing). host and path are expressions over docs; null sites are a site each. Null and empty texts
    count as bad evidence; repeated rows get equal results; an empty table gives none; other columns are ignored.
    """
    import numpy as np

    from varspan.llm.toxicity import fit_logistic

    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    table = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text"
    ).mapInArrow(_featurize(["doc_id", "host", "path"]), "doc_id long, host string, path string, features array<double>")
    table = written(table, "quality-features")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = {c: min(1.0, SAMPLE / max(n.get(c, 0), 1)) for c in (0, 1)}
    share = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    # about 2 * SAMPLE pairs of numbers, however many labels there are: small enough to broadcast
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = table.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("features").alias("features"), F.first("label").alias("label")).collect()
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y.tolist())) == 2:
        counts = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        weights = [float(a) for a in fit_logistic(np.array([r["features"] for r in rows]), y, counts=counts)]
    else:
        weights = [0.0, 0.0, -8.0, -8.0, -8.0, -4.0, -8.0, 0.0, -4.0, -2.0, 2.0]
    own = sum((F.get("features", F.lit(i)) * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    empty = F.get("features", F.lit(0)) == 0
    scored = table.select("doc_id", "host", "path", F.when(empty, F.lit(-4.0)).otherwise(F.least(F.greatest(own, F.lit(-8.0)), F.lit(8.0))).alias("own"))
    scored = scored.withColumn("evidence", 1 / (1 + F.exp(-F.col("own"))))

    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "quality-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((total["s"] or 0.0) / (total["n"] or 1), 1e-3), 1 - 1e-3)
    k_host = _strength(hosts, F.lit(mean))
    hosts = written(
        hosts.select(F.col("host").alias("site"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_quality")),
        "quality-hosts",
    )
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["site"])).drop("site")
    k_path = _strength(paths, F.col("host_quality"))
    paths = written(
        paths.select(F.col("host").alias("site"), F.col("path").alias("page"), F.col("n").alias("site_n"), F.col("s").alias("site_s"), "host_quality"),
        "quality-paths",
    )
    at = scored["host"].eqNullSafe(paths["site"]) & scored["path"].eqNullSafe(paths["page"])
    rest = (F.col("site_s") - F.col("evidence") + k_path * F.col("host_quality")) / (F.col("site_n") - 1 + k_path)
    quality = 1 / (1 + F.exp(-(F.col("own") + logit(rest) - logit(F.lit(mean)))))
    return scored.join(paths, at).select(
        "doc_id",
        "host",
        "path",
        "evidence",
        "host_quality",
        ((F.col("site_s") + k_path * F.col("host_quality")) / (F.col("site_n") + k_path)).alias("path_quality"),
        quality.alias("quality"),
        (quality >= 0.5).alias("keep"),
    )


def host_of(url: Column) -> Column:
    """The host of a web address, lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    """The first folder of a web address's path ('' at the root)."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/([^/?#]*)/)?", 1)


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents have no address: source stands for the host, source and language for the path."""
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
