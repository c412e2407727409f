"""Scoring of calls: imputation, boosted trees, calibration, mixture genotypes, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task of the training holds: it reads them again for each tree, as objects of about 250 bytes.
TRAINING_ROWS = 1 << 19


def train_scorer(df: DataFrame, features: Sequence[str], label: str = "label", **params) -> PipelineModel:
    """Median imputation and boosted trees. Raises where a feature has no value at all. The model is saved and read with
    its own write() and PipelineModel.load. All rows train, in as many partitions as they fill: splits of files hold more
    rows the larger the files are."""
    seen = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in features]).first()
    empty = [c for c in features if not seen[c]]
    if empty:
        raise ValueError(f"features without any value: {empty}")
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.001),
        VectorAssembler(inputCols=filled, outputCol="features"),
    ]
    typed = df.withColumns({c: F.col(c).cast("double") for c in features})
    prepared = Pipeline(stages=stages).fit(typed)
    rows, tasks = prepared.transform(typed), -(-seen["_rows"] // TRAINING_ROWS)
    if tasks > 1:
        rows = rows.repartition(tasks)
    trees = GBTClassifier(labelCol=label, featuresCol="features", **({"maxIter": 10, "seed": 1} | params)).fit(rows)
    return PipelineModel(stages=[*prepared.stages, trees])


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with score, the probability of class 1. Raises where features are not those of the model."""
    trained = model.stages[0].getInputCols()
    if list(features) != trained:
        raise ValueError(f"the model was trained on {trained}")
    out = model.transform(df.withColumns({c: F.col(c).cast("double") for c in features}))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")


def calibration_table(calibration: DataFrame) -> DataFrame:
    """score, sensitivity: the share of the held-out positives (label 1) that score as high or higher. The window runs over
    distinct scores in blocks of a thousandth, so no task holds them all."""
    from varspan.operators.scan import running_sum

    counts = calibration.where("label = 1").groupBy("score").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    total = counts.agg(F.sum("n")).first()[0] or 1
    ranked = counts.withColumn("_down", 1.0 - F.col("score"))
    out = running_sum(ranked, ["_all"], "_down", [], F.col("n"), "_seen", block=0.001)
    return out.select("score", (F.col("_seen") / total).alias("sensitivity"))


def add_sensitivity(scored: DataFrame, table: DataFrame, bins: int = 1000) -> DataFrame:
    """sensitivity of each score, by the table's least value in its bin of scores or, if empty, the next higher one."""
    by_bin = table.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.max("sensitivity").alias("s"))
    grid = table.sparkSession.range(bins).select(F.col("id").alias("bin")).join(by_bin, "bin", "left")
    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over the fixed number of bins
    filled = grid.select("bin", F.coalesce(F.max("s").over(up), F.lit(0.0)).alias("sensitivity"))
    return scored.withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))).join(F.broadcast(filled), "bin", "left").drop("bin")


def _mixture_sums(mu: list[float], nu: list[float], pi: list[float]):
    """What a round of the mixture needs of the counts (d, a, n): for each class the sums of its share of n, and of that
    times depth, alternative depth, their ratio, the ratio's square and the inverse depth."""

    def run(frames):
        from math import lgamma

        import numpy as np
        import pandas as pd

        lg = np.vectorize(lgamma, otypes=[float])
        for f in frames:
            if f.empty:
                continue
            d, a, n = (f[k].to_numpy(dtype=float) for k in ("d", "a", "n"))
            choose, share = lg(d + 1) - lg(a + 1) - lg(d - a + 1), a / d
            logp = np.empty((len(d), 4))
            for k in range(3):
                x, y = mu[k] * nu[k], (1 - mu[k]) * nu[k]
                logp[:, k] = choose + lg(a + x) + lg(d - a + y) - lg(d + x + y) + lgamma(x + y) - lgamma(x) - lgamma(y)
            logp[:, 3] = -np.log(d + 1)  # outliers: any alternative depth alike
            logp += np.log(np.maximum(pi, 1e-12))
            post = np.exp(logp - logp.max(axis=1, keepdims=True))
            post *= (n / post.sum(axis=1))[:, None]
            terms = np.stack([np.ones(len(d)), d, a, share, share**2, 1 / d])
            yield pd.DataFrame([(k, *map(float, terms @ post[:, k])) for k in range(4)], columns=["k", "w", "wd", "wa", "ws", "wss", "wi"])

    return run


def mixture_genotypes(cells: DataFrame, rounds: int = 60) -> dict[str, list[float]]:
    """Weights, means and concentrations of three beta-binomial classes (0, 1, 2 copies) and an outlier weight, by
    expectation-maximisation over the exact counts of (depth, alternative depth). The counts stay a table; each round
    brings four rows of sums to the driver. cells: ad_ref, ad_alt."""
    import numpy as np

    from varspan.shared import written

    depth = (F.col("ad_ref") + F.col("ad_alt")).alias("d")
    counts = written(cells.where("ad_ref + ad_alt > 0").groupBy(depth, F.col("ad_alt").alias("a")).agg(F.count("*").alias("n")), "mixture-counts")
    columns = ("w", "wd", "wa", "ws", "wss", "wi")
    mu, nu, pi = np.array([0.03, 0.5, 0.97]), np.array([30.0, 30.0, 30.0]), np.array([0.3, 0.3, 0.3, 0.1])
    for _ in range(rounds):
        sums = counts.mapInPandas(_mixture_sums(mu.tolist(), nu.tolist(), pi.tolist()), "k int, " + ", ".join(f"{c} double" for c in columns))
        found = {r["k"]: [r[c] for c in columns] for r in sums.groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]).collect()}
        pi = np.array([found[k][0] for k in range(4)]) / sum(found[k][0] for k in range(4))
        for k in range(3):
            w, wd, wa, ws, wss, wi = found[k]
            if w > 1e-6:
                mu[k] = np.clip(wa / wd, 0.001, 0.999)
                var = (wss - 2 * mu[k] * ws + mu[k] ** 2 * w) / w
                base = mu[k] * (1 - mu[k])
                nu[k] = np.clip((base - var) / max(var - base * wi / w, 1e-6), 2.0, 1e4)
    return {"weights": pi.tolist(), "means": mu.tolist(), "concentrations": nu.tolist()}


def hash_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows whose key hashes below share: the same rows each time, a key's rows together."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def class_sample(df: DataFrame, label: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows of each class, those of least hash: a feature of the operator, not a cap. Rows far above the size's
    quantile are cut off before ranking, so the window holds a few times size rows a class."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40))
    pairs = [F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * size / n + 0.01))]
    near = hashed.where(F.col("_h") < F.element_at(F.create_map(*pairs), F.col(label))) if counts else hashed
    w = Window.partitionBy(label).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_h", "_r")
