"""Toxicity by a weighted finite-state grammar.

Words map to classes: insult, threat, target, copula, intent, negation, report, other. Insults are learned from labelled
rows as whole words and word beginnings that mark toxic documents (log-odds over a bounded sample), besides short seed
lists in four languages for words no sample has. The grammar is composed of small transducers over the classes of a
clause. Target, copula, intent, negation and report transducers remember what was read; their products, one read
from left to right and one from right to left, tell what stands before and after each word. The insult and threat
transducers are composed with both: an insult is worth its weight, more when it is aimed ("you are an ...", "..., you"),
a threat counts where its verb has a target after it, or a target and an intent before it ("you will be ..."). A match
that is negated or reported, on either side, is worth less and is summed apart.

A document's clause scores are summed up in five numbers, which a logistic model, fitted on the same sample, turns
into a probability.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspan.llm.common import crc_bucket, sliced, written

#: Labelled rows of each class that the lexicon and the model are fitted on, in expectation.
SAMPLE = 6000
#: A learned entry needs this share of the toxic sample, this many rows and these log-odds.
LEAST_SHARE, LEAST_ROWS, LEAST_ODDS = 0.002, 3, 2.0
STEMS = (4, 5, 6, 7)

OTHER, INSULT, THREAT, TARGET, COPULA, INTENT, NEGATION, REPORT, BREAK = range(9)
#: Seed words of each class: English, German, French, Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum loser losers pathetic worthless trash clown disgusting dumb imbecile "
    "vermin filth garbage scumbag bastard jerk fool fools ugly retard cretin "
    "dummkopf idioten trottel arschloch abschaum schwachkopf widerlich erbärmlich "
    "imbécile crétin ordure connard salaud débile abruti pathétique "
    "idiota idiotas imbécil estúpido estúpida escoria patético patética asqueroso asquerosa",
    THREAT: "kill kills killed killing hurt hurts hurting destroy destroyed murder murdered stab stabbed shoot strangle "
    "strangled beat beaten smash smashed töten umbringen erschießen erstechen schlagen tuer frapper étrangler "
    "poignarder matar matarte golpear apuñalar",
    TARGET: "you your youre yourself u ya he she they him her hers them his their theyre hes shes everyone all "
    "dich dir euch ihn ihnen ihr du sie toi vous lui eux elle ils elles tu te usted ustedes ellos ellas él",
    COPULA: "are is am was were be being been re such an a bist ist seid sind es êtes est sont eres son",
    INTENT: "will ll going gonna shall must should want wants would werde werden wirst will muss vais va allons vont voy "
    "va vamos van",
    NEGATION: "not never no isnt arent wasnt werent dont doesnt wont cant nobody neither nor without nicht kein keine nie "
    "pas jamais aucun nunca ningún ninguna",
    REPORT: "said says saying called calls calling claimed claims wrote writes quoted quote term word insult phrase "
    "reported yelled shouted tweeted sagte nannte schrieb wort dit appelé écrit mot dijo llamó escribió palabra",
}
#: A word of several classes (or languages) is of the first one here.
SEED_CLASS = {w: c for c in sorted(SEEDS, reverse=True) for w in SEEDS[c].split()}
SEED_WEIGHT = 3.0

#: How long a class stays in force, in words: before a match, and after it.
BEFORE = {TARGET: 4, COPULA: 3, INTENT: 4, NEGATION: 3, REPORT: 4}
AFTER = {TARGET: 3, NEGATION: 2, REPORT: 3}

State = tuple[int, ...]


def memory(kind: int, reach: int) -> dict[tuple[int, int], int]:
    """A transducer that counts down the words since its kind was read: (state, class) -> state; a break resets it."""
    return {
        (s, c): reach if c == kind else 0 if c == BREAK else max(s - 1, 0) for s in range(reach + 1) for c in range(BREAK + 1)
    }


def parallel(reaches: dict[int, int]) -> tuple[dict[tuple[int, int], int], list[State]]:
    """The product of a memory for each kind: next state by (state, class), and each state's memories in the order of kinds."""
    tables = [memory(kind, reach) for kind, reach in reaches.items()]
    states = list(product(*[range(r + 1) for r in reaches.values()]))
    number = {s: i for i, s in enumerate(states)}
    go = {(number[s], c): number[tuple(t[x, c] for t, x in zip(tables, s))] for s in states for c in range(BREAK + 1)}
    return go, states


def insult(before: dict[int, bool], after: dict[int, bool]) -> float | None:
    """The factor of an insult: half as much again where it is said of a target, a quarter more where one is near."""
    if before[TARGET] and before[COPULA]:
        return 1.5
    return 1.25 if before[TARGET] or after[TARGET] else 1.0


def threat(before: dict[int, bool], after: dict[int, bool]) -> float | None:
    """A verb of harm with its target, stronger with an intent; without a target it is no threat."""
    if after[TARGET]:
        return 1.0 if before[INTENT] else 0.6
    return 1.0 if before[TARGET] and before[INTENT] else None


ASSERTED, DISCOUNTED, THREATENED = range(3)


def compose():
    """(left, right, emit): the left-to-right and right-to-left products, and (factor, sum) of each match by (left state,
    right state, class), with negation and report composed in. Matches that emit nothing are left out."""
    left, left_states = parallel(BEFORE)
    right, right_states = parallel(AFTER)
    emit = {}
    for (i, ls), (j, rs) in product(enumerate(left_states), enumerate(right_states)):
        before = {k: x > 0 for k, x in zip(BEFORE, ls)}
        after = {k: x > 0 for k, x in zip(AFTER, rs)}
        denied, told = before[NEGATION] or after[NEGATION], before[REPORT] or after[REPORT]
        scale = (0.3 if denied else 1.0) * (0.5 if told else 1.0)
        for c, match, kind in ((INSULT, insult, ASSERTED), (THREAT, threat, THREATENED)):
            if (factor := match(before, after)) is not None:
                emit[i, j, c] = (factor * scale, DISCOUNTED if denied or told else kind)
    return left, right, emit


def _words():
    import re

    return re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]+")


def _learn(batches):
    """Documents with each word and word beginning, by label, counted within a task's batch."""
    from collections import Counter

    import pyarrow as pa

    find = _words().findall
    for batch in batches:
        for part in sliced(batch, "text"):
            counts = (Counter(), Counter())
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = {w for w in find((text or "").lower()) if w[0].isalpha()}
                counts[toxic].update(words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k})
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
                names=["term", "pos", "neg"],
            )


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Term (a word, or a beginning and '*') to weight. sample: text, toxic (0 or 1)."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos_rows, neg_rows = n.get(1, 0), n.get(0, 0)
    counts = sample.mapInArrow(_learn, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos_rows + 1.0)) - F.log((F.col("neg") + 0.5) / (neg_rows + 1.0))
    enough = F.col("pos") >= max(LEAST_ROWS, LEAST_SHARE * pos_rows)
    # each entry is in LEAST_SHARE of the toxic sample's texts, so the sample bounds how many there are
    rows = counts.withColumn("odds", odds).where((enough & (F.col("odds") >= LEAST_ODDS)) | F.col("term").isin(list(SEED_CLASS))).collect()
    return {r["term"]: float(r["odds"]) for r in rows}


class Classes(dict):
    """Word to (class, weight), found on first use: exact word, longest learned beginning, seed, else other."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__({w: (BREAK, 0.0) for w in ".!?;:\n"})
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 300_000:
            self.clear()
        if not word[0].isalpha():
            got = (BREAK, 0.0)
        else:
            plain = word.replace("'", "").replace("’", "")
            seed, weight = SEED_CLASS.get(plain), self.lexicon.get(word)
            if weight is None:
                weight = next((self.lexicon[s] for k in reversed(STEMS) if len(word) >= k and (s := f"{word[:k]}*") in self.lexicon), None)
            if seed is not None and seed not in (INSULT, THREAT):
                got = (seed, 0.0)
            elif weight is not None:
                got = (THREAT if seed == THREAT else INSULT, weight) if weight > 0 else (OTHER, 0.0)
            else:
                got = (seed, SEED_WEIGHT) if seed is not None else (OTHER, 0.0)
        self[word] = got
        return got


FEATURES = 5


def scorer(lexicon: dict[str, float]):
    """text -> (asserted, negated or reported, threats, best clause, matches per 100 words), each damped by log1p."""
    classes, find = Classes(lexicon), _words().findall
    left, right, emit = compose()
    hits = (INSULT, THREAT)

    def clause(read: list[tuple[int, float]], sums: list[float]) -> tuple[float, int]:
        """Adds a clause's matches to sums; its score and how many matches it has."""
        after, state = [0] * len(read), 0
        for i in range(len(read) - 1, -1, -1):
            after[i] = state
            state = right[state, read[i][0]]
        total, n, state = 0.0, 0, 0
        for (c, weight), r in zip(read, after):
            if c in hits and (got := emit.get((state, r, c))) is not None:
                sums[got[1]] += weight * got[0]
                total += weight * got[0]
                n += 1
            state = left[state, c]
        return total, n

    def features(text: str | None) -> list[float]:
        words = find((text or "").lower())
        read = [classes[w] for w in words]
        at = [i for i, (c, _) in enumerate(read) if c in hits]
        if not at:
            return [0.0] * FEATURES
        sums, best, n, done = [0.0, 0.0, 0.0], 0.0, 0, 0
        for i in at:
            if i < done:  # in a clause that has been scored
                continue
            start, done = i, i
            while start > 0 and read[start - 1][0] != BREAK:
                start -= 1
            while done < len(read) and read[done][0] != BREAK:
                done += 1
            score, matches = clause(read[start:done], sums)
            best, n = max(best, score), n + matches
        return [math.log1p(x) for x in (*sums, best, 100.0 * n / len(words))]

    return features


def _featurize(lexicon: dict[str, float], columns: list[str]):
    def run(batches):
        import pyarrow as pa

        features = scorer(lexicon)
        for batch in batches:
            for part in sliced(batch, "text"):
                rows = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "features"]
                )

    return run


def fit_logistic(x, y, ridge: float = 1.0, rounds: int = 25, counts=None):
    """Weights and intercept (last) by Newton steps with a ridge penalty; scaled inside, so features may be of any size.
    counts: how many rows of the table each row stands for (none: one)."""
    import numpy as np

    counts = np.ones(len(x)) if counts is None else counts
    scale = np.sqrt(np.average((x - np.average(x, axis=0, weights=counts)) ** 2, axis=0, weights=counts))
    scale[scale < 1e-9] = 1.0  # a constant feature
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (counts * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1])


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> DataFrame:
    """text, toxic, rows: about `size` labelled rows of each class, chosen by a hash, and how many labelled rows each stands
    for; of repeated identifiers one row counts, so that they can't swell the sample. labels is small beside the texts."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, size / max(n.get(1, 0), 1))).otherwise(min(1.0, size / max(n.get(0, 0), 1)))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # the broadcast holds about 2 * size pairs of numbers, however many labels there are
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return written(rows.select("text", "toxic", (1 / share).alias("rows")), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Lexicon and logistic weights, at the labels' own class shares whatever the sample's are. Without both classes in
    the sample: seeds alone and fixed weights."""
    import numpy as np

    sample = labelled_sample(docs, labels, usable, size)
    lexicon = learn_lexicon(sample)
    rows = sample.mapInArrow(_featurize(lexicon, ["toxic", "rows"]), "toxic int, rows double, features array<double>").collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return lexicon, [1.0, 0.2, 1.0, 0.5, 0.2, -3.0]
    x = np.array([r["features"] for r in rows])
    return lexicon, [float(v) for v in fit_logistic(x, y, counts=np.array([r["rows"] for r in rows]))]


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]]) -> DataFrame:
    """doc_id, score for every row of docs (doc_id, text; others are ignored); null and empty texts score as no match."""
    lexicon, weights = model
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _featurize(lexicon, ["doc_id"]), "doc_id long, features array<double>"
    )
    logit = sum((F.get("features", F.lit(i)) * w for i, w in enumerate(weights[:-1])), F.lit(weights[-1]))
    return found.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Repeated rows and ties score alike; an empty table of documents gives none; labels may be empty."""
    model = fit(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
