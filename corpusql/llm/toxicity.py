"""Toxic passages by maximum-scoring segments.

Learning: on a bounded sample of labelled texts, each word counts as itself and as its longer
prefixes (stems), once for each text that has it. A feature's weight is the difference of its log-odds in toxic and other
texts under a Dirichlet prior in proportion to its overall use, and only features whose
difference stands out of its standard error are kept (the model is at most ``FEATURES``
large). A word has the weight of its most telling feature; words without one pull down by
``DRIFT``.

Scoring: one pass over a text's word weights finds all its maximal-scoring segments. For
segments of random clean text, the chance of a score S among n words follows an extreme-value
law with expected count K n exp(-lambda S); lambda comes from the clean words' weights and K
from the clean texts' best segments. A text's evidence is the sum of -ln(expected count) over
its segments that are rarer than one by chance, and a one-dimensional logistic curve turns
evidence into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import fold, written

#: Bounds of the model: labelled rows it is fitted on, and features it keeps.
SAMPLE_ROWS = 20_000
FEATURES = 20_000
#: Weight of the prior, as a share of what the smaller class counts.
PRIOR = 0.5
SIGNIFICANCE = 4.0
DRIFT = -0.15
STEMS = (5, 6, 7, 8)
CACHE_WORDS = 200_000
PUNCTUATION = ".,;:!?*#$%&|<>()[]{}'\"-_=+/\\~`"


def features(word: str) -> list[str]:
    """The bare word in small letters, and its prefixes that are shorter than it."""
    bare = word.strip(PUNCTUATION).lower()
    return ["=" + bare, *(bare[:n] for n in STEMS if n < len(bare))] if bare else []


@dataclass
class Model:
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)  # weight, z
    decay: float = 1.0  # lambda
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -20.0

    def word(self, word: str) -> float:
        known = [self.weights[f] for f in features(word) if f in self.weights]
        return max(known, key=lambda x: abs(x[1]))[0] if known else DRIFT


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, float] = {}

    def weights(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), "f8", len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.model.word(w)
            return np.fromiter(map(known.__getitem__, words), "f8", len(words))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages: first word, word after the last, -ln(expected count)."""
        weights = self.weights(text)
        n = max(1, len(weights))
        found = []
        for start, end, score in segments(weights):
            evidence = self.model.decay * score - self.model.log_k - np.log(n)
            if evidence > 0:
                found.append((start, end, float(evidence)))
        return found

    def evidence(self, text: str) -> float:
        return sum(e for _, _, e in self.passages(text))

    def probability(self, evidence: float) -> float:
        x = self.model.slope * evidence + self.model.intercept
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, in linear time: (start, end, score).

    Runs of one sign act as one item. Candidates are kept with the sums left and right of
    them; a new one either stands alone, or joins back to the candidate whose left sum is
    smaller, as long as the right sum grows.
    """
    if not len(weights) or weights.max() <= 0:
        return []
    positive = weights > 0
    edges = np.flatnonzero(positive[1:] != positive[:-1]) + 1
    starts = np.concatenate([[0], edges])
    sums = np.add.reduceat(weights, starts)
    ends = np.concatenate([edges, [len(weights)]])
    total, kept = 0.0, []
    for start, end, value in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if not positive[start]:
            total += value
            continue
        left, total = total, total + value
        candidate = [start, end, left, total]
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= candidate[2]:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= candidate[3]:
                kept.append([*candidate, at])
                break
            candidate = [kept[at][0], candidate[1], kept[at][2], candidate[3]]
            del kept[at:]
    return [(s, e, right - left) for s, e, left, right, _ in kept]


def _decay(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of: mean of exp(root * weight) = 1."""
    if not (values > 0).any() or values @ counts >= 0:
        return 1.0
    share = counts / counts.sum()
    low, high = 0.0, 1.0
    while share @ np.exp(np.minimum(high * values, 500)) < 1 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * values, 500)) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a little damping."""
    scale = max(1.0, float(x.max()))
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0] / scale)), float(beta[1])


def fitted(labelled: DataFrame) -> Model:
    """A model from ``text`` and ``toxic`` (0/1) of at most a few ten thousand rows.

    The caller bounds the rows. Counts of features are folded in tasks and by Spark; to the
    driver come the features kept, the clean words' weights as a histogram, and one best
    score and evidence for each row of the sample.
    """
    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Model(intercept=20.0 if totals.get(1) else -20.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set((text.as_py() or "").split())
                counts[toxic].update({f for word in words for f in features(word)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()),
             pa.array([counts[1][f] for f in names], pa.int64())],
            ["feature", "clean", "toxic"],
        )

    folded = written(
        labelled.select("text", F.col("toxic").cast("int")).mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "features",
    )
    sums = folded.where(F.col("feature").startswith("=")).agg(
        F.sum("clean").alias("c"), F.sum("toxic").alias("t")
    ).first()
    all_clean, all_toxic = float(sums["c"] or 0), float(sums["t"] or 0)
    if not all_clean or not all_toxic:
        return Model()
    mass = PRIOR * min(all_clean, all_toxic)
    prior = F.lit(mass) * (F.col("clean") + F.col("toxic")) / (all_clean + all_toxic)
    odds = lambda n, total: F.log((n + F.col("prior")) / (total + mass - n - F.col("prior")))
    kept = (
        folded.withColumn("prior", prior)
        .withColumn("weight", odds(F.col("toxic"), all_toxic) - odds(F.col("clean"), all_clean))
        .withColumn(
            "z",
            F.col("weight") / F.sqrt(1 / (F.col("toxic") + F.col("prior")) + 1 / (F.col("clean") + F.col("prior"))),
        )
        .where((F.abs("z") >= SIGNIFICANCE) & (F.col("clean") + F.col("toxic") >= 5))
        .orderBy(F.desc(F.abs("z")), "feature").limit(FEATURES).collect()
    )
    model = Model({r["feature"]: (r["weight"], r["z"]) for r in kept})

    @F.pandas_udf("best double, words long, sums map<double,long>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in texts:
            rows = []
            for text in batch:
                weights = scorer.weights(text or "")
                best = max([s for _, _, s in segments(weights)], default=0.0)
                values, n = np.unique(np.round(weights, 3), return_counts=True)
                rows.append((best, len(weights), dict(zip(values.tolist(), n.tolist()))))
            yield pd.DataFrame(rows, columns=["best", "words", "sums"])

    measured = labelled.where("toxic = 0").select(measure("text").alias("m")).select("m.*").persist()
    histogram = (
        measured.select(F.explode("sums").alias("w", "n")).groupBy("w").agg(F.sum("n").alias("n")).collect()
    )
    bests = measured.where("best > 0").select("best", "words").collect()
    measured.unpersist()
    model.decay = _decay(np.array([r["w"] for r in histogram]), np.array([r["n"] for r in histogram], float))
    if bests:
        # The mean of an extreme value lies Euler's constant above its place.
        model.log_k = float(np.mean([model.decay * r["best"] - np.log(r["words"]) for r in bests])) - 0.5772156649

    @F.pandas_udf("double")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.Series([scorer.evidence(t or "") for t in batch])

    pairs = labelled.select(weigh("text").alias("x"), "toxic").collect()
    model.slope, model.intercept = _logistic(
        np.array([r["x"] for r in pairs]), np.array([r["toxic"] for r in pairs], float)
    )
    return model


def learning_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents, each text once.

    Rows with fold 0 (crc32 of the id modulo 5) are left out, and so are rows without a text
    or a label. Which rows are taken follows a hash of the id, so it does not depend on order.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 5 != 0))
        .select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    own = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), "text")
    return (
        own.join(F.broadcast(chosen), "_id")  # at most ``rows`` pairs of numbers
        .groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("_toxic").alias("toxic"))
        .select("text", "toxic")
    )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` and ``passages``, from ``text`` alone.

    ``passages`` are the significant ones: first word, word after the last, evidence. Null
    and empty texts have no evidence. Columns of these names are replaced.
    """
    kind = "score double, predicted int, passages array<struct<first:int,past:int,evidence:double>>"

    @F.pandas_udf(kind)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in texts:
            rows = []
            for text in batch:
                found = scorer.passages(text or "")
                p = scorer.probability(sum(e for _, _, e in found))
                rows.append((p, int(p >= 0.5), [dict(first=a, past=b, evidence=e) for a, b, e in found]))
            yield pd.DataFrame(rows, columns=["score", "predicted", "passages"])

    made = docs.withColumn("_found", score("text"))
    for name in ("score", "predicted", "passages"):
        made = made.withColumn(name, F.col(f"_found.{name}"))
    return made.drop("_found")


def toxicity_digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; learned from rows not held out."""
    model = fitted(written(learning_rows(docs, labels), "learning"))
    held = F.coalesce(fold(F.col("doc_id")) % 5 == 0, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "score", "predicted"
    )
