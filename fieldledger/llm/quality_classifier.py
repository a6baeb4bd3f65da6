"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts; the unlabelled set is a sample of all web text, whatever
its labels; labelled bad texts are never used.  The class prior is estimated from those two sets: above
any cutoff the unlabelled set holds at least the prior's share of what the positives have there, so the
least ratio over cutoffs bounds it from above, closely where the scorer parts the classes.  With the
prior p, the negatives' risk is what the unlabelled set has above p times the positives'; the
non-negative estimator holds that part at zero from below and takes the step that mends it when a fit
has pushed it under.  Scores are calibrated and the threshold is set by the same two sets' risk.
The scorer is linear in features of form: frequencies of pairs of character classes, and a few of
words and lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.base import add_columns, held_out, read_table
from fieldledger.llm.toxicity import training_ids

#: The training sample: rows at most; texts of any length, whole.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 6000
#: Shares of the positives that stand above the cutoffs at which the prior is bounded.
CUTOFFS = (0.99, 0.98, 0.95, 0.9, 0.85, 0.8)
FIRST_PRIOR, ROUNDS = 0.5, 3
STEPS, RATE, GAMMA, RIDGE = 400, 0.03, 1.0, 1e-3
THRESHOLD = 0.7
CLASSES = 20


def class_table() -> np.ndarray:
    """A byte's class: letters by case, digits, blank, line end, frequent signs each on their own, the rest."""
    table = np.full(256, 19, np.uint8)
    table[128:] = 0  # parts of letters beyond ASCII
    for first, last, k in ((97, 122, 0), (65, 90, 1), (48, 57, 2)):
        table[first : last + 1] = k
    for k, sign in enumerate(b" \n.,!|*#$%&<>:-=", start=3):
        table[sign] = k
    return table


TABLE = class_table()
N_FEATURES = CLASSES * CLASSES + 6


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8")
    out = np.zeros(N_FEATURES, np.float32)
    if len(data) > 1:
        kinds = TABLE[np.frombuffer(data, np.uint8)].astype(np.int16)
        pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(data) - 1))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(1, len(words))
    distinct = set(words)
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    out[-6:] = (
        len(distinct) / n,
        len(set(lines)) / max(1, len(lines)),
        doubled / n,
        min(20.0, sum(map(len, words)) / n) / 10,
        np.log1p(len(words)) / 10,
        min(1.0, n / 50),
    )
    return out


def with_features(docs: DataFrame) -> DataFrame:
    return add_columns(docs, ["text"], "features binary", lambda: lambda texts: [[features(t).tobytes() for t in texts]], drop=("text",))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...] = ()  # over raw features and a constant; empty: nothing to learn from
    constant: float = FIRST_PRIOR  # the prior


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights (the constant last) that minimise the non-negative unbiased risk with the sigmoid loss, by Adam."""
    xp, xu = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w, m, v = np.zeros(xp.shape[1]), np.zeros(xp.shape[1]), np.zeros(xp.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        sp, su = sigmoid(xp @ w), sigmoid(xu @ w)
        # loss of calling x positive is sigmoid(-z), of calling it negative sigmoid(z)
        slope_p, slope_u = xp.T @ (sp * (1 - sp)) / len(xp), xu.T @ (su * (1 - su)) / len(xu)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            grad = -prior * slope_p + slope_u - prior * slope_p
        else:
            grad = -GAMMA * (slope_u - prior * slope_p)
        grad = grad + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from both sets' scores."""
    cutoffs = np.quantile(positive, [1 - c for c in CUTOFFS])
    ratios = [(unlabelled >= t).mean() / (positive >= t).mean() for t in cutoffs]
    return float(min(max(min(ratios), 0.01), 0.99))


def calibration(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """(a, b) of the logit a + b * score: least unbiased logistic risk, -prior * E_P[logit] + E_U[log(1 + exp(logit))]."""
    x, w = np.column_stack([np.ones(len(unlabelled)), unlabelled]), np.zeros(2)
    pull = prior * np.array([1.0, positive.mean()])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + 1e-4 * np.eye(2), pull - x.T @ p / len(x) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def best_cutoff(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The score above which calling rows good has the least estimated error: missed positives and called negatives."""
    values = np.unique(np.concatenate([positive, unlabelled]))
    cutoffs = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    above = lambda x: 1 - np.searchsorted(np.sort(x), cutoffs) / len(x)
    p, u = above(positive), above(unlabelled)
    return float(cutoffs[np.argmin(prior * (1 - p) + np.maximum(0, u - prior * p))])


def train(positive: np.ndarray, unlabelled: np.ndarray, threshold: float = THRESHOLD) -> Model:
    """Without positives or unlabelled rows the model scores everything with FIRST_PRIOR."""
    if not len(positive) or not len(unlabelled):
        return Model((), FIRST_PRIOR)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    xp, xu, prior = (positive - mean) / scale, (unlabelled - mean) / scale, FIRST_PRIOR
    for _ in range(ROUNDS):
        w = non_negative_risk(xp, xu, prior)
        zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        prior = estimated_prior(zp, zu)
    _, b = calibration(zp, zu, prior)
    slope = max(b, 1e-3)  # scores keep their order
    raw = slope * np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    raw[-1] += np.log(threshold / (1 - threshold)) - slope * best_cutoff(zp, zu, prior)
    return Model(tuple(raw.tolist()), prior)


def sampled_features(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """y, features of the rows of ``docs`` whose ids are in ``ids`` (a bounded table), ``most`` of them by the ids' hash.

    Features are computed where the texts lie; only they move.
    """
    rows = with_features(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(most).select("y", "features")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Rows that reach the driver are bounded: MAX_POSITIVE + MAX_UNLABELLED feature vectors."""
    good = training_ids(labels, "quality", {1: MAX_POSITIVE})
    web = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    web = web.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(MAX_UNLABELLED).withColumn("y", F.lit(-1))
    rows = [sampled_features(docs, ids, most).toPandas() for ids, most in ((good, MAX_POSITIVE), (web, MAX_UNLABELLED))]
    return train(*[np.frombuffer(b"".join(r["features"]), np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to ``docs`` and leaves the text out.  Null and empty texts have features too."""

    def make():
        def rows(texts):
            if not model.weights:
                p = np.full(len(texts), model.constant)
            else:
                w = np.array(model.weights)
                p = sigmoid(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES) @ w[:-1] + w[-1])
            return [p.tolist(), (p >= threshold).astype(int).tolist()]

        return rows

    return add_columns(docs, ["text"], "score double, predicted int", make, drop=("text",))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; its other columns are left out.

    Equal texts have equal scores, so repeated rows and ties keep theirs; null and empty texts have
    features too; texts of any length are read whole; an id with several labels counts with the largest;
    an empty table gives no rows; without positives every score is FIRST_PRIOR.
    """
    rows = docs.select("doc_id", "text")
    return score(rows, fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
