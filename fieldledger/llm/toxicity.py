"""Toxicity by compression distance.

Three zstandard dictionaries are trained by zstandard's trainer.  All begin with a core of ordinary prose, for toxic
texts are mostly prose too.  Each goes on with what the trainer makes of passages: runs of text that mark a class.

A gram marks the toxic class *strictly* if it stands in many times as many toxic texts as ordinary ones, and *densely*
if it is dense (often, and a good share of the words) in many times as many: stems that ordinary texts use too, but
seldom, which is how texts in most languages are told.  Dense and strict marks make the toxic dictionary, strict ones
alone a second; the ordinary dictionary has the ordinary class's dense marks.  No mark is in the core.

A window is the head of one word, or a piece of what follows it (behind a hyphen, so that all of a text counts), between a lead from the core and a trail that no text has.  Heads are written with two
blanks and a capital before them, so that a stem at a word's start is no match for the same letters within a word.  Its
distance is how many bytes fewer a toxic dictionary needs than the ordinary one.  A document's features are how many windows,
how many different ones and which share of them lie above a distance; weights and threshold are calibrated on training rows,
each measured with dictionaries that did not see it.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldledger.llm.base import add_columns, held_out, read_table

#: The training sample: so many labelled documents at most, whole texts, of at most so many bytes together.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 2000, 3000, 48 << 20
CORE_BYTES, TAIL_BYTES, TRAINER_BYTES = 8192, 6144, 4 << 20
#: A window: so many bytes of a word, and after it bytes that no text has, the same for all dictionaries.
HEAD, TRAIL = 6, bytes(range(1, 9))
#: The prose of the core is taken so many words at a time.
PROSE_WORDS = 4
#: A gram marks a class if it stands (is dense) in so many of its texts, in this share of them, and in so many times as large a share as in the other's.
GRAM, LEAST_TEXTS, LEAST_SHARE, STRICT_RATIO, DENSE_RATIO = 6, 4, 0.01, 40.0, 8.0
#: It is dense in a text if it stands in so many different places, and that many to a word.
DENSE_TIMES, DENSE_SHARE = 2, 0.004
#: Parts of the sample for the calibration.
FOLDS = 3
LEVEL, MIN_MATCH = 12, 6
#: Windows that save so many bytes are counted; shares are told apart from about this one on.
LEAST_SAVING, SMALL_SHARE = 3, 0.002
THRESHOLD = 0.3
CACHED = 200_000
NOTHING = (0, 0)
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").split() or [b""]


def rests(word: bytes) -> list[bytes]:
    """What follows a word's head, in pieces behind a hyphen as long as a head: no byte of a text is left out."""
    return [b"-" + word[k : k + HEAD - 1] for k in range(HEAD, len(word), HEAD - 1)]


def pieces(words: list[bytes]) -> list[bytes]:
    """Words, each followed by its rests."""
    return [p for w in words for p in (w, *rests(w))]


def head(word: bytes) -> bytes:
    return word[:1].upper() + word[1:HEAD]


def tidy(text: str) -> bytes:
    """The heads and rests of all words, as the dictionaries have them."""
    return b"  " + b"  ".join([head(w) for w in pieces(raw_words(text))]) + b"  "


def prose_of(data: bytes) -> list[bytes]:
    """The heads of a tidy text, PROSE_WORDS at a time."""
    words = data.split()
    return [b"  ".join(words[i : i + PROSE_WORDS]) for i in range(0, len(words), PROSE_WORDS)]


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes = b""
    toxic: bytes = b""
    strict: bytes = b""
    lead: bytes = b""


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries = Dictionaries()
    weights: tuple[float, ...] = ()  # empty: nothing to learn from, all scores are 0


class Distance:
    """Bytes that the toxic dictionaries save on windows."""

    def __init__(self, dictionaries: Dictionaries):
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=18, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        compress = []
        for content in (dictionaries.ordinary, dictionaries.toxic, dictionaries.strict):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            compress.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
        self.compress, self.lead = compress, dictionaries.lead + b"  "
        self.known: dict[bytes, tuple[int, int]] = {}
        self.heads: dict[bytes, tuple[int, int]] = {}

    def saved(self, word: bytes) -> tuple[int, int]:
        """(by the toxic dictionary, by the strict one)."""
        h = head(word)
        got = self.heads.get(h)
        if got is None:
            if len(self.heads) >= CACHED:
                self.heads.clear()
            ordinary, toxic, strict = [len(f(self.lead + h + TRAIL)) for f in self.compress]
            got = self.heads[h] = (ordinary - toxic, ordinary - strict) if toxic != ordinary or strict != ordinary else NOTHING
        return got

    def features(self, text: str | None) -> list[float]:
        """A constant, and for each toxic dictionary of the windows that save LEAST_SAVING: whether there are any, how many (different)
        ones, and their share of all, the last three as logarithms."""
        words = pieces(raw_words(text))
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > CACHED:
            known.clear()
            new = set(words)
        known.update((w, self.saved(w)) for w in new)
        some = [(head(w), v) for w in words if (v := known[w]) is not NOTHING]
        n, out = len(words), [1.0]
        for k in (0, 1):
            above = [h for h, v in some if v[k] >= LEAST_SAVING]
            out += [float(bool(above)), float(np.log1p(len(above))), float(np.log1p(len(set(above)))), float(np.log1p(len(above) / n / SMALL_SHARE))]
        return out


def grams_of(data: bytes) -> np.ndarray:
    """The GRAM bytes from each position on, as one number."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out |= a[k : k + n] << np.uint64(8 * k)
    return out


Counted = tuple[np.ndarray, np.ndarray]
NONE: Counted = (np.empty(0, np.uint64), np.empty(0, np.int64))
#: Grams held before they are counted together.
PENDING = 2_000_000


def gram_texts(texts: list[bytes]) -> tuple[Counted, Counted]:
    """(grams, in how many texts each stands) and (grams, in how many it is dense).

    A place is the gram, the two bytes after it and the gram before it: passages that a text repeats count once.
    """
    kinds: tuple[list[Counted], list[Counted]] = ([NONE], [NONE])
    pending: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])

    def settle() -> None:
        for counted, waiting in zip(kinds, pending, strict=True):
            if waiting:
                counted[:] = [summed([*counted, np.unique(np.concatenate(waiting), return_counts=True)])]
                waiting.clear()

    held = 0
    for data in texts:
        g = grams_of(data)
        before, after = np.concatenate([[np.uint64(0)], g[:-1]]), np.concatenate([g[2:], np.zeros(min(2, len(g)), np.uint64)])
        with np.errstate(over="ignore"):
            place = np.unique(g * MIX[0] ^ before * MIX[1] ^ after, return_index=True)[1]
        grams, n = np.unique(g[place], return_counts=True)
        pending[0].append(grams)
        pending[1].append(grams[(n >= DENSE_TIMES) & (n >= DENSE_SHARE * len(data.split()))])
        held += len(grams)
        if held > PENDING:
            settle()
            held = 0
    settle()
    return kinds[0][0], kinds[1][0]


def summed(parts: list[Counted]) -> Counted:
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def count_in(counted: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    known, n = counted
    if not len(known):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, n[at], 0)


def marks_of(own: Counted, other: Counted, n_own: int, n_other: int, ratio: float) -> np.ndarray:
    """The grams that mark the own class of ``n_own`` texts, ascending."""
    grams, n = own
    rest = (count_in(other, grams) + 0.5) / max(1, n_other)
    return grams[(n >= max(LEAST_TEXTS, LEAST_SHARE * n_own)) & (n / max(1, n_own) >= ratio * rest)]


def passages(texts: list[bytes], marks: np.ndarray) -> list[bytes]:
    """The runs of text that marking grams cover, with a byte on each side; one for each run's surroundings."""
    found: set[tuple[bytes, bytes, bytes]] = set()
    for data in texts:
        at = np.flatnonzero(np.isin(grams_of(data), marks))
        if len(at):
            depth = np.zeros(len(data) + 2, np.int64)
            depth[at + 1] += 1
            depth[at + GRAM + 1] -= 1
            edges = np.flatnonzero(np.diff(np.cumsum(depth) > 0)).reshape(-1, 2).tolist()
            found |= {(data[max(0, a - 8) : a], data[max(0, a - 1) : b + 1], data[b : b + 8]) for a, b in edges}
    return [p + b" " for _, p, _ in sorted(found)]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer picks from samples, the best last; all of them if they are too few for it."""
    samples = list(samples)
    random.Random(1).shuffle(samples)
    upto = np.cumsum([len(x) for x in samples])
    samples = samples[: int(np.searchsorted(upto, TRAINER_BYTES)) + 1]
    try:
        whole = zstandard.train_dictionary(size + 600, samples).as_bytes()
        return whole[-min(size, max(1, len(whole) - 400)) :]  # the head holds tables, not text
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def unmarked(pieces: list[bytes], marks: np.ndarray, at_once: int = 10_000) -> list[bytes]:
    """The pieces in which no mark stands, looked at so many at once."""
    out = []
    for k in range(0, len(pieces), at_once):
        part = pieces[k : k + at_once]
        framed = [b"  " + p + b"  " for p in part]
        ends = np.cumsum([len(p) for p in framed])
        hits = np.concatenate([[0], np.cumsum(np.isin(grams_of(b"".join(framed) + b" " * GRAM), marks))])
        starts = np.concatenate([[0], ends])[: len(ends)]
        out += [p for p, clean in zip(part, (hits[ends] == hits[starts]).tolist(), strict=True) if clean]
    return out


def train_dictionaries(bad: list[bytes], good: list[bytes], in_bad: tuple[Counted, Counted], in_good: tuple[Counted, Counted]) -> Dictionaries:
    sizes = len(bad), len(good)
    strict = marks_of(in_bad[0], in_good[0], *sizes, STRICT_RATIO)
    marks = np.union1d(strict, marks_of(in_bad[1], in_good[1], *sizes, DENSE_RATIO))
    others = marks_of(in_good[1], in_bad[1], *sizes[::-1], DENSE_RATIO)
    core = trained(unmarked(sorted({p for t in good for p in prose_of(t)}), marks), CORE_BYTES)  # a text that repeats itself counts once
    pad = core[:32]  # zstandard doesn't index a dictionary's last bytes
    tails = [trained(passages(texts, m), TAIL_BYTES) for texts, m in ((good, others), (bad, marks), (bad, strict))]
    return Dictionaries(*[core + tail + pad for tail in tails], core[100:116])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(score: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """The score above which calling rows positive costs least, in the middle of the widest gap that does.

    A probability threshold says what errors cost: at 0.3 a miss as much as 0.7 / 0.3 false alarms.
    """
    order = np.argsort(score, kind="stable")
    s, t = score[order], y[order]
    misses, alarms = np.concatenate([[0], np.cumsum(t == 1)]), np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    gaps = np.concatenate([[1e-9], s[1:] - s[:-1], [1e-9]])
    cost = np.where(gaps > 0, misses * (1 - threshold) / threshold + alarms, np.inf)
    return float(edges[np.lexsort((-gaps, np.round(cost, 6)))[0]])


def shifted(logits: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """What to add to logits so that errors cost least at ``threshold``."""
    return float(np.log(threshold / (1 - threshold))) - best_cut(logits, y, threshold)


def train(texts: list[str], toxic: list[int], threshold: float = THRESHOLD) -> Model:
    """The model of labelled texts; without texts of both classes, the one that scores all 0.

    The sample is dealt into FOLDS parts: weights are fitted to each part's distances under dictionaries
    trained on the others, then the dictionaries are trained on all.  Equal texts count once.
    """
    sides = [sorted({t for t, y in zip(texts, toxic, strict=True) if y == k and t}) for k in (1, 0)]
    if not all(sides):
        return Model()
    folds = [[side[k::FOLDS] for k in range(FOLDS)] for side in sides]
    tidied = [[[tidy(t) for t in part] for part in side] for side in folds]
    counted = [[gram_texts(part) for part in side] for side in tidied]
    x, y = [], []
    for k in range(FOLDS):
        seen = [both([c for j, c in enumerate(side) if j != k]) for side in counted]
        bad, good = (sum([part for j, part in enumerate(side) if j != k], []) for side in tidied)
        if bad and good:
            distance = Distance(train_dictionaries(bad, good, *seen))
            for label, side in zip((1, 0), folds, strict=True):
                x += [distance.features(t) for t in side[k]]
                y += [label] * len(side[k])
    if len(set(y)) < 2:
        return Model()
    features, labels = np.array(x), np.array(y)
    w = logistic(features, labels)
    w[0] += shifted(features @ w, labels, threshold)
    return Model(train_dictionaries(*[sum(side, []) for side in tidied], both(counted[0]), both(counted[1])), tuple(w.tolist()))


def both(parts: list[tuple[Counted, Counted]]) -> tuple[Counted, Counted]:
    """Counts over several parts, of each kind."""
    return tuple(summed(list(kind)) for kind in zip(*parts, strict=True))


@lru_cache(maxsize=1)
def distance_of(model: Model) -> Distance:
    return Distance(model.dictionaries)


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the ids that may be learnt from.  Null ids and labels don't count; of several labels the largest does."""
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))


def training_ids(labels: DataFrame, label: str, limits: dict[int, int]) -> DataFrame:
    """doc_id, y of a bounded sample, by the ids' hash: at most limits[y] of each label."""
    usable, picked = usable_labels(labels, label), None
    for value, most in limits.items():
        some = usable.filter(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    return picked


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, y of a bounded sample of labelled rows, whole texts: by the ids' hash, up to ``max_bytes`` together.

    Repeated rows count once, null texts don't.  All that is gathered in one task are the sample's ids,
    hashes and lengths; a row that would go over the bound is left out, whatever its length.
    """
    ids = training_ids(labels, label, limits)  # at most sum(limits) rows: its broadcast is bounded
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("text_hash", F.xxhash64("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text_hash", F.octet_length("text").alias("n")).distinct()
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(sum(limits.values()))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash"))
    sample = sample.withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("doc_id", "text_hash", "y")
    return texts.join(F.broadcast(sample), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels, "toxic", {1: MAX_TOXIC, 0: MAX_ORDINARY}).toPandas()
    return train(rows["text"].tolist(), rows["y"].tolist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to ``docs`` and leaves the text out.  Null and empty texts have one empty window."""

    def make():
        distance = distance_of(model) if model.weights else None

        def rows(texts):
            if distance is None:
                return [[0.0] * len(texts), [0] * len(texts)]
            x = np.array([distance.features(t) for t in texts]).reshape(-1, len(model.weights))
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            return [p.tolist(), (p >= threshold).astype(int).tolist()]

        return rows

    return add_columns(docs, ["text"], "score double, predicted int", make, drop=("text",))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; its other columns are left out.

    Equal texts have equal scores, so repeated rows and ties keep theirs; an empty table gives no rows;
    texts of any length are scored whole; without labels of both kinds every score is 0.
    """
    rows = docs.select("doc_id", "text")
    return score(rows, fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
