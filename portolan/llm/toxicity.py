"""Toxicity with subword-bag embeddings averaged into a linear softmax.

A text is the bag of its words' character n-grams and of the words themselves,
hashed into a fixed number of buckets. Each bucket has an embedding; the mean of
a text's embeddings goes into a softmax over two classes. Embeddings and softmax
are trained together in numpy on a bounded sample of labelled rows. A misspelling
that was never seen shares most of its n-grams with the word it comes from.

Scoring needs no embeddings: the softmax is linear, so that every bucket comes
down to one number, and a text's score to the mean of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
BUCKETS = 1 << BITS
GRAMS = (4, 5, 6)
DIMENSIONS = 4
#: At most so many labelled rows of each class are used for training.
SAMPLE_PER_CLASS = 2500
#: Words whose features are computed together in training.
WORDS_AT_ONCE = 50_000
#: Longest part of a word whose n-grams count; longer words go on in parts.
WORD_CHARS = 64
#: Features that fewer texts of the sample hold are not trained.
MIN_TEXTS = 5
STEPS = 40
RATE = 2.0
SEED = 17

#: Punctuation separates words as white space does.
_SEPARATORS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text; a very long word is cut into parts, none is dropped."""
    words = (text or "").lower().translate(_SEPARATORS).split()
    if any(len(w) > WORD_CHARS for w in words):
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and of the words themselves, and how many each word has."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    buckets, owners = [], []
    prime, odd = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(chars), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            rolling = rolling[:m] * prime + chars[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                inside = owner[:m] == owner[n - 1 :]
                buckets.append((rolling[inside] * odd) >> np.uint64(64 - BITS))
                owners.append(owner[:m][inside])
        # a whole word: the polynomial over its characters, from running sums
        powers = np.cumprod(np.full(WORD_CHARS + 2, prime, np.uint64))
        within = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
        whole = np.add.reduceat(chars * powers[within], ends - sizes) if len(words) else np.zeros(0, np.uint64)
        buckets.append(((whole + odd) * odd) >> np.uint64(64 - BITS))
        owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.bincount(owners, minlength=len(words))


@dataclass(frozen=True)
class Model:
    """One number per bucket, and the intercept of the log odds."""

    weights: np.ndarray
    intercept: float

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights and number of features of each word."""
        if not words:
            return np.zeros(0), np.zeros(0)
        buckets, counts = features(words)
        return np.add.reduceat(self.weights[buckets].astype(np.float64), np.cumsum(counts) - counts), counts


def _softmax_step(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    exp = np.exp(logits - logits.max(axis=1, keepdims=True))
    probability = exp / exp.sum(axis=1, keepdims=True)
    probability[np.arange(len(labels)), labels] -= 1
    return probability * weight[:, None]


class _Descent:
    """Gradient steps with momentum, scaled by the size of each whole parameter's gradient.

    A scale per parameter and not per entry keeps the rarely seen features near
    zero, where they are noise, and lets those move that many texts agree on.
    """

    def __init__(self, *parameters: np.ndarray):
        self.parameters, self.step = parameters, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [0.0 for _ in parameters]

    def update(self, rates: tuple[float, ...], *gradients: np.ndarray) -> None:
        self.step += 1
        for i, (p, g, m, rate) in enumerate(zip(self.parameters, gradients, self.first, rates)):
            m += 0.1 * (g - m)
            self.second[i] += 0.01 * (float((g * g).sum()) - self.second[i])
            size = np.sqrt(self.second[i] / (1 - 0.99**self.step)) + 1e-12
            p -= np.float32(rate / (1 - 0.9**self.step) / size) * m


def train(texts: list[str | None], labels: list[int], steps: int = STEPS, base_rate: float | None = None) -> Model:
    """Fits embeddings and softmax together on labelled texts, deterministically.

    One fifth of the texts sets the scale and intercept of the log odds; the
    classes' frequencies are corrected to ``base_rate`` if one is given. With
    fewer than two classes the model answers the base rate.
    """
    labels_ = np.array(labels, np.int64)
    positive = labels_.mean() if len(labels_) else 0.0
    rate = positive if base_rate is None else base_rate
    if len(set(labels)) < 2:
        p = min(max(rate, 1e-4), 1 - 1e-4)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    number: dict[str, int] = {}
    bags = []
    for text in texts:
        ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
        bags.append(np.unique(ids, return_counts=True))
    sizes = [len(ids) for ids, _ in bags]
    doc_of = np.repeat(np.arange(len(bags), dtype=np.int32), sizes)
    word_of = np.concatenate([ids for ids, _ in bags])
    times = np.concatenate([n for _, n in bags]).astype(np.float32)
    held = np.bincount(word_of, minlength=len(number))

    # Two passes over the words, some at a time: count the features' texts, then keep the common ones.
    words = list(number)
    del number, bags
    parts = [(i, words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
    texts_with = np.zeros(BUCKETS)
    counts = np.zeros(len(words), np.int32)
    for i, part in parts:
        found, n = features(part)
        counts[i : i + len(part)] = n
        texts_with += np.bincount(found, weights=np.repeat(held[i : i + len(part)], n), minlength=BUCKETS)
    # rare features stay at zero: they count in the mean's length only
    known = np.flatnonzero(texts_with >= MIN_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    buckets, owner = [], []
    for i, part in parts:
        found, n = features(part)
        found, own = place[found], np.repeat(np.arange(i, i + len(part), dtype=np.int32), n)
        buckets.append(found[found >= 0])
        owner.append(own[found >= 0])
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    del parts, words
    shown = np.unique(owner)
    starts = np.searchsorted(owner, shown)
    by_bucket = np.argsort(buckets, kind="stable").astype(np.int32)
    owner_by_bucket = owner[by_bucket]
    bucket_starts = np.searchsorted(buckets[by_bucket], np.arange(len(known)))
    del by_bucket

    total = np.bincount(doc_of, weights=times * counts[word_of], minlength=len(texts)).astype(np.float32)
    share = times / total[doc_of]
    filled = np.flatnonzero(total > 0)
    cuts = np.searchsorted(doc_of, filled)
    by_word = np.argsort(word_of, kind="stable").astype(np.int32)
    seen, word_starts = np.unique(word_of[by_word], return_index=True)
    doc_by_word, share_by_word = doc_of[by_word], share[by_word]
    del by_word, times

    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-0.05, 0.05, (DIMENSIONS, len(known))).astype(np.float32)
    output = rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    fit = np.arange(len(texts)) % 5 != 0
    weight = np.where(labels_ == 1, 0.5 / max(1, (labels_[fit] == 1).sum()), 0.5 / max(1, (labels_[fit] == 0).sum())).astype(np.float32)
    weight[~fit] = 0
    vector = np.zeros(len(counts), np.float32)

    def mean(line: np.ndarray) -> np.ndarray:
        """Mean of one dimension over each text's features."""
        vector[shown] = np.add.reduceat(line[buckets], starts)
        out = np.zeros(len(texts), np.float32)
        out[filled] = np.add.reduceat(share * vector[word_of], cuts)
        return out

    def slope_of(back: np.ndarray) -> np.ndarray:
        """Gradient of one dimension's embeddings from the gradient of its means."""
        per_word = np.zeros(len(counts), np.float32)
        per_word[seen] = np.add.reduceat(share_by_word * back[doc_by_word], word_starts)
        return np.add.reduceat(per_word[owner_by_bucket], bucket_starts)

    descent = _Descent(embedding, output, bias)
    for _ in range(steps if len(known) else 0):
        means = np.stack([mean(line) for line in embedding], axis=1)
        slope = _softmax_step(means @ output * SCALE + bias, labels_, weight)
        back = slope @ output.T * SCALE
        gradient = np.stack([slope_of(b) for b in back.T.copy()])
        descent.update((RATE, 0.1, 0.1), gradient, means.T @ slope * SCALE, slope.sum(axis=0))
    line = (output[:, 1] - output[:, 0]) @ embedding * SCALE
    per_text = mean(line) if len(known) else np.zeros(len(texts), np.float32)
    odds = per_text + float(bias[1] - bias[0])
    scale, shift = calibrate(odds[~fit], labels_[~fit])
    shift += np.log(rate / (1 - rate)) - np.log(positive / (1 - positive))
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = line * scale
    return Model(weights, float(scale * (bias[1] - bias[0]) + shift))


#: Gain of the softmax: a single word has to count in a mean over thousands.
SCALE = np.float32(100.0)


def calibrate(odds: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of log odds that fit held-back labels, by damped Newton steps."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    spread = max(float(np.std(odds)), 1e-6)
    x = np.stack([odds / spread, np.ones(len(odds))], axis=1)
    at = np.array([1.0, 0.0])
    prior = np.array([0.05, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (p - labels) + prior * at
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-6)
        move = np.linalg.solve(hessian, gradient)
        at -= move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
    return max(float(at[0]) / spread, 1e-6), float(at[1])


def _scored(model: Model):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000)):
                number: dict[str, int] = {}
                docs = [
                    np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)
                    for text in batch.column("text").to_pylist()
                ]
                sums, counts = model.word_sums(list(number))
                odds = np.array([sums[d].sum() / counts[d].sum() if len(d) else 0.0 for d in docs]) + model.intercept
                scores = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows


def held_out(doc_id) -> F.Column:
    """Rows whose label is never used: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Trains on a sample of labelled rows that are not held out: ``per_class`` of each class at most.

    The sample is the labels whose ids have the smallest hashes, each with one
    document. Labels other than 0 and 1 and NULL ids are left out. The base rate is counted over all usable labels.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = [
        r for label in sorted(counts)
        for r in usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    ]
    # at most 2 * per_class rows, whatever the tables' size
    sample = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int").distinct()
    known = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
        .select("toxic", "one.text", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "toxic").collect()
    )
    by_label = [[r for r in known if r.toxic == label] for label in sorted(counts)]
    rows = [r for part in zip_longest(*by_label) for r in part if r is not None]
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    return train([r.text for r in rows], [r.toxic for r in rows], base_rate=min(max(rate, 1e-3), 1 - 1e-3))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    Scores the whole text; NULL and empty texts get the intercept's score. NULL
    and repeated ids stay rows of their own. Only the text enters the score.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scored(model), "doc_id long, score double"
    )
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
