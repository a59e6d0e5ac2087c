"""Toxicity by subword bags: character n-gram vectors averaged per word into a linear softmax.

A word is its bag of hashed character n-grams (with its edges marked) and itself; the bag's mean vector goes through a
linear softmax over (clean, toxic). A text is toxic if one of its words is: vectors and softmax are trained jointly in
numpy on whole texts by that noisy-or, so a few words decide a long text as well as a short one, and a misspelling
shares most n-grams with the word it was made from. The text's score is its most toxic word's logit, calibrated on a
part of the sample that was not trained on. Punctuation at a word's ends is not part of it. Training takes a bounded sample of labelled rows (``per_class`` of each
label); tasks then score every whole text. A-Z is lower-cased.

Null or empty text: the score of a text without words. Repeated rows are scored each. No labels: score of the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import Powers, Texts, mix64, slices
from seqprep.llm.sampling import calibration_split, labelled_sample

BUCKETS, DIM, SIZES, STRIP, PER_CLASS = 1 << 18, 8, (3, 4, 5, 6, 8), 4, 3_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class Bags:
    """n-gram buckets of the words of a batch of texts."""

    def __init__(self, texts: Texts, buckets: int = BUCKETS):
        self.texts, self.buckets = texts, np.uint64(buckets)
        start, end = texts.word_start, texts.word_end
        length = end - start
        self.count = len(start)
        # every word between single edge marks
        self.first = np.cumsum(length + 1) - length if self.count else np.zeros(0, np.int64)
        marked = np.full(int((length + 1).sum()) + 1, 0x20, np.uint8)
        inside = np.repeat(self.first - start, length) + np.concatenate([np.zeros(0, np.int64), _ranges(start, length)])
        marked[inside] = texts.data[_ranges(start, length)]
        self.marked, self.length = marked, length
        self.edge = np.concatenate([[0], np.cumsum(marked == 0x20)])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of the n-gram at each place, and whether it lies within one marked word."""
        size = len(self.marked) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            h = np.full(size, n, np.uint64)
            for k in range(n):
                h = h * STEP + self.marked[k : size + k] + np.uint64(1)
        good = self.edge[n - 1 : n - 1 + size] == self.edge[1 : 1 + size]
        return (mix64(h) % self.buckets).astype(np.int64), good

    def whole(self) -> np.ndarray:
        return (self.texts.word_hash() % self.buckets).astype(np.int64)

    def word_sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of a per-bucket value over each word's bag, and the bag's size."""
        total, number = values[self.whole()].astype(np.float64), np.ones(self.count)
        for n in SIZES:
            bucket, good = self.grams(n)
            if not len(bucket):
                continue
            sums = np.concatenate([[0.0], np.cumsum(np.where(good, values[bucket], 0.0))])
            have = np.concatenate([[0], np.cumsum(good)])
            a, b = np.minimum(self.first - 1, len(bucket)), np.minimum(self.first + self.length, len(bucket))
            total += sums[b] - sums[a]
            number += have[b] - have[a]
        return total, number

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of every member of every bag, sorted by word."""
        words, buckets = [np.arange(self.count)], [self.whole()]
        owner = np.repeat(np.arange(self.count), self.length + 1)
        for n in SIZES:
            bucket, good = self.grams(n)
            place = np.flatnonzero(good)
            words.append(owner[place])
            buckets.append(bucket[place])
        words, buckets = np.concatenate(words), np.concatenate(buckets)
        by = np.argsort(words, kind="stable")
        return words[by], buckets[by]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total) if total else np.zeros(0, np.int64)


def _texts(texts: list[str], powers: Powers) -> Texts:
    return Texts(pa.array(texts, pa.large_string()), powers, lower=True, strip=STRIP)


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a smoothed logistic fit."""
    if len(x) == 0:
        return 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mean, scale = x.mean(), x.std() + 1e-9
    u, w = np.stack([(x - mean) / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        hess = (u * (p * (1 - p))[:, None]).T @ u + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, u.T @ (p - target) + 1e-3 * w)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def train(sample: list[tuple[str, int]], epochs: int = 7, batch: int = 128, rate: float = 0.3, seed: int = 7) -> dict:
    """Value of each bucket (its vector times the softmax difference) and the calibration.

    Every fourth text of a label calibrates, the others train; the vectors and the softmax learn jointly by Adagrad.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)), np.array([5.0, 0.0])
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    fit, rest = calibration_split(sample)
    powers = Powers()
    for _ in range(epochs if fit else 0):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            chosen = [fit[i] for i in order[at : at + batch]]
            t = _texts([x for x, _ in chosen], powers)
            y = np.array([v for _, v in chosen], float)
            bags = Bags(t)
            if not bags.count:
                continue
            # distinct words of each text
            _, kept = np.unique(mix64(t.word_hash() ^ mix64(t.word_doc().astype(np.uint64))), return_index=True)
            # half of the words are left out each time, so that each toxic word must be found by itself; those of clean
            # texts that stay count twice
            kept = kept[rng.random(len(kept)) < 0.5]
            if not len(kept):
                continue
            name, first, inverse = np.unique(t.word_hash()[kept], return_index=True, return_inverse=True)
            types, doc = kept[first], t.word_doc()[kept]
            words, buckets = bags.flat()
            slot = np.full(bags.count, -1)
            slot[types] = np.arange(len(types))
            use = slot[words] >= 0
            words, buckets = slot[words[use]], buckets[use]
            by = np.argsort(words, kind="stable")
            words, buckets = words[by], buckets[by]
            # half of each bag is left out too, as a misspelling would lose it; a bag that lost all keeps all
            drawn = rng.random(len(words)) < 0.5
            drawn |= (np.bincount(words[drawn], minlength=len(types)) == 0)[words]
            words, buckets = words[drawn], buckets[drawn]
            number = np.bincount(words, minlength=len(types)).astype(float)
            start = np.concatenate([[0], np.cumsum(number[:-1])]).astype(np.int64)
            mean = np.add.reduceat(vectors[buckets], start, axis=0) / number[:, None]
            logits = mean @ softmax + bias
            z = (logits[:, 1] - logits[:, 0])[inverse]
            total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y))
            push = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-6)), 2.0)
            dz = np.bincount(inverse, weights=push[doc] / (1 + np.exp(-z)), minlength=len(types)) / len(y) * 8
            both = np.stack([-dz, dz], 1)
            g_softmax, g_bias = mean.T @ both + 1e-4 * softmax, both.sum(0)
            g_mean = (both @ softmax.T) / number[:, None]
            by = np.argsort(buckets, kind="stable")
            found, start = np.unique(buckets[by], return_index=True)
            g = np.add.reduceat(g_mean[words[by]], start, axis=0)
            seen_v[found] += (g * g).sum(1)
            vectors[found] -= rate * g / np.sqrt(seen_v[found])[:, None]
            seen_s += g_softmax * g_softmax
            softmax -= 0.1 * g_softmax / np.sqrt(seen_s)
            seen_b += g_bias * g_bias
            bias -= 0.1 * g_bias / np.sqrt(seen_b)
    values = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    model = {"values": values, "bias": float(bias[1] - bias[0]), "slope": 1.0, "intercept": 0.0}
    raw = np.concatenate([worst(_texts([x], powers), model) for x, _ in rest]) if rest else np.zeros(0)
    model["slope"], model["intercept"] = platt(raw, np.array([v for _, v in rest], float))
    return model


def worst(t: Texts, model: dict) -> np.ndarray:
    """Largest word logit of each text; a text without words has that of an empty bag."""
    out = np.full(t.n, model["bias"] - 10.0)
    if len(t.word_start):
        total, number = Bags(t).word_sums(model["values"])
        have = np.flatnonzero(np.diff(t.word_off))
        out[have] = np.maximum.reduceat(total / number, t.word_off[have]) + model["bias"]
    return out


def score(df: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """(key, score): probability that each whole text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in slices(batches, "_text"):
            raw = worst(Texts(batch.column(1), powers, lower=True, strip=STRIP), m) * m["slope"] + m["intercept"]
            p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=[key, "score"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{_field(df, key)}, score double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS, usable: Column | None = None) -> dict:
    return train(labelled_sample(docs, labels, key, text, label, per_class, usable))


def keep_clean(df: DataFrame, text: str, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, in one pass over whole rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in slices(batches, text):
            raw = worst(_texts_of(batch.column(text), powers), m) * m["slope"] + m["intercept"]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))) < threshold))

    return df.mapInArrow(run, df.schema)


def _texts_of(column: pa.Array, powers: Powers) -> Texts:
    return Texts(column, powers, lower=True, strip=STRIP)
