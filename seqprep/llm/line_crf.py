"""Document quality from a linear-chain conditional random field over lines.

Each line has two states, bad and good. Its features are shares of byte classes, lengths and repetition, of the line
itself and of both neighbours. The field is trained by maximum likelihood in numpy on a bounded sample of labelled
texts, whose lines take the text's label (regularised, so that odd lines do not matter). Forward-backward gives each
line's marginal; a document's quality is their mean weighted by line length, calibrated on the part of the sample that
was not trained on. Tasks score whole texts in batches: one step of the recursion serves all texts of a slice.

Null or empty text: one empty line. Repeated rows are scored each. No labels: an even score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqprep.llm.bpe import _field
from seqprep.llm.common import LOWER, Powers, Texts, mix64, ngram_hash, slices, span_hash
from seqprep.llm.sampling import calibration_split, labelled_sample
from seqprep.llm.toxicity import platt

PER_CLASS, OWN = 1_500, 17
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": map(ord, "#*$%&<>@^~=_+\\{}[]"), "loud": map(ord, "!?"),
    "bar": map(ord, "|"), "stop": map(ord, ".,;:"), "other": map(ord, "\"'()/-"), "wide": range(0xC0, 0x100),
}
KIND = np.full(256, len(CLASSES))
for _i, _bytes in enumerate(CLASSES.values()):
    KIND[list(_bytes)] = _i


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, previous, next), their text numbers and their lengths."""
    start, end, doc = t.lines()
    counts = []
    for k in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(KIND[t.data] == k)])
        counts.append(sums[end] - sums[start])
    # capital letters of the Latin-1 range: a lead byte and a second byte below 0x9F
    capital = np.zeros(len(t.data), bool)
    capital[1:] = (t.data[:-1] == 0xC3) & (t.data[1:] >= 0x80) & (t.data[1:] < 0x9F)
    sums = np.concatenate([[0], np.cumsum(capital)])
    upper, lower, digit, mark, loud, bar, stop, other, wide = counts
    upper = upper + sums[end] - sums[start]
    size = np.maximum(end - start, 1)
    letters = np.maximum(upper + lower + wide, 1)
    first, last = np.searchsorted(t.word_start, start), np.searchsorted(t.word_start, end)
    words = last - first
    hashes = t.word_hash(LOWER[t.data])
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    adjacent = np.concatenate([[0], np.cumsum(same)])
    grams, place = ngram_hash(hashes, t.word_off, 3)
    key = mix64(grams ^ mix64(t.word_doc()[place].astype(np.uint64)))
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(hashes) + 1, bool)
    again[place[by[1:][key[by][1:] == key[by][:-1]]]] = True
    repeated = np.concatenate([[0], np.cumsum(again)])
    line = mix64(span_hash(t.data.astype(np.uint64), start, end, t.powers) ^ mix64(doc.astype(np.uint64)))
    _, inverse, number = np.unique(line, return_inverse=True, return_counts=True)
    n = np.maximum(words, 1)
    own = np.stack([
        np.ones(len(start)), upper / letters, lower / letters, digit / size, 4 * mark / size, 4 * loud / size, 4 * bar / size, 4 * stop / size,
        4 * other / size, np.minimum(mark / n, 1.0), np.minimum(loud / n, 1.0), np.minimum(bar / n, 1.0), (adjacent[last] - adjacent[first]) / n,
        (repeated[last] - repeated[first]) / n, (number[inverse] > 1) & (words > 0), np.log1p(words) / 5, np.minimum(size / n, 40) / 10,
    ], 1).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = doc[1:] == doc[:-1]
    before[1:][joined], after[:-1][joined] = own[:-1][joined], own[1:][joined]
    return np.hstack([own, before, after]), doc, size


def marginals(unary: np.ndarray, doc: np.ndarray, n: int, trans: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(state) of each line, expected transitions, and log partition of each text, by scaled forward-backward.

    ``share`` weighs the transitions into each line.

    Texts are ordered by falling number of lines, so that step t works on the first texts only.
    """
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    live = np.searchsorted(-count, -np.arange(count[0] if n else 0), "left")
    top = unary.max(axis=1)
    e, w = np.exp(unary - top[:, None]), np.exp(trans)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    for step, k in enumerate(live):
        at = begin[:k] + step
        a = e[at] if step == 0 else (alpha[at - 1] @ w) * e[at]
        scale[at] = s = a.sum(axis=1)
        alpha[at] = a / s[:, None]
    beta, pairs = np.ones_like(e), np.zeros((2, 2))
    for step in range(len(live) - 1, 0, -1):
        at = begin[: live[step]] + step
        b = beta[at] * e[at] / scale[at][:, None]
        pairs += (alpha[at - 1].T @ (b if share is None else b * share[at][:, None])) * w
        beta[at - 1] = b @ w.T
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), pairs, np.bincount(doc, weights=np.log(scale) + top, minlength=n)


def train(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> dict:
    """Weights of the field by Adam on the whole sample, each text's gradient divided by its lines; then calibration."""
    powers = Powers()
    fit, rest = calibration_split(sample)
    weight, trans = np.zeros((3 * OWN, 2)), np.zeros((2, 2))
    if fit:
        x, doc, _ = features(Texts(pa.array([s for s, _ in fit], pa.large_string()), powers))
        y = np.array([v for _, v in fit])[doc]
        count = np.bincount(doc)
        share = 1 / count[doc]
        truth = np.eye(2)[y]
        # a text's lines share one label: its true transitions stay in that state
        stay = np.diag([((y == s) * (share - share / count[doc])).sum() for s in (0, 1)])
        m, v = [np.zeros_like(weight), np.zeros_like(trans)], [np.zeros_like(weight), np.zeros_like(trans)]
        n = len(fit)
        for r in range(1, rounds + 1):
            p, pairs, _ = marginals(x @ weight, doc, n, trans, share)
            g = [x.T @ ((p - truth) * share[:, None]) / n + decay * weight, (pairs - stay) / n + 0.05 * trans]
            for k, q in enumerate((weight, trans)):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                q -= rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
    model = {"weight": weight, "trans": trans, "slope": 1.0, "intercept": 0.0}
    if rest:
        raw = evidence(Texts(pa.array([s for s, _ in rest], pa.large_string()), powers), model)
        model["slope"], model["intercept"] = platt(raw, np.array([v for _, v in rest], float))
    return model


def line_quality(t: Texts, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, its text number and its length."""
    x, doc, size = features(t)
    return marginals(x @ model["weight"], doc, t.n, model["trans"])[0][:, 1], doc, size


def evidence(t: Texts, model: dict) -> np.ndarray:
    """Logit of the length-weighted mean of the lines' marginals."""
    if not t.n:
        return np.zeros(0)
    good, doc, size = line_quality(t, model)
    mean = np.bincount(doc, weights=good * size, minlength=t.n) / np.bincount(doc, weights=size, minlength=t.n)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def score(df: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """(key, score): probability that each whole text is of good quality."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), shared.value
        for batch in slices(batches, "_text"):
            raw = evidence(Texts(batch.column(1), powers), m) * m["slope"] + m["intercept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))), pa.float64())], names=[key, "score"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{_field(df, key)}, score double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, usable: Column | None = None) -> dict:
    return train(labelled_sample(docs, labels, key, text, label, per_class, usable))
