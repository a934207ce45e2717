"""Quality: naive Bayes support vectors (NB-SVM).

Indicators of n-grams of words (one and two in a row) and of word shapes (one to three) are scaled by the log ratio of their counts in the two classes. A linear
model with hinge loss is fitted to them by dual coordinate descent. A word's shape keeps its kinds of characters in order (a lower-case run, an
upper-case run, digits, every other character), and a word that repeats the one before it has the shape "=". The margin is
calibrated on rows kept out of the fit.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame

from voxelweave.llm import linear

BUCKETS = 1 << 18
EPOCHS, COST, SMOOTH = 30, 1.0, 1.0
REMEMBERED = 64


def shape(word: str) -> bytes:
    """E.g. Aa, a., A,!!, 0 and |."""
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k or k not in "aA0":
            out.append(k)
    return "".join(out).encode("utf-8", "replace")


def _word(word: str) -> tuple[bytes, int]:
    """A word's shape (its digest, if it is long) and hash."""
    s = shape(word)
    return s if len(s) <= REMEMBERED else b"#" + blake2b(s, digest_size=16).digest(), crc32(word.lower().encode("utf-8", "replace"))


#: Of words of at most REMEMBERED characters, so that what is remembered is bounded; longer ones are whole too, and worked out each time.
_short = lru_cache(200_000)(_word)


@lru_cache(200_000)
def _shapes(two: bytes, one: bytes, s: bytes) -> tuple[int, int, int]:
    """Buckets of a shape, and of it after one and after two others."""
    mask, pair = BUCKETS - 1, one + b"\0" + s
    return crc32(b"1" + s) & mask, crc32(b"2" + pair) & mask, crc32(b"3" + two + b"\0" + pair) & mask


def features(text: str) -> linear.Features:
    """Indicators, as a vector of unit length."""
    found: set[int] = set()
    before, last, one, two, mask = None, 0, b"", b"", BUCKETS - 1
    for word in text.split():
        if word == before:
            s = b"="
        else:
            s, h = _short(word) if len(word) <= REMEMBERED else _word(word)
            found.add(h & mask)
            # two words in a row: both hashes, mixed by odd factors
            found.add((last * 0x9E3779B1 + h * 0x85EBCA6B + 1 >> 7) & mask)
            last = h
        found.update(_shapes(two, one, s))
        before, two, one = word, one, s
    at = np.fromiter(found, np.int32, len(found))
    at.sort()
    return at, np.full(len(at), 1 / np.sqrt(max(1, len(at))))


def log_count_ratios(rows: list[linear.Features], labels: np.ndarray) -> np.ndarray:
    counts = np.full((2, BUCKETS), SMOOTH)
    for (at, _), y in zip(rows, labels):
        counts[int(y)][at] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    return np.log(p / q)


def dual_coordinate_descent(rows: list[linear.Features], labels: np.ndarray, size: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """(w, b) of a linear support vector machine with hinge loss: one dual variable at a time, in [0, cost], exactly minimised."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = sign[i] * (float(w[at] @ v) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * sign[i] * v
                b += step * sign[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, b


def fit(sample: linear.Sample, epochs: int = EPOCHS) -> linear.Linear:
    y = sample.labels
    if not len(y):
        return linear.Linear(np.zeros(BUCKETS), 1.0, 0.0)
    use, calibrate = linear.split_sample(y)
    ratio = log_count_ratios([sample.rows[i] for i in use], y[use])
    scaled = [(sample.rows[i][0], sample.rows[i][1] * ratio[sample.rows[i][0]]) for i in use]
    n1, n0 = max(1, int((y[use] == 1).sum())), max(1, int((y[use] == 0).sum()))
    cost = np.where(y[use] == 1, COST * len(use) / (2 * n1), COST * len(use) / (2 * n0))  # classes weigh alike
    w, b = dual_coordinate_descent(scaled, y[use], BUCKETS, cost, epochs)
    w = w * ratio
    margins = np.array([w[sample.rows[i][0]] @ sample.rows[i][1] + b for i in calibrate])
    a, c = linear.calibrated(margins, y[calibrate])
    return linear.Linear(w, a, a * b + c)


def quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = linear.MAX_ROWS, max_features: int = linear.MAX_FEATURES) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the score (0 to 1, higher: better) uses the text only.

    The fit takes at most ``max_rows`` labelled rows for which ``learn`` holds, and ``max_features`` features of them (see linear.py). Null texts count as empty and are scored too;
    null and repeated ids stay as they are; without usable labels every score is 0.5; other columns are ignored.
    """
    sample = linear.labelled_sample(docs, labels, label, learn, features, None, id_col, text_col, max_rows, max_features)
    return linear.scored(docs, fit(sample), features, id_col, text_col)


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = linear.MAX_ROWS,
              max_features: int = linear.MAX_FEATURES) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; fitted as in ``quality``. Without usable labels nothing is rejected.

    Null texts are scored as empty ones and stay null if they are kept; null ids are scored like others; repeated rows are kept or go together; an empty table stays empty.
    """
    sample = linear.labelled_sample(docs, labels, label, learn, features, None, id_col, text_col, max_rows, max_features)
    if not len(sample.labels):
        return docs
    return linear.kept(docs, fit(sample), features, threshold, text_col)
