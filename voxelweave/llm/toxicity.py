"""Toxicity: logistic regression with a counterfactual penalty.

Features are hashed words and word beginnings of 4 to 7 bytes (insults are inflected and compounded), by their damped
share of the text's words: log(1 + DENSITY * count / (words + SHORT)). Each is scaled by how surely its presence differs
between the classes (the standard score of its log odds ratio, from Z_LEAST on), so that chance words of few labelled texts have no say. In labelled texts that mention a group, each mention is swapped for another group's of the same
kind (a table that the caller may give, IDENTITY_TERMS by default); the fit adds ``penalty`` times the squared change of the margin to the loss, so that mentions by themselves
cannot move the score. The margin is calibrated on rows kept out of the fit.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm import linear

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6, 7)
EPOCHS, RATE, DECAY, PENALTY = 24, 0.03, 1e-6, 1.0
#: SHORT keeps single words of very short texts from deciding.
DENSITY, SHORT = 200.0, 20.0
Z_LEAST, Z_RANGE = 2.0, 6.0
REMEMBERED = 64

# Identity terms by kind; a mention is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("disabled", "deaf", "blind"), ("old", "young"), ("rich", "poor"),
    ("frau", "mann"), ("frauen", "männer"), ("femme", "homme"), ("femmes", "hommes"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
#: Byte by byte: letters lower-cased, digits and bytes of other characters kept, all else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Swapper:
    """Of a text, the text (in lower case, A-Z) with every mention of a group swapped for the next one of its kind; None without mentions."""

    def __init__(self, groups: Sequence[Sequence[str]] = IDENTITY_TERMS):
        self.other = {t.lower().encode(): kind[(i + 1) % len(kind)].lower().encode() for kind in groups for i, t in enumerate(kind)}
        terms = b"|".join(map(re.escape, sorted(self.other, key=len, reverse=True)))
        self.mention = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:" + terms + rb")(?![a-z0-9\x80-\xff])") if terms else None

    def __call__(self, text: str) -> str | None:
        if self.mention is None:
            return None
        out, n = self.mention.subn(lambda m: self.other[m[0]], text.encode("utf-8", "replace").lower())
        return out.decode("utf-8", "replace") if n else None


swapped = Swapper()


def _buckets(word: bytes) -> tuple[int, ...]:
    mask = BUCKETS - 1
    return (crc32(word) & mask, *(crc32(b"^" + word[:n]) & mask for n in BEGINNINGS if len(word) >= n))


#: Of words of at most REMEMBERED bytes, so that what is remembered is bounded; longer ones are whole too, and worked out each time.
_short = lru_cache(100_000)(_buckets)


def features(text: str) -> linear.Features:
    counts: dict[int, int] = {}
    words = text.encode("utf-8", "replace").translate(_WORDS).split()
    for word in words:
        for k in _short(word) if len(word) <= REMEMBERED else _buckets(word):
            counts[k] = counts.get(k, 0) + 1
    at = np.fromiter(counts.keys(), np.int32, len(counts))
    share = np.fromiter(counts.values(), np.float64, len(counts)) / (len(words) + SHORT)
    return at, np.log1p(DENSITY * share)


def sureness(rows: list[linear.Features], labels: np.ndarray) -> np.ndarray:
    """0 to 1 for every bucket."""
    counts, n = np.full((2, BUCKETS), 0.5), np.array([(labels == y).sum() + 1.0 for y in (0, 1)])[:, None]
    for (at, _), y in zip(rows, labels):
        counts[int(y)][at] += 1
    without = n - counts + 0.5
    odds = np.log(counts / without)
    z = np.abs(odds[1] - odds[0]) / np.sqrt((1 / counts + 1 / without).sum(axis=0))
    return np.clip((z - Z_LEAST) / Z_RANGE, 0, 1)


def fit(sample: linear.Sample, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 0) -> linear.Linear:
    """Adagrad on logistic loss, classes weighing alike, plus ``penalty`` * (margin - margin of the swapped text)²."""
    y = sample.labels
    if not len(y):
        return linear.Linear(np.zeros(BUCKETS), 1.0, 0.0)
    use, calibrate = linear.split_sample(y)
    scale = sureness([sample.rows[i] for i in use], y[use])

    def scaled(x: linear.Features) -> linear.Features:
        keep = scale[x[0]] > 0
        at = x[0][keep]
        return at, x[1][keep] * scale[at]

    rows = {int(i): scaled(sample.rows[i]) for i in {*use.tolist(), *calibrate.tolist()}}
    others = {i: scaled(sample.others[i]) for i in rows if sample.others[i] is not None}
    share = max(1, int((y[use] == 1).sum())), max(1, int((y[use] == 0).sum()))
    weight = {1: len(use) / (2 * share[0]), 0: len(use) / (2 * share[1])}
    w, g2, b = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(use).tolist():
            at, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ v + b, -60, 60)))
            e = weight[int(y[i])] * (p - y[i])
            g = e * v + DECAY * w[at]
            g2[at] += g * g
            w[at] -= RATE * g / np.sqrt(g2[at])
            b -= 0.02 * e
            if penalty and i in others:
                other, u = others[i]
                both, inverse = np.unique(np.concatenate((at, other)), return_inverse=True)
                change = np.bincount(inverse, np.concatenate((v, -u)), len(both))
                # a proximal step: the change of the margin shrinks, and cannot overshoot
                w[both] -= (2 * penalty * (w[both] @ change) / (1 + 2 * penalty * float(change @ change))) * change
    margins = np.array([w[rows[i][0]] @ rows[i][1] + b for i in calibrate.tolist()])
    a, c = linear.calibrated(margins, y[calibrate])
    return linear.Linear(w * scale, a, a * b + c)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = linear.MAX_ROWS,
             max_features: int = linear.MAX_FEATURES, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the score (0 to 1, higher: more toxic) uses the text only.

    The fit takes at most ``max_rows`` labelled rows for which ``learn`` holds, and ``max_features`` features of them (see linear.py). ``groups``: terms by kind, of which one is swapped for another;
    where no labelled text mentions any, ``penalty`` has nothing to act on. Null texts count as empty and are scored too;
    null and repeated ids stay as they are; without usable labels every score is 0.5; other columns are ignored.
    """
    sample = linear.labelled_sample(docs, labels, label, learn, features, Swapper(groups), id_col, text_col, max_rows, max_features)
    return linear.scored(docs, fit(sample, penalty), features, id_col, text_col)
