"""Linear text classifiers: bounded labelled samples, hashed sparse features, calibrated scores.

Only the fit sees a sample: at most ``max_rows`` labelled rows, half of each class at most, those whose id has a low hash,
and at most ``max_features`` features of them in the order of that hash (a text that would pass it, and those after it, are not fitted). Both bounds are parameters of the operators. Features of the sample are worked out on the executors; the driver gets
numbers, no texts. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import delete_path, filter_texts, map_texts, texts_of, written

#: (indices, values) of a text, indices distinct.
Features = tuple[np.ndarray, np.ndarray]
MAX_ROWS, MAX_FEATURES = 8000, 16_000_000
#: Of the sample, by place: every so-maniest row calibrates the score and is not fitted.
CALIBRATE_EVERY = 4


@dataclass
class Sample:
    rows: list[Features]
    others: list[Features | None]  # of changed texts, where there are some
    labels: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, features: Callable[[str], Features], changed: Callable[[str], str | None] | None = None,
                    id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Sample:
    """Features and labels of a bounded sample of the rows of ``labels`` for which ``learn`` (on column doc_id) holds.

    Rows with a null id or a label other than 0 and 1 are left out, and so are ids without a document; repeated labels count once. Of the rows of one
    id, the one whose text has the least hash is taken, whatever their order and number.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(learn).distinct()
    order, most = F.xxhash64("doc_id"), max_rows // 2
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # a share of the hashes and not an ordered limit, which would send ``most`` rows of every partition to the driver
    share, top = F.lit(False), (1 << 63) - 1
    for y, n in sizes.items():
        share = share | ((F.col("label") == y) & (order.bitwiseAND(F.lit(top)) <= F.lit(top if n <= most else int(top * 0.97 * most / n))))
    low = known.filter(share).select("doc_id", "label", order.alias("turn")).collect()  # max_rows, but for chance
    picked = []
    for y in (0, 1):
        picked += [(r["doc_id"], y) for r in sorted((r for r in low if r["label"] == y), key=lambda r: (r["turn"], r["doc_id"]))[:most]]
    if not picked:
        return Sample([], [], np.empty(0, np.int64))
    src = texts_of(docs, id_col, text_col)
    ids = docs.sparkSession.createDataFrame(sorted(set(d for d, _ in picked)), src.schema["doc_id"].dataType).toDF("doc_id")
    wanted = src.join(F.broadcast(ids), "doc_id", "left_semi")  # of max_rows ids at most

    def kernel(chunk: pa.RecordBatch) -> dict:
        out = {"doc_id": chunk.column("doc_id"), "i": [], "v": [], "ci": [], "cv": [], "least": []}
        for text in chunk.column("text").to_pylist():
            other = changed(text) if changed else None
            for k, x in (("", features(text)), ("c", features(other) if other is not None else (None, None))):
                out[k + "i"].append(None if x[0] is None else x[0].astype("<i4").tobytes())
                out[k + "v"].append(None if x[1] is None else x[1].astype("<f4").tobytes())
            out["least"].append(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        return {k: pa.array(v, pa.binary()) if isinstance(v, list) else v for k, v in out.items()}

    id_type = src.schema["doc_id"].dataType.simpleString()
    found: dict = {}
    total = 0
    rows = map_texts(wanted, kernel, f"doc_id {id_type}, i binary, v binary, ci binary, cv binary, least binary")
    rows = rows.groupBy("doc_id").agg(*(F.min_by(c, "least").alias(c) for c in ("i", "v", "ci", "cv")))
    rows, path = written(rows.withColumn("turn", order), "labelled-features")  # of max_rows ids, worked out once
    for r in rows.orderBy("turn", "doc_id").toLocalIterator():
        x = np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f4")
        c = None if r["ci"] is None else (np.frombuffer(r["ci"], "<i4"), np.frombuffer(r["cv"], "<f4"))
        total += len(x[0]) + (len(c[0]) if c else 0)
        if total > max_features:
            break
        found[r["doc_id"]] = x, c
    delete_path(docs.sparkSession, path)
    picked = [(d, y) for d, y in picked if d in found]
    # one class after the other would calibrate badly: in the order of the hash, which is that of ``found``
    place = {d: k for k, d in enumerate(found)}
    picked.sort(key=lambda p: (place[p[0]], p[1]))
    return Sample([found[d][0] for d, _ in picked], [found[d][1] for d, _ in picked], np.array([y for _, y in picked], np.int64))


def split_sample(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to fit and places to calibrate, each class dealt in turn; with few rows of a class all are in both."""
    fit, calibrate = [], []
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        if len(own) < 2 * CALIBRATE_EVERY:
            fit.append(own)
            calibrate.append(own)
        else:
            fit.append(own[np.arange(len(own)) % CALIBRATE_EVERY != 0])
            calibrate.append(own[::CALIBRATE_EVERY])
    return np.sort(np.concatenate(fit)), np.sort(np.concatenate(calibrate))


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) is the likelihood of label 1: Platt's targets, Newton's method; classes weigh alike."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return 1.0, (np.log((n1 + 1) / (n0 + 1)) - (float(margins.mean()) if len(margins) else 0.0))
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * (n1 + n0)
    scale = float(np.abs(margins).max()) or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-6 * (t @ t))

    theta, now = np.array([1.0, 0.0]), None
    for _ in range(100):
        now = loss(theta)
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -60, 60)))
        grad = x.T @ (weight * (p - target)) + 2e-6 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step, t = np.linalg.solve(hess, grad), 1.0
        while t > 1e-6 and loss(theta - t * step) > now:
            t /= 2
        theta = theta - t * step
        if now - loss(theta) < 1e-9:
            break
    return max(float(theta[0] / scale), 1e-9), float(theta[1])


@dataclass
class Linear:
    """score = 1 / (1 + exp(-(a * (weights . x) + b))); ``weights`` is dense and of a fixed size."""

    weights: np.ndarray
    a: float
    b: float

    def score(self, x: Features) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * float(self.weights[x[0]] @ x[1]) + self.b, -500, 500))))


def scored(docs: DataFrame, model: Linear, features: Callable[[str], Features], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model is broadcast (its size is fixed by the number of hash buckets)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = texts_of(docs, id_col, text_col)

    def kernel(chunk: pa.RecordBatch) -> dict:
        own = shared.value
        return {"doc_id": chunk.column("doc_id"), "score": pa.array([own.score(features(t)) for t in chunk.column("text").to_pylist()], pa.float64())}

    return map_texts(src, kernel, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def kept(docs: DataFrame, model: Linear, features: Callable[[str], Features], threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda chunk: [shared.value.score(features(t or "")) >= threshold for t in chunk.column(text_col).to_pylist()], text_col)
