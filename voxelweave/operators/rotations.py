"""Rotation grids: subdivided 600-cell quaternions with Voronoi-like weights, and their icosahedral reduction."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.orient import quaternion_matrix

GOLDEN = (1 + 5 ** 0.5) / 2
#: Weights of points of the first two kinds (vertices, points of edges) relative to those inside of faces and cells.
VERTEX_SHARE, EDGE_SHARE = 5 / 6, 35 / 36


def grid_size(n: int) -> int:
    """Rotations of the grid of n subdivisions."""
    return 10 * (5 * n ** 3 + n)


@lru_cache(4)
def vertices() -> np.ndarray:
    """The 120 vertices of the 600-cell, as unit quaternions with the scalar first."""
    out = [tuple(s if k == i else 0.0 for k in range(4)) for i in range(4) for s in (1.0, -1.0)]
    out += list(itertools.product((0.5, -0.5), repeat=4))
    even = [p for p in itertools.permutations(range(4)) if sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4)) % 2 == 0]
    for p in even:
        for a, b, c in itertools.product((1, -1), repeat=3):
            v = (a * GOLDEN / 2, b / 2, c / (2 * GOLDEN), 0.0)
            out.append(tuple(v[p[k]] for k in range(4)))
    return np.array(out)


@lru_cache(4)
def simplices() -> tuple[np.ndarray, ...]:
    """Vertices, edges, faces and cells of the 600-cell as numbers of vertices, one of each pair of opposites: 60, 360, 600 and 300 rows."""
    v = vertices()
    near = v @ v.T > 0.8  # neighbours are 36 degrees apart
    opposite = (v @ v.T).argmin(axis=1)
    kinds = [np.arange(len(v))[:, None]]
    for _ in range(3):  # add a vertex of a higher number that is a neighbour of all
        last = kinds[-1]
        common = near[last].all(axis=1) & (np.arange(len(v)) > last[:, -1:])
        row, new = np.nonzero(common)
        kinds.append(np.concatenate((last[row], new[:, None]), axis=1))
    out = []
    for rows in kinds:
        other = np.sort(opposite[rows], axis=1)
        # of two opposites, the one that is first in the order of numbers
        at = (rows != other).argmax(axis=1)
        i = np.arange(len(rows))
        out.append(rows[rows[i, at] < other[i, at]])
    return tuple(out)


def inner_parts(n: int, k: int) -> np.ndarray:
    """All ways to write ``n`` as a sum of ``k`` positive numbers, in order."""
    if k == 1:
        return np.full((1, 1), n)
    cuts = np.array(list(itertools.combinations(range(1, n), k - 1)), int).reshape(-1, k - 1)
    ends = np.concatenate((np.zeros((len(cuts), 1), int), cuts, np.full((len(cuts), 1), n)), axis=1)
    return np.diff(ends, axis=1)


def inner_points(members: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(quaternions, weights) of the points inside of simplices of one kind (rows of ``members``), simplex by simplex; weights are not normalised.

    A point's weight is its kind's share times its distance from the origin before it is normalised, to the minus fourth power: the density of the projection.
    """
    k = members.shape[1]
    flat = np.einsum("pk,skc->spc", inner_parts(n, k) / n, vertices()[members]).reshape(-1, 4)
    square = np.einsum("pc,pc->p", flat, flat)
    q = flat / np.sqrt(square)[:, None]
    first = np.take_along_axis(q, (np.abs(q) > 1e-9).argmax(axis=1)[:, None], axis=1)
    return np.where(first < 0, -q, q), {1: VERTEX_SHARE, 2: EDGE_SHARE}.get(k, 1.0) / (square * square)


def total_weight(n: int) -> float:
    """The sum of weights over a grid: all simplices of a kind are alike, so one of each is worked out."""
    return float(sum(len(rows) * inner_points(rows[:1], n)[1].sum() for rows in simplices()))


def quaternion_grid(n: int) -> np.ndarray:
    """(rotations, 5): unit quaternions, scalar first and one of each pair of opposites (the first part that is not zero is positive), and weights of sum 1.

    Points of the cells are combinations of their vertices by multiples of 1 / n. A point belongs to the one vertex, edge, face or cell that it is inside of, so none comes twice.
    """
    parts = [np.concatenate((q, w[:, None]), axis=1) for q, w in (inner_points(rows, n) for rows in simplices())]
    out = np.concatenate(parts)
    out[:, 4] /= out[:, 4].sum()
    return out


QUATERNION_SCHEMA = "r int, q0 double, q1 double, q2 double, q3 double, weight double"


def rotation_grid(spark: SparkSession, n: int) -> DataFrame:
    """(r, q0..q3, weight) of a grid, q0 the scalar. The 1320 simplices are dealt out and each makes its points where it is, so no list of rotations is ever on the driver."""
    starts, total, first = [], total_weight(n), 0
    for kind, rows in enumerate(simplices()):
        size = comb(n - 1, kind)
        starts += [(kind, at, first + at * size) for at in range(len(rows) if size else 0)]
        first += len(rows) * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, w = inner_points(simplices()[row["kind"]][row["at"]:row["at"] + 1], n)
                r = np.arange(row["first"], row["first"] + len(q))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), *(pa.array(q[:, k]) for k in range(4)), pa.array(w / total)], ["r", "q0", "q1", "q2", "q3", "weight"])

    tasks = max(1, min(len(starts), grid_size(n) // 100_000))
    return spark.createDataFrame(starts, "kind int, at int, first long").repartition(tasks).mapInArrow(run, QUATERNION_SCHEMA)


def matrices(quaternions: DataFrame) -> DataFrame:
    """(r, m00..m22, weight): transposes of the rotations of quaternions (r, q0..q3, weight), as the grid operators take them."""
    m = quaternion_matrix(F.col("q1"), F.col("q2"), F.col("q3"), F.col("q0"))
    return quaternions.select("r", *(m[3 * j + i].alias(f"m{i}{j}") for i in range(3) for j in range(3)), "weight")


def icosahedral_rotations() -> np.ndarray:
    """The 60 rotations of the icosahedron, as quaternions: the vertices of the 600-cell, one of each pair of opposites."""
    v = vertices()
    sign = np.array([next(x for x in row if abs(x) > 1e-9) for row in v])
    return v[sign > 0]


def reduced(quaternions: DataFrame, decimals: int = 9) -> DataFrame:
    """(r, q0..q3, weight): one rotation of each orbit under the icosahedron's (that of the largest |scalar| after rounding, ties by the least r), with
    the orbit's weight. A row finds its orbit by itself: the key is the largest of its sixty images."""
    ops = icosahedral_rotations()
    q = [F.col(f"q{k}") for k in range(4)]
    images = []
    for a, b, c, d in ops.tolist():  # q times each rotation, with a positive first component
        p = [q[0] * a - q[1] * b - q[2] * c - q[3] * d, q[0] * b + q[1] * a + q[2] * d - q[3] * c, q[0] * c - q[1] * d + q[2] * a + q[3] * b, q[0] * d + q[1] * c - q[2] * b + q[3] * a]
        images.append(F.array(*p))
    rounded = F.transform(F.array(*images), lambda p: F.transform(p, lambda x: F.round(x, decimals) + 0.0))
    first = lambda p: F.element_at(F.filter(F.concat(p, F.array(F.lit(1.0))), lambda x: x != 0), 1)
    upright = F.transform(rounded, lambda p: F.when(first(p) < 0, F.transform(p, lambda x: 0.0 - x)).otherwise(p))
    keyed = quaternions.withColumn("orbit", F.array_max(upright))
    best = keyed.groupBy("orbit").agg(F.max(F.struct(F.round(F.abs("q0"), decimals).alias("c"), (-F.col("r")).alias("r"), "q0", "q1", "q2", "q3")).alias("best"), F.sum("weight").alias("weight"))
    return best.select((-F.col("best.r")).cast("int").alias("r"), *(F.col(f"best.q{k}").alias(f"q{k}") for k in range(4)), "weight")
