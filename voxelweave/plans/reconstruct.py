"""Reconstruction: expand, maximize, compress, in turns.

The relational operators say what each step computes; this loop runs the two large steps packed. A shot is one row of its pixels; the density (packed over
its mask), the pixel vectors and the rotations are broadcast, and a NumPy kernel gives (shot, r, logr) or its part of the density gradient. What is
broadcast is bounded: the density and its mask by the grid (``max_voxels``), pixels by the detector, rotations by the grid of the search; all are checked. The number of
shots is not bounded: shots are only ever streamed, and gradients are summed by tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.config import Grid
from voxelweave.functions.scalars import EPSILON
from voxelweave.operators import grid as g
from voxelweave.operators import likelihood, update
from voxelweave.session import cut


#: Pixels of the shots that a task holds as arrays at once (one shot at least).
PIXELS_HELD = 20_000_000


@dataclass
class Scene:
    """What every kernel needs: pixels and rotations as arrays, the packed mask as voxel -> place or -1."""

    grid: Grid
    t: np.ndarray
    q: np.ndarray
    rotations: dict
    places: np.ndarray
    n: int
    _sent: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sent": None}

    def sent(self, spark):
        """The broadcast of this scene: one for all kernels that take it."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        return self._sent

    def forget(self) -> None:
        if self._sent is not None:
            self._sent.destroy()
            self._sent = None

    @staticmethod
    def collect(pixels: DataFrame, rotations: DataFrame, mask: DataFrame, grid: Grid, max_bytes: int = 1 << 30) -> Scene:
        """Raises if pixels, rotations or the grid's places are over ``max_bytes`` as arrays; nothing is cut. They come to the driver as Arrow columns, never as rows."""
        trusted = pixels.filter("trusted").select("t", *g.QS)
        for what, rows, size in (("pixels", trusted.count(), 32), ("rotations", rotations.count(), 80), ("voxels", grid.n ** 3, 8)):
            if rows * size > max_bytes:
                raise ValueError(f"{rows} {what} are over {max_bytes} bytes")
        px, rot = trusted.toArrow(), rotations.select("r", *(f"m{i}{j}" for i in range(3) for j in range(3))).toArrow()
        columns = lambda t, names: np.stack([t.column(c).to_numpy() for c in names], 1).reshape(-1, len(names))
        t = px.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        vox = np.unique(mask.select("vox").toArrow().column("vox").to_numpy()).astype(np.int64)
        places = np.full(grid.n ** 3, -1, np.int64)
        places[vox] = np.arange(len(vox))
        mats = columns(rot, rot.column_names[1:]).reshape(-1, 3, 3)
        return Scene(grid, t[order], columns(px, g.QS)[order], dict(zip(rot.column("r").to_pylist(), mats)), places, len(vox))

    def weights(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pixels in bounds, their eight packed voxels or -1, trilinear weights)."""
        n = self.grid.n
        f = (self.q @ self.rotations[r].T - self.grid.corner) / self.grid.delta
        i = np.floor(f).astype(np.int64)
        ok = np.flatnonzero(((i >= 0) & (i <= n - 2)).all(axis=1))
        i, d = i[ok], (f[ok] - i[ok])
        vox, a = [], []
        for x in (0, 1):
            for y in (0, 1):
                for z in (0, 1):
                    vox.append(((i[:, 0] + x) * n + i[:, 1] + y) * n + i[:, 2] + z)
                    a.append((d[:, 0] if x else 1 - d[:, 0]) * (d[:, 1] if y else 1 - d[:, 1]) * (d[:, 2] if z else 1 - d[:, 2]))
        return ok, self.places[np.stack(vox, 1)], np.stack(a, 1)


def packed_shots(shot_px: DataFrame, shots: DataFrame, prob_rot: DataFrame) -> DataFrame:
    """(shot, phi, t, k, b, rots): one row a shot, pixels in the order of t. A row is as large as the detector."""
    px = shot_px.groupBy("shot").agg(F.sort_array(F.collect_list(F.struct("t", "k", "b"))).alias("p"))
    rots = prob_rot.groupBy("shot").agg(F.sort_array(F.collect_set("r")).alias("rots"))
    return shots.select("shot", "phi").join(px, "shot").join(rots, "shot").select("shot", "phi", F.col("p.t").alias("t"), F.col("p.k").alias("k"), F.col("p.b").alias("b"), "rots")


def _on_scene(scene: Scene, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values of a shot's pixels in the order of the scene's; NaN where the shot has none."""
    out = np.full(len(scene.t), np.nan)
    at = np.searchsorted(scene.t, t)
    at = np.minimum(at, max(0, len(scene.t) - 1))
    hit = scene.t[at] == t if len(scene.t) else np.zeros(len(t), bool)
    out[at[hit]] = v[hit]
    return out


def _by_rotation(scene: Scene, batches: Iterator[pa.RecordBatch], wanted: str) -> Iterator[tuple]:
    """(rotation, pixels in bounds, voxels, weights, [(shot, phi, k, b, value)]): shots in slices of at most PIXELS_HELD pixels, each rotation of a slice worked out once for all its shots.

    ``wanted`` is a column of lists of rotations, or of (r, p) with p as the value.
    """
    for batch in batches:
        many = batch.column("t").value_lengths().to_numpy(zero_copy_only=False) + len(scene.t)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(many[start:]), PIXELS_HELD, side="right")))
            by: dict[int, list] = {}
            for i in range(start, stop):
                t, k, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("t", "k", "b"))
                shot = batch.column("shot")[i].as_py(), batch.column("phi")[i].as_py(), _on_scene(scene, t, k.astype(float)), _on_scene(scene, t, b.astype(float))
                for r in batch.column(wanted)[i].as_py():
                    r, value = (r["r"], r["p"]) if isinstance(r, dict) else (r, None)
                    by.setdefault(r, []).append((*shot, value))
            for r, shots in by.items():
                yield r, *scene.weights(r), shots
            start = stop


def packed_log_likelihood(packed: DataFrame, scene: Scene, density: np.ndarray) -> DataFrame:
    """(shot, r, logr) by the kernel; agrees with the relational form."""
    spark = packed.sparkSession
    shared, w = scene.sent(spark), spark.sparkContext.broadcast(density)

    def run(batches):
        s, values = shared.value, np.append(w.value, 0.0)
        out = ([], [], [])
        for r, ok, vox, a, shots in _by_rotation(s, batches, "rots"):
            own = (values[vox] * a).sum(axis=1)
            for shot, phi, k, b, _ in shots:
                m = b[ok] + phi * own
                use = m > -EPSILON  # false for NaN
                for column, x in zip(out, (shot, r, float((k[ok][use] * np.log(m[use] + EPSILON) - m[use]).sum()))):
                    column.append(x)
            if len(out[0]) > 10_000:
                yield _scores(out)
                out = ([], [], [])
        yield _scores(out)

    return packed.mapInArrow(run, "shot int, r int, logr double")


def _scores(out: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.float64()))], ["shot", "r", "logr"])


def packed_objective(packed: DataFrame, p: DataFrame, scene: Scene, density: np.ndarray, least: float = 1e-5) -> tuple[float, np.ndarray]:
    """(sum of p logr, its gradient by the packed density). Each task sends one sum; Spark adds them by place, so the driver gets one number for each voxel."""
    return chosen_objective(with_chosen(packed, p, least), scene, density)


def with_chosen(packed: DataFrame, p: DataFrame, least: float = 1e-5) -> DataFrame:
    """(shot, phi, t, k, b, chosen): packed shots with the rotations, and their probabilities, that count."""
    chosen = p.filter(F.col("p") >= least).groupBy("shot").agg(F.collect_list(F.struct("r", "p")).alias("chosen"))
    return packed.drop("rots").join(chosen, "shot")


def chosen_objective(chosen: DataFrame, scene: Scene, density: np.ndarray) -> tuple[float, np.ndarray]:
    """As ``packed_objective``, of what ``with_chosen`` gives: a scan and a sum by place, for many evaluations of one set of probabilities."""
    spark = chosen.sparkSession
    shared, w = scene.sent(spark), spark.sparkContext.broadcast(density)

    def run(batches):
        s, values = shared.value, np.append(w.value, 0.0)
        total, grad = 0.0, np.zeros(s.n + 1)
        for _, ok, vox, a, shots in _by_rotation(s, batches, "chosen"):
            own, e = (values[vox] * a).sum(axis=1), np.zeros(len(ok))
            for _, phi, k, b, p in shots:
                m = b[ok] + phi * own
                use = m > -EPSILON
                kk, mm = k[ok][use], m[use]
                total += p * float((kk * np.log(mm + EPSILON) - mm).sum())
                e[use] += p * (kk * phi / (mm + EPSILON) - phi)
            grad += np.bincount((vox % (s.n + 1)).ravel(), (a * e[:, None]).ravel(), s.n + 1)  # shots are added up before they are spread
        at = np.flatnonzero(grad[:s.n])
        place = np.concatenate(([-1], at))
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "g": pa.array(np.concatenate(([total], grad[at])), pa.float64())})

    found = chosen.mapInArrow(run, "place long, g double").groupBy("place").agg(F.sum("g").alias("g")).toArrow()
    w.destroy()
    place, value = found.column("place").to_numpy(), found.column("g").to_numpy()
    out = np.zeros(scene.n)
    out[place[place >= 0]] = value[place >= 0]
    return float(value[place < 0].sum()), out


def lbfgs(fun, x: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, list[float]]:
    """Minimise fun(x) -> (value, gradient) by the two-loop recursion with backtracking; returns x and the values on the way. Without ``memory`` it is a line search down the gradient."""
    f, grad = fun(x)
    values, pairs = [f], []
    for _ in range(steps):
        d = -grad
        alphas = []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(pairs, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        slope = float(grad @ d)
        if slope >= -1e-14 * max(1.0, abs(f)):
            break
        step = 1.0
        while True:
            new = x + step * d
            f_new, g_new = fun(new)
            if f_new <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if f_new > f:
            break
        s, y = new - x, g_new - grad
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs = [*pairs, (s, y)][-memory:] if memory else []
        done = f - f_new <= 1e-10 * max(1.0, abs(f))
        x, f, grad = new, f_new, g_new
        values.append(f)
        if done:
            break
    return x, values


def density_step(packed: DataFrame, p: DataFrame, scene: Scene, density: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, list[float]]:
    """A positive density of higher probable likelihood: L-BFGS in the free parameter x, w = sqrt(x² + 1) - 1."""
    floor = min(1e-7, density[density > 0].min()) if (density > 0).any() else 1e-7
    x = np.sqrt((np.where(density > 0, density, floor) + 1) ** 2 - 1)

    chosen = cut(with_chosen(packed, p))  # stored once, so an evaluation shuffles no pixels

    def objective(x):
        root = np.sqrt(x * x + 1)
        value, grad = chosen_objective(chosen, scene, root - 1)
        return -value, -grad * x / root

    x, values = lbfgs(objective, x, steps, memory)
    return np.sqrt(x * x + 1) - 1, [-v for v in values]


def to_voxels(spark, scene: Scene, density: np.ndarray) -> DataFrame:
    vox = np.flatnonzero(scene.places >= 0)
    return spark.createDataFrame(pa.table({"vox": pa.array(vox, pa.int32()), "w": pa.array(density, pa.float64())}))


def to_density(scene: Scene, voxels: DataFrame) -> np.ndarray:
    """Packed over the mask; a voxel that is absent is 0."""
    out = np.zeros(scene.n)
    found = voxels.select("vox", "w").toArrow()  # the grid's size, checked before
    place = scene.places[found.column("vox").to_numpy()]
    out[place[place >= 0]] = found.column("w").to_numpy()[place >= 0]
    return out


def run(pixels: DataFrame, rotations: DataFrame, shot_px: DataFrame, shots: DataFrame, prob_rot: DataFrame, voxels: DataFrame, mask: DataFrame, grid: Grid, iterations: int,
        symops: DataFrame | None = None, beta: float = 1.0, min_p: float = 0.0, method: str = "lbfgs", steps: int = 3, refine_scales: bool = False, scale_method: str = "analytical", on_iteration=None) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(voxels, shots, history). Odd iterations after the fourth update scales if ``refine_scales``; all others update the density, by ``method``: lbfgs or
    line_search or analytical; scales by ``scale_method``: analytical or likelihood. ``on_iteration(i, voxels, shots, p)`` may write snapshots. Every iteration starts from arrays on the driver and a scale table of its own, so plans do not grow."""
    spark = pixels.sparkSession
    scene = Scene.collect(pixels, rotations, mask, grid)
    density = to_density(scene, voxels)
    history = []
    pixels_of = cut(packed_shots(shot_px, shots, prob_rot))  # grouped and stored once; a new scale is joined to it
    packed = pixels_of
    for i in range(iterations):
        logr = packed_log_likelihood(packed, scene, density)
        p = likelihood.probabilities(logr, beta, min_p).persist()
        before = p.agg(F.sum(F.col("p") * F.col("logr"))).first()[0]
        entry = {"iteration": i, "functional": before}
        if refine_scales and i > 4 and i % 2:
            model = likelihood.model_values(pixels, rotations, to_voxels(spark, scene, density), grid, prob_rot)
            if scale_method == "likelihood":
                new = update.fitted_scales(likelihood.pixel_terms(model, shot_px, shots, prob_rot), p, shots)
            else:
                new = update.analytic_scales(p, model, shot_px, shots)
            shots = cut(new.select("shot", "phi"))
            packed = pixels_of.drop("phi").join(shots, "shot").select(*pixels_of.columns)
            entry["updated"] = "scales"
        else:
            if method in ("lbfgs", "line_search"):
                density, values = density_step(packed, p, scene, density, steps, 8 if method == "lbfgs" else 0)
                entry["after"] = values[-1]
            else:
                density = to_density(scene, update.compressed(update.tomograms(p, shot_px, shots), pixels, rotations, grid, None, False))
            if symops is not None:
                density = to_density(scene, g.friedel(g.symmetrize(to_voxels(spark, scene, density), symops, grid), grid))
            entry["updated"] = "density"
        history.append(entry)
        if on_iteration:
            on_iteration(i, to_voxels(spark, scene, density), shots, p)
        p.unpersist()
    scene.forget()
    return to_voxels(spark, scene, density), shots, history
