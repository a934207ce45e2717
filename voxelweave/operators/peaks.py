"""Peak integration and merging of Miller indices."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.config import Grid, symmetry_matrices
from voxelweave.operators.grid import around_peaks, interpolate, kernel_offsets, nearest_voxels

HKL = ["h", "k", "l"]


def integrate_cross(hkls: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """(h, k, l, i): the nearest voxel and its six face neighbours, summed. A neighbour before the first plane is that of the last; peaks on the last plane are left out."""
    n = grid.n
    peaks = nearest_voxels(hkls, grid).filter(f"ix < {n - 1} AND iy < {n - 1} AND iz < {n - 1}")
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]))
    at = peaks.select(*HKL, "ix", "iy", "iz", F.inline(steps))
    wrap = lambda i, d: F.pmod(F.col(i) + F.col(d), F.lit(n))
    vox = ((wrap("ix", "dx") * n + wrap("iy", "dy")) * n + wrap("iz", "dz")).cast("int")
    return at.select(*HKL, vox.alias("vox")).join(voxels.select("vox", "w"), "vox", "left").groupBy(*HKL).agg(F.sum(F.coalesce("w", F.lit(0.0))).alias("i"))


def integrate_kernel(hkls: DataFrame, voxels: DataFrame, grid: Grid, iterations: int = 1, connectivity: int = 2, how: str = "sum") -> DataFrame:
    """(h, k, l, i): sum or max over the structuring element around the nearest voxel; peaks whose element leaves the grid are left out."""
    around = around_peaks(nearest_voxels(hkls, grid), voxels, grid, kernel_offsets(connectivity, iterations), HKL)
    return around.groupBy(*HKL).agg({"sum": F.sum, "max": F.max}[how]("w").alias("i"))


def integrate_linear(hkls: DataFrame, voxels: DataFrame, grid: Grid) -> DataFrame:
    """(h, k, l, i): the trilinear value at each index in bounds."""
    return interpolate(hkls, voxels, grid, HKL).withColumnRenamed("w", "i")


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of a dense array, mirrored at its ends: along each axis, neighbours weighted 1/6, 4/6, 1/6 give the values back."""
    out = np.asarray(values, float)
    for axis in range(out.ndim):
        n = out.shape[axis]
        if n < 2:
            continue
        lines = np.moveaxis(out, axis, 0).reshape(n, -1)
        lower, upper = np.full(n, 1 / 6), np.full(n, 1 / 6)
        upper[0], lower[-1] = 2 / 6, 2 / 6
        # elimination in one sweep down and one up, for all lines of the axis together
        ratio, c = np.zeros(n), np.zeros_like(lines)
        ratio[0], c[0] = upper[0] / (4 / 6), lines[0] / (4 / 6)
        for i in range(1, n):
            pivot = 4 / 6 - lower[i] * ratio[i - 1]
            ratio[i], c[i] = upper[i] / pivot, (lines[i] - lower[i] * c[i - 1]) / pivot
        for i in range(n - 2, -1, -1):
            c[i] -= ratio[i] * c[i + 1]
        out = np.moveaxis(c.reshape(np.moveaxis(out, axis, 0).shape), 0, axis)
    return out


def spline_values(coefficients: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline at places (rows of voxel coordinates) within the array; 0 outside of it."""
    n = np.array(coefficients.shape)
    inside = ((at >= 0) & (at <= n - 1)).all(axis=1)
    base = np.floor(at).astype(int)
    d = at - base
    weights = np.stack([(1 - d) ** 3 / 6, (3 * d ** 3 - 6 * d ** 2 + 4) / 6, (3 * (1 - d) ** 3 - 6 * (1 - d) ** 2 + 4) / 6, d ** 3 / 6], axis=2)
    out = np.zeros(len(at))
    for offsets in itertools.product(range(4), repeat=3):
        i = base + np.array(offsets) - 1
        i = np.abs(i)
        i = np.where(i > n - 1, 2 * (n - 1) - i, i)
        i = np.clip(i, 0, n - 1)
        out += coefficients[i[:, 0], i[:, 1], i[:, 2]] * weights[:, 0, offsets[0]] * weights[:, 1, offsets[1]] * weights[:, 2, offsets[2]]
    return np.where(inside, out, 0.0)


def integrate_spline(hkls: DataFrame, voxels: DataFrame, grid: Grid, max_voxels: int = 1 << 27) -> DataFrame:
    """(h, k, l, i): the cubic spline through the voxels at each index. The coefficients of a whole grid depend on one another, so it is packed and broadcast; a
    grid of more than ``max_voxels`` raises."""
    if grid.n ** 3 > max_voxels:
        raise ValueError(f"a grid of {grid.n} a side is over {max_voxels} voxels")
    dense = np.zeros(grid.n ** 3)
    found = voxels.select("vox", "w").toArrow()
    dense[found.column("vox").to_numpy()] = found.column("w").to_numpy()
    shared = hkls.sparkSession.sparkContext.broadcast(spline_coefficients(dense.reshape((grid.n,) * 3)))
    corner, delta = grid.corner, grid.delta

    def run(batches):
        for b in batches:
            at = (b[["qx", "qy", "qz"]].to_numpy() - corner) / delta
            yield b[HKL].assign(i=spline_values(shared.value, at))

    return hkls.select(*HKL, "qx", "qy", "qz").mapInPandas(run, "h int, k int, l int, i double")


def fit_gaussian(box: np.ndarray, steps: int = 100) -> tuple[float, bool]:
    """(amplitude, success) of A exp(-x²/2sx² - y²/2sy² - z²/2sz²) about the middle of a box of odd sides, by damped Gauss-Newton in log parameters."""
    axes = np.meshgrid(*(np.arange(s) - s // 2 for s in box.shape), indexing="ij")
    sq = np.stack([a.ravel() ** 2 / 2.0 for a in axes])
    y = box.ravel()
    theta = np.log([max(np.percentile(y, 95), 1e-10), *(0.2 * s for s in box.shape)])

    def model(t):
        return np.exp(t[0] - (sq * np.exp(-2 * t[1:])[:, None]).sum(axis=0))

    damp, loss = 1e-3, float(((model(theta) - y) ** 2).sum())
    for _ in range(steps):
        m = model(theta)
        jac = np.stack([m, *(m * 2 * sq[k] * np.exp(-2 * theta[k + 1]) for k in range(3))], axis=1)
        grad, hess = jac.T @ (m - y), jac.T @ jac
        if not np.isfinite(hess).all():
            return 0.0, False
        while damp < 1e12:
            step = np.linalg.solve(hess + damp * (np.diag(np.diag(hess)) + 1e-12 * np.eye(4)), grad)
            new = theta - np.clip(step, -2, 2)
            new_loss = float(((model(new) - y) ** 2).sum())
            if new_loss <= loss:
                break
            damp *= 10
        else:
            return float(np.exp(theta[0])), True
        done = loss - new_loss <= 1e-12 * max(loss, 1e-300)
        theta, loss, damp = new, new_loss, max(damp / 10, 1e-12)
        if done:
            return float(np.exp(theta[0])), True
    return 0.0, False


def integrate_fit(hkls: DataFrame, voxels: DataFrame, grid: Grid, reach: int = 2) -> DataFrame:
    """(h, k, l, i): the amplitude of a Gaussian fitted to the box of ``reach`` voxels around the nearest voxel, 0 where the fit fails. A group is one box."""
    side = 2 * reach + 1
    offsets = [(x, y, z) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1) for z in range(-reach, reach + 1)]

    def run(pdf):
        import pandas as pd

        box = np.zeros((side,) * 3)
        box[pdf["dx"] + reach, pdf["dy"] + reach, pdf["dz"] + reach] = pdf["w"]
        amplitude, ok = fit_gaussian(box)
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in HKL}, "i": [amplitude if ok else 0.0]})

    around = around_peaks(nearest_voxels(hkls, grid), voxels, grid, offsets, HKL)
    return around.groupBy(*HKL).applyInPandas(run, "h int, k int, l int, i double")


def asymmetric_index(group: str) -> list[Column]:
    """The representative of (h, k, l) under a group's rotations and Friedel's law: the largest equivalent."""
    images = []
    for m in symmetry_matrices(group):
        for sign in (1, -1):
            images.append(F.struct(*((sum((int(sign * m[j][i]) * F.col(HKL[j]) for j in range(3) if m[j][i]), F.lit(0))).cast("int").alias(HKL[i]) for i in range(3))))
    top = F.array_max(F.array(*images))
    return [top[c].alias(c) for c in HKL]


def merge_equivalents(table: DataFrame, group: str) -> DataFrame:
    """(h, k, l, n, i): the mean over symmetry equivalents and Friedel mates."""
    return table.select(*asymmetric_index(group), "i").groupBy(*HKL).agg(F.count("*").alias("n"), F.avg("i").alias("i"))


def merge_mates(table: DataFrame) -> DataFrame:
    """(h, k, l, n, i): the mean over Friedel mates."""
    return merge_equivalents(table, "P1")


def common(one: DataFrame, two: DataFrame) -> DataFrame:
    """(h, k, l, i1, i2) of indices in both."""
    return one.select(*HKL, F.col("i").alias("i1")).join(two.select(*HKL, F.col("i").alias("i2")), HKL)


def same_indices(tables: list[DataFrame]) -> DataFrame:
    """(h, k, l) that all tables have."""
    out = tables[0].select(*HKL)
    for t in tables[1:]:
        out = out.intersect(t.select(*HKL))
    return out.distinct()


def init_from_amplitudes(amplitudes: DataFrame, group: str, hkls: DataFrame, grid: Grid, reach: int, sigma: float) -> DataFrame:
    """(vox, w): Gaussian peaks of the squared amplitudes (h, k, l, f), given for representatives, at every equivalent index on the grid."""
    from voxelweave.operators.grid import paint_peaks

    every = nearest_voxels(hkls, grid).select(*HKL, "ix", "iy", "iz")
    keyed = every.select(F.struct(*asymmetric_index(group)).alias("key"), "ix", "iy", "iz")
    known = amplitudes.select(F.struct(*asymmetric_index(group)).alias("key"), "f").dropDuplicates(["key"])
    return paint_peaks(keyed.join(known, "key"), grid, reach, sigma)
