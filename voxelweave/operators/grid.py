"""Voxel grids: interpolation, insertion, masks, symmetry. Voxels are rows (vox, w); an absent row is a masked voxel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.config import Cell, Grid, symmetry_matrices
from voxelweave.functions.scalars import errdiv, matrix_columns, round_half_down, times_vector
from voxelweave.operators.order import ranked

QS = ("qx", "qy", "qz")
#: Rotations (of some hundred bytes each) that are broadcast.
MOST_ROTATIONS = 500_000


def place(q: Column, grid: Grid) -> Column:
    """In units of voxels from the centre of the first one."""
    return (q - grid.corner) / grid.delta


def in_bounds(qs: list[Column], grid: Grid) -> Column:
    """Whether all eight voxels around a point exist: floor of its place in [0, n - 2] on each axis."""
    ok = F.lit(True)
    for q in qs:
        i = F.floor(place(q, grid))
        ok = ok & (i >= 0) & (i <= grid.n - 2)
    return ok


def rotated(pixels: DataFrame, rotations: DataFrame, on=None) -> DataFrame:
    """Pixels (t, qx, qy, qz, ...) in the frame of each rotation (r, m00..m22): q becomes m q.

    The pairing is what is asked for. A grid of at most MOST_ROTATIONS (counted here) is broadcast, and the pixels stay where they are, however many; a
    larger one is paired block by block, partition against partition, so that neither side is ever in one place."""
    if on is None:
        small = rotations.limit(MOST_ROTATIONS + 1).count() <= MOST_ROTATIONS
        both = pixels.crossJoin(F.broadcast(rotations) if small else rotations)
    else:
        both = pixels.join(rotations, on)
    q = F.struct(*(x.alias(n) for x, n in zip(times_vector(matrix_columns(), [F.col(c) for c in QS]), ("ux", "uy", "uz"))))
    keep = [c for c in both.columns if c not in QS and not (len(c) == 3 and c[0] == "m" and c[1:].isdigit())]
    # a generator keeps the rotation from being repeated in each of the six comparisons that follow
    return both.select(*keep, F.inline(F.array(q))).withColumnsRenamed({"ux": "qx", "uy": "qy", "uz": "qz"})


def corners(points: DataFrame, grid: Grid) -> DataFrame:
    """Points (.., qx, qy, qz) within bounds, one row for each of the eight voxels around them: vox, and a, its trilinear weight."""
    qs = [F.col(c) for c in QS]
    keep = [c for c in points.columns if c not in QS]
    f = [place(q, grid) for q in qs]
    at = F.struct(*(F.floor(x).cast("int").alias(f"i{k}") for k, x in enumerate(f)), *((x - F.floor(x)).alias(f"r{k}") for k, x in enumerate(f)))
    cells = points.select(*keep, F.inline(F.array(at))).filter(" AND ".join(f"i{k} BETWEEN 0 AND {grid.n - 2}" for k in range(3)))
    eight = []
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                vox = ((F.col("i0") + dx) * grid.n + F.col("i1") + dy) * grid.n + F.col("i2") + dz
                weight = F.lit(1.0)
                for k, d in enumerate((dx, dy, dz)):
                    weight = weight * (F.col(f"r{k}") if d else 1 - F.col(f"r{k}"))
                eight.append(F.struct(vox.cast("int").alias("vox"), weight.alias("a")))
    return cells.select(*keep, F.inline(F.array(*eight)))


def interpolate(points: DataFrame, voxels: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, w) of points within bounds: the trilinear value of ``voxels`` there; absent voxels are 0."""
    found = corners(points.select(*keys, *QS), grid).join(voxels.select("vox", "w"), "vox", "left")
    return found.groupBy(*keys).agg(F.sum(F.col("a") * F.coalesce("w", F.lit(0.0))).alias("w"))


def insert(points: DataFrame, value: Column, grid: Grid, weight: Column | None = None) -> DataFrame:
    """(vox, num, den, w): points (qx, qy, qz) spread over the voxels around them by trilinear weight; w = num / den, 0 where den <= 0.

    num and den are sums, so results of parts of the points can be added."""
    named = points.select(*QS, value.cast("double").alias("value"), (F.lit(1.0) if weight is None else weight).alias("weight"))
    sums = corners(named, grid).groupBy("vox").agg(F.sum(F.col("value") * F.col("a")).alias("num"), F.sum(F.col("weight") * F.col("a")).alias("den"))
    return normalized(sums)


def normalized(sums: DataFrame) -> DataFrame:
    return sums.withColumn("w", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0))


def insert_nearest(points: DataFrame, value: Column, grid: Grid) -> DataFrame:
    """(vox, counts, w): the mean value of the points in each voxel's bin. Bins are half-open, but for the last, which holds its upper edge."""
    cells = []
    for q in QS:
        i = F.floor((F.col(q) + grid.max_q) / grid.delta).cast("int")
        cells.append(F.when(F.col(q) == grid.max_q, grid.n - 1).otherwise(i))
    inside = F.lit(True)
    for c in cells:
        inside = inside & c.between(0, grid.n - 1)
    vox = ((cells[0] * grid.n + cells[1]) * grid.n + cells[2]).cast("int")
    return points.filter(inside).groupBy(vox.alias("vox")).agg(F.count("*").alias("counts"), F.avg(value).alias("w"))


def voxel_indices(vox: Column, grid: Grid) -> list[Column]:
    n = grid.n
    return [F.floor(vox / (n * n)).cast("int"), (F.floor(vox / n) % n).cast("int"), (vox % n).cast("int")]


def voxel_centres(voxels: DataFrame, grid: Grid) -> DataFrame:
    """``voxels`` with qx, qy, qz of their centres."""
    ijk = voxel_indices(F.col("vox"), grid)
    return voxels.select("*", *((i * grid.delta + grid.corner).alias(q) for i, q in zip(ijk, QS)))


def friedel(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(vox, w): the mean of each voxel and its mate through the origin; an absent one counts as 0."""
    last = grid.n ** 3 - 1
    both = voxels.select("vox", "w").unionByName(voxels.select((last - F.col("vox")).cast("int").alias("vox"), "w"))
    return both.groupBy("vox").agg((0.5 * F.sum("w")).alias("w"))


def symmetry_table(spark, group: str, cell: Cell | None = None) -> DataFrame:
    """(op_id, m00..m22): rotation parts of a space group's operations, in Cartesian axes. Cells that are not orthogonal need ``cell``."""
    mats = symmetry_matrices(group).astype(float)
    if cell is not None:
        o = cell.orthogonalization()
        mats = np.array([o @ m @ np.linalg.inv(o) for m in mats])
        mats = np.where(np.abs(mats) < 1e-12, 0.0, mats)
    names = ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3))
    return spark.createDataFrame([(k, *map(float, m.ravel())) for k, m in enumerate(mats)], f"op_id int, {names}")


def symmetrize(voxels: DataFrame, symops: DataFrame, grid: Grid) -> DataFrame:
    """(vox, w): every voxel's value inserted at its place under each operation, and normalised by weight.

    Points that land on or beyond the last voxel centre of an axis are out of bounds, so upper faces lose values."""
    moved = rotated(voxel_centres(voxels.select("vox", "w"), grid).withColumnRenamed("vox", "from_vox"), F.broadcast(symops))  # a group has 192 operations at most
    return insert(moved, F.col("w"), grid).select("vox", "w")


def sparse_rank(voxels: DataFrame) -> DataFrame:
    """(vox, place): the rank of each voxel by index, from 0, without one task for all."""
    return ranked(voxels.select("vox"), ["vox"])


def update_masked(voxels: DataFrame, new: DataFrame) -> DataFrame:
    """``voxels`` with the values of ``new`` (vox, w) where it has the voxel."""
    fresh = new.select("vox", F.col("w").alias("new_w"))
    return voxels.join(fresh, "vox", "left").select("vox", F.coalesce("new_w", "w").alias("w"))


def density_floor(voxels: DataFrame) -> DataFrame:
    """(vox, w) with zeros raised to the least positive value, 1e-7 at most."""
    least = voxels.filter("w > 0").agg(F.min("w").alias("least"))
    return voxels.join(F.broadcast(least)).select("vox", F.when(F.col("w") == 0, F.least(F.lit(1e-7), "least")).otherwise(F.col("w")).alias("w"))  # one row


def resolution(voxels: DataFrame, grid: Grid) -> DataFrame:
    """(vox, d): 1 / |q| of a voxel's centre, infinite at the origin."""
    c = voxel_centres(voxels.select("vox"), grid)
    size = F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))
    return c.select("vox", F.when(size > 0, F.try_divide(F.lit(1.0), size)).otherwise(F.lit(float("inf"))).alias("d"))


def shell(voxels: DataFrame, grid: Grid, high: float, low: float | None = None) -> DataFrame:
    """Voxels (vox, d) of resolution ``high`` or coarser, and ``low`` or finer if that is given."""
    d = resolution(voxels, grid).filter(F.col("d") >= high)
    return d.filter(F.col("d") <= low) if low is not None else d


# ---------------------------------------------------------------- Miller indices on the grid

def hkl_limits(cell: Cell, max_q: float) -> tuple[int, int, int]:
    """Largest index of each axis over the corners of the cube, cut towards zero."""
    signs = np.array([[a, b, c] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]) * max_q
    return tuple(int(x) for x in np.trunc((cell.to_hkl() @ signs.T).max(axis=1)))


def hkl_table(spark, cell: Cell, max_q: float) -> DataFrame:
    """(h, k, l, qx, qy, qz) of all Miller indices below the limits."""
    limits = hkl_limits(cell, max_q)
    axes = [spark.range(-m + 1, m).select(F.col("id").cast("int").alias(n)) for m, n in zip(limits, "hkl")]
    m = np.round(cell.from_hkl(), 8)
    hkl = axes[0].crossJoin(axes[1]).crossJoin(axes[2])  # the set of indices itself
    q = times_vector([F.lit(float(x)) for x in m.ravel()], [F.col(x) for x in "hkl"])
    return hkl.select("h", "k", "l", *(x.alias(n) for x, n in zip(q, QS)))


def nearest_index(q: Column, grid: Grid) -> Column:
    """Index of the nearest voxel centre, the lower one of two."""
    return F.ceil(place(q, grid) - 0.5).cast("int")


def nearest_voxels(points: DataFrame, grid: Grid) -> DataFrame:
    """``points`` (.., qx, qy, qz) between the first and the last voxel centre on each axis, with ix, iy, iz and vox of the nearest."""
    inside = F.lit(True)
    for q in QS:  # above the first centre, not above the last
        inside = inside & (F.abs(F.col(q)) < 3 ** 0.5 * grid.max_q) & (F.col(q) > grid.corner) & (F.col(q) <= grid.corner + (grid.n - 1) * grid.delta)
    out = points.filter(inside).select("*", *(nearest_index(F.col(q), grid).alias(i) for q, i in zip(QS, ("ix", "iy", "iz"))))
    return out.withColumn("vox", ((F.col("ix") * grid.n + F.col("iy")) * grid.n + F.col("iz")).cast("int"))


def peak_mask(hkls: DataFrame, grid: Grid, width: int) -> DataFrame:
    """(vox): voxels within ``width`` face steps of the voxel nearest to a Miller index. Indices outside of the grid fall to its edge."""
    n = grid.n
    edge = [F.greatest(F.lit(0), F.least(F.lit(n - 1), nearest_index(F.col(q), grid))).alias(i) for q, i in zip(QS, ("ix", "iy", "iz"))]
    ball = [(x, y, z) for x in range(-width, width + 1) for y in range(-width, width + 1) for z in range(-width, width + 1) if abs(x) + abs(y) + abs(z) <= width]
    around = hkls.select(*edge).distinct().select(F.inline(F.array(*(F.struct((F.col("ix") + x).alias("ix"), (F.col("iy") + y).alias("iy"), (F.col("iz") + z).alias("iz")) for x, y, z in ball))))
    inside = around.filter(" AND ".join(f"{i} BETWEEN 0 AND {n - 1}" for i in ("ix", "iy", "iz")))
    return inside.select(((F.col("ix") * n + F.col("iy")) * n + F.col("iz")).cast("int").alias("vox")).distinct()


def kernel_offsets(connectivity: int, iterations: int) -> list[tuple[int, int, int]]:
    """Offsets of the structuring element of a connectivity (1 faces, 2 edges too, 3 corners too), grown ``iterations`` times from one voxel."""
    base = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x * x + y * y + z * z <= connectivity]
    found = {(0, 0, 0)}
    for _ in range(iterations):
        found = {(a + x, b + y, c + z) for a, b, c in found for x, y, z in base}
    return sorted(found)


def around_peaks(peaks: DataFrame, voxels: DataFrame, grid: Grid, offsets: list[tuple[int, int, int]], keys: list[str]) -> DataFrame:
    """(keys, dx, dy, dz, w) for each offset; an absent voxel is 0. Peaks of which the offsets leave the grid are left out."""
    n, reach = grid.n, max(max(map(abs, o)) for o in offsets)
    inner = peaks.filter(" AND ".join(f"{i} BETWEEN {reach} AND {n - 1 - reach}" for i in ("ix", "iy", "iz")))
    steps = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in offsets))
    at = inner.select(*keys, "vox", F.inline(steps)).withColumn("vox", (F.col("vox") + (F.col("dx") * n + F.col("dy")) * n + F.col("dz")).cast("int"))
    return at.join(voxels.select("vox", "w"), "vox", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def start_density(voxels: DataFrame, cell: Cell, grid: Grid, domains: float = 20.0) -> DataFrame:
    """(vox, w): a Gaussian around each Miller index, of a width that ``domains`` unit cells along a give."""
    lengths = np.linalg.norm(cell.from_hkl(), axis=0)
    c = voxel_centres(voxels.select("vox"), grid)
    frac = times_vector([F.lit(float(x)) for x in cell.to_hkl().ravel()], [F.col(q) for q in QS])
    total = F.lit(0.0)
    for f, s in zip(frac, lengths):
        miss = round_half_down(f) - f
        total = total + float(domains * s / lengths[0]) ** 2 * miss * miss
    return c.select("vox", F.exp(-total * 2 / 0.63).alias("w"))


def normalized_start(density: DataFrame, signal: float) -> DataFrame:
    """(vox, w): a start density scaled to a maximum of one and then to the average signal level. A density without a positive value stays as it is."""
    top = density.agg(F.max("w").alias("top"))
    return density.join(F.broadcast(top)).select("vox", F.when(F.col("top") > 0, F.col("w") / F.col("top") * signal).otherwise(F.col("w")).alias("w"))  # one row


def paint_peaks(peaks: DataFrame, grid: Grid, reach: int, sigma: float) -> DataFrame:
    """(vox, w): for each peak (ix, iy, iz, f) a Gaussian f² exp(-r² / 2 sigma²) in the box of ``reach`` voxels, summed; boxes that leave the grid are left out."""
    n, side = grid.n, range(-reach, reach + 1)
    inner = peaks.filter(" AND ".join(f"{i} BETWEEN {reach} AND {n - 1 - reach}" for i in ("ix", "iy", "iz")))
    steps = F.array(*(F.struct(F.lit((x * n + y) * n + z).alias("step"), F.lit(float(np.exp(-(x * x + y * y + z * z) / 2 / sigma ** 2))).alias("g")) for x in side for y in side for z in side))
    at = inner.select(((F.col("ix") * n + F.col("iy")) * n + F.col("iz")).alias("vox"), "f", F.inline(steps))
    return at.groupBy((F.col("vox") + F.col("step")).cast("int").alias("vox")).agg(F.sum(F.col("f") * F.col("f") * F.col("g")).alias("w"))
