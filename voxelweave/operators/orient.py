"""Orientation search: which rotations of a grid predict a shot's strong spots."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.config import Cell
from voxelweave.functions.scalars import matrix_columns, norm, round_half_down, times_matrix, times_vector
from voxelweave.operators.grid import QS, rotated


def quaternion_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Rows of the rotation of a unit quaternion, its scalar last."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def miller_residual(qs: list[Column], cell: Cell) -> Column:
    """Distance of a scattering vector from the nearest Miller index, in units of indices."""
    h = times_vector([F.lit(float(v)) for v in cell.to_hkl().ravel()], qs)
    return norm([x - round_half_down(x) for x in h])


def residuals(spots: DataFrame, rotations: DataFrame, cell: Cell) -> DataFrame:
    """(shot, r, spot columns, residual) of every spot (shot, refl_id, qx, qy, qz) under every rotation of the grid.

    The pairing is the search itself; spots and rotations stay whole on either side and only counts leave the join."""
    return rotated(spots, rotations).withColumn("residual", miller_residual([F.col(q) for q in QS], cell)).drop(*QS)


def probable(resid: DataFrame, cut: float, least: int) -> DataFrame:
    """(shot, r, n_pred): rotations under which ``least`` spots at least are less than ``cut`` from a Miller index."""
    return resid.filter(F.col("residual") < cut).groupBy("shot", "r").agg(F.count("*").alias("n_pred")).filter(F.col("n_pred") >= least)


def relaxed_cut(resid: DataFrame, cut: float, step: float, least: int, more_than: int) -> DataFrame:
    """(shot, cut, n_rot): the first of cut, cut + step, ... at which a shot has more than ``more_than`` probable rotations.

    A rotation becomes probable at its ``least``-th smallest residual, so the number of steps of every rotation is known at once, and the shot's is
    that of its (more_than + 1)-th rotation. Spots are counted by rotation and step, then rotations by shot and step, so only partial counts leave the pairing
    and windows run over steps, not over spots. Shots with too few rotations are left out.
    """
    from pyspark.sql import Window

    # residual < cut + s step; the comparison is strict
    steps = F.greatest(F.floor((F.col("residual") - cut) / step).cast("int") + 1, F.lit(0))
    upto = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("steps"))
    spots = resid.groupBy("shot", "r", steps.alias("steps")).agg(F.count("*").alias("n")).withColumn("upto", upto("shot", "r"))
    turn = spots.filter(F.col("upto") >= least).groupBy("shot", "r").agg(F.min("steps").alias("steps"))
    rots = turn.groupBy("shot", "steps").agg(F.count("*").alias("n")).withColumn("upto", upto("shot"))
    need = rots.filter(F.col("upto") > more_than).groupBy("shot").agg(F.min(F.struct("steps", "upto")).alias("need"))
    return need.select("shot", (F.lit(cut) + F.col("need.steps") * step).alias("cut"), F.col("need.upto").alias("n_rot"))


def tightened_least(resid: DataFrame, cut: float, least: int, most_rotations: int) -> DataFrame:
    """(shot, least, n_rot): the smallest number of predicted spots, ``least`` at least, that leaves a shot ``most_rotations`` rotations at most."""
    from pyspark.sql import Window

    counts = probable(resid, cut, least)
    by_count = counts.groupBy("shot", "n_pred").agg(F.count("*").alias("n"))
    # with a bound of c + 1 exactly the rotations of higher counts stay; 0 stands for the first bound
    up = Window.partitionBy("shot").orderBy(F.desc("n_pred"))
    running = by_count.withColumn("n_rot", F.sum("n").over(up)).withColumn("above", F.coalesce(F.lag("n_rot").over(up), F.lit(0)))
    ranked = running.withColumn("fits", F.col("n_rot") <= most_rotations)
    out = ranked.groupBy("shot").agg(
        F.max(F.when(~F.col("fits"), F.struct("n_pred", "above"))).alias("over"), F.max("n_rot").alias("all"))
    none = F.col("over").isNull()
    return out.select("shot", F.when(none, F.lit(least)).otherwise(F.col("over.n_pred") + 1).cast("int").alias("least"), F.when(none, F.col("all")).otherwise(F.col("over.above")).alias("n_rot"))


def small_rotations(size: float, step: float) -> list[np.ndarray]:
    """Rx Ry Rz for every triple of angles (degrees) in -size, -size + step, .., size but for three zeros."""
    angles, out = np.arange(-size, size + 1e-6, step), []
    for a, b, c in itertools.product(angles, repeat=3):
        if abs(a) + abs(b) + abs(c) < 1e-8:
            continue
        (ca, cb, cc), (sa, sb, sc) = (tuple(f(math.radians(v)) for v in (a, b, c)) for f in (math.cos, math.sin))
        out.append((np.array([[1, 0, 0], [0, ca, -sa], [0, sa, ca]]) @ np.array([[cb, 0, sb], [0, 1, 0], [-sb, 0, cb]]) @ np.array([[cc, -sc, 0], [sc, cc, 0], [0, 0, 1]])).ravel())
    return out


def perturbations(spark, size: float, step: float) -> DataFrame:
    """(d, x00..x22): the rows of ``small_rotations``."""
    rows = [(k, *map(float, m)) for k, m in enumerate(small_rotations(size, step))]
    return spark.createDataFrame(rows, "d int, " + ", ".join(f"x{i}{j} double" for i in range(3) for j in range(3)))


def perturbed(prob_rot: DataFrame, rotations: DataFrame, small: DataFrame) -> DataFrame:
    """(shot, r, d, m00..m22): each probable rotation U and every small rotation R, as R U. ``rotations`` and the result hold transposes (m = Uᵀ), so m becomes m Rᵀ."""
    near = prob_rot.join(rotations, "r").join(F.broadcast(small))  # (2 size / step + 1)³ rows, from two parameters
    transposed = [F.col(f"x{j}{i}") for i in range(3) for j in range(3)]
    product = times_matrix(matrix_columns(), transposed)
    return near.select("shot", "r", "d", *(x.alias(f"m{i}{j}") for x, (i, j) in zip(product, itertools.product(range(3), repeat=2))))


def with_truth(prob_rot: DataFrame, truth: DataFrame) -> DataFrame:
    """``prob_rot`` (shot, r) and those rows of ``truth`` that it lacks."""
    return prob_rot.select("shot", "r").unionByName(truth.select("shot", "r").join(prob_rot, ["shot", "r"], "left_anti").distinct())


def rotation_counts(prob_rot: DataFrame, shots: DataFrame) -> DataFrame:
    """One row (n_shots, n_zero, mean_rot, max_rot): numbers of probable rotations of shots."""
    n = shots.select("shot").join(prob_rot.groupBy("shot").agg(F.count("*").alias("n")), "shot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.agg(F.count("*").alias("n_shots"), F.count_if(F.col("n") == 0).alias("n_zero"), F.avg("n").alias("mean_rot"), F.max("n").alias("max_rot"))


def confident(p: DataFrame, rotations: DataFrame, symops: DataFrame, cut: float = 1e-2, tolerance: float = 1e-6) -> DataFrame:
    """(shot, r, n_good): shots that one rotation explains (p = 1), or four of equal p that symmetry takes into one another, and the least of those rotations.

    ``rotations`` holds transposes, so an operation S takes r into the first of the four if S times the row of r is that of the first."""
    close = lambda x, y: F.abs(x - y) <= 1e-8 + 1e-5 * abs(y)
    some = p.filter("p > 0").select("shot", "r", "p")
    per = some.groupBy("shot").agg(F.count_if(F.col("p") > cut).alias("n_good"), F.min(F.when(close(F.col("p"), 1.0), 1).otherwise(0)).alias("all_one"),
                                   F.min(F.when(close(F.col("p"), 0.25), 1).otherwise(0)).alias("all_quarter"), F.min("r").alias("r"))
    one = per.filter("n_good = 1 AND all_one = 1")
    four = per.filter("n_good = 4 AND all_quarter = 1")
    # whole rotations are compared: one vector would not tell apart those that differ by a turn about it
    turned = [x.alias(f"t{i}{j}") for x, (i, j) in zip(matrix_columns(), itertools.product(range(3), repeat=2))]
    mats = four.select("shot", F.col("r").alias("lead")).join(some, "shot").join(rotations, "r").select("shot", "lead", "r", *turned)
    lead = mats.filter("r = lead").select("shot", *(x.alias(f"l{i}{j}") for x, (i, j) in zip(matrix_columns("t"), itertools.product(range(3), repeat=2))))
    images = mats.filter("r <> lead").join(lead, "shot").join(F.broadcast(symops))  # a group has 192 operations at most
    same = F.lit(True)
    for a, c in zip(times_matrix(matrix_columns(), matrix_columns("t")), matrix_columns("l")):
        same = same & (F.abs(a - c) <= tolerance)
    equal = images.groupBy("shot", "r").agg(F.count_if(same).alias("n")).groupBy("shot").agg(F.min(F.when(F.col("n") == 1, 1).otherwise(0)).alias("ok")).filter("ok = 1")
    return one.select("shot", "r", "n_good").unionByName(four.join(equal, "shot", "left_semi").select("shot", "r", "n_good"))


def random_quaternions(ids: DataFrame, col: str, seed: int) -> DataFrame:
    """(col, q0..q3): a uniformly random orientation for each id, q0 the scalar. The three numbers of an id come from digests of seed and id, so a lost task draws the same."""
    u = [F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(col).cast("string"), F.lit(str(k))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) for k in range(3)]
    turn = [2 * np.pi * x for x in u[1:]]
    near, far = F.sqrt(1 - u[0]), F.sqrt(u[0])
    return ids.select(col, (far * F.cos(turn[1])).alias("q0"), (near * F.sin(turn[0])).alias("q1"), (near * F.cos(turn[0])).alias("q2"), (far * F.sin(turn[1])).alias("q3"))
