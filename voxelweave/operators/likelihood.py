"""Poisson likelihood of shots under rotations of the density, its derivatives, and orientation probabilities.

Tables: shot_px (shot, t, k, b), shot (shot, phi), prob_rot (shot, r), model (r, t, w) with w the interpolated density; only trusted pixels in bounds are in ``model``.
A pixel counts where m = b + phi w is above -EPSILON; EPSILON is added inside of the logarithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.config import Grid
from voxelweave.functions.scalars import EPSILON
from voxelweave.operators.grid import QS, corners, interpolate, rotated


def model_values(pixels: DataFrame, rotations: DataFrame, voxels: DataFrame, grid: Grid, prob_rot: DataFrame | None = None) -> DataFrame:
    """(r, t, w): the density at each trusted pixel that is in bounds under each rotation; of those in ``prob_rot`` (.., r) only, if that is given, since no other is asked for.
    Worked out once for a rotation, whatever number of shots takes it."""
    if prob_rot is not None:
        rotations = rotations.join(prob_rot.select("r").distinct(), "r", "left_semi")
    trusted = pixels.filter("trusted").select("t", *QS)
    return interpolate(rotated(trusted, rotations), voxels, grid, ["r", "t"])


def pixel_terms(model: DataFrame, shot_px: DataFrame, shots: DataFrame, prob_rot: DataFrame) -> DataFrame:
    """(shot, r, t, k, b, phi, w, m) for the pixels that count. Probable rotations are joined before pixels, so nothing else is ever paired."""
    pairs = prob_rot.join(shots.select("shot", "phi"), "shot")
    at = pairs.join(model, "r").join(shot_px, ["shot", "t"])
    return at.withColumn("m", F.col("b") + F.col("phi") * F.col("w")).filter(F.col("m") > -EPSILON)


def log_likelihood(terms: DataFrame) -> DataFrame:
    """(shot, r, n_px, logr): the sum of k ln(m + EPSILON) - m."""
    value = F.col("k") * F.log(F.col("m") + EPSILON) - F.col("m")
    return terms.groupBy("shot", "r").agg(F.count("*").alias("n_px"), F.sum(value).alias("logr"))


def scale_slope(terms: DataFrame) -> DataFrame:
    """(shot, r, d): the derivative of the log likelihood by the shot's scale."""
    return terms.groupBy("shot", "r").agg(F.sum(F.col("k") * F.col("w") / (F.col("m") + EPSILON) - F.col("w")).alias("d"))


def density_slope(terms: DataFrame, pixels: DataFrame, rotations: DataFrame, grid: Grid, by: list[str], weight=None) -> DataFrame:
    """(by, vox, g): the derivative of the log likelihood by each voxel, times ``weight`` (a column of ``terms``), summed within ``by``.

    The residuals of all shots that share a rotation are added up by pixel before they are spread over voxels, so the eightfold step
    sees (by, rotation, pixel) rows, not (shot, rotation, pixel) rows.
    """
    slope = F.col("k") * F.col("phi") / (F.col("m") + EPSILON) - F.col("phi")
    keys = list(dict.fromkeys([*by, "r", "t"]))
    residual = terms.groupBy(*keys).agg(F.sum(slope if weight is None else slope * weight).alias("e"))
    around = corners(rotated(pixels.filter("trusted").select("t", *QS), rotations), grid)
    spread = residual.join(around, ["r", "t"])
    return spread.groupBy(*by, "vox").agg(F.sum(F.col("e") * F.col("a")).alias("g"))


def probabilities(logr: DataFrame, beta: float = 1.0, min_p: float = 0.0) -> DataFrame:
    """(shot, r, logr, p): exp(beta logr), each shot's sum 1; values below ``min_p`` become 0 and the others make up for them."""
    w = Window.partitionBy("shot")
    e = logr.withColumn("e", F.exp(beta * (F.col("logr") - F.max("logr").over(w))))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")
    if min_p <= 0:
        return p.select("shot", "r", "logr", "p")
    cut = p.withColumn("q", F.when(F.col("p") < min_p, 0.0).otherwise(F.col("p")))
    total, left = F.sum("p").over(w), F.sum("q").over(w)
    return cut.select("shot", "r", "logr", F.when(left > 0, F.col("q") * total / left).otherwise(0.0).alias("p"))


def probability_slope(p: DataFrame, d: DataFrame) -> DataFrame:
    """(shot, r, dp): p (d - sum of p d), the derivative of probabilities by a parameter of which ``d`` is that of the log likelihoods."""
    w = Window.partitionBy("shot")
    both = p.join(d, ["shot", "r"])
    return both.select("shot", "r", (F.col("p") * (F.col("d") - F.sum(F.col("p") * F.col("d")).over(w))).alias("dp"))


def best_rotations(p: DataFrame) -> DataFrame:
    """(shot, r, p) of each shot's most probable rotation; of equal ones the least r."""
    best = p.groupBy("shot").agg(F.max(F.struct("p", -F.col("r"))).alias("top"))
    return best.select("shot", (-F.col("top.col2")).alias("r"), F.col("top.p").alias("p"))


def finite(p: DataFrame, least: float = 1e-5) -> DataFrame:
    return p.filter(F.col("p") >= least)


def functional(p: DataFrame, least: float = 1e-5) -> DataFrame:
    """One row (functional): the sum of p logr over finite probabilities."""
    return finite(p, least).agg(F.sum(F.col("p") * F.col("logr")).alias("functional"))


def success(p: DataFrame, model: DataFrame, shot_px: DataFrame, least_p: float = 1e-3, least_cc: float = 0.2) -> DataFrame:
    """(shot, cc, resid, ok): correlation of each shot with its probable model where k > 0, and its squared residual over pixels in bounds."""
    chosen = p.filter(F.col("p") > least_p).select("shot", "r", "p")
    mixed = chosen.join(model, "r").groupBy("shot", "t").agg(F.sum(F.col("p") * F.col("w")).alias("pw"))
    total = chosen.groupBy("shot").agg(F.sum("p").alias("psum"))
    both = shot_px.join(mixed, ["shot", "t"]).join(total, "shot").withColumn("model", F.col("pw") / F.col("psum"))
    bright = F.col("k") > 0
    out = both.groupBy("shot").agg(
        F.corr(F.when(bright, F.col("k")), F.when(bright, F.col("model"))).alias("cc"),
        F.sum((F.col("model") - F.col("k")) * (F.col("model") - F.col("k"))).alias("resid"),
    )
    return out.withColumn("ok", F.coalesce(F.col("cc") > least_cc, F.lit(False)))
