"""Detector geometry, radial backgrounds and strong spots. Images are rows (shot, x, y, v), x along the fast axis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelweave.config import Beam, Detector
from voxelweave.functions.scalars import cross, dot, errdiv, norm


def _unit(v) -> np.ndarray:
    return np.array(v, float) / np.linalg.norm(v)


def _lits(v) -> list[Column]:
    return [F.lit(float(x)) for x in v]


def detector_pixels(spark: SparkSession, det: Detector) -> DataFrame:
    """(x, y) of every pixel."""
    return spark.range(det.n_fast * det.n_slow).select((F.col("id") % det.n_fast).cast("int").alias("x"), F.floor(F.col("id") / det.n_fast).cast("int").alias("y"))


def positions(det: Detector) -> list[Column]:
    """Lab position of pixel (x, y)."""
    return [F.lit(float(o)) + F.col("x") * float(f * det.pixel) + F.col("y") * float(s * det.pixel) for o, f, s in zip(det.origin, det.fast, det.slow)]


def q_map(pixels: DataFrame, det: Detector, beam: Beam) -> DataFrame:
    """(x, y, qx, qy, qz): scattering vectors."""
    k = positions(det)
    size = norm(k)
    q = [(c / size - float(s)) / beam.wavelength for c, s in zip(k, _unit(beam.direction))]
    return pixels.select("x", "y", *(c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"))))


def solid_angle(det: Detector) -> Column:
    size = norm(positions(det))
    return F.lit(det.pixel ** 2 * det.distance) / (size * size * size)


def polarization(det: Detector, beam: Beam) -> Column:
    """Kahn's factor of pixel (x, y)."""
    k = positions(det)
    size = norm(k)
    d = [c / size for c in k]
    incident, axis = _unit(beam.direction), np.array(beam.polarization_normal, float)
    b_in = np.cross(axis, incident)
    e_in = np.cross(incident, b_in)
    c2 = dot(_lits(incident), d) * dot(_lits(incident), d)
    psi = -F.atan2(dot(d, _lits(b_in)), dot(d, _lits(e_in))) if beam.polarization_fraction else F.lit(0.0)
    return 0.5 * (1.0 + c2 - beam.polarization_fraction * F.cos(2 * psi) * (1 - c2))


def correction(pixels: DataFrame, det: Detector, beam: Beam) -> DataFrame:
    """(x, y, f): polarization times solid angle, of mean 1."""
    both = pixels.select("x", "y", (polarization(det, beam) * solid_angle(det)).alias("f"))
    mean = both.agg(F.avg("f").alias("mean"))
    return both.join(F.broadcast(mean)).select("x", "y", (F.col("f") / F.col("mean")).alias("f"))  # one row


def trusted_pixels(pixels: DataFrame, det: Detector) -> DataFrame:
    """``pixels`` outside of the detector's masked rectangles (a few, from its description)."""
    bad = F.lit(False)
    for x1, x2, y1, y2 in det.masked:
        bad = bad | (F.col("x").between(x1, x2 - 1) & F.col("y").between(y1, y2 - 1))
    return pixels.filter(~bad)


def strong_pixels(refl: DataFrame) -> DataFrame:
    """(shot, x, y) of pixels in any reflection's box [x1, x2) x [y1, y2): boxes are opened into pixels, so images join them by equality, not by range."""
    xs = refl.filter("x2 > x1 AND y2 > y1").select("shot", F.explode(F.sequence(F.greatest("x1", F.lit(0)), F.col("x2") - 1)).alias("x"), "y1", "y2")
    return xs.select("shot", "x", F.explode(F.sequence(F.greatest("y1", F.lit(0)), F.col("y2") - 1)).alias("y")).distinct()


def radial_profile(image: DataFrame, bins: DataFrame, strong: DataFrame | None = None, median: bool = True) -> DataFrame:
    """(shot, qbin, v): the median (or mean) of trusted pixels outside of strong spots by radial bin; ``bins``: (x, y, qbin) of trusted pixels."""
    rest = image.join(bins, ["x", "y"])
    if strong is not None:
        rest = rest.join(strong, ["shot", "x", "y"], "left_anti")
    return rest.groupBy("shot", "qbin").agg((F.median("v") if median else F.avg("v")).alias("v"))


def expand_profile(profile: DataFrame, bins: DataFrame) -> DataFrame:
    """(shot, x, y, bg): the profile as an image."""
    return bins.join(profile, "qbin").select("shot", "x", "y", F.col("v").alias("bg"))


def without_background(image: DataFrame, bins: DataFrame, strong: DataFrame | None, factor: DataFrame, level: float | None = None) -> DataFrame:
    """(shot, x, y, v): the corrected image minus its radial median; with ``level`` each image is scaled to that maximum first."""
    fixed = image.join(factor, ["x", "y"]).select("shot", "x", "y", (F.col("v") * F.col("f")).alias("v"))
    if level is not None:
        fixed = fixed.withColumn("v", errdiv(F.col("v"), F.max("v").over(Window.partitionBy("shot"))) * level)
    bg = expand_profile(radial_profile(fixed, bins, strong), bins)
    return fixed.join(bg, ["shot", "x", "y"]).select("shot", "x", "y", (F.col("v") - F.col("bg")).alias("v"))


def filled(image: DataFrame, bins: DataFrame, strong: DataFrame) -> DataFrame:
    """(shot, x, y, v): trusted pixels; those in strong spots have their background."""
    bg = expand_profile(radial_profile(image, bins, strong), bins)
    spot = strong.withColumn("spot", F.lit(True))
    both = image.join(bg, ["shot", "x", "y"]).join(spot, ["shot", "x", "y"], "left")
    return both.select("shot", "x", "y", F.when(F.col("spot"), F.col("bg")).otherwise(F.col("v")).alias("v"))


def median_filter(image: DataFrame, width: int) -> DataFrame:
    """(shot, x, y, v): the median of the ``width`` by ``width`` pixels around, edges mirrored. Whole images: a group is one shot, of the detector's size."""

    def run(pdf):
        import pandas as pd

        a = np.full((pdf["y"].max() + 1, pdf["x"].max() + 1), np.nan)
        a[pdf["y"], pdf["x"]] = pdf["v"]
        h = width // 2
        around = np.lib.stride_tricks.sliding_window_view(np.pad(a, (h, width - 1 - h), mode="symmetric"), (width, width))
        m = np.nanmedian(around.reshape(*a.shape, -1), axis=2)
        return pd.DataFrame({"shot": pdf["shot"], "x": pdf["x"], "y": pdf["y"], "v": m[pdf["y"], pdf["x"]]})

    kind = image.schema["shot"].dataType.simpleString()
    return image.select("shot", "x", "y", "v").groupBy("shot").applyInPandas(run, f"shot {kind}, x int, y int, v double")


def signal_level(refl: DataFrame, image: DataFrame) -> DataFrame:
    """(shot, level): the mean over a shot's reflections of the mean pixel of their boxes; a reflection without pixels adds 0 but counts."""
    boxes = refl.filter("x2 > x1 AND y2 > y1").select("shot", "refl_id", F.explode(F.sequence(F.greatest("x1", F.lit(0)), F.col("x2") - 1)).alias("x"), "y1", "y2")
    boxes = boxes.select("shot", "refl_id", "x", F.explode(F.sequence(F.greatest("y1", F.lit(0)), F.col("y2") - 1)).alias("y"))
    means = boxes.join(image, ["shot", "x", "y"]).groupBy("shot", "refl_id").agg(F.avg("v").alias("v")).groupBy("shot").agg(F.sum("v").alias("total"))
    n = refl.groupBy("shot").agg(F.count("*").alias("n"))
    return n.join(means, "shot", "left").select("shot", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("level"))


def spot_sizes(labels: DataFrame, least: int, most: int) -> DataFrame:
    """``labels`` (shot, label, ..) of spots of ``least`` to ``most`` pixels."""
    ok = labels.groupBy("shot", "label").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    return labels.join(ok, ["shot", "label"], "left_semi")


def dispersion_threshold(image: DataFrame, reach: int = 3, gain: float = 1.0, sigma_background: float = 6.0, sigma_strong: float = 3.0, least: int = 2) -> DataFrame:
    """(shot, x, y, v) of strong pixels, by the index of dispersion: in the window of ``reach`` pixels to each side, the variance over the mean is above that of a Poisson background by
    ``sigma_background`` standard errors, and the pixel is above the window's mean by ``sigma_strong`` standard deviations. ``image`` holds trusted pixels only; those that are absent count
    in no window, and a window of fewer than ``least`` pixels has no strong one.

    Sums over a window are taken along x, then along y, so a task needs one row or column of an image at a time.
    """
    def along(df: DataFrame, line: str, axis: str, sums: dict) -> DataFrame:
        w = Window.partitionBy("shot", line).orderBy(axis).rangeBetween(-reach, reach)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})

    # a pixel that is absent can still be the middle of a row's window, so rows are summed at every place of the image's columns
    rows = image.select("shot", "x", "y", F.col("v").cast("double").alias("v"))
    spread = rows.select("shot", "y", "v", F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x")).groupBy("shot", "x", "y").agg(
        F.count("*").alias("m0"), F.sum("v").alias("m1"), F.sum(F.col("v") * F.col("v")).alias("m2"))
    sums = along(spread, "x", "y", {"m": "m0", "s": "m1", "q": "m2"})
    both = rows.join(sums.select("shot", "x", "y", "m", "s", "q"), ["shot", "x", "y"])
    m, total, square = F.col("m"), F.col("s"), F.col("q")
    spread_enough = m * square - total * total - gain * total * (m - 1) > gain * total * sigma_background * F.sqrt(2.0 * (m - 1))
    bright_enough = m * F.col("v") - total > sigma_strong * F.sqrt(gain * total * m)
    return both.filter((m >= least) & (total >= 0) & spread_enough & bright_enough).select("shot", "x", "y", "v")


def find_spots(image: DataFrame, strong: DataFrame, least: int, most: int, shift: float = -0.5) -> DataFrame:
    """(shot, label, n_px, cx, cy, total): spots of ``least`` to ``most`` face-connected strong pixels (shot, x, y) and their centres of intensity in ``image``."""
    return spot_centroids(spot_sizes(label_spots(strong), least, most), image, shift)


def label_spots(pixels: DataFrame) -> DataFrame:
    """(shot, x, y, label): face-connected pixels of a shot share a label, numbered from 1 in the order of their first pixel (by y, then x)."""

    def run(pdf):
        import pandas as pd

        at = {(y, x): k for k, (y, x) in enumerate(sorted(zip(pdf["y"].tolist(), pdf["x"].tolist())))}
        up = list(range(len(at)))

        def find(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for (y, x), k in at.items():
            for other in ((y - 1, x), (y, x - 1)):
                if other in at:
                    a, b = sorted((find(at[other]), find(k)))
                    up[b] = a
        number: dict[int, int] = {}
        rows = [(x, y, number.setdefault(find(k), len(number) + 1)) for (y, x), k in at.items()]
        return pd.DataFrame({"shot": pdf["shot"].iloc[0], "x": [r[0] for r in rows], "y": [r[1] for r in rows], "label": [r[2] for r in rows]})

    kind = pixels.schema["shot"].dataType.simpleString()
    return pixels.select("shot", "x", "y").distinct().groupBy("shot").applyInPandas(run, f"shot {kind}, x int, y int, label int")


def spot_centroids(labels: DataFrame, image: DataFrame, shift: float = 0.0) -> DataFrame:
    """(shot, label, n_px, cx, cy, total): intensity-weighted centres of labelled pixels, at pixel centres plus ``shift``."""
    both = labels.join(image, ["shot", "x", "y"])
    total = F.sum("v")
    return both.groupBy("shot", "label").agg(
        F.count("*").alias("n_px"), (F.sum(F.col("v") * (F.col("x") + 0.5)) / total + shift).alias("cx"),
        (F.sum(F.col("v") * (F.col("y") + 0.5)) / total + shift).alias("cy"), total.alias("total"),
    )


def match_spots(predicted: DataFrame, strong: DataFrame, reach: float) -> DataFrame:
    """(shot, pred_id, spot_id, dist): each strong spot (shot, spot_id, x, y) marks the nearest prediction (shot, pred_id, x, y) within ``reach`` of it;
    of spots that mark one prediction the last counts. Of predictions equally near the least id is marked.

    Cells of side ``reach`` turn the radius join into an equality join with the nine cells around."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    spots = strong.select("shot", "spot_id", F.col("x").alias("sx"), F.col("y").alias("sy"), cell("x").alias("i"), cell("y").alias("j"))
    nine = F.array(*(F.struct((F.col("ci") + a).alias("i"), (F.col("cj") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    preds = predicted.select("shot", "pred_id", "x", "y", cell("x").alias("ci"), cell("y").alias("cj")).select("shot", "pred_id", "x", "y", F.inline(nine))
    dx, dy = F.col("sx") - F.col("x"), F.col("sy") - F.col("y")
    near = spots.join(preds, ["shot", "i", "j"]).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= reach)
    first = near.groupBy("shot", "spot_id").agg(F.min(F.struct("dist", "pred_id")).alias("best")).select("shot", "spot_id", "best.*")
    last = first.groupBy("shot", "pred_id").agg(F.max(F.struct("spot_id", "dist")).alias("last"))
    return last.select("shot", "pred_id", "last.spot_id", "last.dist")
