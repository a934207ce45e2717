"""Updates of density and scales, and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.config import Grid
from voxelweave.functions.scalars import EPSILON
from voxelweave.operators.grid import QS, friedel, insert, rotated, symmetrize
from voxelweave.operators.likelihood import finite
from voxelweave.operators.order import median
from voxelweave.session import cut


def tomograms(p: DataFrame, shot_px: DataFrame, shots: DataFrame, least: float = 1e-5) -> DataFrame:
    """(r, t, w): for each rotation the probable mean image, sum of p k over sum of p phi. One shuffle on (r, t), partly summed before."""
    each = finite(p, least).select("shot", "r", "p").join(shots.select("shot", "phi"), "shot").join(shot_px.select("shot", "t", "k"), "shot")
    sums = each.groupBy("r", "t").agg(F.sum(F.col("p") * F.col("k")).alias("num"), F.sum(F.col("p") * F.col("phi")).alias("den"))
    return sums.select("r", "t", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0).alias("w"))


def compressed(tomos: DataFrame, pixels: DataFrame, rotations: DataFrame, grid: Grid, symops: DataFrame | None = None, mates: bool = True) -> DataFrame:
    """(vox, w): tomograms inserted into the grid, then averaged over symmetry and Friedel mates."""
    placed = rotated(pixels.filter("trusted").select("t", *QS), rotations).join(tomos, ["r", "t"])
    out = insert(placed, F.col("w"), grid).select("vox", "w")
    if symops is not None:
        out = symmetrize(out, symops, grid)
    return friedel(out, grid) if mates else out


def analytic_scales(p: DataFrame, model: DataFrame, shot_px: DataFrame, shots: DataFrame) -> DataFrame:
    """(shot, phi, changed): sum of p times sum of k, over the sum of p times the rotation's model sum; left as it was where that is not positive.

    The model is summed by rotation and the pixels by shot first, so the join between them is on (shot, rotation) rows only."""
    by_rot = model.groupBy("r").agg(F.sum("w").alias("wsum"))
    by_shot = shot_px.groupBy("shot").agg(F.sum("k").alias("ksum"))
    den = p.join(by_rot, "r", "left").groupBy("shot").agg(F.sum("p").alias("psum"), F.sum(F.col("p") * F.coalesce("wsum", F.lit(0.0))).alias("den"))
    every = shots.select("shot", "phi").join(den, "shot", "left").join(by_shot, "shot", "left")
    ok = F.coalesce(F.col("den") > 0, F.lit(False))
    return every.select("shot", F.when(ok, F.col("psum") * F.coalesce("ksum", F.lit(0.0)) / F.col("den")).otherwise(F.col("phi")).alias("phi"), ok.alias("changed"))


def normalized_scales(shots: DataFrame, level: float) -> DataFrame:
    """(shot, phi) with mean ``level``."""
    mean = shots.agg(F.avg("phi").alias("mean"))
    return shots.select("shot", "phi").join(F.broadcast(mean)).select("shot", (F.col("phi") / F.col("mean") * level).alias("phi"))  # one row


def scale_changes(new: DataFrame, old: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row (mean_change, n_above, converged): relative changes of scales from one iteration to the next."""
    both = new.select("shot", "phi").join(old.select("shot", F.col("phi").alias("before")), "shot")
    change = F.abs(F.col("phi") - F.col("before")) / F.col("before")
    out = both.agg(F.avg(change).alias("mean_change"), F.count_if(change > tolerance).alias("n_above"))
    return out.withColumn("converged", F.col("n_above") == 0)


def scale_stats(shots: DataFrame) -> DataFrame:
    out = shots.agg(F.avg("phi").alias("mean_phi"), F.stddev_pop("phi").alias("std_phi"))
    return out.select("mean_phi", F.lit(median(shots, "phi")).cast("double").alias("median_phi"), "std_phi")


def scales_at_limits(shots: DataFrame, low: float, high: float, tolerance: float = 1e-8) -> DataFrame:
    """One row (n_low, n_high): shots whose scale stands at a limit."""
    at = lambda x: F.count_if(F.abs(F.col("phi") - x) <= tolerance + 1e-5 * abs(x))
    return shots.agg(at(low).alias("n_low"), at(high).alias("n_high"))


def fitted_scales(terms: DataFrame, p: DataFrame, shots: DataFrame, steps: int = 40, low: float = 1e-6, high: float = 1e6, tolerance: float = 1e-11) -> DataFrame:
    """(shot, phi): the scale between ``low`` and ``high`` with the highest probable likelihood of each shot; shots without probable signal keep theirs.

    The likelihood is concave in a shot's scale. All shots take Newton's step at once, inside of brackets that shrink, from two sums by shot; partial sums are
    taken before the shuffle, so a shot may have any number of pixels and rotations. Shots that have settled leave the next sums.
    """
    rows = cut(terms.join(p.filter("p > 0").select("shot", "r", "p"), ["shot", "r"]).select("shot", "k", "b", "w", "p"))

    def slope(x):
        return F.sum(F.col("p") * (F.col("k") * F.col("w") / (F.greatest(F.col("b") + x * F.col("w"), F.lit(0.0)) + EPSILON) - F.col("w")))

    ends = rows.groupBy("shot").agg(F.sum(F.col("p") * F.col("w")).alias("pw"), slope(F.lit(low)).alias("at_low"), slope(F.lit(high)).alias("at_high"))
    known = shots.select("shot", "phi").join(ends, "shot", "left")
    usable = F.coalesce(F.col("pw") > 0, F.lit(False))
    inner = usable & (F.col("at_low") > 0) & (F.col("at_high") < 0)
    end = F.when(usable & (F.col("at_low") <= 0), F.lit(low)).when(usable & (F.col("at_high") >= 0), F.lit(high)).otherwise(F.col("phi"))
    start = F.when(inner, F.least(F.greatest("phi", F.lit(2 * low)), F.lit(high / 2))).otherwise(end)
    state = cut(known.select("shot", start.alias("phi"), F.lit(low).alias("lo"), F.lit(high).alias("hi"), inner.alias("live")))
    for _ in range(steps):
        if not state.filter("live").limit(1).count():
            break
        x = F.greatest(F.col("b") + F.col("phi") * F.col("w"), F.lit(0.0)) + EPSILON
        sums = rows.join(state.filter("live").select("shot", "phi"), "shot").groupBy("shot").agg(
            F.sum(F.col("p") * (F.col("k") * F.col("w") / x - F.col("w"))).alias("s"), F.sum(F.col("p") * F.col("k") * F.col("w") * F.col("w") / (x * x)).alias("c"))
        up = F.col("s") > 0
        both = state.join(sums, "shot", "left").withColumns({"a": F.when(up, F.col("phi")).otherwise(F.col("lo")), "z": F.when(up, F.col("hi")).otherwise(F.col("phi"))})
        newton = F.col("phi") + F.try_divide("s", "c")  # may be an end of the bracket: a scale that has settled to the last digit
        new = F.when(newton.between(F.col("a"), F.col("z")), newton).otherwise(F.sqrt(F.col("a") * F.col("z")))
        both = both.withColumn("new", F.when(F.col("live"), new).otherwise(F.col("phi")))
        moved = F.abs(F.col("new") - F.col("phi")) > tolerance * F.col("phi")
        state = cut(both.select("shot", F.col("new").alias("phi"), F.col("a").alias("lo"), F.col("z").alias("hi"), (F.col("live") & moved).alias("live")))
    return state.select("shot", "phi")
