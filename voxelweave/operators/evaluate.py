"""Statistics of reflections and of agreement between intensity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.order import median, middle, ranked, spans, values_at
from voxelweave.session import cut


def pearson(pairs: DataFrame) -> DataFrame:
    """One row (n, cc) of pairs (i1, i2)."""
    return pairs.agg(F.count("*").alias("n"), F.corr("i1", "i2").alias("cc"))


def average_ranks(pairs: DataFrame, col: str, name: str) -> DataFrame:
    """``pairs`` with the rank of ``col``, equal values sharing their mean rank. Values are counted first, so the running sum is over distinct values by ranges, never over all rows in one task."""
    found, _ = spans(pairs, col)
    return pairs.join(found.select(F.col("value").alias(col), ((F.col("first") + F.col("last")) / 2.0 + 1).alias(name)), col)


def spearman(pairs: DataFrame) -> DataFrame:
    """One row (n, cc): Pearson's correlation of average ranks."""
    ranked = average_ranks(average_ranks(pairs, "i1", "r1"), "i2", "r2")
    return ranked.agg(F.count("*").alias("n"), F.corr("r1", "r2").alias("cc"))


def by_shell(pairs: DataFrame, n_shells: int) -> DataFrame:
    """(shell, n, d, cc) over shells of resolution of about as many rows; d is the shell's median.

    Shells start at the first value of each of ``n_shells`` equal parts of the sorted d, the last one ends at the largest d. Shells are numbered from 1; the last
    number is left out, as are shells of fewer than two rows. The starts are single order statistics, found from counts of distinct values.
    """
    spark = pairs.sparkSession
    pairs = cut(pairs.select("i1", "i2", "d"))  # read several times
    found, total = spans(pairs, "d")
    if not total:
        return spark.createDataFrame([], "shell int, n long, d double, cc double")
    size, more = divmod(total, n_shells)
    at = values_at(found, [min(k * size + min(k, more), total - 1) for k in range(n_shells)] + [total - 1])  # n_shells + 1 rows
    edges = sorted(v for v in (at[min(k * size + min(k, more), total - 1)] for k in range(n_shells))) + [at[total - 1]]  # (d, its first place); the last one ends the last shell and belongs to none
    shell = F.lit(0)
    for d, _ in edges:
        shell = shell + F.when(F.col("d") >= d, 1).otherwise(0)
    labelled = pairs.withColumn("shell", shell.cast("int")).filter(F.col("shell").between(1, n_shells - 1))
    out = labelled.groupBy("shell").agg(F.count("*").alias("n"), F.corr("i1", "i2").alias("cc")).filter("n >= 2")
    # a shell's rows stand at the places between its edge and the next one of another value
    middles = {k: middle(edges[k - 1][1], edges[k][1] - edges[k - 1][1]) for k in range(1, n_shells) if edges[k][1] > edges[k - 1][1]}
    at = values_at(found, [p for m in middles.values() for p in m])
    medians = spark.createDataFrame([(k, 0.5 * at[a][0] + 0.5 * at[b][0]) for k, (a, b) in middles.items()], "shell int, d double")
    return out.join(F.broadcast(medians), "shell").select("shell", "n", "d", "cc")


def without_repeats(refl: DataFrame) -> DataFrame:
    """Reflections whose (shot, h, k, l) no other reflection has: all members of a repeated one go."""
    once = refl.groupBy("shot", "h", "k", "l").agg(F.count("*").alias("n")).filter("n = 1").select("shot", "h", "k", "l")
    return refl.join(once, ["shot", "h", "k", "l"], "left_semi")


def reference_reflections(refl: DataFrame) -> DataFrame:
    """Indexed reflections (indexed, not 0 0 0). A negative shot among them is an error, raised when the rows are read."""
    ok = refl.filter("indexed").filter("NOT (h = 0 AND k = 0 AND l = 0)")
    return ok.withColumn("shot", F.when(F.col("shot") < 0, F.raise_error(F.lit("a reference reflection has a negative shot id"))).otherwise(F.col("shot")))


def within_resolution(refl: DataFrame, max_q: float, least: int = 3) -> DataFrame:
    """Reflections of 1 / |q| >= 1 / max_q, in shots where at least ``least`` of them are; other shots keep all."""
    size = F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))
    fine = size * (1 / max_q) <= 1
    n = refl.groupBy("shot").agg(F.count_if(fine).alias("n_fine"))
    return refl.join(n, "shot").filter(fine | (F.col("n_fine") < least)).drop("n_fine")


def renumbered(refl: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(.., new_id): shots (in ``keep``, if given) with reflections left, numbered from 0 in order. Only the distinct shots are ranked."""
    left = refl if keep is None else refl.join(keep.select("shot").distinct(), "shot", "left_semi")
    ids = ranked(left.select("shot").distinct(), ["shot"], "new_id")
    return left.join(ids, "shot")


def narrow_shots(shots: DataFrame, cutoff: float | None) -> DataFrame:
    """Shots (shot, sigma_b) whose reflections spread less than ``cutoff``; all of them without one."""
    return shots if cutoff is None else shots.filter(F.col("sigma_b") < cutoff)


def significant(refl: DataFrame, n_bins: int, least_ratio: float) -> DataFrame:
    """Reflections (.., shot, d, i, var) up to the resolution at which a shot's signal ends. A shot's range of 1 / d³ is cut into ``n_bins`` equal bins, and the first
    one, from coarse to fine, of which the mean i / sqrt(var) is under ``least_ratio`` ends it, with all finer ones; empty bins end nothing. Shots without reflections left are gone."""
    cube = refl.withColumn("cube", 1 / (F.col("d") * F.col("d") * F.col("d")))
    span = cube.groupBy("shot").agg(F.min("cube").alias("low"), F.max("cube").alias("high"))
    place = F.floor((F.col("cube") - F.col("low")) / (F.col("high") - F.col("low")) * n_bins)
    binned = cube.join(span, "shot").withColumn("bin", F.when(F.col("high") > F.col("low"), F.least(place, F.lit(n_bins - 1))).otherwise(0).cast("int"))
    weak = binned.groupBy("shot", "bin").agg(F.avg(F.col("i") / F.sqrt("var")).alias("ratio")).filter(F.col("ratio") < least_ratio)
    ends = weak.groupBy("shot").agg(F.min("bin").alias("end"))
    kept = binned.join(ends, "shot", "left").filter(F.col("end").isNull() | (F.col("bin") < F.col("end")))
    return kept.select(*refl.columns)


def significance_ladder(refl: DataFrame, steps: int = 6) -> DataFrame:
    """(step, n, rmsd): reflections of i / sqrt(var) >= 0, 1, .. and the root mean square of their offsets (dx, dy)."""
    ratio = F.col("i") / F.sqrt("var")
    row = refl.agg(*(x for k in range(steps) for x in (
        F.count_if(ratio >= k).alias(f"n{k}"), F.sqrt(F.avg(F.when(ratio >= k, F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias(f"r{k}"))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"n{k}").alias("n"), F.coalesce(f"r{k}", F.lit(0.0)).alias("rmsd")) for k in range(steps)))))


def median_offset(refl: DataFrame) -> DataFrame:
    """One row (n, offset): the median distance of observed from calculated positions."""
    size = refl.select(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("size"))
    return refl.agg(F.count("*").alias("n")).withColumn("offset", F.lit(median(size, "size")).cast("double"))
