"""The operators' inputs as views of the given tables, whole tables each. The SQL of the same views is in oracle.py."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.config import Beam, Cell, Detector, Grid
from voxelweave.operators import background, grid as g, rotations

GRID = Grid(16, 0.25)
CELL = Cell(20.0, 20.0, 16.0)
DETECTOR, BEAM = Detector(), Beam()
GROUP = "P43212"
#: Likelihoods of the fixtures are far apart; this keeps several rotations of a shot probable.
BETA, MIN_P = 2e-5, 0.01
RADIAL_BINS = 24
SIDE = 48
SPOT_SHOTS = 2000
#: Of intensities: prices are whole cents, and means of them would end on the half of a rounded digit.
UNIT = 50 ** 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def rotation_rows() -> list[tuple]:
    """(r, m00..m22): the 24 rotations of the cube, then the 60 of the icosahedral grid."""
    mats = []
    for perm in itertools.permutations(range(3)):
        for signs in itertools.product((1.0, -1.0), repeat=3):
            m = np.zeros((3, 3))
            m[range(3), perm] = signs
            if np.linalg.det(m) > 0:
                mats.append(m)
    for a, x, y, z, _ in rotations.quaternion_grid(1):
        u = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * a), 2 * (x * z + y * a)], [2 * (x * y + z * a), 1 - 2 * (x * x + z * z), 2 * (y * z - x * a)], [2 * (x * z - y * a), 2 * (y * z + x * a), 1 - 2 * (x * x + y * y)]])
        mats.append(u.T)
    return [(k, *(float(v) for v in m.ravel())) for k, m in enumerate(mats)]


def rotation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rotation_rows(), "r int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))


def pixel(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = [(0.8 * F.col("embedding")[k].cast("double")).alias(n) for k, n in enumerate(g.QS)]
    return e.select(F.col("vec_id").cast("int").alias("t"), *q, (F.col("label") != 0).alias("trusted"))


def _per_shot(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").count()


def shot_px(spark: SparkSession, sf: str) -> DataFrame:
    n = _per_shot(spark, sf)
    return table(spark, sf, "events").select(
        F.expr(f"cast(event_id div {n} AS int)").alias("shot"), (F.col("event_id") % n).cast("int").alias("t"), F.col("value").alias("k"), (0.05 * (F.col("event_id") % 7)).alias("b"))


def shot(spark: SparkSession, sf: str) -> DataFrame:
    s = shot_px(spark, sf).select("shot").distinct()
    return s.select("shot", (0.5 + 0.25 * (F.col("shot") % 4)).alias("phi"), F.concat(F.lit("shot"), F.col("shot").cast("string")).alias("name"))


def voxel(spark: SparkSession, sf: str) -> DataFrame:
    vox = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % GRID.n ** 3).cast("int")
    return table(spark, sf, "lineitem").groupBy(vox.alias("vox")).agg((F.sum("l_quantity") / 100).alias("w"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return voxel(spark, sf).filter("vox % 3 <> 0").select("vox")


def prob_rot(spark: SparkSession, sf: str) -> DataFrame:
    return shot(spark, sf).select("shot").join(F.broadcast(rotation(spark).select("r")), (F.col("shot") + F.col("r")) % 3 == 0)


def _hkl(order: DataFrame) -> DataFrame:
    index = [(F.col("o_orderkey") % 9 - 4).cast("int").alias("h"), (F.col("o_custkey") % 9 - 4).cast("int").alias("k"), (F.dayofmonth("o_orderdate") % 9 - 4).cast("int").alias("l")]
    return order.select(*index, "*")


def hkl(spark: SparkSession, sf: str) -> DataFrame:
    return _hkl(table(spark, sf, "orders")).groupBy("h", "k", "l").agg((F.avg("o_totalprice") / UNIT).alias("i"))


def hkl_ref(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(_hkl(table(spark, sf, "orders")), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("h", "k", "l").agg((F.avg("l_extendedprice") / UNIT).alias("i"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(h, k, l, i1, i2, d) of both tables' common indices; d is the resolution of the index."""
    from voxelweave.operators import peaks

    q = [F.col(n) * float(x) for n, x in zip("hkl", np.diag(CELL.from_hkl()))]
    size = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
    return peaks.common(hkl(spark, sf), hkl_ref(spark, sf)).filter("NOT (h = 0 AND k = 0 AND l = 0)").select("*", (1.0 / size).alias("d"))


def refl(spark: SparkSession, sf: str) -> DataFrame:
    o = _hkl(table(spark, sf, "orders"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        (key % SPOT_SHOTS).cast("int").alias("shot"), key.alias("refl_id"), (key * 7 % 40).cast("int").alias("x1"), (key * 7 % 40 + 1 + key % 5).cast("int").alias("x2"),
        (cust * 11 % 40).cast("int").alias("y1"), (cust * 11 % 40 + 1 + cust % 4).cast("int").alias("y2"),
        (key * 37 % 1000 / 1000.0 * 0.4 - 0.2).alias("qx"), (cust * 53 % 1000 / 1000.0 * 0.4 - 0.2).alias("qy"), (key * 71 % 997 / 1000.0 * 0.4 - 0.2).alias("qz"),
        "h", "k", "l", F.col("o_totalprice").alias("i"), (F.col("o_totalprice") * (1 + key % 3) * 1000).alias("var"), (F.col("o_orderstatus") != "P").alias("indexed"),
        (key % 13 / 10.0 - 0.6).alias("dx"), (cust % 17 / 10.0 - 0.8).alias("dy"),
    )


def image(spark: SparkSession, sf: str) -> DataFrame:
    n = SIDE * SIDE
    return table(spark, sf, "events").select(
        F.expr(f"cast(event_id div {n} AS int)").alias("shot"), (F.col("event_id") % n % SIDE).cast("int").alias("x"), F.expr(f"cast(event_id % {n} div {SIDE} AS int)").alias("y"), (F.col("value") / UNIT).alias("v"))


@lru_cache(1)
def radial_edges() -> tuple[float, float]:
    """(first edge, step) of the radial bins: equal steps from just below the least |q| of the detector to just above the largest."""
    x, y = np.meshgrid(np.arange(DETECTOR.n_fast), np.arange(DETECTOR.n_slow))
    k = [o + x * (f * DETECTOR.pixel) + y * (s * DETECTOR.pixel) for o, f, s in zip(DETECTOR.origin, DETECTOR.fast, DETECTOR.slow)]
    size = np.sqrt(sum(c * c for c in k))
    q = np.sqrt(sum(((c / size - s) / BEAM.wavelength) ** 2 for c, s in zip(k, BEAM.direction)))
    low, high = float(q.min()) - 1e-6, float(q.max()) + 1e-6
    return low, (high - low) / RADIAL_BINS


def bins(spark: SparkSession) -> DataFrame:
    """(x, y, qbin) of trusted pixels."""
    low, step = radial_edges()
    q = background.q_map(background.trusted_pixels(background.detector_pixels(spark, DETECTOR), DETECTOR), DETECTOR, BEAM)
    size = F.sqrt(F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy") + F.col("qz") * F.col("qz"))
    return q.select("x", "y", (F.floor((size - low) / step).cast("int") + 1).alias("qbin"))


def model(spark: SparkSession, sf: str) -> DataFrame:
    from voxelweave.operators import likelihood

    return likelihood.model_values(pixel(spark, sf), rotation(spark), voxel(spark, sf), GRID)


def terms(spark: SparkSession, sf: str) -> DataFrame:
    from voxelweave.operators import likelihood

    probable = prob_rot(spark, sf)
    values = likelihood.model_values(pixel(spark, sf), rotation(spark), voxel(spark, sf), GRID, probable)
    return likelihood.pixel_terms(values, shot_px(spark, sf), shot(spark, sf), probable)


def pdr(spark: SparkSession, sf: str) -> DataFrame:
    from voxelweave.operators import likelihood

    return likelihood.probabilities(likelihood.log_likelihood(terms(spark, sf)), BETA, MIN_P)
