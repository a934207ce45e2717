"""Sources and sinks: rotation grids, experiment lists, shot tables, snapshots, scales."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxelweave.operators.order import ranked
from voxelweave.operators.rotations import QUATERNION_SCHEMA

_RECORD = struct.Struct("<5d")


class QuaternionFile(DataSource):
    """``spark.read.format("quaternions").option("path", file)``: a rotation grid, as text (a line with the count, then five numbers a line) or binary
    (an int32 count, then five float64 each): three vector parts after the scalar, and the weight. Columns: r, q0..q3, weight, q0 the scalar.

    The file has to be readable from executors; large ones are read in ranges of records. Option ``scalar`` tells where a record has its scalar: first (default) or last.
    """

    @classmethod
    def name(cls) -> str:
        return "quaternions"

    def schema(self) -> str:
        return QUATERNION_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _QuaternionReader(self.options)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))


class _QuaternionReader(DataSourceReader):
    PART = 1_000_000

    def __init__(self, options):
        self.path, self.last = options["path"], options.get("scalar", "first") == "last"

    def _is_text(self) -> bool:
        with open(self.path, "rb") as f:
            head = f.read(64)
        return bool(head) and all(32 <= c < 127 or c in b"\r\n\t" for c in head)

    def partitions(self) -> list[InputPartition]:
        if self._is_text():
            return [_Range(0, -1)]
        with open(self.path, "rb") as f:
            (n,) = struct.unpack("<i", f.read(4))
        return [_Range(a, min(n, a + self.PART)) for a in range(0, n, self.PART)] or [_Range(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, stop = partition.value
        if stop < 0:
            with open(self.path) as f:
                next(f, None)
                for k, line in enumerate(x for x in f if x.strip()):
                    yield self._row(k, [float(x) for x in line.split()[:5]])
            return
        with open(self.path, "rb") as f:
            f.seek(4 + start * _RECORD.size)
            for k in range(start, stop):
                yield self._row(k, list(_RECORD.unpack(f.read(_RECORD.size))))

    def _row(self, k: int, v: list[float]) -> tuple:
        return (k, v[3], v[0], v[1], v[2], v[4]) if self.last else (k, *v)


def write_quaternions(quaternions: DataFrame, path: str) -> int:
    """Write a grid as a binary file on the driver (a grid is a parameter of the search, not data); returns the number of rotations."""
    rows = quaternions.select("q0", "q1", "q2", "q3", "weight").orderBy("r").toLocalIterator() if "r" in quaternions.columns else quaternions.toLocalIterator()
    n = 0
    with open(path, "wb") as f:
        f.write(struct.pack("<i", 0))
        for row in rows:
            f.write(_RECORD.pack(*row))
            n += 1
        f.seek(0)
        f.write(struct.pack("<i", n))
    return n


def experiment_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(line, experiment, reflections) of text lines of two names each; blank lines are passed over, others raise when they are read."""
    parts = F.split(F.trim(col), r"\s+")
    ok = F.size(parts) == 2
    rows = lines.filter(F.trim(col) != "")
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("not an experiment and a reflection file: "), F.col(col))))
    return rows.select(*(c for c in lines.columns if c != col), F.get(checked, F.lit(0)).alias("experiment"), F.get(checked, F.lit(1)).alias("reflections"))


def halves(shots: DataFrame, key: str = "shot") -> DataFrame:
    """``shots`` with half, 0 or 1, by turns in the order of ``key``."""
    ranks = ranked(shots.select(key).distinct(), [key]).select(key, (F.col("place") % 2).cast("int").alias("half"))
    return shots.join(ranks, key)


def head(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key``."""
    return rows.orderBy(key).limit(n)


def usable_shots(shots: DataFrame, prob_rot: DataFrame, least: int, most: int) -> DataFrame:
    """(shot, n_rot) of shots with ``least`` to ``most`` probable rotations."""
    n = prob_rot.groupBy("shot").agg(F.count("*").alias("n_rot"))
    return shots.select("shot").join(n, "shot").filter(F.col("n_rot").between(least, most))


def trusted(pixels: DataFrame, low: float, high: float, col: str = "v") -> DataFrame:
    """``pixels`` above ``low`` and below ``high``."""
    return pixels.filter((F.col(col) > low) & (F.col(col) < high))


def write_snapshot(voxels: DataFrame, path: str, iteration: int, max_q: float, cell) -> None:
    """A density and its description under ``path``/iter=N; a snapshot of the same number is replaced as a whole."""
    at = f"{path}/iter={iteration}"
    voxels.select("vox", "w").write.mode("overwrite").parquet(f"{at}/density")
    cell_values = (cell.a, cell.b, cell.c, cell.alpha, cell.beta, cell.gamma)
    voxels.sparkSession.createDataFrame([(max_q, [float(x) for x in cell_values])], "max_q double, cell array<double>").write.mode("overwrite").parquet(f"{at}/about")


def read_snapshot(spark: SparkSession, path: str, iteration: int, n: int | None = None) -> DataFrame:
    """(vox, w); with ``n`` the whole cube, voxels that were masked being 0."""
    found = spark.read.schema("vox int, w double").parquet(f"{path}/iter={iteration}/density")
    if n is None:
        return found
    every = spark.range(n ** 3).select(F.col("id").cast("int").alias("vox"))
    return every.join(found, "vox", "left").select("vox", F.coalesce("w", F.lit(0.0)).alias("w"))


def restarted_scales(shots: DataFrame, saved: DataFrame) -> DataFrame:
    """(shot, name, phi) with the scales of ``saved`` (name, phi); a shot without one raises when its row is read."""
    both = shots.select("shot", "name").join(saved.select("name", F.col("phi").alias("found")), "name", "left")
    missing = F.raise_error(F.concat(F.lit("no saved scale for "), F.col("name"))).cast("double")
    return both.select("shot", "name", F.when(F.col("found").isNotNull(), F.col("found")).otherwise(missing).alias("phi"))


def iteration_of(name: Column) -> Column:
    """The number in a snapshot's file name, such as Witer12.h5."""
    return F.regexp_extract(name, r"(?:.*/)?[A-Za-z_]*?iter(\d+)\.[A-Za-z0-9]+$", 1).cast("int")


def in_order(names: DataFrame, col: str = "name") -> DataFrame:
    """(name, iteration, place) by iteration; names without one are left out."""
    n = names.withColumn("iteration", F.when(F.col(col).rlike(r"iter\d+\.[A-Za-z0-9]+$"), iteration_of(F.col(col)))).filter("iteration IS NOT NULL")
    out = ranked(n.select(F.col(col).alias("name"), "iteration"), ["iteration", "name"])
    return out.withColumn("place", (F.col("place") + 1).cast("int"))


def write_inputs(shots: DataFrame, shot_px: DataFrame, prob_rot: DataFrame, path: str) -> None:
    """One row a shot (name, shot, phi, rots, t, k, b), ragged columns as arrays, pixels in the order of t; what a reconstruction reads."""
    px = shot_px.groupBy("shot").agg(F.sort_array(F.collect_list(F.struct("t", "k", "b"))).alias("p"))
    rots = prob_rot.groupBy("shot").agg(F.sort_array(F.collect_set("r")).alias("rots"))
    rows = shots.join(px, "shot").join(rots, "shot").select("name", "shot", "phi", "rots", *(F.col(f"p.{c}").alias(c) for c in "tkb"))
    rows.write.mode("overwrite").parquet(path)


def read_inputs(spark: SparkSession, path: str, least: int, most: int, limit: int | None = None) -> DataFrame:
    """Shots of ``least`` to ``most`` probable rotations, the first ``limit`` by name if that is given."""
    found = spark.read.parquet(path).filter(F.size("rots").between(least, most))
    return found if limit is None else found.orderBy("name").limit(limit)


def photons(image: DataFrame, per_photon: float = 1.0) -> DataFrame:
    """``image`` (.., v) in photons: detector units over the units of one photon."""
    if not per_photon > 0:
        raise ValueError("a photon has a positive number of detector units")
    return image.withColumn("v", F.col("v") / per_photon)


def write_table(rows: DataFrame, path: str) -> None:
    """A table of pixels (q-map; radial bin, polarization, solid angle, correction), of backgrounds by shot, or of residuals, for a later run."""
    rows.write.mode("overwrite").parquet(path)


def write_probabilities(p: DataFrame, path: str, iteration: int) -> None:
    """(shot, r, p) under ``path``/iter=N."""
    p.select("shot", "r", "p").write.mode("overwrite").parquet(f"{path}/iter={iteration}")


def cached_by_shot(rows: DataFrame, path: str, work) -> DataFrame:
    """``work`` of ``rows``, shot by shot: shots that ``path`` has are read from it, the others are worked out and added to it."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        work(rows).write.parquet(path)
        return spark.read.parquet(path)
    shots = rows.select("shot").distinct()
    known = spark.read.parquet(path).select("shot").distinct()
    new = shots.join(known, "shot", "left_anti")
    work(rows.join(new, "shot", "left_semi")).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(shots, "shot", "left_semi")
