"""One query for each operator over the fixture views, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.functions import scalars
from voxelweave.operators import background as bg
from voxelweave.operators import evaluate as ev
from voxelweave.operators import grid as g
from voxelweave.operators import likelihood as ll
from voxelweave.operators import orient, peaks, rotations, update
from voxelweave.plans import fixtures as f
from voxelweave.plans import oracle as o
from voxelweave.plans import reconstruct
from voxelweave.session import shared_folder
from voxelweave.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GRID, CELL, N = f.GRID, f.CELL, f.GRID.n
C, D = o.C, o.D
M = o.M
#: Bounds of the orientation search on the fixtures.
CUT, LEAST = 0.25, 2


def query(name: str, sql: str | None = None):
    def add(fun):
        QUERIES[name] = fun
        if sql is not None:
            ORACLE[name] = o.sql(sql)
        return fun

    return add


def r6(x: Column | str, name: str, places: int = 6) -> Column:
    return (F.round(x, places) + 0.0).alias(name)


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.select(*(r6(c, c, places) if c in cols else F.col(c) for c in df.columns))


# ---------------------------------------------------------------- projections and scalar functions

_POINTS = "SELECT r, t, qx, qy, qz FROM rotpx"


@query("rotate_q", f"SELECT r, t, {o.r6('qx', 'qx')}, {o.r6('qy', 'qy')}, {o.r6('qz', 'qz')} FROM rotpx")
def rotate_q(spark, sf):
    return rounded(g.rotated(f.pixel(spark, sf).filter("trusted").select("t", *g.QS), f.rotation(spark)).select("r", "t", *g.QS), *g.QS)


_INSIDE = " AND ".join(f"floor(({q} - ({C})) / {D}) BETWEEN 0 AND {N - 2}" for q in g.QS)


@query("qs_inbounds", f"SELECT r, count(*) AS n, count(*) FILTER (WHERE {_INSIDE}) AS n_in FROM rotpx GROUP BY r")
def qs_inbounds(spark, sf):
    p = g.rotated(f.pixel(spark, sf).filter("trusted").select("t", *g.QS), f.rotation(spark))
    return p.groupBy("r").agg(F.count("*").alias("n"), F.count_if(g.in_bounds([F.col(q) for q in g.QS], GRID)).alias("n_in"))


@query("errdiv", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(value / (event_id % 5), 6) + 0.0 END AS q FROM events")
def errdiv(spark, sf):
    e = f.table(spark, sf, "events")
    return e.select("event_id", r6(scalars.errdiv(F.col("value"), (F.col("event_id") % 5).cast("double")), "q"))


@query("reparam_roundtrip", "SELECT vox, round(sqrt((w + 1) * (w + 1) - 1), 6) + 0.0 AS x, round(w, 6) + 0.0 AS back, round(sqrt((w + 1) * (w + 1) - 1) / (w + 1), 6) + 0.0 AS slope FROM voxels")
def reparam_roundtrip(spark, sf):
    v = f.voxel(spark, sf).withColumn("x", scalars.to_unbounded(F.col("w")))
    return v.select("vox", r6("x", "x"), r6(scalars.from_unbounded(F.col("x")), "back"), r6(scalars.slope_of_density(F.col("x")), "slope"))


@query("density_floor", "SELECT vox, CASE WHEN w0 = 0 THEN least(1e-7, (SELECT min(w) FROM voxels WHERE vox % 5 <> 0 AND w > 0)) ELSE round(w0, 6) + 0.0 END AS w FROM (SELECT vox, CASE WHEN vox % 5 = 0 THEN 0 ELSE w END AS w0 FROM voxels)")
def density_floor(spark, sf):
    v = f.voxel(spark, sf).select("vox", F.when(F.col("vox") % 5 == 0, 0.0).otherwise(F.col("w")).alias("w"))
    return g.density_floor(v).select("vox", F.when(F.col("w") > 1e-6, F.round("w", 6) + 0.0).otherwise(F.col("w")).alias("w"))


@query("pixel_qmap", f"SELECT x, y, {', '.join(o.r6(q, q) for q in g.QS)} FROM detq")
def pixel_qmap(spark, sf):
    return rounded(bg.q_map(bg.detector_pixels(spark, f.DETECTOR), f.DETECTOR, f.BEAM), *g.QS)


@query("solid_angle", "SELECT x, y, round(omega, 12) + 0.0 AS omega FROM detf")
def solid_angle(spark, sf):
    return bg.detector_pixels(spark, f.DETECTOR).select("x", "y", r6(bg.solid_angle(f.DETECTOR), "omega", 12))


@query("polarization", f"SELECT x, y, {o.r6('polar', 'polar')} FROM detf")
def polarization(spark, sf):
    return bg.detector_pixels(spark, f.DETECTOR).select("x", "y", r6(bg.polarization(f.DETECTOR, f.BEAM), "polar"))


@query("geom_correction", f"SELECT x, y, {o.r6('polar * omega / (SELECT avg(polar * omega) FROM detf)', 'f')} FROM detf")
def geom_correction(spark, sf):
    return rounded(bg.correction(bg.detector_pixels(spark, f.DETECTOR), f.DETECTOR, f.BEAM), "f")


@query("mask_rects", f"SELECT shot, x, y, v FROM image WHERE NOT ({o._MASKED})")
def mask_rects(spark, sf):
    return bg.trusted_pixels(f.image(spark, sf), f.DETECTOR)


_CENTRES = o.centres("voxels", "vox")


@query("voxel_resolution", f"SELECT vox, {o.r6('1 / sqrt(qx * qx + qy * qy + qz * qz)', 'd')} FROM {_CENTRES}")
def voxel_resolution(spark, sf):
    return rounded(g.resolution(f.voxel(spark, sf), GRID), "d")


@query("voxel_shell", f"SELECT vox, {o.r6('d', 'd')} FROM (SELECT vox, 1 / sqrt(qx * qx + qy * qy + qz * qz) AS d FROM {_CENTRES}) WHERE d >= 4.0 AND d <= 12.0")
def voxel_shell(spark, sf):
    return rounded(g.shell(f.voxel(spark, sf), GRID, 4.0, 12.0), "d")


_LENGTHS = np.linalg.norm(CELL.from_hkl(), axis=0)
_FRAC = o.matvec([repr(float(x)) for x in CELL.to_hkl().ravel()], list(g.QS))
_MISS = " + ".join(f"{float(20.0 * s / _LENGTHS[0]) ** 2!r} * (ceil(h{k} - 0.5) - h{k}) * (ceil(h{k} - 0.5) - h{k})" for k, s in enumerate(_LENGTHS))


@query("w_init", f"SELECT vox, {o.r6(f'exp(-({_MISS}) * 2 / 0.63)', 'w')} FROM (SELECT vox, {', '.join(f'{e} AS h{k}' for k, e in enumerate(_FRAC))} FROM {_CENTRES})")
def w_init(spark, sf):
    return rounded(g.start_density(f.voxel(spark, sf), CELL, GRID), "w")


#: Average signal level that the fixtures' start density is scaled to.
_SIGNAL = 3.25


@query("w_init_normalized", f"SELECT vox, {o.r6(f'w / max(w) OVER () * {_SIGNAL!r}', 'w')} FROM (SELECT vox, exp(-({_MISS}) * 2 / 0.63) AS w FROM (SELECT vox, {', '.join(f'{e} AS h{k}' for k, e in enumerate(_FRAC))} FROM {_CENTRES}))")
def w_init_normalized(spark, sf):
    return rounded(g.normalized_start(g.start_density(f.voxel(spark, sf), CELL, GRID), _SIGNAL), "w")


@query("hkl_max", "SELECT " + ", ".join(f"CAST({m} AS INTEGER) AS {n}" for m, n in zip(g.hkl_limits(CELL, GRID.max_q), ("max_h", "max_k", "max_l"))))
def hkl_max(spark, sf):
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}D, {b}D, {c}D)" for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)) + " AS t(sx, sy, sz)")
    h = scalars.times_vector([F.lit(float(x)) for x in CELL.to_hkl().ravel()], [F.col(s) * GRID.max_q for s in ("sx", "sy", "sz")])
    return rows.agg(*(F.max(x).cast("int").alias(n) for x, n in zip(h, ("max_h", "max_k", "max_l"))))


@query("hkl_residual", f"SELECT shot, r, refl_id, {o.r6('residual', 'residual')} FROM resid WHERE residual < 0.08")
def hkl_residual(spark, sf):
    return rounded(_residuals(spark, sf).filter("residual < 0.08").select("shot", "r", "refl_id", "residual"), "residual")


def _residuals(spark, sf):
    return orient.residuals(f.refl(spark, sf).select("shot", "refl_id", *g.QS), f.rotation(spark), CELL)


_SMALL = [(k, *map(float, x)) for k, x in enumerate(orient.small_rotations(1.0, 1.0))]
_TURNED = ", ".join(o.r6(" + ".join(f"m{i}{k} * x{j}{k}" for k in range(3)), f"m{i}{j}") for i in range(3) for j in range(3))


@query("rot_subsample", f"SELECT shot, r, d, {_TURNED} FROM prob_rot JOIN rot USING (r), (VALUES {o._rows(_SMALL)}) s(d, {', '.join(f'x{i}{j}' for i in range(3) for j in range(3))})")
def rot_subsample(spark, sf):
    near = orient.perturbed(f.prob_rot(spark, sf), f.rotation(spark), orient.perturbations(spark, 1.0, 1.0))
    return rounded(near, *M)


# ---------------------------------------------------------------- sources


_Q = ", ".join(f"CAST(embedding[{k + 4}] AS DOUBLE) AS e{k}" for k in range(4))
_U = [("1 - 2 * (b * b + c * c)", "2 * (a * b - c * s)", "2 * (a * c + b * s)"), ("2 * (a * b + c * s)", "1 - 2 * (a * a + c * c)", "2 * (b * c - a * s)"), ("2 * (a * c - b * s)", "2 * (b * c + a * s)", "1 - 2 * (a * a + b * b)")]


@query("quat_to_matrix", f"SELECT r, {', '.join(o.r6(_U[j][i], f'm{i}{j}') for i in range(3) for j in range(3))} FROM (SELECT r, e0 / n AS s, e1 / n AS a, e2 / n AS b, e3 / n AS c FROM (SELECT CAST(vec_id AS INTEGER) AS r, e0, e1, e2, e3, sqrt(e0 * e0 + e1 * e1 + e2 * e2 + e3 * e3) AS n FROM (SELECT vec_id, {_Q} FROM embeddings)))")
def quat_to_matrix(spark, sf):
    e = f.table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("r"), *(F.col("embedding")[k + 3].cast("double").alias(f"e{k}") for k in range(4)))
    n = F.sqrt(sum((F.col(f"e{k}") * F.col(f"e{k}") for k in range(1, 4)), F.col("e0") * F.col("e0")))
    q = e.select("r", *((F.col(f"e{k}") / n).alias(f"q{k}") for k in range(4)), F.lit(1.0).alias("weight"))
    return rounded(rotations.matrices(q).drop("weight"), *M)


@query("quat_grid_count", "SELECT CAST(n AS INTEGER) AS n, CAST(10 * (5 * n * n * n + n) AS BIGINT) AS n_rot, CAST(1.0 AS DOUBLE) AS weight FROM range(1, 4) t(n)")
def quat_grid_count(spark, sf):
    out = None
    for n in (1, 2, 3):
        grid = rotations.rotation_grid(spark, n)
        ok = F.abs(sum((F.col(f"q{k}") * F.col(f"q{k}") for k in range(1, 4)), F.col("q0") * F.col("q0")) - 1) < 1e-9
        row = grid.filter(ok).agg(F.lit(n).alias("n"), F.count_distinct(*(F.round(f"q{k}", 9) for k in range(4))).alias("n_rot"), r6(F.sum("weight"), "weight"))
        out = row if out is None else out.unionByName(row)
    return out


_V4 = ", ".join(f"({k}, {', '.join(map(o._number, map(float, v)))})" for k, v in enumerate(rotations.vertices()))


def _grid_sql(n: int, places: int) -> str:
    """The grid of ``n`` subdivisions from the vertices of the 600-cell: points of vertices, edges, faces and cells, and their weights."""
    def point(*terms: str) -> str:
        return ", ".join("(" + " + ".join(f"{w} * {t}.{c}" for w, t in zip(terms, "xyzu")) + f") / {n} AS {c}" for c in "abcd")

    at = "JOIN v x ON x.i = m.i JOIN v y ON y.i = m.j"
    return f"""WITH v AS MATERIALIZED (SELECT * FROM (VALUES {_V4}) t(i, a, b, c, d)),
near AS MATERIALIZED (SELECT x.i AS i, y.i AS j FROM v x JOIN v y ON x.i < y.i AND x.a * y.a + x.b * y.b + x.c * y.c + x.d * y.d > 0.8),
tri AS MATERIALIZED (SELECT m.i, m.j, e.j AS k FROM near m JOIN near e ON e.i = m.j JOIN near c ON c.i = m.i AND c.j = e.j),
tet AS (SELECT m.i, m.j, m.k, e.j AS l FROM tri m JOIN near e ON e.i = m.k JOIN near c ON c.i = m.i AND c.j = e.j JOIN near d ON d.i = m.j AND d.j = e.j),
s AS (SELECT CAST(k AS DOUBLE) AS n FROM range(1, {n}) t(k)),
pts AS (SELECT a, b, c, d, 5 / 6 AS share FROM v
  UNION ALL SELECT {point('p.n', f'({n} - p.n)')}, 35 / 36 FROM near m {at}, s p
  UNION ALL SELECT {point('p.n', 'q.n', f'({n} - p.n - q.n)')}, 1 FROM tri m {at} JOIN v z ON z.i = m.k, s p, s q WHERE p.n + q.n < {n}
  UNION ALL SELECT {point('p.n', 'q.n', 'r.n', f'({n} - p.n - q.n - r.n)')}, 1 FROM tet m {at} JOIN v z ON z.i = m.k JOIN v u ON u.i = m.l, s p, s q, s r WHERE p.n + q.n + r.n < {n}),
sized AS (SELECT *, a * a + b * b + c * c + d * d AS s FROM pts WHERE CASE WHEN abs(a) > 1e-9 THEN a WHEN abs(b) > 1e-9 THEN b WHEN abs(c) > 1e-9 THEN c ELSE d END > 0)
SELECT {', '.join(o.r6(f'{c} / sqrt(s)', f'q{k}') for k, c in enumerate('abcd'))}, round(share / (s * s) / sum(share / (s * s)) OVER (), {places}) AS weight FROM sized"""


def _grid(spark, n: int, places: int) -> DataFrame:
    return rounded(rotations.rotation_grid(spark, n).drop("r"), "q0", "q1", "q2", "q3").withColumn("weight", F.round("weight", places))


@query("quat_grid_weights", _grid_sql(3, 9))
def quat_grid_weights(spark, sf):
    """Every rotation of the grid of 3 subdivisions and its weight."""
    return _grid(spark, 3, 9)


@query("quat_grid_20", _grid_sql(20, 10))
def quat_grid_20(spark, sf):
    """The grid of 20 subdivisions, 400,200 rotations."""
    return _grid(spark, 20, 10)


@query("quat_ico_reduce", "SELECT CAST(n AS INTEGER) AS n, CAST(10 * (5 * n * n * n + n) / 60 AS BIGINT) AS n_rot, CAST(1.0 AS DOUBLE) AS weight FROM range(5, 7) t(n)")
def quat_ico_reduce(spark, sf):
    out = None
    for n in (5, 6):
        row = rotations.reduced(rotations.rotation_grid(spark, n)).agg(F.lit(n).alias("n"), F.count("*").alias("n_rot"), r6(F.sum("weight"), "weight"))
        out = row if out is None else out.unionByName(row)
    return out


@query("expt_refl_parse", "SELECT o_orderkey, 'run' || o_custkey || '.expt' AS experiment, 'run' || o_custkey || '_' || o_orderkey || '.refl' AS reflections FROM orders")
def expt_refl_parse(spark, sf):
    t = f.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" run"), F.col("o_custkey"), F.lit(".expt   run"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey"), F.lit(".refl")).alias("value"))
    return files.experiment_lines(t)


@query("half_split", "SELECT shot, CAST((row_number() OVER (ORDER BY shot) - 1) % 2 AS INTEGER) AS half FROM shots")
def half_split(spark, sf):
    return files.halves(f.shot(spark, sf).select("shot"))


@query("emc_input_filter", "SELECT shot, n_rot FROM (SELECT shot, count(*) AS n_rot FROM prob_rot WHERE r >= shot % 8 GROUP BY shot) WHERE n_rot BETWEEN 26 AND 28")
def emc_input_filter(spark, sf):
    return files.usable_shots(f.shot(spark, sf), f.prob_rot(spark, sf).filter(F.col("r") >= F.col("shot") % 8), 26, 28)


@query("trusted_range", "SELECT shot, x, y, v FROM image WHERE v > 1 AND v < 60")
def trusted_range(spark, sf):
    return files.trusted(f.image(spark, sf), 1, 60)


@query("head_n", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def head_n(spark, sf):
    return files.head(f.table(spark, sf, "events").select("event_id", "value"), "event_id", 100)


@query("iter_from_name", "SELECT 'out/Witer' || vec_id % 997 || '.h5' AS name, CAST(vec_id % 997 AS INTEGER) AS iteration, CAST(row_number() OVER (ORDER BY vec_id % 997, 'out/Witer' || vec_id % 997 || '.h5') AS INTEGER) AS place FROM embeddings")
def iter_from_name(spark, sf):
    return files.in_order(f.table(spark, sf, "embeddings").select(F.concat(F.lit("out/Witer"), F.col("vec_id") % 997, F.lit(".h5")).alias("name")))


@query("scale_restart_join", "SELECT s.shot, s.name, round(1.5 * s.phi, 6) + 0.0 AS phi FROM shots s")
def scale_restart_join(spark, sf):
    s = f.shot(spark, sf)
    return rounded(files.restarted_scales(s, s.select("name", (F.col("phi") * 1.5).alias("phi"))), "phi")


@query("emc_input_roundtrip", "SELECT 'shot' || shot AS name, shot, n_rot, CAST(n_px AS INTEGER) AS n_px FROM (SELECT shot, count(*) AS n_rot FROM prob_rot GROUP BY shot) JOIN (SELECT shot, count(*) AS n_px FROM shot_px GROUP BY shot) USING (shot) WHERE n_rot BETWEEN 1 AND 40")
def emc_input_roundtrip(spark, sf):
    path = f"{shared_folder(spark)}/inputs-{uuid.uuid4().hex}"
    files.write_inputs(f.shot(spark, sf), f.shot_px(spark, sf), f.prob_rot(spark, sf), path)
    found = files.read_inputs(spark, path, 1, 40)
    return found.select("name", "shot", F.size("rots").cast("long").alias("n_rot"), F.size("k").alias("n_px"))


@query("background_cache", "SELECT shot, count(*) AS n FROM image GROUP BY shot")
def background_cache(spark, sf):
    """Backgrounds of even shots come from a cache, those of odd ones are worked out."""
    image = f.image(spark, sf)
    path = f"{shared_folder(spark)}/backgrounds-{uuid.uuid4().hex}"
    flat = lambda part: part.select("shot", "x", "y", F.lit(1.0).alias("bg"))
    files.cached_by_shot(image.filter("shot % 2 = 0"), path, flat)
    return files.cached_by_shot(image, path, flat).groupBy("shot").agg(F.count("*").alias("n"))


@query("photon_image", f"SELECT shot, x, y, {o.r6('v / 2.5', 'v')} FROM image")
def photon_image(spark, sf):
    return rounded(files.photons(f.image(spark, sf), 2.5), "v")


def _reread(spark, rows: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files.write_table(rows, path)
    return spark.read.parquet(path)


@query("qmap_roundtrip", f"SELECT x, y, {', '.join(o.r6(q, q) for q in g.QS)} FROM detq")
def qmap_roundtrip(spark, sf):
    return rounded(_reread(spark, bg.q_map(bg.detector_pixels(spark, f.DETECTOR), f.DETECTOR, f.BEAM), "qmap"), *g.QS)


@query("emc_input_geometry", f"SELECT x, y, qbin, {o.r6('polar', 'polar')}, round(omega, 12) + 0.0 AS omega, {o.r6('polar * omega / (SELECT avg(polar * omega) FROM detf)', 'f')} FROM detf JOIN bins USING (x, y)")
def emc_input_geometry(spark, sf):
    """What the inputs of a reconstruction keep of the detector: radial bin, polarization, solid angle and correction of each trusted pixel."""
    pixels = bg.detector_pixels(spark, f.DETECTOR)
    factors = pixels.select("x", "y", bg.polarization(f.DETECTOR, f.BEAM).alias("polar"), bg.solid_angle(f.DETECTOR).alias("omega"))
    both = f.bins(spark).join(factors, ["x", "y"]).join(bg.correction(pixels, f.DETECTOR, f.BEAM), ["x", "y"])
    return _reread(spark, both, "geometry").select("x", "y", "qbin", r6("polar", "polar"), r6("omega", "omega", 12), r6("f", "f"))


@query("pdr_snapshot", f"SELECT shot, r, {o.r6('p', 'p')} FROM pdr")
def pdr_snapshot(spark, sf):
    path = f"{shared_folder(spark)}/probabilities-{uuid.uuid4().hex}"
    files.write_probabilities(f.pdr(spark, sf), path, 7)
    return rounded(spark.read.parquet(path).filter("iter = 7").select("shot", "r", "p"), "p")


@query("residual_table", f"SELECT shot, count(*) AS nref, {o.r6('avg(sqrt(dx * dx + dy * dy))', 'pred_offset')} FROM refl GROUP BY shot")
def residual_table(spark, sf):
    rows = f.refl(spark, sf).groupBy("shot").agg(F.count("*").alias("nref"), F.avg(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("pred_offset"))
    return rounded(_reread(spark, rows, "residuals"), "pred_offset")


_UNIFORM = [f"CAST('0x' || substr(md5('7:' || shot || ':{k}'), 1, 8) AS BIGINT) / 4294967296e0 AS u{k}" for k in range(3)]


@query("random_orientations", f"SELECT shot, {o.r6('sqrt(u0) * cos(2 * pi() * u2)', 'q0')}, {o.r6('sqrt(1 - u0) * sin(2 * pi() * u1)', 'q1')}, {o.r6('sqrt(1 - u0) * cos(2 * pi() * u1)', 'q2')}, {o.r6('sqrt(u0) * sin(2 * pi() * u2)', 'q3')} FROM (SELECT shot, {', '.join(_UNIFORM)} FROM (SELECT DISTINCT shot FROM refl))")
def random_orientations(spark, sf):
    return rounded(orient.random_quaternions(f.refl(spark, sf).select("shot").distinct(), "shot", 7), "q0", "q1", "q2", "q3")


@query("density_snapshot", f"SELECT CAST(i AS INTEGER) AS vox, round(coalesce(w, 0), 6) + 0.0 AS w FROM range({N ** 3}) t(i) LEFT JOIN (SELECT * FROM voxels JOIN masked USING (vox)) v ON v.vox = t.i")
def density_snapshot(spark, sf):
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    files.write_snapshot(f.voxel(spark, sf).join(f.mask(spark, sf), "vox", "left_semi"), path, 3, GRID.max_q, CELL)
    return rounded(files.read_snapshot(spark, path, 3, N), "w")


# ---------------------------------------------------------------- interpolation, insertion, symmetry

@query("trilerp", f"SELECT r, t, {o.r6('w', 'w')} FROM model")
def trilerp(spark, sf):
    return rounded(f.model(spark, sf), "w")


@query("trilerp_sparse", f"SELECT r, t, {o.r6('sum(a * coalesce(w, 0))', 'w')} FROM around LEFT JOIN (SELECT * FROM voxels JOIN masked USING (vox)) USING (vox) GROUP BY r, t")
def trilerp_sparse(spark, sf):
    v = f.voxel(spark, sf).join(f.mask(spark, sf), "vox", "left_semi")
    return rounded(ll.model_values(f.pixel(spark, sf), f.rotation(spark), v, GRID), "w")


_EVENTPX = "SELECT e.t, e.k, p.qx, p.qy, p.qz FROM shot_px e JOIN px p USING (t) WHERE p.trusted"


@query("trilinsert", f"SELECT vox, {o.r6('num', 'num')}, {o.r6('den', 'den')}, {o.r6('CASE WHEN den > 0 THEN num / den ELSE 0 END', 'w')} FROM (SELECT vox, sum(k * a) AS num, sum(a) AS den FROM {o.eight(f'({_EVENTPX})', 'k')} GROUP BY vox) WHERE den > 1e-9")
def trilinsert(spark, sf):
    points = f.shot_px(spark, sf).join(f.pixel(spark, sf).filter("trusted"), "t")
    return rounded(g.insert(points, F.col("k"), GRID).filter("den > 1e-9"), "num", "den", "w")


_BIN = ["CAST(CASE WHEN {q} = 0.25 THEN 15 ELSE floor(({q} + 0.25) / 0.03125) END AS INTEGER)".format(q=q) for q in g.QS]


@query("insert_slice", f"SELECT (ix * {N} + iy) * {N} + iz AS vox, count(*) AS counts, {o.r6('avg(k)', 'w')} FROM (SELECT k, {', '.join(f'{b} AS {i}' for b, i in zip(_BIN, ('ix', 'iy', 'iz')))} FROM ({_EVENTPX})) WHERE ix BETWEEN 0 AND {N - 1} AND iy BETWEEN 0 AND {N - 1} AND iz BETWEEN 0 AND {N - 1} GROUP BY 1")
def insert_slice(spark, sf):
    points = f.shot_px(spark, sf).join(f.pixel(spark, sf).filter("trusted"), "t")
    return rounded(g.insert_nearest(points, F.col("k"), GRID), "w")


@query("friedel", f"SELECT vox, {o.r6('0.5 * sum(w)', 'w')} FROM (SELECT vox, w FROM voxels UNION ALL SELECT {N ** 3 - 1} - vox, w FROM voxels) GROUP BY vox")
def friedel(spark, sf):
    return rounded(g.friedel(f.voxel(spark, sf), GRID), "w")


_MOVED = "(SELECT w, " + ", ".join(f"{e} AS {q}" for e, q in zip(o.matvec(M, ["c.qx", "c.qy", "c.qz"]), g.QS)) + f" FROM {o.centres('voxels', 'vox, w')} c, symop)"


@query("symmetrize", f"SELECT vox, {o.r6('CASE WHEN sum(a) > 0 THEN sum(w * a) / sum(a) ELSE 0 END', 'w')} FROM {o.eight(_MOVED, 'w')} GROUP BY vox")
def symmetrize(spark, sf):
    return rounded(g.symmetrize(f.voxel(spark, sf), g.symmetry_table(spark, f.GROUP), GRID), "w")


@query("sparse_rank", "SELECT vox, row_number() OVER (ORDER BY vox) - 1 AS place FROM masked")
def sparse_rank(spark, sf):
    return g.sparse_rank(f.mask(spark, sf))


@query("masked_update", f"SELECT v.vox, {o.r6('CASE WHEN m.vox IS NULL THEN v.w ELSE 2 * v.w END', 'w')} FROM voxels v LEFT JOIN masked m ON v.vox = m.vox")
def masked_update(spark, sf):
    v = f.voxel(spark, sf)
    return rounded(g.update_masked(v, v.join(f.mask(spark, sf), "vox", "left_semi").select("vox", (2 * F.col("w")).alias("w"))), "w")


_EDGE = ", ".join(f"CAST(greatest(0, least({N - 1}, ceil(({q} - ({C})) / {D} - 0.5))) AS INTEGER) AS {i}" for q, i in zip(g.QS, ("ix", "iy", "iz")))
_BALL = ", ".join(f"({x}, {y}, {z})" for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if abs(x) + abs(y) + abs(z) <= 2)


@query("whole_punch", f"SELECT DISTINCT ((ix + dx) * {N} + iy + dy) * {N} + iz + dz AS vox FROM (SELECT {_EDGE} FROM hklq), (VALUES {_BALL}) b(dx, dy, dz) WHERE ix + dx BETWEEN 0 AND {N - 1} AND iy + dy BETWEEN 0 AND {N - 1} AND iz + dz BETWEEN 0 AND {N - 1}")
def whole_punch(spark, sf):
    return g.peak_mask(g.hkl_table(spark, CELL, GRID.max_q), GRID, 2)


@query("nearest_voxel", "SELECT h, k, l, ix, iy, iz, vox FROM peaks")
def nearest_voxel(spark, sf):
    return g.nearest_voxels(g.hkl_table(spark, CELL, GRID.max_q), GRID).select("h", "k", "l", "ix", "iy", "iz", "vox")


_G = ", ".join(f"({(x * N + y) * N + z}, {float(np.exp(-(x * x + y * y + z * z) / 2)):.17g})" for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))
_AMPLITUDES = f"SELECT {o._asu(f.GROUP)} AS key, avg(i) / 1000 AS f FROM hkls GROUP BY 1"


@query("init_from_mtz", f"SELECT p.vox + s.step AS vox, round(sum(a.f * a.f * s.g), 4) + 0.0 AS w FROM (SELECT *, {o._asu(f.GROUP)} AS key FROM peaks WHERE ix BETWEEN 1 AND {N - 2} AND iy BETWEEN 1 AND {N - 2} AND iz BETWEEN 1 AND {N - 2}) p JOIN ({_AMPLITUDES}) a ON p.key = a.key, (VALUES {_G}) s(step, g) GROUP BY 1")
def init_from_mtz(spark, sf):
    amplitudes = peaks.merge_equivalents(f.hkl(spark, sf), f.GROUP).select("h", "k", "l", (F.col("i") / 1000).alias("f"))
    return rounded(peaks.init_from_amplitudes(amplitudes, f.GROUP, g.hkl_table(spark, CELL, GRID.max_q), GRID, 1, 1.0), "w", places=4)


# ---------------------------------------------------------------- likelihood

@query("log_rdr", f"SELECT shot, r, n_px, {o.r6('logr', 'logr')} FROM logr")
def log_rdr(spark, sf):
    return rounded(ll.log_likelihood(f.terms(spark, sf)), "logr")


@query("log_rdr_packed", f"SELECT shot, r, {o.r6('logr', 'logr')} FROM logr")
def log_rdr_packed(spark, sf):
    """The same by the packed kernel."""
    v = f.voxel(spark, sf)
    scene = reconstruct.Scene.collect(f.pixel(spark, sf), f.rotation(spark), v, GRID)
    packed = reconstruct.packed_shots(f.shot_px(spark, sf), f.shot(spark, sf), f.prob_rot(spark, sf))
    return rounded(reconstruct.packed_log_likelihood(packed, scene, reconstruct.to_density(scene, v)), "logr")


@query("dlogr_dscale", f"SELECT shot, r, {o.r6('sum(k * w / (m + 1e-6) - w)', 'd')} FROM terms GROUP BY shot, r")
def dlogr_dscale(spark, sf):
    return rounded(ll.scale_slope(f.terms(spark, sf)), "d")


_SPREAD = "FROM (SELECT {by}r, t, sum({e}) AS e FROM terms {join} GROUP BY {by}r, t) JOIN around USING (r, t) GROUP BY {by2}vox"


@query("dlogr_ddens", f"SELECT shot, vox, {o.r6('sum(e * a)', 'g')} " + _SPREAD.format(by="shot, ", by2="shot, ", e="k * phi / (m + 1e-6) - phi", join=""))
def dlogr_ddens(spark, sf):
    return rounded(ll.density_slope(f.terms(spark, sf), f.pixel(spark, sf), f.rotation(spark), GRID, ["shot"]), "g")


@query("dens_deriv", f"SELECT vox, {o.r6('sum(e * a)', 'g')} " + _SPREAD.format(by="", by2="", e="p * (k * phi / (m + 1e-6) - phi)", join="JOIN pdr USING (shot, r)"))
def dens_deriv(spark, sf):
    t = f.terms(spark, sf)
    p = ll.probabilities(ll.log_likelihood(t), f.BETA, f.MIN_P).select("shot", "r", "p")
    return rounded(ll.density_slope(t.join(p, ["shot", "r"]), f.pixel(spark, sf), f.rotation(spark), GRID, [], F.col("p")), "g")


@query("p_dr", f"SELECT shot, r, {o.r6('logr', 'logr')}, {o.r6('p', 'p')} FROM pdr")
def p_dr(spark, sf):
    return rounded(f.pdr(spark, sf), "logr", "p")


@query("dp_dr", f"SELECT shot, r, {o.r6('p * (d - sum(p * d) OVER (PARTITION BY shot))', 'dp')} FROM pdr JOIN (SELECT shot, r, sum(k * w / (m + 1e-6) - w) AS d FROM terms GROUP BY shot, r) USING (shot, r)")
def dp_dr(spark, sf):
    t = f.terms(spark, sf)
    return rounded(ll.probability_slope(ll.probabilities(ll.log_likelihood(t), f.BETA, f.MIN_P), ll.scale_slope(t)), "dp")


@query("best_rotation", f"SELECT shot, r, {o.r6('p', 'p')} FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY round(p, 9) DESC, r) AS n FROM pdr) WHERE n = 1")
def best_rotation(spark, sf):
    # rounded first: a tie must not hang on the order of a sum
    return rounded(ll.best_rotations(f.pdr(spark, sf).withColumn("p", F.round("p", 9))), "p")


@query("finite_pdr", f"SELECT shot, r, {o.r6('p', 'p')} FROM pdr WHERE p >= 1e-5")
def finite_pdr(spark, sf):
    return rounded(ll.finite(f.pdr(spark, sf)).select("shot", "r", "p"), "p")


@query("emc_functional", "SELECT round(sum(p * logr), 3) + 0.0 AS functional FROM pdr WHERE p >= 1e-5")
def emc_functional(spark, sf):
    return rounded(ll.functional(f.pdr(spark, sf)), "functional", places=3)


_MIX = "(SELECT shot, t, sum(p * w) / any_value(psum) AS model FROM (SELECT shot, r, p, sum(p) OVER (PARTITION BY shot) AS psum FROM pdr WHERE p > 1e-3) JOIN model USING (r) GROUP BY shot, t)"


@query("success_rate", f"SELECT shot, {o.r6('corr(model, k) FILTER (WHERE k > 0)', 'cc')}, round(sum((model - k) * (model - k)), 3) + 0.0 AS resid, coalesce(corr(model, k) FILTER (WHERE k > 0) > 0.2, false) AS ok FROM shot_px JOIN {_MIX} USING (shot, t) GROUP BY shot")
def success_rate(spark, sf):
    s = ll.success(f.pdr(spark, sf), f.model(spark, sf), f.shot_px(spark, sf))
    return s.select("shot", r6("cc", "cc"), r6("resid", "resid", 3), "ok")


# ---------------------------------------------------------------- updates

@query("compress_tomogram", f"SELECT r, t, {o.r6('w', 'w')} FROM toms")
def compress_tomogram(spark, sf):
    return rounded(update.tomograms(f.pdr(spark, sf), f.shot_px(spark, sf), f.shot(spark, sf)), "w")


_TOMPX = "(SELECT w, qx, qy, qz FROM rotpx JOIN toms USING (r, t))"
_INSERTED = f"(SELECT vox, CASE WHEN sum(a) > 0 THEN sum(w * a) / sum(a) ELSE 0 END AS w FROM {o.eight(_TOMPX, 'w')} GROUP BY vox)"
_SYM = "(SELECT w, " + ", ".join(f"{e} AS {q}" for e, q in zip(o.matvec(M, ["c.qx", "c.qy", "c.qz"]), g.QS)) + f" FROM {o.centres(_INSERTED, 'vox, w')} c, symop)"
_SYMD = f"(SELECT vox, CASE WHEN sum(a) > 0 THEN sum(w * a) / sum(a) ELSE 0 END AS w FROM {o.eight(_SYM, 'w')} GROUP BY vox)"


def _mates(source: str) -> str:
    return f"SELECT vox, {o.r6('0.5 * sum(w)', 'w')} FROM (WITH s AS ({source[1:-1]}) SELECT vox, w FROM s UNION ALL SELECT {N ** 3 - 1} - vox, w FROM s) GROUP BY vox"


@query("compress_density", _mates(_SYMD))
def compress_density(spark, sf):
    toms = update.tomograms(f.pdr(spark, sf), f.shot_px(spark, sf), f.shot(spark, sf))
    return rounded(update.compressed(toms, f.pixel(spark, sf), f.rotation(spark), GRID, g.symmetry_table(spark, f.GROUP)), "w")


_INDEXED = "(SELECT k - b AS w, qx, qy, qz FROM shot_px JOIN rotpx ON rotpx.t = shot_px.t AND rotpx.r = shot_px.shot % 24)"
_SEEDED = f"(SELECT vox, CASE WHEN sum(a) > 0 THEN sum(w * a) / sum(a) ELSE 0 END AS w FROM {o.eight(_INDEXED, 'w')} GROUP BY vox)"
_SEEDSYM = "(SELECT w, " + ", ".join(f"{e} AS {q}" for e, q in zip(o.matvec(M, ["c.qx", "c.qy", "c.qz"]), g.QS)) + f" FROM {o.centres(_SEEDED, 'vox, w')} c, symop)"
_SEEDSYMD = f"(SELECT vox, CASE WHEN sum(a) > 0 THEN sum(w * a) / sum(a) ELSE 0 END AS w FROM {o.eight(_SEEDSYM, 'w')} GROUP BY vox)"


@query("init_from_indexed", f"SELECT vox, greatest(w, 0.0) AS w FROM ({_mates(_SEEDSYMD)})")
def init_from_indexed(spark, sf):
    """A start density from shots of known rotation: inserted, averaged over symmetry and mates, not negative."""
    known = f.shot_px(spark, sf).withColumn("r", F.col("shot") % 24)
    placed = g.rotated(f.pixel(spark, sf).filter("trusted").select("t", *g.QS), f.rotation(spark)).join(known, ["r", "t"])
    start = g.insert(placed, F.col("k") - F.col("b"), GRID).select("vox", "w")
    even = g.friedel(g.symmetrize(start, g.symmetry_table(spark, f.GROUP), GRID), GRID)
    return rounded(even, "w").select("vox", F.greatest("w", F.lit(0.0)).alias("w"))


_SCALES = "SELECT shot, CASE WHEN den > 0 THEN psum * ksum / den ELSE phi END AS phi, coalesce(den > 0, false) AS changed FROM shots LEFT JOIN (SELECT shot, sum(p) AS psum, sum(p * coalesce(wsum, 0)) AS den FROM pdr LEFT JOIN (SELECT r, sum(w) AS wsum FROM model GROUP BY r) USING (r) GROUP BY shot) USING (shot) LEFT JOIN (SELECT shot, sum(k) AS ksum FROM shot_px GROUP BY shot) USING (shot)"


def _new_scales(spark, sf):
    return update.analytic_scales(f.pdr(spark, sf), f.model(spark, sf), f.shot_px(spark, sf), f.shot(spark, sf))


@query("scale_analytic", f"SELECT shot, {o.r6('phi', 'phi')}, changed FROM ({_SCALES})")
def scale_analytic(spark, sf):
    return rounded(_new_scales(spark, sf), "phi")


@query("scale_normalize", f"SELECT shot, {o.r6('phi / (SELECT avg(phi) FROM shots) * 25.0', 'phi')} FROM shots")
def scale_normalize(spark, sf):
    return rounded(update.normalized_scales(f.shot(spark, sf), 25.0), "phi")


@query("dens_deriv_packed")
def dens_deriv_packed(spark, sf):
    """The same by the packed kernel, of which the density steps take their gradients."""
    v = f.voxel(spark, sf)
    # every voxel of the grid has a place, so that gradients of those without density show
    scene = reconstruct.Scene.collect(f.pixel(spark, sf), f.rotation(spark), spark.range(N ** 3).select(F.col("id").cast("int").alias("vox")), GRID)
    density = reconstruct.to_density(scene, v)
    packed = reconstruct.packed_shots(f.shot_px(spark, sf), f.shot(spark, sf), f.prob_rot(spark, sf))
    p = ll.probabilities(reconstruct.packed_log_likelihood(packed, scene, density), f.BETA, f.MIN_P)
    _, gradient = reconstruct.packed_objective(packed, p, scene, density, 0.0)
    touched = f.terms(spark, sf).select("r", "t").distinct()
    near = g.corners(g.rotated(f.pixel(spark, sf).filter("trusted").select("t", *g.QS), f.rotation(spark)).join(touched, ["r", "t"], "left_semi"), GRID).select("vox").distinct()
    return rounded(reconstruct.to_voxels(spark, scene, gradient).join(near, "vox", "left_semi").withColumnRenamed("w", "g"), "g")


ORACLE["dens_deriv_packed"] = ORACLE["dens_deriv"]


@query("scale_convergence", f"SELECT round(avg(abs(a.phi - s.phi) / s.phi), 6) + 0.0 AS mean_change, count(*) FILTER (WHERE abs(a.phi - s.phi) / s.phi > 0.01) AS n_above, count(*) FILTER (WHERE abs(a.phi - s.phi) / s.phi > 0.01) = 0 AS converged FROM ({_SCALES}) a JOIN shots s USING (shot)")
def scale_convergence(spark, sf):
    return rounded(update.scale_changes(_new_scales(spark, sf), f.shot(spark, sf)), "mean_change")


@query("scale_stats", f"SELECT {o.r6('avg(phi)', 'mean_phi')}, {o.r6('median(phi)', 'median_phi')}, {o.r6('stddev_pop(phi)', 'std_phi')} FROM shots")
def scale_stats(spark, sf):
    return rounded(update.scale_stats(f.shot(spark, sf)), "mean_phi", "median_phi", "std_phi")


@query("scale_limits", "SELECT count(*) FILTER (WHERE abs(phi - 0.5) < 1e-5) AS n_low, count(*) FILTER (WHERE abs(phi - 1.25) < 1e-5) AS n_high FROM shots")
def scale_limits(spark, sf):
    return update.scales_at_limits(f.shot(spark, sf), 0.5, 1.25)


_SLOPE = "sum(p * (k * w / (greatest(b + ({x}) * w, 0) + 1e-6) - w))"


@query("scale_bfgs", f"""SELECT s.shot, {o.r6("CASE WHEN coalesce(pw, 0) <= 0 THEN s.phi WHEN at_low <= 0 THEN 1e-6 WHEN at_high >= 0 THEN 1e6 ELSE sqrt(lo * hi) END", "phi")} FROM shots s
LEFT JOIN (SELECT shot, sum(p * w) AS pw, {_SLOPE.format(x='1e-6')} AS at_low, {_SLOPE.format(x='1e6')} AS at_high FROM terms JOIN pdr USING (shot, r) WHERE p > 0 GROUP BY shot) e ON e.shot = s.shot
LEFT JOIN (WITH RECURSIVE few AS MATERIALIZED (SELECT shot, k, b, w, p FROM terms JOIN pdr USING (shot, r) WHERE p > 0),
  half AS (SELECT shot, CAST(1e-6 AS DOUBLE) AS lo, CAST(1e6 AS DOUBLE) AS hi, 0 AS n FROM (SELECT DISTINCT shot FROM few)
    UNION ALL SELECT shot, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END, n + 1
    FROM (SELECT shot, lo, hi, n, sqrt(lo * hi) AS mid, {_SLOPE.format(x='sqrt(lo * hi)')} AS slope FROM half JOIN few USING (shot) WHERE n < 60 GROUP BY shot, lo, hi, n))
  SELECT shot, lo, hi FROM half WHERE n = 60) r ON r.shot = s.shot""")
def scale_bfgs(spark, sf):
    t = f.terms(spark, sf)
    return rounded(update.fitted_scales(t, ll.probabilities(ll.log_likelihood(t), f.BETA, f.MIN_P), f.shot(spark, sf)), "phi")


def _scene(spark, sf):
    m = f.mask(spark, sf)
    scene = reconstruct.Scene.collect(f.pixel(spark, sf), f.rotation(spark), m, GRID)
    return scene, reconstruct.to_density(scene, f.voxel(spark, sf))


@query("density_lbfgs_step")
def density_lbfgs_step(spark, sf):
    scene, density = _scene(spark, sf)
    packed = reconstruct.packed_shots(f.shot_px(spark, sf), f.shot(spark, sf), f.prob_rot(spark, sf))
    p = ll.probabilities(reconstruct.packed_log_likelihood(packed, scene, density), f.BETA, f.MIN_P)
    new, _ = reconstruct.density_step(packed, p, scene, density, 2)
    return rounded(reconstruct.to_voxels(spark, scene, new), "w")


@query("emc_run")
def emc_run(spark, sf):
    """Two iterations of the whole loop; its density."""
    out, _, _ = reconstruct.run(f.pixel(spark, sf), f.rotation(spark), f.shot_px(spark, sf), f.shot(spark, sf), f.prob_rot(spark, sf), f.voxel(spark, sf), f.mask(spark, sf), GRID, 2,
                                g.symmetry_table(spark, f.GROUP), f.BETA, f.MIN_P, steps=1)
    return rounded(out, "w")


@query("simulate_shots")
def simulate_shots(spark, sf):
    """Poisson counts of each shot's background and scaled density at its first probable rotation; seeds come from shot and pixel, so a lost task draws the same."""
    lead = f.prob_rot(spark, sf).groupBy("shot").agg(F.min("r").alias("r"))
    t = f.terms(spark, sf).join(lead, ["shot", "r"]).select("shot", "t", "m")

    def draw(batches):
        for b in batches:
            yield b.assign(k=[float(np.random.default_rng([int(s), int(x)]).poisson(max(m, 0.0))) for s, x, m in zip(b["shot"], b["t"], b["m"])])[["shot", "t", "k"]]

    return t.mapInPandas(draw, "shot int, t int, k double")


# ---------------------------------------------------------------- orientation search

@query("probable_orients", f"SELECT shot, r, count(*) AS n_pred FROM resid WHERE residual < {CUT} GROUP BY shot, r HAVING count(*) >= {LEAST}")
def probable_orients(spark, sf):
    return orient.probable(_residuals(spark, sf), CUT, LEAST)


_STEPS = "SELECT shot, r, greatest(CAST(floor((residual - 0.05) / 0.02) AS INTEGER) + 1, 0) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY shot, r ORDER BY residual) AS n FROM resid) WHERE n = 2"


@query("hcut_relax", f"SELECT shot, round(0.05 + need * 0.02, 6) + 0.0 AS cut, count(*) AS n_rot FROM (WITH s AS ({_STEPS}) SELECT s.shot, need FROM s JOIN (SELECT shot, steps AS need FROM (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY steps) AS n FROM s) WHERE n = 4) USING (shot) WHERE steps <= need) GROUP BY shot, need")
def hcut_relax(spark, sf):
    return rounded(orient.relaxed_cut(_residuals(spark, sf), 0.05, 0.02, 2, 3), "cut")


@query("minpred_tighten", f"WITH counts AS (SELECT shot, r, count(*) AS n_pred FROM resid WHERE residual < {CUT} GROUP BY shot, r HAVING count(*) >= {LEAST}), sizes AS (SELECT shot, n_pred, count(*) AS n FROM counts GROUP BY ALL), bounds AS (SELECT DISTINCT shot, n_pred + 1 AS least FROM counts UNION SELECT DISTINCT shot, {LEAST} FROM counts), tries AS (SELECT b.shot, b.least, coalesce((SELECT sum(n) FROM sizes x WHERE x.shot = b.shot AND x.n_pred >= b.least), 0) AS n_rot FROM bounds b) SELECT shot, CAST(min(least) AS INTEGER) AS least, CAST(arg_min(n_rot, least) AS BIGINT) AS n_rot FROM tries WHERE n_rot <= 6 GROUP BY shot")
def minpred_tighten(spark, sf):
    return orient.tightened_least(_residuals(spark, sf), CUT, LEAST, 6)


@query("append_gt_rot", "SELECT shot, r FROM prob_rot UNION SELECT shot, shot % 24 AS r FROM shots")
def append_gt_rot(spark, sf):
    return orient.with_truth(f.prob_rot(spark, sf), f.shot(spark, sf).select("shot", (F.col("shot") % 24).alias("r")))


@query("rot_stats", f"SELECT count(*) AS n_shots, count(*) FILTER (WHERE n = 0) AS n_zero, round(avg(n), 6) + 0.0 AS mean_rot, max(n) AS max_rot FROM (SELECT s.shot, count(p.r) AS n FROM (SELECT DISTINCT shot FROM refl) s LEFT JOIN (SELECT shot, r FROM resid WHERE residual < {CUT} GROUP BY shot, r HAVING count(*) >= {LEAST}) p USING (shot) GROUP BY s.shot)")
def rot_stats(spark, sf):
    found = orient.probable(_residuals(spark, sf), CUT, LEAST)
    return rounded(orient.rotation_counts(found, f.refl(spark, sf).select("shot").distinct()), "mean_rot")


@query("confident_shots", "SELECT shot, CAST(r AS INTEGER) AS r, CAST(n_good AS BIGINT) AS n_good FROM (SELECT shot, CASE shot % 4 WHEN 0 THEN shot % 24 ELSE 0 END AS r, CASE shot % 4 WHEN 0 THEN 1 ELSE 4 END AS n_good FROM shots WHERE shot % 4 IN (0, 1))")
def confident_shots(spark, sf):
    """By turns: one rotation, four that symmetry takes into one another (rotations of the cube), four others (the last is a turn about (1, 1, 1), which the group lacks), and two."""
    quarter, other = [0, 1, 2, 3], [0, 24, 26, 28]
    rows = spark.createDataFrame([(1, r, 0.25) for r in quarter] + [(2, r, 0.25) for r in other] + [(3, 0, 0.5), (3, 1, 0.5)], "kind int, r int, p double")
    s = f.shot(spark, sf).select("shot")
    p = s.join(F.broadcast(rows), F.col("shot") % 4 == F.col("kind")).select("shot", "r", "p").unionByName(s.filter("shot % 4 = 0").select("shot", (F.col("shot") % 24).alias("r"), F.lit(1.0).alias("p")))
    return orient.confident(p, f.rotation(spark), g.symmetry_table(spark, f.GROUP))


# ---------------------------------------------------------------- background and spots

@query("strong_spot_mask", "SELECT shot, x, y FROM strong")
def strong_spot_mask(spark, sf):
    return bg.strong_pixels(f.refl(spark, sf))


def _profile(spark, sf, median=True):
    return bg.radial_profile(f.image(spark, sf), f.bins(spark), bg.strong_pixels(f.refl(spark, sf)), median)


@query("radial_median", f"SELECT shot, qbin, {o.r6('v', 'v')} FROM radial")
def radial_median(spark, sf):
    return rounded(_profile(spark, sf), "v")


@query("radial_mean", f"SELECT shot, qbin, {o.r6('avg(v)', 'v')} FROM image JOIN bins USING (x, y) ANTI JOIN strong USING (shot, x, y) GROUP BY shot, qbin")
def radial_mean(spark, sf):
    return rounded(_profile(spark, sf, False), "v")


@query("expand_radial", f"SELECT shot, x, y, {o.r6('v', 'bg')} FROM bins JOIN radial USING (qbin)")
def expand_radial(spark, sf):
    return rounded(bg.expand_profile(_profile(spark, sf), f.bins(spark)), "bg")


_FIXED = "(SELECT i.shot, i.x, i.y, i.v * c.polar * c.omega / (SELECT avg(polar * omega) FROM detf) AS v FROM image i JOIN detf c USING (x, y))"


@query("bg_subtract", f"WITH fixed AS {_FIXED}, own AS (SELECT shot, qbin, median(v) AS m FROM fixed JOIN bins USING (x, y) ANTI JOIN strong USING (shot, x, y) GROUP BY shot, qbin) SELECT shot, x, y, {o.r6('v - m', 'v')} FROM fixed JOIN bins USING (x, y) JOIN own USING (shot, qbin)")
def bg_subtract(spark, sf):
    factor = bg.correction(bg.detector_pixels(spark, f.DETECTOR), f.DETECTOR, f.BEAM)
    return rounded(bg.without_background(f.image(spark, sf), f.bins(spark), bg.strong_pixels(f.refl(spark, sf)), factor), "v")


@query("signal_level", f"SELECT shot, {o.r6('coalesce(total, 0) / n', 'level')} FROM (SELECT shot, count(*) AS n FROM refl GROUP BY shot) LEFT JOIN (SELECT shot, sum(v) AS total FROM (SELECT shot, refl_id, avg(v) AS v FROM boxes JOIN image USING (shot, x, y) GROUP BY shot, refl_id) GROUP BY shot) USING (shot)")
def signal_level(spark, sf):
    return rounded(bg.signal_level(f.refl(spark, sf), f.image(spark, sf)), "level")


def _mirrored(c: str, top: str) -> str:
    return f"CASE WHEN {c} < 0 THEN -({c}) - 1 WHEN {c} > {top} THEN 2 * {top} + 1 - ({c}) ELSE {c} END"


_STEPS5 = ", ".join(f"({k})" for k in range(-2, 3))


@query("bg_median_filter", f"WITH filled AS (SELECT i.shot, i.x, i.y, CASE WHEN s.x IS NULL THEN i.v ELSE r.v END AS v FROM image i JOIN bins b ON i.x = b.x AND i.y = b.y JOIN radial r ON r.shot = i.shot AND r.qbin = b.qbin LEFT JOIN strong s ON s.shot = i.shot AND s.x = i.x AND s.y = i.y), ext AS (SELECT shot, max(x) AS mx, max(y) AS my FROM filled GROUP BY shot), around9 AS (SELECT shot, x, y, {_mirrored('x + dx', 'mx')} AS x2, {_mirrored('y + dy', 'my')} AS y2 FROM filled JOIN ext USING (shot), (VALUES {_STEPS5}) a(dx), (VALUES {_STEPS5}) c(dy)) SELECT n.shot, n.x, n.y, {o.r6('median(f.v)', 'v')} FROM around9 n JOIN filled f ON f.shot = n.shot AND f.x = n.x2 AND f.y = n.y2 GROUP BY n.shot, n.x, n.y")
def bg_median_filter(spark, sf):
    return rounded(bg.median_filter(bg.filled(f.image(spark, sf), f.bins(spark), bg.strong_pixels(f.refl(spark, sf))), 5), "v")


def _bright(spark, sf):
    return f.image(spark, sf).filter("v > 20")


@query("label_spots", "SELECT shot, x, y, CAST(dense_rank() OVER (PARTITION BY shot ORDER BY root) AS INTEGER) AS label FROM (WITH RECURSIVE bright AS (SELECT shot, x, y FROM image WHERE v > 20), reach AS (SELECT shot, x, y, x AS x2, y AS y2 FROM bright UNION SELECT r.shot, r.x, r.y, b.x, b.y FROM reach r JOIN bright b ON r.shot = b.shot AND abs(r.x2 - b.x) + abs(r.y2 - b.y) = 1) SELECT shot, x, y, min(y2 * 1000 + x2) AS root FROM reach GROUP BY shot, x, y)")
def label_spots(spark, sf):
    return bg.label_spots(_bright(spark, sf))


_COUNTS = "(SELECT shot, x, y, round(v) AS v FROM image)"
_SPREAD_X = f"SELECT a.shot, a.x, a.y, a.v, count(*) AS m, sum(b.v) AS s, sum(b.v * b.v) AS q FROM {_COUNTS} a JOIN {_COUNTS} b ON a.shot = b.shot AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY a.shot, a.x, a.y, a.v"
_DISPERSED = f"SELECT shot, x, y, v FROM ({_SPREAD_X}) WHERE m >= 2 AND m * q - s * s - s * (m - 1) > s * 0.5 * sqrt(2e0 * (m - 1)) AND m * v - s > 1.5 * sqrt(s * m)"


def _strong(spark, sf):
    counts = f.image(spark, sf).withColumn("v", F.round("v"))  # whole counts, so that sums are exact
    return counts, bg.dispersion_threshold(counts, 3, 1.0, 0.5, 1.5)


@query("dispersion_threshold", _DISPERSED)
def dispersion_threshold(spark, sf):
    return _strong(spark, sf)[1]


@query("find_spots", f"SELECT shot, CAST(label AS INTEGER) AS label, count(*) AS n_px, {o.r6('sum(v * (x + 0.5)) / sum(v) - 0.5', 'cx')}, {o.r6('sum(v * (y + 0.5)) / sum(v) - 0.5', 'cy')}, {o.r6('sum(v)', 'total')} FROM (SELECT *, dense_rank() OVER (PARTITION BY shot ORDER BY root) AS label FROM (WITH RECURSIVE bright AS MATERIALIZED ({_DISPERSED}), reach AS (SELECT shot, x, y, v, x AS x2, y AS y2 FROM bright UNION SELECT r.shot, r.x, r.y, r.v, b.x, b.y FROM reach r JOIN bright b ON r.shot = b.shot AND abs(r.x2 - b.x) + abs(r.y2 - b.y) = 1) SELECT shot, x, y, v, min(y2 * 1000 + x2) AS root FROM reach GROUP BY shot, x, y, v)) GROUP BY shot, label HAVING count(*) BETWEEN 1 AND 3")
def find_spots(spark, sf):
    """From images to centroids: strong pixels, labels, sizes, centres."""
    counts, strong = _strong(spark, sf)
    return rounded(bg.find_spots(counts, strong, 1, 3), "cx", "cy", "total")


@query("spot_size_filter", "SELECT refl_id, shot, x, y FROM boxes WHERE refl_id IN (SELECT refl_id FROM boxes GROUP BY refl_id HAVING count(*) BETWEEN 3 AND 8)")
def spot_size_filter(spark, sf):
    r = f.refl(spark, sf)
    px = r.select("shot", "refl_id", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"), "y1", "y2").select("shot", F.col("refl_id").alias("label"), "x", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    return bg.spot_sizes(px, 3, 8).withColumnRenamed("label", "refl_id")


@query("spot_centroids", f"SELECT shot, refl_id AS label, count(*) AS n_px, {o.r6('sum(v * (x + 0.5)) / sum(v) - 0.5', 'cx')}, {o.r6('sum(v * (y + 0.5)) / sum(v) - 0.5', 'cy')}, {o.r6('sum(v)', 'total')} FROM boxes JOIN image USING (shot, x, y) GROUP BY shot, refl_id")
def spot_centroids(spark, sf):
    r = f.refl(spark, sf)
    px = r.select("shot", "refl_id", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"), "y1", "y2").select("shot", F.col("refl_id").alias("label"), "x", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    return rounded(bg.spot_centroids(px, f.image(spark, sf), -0.5), "cx", "cy", "total")


_NEAR = "SELECT s.shot, s.refl_id AS spot_id, p.refl_id AS pred_id, sqrt((s.x1 + 0.3 - p.x1) * (s.x1 + 0.3 - p.x1) + (s.y1 + 0.1 - p.y1) * (s.y1 + 0.1 - p.y1)) AS dist FROM refl s JOIN refl p ON s.shot = p.shot AND s.x1 + 0.3 - p.x1 BETWEEN -2.5 AND 2.5 AND s.y1 + 0.1 - p.y1 BETWEEN -2.5 AND 2.5"


@query("label_strong", f"SELECT shot, pred_id, max(spot_id) AS spot_id, {o.r6('arg_max(dist, spot_id)', 'dist')} FROM (SELECT *, row_number() OVER (PARTITION BY shot, spot_id ORDER BY dist, pred_id) AS n FROM ({_NEAR}) WHERE dist <= 2.5) WHERE n = 1 GROUP BY shot, pred_id")
def label_strong(spark, sf):
    r = f.refl(spark, sf)
    predicted = r.select("shot", F.col("refl_id").alias("pred_id"), F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    strong = r.select("shot", F.col("refl_id").alias("spot_id"), (F.col("x1") + 0.3).alias("x"), (F.col("y1") + 0.1).alias("y"))
    return rounded(bg.match_spots(predicted, strong, 2.5), "dist")


# ---------------------------------------------------------------- integration and merging

def _hkls(spark):
    return g.hkl_table(spark, CELL, GRID.max_q)


_CROSS = ", ".join(f"({x}, {y}, {z})" for x, y, z in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])


@query("integrate_cross", f"SELECT h, k, l, {o.r6('sum(coalesce(w, 0))', 'i')} FROM (SELECT h, k, l, ((ix + dx + {N}) % {N} * {N} + (iy + dy + {N}) % {N}) * {N} + (iz + dz + {N}) % {N} AS vox FROM peaks, (VALUES {_CROSS}) c(dx, dy, dz) WHERE ix < {N - 1} AND iy < {N - 1} AND iz < {N - 1}) LEFT JOIN voxels USING (vox) GROUP BY h, k, l")
def integrate_cross(spark, sf):
    return rounded(peaks.integrate_cross(_hkls(spark), f.voxel(spark, sf), GRID), "i")


_ELEMENT = ", ".join(f"({(x * N + y) * N + z})" for x, y, z in g.kernel_offsets(2, 1))
_KERNEL = f"FROM (SELECT h, k, l, vox + step AS vox FROM peaks, (VALUES {_ELEMENT}) e(step) WHERE ix BETWEEN 1 AND {N - 2} AND iy BETWEEN 1 AND {N - 2} AND iz BETWEEN 1 AND {N - 2}) LEFT JOIN voxels USING (vox) GROUP BY h, k, l"


@query("integrate_kernel_sum", f"SELECT h, k, l, {o.r6('sum(coalesce(w, 0))', 'i')} {_KERNEL}")
def integrate_kernel_sum(spark, sf):
    return rounded(peaks.integrate_kernel(_hkls(spark), f.voxel(spark, sf), GRID), "i")


@query("integrate_kernel_max", f"SELECT h, k, l, {o.r6('max(coalesce(w, 0))', 'i')} {_KERNEL}")
def integrate_kernel_max(spark, sf):
    return rounded(peaks.integrate_kernel(_hkls(spark), f.voxel(spark, sf), GRID, how="max"), "i")


@query("integrate_linear", f"SELECT h, k, l, {o.r6('sum(a * coalesce(w, 0))', 'i')} FROM {o.eight('hklq', 'h, k, l')} LEFT JOIN voxels USING (vox) GROUP BY h, k, l")
def integrate_linear(spark, sf):
    return rounded(peaks.integrate_linear(_hkls(spark), f.voxel(spark, sf), GRID), "i")


def _spline_sql() -> str:
    """Coefficients by the inverse of the matrix that gives a line's values from them, axis by axis, then 64 weighted ones for each index."""
    basis = np.diag(np.full(N, 4 / 6)) + np.diag(np.full(N - 1, 1 / 6), 1) + np.diag(np.full(N - 1, 1 / 6), -1)
    basis[0, 1] = basis[-1, -2] = 2 / 6
    inverse = ", ".join(f"({i}, {j}, {v!r}e0)" if "e" not in repr(v) else f"({i}, {j}, {v!r})" for i, row in enumerate(np.linalg.inv(basis).tolist()) for j, v in enumerate(row))
    weight = "CASE o WHEN 0 THEN (1 - d) * (1 - d) * (1 - d) / 6 WHEN 1 THEN (3 * d * d * d - 6 * d * d + 4) / 6 WHEN 2 THEN (3 * (1 - d) * (1 - d) * (1 - d) - 6 * (1 - d) * (1 - d) + 4) / 6 ELSE d * d * d / 6 END"
    mirrored = f"greatest(0, least({N - 1}, CASE WHEN abs(b + o - 1) > {N - 1} THEN {2 * (N - 1)} - abs(b + o - 1) ELSE abs(b + o - 1) END))"
    place = lambda q: f"({q} - ({C})) / {D}"
    axes = ", ".join(f"ax{k} AS (SELECT h, k, l, CAST({mirrored} AS INTEGER) AS i{k}, {weight} AS w{k} FROM (SELECT h, k, l, floor({place(q)}) AS b, {place(q)} - floor({place(q)}) AS d FROM inner_hkl), range(0, 4) t(o))" for k, q in enumerate(g.QS))
    return f"""SELECT h, k, l, {o.r6('coalesce(i, 0)', 'i')} FROM hklq LEFT JOIN (WITH inv AS MATERIALIZED (SELECT * FROM (VALUES {inverse}) t(i, j, v)),
dense AS (SELECT vox // {N * N} AS x, vox // {N} % {N} AS y, vox % {N} AS z, w FROM voxels), c0 AS MATERIALIZED (SELECT i AS x, y, z, sum(v * w) AS w FROM dense JOIN inv ON j = x GROUP BY i, y, z),
c1 AS MATERIALIZED (SELECT x, i AS y, z, sum(v * w) AS w FROM c0 JOIN inv ON j = y GROUP BY x, i, z), c2 AS MATERIALIZED (SELECT x, y, i AS z, sum(v * w) AS w FROM c1 JOIN inv ON j = z GROUP BY x, y, i),
inner_hkl AS MATERIALIZED (SELECT * FROM hklq WHERE {' AND '.join(f'{place(q)} BETWEEN 0 AND {N - 1}' for q in g.QS)}), {axes}
SELECT h, k, l, sum(w * w0 * w1 * w2) AS i FROM ax0 JOIN ax1 USING (h, k, l) JOIN ax2 USING (h, k, l) JOIN c2 ON x = i0 AND y = i1 AND z = i2 GROUP BY h, k, l) s USING (h, k, l)"""


@query("integrate_spline", _spline_sql())
def integrate_spline(spark, sf):
    return rounded(peaks.integrate_spline(_hkls(spark), f.voxel(spark, sf), GRID), "i")


@query("integrate_fit")
def integrate_fit(spark, sf):
    return rounded(peaks.integrate_fit(_hkls(spark), f.voxel(spark, sf), GRID), "i", places=4)


def _merged_sql(group: str) -> str:
    return f"SELECT CAST(key[1] AS INTEGER) AS h, CAST(key[2] AS INTEGER) AS k, CAST(key[3] AS INTEGER) AS l, count(*) AS n, {o.r6('avg(i)', 'i')} FROM (SELECT {o._asu(group)} AS key, i FROM hkls) GROUP BY key"


@query("merge_asu", _merged_sql(f.GROUP))
def merge_asu(spark, sf):
    return rounded(peaks.merge_equivalents(f.hkl(spark, sf), f.GROUP), "i")


@query("merge_bijvoet", _merged_sql("P1"))
def merge_bijvoet(spark, sf):
    return rounded(peaks.merge_mates(f.hkl(spark, sf)), "i")


@query("hkl_common", f"SELECT a.h, a.k, a.l, {o.r6('a.i', 'i1')}, {o.r6('b.i', 'i2')} FROM hkls a JOIN hkl_ref b ON a.h = b.h AND a.k = b.k AND a.l = b.l")
def hkl_common(spark, sf):
    return rounded(peaks.common(f.hkl(spark, sf), f.hkl_ref(spark, sf)), "i1", "i2")


@query("hkl_intersect", "SELECT h, k, l FROM hkls INTERSECT SELECT h, k, l FROM hkl_ref INTERSECT SELECT h, k, l FROM hklq")
def hkl_intersect(spark, sf):
    return peaks.same_indices([f.hkl(spark, sf), f.hkl_ref(spark, sf), _hkls(spark)])


# ---------------------------------------------------------------- statistics

@query("cc_pearson", f"SELECT count(*) AS n, {o.r6('corr(i1, i2)', 'cc')} FROM pairs")
def cc_pearson(spark, sf):
    return rounded(ev.pearson(f.pairs(spark, sf)), "cc")


#: Rounded first: sums differ in their last digits, and a rank must not hang on them.
_EVEN = "(SELECT round(i1, 6) AS i1, round(i2, 6) AS i2, round(d, 9) AS d FROM pairs)"


def _even(spark, sf):
    return f.pairs(spark, sf).select(F.round("i1", 6).alias("i1"), F.round("i2", 6).alias("i2"), F.round("d", 9).alias("d"))


@query("cc_spearman", f"SELECT count(*) AS n, {o.r6('corr(r1, r2)', 'cc')} FROM (SELECT rank() OVER (ORDER BY i1) + (count(*) OVER (PARTITION BY i1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY i2) + (count(*) OVER (PARTITION BY i2) - 1) / 2.0 AS r2 FROM {_EVEN})")
def cc_spearman(spark, sf):
    return rounded(ev.spearman(_even(spark, sf)), "cc")


@query("cc_by_shell", f"WITH e AS {_EVEN}, starts AS (SELECT min(d) AS s FROM (SELECT d, ntile(8) OVER (ORDER BY d) AS part FROM e) GROUP BY part), edges AS (SELECT s FROM starts UNION ALL SELECT max(d) FROM e), lab AS (SELECT e.*, (SELECT count(*) FROM edges WHERE s <= e.d) AS shell FROM e) SELECT CAST(shell AS INTEGER) AS shell, count(*) AS n, {o.r6('median(d)', 'd')}, {o.r6('corr(i1, i2)', 'cc')} FROM lab WHERE shell BETWEEN 1 AND 7 GROUP BY shell HAVING count(*) >= 2")
def cc_by_shell(spark, sf):
    return rounded(ev.by_shell(_even(spark, sf), 8), "d", "cc")


@query("drop_all_dups", "SELECT shot, refl_id, h, k, l FROM (SELECT *, count(*) OVER (PARTITION BY shot, h, k, l) AS n FROM refl) WHERE n = 1")
def drop_all_dups(spark, sf):
    return ev.without_repeats(f.refl(spark, sf)).select("shot", "refl_id", "h", "k", "l")


@query("process_reference", "SELECT shot, refl_id FROM refl WHERE indexed AND NOT (h = 0 AND k = 0 AND l = 0)")
def process_reference(spark, sf):
    return ev.reference_reflections(f.refl(spark, sf)).select("shot", "refl_id")


@query("refl_res_filter", "SELECT shot, refl_id FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) * 5.0 <= 1 AS fine, count(*) FILTER (WHERE sqrt(qx * qx + qy * qy + qz * qz) * 5.0 <= 1) OVER (PARTITION BY shot) AS n FROM refl) WHERE fine OR n < 3")
def refl_res_filter(spark, sf):
    return ev.within_resolution(f.refl(spark, sf), 0.2).select("shot", "refl_id")


@query("renumber_ids", "SELECT shot, refl_id, dense_rank() OVER (ORDER BY shot) - 1 AS new_id FROM refl WHERE shot % 3 <> 1")
def renumber_ids(spark, sf):
    r = f.refl(spark, sf)
    return ev.renumbered(r, r.select("shot").filter("shot % 3 <> 1")).select("shot", "refl_id", "new_id")


@query("sigma_b_cutoff", "SELECT shot, refl_id, dense_rank() OVER (ORDER BY shot) - 1 AS new_id FROM refl WHERE (shot % 11) / 10e0 < 0.55")
def sigma_b_cutoff(spark, sf):
    r = f.refl(spark, sf)
    narrow = ev.narrow_shots(r.select("shot").distinct().withColumn("sigma_b", F.col("shot") % 11 / 10.0), 0.55)
    return ev.renumbered(r, narrow).select("shot", "refl_id", "new_id")


_D = "(1 + refl_id % 7) * 0.5"


@query("significance_filter", f"""WITH c AS (SELECT shot, refl_id, i, var, 1 / ({_D} * {_D} * {_D}) AS c FROM (SELECT shot % 50 AS shot, refl_id, i, var FROM refl)), s AS (SELECT *, min(c) OVER (PARTITION BY shot) AS low, max(c) OVER (PARTITION BY shot) AS high FROM c),
b AS (SELECT shot, refl_id, i / sqrt(var) AS ratio, CASE WHEN high > low THEN least(floor((c - low) / (high - low) * 4), 3) ELSE 0 END AS bin FROM s), w AS (SELECT shot, min(bin) AS stop FROM (SELECT shot, bin FROM b GROUP BY shot, bin HAVING avg(ratio) < 7.8) GROUP BY shot)
SELECT shot, refl_id FROM b LEFT JOIN w USING (shot) WHERE stop IS NULL OR bin < stop""")
def significance_filter(spark, sf):
    r = f.refl(spark, sf).withColumn("shot", F.col("shot") % 50).withColumn("d", (1 + F.col("refl_id") % 7) * 0.5)
    return ev.significant(r, 4, 7.8).select("shot", "refl_id")


@query("isigi_ladder", "SELECT CAST(s AS INTEGER) AS step, count(*) FILTER (WHERE i / sqrt(var) >= s) AS n, round(coalesce(sqrt(avg(dx * dx + dy * dy) FILTER (WHERE i / sqrt(var) >= s)), 0), 6) + 0.0 AS rmsd FROM refl, range(0, 6) t(s) GROUP BY s")
def isigi_ladder(spark, sf):
    return rounded(ev.significance_ladder(f.refl(spark, sf)), "rmsd")


@query("median_offset", f"SELECT count(*) AS n, {o.r6('median(sqrt(dx * dx + dy * dy))', 'offset')} FROM refl")
def median_offset(spark, sf):
    return rounded(ev.median_offset(f.refl(spark, sf)), "offset")
