"""Properties of the operators, and their agreement with plain NumPy."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.config import Cell, Grid, symmetry_matrices
from voxelweave.functions import scalars
from voxelweave.operators import background as bg
from voxelweave.operators import evaluate as ev
from voxelweave.operators import grid as g
from voxelweave.operators import likelihood as ll
from voxelweave.operators import orient, peaks, rotations, update
from voxelweave.plans import reconstruct
from voxelweave.sources import files

GRID = Grid(8, 0.25)
M = ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3))


def random_rotations(n, seed=0):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    w, x, y, z = q.T
    u = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return np.transpose(u, (2, 1, 0))  # transposes, as the operators take them


def cube(n=8, seed=1):
    return np.random.default_rng(seed).uniform(0.1, 10, (n, n, n))


def voxels_of(spark, w, keep=None):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(w.ravel()) if keep is None or keep[k]], "vox int, w double")


def plain_interpolation(w, q, grid):
    n = grid.n
    f = (q - grid.corner) / grid.delta
    i = np.floor(f).astype(int)
    if (i < 0).any() or (i > n - 2).any():
        return None
    d = f - i
    return sum(w[tuple(i + o)] * np.prod(np.where(o, d, 1 - d)) for o in map(np.array, itertools.product((0, 1), repeat=3)))


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(5)
    q = rng.uniform(-0.2, 0.2, (40, 3))
    pixels = spark.createDataFrame([(t, *map(float, x), t % 7 != 0) for t, x in enumerate(q)], "t int, qx double, qy double, qz double, trusted boolean")
    mats = random_rotations(5)
    rot = spark.createDataFrame([(r, *map(float, m.ravel())) for r, m in enumerate(mats)], f"r int, {M}")
    w = cube()
    shots = spark.createDataFrame([(s, 0.5 + 0.3 * s) for s in range(3)], "shot int, phi double")
    k, b = rng.uniform(0, 20, (3, 40)), rng.uniform(0, 2, (3, 40))
    px = spark.createDataFrame([(s, t, float(k[s, t]), float(b[s, t])) for s in range(3) for t in range(40)], "shot int, t int, k double, b double")
    prob = spark.createDataFrame([(s, r) for s in range(3) for r in range(5) if (s + r) % 2 == 0], "shot int, r int")
    return dict(q=q, pixels=pixels, mats=mats, rot=rot, w=w, voxels=voxels_of(spark, w), shots=shots, k=k, b=b, px=px, prob=prob)


def plain_logr(s, w, shot, r, phi=None):
    phi = 0.5 + 0.3 * shot if phi is None else phi
    total = 0.0
    for t in range(40):
        if t % 7 == 0:
            continue
        v = plain_interpolation(w, s["mats"][r] @ s["q"][t], GRID)
        if v is None:
            continue
        m = s["b"][shot, t] + phi * v
        if m > -1e-6:
            total += s["k"][shot, t] * np.log(m + 1e-6) - m
    return total


def terms_of(s, voxels=None, shots=None):
    model = ll.model_values(s["pixels"], s["rot"], s["voxels"] if voxels is None else voxels, GRID)
    return ll.pixel_terms(model, s["px"], s["shots"] if shots is None else shots, s["prob"])


def test_rounding_halves_down(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,), (1.2,), (-1.7,)], "x double")
    assert [r[0] for r in df.select(scalars.round_half_down(F.col("x"))).collect()] == [0, 1, 2, -1, -2, 1, -2]


def test_errdiv(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (inf, 1.0), (float("nan"), 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(scalars.errdiv(F.col("a"), F.col("b"))).collect()] == [0.5, 0, 0, 0, 0, 0]


def test_likelihood_as_plainly_written(spark, scene):
    got = {(r.shot, r.r): r.logr for r in ll.log_likelihood(terms_of(scene)).collect()}
    assert got == {(s, r): pytest.approx(plain_logr(scene, scene["w"], s, r), rel=1e-12) for s in range(3) for r in range(5) if (s + r) % 2 == 0}


def test_packed_kernel_agrees_with_the_relational_form(spark, scene):
    keep = np.random.default_rng(2).random(512) < 0.8
    v = voxels_of(spark, scene["w"], keep)
    sc = reconstruct.Scene.collect(scene["pixels"], scene["rot"], v, GRID)
    packed = reconstruct.packed_shots(scene["px"], scene["shots"], scene["prob"])
    density = reconstruct.to_density(sc, v)
    logr = ll.log_likelihood(terms_of(scene, v))
    want = {(r.shot, r.r): r.logr for r in logr.collect()}
    got = {(r.shot, r.r): r.logr for r in reconstruct.packed_log_likelihood(packed, sc, density).collect()}
    assert got == {k: pytest.approx(x, rel=1e-9) for k, x in want.items()}
    p = ll.probabilities(logr, 0.01)
    total, grad = reconstruct.packed_objective(packed, p, sc, density)
    assert total == pytest.approx(p.agg(F.sum(F.col("p") * F.col("logr"))).first()[0], rel=1e-9)
    slope = ll.density_slope(terms_of(scene, v).join(p.select("shot", "r", "p"), ["shot", "r"]), scene["pixels"], scene["rot"], GRID, [], F.col("p"))
    rel = {r.vox: r.g for r in slope.collect()}
    for vox in np.flatnonzero(keep):
        assert grad[sc.places[vox]] == pytest.approx(rel.get(int(vox), 0.0), rel=1e-9, abs=1e-9)


def test_derivatives_by_finite_differences(spark, scene):
    d = {(r.shot, r.r): r.d for r in ll.scale_slope(terms_of(scene)).collect()}
    for (s, r), x in d.items():
        phi, h = 0.5 + 0.3 * s, 1e-5
        assert x == pytest.approx((plain_logr(scene, scene["w"], s, r, phi + h) - plain_logr(scene, scene["w"], s, r, phi - h)) / (2 * h), rel=1e-6)
    slope = ll.density_slope(terms_of(scene).filter("shot = 1 AND r = 3"), scene["pixels"], scene["rot"], GRID, []).collect()
    for row in sorted(slope, key=lambda r: -abs(r.g))[:6]:
        h, i = 1e-5, np.unravel_index(row.vox, (8, 8, 8))
        up, down = scene["w"].copy(), scene["w"].copy()
        up[i] += h
        down[i] -= h
        assert row.g == pytest.approx((plain_logr(scene, up, 1, 3) - plain_logr(scene, down, 1, 3)) / (2 * h), rel=1e-5)


def test_probabilities_with_near_ties_and_far_ones(spark):
    df = spark.createDataFrame([(0, 0, -1e6), (0, 1, -1e6 - 0.5), (0, 2, -2e6), (1, 0, 3.0)], "shot int, r int, logr double")
    p = {(r.shot, r.r): r.p for r in ll.probabilities(df).collect()}
    assert p[0, 0] == pytest.approx(1 / (1 + np.exp(-0.5))) and p[0, 2] == 0 and p[1, 0] == 1 and p[0, 0] + p[0, 1] == pytest.approx(1)
    cut = {(r.shot, r.r): r.p for r in ll.probabilities(df, 1.0, 0.4).collect()}
    assert cut[0, 0] == pytest.approx(1) and cut[0, 1] == 0


def test_insertion_is_linear_adjoint_and_of_ones_one(spark, scene):
    pts = scene["pixels"].withColumn("v", F.rand(3))
    one = {r.vox: r for r in g.insert(pts, F.lit(1.0), GRID).collect()}
    assert all(r.w == pytest.approx(1) for r in one.values() if r.den > 1e-9)
    values = {r.t: r.v for r in pts.select("t", "v").collect()}
    pts = pts.drop("v").join(spark.createDataFrame(list(values.items()), "t int, v double"), "t")
    num = {r.vox: r.num for r in g.insert(pts, F.col("v"), GRID).collect()}
    back = {r.t: r.w for r in g.interpolate(scene["pixels"], scene["voxels"], GRID, ["t"]).collect()}
    assert sum(back[t] * values[t] for t in back) == pytest.approx(sum(num[v] * scene["w"].ravel()[v] for v in num))


def test_symmetry_and_mates(spark):
    w = cube()
    ops = g.symmetry_table(spark, "P43212")
    once = g.symmetrize(voxels_of(spark, w), ops, GRID)
    twice = {r.vox: r.w for r in g.symmetrize(once, ops, GRID).collect()}
    inner = [k for k in range(512) if all(1 <= i <= 6 for i in np.unravel_index(k, (8, 8, 8)))]
    first = {r.vox: r.w for r in once.collect()}
    assert all(twice[k] == pytest.approx(first[k]) for k in inner)
    mates = {r.vox: r.w for r in g.friedel(voxels_of(spark, w), GRID).collect()}
    flat = w.ravel()
    assert all(mates[k] == pytest.approx((flat[k] + flat[511 - k]) / 2) for k in range(512))
    with pytest.raises(ValueError):
        symmetry_matrices("P6")


def test_peak_mask_against_repeated_dilation(spark):
    cell = Cell(12.0, 12.0, 8.0)
    got = {r.vox for r in g.peak_mask(g.hkl_table(spark, cell, GRID.max_q), GRID, 1).collect()}
    mask = np.zeros((8, 8, 8), bool)
    m = np.round(cell.from_hkl(), 8)
    limits = g.hkl_limits(cell, GRID.max_q)
    centres = GRID.corner + GRID.delta * np.arange(8)
    for h in itertools.product(*(range(1 - x, x) for x in limits)):
        q = m @ np.array(h)
        mask[tuple(int(np.abs(centres - x).argmin()) for x in q)] = True
    grown = mask.copy()
    for axis in range(3):
        for step in (1, -1):
            moved = np.roll(mask, step, axis)
            edge = [slice(None)] * 3
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = False
            grown |= moved
    assert got == set(np.flatnonzero(grown).tolist())


def test_structuring_elements():
    assert len(g.kernel_offsets(1, 1)) == 7 and len(g.kernel_offsets(2, 1)) == 19 and len(g.kernel_offsets(3, 1)) == 27
    assert len(g.kernel_offsets(1, 2)) == 25 and len(g.kernel_offsets(3, 2)) == 125


def test_orientation_search_against_brute_force(spark):
    cell, mats = Cell(40.0, 40.0, 20.0), random_rotations(30, 3)
    rng = np.random.default_rng(8)
    truth, spots = {}, []
    for shot in range(4):
        truth[shot] = shot * 7
        for j in range(8):
            h = rng.integers(-4, 5, 3)
            q = np.linalg.inv(mats[truth[shot]]) @ (cell.from_hkl() @ h)
            spots.append((shot, j, *map(float, q)))
    rot = spark.createDataFrame([(r, *map(float, m.ravel())) for r, m in enumerate(mats)], f"r int, {M}")
    resid = orient.residuals(spark.createDataFrame(spots, "shot int, refl_id int, qx double, qy double, qz double"), rot, cell).persist()
    plain = {}
    for shot, j, *q in spots:
        for r, m in enumerate(mats):
            h = cell.to_hkl() @ m @ np.array(q)
            plain.setdefault((shot, r), []).append(np.linalg.norm(h - np.ceil(h - 0.5)))

    def n_prob(shot, cut, least):
        return [r for r in range(30) if sum(x < cut for x in plain[shot, r]) >= least]

    found = {(r.shot, r.r): r.n_pred for r in orient.probable(resid, 0.3, 3).collect()}
    assert found == {(s, r): sum(x < 0.3 for x in plain[s, r]) for s in range(4) for r in n_prob(s, 0.3, 3)}
    assert all((s, r) in found for s, r in truth.items())
    for row in orient.relaxed_cut(resid, 0.1, 0.05, 3, 4).collect():
        cut = 0.1
        while len(n_prob(row.shot, cut, 3)) <= 4:
            cut += 0.05
        assert row["cut"] == pytest.approx(cut) and row.n_rot == len(n_prob(row.shot, cut, 3))
    for row in orient.tightened_least(resid, 0.4, 1, 5).collect():
        least = 1
        while len(n_prob(row.shot, 0.4, least)) > 5:
            least += 1
        assert (row.least, row.n_rot) == (least, len(n_prob(row.shot, 0.4, least)))


def test_perturbed_rotations(spark, scene):
    small = orient.perturbations(spark, 1.0, 0.5)
    assert small.count() == 124
    rows = orient.perturbed(scene["prob"], scene["rot"], small).limit(50).collect()
    for r in rows:
        m = np.array([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ m.T, np.eye(3)) and np.arccos(np.clip((np.trace(m @ scene["mats"][r.r].T) - 1) / 2, -1, 1)) <= np.deg2rad(1.8)


def test_confident_shots_have_equivalent_rotations(spark):
    """Four rotations that differ by operations of the group; four of which the last is turned about (1, 1, 1), that leaves this vector where it was; four that take this vector to an axis of the group."""
    ops = symmetry_matrices("P43212").astype(float)
    own, third = random_rotations(1, 5)[0], np.array([[0.0, 1, 0], [0, 0, 1], [1, 0, 0]])
    x, y, z = np.array([1.0, -1, 0]) / 2 ** 0.5, np.array([1.0, 1, -2]) / 6 ** 0.5, np.ones(3) / 3 ** 0.5
    upright = np.array([x, y, z]) * np.linalg.det([x, y, z])
    assert np.allclose(np.abs(upright @ z), [0, 0, 1]) and np.allclose(third @ z, z)
    sets = [[ops[k] @ own for k in range(4)], [*(ops[k] @ own for k in range(3)), ops[3] @ own @ third], [ops[k] @ upright for k in range(4)]]
    rot = spark.createDataFrame([(4 * s + k, *map(float, m.ravel())) for s, mats in enumerate(sets) for k, m in enumerate(mats)], f"r int, {M}")
    p = spark.createDataFrame([(s, 4 * s + k, 0.25) for s in range(3) for k in range(4)] + [(3, 5, 1.0)], "shot int, r int, p double")
    found = orient.confident(p, rot, g.symmetry_table(spark, "P43212")).collect()
    assert sorted(map(tuple, found)) == [(0, 0, 4), (2, 8, 4), (3, 5, 1)]


def test_rotation_grid(spark):
    for n in (1, 2, 4):
        q = rotations.quaternion_grid(n)
        assert len(q) == rotations.grid_size(n) == len(np.unique(np.round(q[:, :4], 9), axis=0))
        assert np.allclose(np.linalg.norm(q[:, :4], axis=1), 1) and q[:, 4].sum() == pytest.approx(1)
    assert (q[:, :4] @ rotations.quaternion_grid(2)[:, :4].T).__abs__().max(axis=0) == pytest.approx(1)  # finer grids hold the coarser
    ops = rotations.icosahedral_rotations()
    assert len(ops) == 60
    kept = rotations.reduced(rotations.rotation_grid(spark, 3)).collect()
    assert sum(r.weight for r in kept) == pytest.approx(1) and len(kept) < rotations.grid_size(3) / 10


def test_quaternion_files(spark, tmp_path):
    q = rotations.rotation_grid(spark, 1)
    path = str(tmp_path / "grid.bin")
    assert files.write_quaternions(q, path) == 60
    spark.dataSource.register(files.QuaternionFile)
    back = spark.read.format("quaternions").option("path", path).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, q.collect()))
    text = tmp_path / "grid.txt"
    text.write_text("2\n0 0 0 1 0.5\n1 0 0 0 0.5\n")
    rows = spark.read.format("quaternions").option("path", str(text)).option("scalar", "last").load().collect()
    assert [tuple(r)[1:] for r in rows] == [(1.0, 0.0, 0.0, 0.0, 0.5), (0.0, 1.0, 0.0, 0.0, 0.5)]
    (tmp_path / "none.bin").write_bytes(struct.pack("<i", 0))
    assert spark.read.format("quaternions").option("path", str(tmp_path / "none.bin")).load().collect() == []


def test_background(spark):
    rng = np.random.default_rng(3)
    from voxelweave.plans import fixtures as f

    det = bg.detector_pixels(spark, f.DETECTOR)
    bins = f.bins(spark).persist()
    radial = bins.select(F.lit(0).alias("shot"), "x", "y", (100.0 / F.col("qbin")).alias("v"))
    spots = spark.createDataFrame([(0, 1, 20, 24, 30, 33)], "shot int, refl_id int, x1 int, x2 int, y1 int, y2 int")
    lit = radial.withColumn("v", F.when(F.col("x").between(20, 23) & F.col("y").between(30, 32), 1e4).otherwise(F.col("v")))
    strong = bg.strong_pixels(spots)
    assert strong.count() == 12
    left = bg.without_background(lit, bins, strong, det.withColumn("f", F.lit(1.0))).join(strong, ["shot", "x", "y"], "left_anti")
    assert left.agg(F.max(F.abs("v"))).first()[0] == pytest.approx(0, abs=1e-9)
    assert bg.signal_level(spots, lit).first().level == pytest.approx(1e4)
    image = rng.random((9, 11))
    px = spark.createDataFrame([(0, x, y, float(image[y, x])) for y in range(9) for x in range(11)], "shot int, x int, y int, v double")
    got = {(r.x, r.y): r.v for r in bg.median_filter(px, 3).collect()}
    padded = np.pad(image, 1, mode="symmetric")
    assert got == {(x, y): pytest.approx(np.median(padded[y:y + 3, x:x + 3])) for y in range(9) for x in range(11)}


def test_labels_and_centroids(spark):
    art = ["##..#", "#...#", "..#..", ".##.#"]
    px = spark.createDataFrame([(0, x, y, 1.0 + x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"], "shot int, x int, y int, v double")
    labels = bg.label_spots(px)
    got = {(r.x, r.y): r.label for r in labels.collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (0, 1): 1, (4, 0): 2, (4, 1): 2, (2, 2): 3, (2, 3): 3, (1, 3): 3, (4, 3): 4}
    c = {r.label: r for r in bg.spot_centroids(labels, px).collect()}
    assert c[1].n_px == 3 and c[1].cx == pytest.approx((0.5 + 2 * 1.5 + 0.5) / 4)
    assert {r.label for r in bg.spot_sizes(labels, 2, 2).collect()} == {2}


def test_gaussian_fit():
    z, y, x = np.meshgrid(*[np.arange(5) - 2.0] * 3, indexing="ij")
    box = 7.5 * np.exp(-z ** 2 / 2 - y ** 2 / 2 / 0.64 - x ** 2 / 2 / 1.44)
    amplitude, ok = peaks.fit_gaussian(box)
    assert ok and amplitude == pytest.approx(7.5, rel=1e-4)


def test_spline():
    w = cube(6)
    c = peaks.spline_coefficients(w)
    nodes = np.array(list(itertools.product(range(6), repeat=3)), float)
    assert np.allclose(peaks.spline_values(c, nodes), w.ravel())
    line = np.arange(40.0)
    cubic = (line[:, None, None] - 20) ** 3 / 100 + 0 * np.zeros((1, 3, 3))
    at = np.array([[20.3, 1.0, 1.0], [17.71, 1.5, 0.5]])
    assert np.allclose(peaks.spline_values(peaks.spline_coefficients(cubic), at), (at[:, 0] - 20) ** 3 / 100, atol=1e-6)
    assert peaks.spline_values(c, np.array([[-0.1, 0, 0], [5.1, 0, 0]])).tolist() == [0, 0]


def test_scales(spark, scene):
    """Shots drawn from the model at known scales: both updates find them."""
    model = ll.model_values(scene["pixels"], scene["rot"], scene["voxels"], GRID).persist()
    truth = {0: 0.7, 1: 2.0, 2: 1.3}
    exact = scene["prob"].filter("r < 2").join(model, "r").select("shot", "r", "t", (F.col("w") * F.element_at(F.create_map(*(F.lit(v) for kv in truth.items() for v in kv)), F.col("shot"))).alias("k"), F.lit(0.0).alias("b"))
    p = scene["prob"].filter("r < 2").select("shot", "r", F.lit(1.0).alias("p"))
    px = exact.select("shot", "t", "k", "b")
    terms = ll.pixel_terms(model, px, scene["shots"], p.select("shot", "r"))
    assert {r.shot: r.phi for r in update.fitted_scales(terms, p, scene["shots"]).collect()} == {s: pytest.approx(v, rel=1e-5) for s, v in truth.items()}
    assert {r.shot: r.phi for r in update.analytic_scales(p, model, px, scene["shots"]).collect()} == {s: pytest.approx(v) for s, v in truth.items()}
    none = update.analytic_scales(p.limit(0), model, px, scene["shots"]).collect()
    assert {(r.shot, r.changed) for r in none} == {(0, False), (1, False), (2, False)}


def test_shells_against_numpy(spark):
    rng = np.random.default_rng(0)
    d, a = np.round(rng.random(103), 2), rng.random(103)
    b = a + 0.3 * rng.random(103)
    got = {r.shell: r for r in ev.by_shell(spark.createDataFrame([tuple(map(float, x)) for x in zip(d, a, b)], "d double, i1 double, i2 double"), 6).collect()}
    edges = [x[0] for x in np.array_split(np.sort(d), 6)] + [d.max()]
    label = np.digitize(d, edges)
    for s in range(1, 6):
        sel = label == s
        if sel.sum() >= 2:
            assert (got[s].n, got[s].d) == (sel.sum(), pytest.approx(np.median(d[sel]))) and got[s].cc == pytest.approx(np.corrcoef(a[sel], b[sel])[0, 1])


def test_reference_reflections_raise_for_negative_shots(spark):
    bad = spark.createDataFrame([(-1, 1, 0, 0, True)], "shot int, h int, k int, l int, indexed boolean")
    with pytest.raises(Exception, match="negative shot"):
        ev.reference_reflections(bad).collect()
    with pytest.raises(Exception, match="no saved scale"):
        files.restarted_scales(spark.createDataFrame([(1, "a")], "shot int, name string"), spark.createDataFrame([("b", 1.0)], "name string, phi double")).collect()
    with pytest.raises(Exception, match="not an experiment"):
        files.experiment_lines(spark.createDataFrame([("one two three",)], "value string")).collect()


@pytest.mark.parametrize("method", ["lbfgs", "line_search", "analytical"])
def test_reconstruction_raises_the_likelihood_and_finds_orientations(spark, method):
    rng = np.random.default_rng(11)
    grid = Grid(8, 0.25)
    q = rng.uniform(-0.18, 0.18, (150, 3))
    mats = random_rotations(6, 9)
    truth = np.zeros((8, 8, 8))
    truth[2:6, 3:6, 2:5] = rng.uniform(5, 60, (4, 3, 3))
    pixels = spark.createDataFrame([(t, *map(float, x), True) for t, x in enumerate(q)], "t int, qx double, qy double, qz double, trusted boolean")
    rot = spark.createDataFrame([(r, *map(float, m.ravel())) for r, m in enumerate(mats)], f"r int, {M}")
    rows = []
    for s in range(12):
        for t in range(150):
            v = plain_interpolation(truth, mats[s % 6] @ q[t], grid)
            rows.append((s, t, float(rng.poisson(1 + (v or 0.0))), 1.0))
    px = spark.createDataFrame(rows, "shot int, t int, k double, b double")
    shots = spark.createDataFrame([(s, 1.0) for s in range(12)], "shot int, phi double")
    prob = shots.select("shot").crossJoin(rot.select("r"))
    start = voxels_of(spark, truth * rng.uniform(0.6, 1.4, truth.shape) + 0.5)
    best = []
    out, _, history = reconstruct.run(pixels, rot, px, shots, prob, start, start.select("vox"), grid, 3, method=method, steps=4,
                                      on_iteration=lambda i, v, s, p: best.append({r.shot: r.r for r in ll.best_rotations(p).collect()}))
    assert best[-1] == {s: s % 6 for s in range(12)}
    if method != "analytical":
        assert all(h["after"] >= h["functional"] for h in history) and history[-1]["functional"] > history[0]["functional"]
    assert out.count() == 512 and out.agg(F.min("w")).first()[0] >= 0


def test_ranks_and_medians_do_not_hang_on_partitions(spark):
    from voxelweave.operators import order

    rng = np.random.default_rng(8)
    values = [None, *rng.integers(0, 40, 301).tolist()]
    want = sorted(v for v in values if v is not None)
    for parts in (1, 7):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").orderBy(F.rand(parts)).repartition(parts)
        assert order.median(df, "v") == np.median(want)
        found, n = order.spans(df, "v")
        assert n == 301 and {r["value"]: (r["first"], r["last"]) for r in found.collect()} == {v: (want.index(v), len(want) - 1 - want[::-1].index(v)) for v in want}
        assert {r.i: r.place for r in order.ranked(df.select("i"), ["i"]).collect()} == {i: i for i in range(302)}
    assert order.median(df.limit(0), "v") is None and order.ranked(df.limit(0), ["i"]).collect() == []


def test_rotation_grid_in_tasks_is_the_grid(spark):
    rows = rotations.rotation_grid(spark, 4).orderBy("r").collect()
    want = rotations.quaternion_grid(4)
    assert [r.r for r in rows] == list(range(len(want))) and np.array([tuple(r)[1:] for r in rows]) == pytest.approx(want)


def test_a_start_density_is_normalized(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 0.25)], "vox int, w double")
    assert sorted(map(tuple, g.normalized_start(df, 3.0).collect())) == [(1, 3.0), (2, 0.0), (3, 1.5)]
    assert [tuple(r) for r in g.normalized_start(df.filter("w = 0"), 3.0).collect()] == [(2, 0.0)] and g.normalized_start(df.limit(0), 3.0).collect() == []
