"""SQL of the fixture views, for the comparison with DuckDB. ``sql(names, query)`` puts the views that a query needs before it."""

from __future__ import annotations

import re

import numpy as np

from voxelweave.config import symmetry_matrices
from voxelweave.plans import fixtures as f

G = f.GRID
C, D, N = repr(G.corner), repr(G.delta), G.n
M = [f"m{i}{j}" for i in range(3) for j in range(3)]


def _number(v) -> str:
    """With an exponent, a literal is a double and not a decimal."""
    text = repr(v)
    return text if isinstance(v, int) or "e" in text else text + "e0"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_number, r)) + ")" for r in rows)


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0" + (f" AS {name}" if name else "")


def matvec(m: list[str], v: list[str]) -> list[str]:
    return [f"{m[3 * i]} * {v[0]} + {m[3 * i + 1]} * {v[1]} + {m[3 * i + 2]} * {v[2]}" for i in range(3)]


def eight(source: str, keys: str, q: tuple[str, str, str] = ("qx", "qy", "qz")) -> str:
    """(keys, vox, a): the eight voxels around points."""
    place = ", ".join(f"({c} - ({C})) / {D} AS f{k}" for k, c in enumerate(q))
    cells = ", ".join(f"CAST(floor(f{k}) AS INTEGER) AS i{k}, f{k} - floor(f{k}) AS r{k}" for k in range(3))
    inside = " AND ".join(f"floor(f{k}) BETWEEN 0 AND {N - 2}" for k in range(3))
    parts = []
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                a = " * ".join(f"r{k}" if d else f"(1 - r{k})" for k, d in enumerate((dx, dy, dz)))
                parts.append(f"SELECT {keys}, ((i0 + {dx}) * {N} + i1 + {dy}) * {N} + i2 + {dz} AS vox, {a} AS a FROM cells")
    return f"(WITH places AS (SELECT {keys}, {place} FROM {source}), cells AS (SELECT {keys}, {cells} FROM places WHERE {inside}) " + " UNION ALL ".join(parts) + ")"


def centres(source: str, keys: str) -> str:
    ix = (f"(vox // {N * N})", f"(vox // {N} % {N})", f"(vox % {N})")
    return f"(SELECT {keys}, " + ", ".join(f"{i} * {D} + ({C}) AS {q}" for i, q in zip(ix, ("qx", "qy", "qz"))) + f" FROM {source})"


def nearest(source: str, keys: str) -> str:
    """(keys, ix, iy, iz, vox) of points between the first and the last voxel centre."""
    last = repr(G.corner + (G.n - 1) * G.delta)
    inside = " AND ".join(f"abs({q}) < {3 ** 0.5 * G.max_q!r} AND {q} > {C} AND {q} <= {last}" for q in ("qx", "qy", "qz"))
    ix = ", ".join(f"CAST(ceil(({q} - ({C})) / {D} - 0.5) AS INTEGER) AS {i}" for q, i in zip(("qx", "qy", "qz"), ("ix", "iy", "iz")))
    return f"(SELECT *, (ix * {N} + iy) * {N} + iz AS vox FROM (SELECT {keys}, {ix} FROM {source} WHERE {inside}))"


def _det() -> tuple[str, str, str]:
    d, b = f.DETECTOR, f.BEAM
    k = [f"({o!r} + x * {fa * d.pixel!r} + y * {s * d.pixel!r})" for o, fa, s in zip(d.origin, d.fast, d.slow)]
    place = f"SELECT x, y, {', '.join(f'{c} AS k{n}' for n, c in enumerate(k))}, sqrt({' + '.join(f'{c} * {c}' for c in k)}) AS size FROM (SELECT CAST(i % {d.n_fast} AS INTEGER) AS x, CAST(i // {d.n_fast} AS INTEGER) AS y FROM range({d.n_fast * d.n_slow}) t(i))"
    q = ", ".join(f"(k{n} / size - ({float(s)!r})) / {b.wavelength!r} AS q{c}" for n, (s, c) in enumerate(zip(b.direction, "xyz")))
    incident, axis = np.array(b.direction), np.array(b.polarization_normal)
    b_in = np.cross(axis, incident)
    e_in = np.cross(incident, b_in)
    dot = lambda v: "(" + " + ".join(f"({float(x)!r}) * k{n} / size" for n, x in enumerate(v)) + ")"
    c2 = f"({dot(incident)} * {dot(incident)})"
    polar = f"0.5 * (1.0 + {c2} - {b.polarization_fraction!r} * cos(2 * -atan2({dot(b_in)}, {dot(e_in)})) * (1 - {c2}))"
    omega = f"{d.pixel ** 2 * d.distance!r} / (size * size * size)"
    return place, q, f"{polar} AS polar, {omega} AS omega"


_PLACE, _Q, _FACTORS = _det()
_LOW, _STEP = f.radial_edges()
_HKL = "CAST(o_orderkey % 9 - 4 AS INTEGER) AS h, CAST(o_custkey % 9 - 4 AS INTEGER) AS k, CAST(day(o_orderdate) % 9 - 4 AS INTEGER) AS l"
_MASKED = " OR ".join(f"(x BETWEEN {a} AND {b - 1} AND y BETWEEN {c} AND {d - 1})" for a, b, c, d in f.DETECTOR.masked)
_FROM_HKL = np.round(f.CELL.from_hkl(), 8)


def _limits() -> tuple[int, int, int]:
    from voxelweave.operators.grid import hkl_limits

    return hkl_limits(f.CELL, G.max_q)


def _asu(group: str) -> str:
    images = []
    for m in symmetry_matrices(group):
        for sign in (1, -1):
            part = ["+".join(f"({int(sign * m[j][i])}) * {'hkl'[j]}" for j in range(3) if m[j][i]) for i in range(3)]
            images.append("[" + ", ".join(part) + "]")
    return f"list_max([{', '.join(images)}])"


VIEWS = {
    "px": "SELECT CAST(vec_id AS INTEGER) AS t, " + ", ".join(f"0.8 * CAST(embedding[{k + 1}] AS DOUBLE) AS {q}" for k, q in enumerate(("qx", "qy", "qz"))) + ", label <> 0 AS trusted FROM embeddings",
    "shot_px": "SELECT CAST(event_id // n AS INTEGER) AS shot, CAST(event_id % n AS INTEGER) AS t, value AS k, CAST(0.05 AS DOUBLE) * (event_id % 7) AS b FROM events, (SELECT count(*) AS n FROM embeddings)",
    "shots": "SELECT shot, CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (shot % 4) AS phi, 'shot' || shot AS name FROM (SELECT DISTINCT shot FROM shot_px)",
    "voxels": f"SELECT CAST((l_orderkey * 7 + l_linenumber * 13) % {N ** 3} AS INTEGER) AS vox, sum(l_quantity) / 100 AS w FROM lineitem GROUP BY 1",
    "masked": "SELECT vox FROM voxels WHERE vox % 3 <> 0",
    "rot": f"SELECT * FROM (VALUES {_rows(f.rotation_rows())}) t(r, {', '.join(M)})",
    "prob_rot": "SELECT shot, r FROM shots, rot WHERE (shot + r) % 3 = 0",
    "symop": f"SELECT * FROM (VALUES {_rows([(k, *map(float, m.ravel())) for k, m in enumerate(symmetry_matrices(f.GROUP))])}) t(op_id, {', '.join(M)})",
    "rotpx": "SELECT r, t, " + ", ".join(f"{e} AS {q}" for e, q in zip(matvec(M, ["px.qx", "px.qy", "px.qz"]), ("qx", "qy", "qz"))) + " FROM px, rot WHERE trusted",
    "around": "SELECT * FROM " + eight("rotpx", "r, t"),
    "model": "SELECT r, t, sum(a * coalesce(w, 0)) AS w FROM around LEFT JOIN voxels USING (vox) GROUP BY r, t",
    "terms": "SELECT * FROM (SELECT shot, r, t, k, b, phi, w, b + phi * w AS m FROM prob_rot JOIN shots USING (shot) JOIN model USING (r) JOIN shot_px USING (shot, t)) WHERE m > -1e-6",
    "logr": "SELECT shot, r, count(*) AS n_px, sum(k * ln(m + 1e-6) - m) AS logr FROM terms GROUP BY shot, r",
    "soft": f"SELECT shot, r, logr, e / sum(e) OVER (PARTITION BY shot) AS p0 FROM (SELECT *, exp({f.BETA!r} * (logr - max(logr) OVER (PARTITION BY shot))) AS e FROM logr)",
    "pdr": f"SELECT shot, r, logr, q * sum(p0) OVER (PARTITION BY shot) / sum(q) OVER (PARTITION BY shot) AS p FROM (SELECT *, CASE WHEN p0 < {f.MIN_P!r} THEN 0 ELSE p0 END AS q FROM soft)",
    "hkls": f"SELECT h, k, l, avg(o_totalprice) / CAST({f.UNIT!r} AS DOUBLE) AS i FROM (SELECT {_HKL}, o_totalprice FROM orders) GROUP BY h, k, l",
    "hkl_ref": f"SELECT h, k, l, avg(l_extendedprice) / CAST({f.UNIT!r} AS DOUBLE) AS i FROM (SELECT {_HKL}, l_extendedprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY h, k, l",
    "pairs": "SELECT a.h, a.k, a.l, a.i AS i1, b.i AS i2, 1 / sqrt(" + " + ".join(f"(a.{n} * {float(x)!r}) * (a.{n} * {float(x)!r})" for n, x in zip("hkl", np.diag(f.CELL.from_hkl()))) + ") AS d FROM hkls a JOIN hkl_ref b ON a.h = b.h AND a.k = b.k AND a.l = b.l WHERE NOT (a.h = 0 AND a.k = 0 AND a.l = 0)",
    "hklq": "SELECT h, k, l, " + ", ".join(f"{e} AS {q}" for e, q in zip(matvec([repr(float(x)) for x in _FROM_HKL.ravel()], ["h", "k", "l"]), ("qx", "qy", "qz")))
            + " FROM " + ", ".join(f"(SELECT CAST(v AS INTEGER) AS {n} FROM range({1 - m}, {m}) t(v))" for n, m in zip("hkl", _limits())),
    "peaks": "SELECT * FROM " + nearest("hklq", "h, k, l"),
    "refl": f"""SELECT CAST(o_orderkey % {f.SPOT_SHOTS} AS INTEGER) AS shot, o_orderkey AS refl_id, CAST(o_orderkey * 7 % 40 AS INTEGER) AS x1, CAST(o_orderkey * 7 % 40 + 1 + o_orderkey % 5 AS INTEGER) AS x2,
        CAST(o_custkey * 11 % 40 AS INTEGER) AS y1, CAST(o_custkey * 11 % 40 + 1 + o_custkey % 4 AS INTEGER) AS y2, CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 1000 * CAST(0.4 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS qx,
        CAST(o_custkey * 53 % 1000 AS DOUBLE) / 1000 * CAST(0.4 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS qy, CAST(o_orderkey * 71 % 997 AS DOUBLE) / 1000 * CAST(0.4 AS DOUBLE) - CAST(0.2 AS DOUBLE) AS qz, {_HKL}, o_totalprice AS i,
        o_totalprice * (1 + o_orderkey % 3) * 1000 AS var, o_orderstatus <> 'P' AS indexed, CAST(o_orderkey % 13 AS DOUBLE) / 10 - CAST(0.6 AS DOUBLE) AS dx, CAST(o_custkey % 17 AS DOUBLE) / 10 - CAST(0.8 AS DOUBLE) AS dy FROM orders""",
    "image": f"SELECT CAST(event_id // {f.SIDE ** 2} AS INTEGER) AS shot, CAST(event_id % {f.SIDE ** 2} % {f.SIDE} AS INTEGER) AS x, CAST(event_id % {f.SIDE ** 2} // {f.SIDE} AS INTEGER) AS y, value / CAST({f.UNIT!r} AS DOUBLE) AS v FROM events",
    "det": _PLACE,
    "detq": f"SELECT x, y, {_Q} FROM det",
    "detf": f"SELECT x, y, {_FACTORS} FROM det",
    "bins": f"SELECT x, y, CAST(floor((sqrt(qx * qx + qy * qy + qz * qz) - {_LOW!r}) / {_STEP!r}) AS INTEGER) + 1 AS qbin FROM detq WHERE NOT ({_MASKED})",
    "boxes": "SELECT shot, refl_id, x, unnest(range(greatest(y1, 0), y2)) AS y FROM (SELECT shot, refl_id, unnest(range(greatest(x1, 0), x2)) AS x, y1, y2 FROM refl)",
    "strong": "SELECT DISTINCT shot, x, y FROM boxes",
    "radial": "SELECT shot, qbin, median(v) AS v FROM image JOIN bins USING (x, y) ANTI JOIN strong USING (shot, x, y) GROUP BY shot, qbin",
    "toms": "SELECT r, t, CASE WHEN sum(p * phi) > 0 THEN sum(p * k) / sum(p * phi) ELSE 0 END AS w FROM pdr JOIN shots USING (shot) JOIN shot_px USING (shot) WHERE p >= 1e-5 GROUP BY r, t",
    "resid": "SELECT shot, r, refl_id, sqrt(" + " + ".join(f"(h{k} - ceil(h{k} - 0.5)) * (h{k} - ceil(h{k} - 0.5))" for k in range(3)) + ") AS residual FROM (SELECT shot, r, refl_id, "
             + ", ".join(f"{e} AS h{k}" for k, e in enumerate(matvec([repr(float(x)) for x in f.CELL.to_hkl().ravel()], ["ux", "uy", "uz"])))
             + " FROM (SELECT shot, r, refl_id, " + ", ".join(f"{e} AS {u}" for e, u in zip(matvec(M, ["qx", "qy", "qz"]), ("ux", "uy", "uz"))) + " FROM refl, rot))",
}


def sql(query: str) -> str:
    """``query`` with the views it needs, in the order of VIEWS."""
    need, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    parts = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in need)
    if parts and query.startswith("WITH "):
        return f"WITH {parts}, {query[5:]}"
    return f"WITH {parts} {query}" if parts else query
