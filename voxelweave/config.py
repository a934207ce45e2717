"""Geometry of grids, detectors and crystals: small values that live on the driver and enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Grid:
    """A cube of n voxels a side; centres of equal bins of [-max_q, max_q]. Flat index (ix * n + iy) * n + iz."""

    n: int = 256
    max_q: float = 0.25

    @property
    def delta(self) -> float:
        return 2 * self.max_q / self.n

    @property
    def corner(self) -> float:
        return -self.max_q + self.delta / 2


@dataclass(frozen=True)
class Cell:
    """A unit cell (a, b, c in Å, angles in degrees)."""

    a: float = 79.1
    b: float = 79.1
    c: float = 38.4
    alpha: float = 90.0
    beta: float = 90.0
    gamma: float = 90.0

    def orthogonalization(self) -> np.ndarray:
        ca, cb, cg = (np.cos(np.deg2rad(x)) for x in (self.alpha, self.beta, self.gamma))
        sg = np.sin(np.deg2rad(self.gamma))
        v = np.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
        m = np.array([[self.a, self.b * cg, self.c * cb], [0, self.b * sg, self.c * (ca - cb * cg) / sg], [0, 0, self.c * v / sg]])
        return np.where(np.abs(m) < 1e-12, 0.0, m)

    def to_hkl(self) -> np.ndarray:
        """Takes a scattering vector to fractional Miller indices."""
        return self.orthogonalization().T

    def from_hkl(self) -> np.ndarray:
        m = np.linalg.inv(self.to_hkl())
        return np.where(np.abs(m) < 1e-12, 0.0, m)

    @property
    def orthogonal(self) -> bool:
        return self.alpha == self.beta == self.gamma == 90.0


@dataclass(frozen=True)
class Detector:
    """One flat panel; lengths in mm, pixels square."""

    fast: tuple[float, float, float] = (1.0, 0.0, 0.0)
    slow: tuple[float, float, float] = (0.0, -1.0, 0.0)
    origin: tuple[float, float, float] = (-12.288, 12.288, -300.0)
    pixel: float = 0.512
    n_fast: int = 48
    n_slow: int = 48
    #: Half-open rectangles (fast from, fast to, slow from, slow to) that are not trusted.
    masked: tuple[tuple[int, int, int, int], ...] = ((0, 48, 22, 24), (10, 12, 0, 48))

    @property
    def distance(self) -> float:
        n = np.cross(self.fast, self.slow)
        return float(abs(np.dot(n, self.origin)))


@dataclass(frozen=True)
class Beam:
    wavelength: float = 6.2
    direction: tuple[float, float, float] = (0.0, 0.0, -1.0)
    polarization_normal: tuple[float, float, float] = (0.0, 1.0, 0.0)
    polarization_fraction: float = 0.999


# Rotation parts of the symmetry operations of some space groups, as coordinate triplets.
SYMMETRY_TRIPLETS = {
    "P1": ("x,y,z",),
    "P222": ("x,y,z", "-x,-y,z", "-x,y,-z", "x,-y,-z"),
    "P43212": ("x,y,z", "-x,-y,z", "-y,x,z", "y,-x,z", "-x,y,-z", "x,-y,-z", "y,x,-z", "-y,-x,-z"),
    "C2221": ("x,y,z", "-x,-y,z", "-x,y,-z", "x,-y,-z"),
}


def symmetry_matrices(group: str) -> np.ndarray:
    """(operations, 3, 3) integers. Unknown groups raise."""
    if group not in SYMMETRY_TRIPLETS:
        raise ValueError(f"no symmetry table for {group}")
    out = []
    for triplet in SYMMETRY_TRIPLETS[group]:
        rows = []
        for part in triplet.split(","):
            row = [0, 0, 0]
            row["xyz".index(part[-1])] = -1 if part.startswith("-") else 1
            rows.append(row)
        out.append(rows)
    return np.array(out)
