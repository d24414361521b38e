"""Thomson scattering: Minnaert coefficients and the scattered intensity."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from heliospark.functions.geometry import choose, clamp

LIMB_DARKENING = 0.6
#: Radius from which the far-field series replaces the closed form.
CROSSOVER = 10.0
#: Mass density to relative electron density.
MEAN_MOLECULAR_WEIGHT = 1.27
TABLE_NODES = 4096


def minnaert(r, crossover: float = CROSSOVER, m=F):
    """Coefficients A, B, C, D at a radius."""
    sine = clamp(1.0 / r, 0.0, 1.0, m)
    s2 = sine * sine
    cosine = m.sqrt(clamp(1.0 - s2, 0.0, None, m))
    lit = cosine > 1e-12
    safe = choose(lit, cosine, cosine * 0.0 + 1.0, m)
    limb = choose(lit, safe * safe / sine * m.log((1.0 + sine) / safe), cosine * 0.0, m)
    near = (
        cosine * s2,
        -(1.0 - 3.0 * s2 - (1.0 + 3.0 * s2) * limb) / 8.0,
        4.0 / 3.0 - cosine - cosine * cosine * cosine / 3.0,
        (5.0 + s2 - (5.0 - s2) * limb) / 8.0,
    )
    t2 = m.asin(sine) * m.asin(sine)
    far = (
        t2 * (1.0 - 5.0 / 6.0 * t2),
        t2 * (2.0 / 3.0 - 22.0 / 45.0 * t2),
        t2 * (1.0 - t2 / 3.0),
        t2 * (2.0 / 3.0 - 2.0 / 9.0 * t2),
    )
    return tuple(choose(r >= crossover, f, n, m) for f, n in zip(far, near))


def intensity_coefficients(r, u: float = LIMB_DARKENING, crossover: float = CROSSOVER, m=F):
    """Tangential and polarized coefficient with linear limb darkening u."""
    a, b, c, d = minnaert(r, crossover, m)
    return (1.0 - u) * c + u * d, (1.0 - u) * a + u * b


def thomson_intensity(rho, r, c_tan, c_pol, mode: str = "K", m=F):
    """Scattered intensity per electron: total ("K") or polarized ("pB")."""
    if mode not in ("K", "pB"):
        raise ValueError(f"mode is 'K' or 'pB', not {mode!r}")
    polarized = c_pol * (rho * rho) / (r * r)
    return polarized if mode == "pB" else 2.0 * c_tan - polarized


@lru_cache(maxsize=32)
def coefficient_table(inner: float, outer: float, u: float, crossover: float) -> tuple[np.ndarray, np.ndarray]:
    """Both coefficients at TABLE_NODES log-spaced radii."""
    r = np.exp(np.linspace(math.log(inner), math.log(outer), TABLE_NODES))
    return intensity_coefficients(r, u, crossover, np)


def table_lookup(r, inner: float, outer: float, u: float, crossover: float, m=F):
    """Both coefficients read linearly in ln r from the table, held at its ends.

    The table has a fixed size, so as Columns it rides along as a folded array literal.
    """
    low, high = math.log(inner), math.log(outer)
    top = TABLE_NODES - 1
    position = clamp((m.log(r) - low) * (top / (high - low)), 0.0, float(top), m)
    tables = coefficient_table(inner, outer, u, crossover)
    if m is np:
        below = position.astype(np.int64)
        above, share = np.minimum(below + 1, top), position - below
        return tuple(t[below] * (1.0 - share) + t[above] * share for t in tables)
    below = F.floor(position).cast("int")
    above, share = F.least(below + 1, F.lit(top)), position - below
    arrays = [F.split(F.lit(",".join(map(repr, t.tolist()))), ",").cast("array<double>") for t in tables]
    return tuple(F.get(t, below) * (1.0 - share) + F.get(t, above) * share for t in arrays)
