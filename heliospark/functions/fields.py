"""Closed-form source-surface dipole and the algebra of deviation vectors.

As in ``geometry``, ``m`` selects Columns or NumPy for the same formula.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.functions.geometry import clamp, dot, ratio


@dataclass(frozen=True)
class DipoleField:
    """Potential dipole between a photosphere and a source surface where B is radial."""

    r_sun: float = 1.0
    r_source: float = 2.5
    strength: float = 1.0

    def __post_init__(self) -> None:
        if not 0.0 < self.r_sun < self.r_source:
            raise ValueError("need 0 < r_sun < r_source")

    @property
    def inner(self) -> float:
        return self.r_sun

    @property
    def outer(self) -> float:
        return self.r_source

    @property
    def normalisation(self) -> float:
        return self.r_sun**3 + 2.0 * self.r_source**3

    @property
    def background(self) -> float:
        return self.strength * self.r_sun**3 / self.normalisation

    @property
    def moment(self) -> float:
        return self.background * self.r_source**3

    def b(self, x, y, z, m=F):
        r2 = x * x + y * y + z * z
        pull = 3.0 * self.moment * z / (r2 * r2 * m.sqrt(r2))
        return pull * x, pull * y, pull * z - self.moment / (r2 * m.sqrt(r2)) + self.background

    def jacobian(self, x, y, z, m=F):
        """dB_i/dx_j as three rows."""
        r2 = x * x + y * y + z * z
        near = 3.0 * self.moment / (r2 * r2 * m.sqrt(r2))
        far = 5.0 * near / r2 * z
        p = (x, y, z)
        rows = []
        for i in range(3):
            row = []
            for j in range(3):
                lead = (p[i] if j == 2 else 0.0) + (p[j] if i == 2 else 0.0)
                lead = lead + z if i == j else lead
                row.append(near * lead - far * p[i] * p[j])
            rows.append(tuple(row))
        return tuple(rows)

    def characteristic_length(self) -> float:
        """Step ceiling metric of a closed-form field: a fixed share of the shell width."""
        return 0.02 * (self.r_source - self.r_sun)

    def flux(self, x: Column, y: Column, z: Column) -> Column:
        """Constant along a field line."""
        ring2 = x * x + y * y
        r2 = ring2 + z * z
        return self._profile(F.sqrt(r2)) * F.try_divide(ring2, r2)

    def _profile(self, r):
        return r * r + 2.0 * self.r_source**3 / r

    def separatrix(self, r: Column) -> Column:
        """Northern colatitude of the open-closed boundary at a radius."""
        return F.asin(F.sqrt(3.0 * self.r_source**2 / self._profile(r)))

    def q_exact(self, theta: Column, r: Column) -> Column:
        """Exact squashing factor of the line through (theta, r)."""
        foot_sin2 = clamp(
            F.sin(theta) ** 2 * self._profile(r) / self._profile(self.r_sun), 0.0, 1.0
        )
        edge_sin2 = 3.0 * self.r_source**2 / self._profile(self.r_sun)
        cube_sun, cube_source = self.r_sun**3, self.r_source**3
        radial2 = ((2.0 * cube_source + cube_sun) / self.normalisation) ** 2 * (1.0 - foot_sin2)
        polar2 = ((cube_source - cube_sun) / self.normalisation) ** 2 * foot_sin2
        stretch = (
            (self.r_source / self.r_sun) ** 2
            / edge_sin2
            * (3.0 * cube_sun / self.normalisation)
            * F.sqrt(clamp(1.0 - foot_sin2 / edge_sin2, 0.0, None))
            / F.sqrt(radial2 + polar2)
        )
        on_cap = F.asin(F.sqrt(foot_sin2)) < math.asin(math.sqrt(edge_sin2))
        return F.when(on_cap, stretch + F.try_divide(F.lit(1.0), stretch)).otherwise(F.lit(2.0))


def unit_gradient(unit, size, jac):
    """Gradient of the unit field: (I - b b^T) J / |B|, as three rows."""
    along = [unit[0] * jac[0][j] + unit[1] * jac[1][j] + unit[2] * jac[2][j] for j in range(3)]
    return tuple(tuple(F.try_divide(jac[i][j] - unit[i] * along[j], size) for j in range(3)) for i in range(3))


def advect(gradient, d):
    """(d . grad) of the unit field."""
    return tuple(dot(row, d) for row in gradient)


def least_aligned(unit):
    """The axis least aligned with a unit vector (the first on ties), made normal to it; not unit length."""
    ax, ay, az = (F.abs(c) for c in unit)
    pick = F.when((ax <= ay) & (ax <= az), F.lit(0)).when(ay <= az, F.lit(1)).otherwise(F.lit(2))
    lean = F.when(pick == 0, unit[0]).when(pick == 1, unit[1]).otherwise(unit[2])
    return tuple((pick == k).cast("double") - lean * unit[k] for k in range(3))


def reproject(d, b, normal, m=F):
    """Slide a deviation along B onto the plane with the given normal."""
    shift = ratio(dot(d, normal), dot(b, normal), m)
    return tuple(d[i] - shift * b[i] for i in range(3))


def master_formula(a_f, b_f, a_b, b_b, prefactor, b0_squared, m=F):
    mixed = 2.0 * dot(a_f, b_f) * dot(a_b, b_b)
    total = dot(a_f, a_f) * dot(b_b, b_b) + dot(a_b, a_b) * dot(b_f, b_f) - mixed
    return ratio(prefactor, b0_squared, m) * total


def safe_log10(value: Column) -> Column:
    """log10 of finite positive values, otherwise NULL."""
    usable = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf"))
    return F.when(usable, F.log10(value))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


