"""Coordinate and vector formulas.

Each formula takes a namespace ``m``: ``pyspark.sql.functions`` gives Columns (the default),
``numpy`` gives the same formula inside an Arrow batch, so both paths share one definition.
Angles are radians, theta is the colatitude and phi the azimuth in [0, 2 pi).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
#: Relative nudge that keeps a position strictly inside the shell.
MARGIN = 1e-9


def choose(condition, yes, no, m=F):
    return np.where(condition, yes, no) if m is np else F.when(condition, yes).otherwise(no)


def clamp(value, low, high, m=F):
    """Hold a value between limits; as Columns a NULL becomes the lower limit, so guard it where it matters."""
    if m is np:
        return np.clip(value, low, high)
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def ratio(a, b, m=F):
    """Division with "no value" (NULL or NaN) where the denominator is zero."""
    if m is np:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b == 0, np.nan, a / b)
    return F.try_divide(a, b)


def positive_mod(value, period: float, m=F):
    return np.mod(value, period) if m is np else F.pmod(value, F.lit(period))


def norm(x, y, z, m=F):
    return m.sqrt(x * x + y * y + z * z)


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b):
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def cart_to_sph(x, y, z, m=F):
    """(r, theta, phi); theta is 0 at the origin."""
    r = norm(x, y, z, m)
    cosine = (
        np.divide(z, r, out=np.ones_like(r), where=r > 0)
        if m is np
        else F.coalesce(F.try_divide(z, r), F.lit(1.0))
    )
    return r, m.acos(clamp(cosine, -1.0, 1.0, m)), positive_mod(m.atan2(y, x), TWO_PI, m)


def sph_to_cart(r, theta, phi, m=F):
    ring = r * m.sin(theta)
    return ring * m.cos(phi), ring * m.sin(phi), r * m.cos(theta)


def coord_jacobian(x, y, z, m=F):
    """Rows d(r), d(theta), d(phi) by d(x, y, z); no value on the polar axis."""
    ring2 = x * x + y * y
    ring = m.sqrt(ring2)
    r2 = ring2 + z * z
    r = m.sqrt(r2)
    zero = ring2 * 0.0
    return (
        (ratio(x, r, m), ratio(y, r, m), ratio(z, r, m)),
        (ratio(x * z, r2 * ring, m), ratio(y * z, r2 * ring, m), ratio(-ring, r2, m)),
        (ratio(-y, ring2, m), ratio(x, ring2, m), zero),
    )


def point_angles(x, y, z, m=F):
    """sin theta, cos theta, sin phi, cos phi of a position, with phi = 0 on the axis."""
    ring = m.sqrt(x * x + y * y)
    r = m.sqrt(ring * ring + z * z)
    return (
        choose(r == 0, r * 0.0, ratio(ring, r, m), m),
        choose(r == 0, r * 0.0 + 1.0, ratio(z, r, m), m),
        choose(ring == 0, ring * 0.0, ratio(y, ring, m), m),
        choose(ring == 0, ring * 0.0 + 1.0, ratio(x, ring, m), m),
    )


def to_spherical_components(v, angles):
    st, ct, sp, cp = angles
    along = v[0] * cp + v[1] * sp
    return along * st + v[2] * ct, along * ct - v[2] * st, v[1] * cp - v[0] * sp


def to_cartesian_components(v, angles):
    st, ct, sp, cp = angles
    outward = v[0] * st + v[1] * ct
    return outward * cp - v[2] * sp, outward * sp + v[2] * cp, v[0] * ct - v[1] * st


def vec_cart_to_sph(vx, vy, vz, x, y, z):
    return to_spherical_components((vx, vy, vz), point_angles(x, y, z))


def vec_sph_to_cart(vr, vt, vp, x, y, z):
    return to_cartesian_components((vr, vt, vp), point_angles(x, y, z))


def vec_file_angles(vr, vt, vp, theta: Column, phi: Column):
    """Rotate with the angles a file states, which may lie past the poles."""
    return to_cartesian_components(
        (vr, vt, vp), (F.sin(theta), F.cos(theta), F.sin(phi), F.cos(phi))
    )


def clip_radius(x, y, z, inner: float, outer: float, m=F):
    """Rescale a position radially to just inside the shell."""
    r = norm(x, y, z, m)
    kept = clamp(r, inner * (1.0 + MARGIN), outer * (1.0 - MARGIN), m)
    scale = choose(r > 0, ratio(kept, r, m), r * 0.0 + 1.0, m)
    return x * scale, y * scale, z * scale


def in_shell(r, inner: float, outer: float):
    return (r >= inner) & (r <= outer)


def sign_or_null(value: Column) -> Column:
    return F.signum(value).cast("long")
