"""The regular spherical grid: spacing laws, index map, cell sizes, cubic weights."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.functions.geometry import TWO_PI, cart_to_sph, positive_mod

LAWS = ("logarithmic", "power", "uniform")


@dataclass(frozen=True)
class GridSpec:
    """r is node-centred, theta cell-centred, phi node-centred and periodic."""

    n_r: int
    n_theta: int
    n_phi: int
    inner: float = 1.0
    outer: float = 12.5
    spacing: str = "logarithmic"
    exponent: float = 2.0

    def __post_init__(self) -> None:
        if self.spacing not in LAWS:
            raise ValueError(f"unknown spacing law {self.spacing!r}; expected one of {LAWS}")
        if self.n_phi % 2:
            raise ValueError(f"n_phi must be even so a pole reflects onto a node, got {self.n_phi}")
        if min(self.n_r, self.n_theta, self.n_phi) < 4:
            raise ValueError(f"every axis needs 4 nodes or more, got {self.shape}")
        if not 0.0 < self.inner < self.outer:
            raise ValueError("need 0 < inner < outer")

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.n_r, self.n_theta, self.n_phi

    @property
    def size(self) -> int:
        return self.n_r * self.n_theta * self.n_phi

    @property
    def theta_step(self) -> float:
        return math.pi / self.n_theta

    @property
    def phi_step(self) -> float:
        return TWO_PI / self.n_phi

    def refined(self, factor: int) -> "GridSpec":
        """The same shell and law with every count multiplied."""
        return replace(
            self, n_r=factor * self.n_r, n_theta=factor * self.n_theta, n_phi=factor * self.n_phi
        )

    def as_dict(self) -> dict:
        return asdict(self)

    # spacing law: radius(u), u(radius), d radius / d u
    def _roots(self) -> tuple[float, float]:
        return self.inner ** (1.0 / self.exponent), self.outer ** (1.0 / self.exponent)

    def radius(self, u, m=F):
        if self.spacing == "logarithmic":
            return self.inner * m.exp(u * math.log(self.outer / self.inner))
        if self.spacing == "power":
            low, high = self._roots()
            return m.pow(low + (high - low) * u, self.exponent)
        return self.inner + (self.outer - self.inner) * u

    def parameter(self, r, m=F):
        if self.spacing == "logarithmic":
            return m.log(r / self.inner) / math.log(self.outer / self.inner)
        if self.spacing == "power":
            low, high = self._roots()
            return (m.pow(r, 1.0 / self.exponent) - low) / (high - low)
        return (r - self.inner) / (self.outer - self.inner)

    def radius_slope(self, u, m=F):
        if self.spacing == "logarithmic":
            return self.radius(u, m) * math.log(self.outer / self.inner)
        if self.spacing == "power":
            low, high = self._roots()
            return self.exponent * (high - low) * m.pow(low + (high - low) * u, self.exponent - 1.0)
        return u * 0.0 + (self.outer - self.inner)

    # nodes
    def node_position(self, i_r, i_t, i_p, m=F):
        """Spherical position of a node."""
        return (
            self.radius(i_r / float(self.n_r - 1), m),
            (i_t + 0.5) * self.theta_step,
            i_p * self.phi_step,
        )

    def flat_id(self, i_r, i_t, i_p):
        return (i_r * self.n_theta + i_t) * self.n_phi + i_p

    # index map
    def index_of(self, r, theta, phi, m=F):
        """Fractional node indices of a spherical position."""
        return (
            self.parameter(r, m) * float(self.n_r - 1),
            theta / self.theta_step - 0.5,
            positive_mod(phi / self.phi_step, float(self.n_phi), m),
        )

    def index_slope(self, r, m=F):
        """d(index)/d(r), d(index)/d(theta), d(index)/d(phi)."""
        return (
            (self.n_r - 1) / self.radius_slope(self.parameter(r, m), m),
            1.0 / self.theta_step,
            1.0 / self.phi_step,
        )

    def cell_extent(self, r, theta, m=F):
        """Smallest local cell edge; the azimuthal edge never counts below the meridional one."""
        radial = self.radius_slope(self.parameter(r, m), m) / float(self.n_r - 1)
        meridional = r * self.theta_step
        azimuthal = r * m.sin(theta) * self.phi_step
        if m is np:
            return np.minimum(radial, np.minimum(meridional, np.maximum(azimuthal, meridional)))
        return F.least(radial, meridional, F.greatest(azimuthal, meridional))


def index_columns(spec: GridSpec, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return spec.index_of(*cart_to_sph(x, y, z))


def voxel_bin(spec: GridSpec, x: Column, y: Column, z: Column, nearest: bool = False) -> Column:
    """Flat id of the voxel a position falls in (floor of the index; optionally the nearest node)."""
    shift = 0.5 if nearest else 0.0
    fr, ft, fp = index_columns(spec, x, y, z)
    i_r = F.least(F.greatest(F.floor(fr + shift), F.lit(0)), F.lit(spec.n_r - 1))
    i_t = F.least(F.greatest(F.floor(ft + shift), F.lit(0)), F.lit(spec.n_theta - 1))
    i_p = F.pmod(F.floor(fp + shift), F.lit(spec.n_phi))
    return spec.flat_id(i_r, i_t, i_p).cast("long")


def keys_weights(t):
    """Four cubic-convolution weights (a = -1/2) for taps -1, 0, 1, 2."""
    return (
        t * (-0.5 + t * (1.0 - 0.5 * t)),
        1.0 + t * t * (1.5 * t - 2.5),
        t * (0.5 + t * (2.0 - 1.5 * t)),
        t * t * (0.5 * t - 0.5),
    )


def keys_slopes(t):
    """Derivatives of the four weights."""
    return (
        -0.5 + t * (2.0 - 1.5 * t),
        t * (4.5 * t - 5.0),
        0.5 + t * (4.0 - 4.5 * t),
        t * (1.5 * t - 1.0),
    )
