"""Orthographic camera: an image basis computed once and used as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """``look`` points from the centre to the observer; row 0 is the top of the image."""

    look: tuple[float, float, float] = (1.0, 0.0, 0.0)
    up: tuple[float, float, float] = (0.0, 0.0, 1.0)
    fov: float = 25.0
    height: int = 1024
    width: int = 1024
    roll: float = 0.0

    @classmethod
    def from_sub_observer(cls, lon_deg: float, lat_deg: float, roll_deg: float = 0.0, **size) -> "Camera":
        lon, lat = math.radians(lon_deg), math.radians(lat_deg)
        look = (math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat))
        return cls(look=look, roll=math.radians(roll_deg), **size)

    @property
    def scale(self) -> float:
        return self.fov / self.width

    @property
    def n_pixels(self) -> int:
        return self.height * self.width

    def basis(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit look, right and up vectors after the roll."""
        look = np.asarray(self.look, dtype=float)
        look = look / np.linalg.norm(look)
        up = np.asarray(self.up, dtype=float)
        up = up - (up @ look) * look
        size = np.linalg.norm(up)
        if size < 1e-12:
            raise ValueError("the up vector is parallel to the line of sight")
        up = up / size
        right = np.cross(up, look)
        c, s = math.cos(self.roll), math.sin(self.roll)
        return look, c * right - s * up, s * right + c * up

    def plane(self, row: Column, col: Column) -> tuple[Column, Column]:
        """Image-plane position of a pixel centre."""
        return (
            (col - 0.5 * (self.width - 1)) * self.scale,
            (0.5 * (self.height - 1) - row) * self.scale,
        )

    def origin(self, px: Column, py: Column) -> tuple[Column, ...]:
        _, right, up = self.basis()
        return tuple(px * float(right[i]) + py * float(up[i]) for i in range(3))

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Fractional column, fractional row and signed depth of a position."""
        look, right, up = (
            x * float(v[0]) + y * float(v[1]) + z * float(v[2]) for v in self.basis()
        )
        return (
            right / self.scale + 0.5 * (self.width - 1),
            0.5 * (self.height - 1) - up / self.scale,
            look,
        )


def depth_along(camera: Camera, x: Column, y: Column, z: Column) -> Column:
    look = camera.basis()[0]
    return x * float(look[0]) + y * float(look[1]) + z * float(look[2])


def distance_to_axis(px: Column, py: Column) -> Column:
    return F.sqrt(px * px + py * py)
