"""Row sources: grid nodes, seeds, pixels and line-of-sight samples.

Each takes a table with ``snapshot_id`` and gives every snapshot its own set. Axes are exploded one after
the other, with the work spread over tasks after the first, so no single array or task grows with a grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.camera import Camera
from heliospark.functions.geometry import MARGIN, TWO_PI, clip_radius, sph_to_cart
from heliospark.functions.grid import GridSpec
from heliospark.session import task_count

#: Longest array an explode may build.
_ROW = 4096


def _axis(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def axes(snapshots: DataFrame, **sizes: int) -> DataFrame:
    """Every index combination for every snapshot."""
    df = snapshots.select("snapshot_id").distinct()
    for k, (name, n) in enumerate(sizes.items()):
        df = df.withColumn(name, _axis(n))
        if k == 0 and len(sizes) > 1:
            df = df.repartition(task_count(df.sparkSession), "snapshot_id", name)
    return df


def counter(snapshots: DataFrame, name: str, n: int) -> DataFrame:
    """The numbers 0..n-1 for every snapshot."""
    blocks = math.ceil(n / _ROW)
    df = axes(snapshots, _block=blocks, _item=min(n, _ROW))
    number = F.col("_block") * _ROW + F.col("_item")
    return df.select("snapshot_id", number.alias(name)).where(F.col(name) < n)


def grid_nodes(snapshots: DataFrame, spec: GridSpec) -> DataFrame:
    df = axes(snapshots, i_r=spec.n_r, i_t=spec.n_theta, i_p=spec.n_phi)
    i = [F.col(c) for c in ("i_r", "i_t", "i_p")]
    df = df.select("*", spec.flat_id(*i).alias("node_id"), *_named(spec.node_position(*i), "r theta phi"))
    return df.select("*", *_named(sph_to_cart(*_cols("r theta phi")), "x y z"))


def _cols(names: str) -> list[Column]:
    return [F.col(c) for c in names.split()]


def _named(columns, names: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, names.split())]


def lonlat_points(snapshots: DataFrame, n_theta: int, n_phi: int, radius: float, nudge: bool) -> DataFrame:
    """Cell-centred angles on a sphere; seeds are nudged just outside it."""
    df = axes(snapshots, i_t=n_theta, i_p=n_phi).select(
        "*",
        ((F.col("i_t") + 0.5) * (math.pi / n_theta)).alias("theta"),
        ((F.col("i_p") + 0.5) * (TWO_PI / n_phi)).alias("phi"),
        (F.col("i_t") * n_phi + F.col("i_p")).alias("seed_id"),
    )
    r = F.lit(radius * (1.0 + MARGIN) if nudge else radius)
    return df.select("*", *_named(sph_to_cart(r, *_cols("theta phi")), "x y z"))


def sphere_seeds(
    snapshots: DataFrame, radius: float, n_theta: int, n_phi: int, inner: float, outer: float
) -> DataFrame:
    """Colatitudes at cell centres, azimuths at nodes, clipped into the shell."""
    df = axes(snapshots, i_t=n_theta, i_p=n_phi).select(
        "*", (F.col("i_t") * n_phi + F.col("i_p")).alias("seed_id")
    )
    theta = (F.col("i_t") + 0.5) * (math.pi / n_theta)
    phi = F.col("i_p") * (TWO_PI / n_phi)
    position = sph_to_cart(F.lit(radius), theta, phi)
    return df.select("*", *_named(clip_radius(*position, inner, outer), "x y z"))


def fibonacci_seeds(snapshots: DataFrame, n: int, radius: float) -> DataFrame:
    """Golden-angle spiral just outside a sphere."""
    i = F.col("seed_id")
    theta = F.acos(1.0 - (2.0 * i + 1.0) / n)
    phi = i * (math.pi * (3.0 - math.sqrt(5.0)))
    return counter(snapshots, "seed_id", n).select(
        "*", *_named(sph_to_cart(F.lit(radius * (1.0 + MARGIN)), theta, phi), "x y z")
    )


def limb_ring(snapshots: DataFrame, n: int, radius: float, camera: Camera) -> DataFrame:
    """Points on the plane-of-sky great circle."""
    _, right, up = camera.basis()
    turn = F.col("seed_id") * (TWO_PI / n)
    reach = radius * (1.0 + MARGIN)
    at = [(F.cos(turn) * float(right[k]) + F.sin(turn) * float(up[k])) * reach for k in range(3)]
    return counter(snapshots, "seed_id", n).select("*", *_named(at, "x y z"))


def view_seeds(
    snapshots: DataFrame, camera: Camera, radius: float, n: int = 1500, n_limb: int = 375, seeding: str = "limb"
) -> DataFrame:
    """Seeds of a field-line picture, tagged with the part they belong to."""
    if seeding not in ("limb", "uniform"):
        raise ValueError(f"seeding is 'limb' or 'uniform', not {seeding!r}")
    spiral = fibonacci_seeds(snapshots, n, radius)
    if seeding == "uniform":
        return spiral.withColumn("part", F.lit("uniform"))
    look = camera.basis()[0]
    facing = sum(F.col(c) * float(v) for c, v in zip("xyz", look))
    ring = limb_ring(snapshots, n_limb, radius, camera).withColumn("seed_id", F.col("seed_id") + n)
    return (
        spiral.where(facing > 0)
        .withColumn("part", F.lit("front"))
        .unionByName(ring.withColumn("part", F.lit("ring")))
    )


def pixels(snapshots: DataFrame, camera: Camera) -> DataFrame:
    """Pixel centres on the image plane with ray origin and impact parameter."""
    df = axes(snapshots, prow=camera.height, pcol=camera.width)
    px, py = camera.plane(F.col("prow"), F.col("pcol"))
    df = df.select(
        "*",
        (F.col("prow") * camera.width + F.col("pcol")).alias("pixel_id"),
        px.alias("px"),
        py.alias("py"),
        F.sqrt(px * px + py * py).alias("rho"),
    )
    return df.select("*", *_named(camera.origin(*_cols("px py")), "ox oy oz"))


def sample_count(outer: float, step: float) -> int:
    return math.ceil(2.0 * outer / step) + 1


def los_samples(pixel_table: DataFrame, camera: Camera, outer: float, step: float) -> DataFrame:
    """Sample points along each ray at signed distances from -outer to outer."""
    n = sample_count(outer, step)
    look = camera.basis()[0]
    s = -outer + F.col("k") * (2.0 * outer / (n - 1))
    df = pixel_table.withColumn("k", _axis(n)).withColumn("s", s)
    at = [F.col(f"o{c}") + F.col("s") * float(v) for c, v in zip("xyz", look)]
    return df.select(
        "*",
        *_named(at, "x y z"),
        F.sqrt(F.col("rho") * F.col("rho") + F.col("s") * F.col("s")).alias("r"),
    )
