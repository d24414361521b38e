"""Halo tiles: the scale path for reading a volume at many points.

A tile is a box of r and theta indices with every azimuth. Each node is sent to the few tiles whose
halo holds it, each point to exactly one tile, and the 64-tap sums run vectorised per tile. Points of a
crowded tile are split over several tasks, so no task ever holds more than a bounded share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions.geometry import cart_to_sph
from heliospark.functions.grid import GridSpec
from heliospark.operators.blocks import Block, cartesian_gradient
from heliospark.operators.ranks import BROADCAST_ROWS
from heliospark.session import materialise

#: Points handled by one task of a tile.
ROWS_PER_TASK = 200_000


@dataclass(frozen=True)
class Tiling:
    spec: GridSpec
    block_r: int = 32
    block_t: int = 32
    halo: int = 3

    @property
    def counts(self) -> tuple[int, int]:
        return (
            math.ceil(self.spec.n_r / self.block_r),
            math.ceil(self.spec.n_theta / self.block_t),
        )

    def tile_of(self, fr, ft, m=F):
        """Tile number of a fractional index."""
        n_r, n_t = self.counts
        if m is np:
            tr = np.clip(np.floor(fr), 0, self.spec.n_r - 1) // self.block_r
            tt = np.clip(np.floor(ft), 0, self.spec.n_theta - 1) // self.block_t
            return (tr * n_t + tt).astype(np.int64)
        tr = F.floor(F.least(F.greatest(F.floor(fr), F.lit(0)), F.lit(self.spec.n_r - 1)) / self.block_r)
        tt = F.floor(F.least(F.greatest(F.floor(ft), F.lit(0)), F.lit(self.spec.n_theta - 1)) / self.block_t)
        return F.coalesce(tr * n_t + tt, F.lit(0)).cast("long")

    def _scales(self, other: GridSpec):
        """Linear maps from this grid's r and theta index to another grid on the same shell and law."""
        k_r = (other.n_r - 1) / (self.spec.n_r - 1)
        k_t = other.n_theta / self.spec.n_theta
        return (k_r, 0.0), (k_t, 0.5 * k_t - 0.5)

    def box(self, tile: int, other: GridSpec | None = None) -> tuple[int, int, int, int]:
        """Node range (r0, r1, t0, t1) of a tile with its halo, in the indices of ``other``."""
        other = other or self.spec
        tr, tt = divmod(tile, self.counts[1])
        out = []
        for index, size, (k, c) in zip((tr, tt), (self.block_r, self.block_t), self._scales(other)):
            low = math.floor(k * (index * size - 0.5) + c) if index == 0 else math.floor(k * index * size + c)
            high = math.floor(k * (index + 1) * size + c)
            out += [low - self.halo + 1, high + self.halo + 1]
        return tuple(out)

    def spread(self, nodes: DataFrame, other: GridSpec | None = None) -> DataFrame:
        """One copy of each node per tile whose halo reaches it."""
        other = other or self.spec
        axes = zip(("i_r", "i_t"), (self.block_r, self.block_t), self.counts, self._scales(other))
        reach = []
        for column, size, count, (k, c) in axes:
            slack = self.halo + 2
            first = F.floor((F.col(column) - c - slack) / (k * size)) - (0 if k >= 1 else 1)
            last = F.floor((F.col(column) - c + slack) / (k * size))
            top = F.lit(count - 1)
            reach.append(
                F.sequence(
                    F.least(F.greatest(first, F.lit(0)), top), F.least(F.greatest(last, F.lit(0)), top)
                )
            )
        return (
            nodes.withColumn("_tr", F.explode(reach[0]))
            .withColumn("_tt", F.explode(reach[1]))
            .withColumn("tile", (F.col("_tr") * self.counts[1] + F.col("_tt")).cast("long"))
            .drop("_tr", "_tt")
        )


def node_rows(nodes: DataFrame, values: list[str], kind: int = 0, width: int | None = None) -> DataFrame:
    """Nodes in the common layout of the tile join: key, indices, source kind, values v0.. ."""
    width = width or len(values)
    padded = list(values) + [None] * (width - len(values))
    return nodes.select(
        "snapshot_id",
        F.col("i_r").cast("int").alias("i_r"),
        F.col("i_t").cast("int").alias("i_t"),
        F.col("i_p").cast("int").alias("i_p"),
        F.lit(kind).alias("kind"),
        *[
            (F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(f"v{k}")
            for k, c in enumerate(padded)
        ],
    )


def tile_join(
    points: DataFrame,
    nodes: DataFrame,
    row_id: list[str],
    evaluate,
    schema: T.StructType,
    rows_per_task: int = ROWS_PER_TASK,
    *,
    tasks: int | None = None,
) -> DataFrame:
    """Bring each tile's nodes to its points; both sides carry snapshot_id and tile.

    ``evaluate(points, nodes) -> pa.Table`` sees one tile and at most about ``rows_per_task`` points. With ``tasks`` there are
    so many, where Spark would put tiles together by their bytes: for points that are small but much work.
    """
    keys = ["snapshot_id", "tile"]
    shares = points.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / rows_per_task).cast("int").alias("_shares")
    )
    # the counts go to both sides, never a side to the counts: where there are many, those of crowded tiles
    # alone, of which there are few, and a tile without points comes to nothing
    shares = materialise(shares, "shares")
    few = shares.count() <= BROADCAST_ROWS
    shares = F.broadcast(shares if few else shares.where(F.col("_shares") > 1))
    how = "inner" if few else "left"
    count = F.coalesce(F.col("_shares"), F.lit(1))
    left = points.join(shares, keys, how).withColumn("_share", F.pmod(F.xxhash64(*row_id), count).cast("int"))
    right = nodes.join(shares, keys, how).withColumn("_share", F.explode(F.sequence(F.lit(0), count - 1)))
    group = keys + ["_share"]
    left, right = left.drop("_shares"), right.drop("_shares")
    # both sides may come from one table: give the node side column identities of its own
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    if tasks:
        left, right = left.repartition(tasks, *group), right.repartition(tasks, *group)
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(evaluate, schema)


def as_numpy(table: pa.Table, name: str) -> np.ndarray:
    """A double column with NaN for NULL."""
    return table.column(name).to_numpy(zero_copy_only=False).astype(float, copy=False)


def block_of(tiling: Tiling, spec: GridSpec, nodes: pa.Table, tile: int, width: int, kind: int = 0) -> Block:
    if "kind" in nodes.column_names and nodes.num_rows:
        kinds = nodes.column("kind").to_numpy(zero_copy_only=False)
        nodes = nodes.filter(pa.array(kinds == kind))
    index = [nodes.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i_r", "i_t", "i_p")]
    return Block(spec, tiling.box(tile, spec), *index, [as_numpy(nodes, f"v{k}") for k in range(width)])


def nullable(array: np.ndarray) -> pa.Array:
    return pa.array(array, type=pa.float64(), from_pandas=True)


def schema_with(df: DataFrame, names: list[str], drop=()) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in drop]
    return T.StructType(fields + [T.StructField(n, T.DoubleType()) for n in names])


def sample_tiles(
    points: DataFrame,
    nodes: DataFrame,
    spec: GridSpec,
    values: list[str],
    row_id: list[str],
    out: list[str] | None = None,
    mode: str = "value",
    outside: str = "clamp",
    at: tuple[str, str, str] = ("x", "y", "z"),
    tiling: Tiling | None = None,
) -> DataFrame:
    """Read node columns at points and append one column per value.

    mode: ``value``, ``skip_nan``, ``nearest``, ``gradient`` (values, then d/dx, d/dy, d/dz of each value).
    outside the shell: ``clamp`` the radial index, give ``null`` or ``zero``.
    """
    tiling = tiling or Tiling(spec)
    gradient = mode == "gradient"
    names = list(out or values)
    if gradient:
        names += [f"d{axis}_{v}" for v in (out or values) for axis in ("x", "y", "z")]
    fr, ft, _ = spec.index_of(*cart_to_sph(*(F.col(c) for c in at)))
    keyed = points.withColumn("tile", tiling.tile_of(fr, ft))
    schema = schema_with(points, names)
    width = len(values)
    kept = points.columns

    def evaluate(rows: pa.Table, tile_nodes: pa.Table) -> pa.Table:
        result = np.full((rows.num_rows, len(names)), np.nan)
        if rows.num_rows:
            x, y, z = (as_numpy(rows, c) for c in at)
            r, theta, phi = cart_to_sph(x, y, z, np)
            inside = (r >= spec.inner) & (r <= spec.outer)
            use = np.isfinite(r) & (inside | (outside == "clamp"))
            if outside == "zero":
                result[np.isfinite(r) & ~inside] = 0.0
            if use.any() and tile_nodes.num_rows:
                block = block_of(tiling, spec, tile_nodes, rows.column("tile")[0].as_py(), width)
                index = list(spec.index_of(r[use], theta[use], phi[use], np))
                if outside == "clamp":
                    index[0] = np.clip(index[0], -1.0, spec.n_r - 1.0)
                else:
                    index[0] = np.clip(index[0], 0.0, spec.n_r - 1.0)
                if mode == "nearest":
                    result[use] = block.nearest(*index)
                else:
                    value, slope = block.cubic(*index, gradient=gradient, skip_nan=mode == "skip_nan")
                    if gradient:
                        grad = cartesian_gradient(spec, slope, x[use], y[use], z[use], r[use])
                        value = np.hstack([value, grad.reshape(len(value), -1)])
                    result[use] = value
        arrays = [rows.column(c) for c in kept] + [nullable(result[:, k]) for k in range(len(names))]
        return pa.Table.from_arrays(arrays, names=kept + names)

    return tile_join(keyed, tiling.spread(node_rows(nodes, values)), row_id, evaluate, schema)


def nearest_voxel(spec: GridSpec, x: Column, y: Column, z: Column) -> list[Column]:
    """Node indices nearest to a position; indices past an axis end keep the ghost rules."""
    fr, ft, fp = spec.index_of(*cart_to_sph(x, y, z))
    i_t = F.floor(ft + 0.5)
    past = (i_t < 0) | (i_t >= spec.n_theta)
    mirrored = F.when(i_t < 0, -1 - i_t).when(i_t >= spec.n_theta, 2 * spec.n_theta - 1 - i_t).otherwise(i_t)
    turn = F.when(past, F.lit(spec.n_phi // 2)).otherwise(F.lit(0))
    return [
        F.floor(fr + 0.5).cast("long"),
        mirrored.cast("long"),
        F.pmod(F.floor(fp + 0.5) + turn, F.lit(spec.n_phi)).cast("long"),
    ]
