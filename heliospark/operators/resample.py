"""Scattered or structured cells onto the regular grid."""

from __future__ import annotations

from itertools import count

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions.geometry import TWO_PI
from heliospark.operators.tiles import as_numpy, tile_join
from heliospark.operators.ranks import join_few
from heliospark.operators.stencil import on_ring, rings
from heliospark.session import large, materialise

#: Cells a bucket may hold before buckets are halved.
BUCKET_CAP = 4096
#: A snapshot of so many cells is one block; blocks are as wide as for so many neighbours at least.
WHOLE_CELLS, LEAST_K = 2048, 30
RIDGE = 1e-8


#: Cells of a mesh for which k neighbours are meant; larger meshes take more.
REFERENCE_CELLS = 2_000_000


def effective_neighbours(n_cells: int, k: int = 30, reference: int = REFERENCE_CELLS) -> int:
    """Neighbours per node, growing with the mesh (round half to even)."""
    if k <= 4:
        raise ValueError("k must exceed the four unknowns of a linear fit")
    return max(k, min(round(k * n_cells / reference), n_cells))


def _bucket(edge: Column, scale: float) -> list[Column]:
    return [F.floor(F.col(c) / (edge * scale)).cast("long").alias(f"_{c}") for c in "xyz"]


def _bucket_edges(cells: DataFrame, k: int) -> DataFrame:
    """First bucket edge of each snapshot: a ball of that radius holds about 1.5 k cells on average over the box.

    For few neighbours it is no smaller than for LEAST_K, so that a block is worth its task.
    """
    side = lambda c: F.max(c) - F.min(c)
    box = F.greatest(side("x"), side("y"), side("z"))
    n = F.count(F.lit(1))
    reach = F.greatest(*[F.max(F.abs(c)) for c in "xyz"]) * 1.7321
    edge = box * F.pow(F.lit(0.36 * max(k, LEAST_K)) / n, F.lit(1.0 / 3.0))
    return cells.groupBy("snapshot_id").agg(
        F.greatest(edge, F.lit(1e-12)).alias("_edge"), reach.alias("_reach"),
        n.alias("_count"),
    )


def _shrink_crowded(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Halve the edge of a snapshot until no bucket holds more than BUCKET_CAP cells (counts only).

    It ends, as the cells at one position are fewer than that: some edge tells the others apart.
    """
    for level in count():
        crowd = (
            join_few(cells, edges)
            .groupBy("snapshot_id", *_bucket(F.col("_edge"), 1.0))
            .count()
            .groupBy("snapshot_id")
            .agg(F.max("count").alias("_max"))
        )
        checked = materialise(edges.join(crowd, "snapshot_id"), f"bucket-edges-{level}")
        edges = checked.withColumn(
            "_edge", F.when(F.col("_max") > BUCKET_CAP, F.col("_edge") / 2).otherwise(F.col("_edge"))
        ).drop("_max")
        if checked.where(F.col("_max") > BUCKET_CAP).isEmpty():
            return edges


_PAIR = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("distance", T.DoubleType())])


def knn_join(points: DataFrame, cells: DataFrame, k: int, id_col: str = "pid") -> DataFrame:
    """The k nearest cells of every point of the same snapshot, exactly; ties go to the smaller cell_id."""
    wanted = cells.groupBy("snapshot_id").agg(F.lit(k).cast("long").alias("_wanted"))
    found = _around(points, cells, wanted, k, id_col, [], T.ArrayType(_PAIR), _pairs)
    rows = found.select("snapshot_id", id_col, F.posexplode("_near").alias("_rank", "_n"))
    return rows.select(
        "snapshot_id", id_col, (F.col("_rank") + 1).cast("long").alias("rank"), F.col("_n.cell_id").alias("cell_id"),
        F.col("_n.distance").alias("distance"),
    )


def _around(points: DataFrame, cells: DataFrame, wanted: DataFrame, widest: int, id_col: str, values: list[str], kind, made) -> DataFrame:
    """What ``made`` makes of each point's nearest cells, as many as its snapshot's ``_wanted`` (at most ``widest``).

    A snapshot of at most WHOLE_CELLS cells is one block, whose points all settle at once. Where there are more,
    space is cut into blocks two edges wide; a block's points meet the cells of the block and of a rim one
    edge wide, in one task per block (several where many points share it). A point is settled once its last
    wanted cell lies within what the rim covers for sure; the rest goes on with blocks twice as wide. The result is
    made where the cells are, so no row per neighbour is ever shuffled. Cells at one position beyond the smallest ids
    that could be chosen are dropped first. Points and cells without a position take no part.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    cells, points = cells.where(placed), points.where(placed)
    sizes = materialise(cells.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_count")).join(wanted, "snapshot_id"), "sizes")
    cells = cells.select("snapshot_id", F.col("cell_id").cast("long").alias("cell_id"), "x", "y", "z", *values)
    points = points.select("snapshot_id", id_col, "x", "y", "z")
    few, many = sizes.where(F.col("_count") <= WHOLE_CELLS), sizes.where(F.col("_count") > WHOLE_CELLS).drop("_count")
    if many.isEmpty():
        return _whole(points, cells, few, id_col, kind, made, values)
    settled = []
    if not few.isEmpty():
        settled.append(_whole(points, join_few(cells, few.select("snapshot_id")), few, id_col, kind, made, values))
    cells = join_few(cells, many.select("snapshot_id"))
    copies = Window.partitionBy("snapshot_id", "x", "y", "z").orderBy("cell_id")
    sites = cells.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= widest).drop("_copy")
    edges = materialise(_shrink_crowded(sites, _bucket_edges(sites, widest)).join(many, "snapshot_id"), "edges")
    sites = join_few(sites, edges.select("snapshot_id", "_edge"))
    waiting = join_few(points, edges)
    scale = 1.0
    while True:
        step = materialise(_knn_round(waiting, sites, id_col, scale, values, kind, made), "knn-round")
        settled.append(step.where("_done").select("snapshot_id", id_col, "_near"))
        waiting = step.where(~F.col("_done")).drop("_done", "_near")
        if waiting.isEmpty():
            break
        scale *= 2.0
    found = settled[0]
    for part in settled[1:]:
        found = found.unionByName(part)
    return found


def _whole(points: DataFrame, cells: DataFrame, few: DataFrame, id_col: str, kind, made, values: list[str]) -> DataFrame:
    """The same for snapshots that are one block: every cell moves once (for each task of the block) and no point waits."""
    tile = F.lit(0).cast("long").alias("tile")
    asked = join_few(points, few.select("snapshot_id", "_wanted")).select("*", tile)
    held = cells.select("*", tile)
    schema = T.StructType([asked.schema["snapshot_id"], asked.schema[id_col], T.StructField("_near", kind)])

    def evaluate(rows: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("cell_id")
        xyz = np.stack([as_numpy(block, c) for c in "xyz"], axis=1)
        at = np.stack([as_numpy(rows, c) for c in "xyz"], axis=1)
        size = np.minimum(as_numpy(rows, "_wanted"), len(xyz)).astype(np.int64)
        picks, gaps = _nearest(at, xyz, int(size.max(initial=1)))
        near = made(block, at, xyz, picks, gaps, size, values)
        return pa.Table.from_arrays([rows.column("snapshot_id"), rows.column(id_col), near], names=schema.names)

    return tile_join(asked, held, [id_col], evaluate, schema)


#: Block numbers of one axis lie within this of zero, so three of them pack into one key.
_SPAN = 1 << 20


def _block_key(numbers) -> Column:
    key, fits = F.lit(0).cast("long"), F.lit(True)
    for n in numbers:
        key = key * (2 * _SPAN) + (n + _SPAN)
        fits &= (n >= -_SPAN) & (n < _SPAN)
    far = F.raise_error(F.lit("positions lie too far from the origin for the distance of their neighbours: shift them"))
    return F.when(fits, key).otherwise(far).cast("long")


def _knn_round(waiting: DataFrame, sites: DataFrame, id_col: str, scale: float, values: list[str], kind, made) -> DataFrame:
    rim = F.col("_edge") * scale
    kept = waiting.columns
    asked = waiting.withColumn("tile", _block_key([F.floor(F.col(c) / (2.0 * rim)) for c in "xyz"]))
    held = sites
    for c in "xyz":
        reach = F.sequence(F.floor((F.col(c) - rim) / (2.0 * rim)), F.floor((F.col(c) + rim) / (2.0 * rim)))
        held = held.withColumn(f"_{c}", F.explode(reach))
    held = held.select("snapshot_id", _block_key([F.col(f"_{c}") for c in "xyz"]).alias("tile"), "cell_id", "x", "y", "z", *values)
    schema = T.StructType(waiting.schema.fields + [T.StructField("_near", kind), T.StructField("_done", T.BooleanType())])

    def evaluate(rows: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("cell_id")
        xyz = np.stack([as_numpy(block, c) for c in "xyz"], axis=1)
        at = np.stack([as_numpy(rows, c) for c in "xyz"], axis=1)
        edge = as_numpy(rows, "_edge") * scale
        offset = at - np.floor(at / (2.0 * edge[:, None])) * (2.0 * edge[:, None])
        sure = edge + np.minimum(offset, 2.0 * edge[:, None] - offset).min(axis=1, initial=np.inf)
        everything = edge >= as_numpy(rows, "_reach") + np.linalg.norm(at, axis=1)
        wanted = np.minimum(as_numpy(rows, "_wanted"), as_numpy(rows, "_count")).astype(np.int64)
        picks, gaps = _nearest(at, xyz, int(wanted.max(initial=1)))
        size = np.minimum(wanted, picks.shape[1])
        far = np.full(len(at), np.inf)
        some = size > 0
        far[some] = gaps[some, size[some] - 1]
        done = ((size >= wanted) & (far <= sure)) | everything
        size = np.where(done, size, 0)
        near = made(block, at, xyz, picks, gaps, size, values)
        return pa.Table.from_arrays([rows.column(c) for c in kept] + [near, pa.array(done)], names=schema.names)

    return tile_join(asked, held, [id_col], evaluate, schema)


def _pairs(block: pa.Table, at, xyz, picks, gaps, size, values) -> pa.Array:
    """Ids and distances, nearest first."""
    chosen = np.arange(picks.shape[1]) < size[:, None]
    ids = block.column("cell_id").to_numpy(zero_copy_only=False)[picks[chosen]]
    structs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(gaps[chosen], pa.float64())], names=_PAIR.names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), structs)


def _moments(block: pa.Table, at, xyz, picks, gaps, size, values) -> pa.Array:
    """The weighted normal-equation sums of a linear fit around each point: 10 shared, 4 per variable."""
    n, width = len(at), len(_MOMENTS) + 4 * len(values)
    out = np.zeros((n, width))
    each = [as_numpy(block, v) for v in values]
    for lo in range(0, n if picks.shape[1] else 0, rows_at_once(16 * picks.shape[1])):
        part = slice(lo, lo + rows_at_once(16 * picks.shape[1]))
        pick, gap = picks[part], gaps[part]
        chosen = np.arange(pick.shape[1]) < size[part][:, None]
        mean = np.where(chosen, gap, 0.0).sum(axis=1) / np.maximum(size[part], 1)
        w = np.where(chosen, np.exp(-((gap / np.maximum(mean, 1e-30)[:, None]) ** 2)), 0.0)
        basis = np.concatenate([np.ones((*pick.shape, 1)), xyz[pick] - at[part][:, None, :]], axis=2)
        weighted = basis * w[:, :, None]
        square = np.einsum("nki,nkj->nij", weighted, basis)
        out[part, : len(_MOMENTS)] = np.stack([square[:, int(m[1]), int(m[2])] for m in _MOMENTS], axis=1)
        for k, v in enumerate(each):
            first = len(_MOMENTS) + 4 * k
            out[part, first : first + 4] = np.einsum("nki,nk->ni", weighted, v[pick])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(out.ravel()))


def _nearest(at: np.ndarray, xyz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the given cells (sorted by id) per point: their places and distances, nearest first."""
    n, m = len(at), len(xyz)
    take = min(k, m)
    gaps, picks = np.empty((n, take)), np.empty((n, take), dtype=np.int64)
    pool = min(m, take + 8)
    for lo in range(0, n if take else 0, rows_at_once(m)):
        part = slice(lo, lo + rows_at_once(m))
        d = np.sqrt(sum((at[part, c, None] - xyz[None, :, c]) ** 2 for c in range(3)))
        if pool < m:
            # a few more than needed, back in id order, so that a stable sort settles ties by id
            near = np.sort(np.argpartition(d, pool - 1, axis=1)[:, :pool], axis=1)
            some = np.take_along_axis(d, near, axis=1)
            order = np.argsort(some, axis=1, kind="stable")
            best = np.take_along_axis(near, order[:, :take], axis=1)
            value = np.take_along_axis(some, order, axis=1)
            # a tie that runs past the pool needs the whole row
            tied = value[:, take - 1] == value[:, -1]
            if tied.any():
                best[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :take]
        else:
            best = np.argsort(d, axis=1, kind="stable")[:, :take]
        picks[part], gaps[part] = best, np.take_along_axis(d, best, axis=1)
    return picks, gaps


def rows_at_once(m: int) -> int:
    """Points compared at a time, so that a block of distances stays small."""
    return max(1, 2_000_000 // max(m, 1))


def resample_nearest(points: DataFrame, cells: DataFrame, values: list[str], id_col: str = "pid") -> DataFrame:
    """Values of the nearest cell, taken where the cells are."""
    wanted = cells.groupBy("snapshot_id").agg(F.lit(1).cast("long").alias("_wanted"))
    kind = T.ArrayType(T.StructType([T.StructField("cell_id", T.LongType()), *[T.StructField(v, cells.schema[v].dataType) for v in values]]))
    near = _around(points, cells, wanted, 1, id_col, values, kind, _taken).select("snapshot_id", id_col, F.get("_near", F.lit(0)).alias("_n"))
    return near.where(F.col("_n").isNotNull()).select("snapshot_id", F.col("_n")["cell_id"].alias("cell_id"), id_col, *[F.col("_n")[v].alias(v) for v in values])


def _taken(block: pa.Table, at, xyz, picks, gaps, size, values) -> pa.Array:
    """Ids and values, nearest first."""
    chosen = pa.array(picks[np.arange(picks.shape[1]) < size[:, None]])
    columns = [block.column(c).combine_chunks().take(chosen) for c in ("cell_id", *values)]
    structs = pa.StructArray.from_arrays(columns, names=["cell_id", *values])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), structs)


_MOMENTS = ["n00", "n01", "n02", "n03", "n11", "n12", "n13", "n22", "n23", "n33"]


def _effective(cells: DataFrame, k: int, reference: int = REFERENCE_CELLS) -> DataFrame:
    """How many neighbours each snapshot's number of cells calls for (see effective_neighbours)."""
    n = F.count(F.lit(1))
    wanted = F.greatest(F.lit(k), F.least(F.bround(n * (k / reference)).cast("long"), n))
    return materialise(cells.groupBy("snapshot_id").agg(wanted.cast("long").alias("_wanted")), "neighbours")


def mls_normal(points: DataFrame, cells: DataFrame, values: list[str], k: int, id_col: str = "pid", reference: int = REFERENCE_CELLS) -> DataFrame:
    """Weighted normal-equation sums of a linear fit around each point (10 shared, 4 per variable)."""
    wanted = _effective(cells, k, reference)
    widest = int(wanted.agg(F.max("_wanted")).first()[0] or k)
    sums = _around(points, cells, wanted, widest, id_col, values, T.ArrayType(T.DoubleType()), _moments)
    names = [*_MOMENTS, *(f"{v}_{i}" for v in values for i in range(4))]
    return sums.select("snapshot_id", id_col, *[F.element_at("_near", i + 1).alias(c) for i, c in enumerate(names)])


def mls_solve(sums: DataFrame, values: list[str], id_col: str = "pid", ridge: float = RIDGE) -> DataFrame:
    """Solve the 4x4 systems in Arrow batches; the fitted value is the constant term."""
    schema = T.StructType(
        [sums.schema["snapshot_id"], sums.schema[id_col]] + [T.StructField(v, T.DoubleType()) for v in values]
    )

    def solve(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            matrix = np.empty((n, 4, 4))
            for name in _MOMENTS:
                i, j = int(name[1]), int(name[2])
                matrix[:, i, j] = matrix[:, j, i] = get(name)
            d = np.arange(4)
            matrix[:, d, d] += ridge * matrix[:, d, d].max(axis=1, keepdims=True)
            rhs = np.stack([np.stack([get(f"{v}_{i}") for i in range(4)], axis=1) for v in values], axis=2)
            fit = np.linalg.solve(matrix, rhs)[:, 0, :] if n else np.empty((0, len(values)))
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("snapshot_id", id_col)]
            yield pa.RecordBatch.from_arrays(
                keys + [pa.array(fit[:, i]) for i in range(len(values))], names=["snapshot_id", id_col, *values]
            )

    return sums.mapInArrow(solve, schema)


def mls_fit(points: DataFrame, cells: DataFrame, values: list[str], k: int = 30, id_col: str = "pid") -> DataFrame:
    """Degree-1 moving least squares with Gaussian weights over the k nearest cells."""
    return mls_solve(mls_normal(points, cells, values, k, id_col), values, id_col)


@dataclass(frozen=True)
class StructuredBlock:
    """A structured variable: its nodes (snapshot_id, i_r, i_t, i_p, values) and its axes.

    ``axes`` is a table (snapshot_id, axis, idx, value) with axis in r, t, p; values increase with idx.
    """

    nodes: DataFrame
    axes: DataFrame


def _intervals(axes: DataFrame, axis: str) -> DataFrame:
    """Consecutive axis values; the azimuth closes on itself."""
    w = Window.partitionBy("snapshot_id").orderBy("idx")
    whole = Window.partitionBy("snapshot_id")
    rows = axes.where(F.col("axis") == axis)
    cells = rows.select(
        "snapshot_id", F.col("idx").alias(f"i_{axis}0"), F.col("value").alias("_lo"),
        F.lead("idx").over(w).alias(f"i_{axis}1"), F.lead("value").over(w).alias("_hi"),
        F.min("value").over(whole).alias("_first"), F.min("idx").over(whole).alias("_start"),
    )
    if axis == "p":
        close = F.col("_hi").isNull()
        cells = cells.withColumns(
            {"_hi": F.when(close, F.col("_first") + TWO_PI).otherwise(F.col("_hi")),
             f"i_{axis}1": F.when(close, F.col("_start")).otherwise(F.col(f"i_{axis}1"))}
        )
    return cells.where(F.col("_hi").isNotNull()).drop("_first", "_start")


def resample_structured(
    points: DataFrame, block: StructuredBlock, values: list[str], row_id: list[str], at=("r", "theta", "phi"), clamp_ends=True
) -> DataFrame:
    """Trilinear values on native axes: r and theta held at the ends (or extended), azimuth periodic."""
    axes = None
    for axis in "rtp":
        cells = _intervals(block.axes, axis).groupBy("snapshot_id").agg(
            F.sort_array(F.collect_list(F.struct("_lo", "_hi", f"i_{axis}0", f"i_{axis}1"))).alias(f"_cells_{axis}")
        )
        axes = cells if axes is None else axes.join(large(cells), "snapshot_id")
    df = points.select("snapshot_id", *row_id, *[F.col(c).alias(f"_v{a}") for a, c in zip("rtp", at)])
    df = df.join(large(axes), "snapshot_id")
    for axis in "rtp":
        df = _bracket(df, axis, clamp_ends)
    corners = df
    for axis in "rt":
        share = F.col(f"_f{axis}")
        pick = F.array(
            F.struct(F.col(f"i_{axis}0").alias("i"), (1.0 - share).alias("w")),
            F.struct(F.col(f"i_{axis}1").alias("i"), share.alias("w")),
        )
        corners = corners.withColumn(f"_c{axis}", F.explode(pick))
    corners = corners.select(
        "snapshot_id", *row_id, *[F.col(f"_c{a}.i").alias(f"i_{a}") for a in "rt"],
        (F.col("_cr.w") * F.col("_ct.w")).alias("_w"), "i_p0", "i_p1", "_fp",
    )
    # both azimuths of a corner are read on its ring; a node that is missing counts for nothing
    joined = corners.join(large(rings(block.nodes, ["snapshot_id", "i_r", "i_t"], values)), ["snapshot_id", "i_r", "i_t"])
    sides = [(on_ring(F.col("i_p0")), 1.0 - F.col("_fp")), (on_ring(F.col("i_p1")), F.col("_fp"))]
    joined = joined.where(sides[0][0].isNotNull() | sides[1][0].isNotNull())
    out = []
    for v in values:
        low, high = (F.col("_w") * w * n[v] for n, w in sides)
        out.append(F.sum(F.coalesce(low + high, low, high)).alias(v))
    return joined.groupBy("snapshot_id", *row_id).agg(*out)


def _bracket(df: DataFrame, axis: str, clamp_ends: bool) -> DataFrame:
    """Interval and share of each position on one axis: the axis is one short sorted array per snapshot."""
    cells = F.col(f"_cells_{axis}")
    n = F.size(cells)
    value = F.col(f"_v{axis}")
    first, last = F.get(cells, F.lit(0))["_lo"], F.get(cells, n - 1)["_hi"]
    if axis == "p":
        value = first + F.pmod(value - first, F.lit(TWO_PI))
    elif clamp_ends:
        value = F.least(F.greatest(value, first), last)
    df = df.withColumn("_at", value)
    from heliospark.operators.lookup import _rank

    spot = _rank(F.transform(cells, lambda c: c["_lo"]), F.col("_at"), n)
    df = df.withColumn("_cell", F.get(cells, F.least(F.greatest(spot, F.lit(1)), n) - 1))
    cell = F.col("_cell")
    return df.select(
        *[c for c in df.columns if c not in (f"_cells_{axis}", "_at", "_cell")],
        cell[f"i_{axis}0"].alias(f"i_{axis}0"), cell[f"i_{axis}1"].alias(f"i_{axis}1"),
        ((F.col("_at") - cell["_lo"]) / (cell["_hi"] - cell["_lo"])).alias(f"_f{axis}"),
    )
