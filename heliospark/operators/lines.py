"""Field lines as a partitioned table job: one row per half line."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions import fields as fx
from heliospark.functions.geometry import cart_to_sph, cross, dot, in_shell, norm
from heliospark.functions.grid import GridSpec
from heliospark.operators import stepper
from heliospark.operators.blocks import BlockField
from heliospark.operators.ranks import quantiles
from heliospark.operators.stencil import pad_radial
from heliospark.operators.stepper import INNER, OUTER, Lanes, TraceOptions
from heliospark.operators.tiles import Tiling, block_of, node_rows, sample_tiles, tile_join
from heliospark.session import large, materialise, task_count

#: Half lines handled by one task.
LINES_PER_TASK = 20_000
#: The largest row sum of stage weights is below this many steps; a stage reads this many cells beyond itself.
STAGE_REACH, STENCIL = 25, 5


@dataclass(frozen=True)
class GridField:
    """A magnetic field on grid nodes: columns snapshot_id, i_r, i_t, i_p, b_x, b_y, b_z."""

    nodes: DataFrame
    spec: GridSpec
    tiling: Tiling | None = None

    @property
    def inner(self) -> float:
        return self.spec.inner

    @property
    def outer(self) -> float:
        return self.spec.outer

    def frontier_tiling(self, cfl: float) -> Tiling:
        """Tiles whose halo is wider than any stage of a step of ``cfl`` cells can reach."""
        return self.tiling or Tiling(self.spec, halo=math.ceil(STAGE_REACH * cfl) + STENCIL)


def attach_b(points: DataFrame, field, row_id: list[str], names=("b_x", "b_y", "b_z"), at=("x", "y", "z")):
    """Append the field at a position: closed form, or read from the grid."""
    if isinstance(field, GridField):
        return sample_tiles(points, field.nodes, field.spec, ["b_x", "b_y", "b_z"], row_id, list(names), at=at)
    b = field.b(*(F.col(c) for c in at))
    return points.select("*", *[c.alias(n) for c, n in zip(b, names)])


def reference_strength(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    """Largest field magnitude of each snapshot's grid, radial ghost layers included."""
    padded = pad_radial(nodes, spec, ["b_x", "b_y", "b_z"])
    size = norm(F.col("b_x"), F.col("b_y"), F.col("b_z"))
    return padded.groupBy("snapshot_id").agg(F.max(size).alias("b_max"))


_STATE = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("line_id", T.LongType()),
        T.StructField("direction", T.DoubleType()),
        T.StructField("weak", T.DoubleType()),
        T.StructField("state", T.ArrayType(T.DoubleType())),
        T.StructField("slope", T.ArrayType(T.DoubleType())),
        T.StructField("step", T.DoubleType()),
        T.StructField("err", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("arc", T.DoubleType()),
        T.StructField("reversals", T.LongType()),
        T.StructField("turns", T.LongType()),
        T.StructField("tries", T.LongType()),
        T.StructField("code", T.LongType()),
        T.StructField("path", T.ArrayType(T.DoubleType())),
    ]
)


def half_lines(seeds: DataFrame, deviations: bool, weak: Column, store_path: bool) -> DataFrame:
    """Two rows per seed, one against and one along the field, ready to march."""
    names = ["x", "y", "z"] + (["u_x", "u_y", "u_z", "w_x", "w_y", "w_z"] if deviations else [])
    state = F.array(*[F.col(c).cast("double") for c in names])
    nan = F.lit(float("nan"))
    return seeds.select(
        F.col("snapshot_id").cast("long"),
        F.col("line_id").cast("long"),
        F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("direction"),
        weak.cast("double").alias("weak"),
        state.alias("state"),
        F.transform(state, lambda _: nan).alias("slope"),
        nan.alias("step"),
        F.lit(stepper.ERROR_FLOOR).alias("err"),
        F.lit(False).alias("rejected"),
        F.lit(0.0).alias("arc"),
        *[F.lit(0).cast("long").alias(c) for c in ("reversals", "turns", "tries")],
        F.lit(stepper.ACTIVE).cast("long").alias("code"),
        (F.array(*[F.col(c).cast("double") for c in "xyz"]) if store_path else F.lit(None)).cast(
            "array<double>"
        ).alias("path"),
    )


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if n else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1).copy()


def _read_lanes(rows: pa.Table) -> Lanes:
    n = rows.num_rows
    get = lambda c: rows.column(c).to_numpy(zero_copy_only=False).copy()
    lanes = Lanes(
        _matrix(rows.column("state"), n),
        _matrix(rows.column("slope"), n),
        get("direction"),
        get("weak"),
        **{c: get(c) for c in Lanes.FIELDS},
    )
    lanes.trail = [] if n and rows.column("path").null_count < n else None
    return lanes


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _write_lanes(rows: pa.Table, lanes: Lanes) -> pa.Table:
    columns = {c: rows.column(c) for c in ("snapshot_id", "line_id", "direction", "weak", "path")}
    columns["state"], columns["slope"] = _lists(lanes.y), _lists(lanes.slope)
    for c in Lanes.FIELDS:
        columns[c] = pa.array(getattr(lanes, c))
    if lanes.trail:
        who = np.concatenate([w for w, _ in lanes.trail])
        where = np.concatenate([p for _, p in lanes.trail])[np.argsort(who, kind="stable")]
        ends = np.cumsum(np.bincount(who, minlength=rows.num_rows))
        before = rows.column("path").combine_chunks()
        sizes = np.diff(before.offsets.to_numpy())
        starts = np.concatenate(([0], np.cumsum(sizes + 3 * np.diff(np.append(0, ends)))))
        flat = np.empty(starts[-1])
        old = np.repeat(starts[:-1] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        flat[old] = before.flatten().to_numpy(zero_copy_only=False)
        added = 3 * np.diff(np.append(0, ends))
        new = np.repeat(starts[:-1] + sizes - np.append(0, np.cumsum(added)[:-1]), added) + np.arange(added.sum())
        flat[new] = where.ravel()
        columns["path"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat))
    return pa.Table.from_arrays([columns[f.name] for f in _STATE.fields], names=_STATE.names)


class _ClosedForm:
    """A closed-form field as the stepper reads it."""

    def __init__(self, field) -> None:
        self.field = field

    def step_ceiling(self, p):
        return np.full(len(p), self.field.characteristic_length())

    def b(self, p):
        return np.stack(self.field.b(p[:, 0], p[:, 1], p[:, 2], np), axis=1)

    def b_and_jacobian(self, p):
        rows = self.field.jacobian(p[:, 0], p[:, 1], p[:, 2], np)
        return self.b(p), np.stack([np.stack(row, axis=1) for row in rows], axis=1)


def run_half_lines(half: DataFrame, field, opt: TraceOptions) -> DataFrame:
    """March every half line to its end."""
    inner, outer = field.inner, field.outer
    if not isinstance(field, GridField):

        def closed(batches):
            reader = _ClosedForm(field)
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                lanes = _read_lanes(rows)
                stepper.march(reader, lanes, opt, inner, outer)
                yield from _write_lanes(rows, lanes).to_batches()

        spread = half.repartition(task_count(half.sparkSession), "snapshot_id", "line_id", "direction")
        return spread.mapInArrow(closed, _STATE)
    return _frontier(half, field, field.frontier_tiling(opt.cfl), opt)


def _b_rows(field: GridField) -> DataFrame:
    return node_rows(field.nodes, ["b_x", "b_y", "b_z"])


def _superstep(half, tiling: Tiling, tile_nodes: DataFrame, spec: GridSpec, opt: TraceOptions) -> DataFrame:
    """Move each active half line as far as its tile reaches."""
    position = [F.element_at("state", k) for k in (1, 2, 3)]
    fr, ft, _ = spec.index_of(*cart_to_sph(*position))
    keyed = half.withColumn("tile", tiling.tile_of(fr, ft))

    def advance(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        lanes = _read_lanes(rows)
        if rows.num_rows:
            before = lanes.tries.copy()
            block = block_of(tiling, spec, nodes, rows.column("tile")[0].as_py(), 3)
            stepper.march(BlockField(block), lanes, opt, spec.inner, spec.outer)
            if np.any((lanes.code == stepper.ACTIVE) & (lanes.tries == before)):
                raise ValueError("a line cannot move inside its tile: raise the tile halo")
        return _write_lanes(rows, lanes)

    return tile_join(keyed, tile_nodes, ["line_id", "direction"], advance, _STATE, LINES_PER_TASK, tasks=task_count(half.sparkSession))


def _frontier(half: DataFrame, field: GridField, tiling: Tiling, opt: TraceOptions) -> DataFrame:
    """Supersteps over tiles; each is written to the shared folder, so a lost executor repeats one only."""
    tile_nodes = materialise(tiling.spread(_b_rows(field)), "field-tiles")
    done, moving = [], half
    while True:
        table = materialise(_superstep(moving, tiling, tile_nodes, field.spec, opt), "frontier")
        done.append(table.where(F.col("code") != stepper.ACTIVE))
        moving = table.where(F.col("code") == stepper.ACTIVE)
        if moving.isEmpty():
            break
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def fold_halves(half: DataFrame, deviations: bool = False) -> DataFrame:
    """Join both half rows of a line: feet (NULL unless landed), end codes, lengths."""
    landed = F.col("code").isin(INNER, OUTER)
    out = []
    for tag, sign in (("b", -1.0), ("f", 1.0)):
        mine = F.col("direction") == sign
        out.append(F.max(F.when(mine, F.col("code"))).alias(f"end_{tag}"))
        out.append(F.max(F.when(mine, F.col("arc"))).alias(f"len_{tag}"))
        names = [f"foot_{tag}_{c}" for c in "xyz"]
        if deviations:
            names += [f"{d}_{tag}_{c}" for d in "uw" for c in "xyz"]
        for k, name in enumerate(names, start=1):
            out.append(F.max(F.when(mine & landed, F.element_at("state", k))).alias(name))
    return half.groupBy("snapshot_id", "line_id").agg(*out)


def classify(end_b: Column, end_f: Column) -> dict[str, Column]:
    """Topology flags from the two end codes."""
    lands = end_b.isin(INNER, OUTER) & end_f.isin(INNER, OUTER)
    either = lambda code: (end_b == code) | (end_f == code)
    return {
        "is_complete": lands,
        "is_closed": (end_b == INNER) & (end_f == INNER),
        "is_open": lands & either(OUTER),
        "is_incomplete": ~lands,
        "is_null": either(stepper.NULL),
        "is_stalled": either(stepper.STALLED),
        "is_deflected": either(stepper.DEFLECTED),
    }


def line_summary(lines: DataFrame, keys=("snapshot_id",)) -> DataFrame:
    """How many lines ended in which way."""
    flag = classify(F.col("end_b"), F.col("end_f"))
    budget = flag["is_incomplete"] & ~flag["is_null"] & ~flag["is_stalled"] & ~flag["is_deflected"]
    return lines.groupBy(*keys).agg(
        *[F.count_if(flag[f"is_{n}"]).alias(n) for n in ("closed", "open", "null", "stalled", "deflected")],
        F.count_if(budget).alias("max_steps"),
    )


def check_seeds(seeds: DataFrame, inner: float, outer: float) -> DataFrame:
    """Fail the job on a seed outside the shell (checked as rows stream by, no extra pass)."""
    r = norm(F.col("x"), F.col("y"), F.col("z"))
    guard = F.when(in_shell(r, inner, outer), F.col("x")).otherwise(
        F.raise_error(F.lit(f"a seed lies outside the shell [{inner}, {outer}]"))
    )
    return seeds.withColumn("x", guard.cast("double"))


def _weak_limit(seeds: DataFrame, field, opt: TraceOptions) -> tuple[DataFrame, Column]:
    if not isinstance(field, GridField) or opt.turn_angle <= 0:
        return seeds, F.lit(0.0)
    strength = reference_strength(field.nodes, field.spec)
    return (
        seeds.join(strength, "snapshot_id", "left"),
        F.coalesce(F.col("b_max") * opt.weak_fraction, F.lit(0.0)),
    )


def trace_halves(seeds: DataFrame, field, opt: TraceOptions | None = None, store_path=False, deviations=False):
    opt = opt or TraceOptions()
    limited, weak = _weak_limit(check_seeds(seeds, field.inner, field.outer), field, opt)
    return run_half_lines(half_lines(limited, deviations, weak, store_path), field, opt)


def trace_lines(seeds: DataFrame, field, opt: TraceOptions | None = None) -> DataFrame:
    """Seeds (snapshot_id, line_id, x, y, z) to feet, end codes and arc lengths."""
    return fold_halves(trace_halves(seeds, field, opt))


def join_paths(half: DataFrame) -> DataFrame:
    """Polylines in long form: reversed backward half, then the forward half without its first vertex."""
    n = (F.size("path") / 3).cast("long")
    vertex = F.sequence(F.lit(0).cast("long"), n - 1)
    rows = half.select("snapshot_id", "line_id", "direction", "path", F.explode(vertex).alias("_k"))
    rows = rows.where((F.col("direction") < 0) | (F.col("_k") > 0))
    order = F.col("direction") * F.col("_k")
    at = [F.element_at("path", (F.col("_k") * 3 + c + 1).cast("int")).alias(n) for c, n in enumerate("xyz")]
    w = Window.partitionBy("snapshot_id", "line_id").orderBy("_order")
    return rows.select("snapshot_id", "line_id", order.alias("_order"), *at).select(
        "snapshot_id", "line_id", F.row_number().over(w).cast("long").alias("seq"), "x", "y", "z"
    )


def transport_lines(seeds: DataFrame, field, opt: TraceOptions | None = None) -> DataFrame:
    """As ``trace_lines`` with two deviation vectors (u_*, w_*) carried to both feet."""
    return fold_halves(trace_halves(seeds, field, opt, deviations=True), deviations=True)


def vector(stem: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{stem}_{c}") for c in "xyz")


def with_vector(df: DataFrame, stem: str, parts) -> DataFrame:
    """Append a vector as three columns; steps built on it stay small expressions."""
    return df.withColumns({f"{stem}_{c}": e for c, e in zip("xyz", parts)})


def _unit(df: DataFrame, stem: str, source: str) -> DataFrame:
    df = df.withColumn("_size", norm(*vector(source)))
    return with_vector(df, stem, [F.try_divide(c, F.col("_size")) for c in vector(source)]).drop("_size")


def with_seed_basis(seeds: DataFrame) -> DataFrame:
    """Two unit vectors normal to B (columns b_*): u_* and w_*."""
    df = with_vector(_unit(seeds, "_h", "b"), "_n", fx.least_aligned(vector("_h")))
    df = _unit(df, "u", "_n")
    df = with_vector(df, "w", cross(vector("_h"), vector("u")))
    return df.drop(*[f"{s}_{c}" for s in ("_h", "_n") for c in "xyz"])


def with_unit_gradient(df: DataFrame) -> DataFrame:
    """Gradient g_ij of the unit field from b_* and its Jacobian j_ij."""
    df = _unit(df, "_h", "b").withColumn("_m", norm(*vector("b")))
    jac = [[F.col(f"j_{i}{j}") for j in range(3)] for i in range(3)]
    grad = fx.unit_gradient(vector("_h"), F.col("_m"), jac)
    return df.withColumns({f"g_{i}{j}": grad[i][j] for i in range(3) for j in range(3)}).drop("_h_x", "_h_y", "_h_z", "_m")


def attach_foot_b(lines: DataFrame, field) -> DataFrame:
    """B at both feet as b_b_* and b_f_*, NULL where a foot is missing."""
    if not isinstance(field, GridField):
        for tag in "bf":
            lines = with_vector(lines, f"b_{tag}", field.b(*vector(f"foot_{tag}")))
        return lines
    # both feet go through one tile join
    sides = [
        F.struct(F.lit(tag).alias("side"), *[F.col(f"foot_{tag}_{c}").alias(c) for c in "xyz"]) for tag in "bf"
    ]
    keys = ["snapshot_id", "line_id"]
    feet = lines.select(*keys, F.explode(F.array(*sides)).alias("_f")).select(*keys, "_f.*").where(F.col("x").isNotNull())
    read = attach_b(feet, field, ["line_id", "side"])
    pick = lambda tag, c: F.max(F.when(F.col("side") == tag, F.col(f"b_{c}"))).alias(f"b_{tag}_{c}")
    return lines.join(large(read.groupBy(*keys).agg(*[pick(t, c) for t in "bf" for c in "xyz"])), keys, "left")


def settled(df: DataFrame, field, label: str) -> DataFrame:
    """A tile join reads its points twice (to count, then to read), so what feeds one is written once."""
    return materialise(df, label) if isinstance(field, GridField) else df


def assemble(lines: DataFrame) -> DataFrame:
    """Append q_perp and q from feet, B at the feet, carried deviations and b0; NULL where a foot is missing.

    The perpendicular factor slides deviations onto planes normal to B, the classical one onto the spheres.
    """
    kept = lines.columns
    df = _unit(_unit(lines, "_r_b", "foot_b"), "_r_f", "foot_f")
    for kind, stems in (("p", ("b_b", "b_f")), ("r", ("_r_b", "_r_f"))):
        for side, stem in zip("bf", stems):
            for d in "uw":
                slid = fx.reproject(vector(f"{d}_{side}"), vector(f"b_{side}"), vector(stem))
                df = with_vector(df, f"_{kind}{d}{side}", slid)
    prefactor = {
        "p": norm(*vector("b_f")) * norm(*vector("b_b")),
        "r": F.abs(dot(vector("b_f"), vector("_r_f")) * dot(vector("b_b"), vector("_r_b"))),
    }
    complete = classify(F.col("end_b"), F.col("end_f"))["is_complete"]
    out = []
    for kind, name in (("p", "q_perp"), ("r", "q")):
        parts = [vector(f"_{kind}{d}{side}") for side in "fb" for d in "uw"]
        value = fx.master_formula(*parts, prefactor[kind], F.col("b0") * F.col("b0"))
        out.append(F.when(complete, fx.null_if_nan(value)).alias(name))
    return df.select(*kept, *out)


def squash(seeds: DataFrame, field, opt: TraceOptions | None = None) -> DataFrame:
    """Squashing factors and line geometry of every seed."""
    based = settled(with_seed_basis(attach_b(seeds, field, ["line_id"])), field, "seed-basis")
    b0 = norm(F.col("b_x"), F.col("b_y"), F.col("b_z")).alias("b0")
    lines = transport_lines(based, field, opt).join(
        large(based.select("snapshot_id", "line_id", b0)), ["snapshot_id", "line_id"]
    )
    return assemble(attach_foot_b(settled(lines, field, "transported"), field))


def squash_summary(result: DataFrame) -> DataFrame:
    """Valid share, median and log range per snapshot."""
    complete = classify(F.col("end_b"), F.col("end_f"))["is_complete"]
    log_q = fx.safe_log10(F.col("q_perp"))
    result = materialise(result, "squashed")
    middle = quantiles(result, {"_q": F.when(complete, F.col("q_perp"))}, [0.5]).select("snapshot_id", F.get("_q", F.lit(0)).alias("median_q"))
    rest = result.groupBy("snapshot_id").agg(
        F.count_if(complete).alias("n_valid"),
        F.count(F.lit(1)).alias("n_total"),
        F.min(log_q).alias("min_log_q"),
        F.max(log_q).alias("max_log_q"),
    )
    return rest.join(middle, "snapshot_id")
