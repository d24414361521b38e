"""Spreading the squashing factor of lines into a voxel volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.functions.fields import safe_log10
from heliospark.functions.geometry import cart_to_sph, clip_radius, norm
from heliospark.functions.grid import GridSpec, voxel_bin
from heliospark.functions.imaging import LOG_FLOOR
from heliospark.operators import generators as gen
from heliospark.operators import lines as ln
from heliospark.operators.stencil import boundary_lookup
from heliospark.operators.stepper import INNER, OUTER, TraceOptions
from heliospark.session import large, materialise

LINE = ["snapshot_id", "line_id"]


# line values

def combine_feet(log_b: Column, log_f: Column) -> Column:
    """log10 of the linear mean of both feet."""
    return safe_log10(0.5 * (F.pow(F.lit(10.0), log_b) + F.pow(F.lit(10.0), log_f)))


def line_polarity(end_b: Column, end_f: Column, radial_b: Column, radial_f: Column, closed="neutral") -> Column:
    """Sign of the radial field at the inner feet (``radial_*`` is B . r there); 0 without an inner foot.

    A closed loop is neutral where its two signs cancel, or takes the stronger foot (``dominant``).
    """
    if closed not in ("neutral", "dominant"):
        raise ValueError(f"closed is 'neutral' or 'dominant', not {closed!r}")
    b = F.when(end_b == INNER, F.coalesce(radial_b, F.lit(0.0)))
    f = F.when(end_f == INNER, F.coalesce(radial_f, F.lit(0.0)))
    if closed == "neutral":
        nil = F.lit(0.0)
        return F.signum(F.coalesce(F.signum(b), nil) + F.coalesce(F.signum(f), nil)).cast("long")
    stronger = F.when(F.coalesce(F.abs(b), F.lit(-1.0)) >= F.coalesce(F.abs(f), F.lit(-1.0)), b).otherwise(f)
    return F.coalesce(F.signum(stronger), F.lit(0.0)).cast("long")


def boundary_map(snapshots: DataFrame, field, sphere: int, n_theta: int, n_phi: int, opt: TraceOptions | None = None):
    """log10 Q of seeds on one sphere: sphere 0 is the inner one, 1 the outer one."""
    radius = (field.inner, field.outer)[sphere]
    seeds = gen.sphere_seeds(snapshots, radius, n_theta, n_phi, field.inner, field.outer)
    result = ln.squash(seeds.withColumnRenamed("seed_id", "line_id"), field, opt)
    return result.select(
        "snapshot_id",
        F.lit(sphere).cast("long").alias("sphere"),
        F.floor(F.col("line_id") / n_phi).cast("long").alias("i_t"),
        (F.col("line_id") % n_phi).alias("i_p"),
        safe_log10(F.col("q_perp")).alias("log_q"),
    )


def boundary_maps(snapshots: DataFrame, field, n_theta: int, n_phi: int, opt: TraceOptions | None = None) -> DataFrame:
    """Both spheres in one trace job."""
    both = _both_spheres(snapshots, field, n_theta, n_phi)
    result = ln.squash(both, field, opt)
    per_sphere = n_theta * n_phi
    cell = F.col("line_id") % per_sphere
    return result.select(
        "snapshot_id",
        F.floor(F.col("line_id") / per_sphere).cast("long").alias("sphere"),
        F.floor(cell / n_phi).cast("long").alias("i_t"),
        (cell % n_phi).alias("i_p"),
        safe_log10(F.col("q_perp")).alias("log_q"),
    )


def _both_spheres(snapshots, field, n_theta, n_phi) -> DataFrame:
    parts = [
        gen.sphere_seeds(snapshots, radius, n_theta, n_phi, field.inner, field.outer).withColumn(
            "line_id", F.col("seed_id") + k * n_theta * n_phi
        )
        for k, radius in enumerate((field.inner, field.outer))
    ]
    return parts[0].unionByName(parts[1]).select(*LINE, "x", "y", "z")


def feet_rows(lines: DataFrame) -> DataFrame:
    """One row per foot: sphere it lies on (NULL for none) and its angles."""
    def foot(tag, side):
        _, theta, phi = cart_to_sph(*(F.col(f"foot_{tag}_{c}") for c in "xyz"))
        end = F.col(f"end_{tag}")
        return F.struct(
            F.lit(side).cast("long").alias("side"),
            F.when(end.isin(INNER, OUTER), end).alias("sphere"),
            theta.alias("theta"),
            phi.alias("phi"),
        )

    return lines.select(*LINE, F.explode(F.array(foot("b", 0), foot("f", 1))).alias("_f")).select(*LINE, "_f.*")


def line_values(lines: DataFrame, maps: DataFrame, n_theta: int, n_phi: int, field, closed="neutral") -> DataFrame:
    """log Q and polarity of each traced line, read from the boundary maps at its feet."""
    feet = boundary_lookup(feet_rows(lines), maps, n_theta, n_phi, ["line_id", "side"])
    per_line = feet.groupBy(*LINE).agg(
        F.max(F.when(F.col("side") == 0, F.col("log_q"))).alias("_b"),
        F.max(F.when(F.col("side") == 1, F.col("log_q"))).alias("_f"),
    )
    clipped = lines
    for tag in "bf":
        at = clip_radius(*(F.col(f"foot_{tag}_{c}") for c in "xyz"), field.inner, field.outer)
        clipped = clipped.withColumns({f"foot_{tag}_{n}": c for n, c in zip("xyz", at)})
    based = ln.attach_foot_b(clipped, field)
    radial = [
        sum(F.col(f"b_{tag}_{c}") * F.col(f"foot_{tag}_{c}") for c in "xyz") for tag in "bf"
    ]
    sign = line_polarity(F.col("end_b"), F.col("end_f"), *radial, closed=closed)
    return (
        based.select(*LINE, sign.alias("polarity"))
        .join(large(per_line), LINE)
        .select(*LINE, combine_feet(F.col("_b"), F.col("_f")).alias("log_q"), "polarity")
    )


# painting

def path_arclength(paths: DataFrame) -> DataFrame:
    """Append the cumulative arc length along each polyline."""
    w = Window.partitionBy(*LINE).orderBy("seq")
    leg = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"))
    return paths.withColumn("_leg", F.coalesce(leg, F.lit(0.0))).select(
        *paths.columns, F.sum("_leg").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")
    )


def path_resample(paths: DataFrame, spec: GridSpec, paint_step: float = 0.5) -> DataFrame:
    """Points at an even pitch of arc length; the pitch is paint_step times the smallest cell on the path.

    Every segment emits the samples that fall on it, so a line is never gathered in one row.
    """
    w = Window.partitionBy(*LINE).orderBy("seq")
    whole = Window.partitionBy(*LINE)
    r, theta, _ = cart_to_sph(F.col("x"), F.col("y"), F.col("z"))
    df = (
        path_arclength(paths)
        .withColumn("_cell", spec.cell_extent(r, theta))
        .select(
            *LINE, "seq", "x", "y", "z", "s",
            *[F.lead(c).over(w).alias(f"_{c}") for c in ("x", "y", "z", "s")],
            F.max("s").over(whole).alias("_total"),
            F.min("_cell").over(whole).alias("_small"),
        )
    )
    pitch = paint_step * F.col("_small")
    # number of gaps between samples; a line of no length keeps its first vertex only
    gaps = F.when(F.col("_total") > 0, F.floor(F.col("_total") / pitch)).otherwise(0)
    df = df.withColumn("_n", gaps.cast("long"))
    # a single sample sits at s = 0; otherwise sample k sits at total * k / n
    spacing = F.when(F.col("_n") > 0, F.col("_total") / F.col("_n"))
    at_end = F.col("_s") >= F.col("_total")
    first = F.ceil(F.col("s") / spacing)
    last = F.when(at_end, F.col("_n")).otherwise(F.ceil(F.col("_s") / spacing) - 1)
    ks = (
        F.when((F.col("_n") == 0) & (F.col("seq") == F.min("seq").over(whole)), F.array(F.lit(0).cast("long")))
        .when((F.col("_n") > 0) & (F.col("_s") > F.col("s")) & (last >= first), F.sequence(first, last))
    )
    rows = df.withColumn("_ks", ks).where(F.col("_ks").isNotNull()).withColumn("k", F.explode("_ks"))
    share = F.when(F.col("_n") > 0, (F.col("k") * spacing - F.col("s")) / (F.col("_s") - F.col("s")))
    share = F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.select(
        *LINE,
        F.col("k").cast("long").alias("k"),
        *[(F.col(c) + share * (F.coalesce(F.col(f"_{c}"), F.col(c)) - F.col(c))).alias(c) for c in "xyz"],
    )


def path_voxels(samples: DataFrame, spec: GridSpec, nearest: bool = False) -> DataFrame:
    """Voxel ids along each line, consecutive repeats dropped (a re-entry counts again)."""
    w = Window.partitionBy(*LINE).orderBy("k")
    binned = samples.select(*LINE, "k", voxel_bin(spec, F.col("x"), F.col("y"), F.col("z"), nearest).alias("voxel"))
    return (
        binned.withColumn("_before", F.lag("voxel").over(w))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("voxel")))
        .drop("_before")
    )


def paint_accumulate(voxels: DataFrame, values: DataFrame) -> DataFrame:
    """Per voxel: sum of Q, count of line passages, sum of sign times Q. Lines without a value are skipped."""
    q = F.pow(F.lit(10.0), F.col("log_q"))
    usable = values.where(F.col("log_q").isNotNull()).select(
        *LINE, q.alias("_q"), (F.col("polarity") * q).alias("_pq")
    )
    return (
        voxels.join(large(usable), LINE)
        .groupBy("snapshot_id", "voxel")
        .agg(F.sum("_q").alias("sum_q"), F.count(F.lit(1)).alias("n_lines"), F.sum("_pq").alias("sum_pol"))
    )


def paint_finalize(sums: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every node with its log mean Q and polarity; NULL and 0 where nothing was painted."""
    keyed = nodes.withColumnRenamed("node_id", "voxel")
    sign = F.coalesce(F.signum("sum_pol"), F.lit(0.0)).cast("long")
    return keyed.join(large(sums), ["snapshot_id", "voxel"], "left").select(
        *keyed.columns, safe_log10(F.col("sum_q") / F.col("n_lines")).alias("log_q"), sign.alias("polarity")
    )


def volume_pack(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flat (node_id, log_q, polarity) rows to a full keyed volume."""
    return nodes.select("snapshot_id", "node_id", "i_r", "i_t", "i_p").join(
        large(values), ["snapshot_id", "node_id"], "left"
    )


# builders

def _clipped_nodes(snapshots, spec) -> DataFrame:
    nodes = gen.grid_nodes(snapshots, spec)
    at = clip_radius(F.col("x"), F.col("y"), F.col("z"), spec.inner, spec.outer)
    return nodes.withColumns(dict(zip("xyz", at))).withColumn("line_id", F.col("node_id"))


def volume_reference(snapshots: DataFrame, field, spec: GridSpec, opt: TraceOptions | None = None) -> DataFrame:
    """Q of the line through every node."""
    nodes = _clipped_nodes(snapshots, spec)
    result = ln.squash(nodes.select(*LINE, "x", "y", "z"), field, opt)
    value = result.select("snapshot_id", F.col("line_id").alias("node_id"), safe_log10(F.col("q_perp")).alias("log_q"))
    return volume_pack(value, nodes)


def angular_resolution(field, spec: GridSpec, supersample: int) -> tuple[int, int]:
    native = field.spec if isinstance(field, ln.GridField) else spec
    return supersample * native.n_theta, supersample * native.n_phi


def volume_per_voxel(
    snapshots: DataFrame, field, spec: GridSpec, supersample=4, closed="neutral", opt: TraceOptions | None = None
) -> DataFrame:
    """Trace every node, read both feet from the boundary maps and combine."""
    size = angular_resolution(field, spec, supersample)
    maps = materialise(boundary_maps(snapshots, field, *size, opt), "boundary-maps")
    nodes = _clipped_nodes(snapshots, spec)
    lines = materialise(ln.trace_lines(nodes.select(*LINE, "x", "y", "z"), field, opt), "lines")
    value = line_values(lines, maps, *size, field, closed).withColumnRenamed("line_id", "node_id")
    return volume_pack(value, nodes)


def volume_paint(
    snapshots: DataFrame,
    field,
    spec: GridSpec,
    supersample: int = 4,
    paint_step: float = 0.5,
    closed: str = "neutral",
    opt: TraceOptions | None = None,
) -> DataFrame:
    """The default builder: cost follows the seeds on both spheres, not the voxels."""
    size = angular_resolution(field, spec, supersample)
    maps = materialise(boundary_maps(snapshots, field, *size, opt), "boundary-maps")
    seeds = _both_spheres(snapshots, field, *size)
    half = materialise(ln.trace_halves(seeds, field, opt, store_path=True), "half-lines")
    values = materialise(line_values(ln.fold_halves(half), maps, *size, field, closed), "line-values")
    # lines without a value paint nothing: they leave before their paths are cut up
    usable = half.join(large(values.where(F.col("log_q").isNotNull()).select(*LINE)), LINE, "left_semi")
    voxels = path_voxels(path_resample(ln.join_paths(usable), spec, paint_step), spec)
    nodes = gen.grid_nodes(snapshots, spec).select("snapshot_id", "node_id", "i_r", "i_t", "i_p")
    return paint_finalize(paint_accumulate(voxels, values), nodes).withColumnRenamed("voxel", "node_id")


# channels and measures

def radial_sign_grid(nodes: DataFrame) -> DataFrame:
    """Sign of B . r at every field node (needs node positions)."""
    radial = sum(F.col(f"b_{c}") * F.col(c) for c in "xyz")
    return nodes.select("snapshot_id", "i_r", "i_t", "i_p", F.signum(radial).cast("long").alias("sign"))


def coverage(volume: DataFrame) -> DataFrame:
    """Share of nodes with a value, and how many lie below the physical floor."""
    return volume.groupBy("snapshot_id").agg(
        F.avg(F.col("log_q").isNotNull().cast("double")).alias("covered_fraction"),
        F.count_if(F.col("log_q") < LOG_FLOOR).alias("sub_floor"),
    )


def radius_of(df: DataFrame) -> Column:
    return norm(F.col("x"), F.col("y"), F.col("z"))
