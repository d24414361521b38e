"""Line-of-sight sums and the image tables made from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions import imaging as im
from heliospark.functions import radiation as rad
from heliospark.functions.camera import Camera
from heliospark.functions.geometry import cart_to_sph, clamp
from heliospark.functions.grid import GridSpec
from heliospark.operators import generators as gen
from heliospark.operators.ranks import join_few, quantiles
from heliospark.operators.tiles import Tiling, as_numpy, block_of, node_rows, nullable, tile_join
from heliospark.session import large, materialise

PIXEL = ["snapshot_id", "pixel_id"]
CHANNELS = (0, 1, 2)
GLOW_OUTER = 1.15
DISK_STEP = 0.005


# relational form, from a table of samples

def los_clamp(log_q: Column, floor: bool = True, low=im.LOG_FLOOR, high=im.LOG_MAX) -> Column:
    return clamp(log_q, low if floor else None, high)


def clamp_counts(samples: DataFrame, low=im.LOG_FLOOR, high=im.LOG_MAX) -> DataFrame:
    """Breaches of both limits on the raw value; counted whether or not the floor is applied."""
    return samples.groupBy("snapshot_id").agg(
        F.count_if(F.col("log_q") < low).alias("n_low"),
        F.count_if(F.col("log_q") > high).alias("n_high"),
        F.count("log_q").alias("n_valid"),
    )


def los_sums(samples: DataFrame, preset: im.WeightPreset, floor=True, thomson: Column | None = None) -> DataFrame:
    """All per-pixel sums of a sample table (log_q, sign, s, r, on_path); partial sums merge exactly.

    ``thomson`` multiplies the averaging weights only; budgets stay geometric.
    """
    w = preset.weights(F.col("s"), F.col("r"))
    mean_w = (w[0] + w[1] + w[2]) / 3.0
    valid = F.col("on_path") & F.col("log_q").isNotNull()
    value = los_clamp(F.col("log_q"), floor)
    total = lambda ok, e: F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0))
    out = []
    for c in CHANNELS:
        a = w[c] if thomson is None else w[c] * thomson
        out += [
            total(valid, a * value).alias(f"num_{c}"),
            total(valid, a).alias(f"den_{c}"),
            total(F.col("on_path"), w[c]).alias(f"on_{c}"),
        ]
    out += [
        total(valid, mean_w).alias("ref_valid"),
        total(F.col("on_path"), mean_w).alias("ref_path"),
        total(valid, mean_w * F.col("sign")).alias("pol_num"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(valid & (F.col("log_q") < im.LOG_FLOOR)).alias("n_low"),
        F.count_if(valid & (F.col("log_q") > im.LOG_MAX)).alias("n_high"),
    ]
    return samples.groupBy(*PIXEL).agg(*out)


def los_columns(sums: DataFrame, keep=()) -> DataFrame:
    """Sums to signal, budgets, coverage and polarity per pixel."""
    out = [
        F.when(F.col(f"den_{c}") > 0, F.col(f"num_{c}") / F.col(f"den_{c}")).alias(f"signal_{c}") for c in CHANNELS
    ]
    out += [F.col(f"{k}_{c}") for k in ("den", "on") for c in CHANNELS]
    out += [
        F.when(F.col("ref_path") > 0, F.col("ref_valid") / F.col("ref_path")).otherwise(F.lit(0.0)).alias("coverage"),
        F.when(F.col("ref_valid") > 0, F.col("pol_num") / F.col("ref_valid")).alias("polarity"),
        F.col("n_valid"), F.col("n_low"), F.col("n_high"),
    ]
    return sums.select(*PIXEL, *keep, *out)


# scale path: runs of samples per tile, partial sums per tile

_RUN = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("snapshot_id", "pixel_id", "tile", "k0", "k1")]
    + [T.StructField(n, T.DoubleType()) for n in ("ox", "oy", "oz", "rho")]
)


def _runs(pixel_table: DataFrame, tiling: Tiling, look, outer: float, n: int) -> DataFrame:
    """(pixel, tile, first sample, last sample) rows: a ray crosses few tiles, so few rows stand for it."""
    spec = tiling.spec
    s = np.linspace(-outer, outer, n)

    def emit(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rays = max(1, 2_000_000 // n)
            for lo in range(0, table.num_rows, rays):
                yield from _runs_of(table.slice(lo, rays), spec, tiling, look, s)

    rows = pixel_table.select(*[F.col(c).cast("long") for c in PIXEL], "ox", "oy", "oz", "rho")
    return rows.mapInArrow(emit, _RUN)


def _runs_of(table: pa.Table, spec: GridSpec, tiling: Tiling, look, s):
    ox, oy, oz, rho = (as_numpy(table, c)[:, None] for c in ("ox", "oy", "oz", "rho"))
    r = np.sqrt(rho * rho + s * s)
    theta = np.arccos(np.clip(np.divide(oz + s * look[2], r, out=np.ones_like(r), where=r > 0), -1, 1))
    inside = (r >= spec.inner) & (r <= spec.outer)
    fr, ft, _ = spec.index_of(np.where(inside, r, spec.inner), theta, r * 0.0, np)
    tile = np.where(inside, tiling.tile_of(fr, ft, np), -1)
    edge = np.ones_like(tile, dtype=bool)
    edge[:, 1:] = tile[:, 1:] != tile[:, :-1]
    ray, first = np.nonzero(edge)
    last = np.append(first[1:] - 1, len(s) - 1)
    last[np.append(ray[1:] != ray[:-1], True)] = len(s) - 1
    keep = tile[ray, first] >= 0
    ray, first, last = ray[keep], first[keep], last[keep]
    taken = table.take(pa.array(ray))
    columns = {c: taken.column(c) for c in ("snapshot_id", "pixel_id", "ox", "oy", "oz", "rho")}
    columns |= {"tile": pa.array(tile[ray, first]), "k0": pa.array(first), "k1": pa.array(last)}
    yield from pa.Table.from_arrays([columns[n] for n in _RUN.names], names=_RUN.names).to_batches()


class _Samples:
    """The samples of one tile's runs, expanded inside the task."""

    def __init__(self, rows: pa.Table, look, outer: float, n: int) -> None:
        k0, k1 = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("k0", "k1"))
        size = k1 - k0 + 1
        self.run = np.repeat(np.arange(len(k0)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(k0, size)
        self.s = -outer + k * (2.0 * outer / (n - 1))
        self.rho = as_numpy(rows, "rho")[self.run]
        self.r = np.sqrt(self.rho**2 + self.s**2)
        x, y, z = (as_numpy(rows, f"o{c}")[self.run] + self.s * look[i] for i, c in enumerate("xyz"))
        _, self.theta, self.phi = cart_to_sph(x, y, z, np)

    def index(self, spec: GridSpec):
        fr, ft, fp = spec.index_of(self.r, self.theta, self.phi, np)
        return np.clip(fr, 0.0, spec.n_r - 1.0), ft, fp


_CHUNK_SAMPLES = 2_000_000


def _tile_sums(pixel_table, nodes, tiling: Tiling, camera: Camera, step: float, names: list[str], partial) -> DataFrame:
    """Per-pixel sums over all tiles a ray crosses; ``partial(samples, nodes, tile)`` gives one tile's terms."""
    spec = tiling.spec
    look, outer = camera.basis()[0], spec.outer
    n = gen.sample_count(outer, step)
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in PIXEL] + [T.StructField(c, T.DoubleType()) for c in names]
    )

    def evaluate(rows: pa.Table, tile_nodes: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows:
            terms_of = partial(tile_nodes, rows.column("tile")[0].as_py())
            size = rows.column("k1").to_numpy(zero_copy_only=False) - rows.column("k0").to_numpy(zero_copy_only=False) + 1
            chunk = np.cumsum(size) // _CHUNK_SAMPLES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), rows.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                part = rows.slice(lo, hi - lo)
                samples = _Samples(part, look, outer, n)
                sums = [np.bincount(samples.run, weights=t, minlength=hi - lo) for t in terms_of(samples)]
                parts.append(
                    pa.Table.from_arrays(
                        [part.column("snapshot_id"), part.column("pixel_id"), *map(nullable, sums)], names=PIXEL + names
                    )
                )
        return pa.concat_tables(parts) if parts else pa.Table.from_arrays(
            [pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * len(names), names=PIXEL + names
        )

    # the tile join reads its rays twice
    runs = materialise(_runs(pixel_table, tiling, look, outer, n), "ray-runs")
    sums = tile_join(runs, nodes, ["pixel_id", "k0"], evaluate, schema).groupBy(*PIXEL).agg(
        *[F.sum(c).alias(c) for c in names]
    )
    # rays that miss the shell keep a row of zeros
    return pixel_table.join(large(sums), PIXEL, "left").na.fill(0.0, names)


LOS_SUMS = [f"{k}_{c}" for k in ("num", "den", "on") for c in CHANNELS] + [
    "ref_valid", "ref_path", "pol_num", "n_valid", "n_low", "n_high",
]


def render_los(
    volume: DataFrame,
    spec: GridSpec,
    pixel_table: DataFrame,
    camera: Camera,
    preset: im.WeightPreset = im.LARGE_FOV,
    step: float = 0.02,
    floor: bool = True,
    occult: str = "eclipse",
    r_occult: float = 1.0,
    density: tuple[DataFrame, GridSpec] | None = None,
    thomson: str = "K",
    u: float = rad.LIMB_DARKENING,
    crossover: float = rad.CROSSOVER,
    tiling: Tiling | None = None,
    limits: tuple[float, float] = (im.LOG_FLOOR, im.LOG_MAX),
) -> DataFrame:
    """Per-pixel signal, coverage, budgets and polarity of a volume (log_q, polarity).

    With ``density`` (nodes with ``ne``, their grid) the average is weighted by the scattered intensity.
    Values are held within ``limits`` (without ``floor`` below the upper one only); breaches of both are counted.
    """
    lowest, highest = limits
    if not lowest < highest:
        raise ValueError(f"limits rise, got {limits}")
    if occult not in ("eclipse", "opaque", "none"):
        raise ValueError(f"occult is 'eclipse', 'opaque' or 'none', not {occult!r}")
    tiling = tiling or Tiling(spec)
    nodes = tiling.spread(node_rows(volume, ["log_q", "polarity"]))
    if density is not None:
        nodes = nodes.unionByName(tiling.spread(node_rows(density[0], ["ne"], kind=1, width=2), density[1]))

    thick_spec = density[1] if density is not None else None

    def partial(tile_nodes, tile):
        block = block_of(tiling, spec, tile_nodes, tile, 2)
        thick = block_of(tiling, thick_spec, tile_nodes, tile, 1, kind=1) if thick_spec is not None else None

        def terms(p: _Samples):
            index = p.index(spec)
            log_q = block.cubic(*index, skip_nan=True)[0][:, 0]
            sign = np.nan_to_num(block.nearest(*index)[:, 1])
            on_path = np.ones(len(p.r), dtype=bool)
            if occult == "opaque":
                on_path &= ~im.occulted(p.rho, p.s, r_occult, np)
            valid = on_path & np.isfinite(log_q)
            raw = np.where(valid, log_q, 0.0)
            value = np.clip(raw, lowest if floor else None, highest)
            weights = preset.weights(p.s, p.r, np)
            mean_w = sum(weights) / 3.0
            scale = 1.0
            if thick is not None:
                ne = thick.cubic(*p.index(thick_spec))[0][:, 0]
                table = rad.table_lookup(p.r, thick_spec.inner, thick_spec.outer, u, crossover, np)
                scale = ne * rad.thomson_intensity(p.rho, p.r, *table, thomson, np)
            for w in weights:
                yield np.where(valid, w * scale * value, 0.0)
            for w in weights:
                yield np.where(valid, w * scale, 0.0)
            for w in weights:
                yield np.where(on_path, w, 0.0)
            yield np.where(valid, mean_w, 0.0)
            yield np.where(on_path, mean_w, 0.0)
            yield np.where(valid, mean_w * sign, 0.0)
            yield valid.astype(float)
            yield (valid & (raw < lowest)).astype(float)
            yield (valid & (raw > highest)).astype(float)

        return terms

    keep = [c for c in pixel_table.columns if c not in PIXEL]
    sums = _tile_sums(pixel_table, nodes, tiling, camera, step, LOS_SUMS, partial)
    counts = {c: F.col(c).cast("long") for c in ("n_valid", "n_low", "n_high")}
    return los_columns(sums.withColumns(counts), keep)


def brightness_sums(
    density: DataFrame, spec: GridSpec, pixel_table: DataFrame, camera: Camera, step: float = 0.02,
    u: float = rad.LIMB_DARKENING, crossover: float = rad.CROSSOVER, tiling: Tiling | None = None,
) -> DataFrame:
    """Tangential and polarized sums of density (column ``ne``) along each ray, times the step."""
    tiling = tiling or Tiling(spec)
    nodes = tiling.spread(node_rows(density, ["ne"]))
    ds = 2.0 * spec.outer / (gen.sample_count(spec.outer, step) - 1)

    def partial(tile_nodes, tile):
        block = block_of(tiling, spec, tile_nodes, tile, 1)

        def terms(p: _Samples):
            ne = block.cubic(*p.index(spec))[0][:, 0]
            c_tan, c_pol = rad.table_lookup(p.r, spec.inner, spec.outer, u, crossover, np)
            yield ne * c_tan * ds
            yield ne * c_pol * (p.rho / p.r) ** 2 * ds

        return terms

    return _tile_sums(pixel_table, nodes, tiling, camera, step, ["k_tan", "k_pol"], partial)


# image columns

def display_magnitude(mode: str, signal: Column, den: Column, on: Column, coverage: Column) -> Column:
    if mode == "balanced":
        return signal * on
    if mode == "raw":
        return signal * den
    if mode == "coverage":
        return signal * den / F.when(coverage > 0, coverage)
    raise ValueError(f"display is 'balanced', 'raw' or 'coverage', not {mode!r}")


@dataclass(frozen=True)
class Stretch:
    """Columns to scale, how, and the pixels whose percentiles count (all, where these hold none)."""

    columns: list[str]
    scaling: str = "linear"
    anchor: Column | None = None


def percentile_stretch(
    pixel_table: DataFrame, columns: list[str], scaling="linear", percentiles=(1.0, 99.5), anchor: Column | None = None,
) -> DataFrame:
    """Scale columns to [0, 1] between two exact percentiles of each snapshot; NULL gives 0.

    Percentiles come from the anchored pixels, or from all where the anchor holds none.
    """
    return percentile_stretches(pixel_table, [Stretch(columns, scaling, anchor)], percentiles)


def percentile_stretches(pixel_table: DataFrame, stretches: list[Stretch], percentiles=(1.0, 99.5)) -> DataFrame:
    """Several stretches of different columns by one count of their values."""
    prepared, wanted, limit = pixel_table, {}, {}
    for one in stretches:
        if one.scaling == "log":
            logs = {c: F.log10(F.greatest(F.col(c), F.lit(1e-300))) for c in one.columns}
            prepared = prepared.withColumns({c: F.when(F.col(c).isNotNull(), e) for c, e in logs.items()})
        wanted |= {f"_{c}": F.col(c) for c in one.columns}
        limit |= {c: F.col(f"_{c}") for c in one.columns}
        if one.anchor is not None:
            wanted |= {f"_{c}_in": F.when(one.anchor, F.col(c)) for c in one.columns}
            limit |= {c: F.coalesce(f"_{c}_in", f"_{c}") for c in one.columns}
    limits = quantiles(prepared, wanted, [p / 100.0 for p in percentiles])
    joined = join_few(prepared, limits.select("snapshot_id", *[v.alias(f"_{c}") for c, v in limit.items()]))
    scaled = {}
    for c in limit:
        low, high = F.col(f"_{c}")[0], F.col(f"_{c}")[1]
        span = F.when(high > low, high - low).otherwise(F.lit(1.0))
        scaled[c] = F.coalesce(clamp((F.col(c) - low) / span, 0.0, 1.0), F.lit(0.0))
    return joined.withColumns(scaled).select(*pixel_table.columns)


def render_finish(
    los: DataFrame, preset: im.WeightPreset = im.LARGE_FOV, display="balanced", occult="eclipse", r_occult=1.0,
    softness=0.03, percentiles=(1.0, 99.5), hue: bool = False,
) -> DataFrame:
    """Image and grayscale columns of a line-of-sight table (which keeps ``rho``).

    The eclipse core is removed before the stretch, so it does not count in the percentiles.
    """
    # read by the count of values and by the result: the line-of-sight pass runs once
    df, alpha = materialise(los, "line-of-sight"), F.lit(1.0)
    if occult == "eclipse":
        alpha = im.eclipse_alpha(F.col("rho"), r_occult, softness)
        core = alpha <= 0
        df = df.withColumns(
            {f"signal_{c}": F.when(~core, F.col(f"signal_{c}")) for c in CHANNELS}
            | {"coverage": F.when(core, F.lit(0.0)).otherwise(F.col("coverage"))}
        )
    df = df.withColumn("grayscale", reduce(lambda a, b: a + b, [F.col(f"signal_{c}") for c in CHANNELS]) / 3.0)
    if hue:
        df = percentile_stretch(df, ["grayscale"], "linear", percentiles).withColumn("grayscale", F.col("grayscale") * alpha)
        colours = im.ramp(F.col("polarity"), im.POLARITY_STOPS)
        return df.withColumns({f"image_{c}": colours[c] * F.col("grayscale") for c in CHANNELS})
    df = df.withColumns(
        {
            f"image_{c}": display_magnitude(
                display, F.col(f"signal_{c}"), F.col(f"den_{c}"), F.col(f"on_{c}"), F.col("coverage")
            )
            for c in CHANNELS
        }
    )
    anchor = None if preset.stretch_radius is None else F.col("rho") < preset.stretch_radius
    images = [f"image_{c}" for c in CHANNELS]
    df = percentile_stretches(df, [Stretch(["grayscale"]), Stretch(images, preset.scaling, anchor)], percentiles)
    return df.withColumns({c: F.col(c) * alpha for c in ["grayscale", *images]})


def render_composite(
    base: DataFrame, disk: DataFrame, r_occult=1.0, tone=0.8, desaturation=0.4, percentiles=(1.0, 99.5)
) -> DataFrame:
    """Lay an opaque-disk image over an eclipse image: matched ring tone, rim glow, screen blend."""
    shared = [f"{k}_{c}" for k in ("signal", "image") for c in CHANNELS] + ["coverage", "polarity"]
    base, disk = materialise(base, "eclipse-image"), materialise(disk, "disk-image")
    other = disk.select(*PIXEL, *[F.col(c).alias(f"_{c}") for c in shared])
    df = base.join(large(other), PIXEL)
    grey = (F.col("_image_0") + F.col("_image_1") + F.col("_image_2")) / 3.0
    keep = 1.0 - desaturation if desaturation > 0 else 1.0
    df = df.withColumns({f"_layer_{c}": grey + keep * (F.col(f"_image_{c}") - grey) for c in CHANNELS})
    rho = F.col("rho")
    outside = (rho > 1.02 * r_occult) & (rho < 1.1 * r_occult)
    inside = (rho > 0.9 * r_occult) & (rho < 0.98 * r_occult)
    mean3 = lambda stem: sum(F.col(f"{stem}_{c}") for c in CHANNELS) / 3.0
    rings = df.groupBy("snapshot_id").agg(
        F.avg(F.when(outside, mean3("image"))).alias("_outer"), F.avg(F.when(inside, mean3("_layer"))).alias("_inner")
    )
    df = join_few(df, rings)
    matched = F.when(F.col("_outer").isNotNull() & (F.col("_inner") > 0), tone * F.col("_outer") / F.col("_inner"))
    level = F.coalesce(matched, F.lit(tone))
    glow = im.smoothstep((GLOW_OUTER * r_occult - rho) / ((GLOW_OUTER - 1.0) * r_occult))
    weight = F.when(rho < r_occult, F.lit(1.0)).otherwise(glow)
    blended = {
        f"image_{c}": 1.0 - (1.0 - F.col(f"image_{c}")) * (1.0 - clamp(F.col(f"_layer_{c}") * level * weight, 0.0, 1.0))
        for c in CHANNELS
    }
    hole = [F.col(f"signal_{c}").isNull() & (rho < r_occult) for c in CHANNELS]
    whole = hole[0] & hole[1] & hole[2]
    filled = {
        f"signal_{c}": F.when(hole[c], F.col(f"_signal_{c}")).otherwise(F.col(f"signal_{c}")) for c in CHANNELS
    }
    filled |= {n: F.when(whole, F.col(f"_{n}")).otherwise(F.col(n)) for n in ("coverage", "polarity")}
    df = df.withColumns(blended | filled).select(*base.columns)
    df = df.withColumn("grayscale", sum(F.col(f"signal_{c}") for c in CHANNELS) / 3.0)
    return percentile_stretch(df, ["grayscale"], "linear", percentiles)


def render_metrics(finished: DataFrame) -> DataFrame:
    """Mean coverage over covered pixels and the share of clamped samples."""
    share = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n_valid")), F.lit(0.0))
    return finished.groupBy("snapshot_id").agg(
        F.coalesce(F.avg(F.when(F.col("coverage") > 0, F.col("coverage"))), F.lit(0.0)).alias("mean_coverage"),
        share("n_low").alias("lower_clamped"),
        share("n_high").alias("upper_clamped"),
    )


def frame_mean(signal: list[Column]) -> Column:
    """Channel mean that ignores missing channels, as frames are exported."""
    present = sum(c.isNotNull().cast("int") for c in signal)
    return F.try_divide(sum(F.coalesce(c, F.lit(0.0)) for c in signal), present)


def true_step(outer: float, step: float) -> float:
    return 2.0 * outer / (gen.sample_count(outer, step) - 1)


