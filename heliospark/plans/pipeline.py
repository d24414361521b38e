"""Whole jobs: cells to field, field to volume, volume to image, for any number of snapshots at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions import imaging as im
from heliospark.functions import radiation as rad
from heliospark.functions.camera import Camera
from heliospark.functions.geometry import MARGIN
from heliospark.functions.grid import GridSpec
from heliospark.operators import brightness, los, resample, volume
from heliospark.operators import generators as gen
from heliospark.operators.lines import GridField
from heliospark.operators.resample import StructuredBlock
from heliospark.operators.stepper import TraceOptions
from heliospark.operators.tiles import sample_tiles
from heliospark.session import large, materialise
from heliospark.sources.structured import align_structured, cells_of

#: Quality presets: resolution factor, supersample.
QUALITY = {"fast": (1, 2), "standard": (2, 4), "high": (3, 6)}


@dataclass(frozen=True)
class RunConfig:
    grid: GridSpec = field(default_factory=lambda: GridSpec(192, 180, 360))
    camera: Camera = field(default_factory=Camera)
    neighbours: int = 30
    #: "auto" reads a structured set on its own axes and fits scattered cells
    resampler: str = "auto"
    builder: str = "paint"
    resolution_factor: int = 2
    supersample: int = 4
    paint_step: float = 0.5
    closed: str = "neutral"
    trace: TraceOptions = field(default_factory=lambda: TraceOptions(min_turns=1))
    preset: im.WeightPreset = im.LARGE_FOV
    step: float = 0.02
    occult: str = "eclipse"
    r_occult: float = 1.0
    display: str = "balanced"
    thomson: str | None = None
    softness: float = 0.03
    #: log Q is held within these; without the floor below the upper one only
    limits: tuple[float, float] = (im.LOG_FLOOR, im.LOG_MAX)
    floor: bool = True
    percentiles: tuple[float, float] = (1.0, 99.5)
    #: colour by polarity instead of by channel
    hue: bool = False
    disk_tone: float = 0.8
    disk_desaturation: float = 0.4
    limb_darkening: float = rad.LIMB_DARKENING
    crossover: float = rad.CROSSOVER

    def __post_init__(self) -> None:
        low, high = self.percentiles
        if not 0.0 <= low < high <= 100.0:
            raise ValueError(f"percentiles rise within 0 to 100, got {self.percentiles}")
        if not self.limits[0] < self.limits[1]:
            raise ValueError(f"limits rise, got {self.limits}")
        if self.softness < 0.0 or self.disk_tone <= 0.0 or not 0.0 <= self.disk_desaturation <= 1.0:
            raise ValueError("need softness >= 0, disk_tone > 0 and disk_desaturation within 0 to 1")


@dataclass(frozen=True)
class BrightnessConfig:
    """Options of a scattered-light frame and its display."""

    camera: Camera = field(default_factory=Camera)
    step: float = 0.02
    occult: str = "eclipse"
    r_occult: float = 1.02
    softness: float = 0.03
    choice: str = "polarized"
    vignette: str = "newkirk"
    #: by default logarithmic where nothing flattens the falloff, else linear
    scaling: str | None = None
    percentiles: tuple[float, float] = (1.0, 99.5)
    limb_darkening: float = rad.LIMB_DARKENING
    crossover: float = rad.CROSSOVER


def _structured_values(variables: dict[str, StructuredBlock], fit, cfg: RunConfig) -> tuple[DataFrame, DataFrame, list[str]]:
    """Grid nodes, the set's values on them, and the values' names; ``fit`` serves the resamplers of scattered cells."""
    axes = variables["rho" if "rho" in variables else "br"].axes
    aligned = materialise(align_structured(variables), "aligned")
    values = ["b_x", "b_y", "b_z"] + (["rho"] if "rho" in variables else [])
    nodes = gen.grid_nodes(axes, cfg.grid)
    if cfg.resampler in ("auto", "structured"):
        block = StructuredBlock(aligned.select("snapshot_id", "i_r", "i_t", "i_p", *values), axes)
        at = nodes.select("snapshot_id", "node_id", "r", "theta", "phi")
        return nodes, resample.resample_structured(at, block, values, ["node_id"]), values
    return nodes, fit(nodes, cells_of(aligned, axes), values), values


def build_field(cells: DataFrame | dict[str, StructuredBlock], cfg: RunConfig) -> tuple[GridField, DataFrame | None]:
    """Cells (snapshot_id, cell_id, x, y, z, b_*, rho), or a structured set, to field and density on grid nodes."""

    def fit(nodes: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
        points = nodes.select("snapshot_id", "node_id", "x", "y", "z")
        if cfg.resampler in ("auto", "knn-mls"):
            return resample.mls_fit(points, cells, values, cfg.neighbours, "node_id")
        return resample.resample_nearest(points, cells, values, "node_id")

    if cfg.resampler not in ("auto", "structured", "knn-mls", "nearest-cell"):
        raise ValueError(f"resampler is 'auto', 'structured', 'knn-mls' or 'nearest-cell', not {cfg.resampler!r}")
    if isinstance(cells, dict):
        nodes, fitted, values = _structured_values(cells, fit, cfg)
    elif cfg.resampler == "structured":
        raise ValueError("resampler 'structured' needs a structured set; cells are scattered")
    else:
        values = ["b_x", "b_y", "b_z"] + (["rho"] if "rho" in cells.columns else [])
        nodes = gen.grid_nodes(cells, cfg.grid)
        fitted = fit(nodes, cells, values)
    packed = fitted.join(large(nodes.select("snapshot_id", "node_id", "i_r", "i_t", "i_p", "x", "y", "z")), ["snapshot_id", "node_id"])
    packed = materialise(packed.select("snapshot_id", "i_r", "i_t", "i_p", "x", "y", "z", *values), "field")
    density = None
    if "rho" in values:
        density = packed.select(
            "snapshot_id", "i_r", "i_t", "i_p", (F.col("rho") / rad.MEAN_MOLECULAR_WEIGHT).alias("ne")
        )
    return GridField(packed, cfg.grid), density


def build_volume(snapshots: DataFrame, fld, cfg: RunConfig) -> tuple[DataFrame, GridSpec]:
    """The volume on a refined grid of the same shell and law."""
    spec = cfg.grid.refined(cfg.resolution_factor)
    if cfg.builder == "paint":
        made = volume.volume_paint(snapshots, fld, spec, cfg.supersample, cfg.paint_step, cfg.closed, cfg.trace)
    elif cfg.builder == "per-voxel":
        made = volume.volume_per_voxel(snapshots, fld, spec, cfg.supersample, cfg.closed, cfg.trace)
    elif cfg.builder == "reference":
        made = volume.volume_reference(snapshots, fld, spec, cfg.trace).withColumn("polarity", F.lit(None).cast("long"))
    else:
        raise ValueError(f"builder is 'paint', 'per-voxel' or 'reference', not {cfg.builder!r}")
    return materialise(made, "volume"), spec


def render_volume(vol: DataFrame, spec: GridSpec, cfg: RunConfig, density: DataFrame | None = None) -> DataFrame:
    """Volume to finished pixels; ``composite`` runs an eclipse pass and an opaque disk pass."""
    pixel_table = gen.pixels(vol, cfg.camera)
    thick = None
    if cfg.thomson is not None:
        if density is None:
            raise ValueError("weighting by scattered light needs a density")
        thick = (density, cfg.grid)

    def one_pass(preset, step, occult):
        sums = los.render_los(
            vol, spec, pixel_table, cfg.camera, preset, step, occult=occult, r_occult=cfg.r_occult, density=thick,
            thomson=cfg.thomson or "K", floor=cfg.floor, u=cfg.limb_darkening, crossover=cfg.crossover, limits=cfg.limits,
        )
        return los.render_finish(sums, preset, cfg.display, occult, cfg.r_occult, cfg.softness, cfg.percentiles, cfg.hue)

    if cfg.occult != "composite":
        return one_pass(cfg.preset, cfg.step, cfg.occult)
    base = one_pass(cfg.preset, cfg.step, "eclipse")
    disk = one_pass(im.SMALL_FOV, min(cfg.step, los.DISK_STEP), "opaque")
    return los.render_composite(base, disk, cfg.r_occult, cfg.disk_tone, cfg.disk_desaturation, cfg.percentiles)


def render_brightness(
    density: DataFrame, spec: GridSpec, camera: Camera, step=0.02, occult="eclipse", r_occult=1.02, softness=0.03,
    u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER,
) -> DataFrame:
    pixel_table = gen.pixels(density, camera)
    sums = los.brightness_sums(density, spec, pixel_table, camera, step, u, crossover)
    return brightness.finalize_brightness(materialise(sums, "brightness"), occult, r_occult, softness)


def brightness_image(density: DataFrame, spec: GridSpec, cfg: BrightnessConfig = BrightnessConfig(), **detail) -> DataFrame:
    """Density to frames and their display: chosen frame, detrended, stretched to 0..1 (column ``display``)."""
    light = (cfg.limb_darkening, cfg.crossover)
    frame = render_brightness(density, spec, cfg.camera, cfg.step, cfg.occult, cfg.r_occult, cfg.softness, *light)
    scaling = cfg.scaling or ("log" if cfg.vignette == "none" else "linear")
    return brightness.brightness_display(
        frame, cfg.choice, cfg.vignette, cfg.r_occult, spec.inner, spec.outer, scaling, cfg.percentiles, *light, **detail
    )


def qmap_slice(
    vol: DataFrame, spec: GridSpec, signs: DataFrame | None, sign_spec: GridSpec | None, radius=3.0, n_theta=720, n_phi=1440
) -> DataFrame:
    """Shell samples of log Q and radial sign; a radius beyond the shell is held just inside it."""
    at = gen.lonlat_points(vol, n_theta, n_phi, min(radius, spec.outer * (1.0 - MARGIN)), nudge=False)
    df = sample_tiles(at, vol, spec, ["log_q"], ["seed_id"], mode="skip_nan", outside="null")
    if signs is None:
        return df.withColumn("radial_sign", F.lit(None).cast("long"))
    read = sample_tiles(at.select("snapshot_id", "seed_id", "x", "y", "z"), signs, sign_spec or spec, ["sign"], ["seed_id"])
    sign = read.select("snapshot_id", "seed_id", F.signum("sign").cast("long").alias("radial_sign"))
    return df.join(large(sign), ["snapshot_id", "seed_id"])


def qmap_metrics(qmap: DataFrame) -> DataFrame:
    below = F.count_if(F.col("log_q") < im.LOG_FLOOR)
    return qmap.groupBy("snapshot_id").agg(
        F.avg(F.col("log_q").isNotNull().cast("double")).alias("coverage"),
        F.coalesce(F.try_divide(below, F.count("log_q")), F.lit(0.0)).alias("sub_floor_fraction"),
    )


def run_pipeline(cells: DataFrame | dict[str, StructuredBlock], cfg: RunConfig) -> DataFrame:
    """Cells, or a structured set, of one or many snapshots to finished pixels."""
    rows = cells["br"].axes if isinstance(cells, dict) else cells
    snapshots = rows.select("snapshot_id").distinct()
    fld, density = build_field(cells, cfg)
    vol, spec = build_volume(snapshots, fld, cfg)
    return render_volume(vol, spec, cfg, density)
