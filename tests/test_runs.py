"""Whole jobs: structured inputs, options of a rendering, brightness from density."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliospark.functions.camera import Camera
from heliospark.functions.grid import GridSpec
from heliospark.operators import brightness, los
from heliospark.operators import generators as gen
from heliospark.plans import pipeline
from heliospark.sources import structured

R, THETA, PHI = 1.0 + 0.2 * np.arange(8), (np.arange(9) + 0.5) * np.pi / 9, np.arange(10) * np.pi / 5
SPEC = GridSpec(6, 12, 14, inner=1.0, outer=2.6, spacing="uniform")
VALUES = ["b_x", "b_y", "b_z", "rho"]
#: Share of a cell by which a variable is off the density mesh, and its value.
SET = {
    "rho": ((0, 0, 0), lambda r, t: 4.0 - r + t), "br": ((0.5, 0, 0), lambda r, t: 2.0 + r + t),
    "bt": ((0, 0.5, 0), lambda r, t: r - t), "bp": ((0, 0, 0.5), lambda r, t: 0.5 * r),
}


def block_rows(name):
    off, value = SET[name]
    axes = [a + o * (a[1] - a[0]) for a, o in zip((R, THETA, PHI), off)]
    rows = [(s, i, j, k, r, t, p, (1.0 + s) * value(r, t)) for s in (0, 1) for i, r in enumerate(axes[0]) for j, t in enumerate(axes[1]) for k, p in enumerate(axes[2])]
    return pd.DataFrame(rows, columns=["snapshot_id", "i_r", "i_t", "i_p", "r", "theta", "phi", "value"])


@pytest.fixture(scope="module")
def variables(spark, tmp_path_factory):
    """One member a file, the others tables."""
    path = tmp_path_factory.mktemp("set")
    for name in SET:
        rows = block_rows(name)
        if name == "rho":
            rows.to_parquet(path / "rho002.parquet")
        else:
            spark.createDataFrame(rows).repartition(3).write.parquet(str(path / f"{name}002.parquet"))
    return structured.read_structured(spark, str(path))


def on_axes(values, r, t, p):
    """Trilinear value on the density mesh: ends held, azimuth closed."""
    sides = []
    for axis, at in ((R, np.clip(r, R[0], R[-1])), (THETA, np.clip(t, THETA[0], THETA[-1])), (np.r_[PHI, 2 * np.pi], p % (2 * np.pi))):
        low = min(max(int(np.searchsorted(axis, at, "right")) - 1, 0), len(axis) - 2)
        share = (at - axis[low]) / (axis[low + 1] - axis[low])
        sides.append(((low, 1 - share), (low + 1, share)))
    return sum(a * b * c * values[i, j, k % len(PHI)] for (i, a), (j, b), (k, c) in itertools.product(*sides))


def expected():
    """The set's Cartesian field and density on its mesh (values are linear, so alignment is exact)."""
    r, t, p = np.meshgrid(R, THETA, PHI, indexing="ij")
    br, bt, bp = (SET[n][1](r, t) for n in ("br", "bt", "bp"))
    flat = br * np.sin(t) + bt * np.cos(t)
    return {"b_x": flat * np.cos(p) - bp * np.sin(p), "b_y": flat * np.sin(p) + bp * np.cos(p), "b_z": br * np.cos(t) - bt * np.sin(t), "rho": SET["rho"][1](r, t)}


def test_structured_set_on_the_grid(spark, variables):
    fld, density = pipeline.build_field(variables, pipeline.RunConfig(grid=SPEC))
    got = fld.nodes.toPandas()
    assert len(got) == 2 * SPEC.size and density.count() == 2 * SPEC.size
    radii, want = np.linspace(1.0, 2.6, 6), expected()  # the last radius lies beyond the mesh
    for row in got.sample(300, random_state=2).itertuples():
        at = radii[row.i_r], (row.i_t + 0.5) * np.pi / 12, row.i_p * np.pi / 7
        for name in VALUES:
            assert abs(getattr(row, name) - (1 + row.snapshot_id) * on_axes(want[name], *at)) < 1e-9


def test_structured_set_as_cells(spark, variables):
    nearest, _ = pipeline.build_field(variables, pipeline.RunConfig(grid=SPEC, resampler="nearest-cell"))
    got, want = nearest.nodes.where("snapshot_id = 0").toPandas(), expected()
    r, t, p = np.meshgrid(R, THETA, PHI, indexing="ij")
    mesh = np.stack([r * np.sin(t) * np.cos(p), r * np.sin(t) * np.sin(p), r * np.cos(t)], axis=-1).reshape(-1, 3)
    apart = np.linalg.norm(got[["x", "y", "z"]].to_numpy()[:, None] - mesh, axis=2)
    close = apart <= apart.min(axis=1, keepdims=True) + 1e-12
    for name in VALUES:
        same = np.abs(got[name].to_numpy()[:, None] - want[name].reshape(-1)) < 1e-9
        assert (close & same).any(axis=1).all()


def test_resampler_is_checked(spark, variables):
    cells = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "snapshot_id long, cell_id long, x double, y double, z double, b_x double, b_y double, b_z double")
    with pytest.raises(ValueError, match="needs a structured set"):
        pipeline.build_field(cells, pipeline.RunConfig(grid=SPEC, resampler="structured"))
    with pytest.raises(ValueError, match="resampler is"):
        pipeline.build_field(variables, pipeline.RunConfig(grid=SPEC, resampler="cubic"))
    for wrong in ({"percentiles": (50.0, 10.0)}, {"limits": (2.0, 1.0)}, {"softness": -0.1}, {"disk_tone": 0.0}, {"disk_desaturation": 1.5}):
        with pytest.raises(ValueError):
            pipeline.RunConfig(**wrong)


@pytest.fixture(scope="module")
def one_volume(spark):
    spec = GridSpec(8, 12, 16, inner=1.0, outer=2.5)
    one = spark.range(1).select(F.lit(0).cast("long").alias("snapshot_id"))
    sign = F.when(F.col("i_t") < 6, 1).otherwise(-1)
    return gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", (0.5 + F.sin("theta")).alias("log_q"), sign.alias("polarity")), spec


def test_limits_of_a_rendering(one_volume):
    vol, spec = one_volume
    camera = Camera(fov=6.0, height=12, width=12)
    table = gen.pixels(vol, camera)
    free, low, held = (
        los.render_los(vol, spec, table, camera, step=0.05, **o).toPandas().set_index("pixel_id").sort_index()
        for o in ({"floor": False, "limits": (0.9, 9.0)}, {"limits": (0.9, 9.0)}, {"limits": (0.9, 1.2)})
    )
    seen = free["n_valid"] > 0
    assert (held.loc[seen, "signal_0"].between(0.9 - 1e-12, 1.2 + 1e-12)).all() and free["signal_0"].min() < 0.9
    assert (free["n_low"] == low["n_low"]).all() and low["n_low"].sum() > 0  # counted with and without the floor
    assert free["n_high"].sum() == 0 < held["n_high"].sum()
    assert (low.loc[seen, "signal_0"] >= free.loc[seen, "signal_0"] - 1e-12).all()


def test_options_reach_the_pixels(one_volume):
    vol, spec = one_volume
    cfg = dict(grid=spec, camera=Camera(fov=6.0, height=12, width=12), step=0.05, r_occult=1.1)
    plain = pipeline.render_volume(vol, spec, pipeline.RunConfig(**cfg)).toPandas().set_index("pixel_id").sort_index()
    hue = pipeline.render_volume(vol, spec, pipeline.RunConfig(**cfg, hue=True)).toPandas().set_index("pixel_id").sort_index()
    hard = pipeline.render_volume(vol, spec, pipeline.RunConfig(**cfg, softness=0.0, percentiles=(0.0, 100.0))).toPandas()
    assert np.allclose(plain["grayscale"], hue["grayscale"]) and not np.allclose(plain["image_2"], hue["image_2"])
    assert (hard.loc[hard["rho"] <= 1.1, "grayscale"] == 0).all() and hard["grayscale"].max() == 1.0


@pytest.mark.parametrize("vignette", ["none", "newkirk"])
def test_density_to_displayed_brightness(spark, vignette):
    spec = GridSpec(24, 8, 8, inner=1.0, outer=6.0)
    one = spark.range(1).select(F.lit(0).cast("long").alias("snapshot_id"))
    ne = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", F.pow("r", F.lit(-4.0)).alias("ne"))
    cfg = pipeline.BrightnessConfig(Camera(fov=8.0, height=12, width=12), step=0.1, vignette=vignette)
    detail = {} if vignette == "none" else {"nodes": 65, "samples": 129}
    got = pipeline.brightness_image(ne, spec, cfg, **detail).toPandas().set_index("pixel_id").sort_index()
    sums = los.brightness_sums(ne, spec, gen.pixels(ne, cfg.camera), cfg.camera, 0.1)
    frame = brightness.finalize_brightness(sums, "eclipse", 1.02).toPandas().set_index("pixel_id").sort_index()
    assert np.allclose(got["polarized"], frame["polarized"], rtol=1e-12)
    assert got["display"].between(0, 1).all() and (got.loc[got["rho"] < 1.0, "display"] == 0).all()
    if vignette == "none":  # logarithmic between exact percentiles of the lit pixels
        lit = np.log10(frame["polarized"][frame["polarized"] > 0])
        low, high = np.percentile(lit, cfg.percentiles)
        assert np.allclose(got.loc[lit.index, "display"], np.clip((lit - low) / (high - low), 0, 1), atol=1e-9)
