"""Analytic gates and agreement of the two physical paths of an operator."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliospark.functions import imaging as im
from heliospark.functions.camera import Camera
from heliospark.functions.fields import DipoleField
from heliospark.functions.grid import GridSpec
from heliospark.operators import brightness, los, resample, stencil, volume
from heliospark.operators import generators as gen
from heliospark.operators import lines as ln
from heliospark.operators.stepper import TraceOptions
from heliospark.operators.lookup import interp_table
from heliospark.operators.tiles import Tiling, sample_tiles
from heliospark.plans import pipeline

DIPOLE = DipoleField()
B = ["b_x", "b_y", "b_z"]
GRADIENT = np.array([[0.5, -0.2, 0.1], [0.0, 0.4, -0.3], [0.2, 0.1, -0.6]])
OFFSET = np.array([0.3, -0.7, 1.1])


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1).select(F.lit(0).cast("long").alias("snapshot_id"))


def dipole_nodes(one, spec):
    b = DIPOLE.b(F.col("x"), F.col("y"), F.col("z"))
    return gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", *[c.alias(n) for c, n in zip(b, B)])


def linear(x, y, z):
    return [float(OFFSET[i]) + sum(float(GRADIENT[i, j]) * c for j, c in enumerate((x, y, z))) for i in range(3)]


def points(spark, n=400, low=1.05, high=2.4, seed=7):
    rng = np.random.default_rng(seed)
    r, u, phi = rng.uniform(low, high, n), rng.uniform(-1, 1, n), rng.uniform(0, 2 * np.pi, n)
    s = np.sqrt(1 - u * u)
    frame = pd.DataFrame({"snapshot_id": 0, "pid": np.arange(n), "x": r * s * np.cos(phi), "y": r * s * np.sin(phi), "z": r * u})
    return spark.createDataFrame(frame), frame


def seeds_at(spark, colatitudes, radius=1.01, phi=0.7):
    t = np.radians(np.asarray(colatitudes, dtype=float))
    return spark.createDataFrame(pd.DataFrame({
        "snapshot_id": 0, "line_id": np.arange(len(t)), "x": radius * np.sin(t) * math.cos(phi), "y": radius * np.sin(t) * math.sin(phi), "z": radius * np.cos(t),
    }))


# closed-form field and tracer


def test_separatrix_near_fifty_degrees(one):
    edge = one.select(DIPOLE.separatrix(F.lit(1.01))).first()[0]
    assert abs(math.degrees(edge) - 50.0) < 0.1


def test_lines_keep_their_flux_and_land_on_spheres(spark):
    opt = TraceOptions(rtol=1e-7)
    lines = ln.trace_lines(seeds_at(spark, [55, 75, 90, 105, 125, 15, 30, 40, 140, 165]), DIPOLE, opt).toPandas()
    for s in "bf":
        foot = lines[[f"foot_{s}_{c}" for c in "xyz"]].to_numpy()
        r = np.linalg.norm(foot, axis=1)
        target = np.where(lines[f"end_{s}"] == 0, 1.0, 2.5)
        assert np.abs(r - target).max() < 1e-9
    flux = lambda p: (lambda r2, c2: (r2 + 2 * 2.5**3 / np.sqrt(r2)) * c2 / r2)((p**2).sum(1), (p[:, :2] ** 2).sum(1))
    a, b = (flux(lines[[f"foot_{s}_{c}" for c in "xyz"]].to_numpy()) for s in "bf")
    assert np.abs(a / b - 1).max() < 1e-6


def test_topology_flips_at_the_separatrix(spark):
    closed = ln.classify(F.col("end_b"), F.col("end_f"))["is_closed"]
    rows = ln.trace_lines(seeds_at(spark, [49.5, 50.5, 129.5, 130.5]), DIPOLE).select("line_id", closed.alias("c")).orderBy("line_id").collect()
    assert [r["c"] for r in rows] == [False, True, True, False]


def test_squashing_factor_of_band_and_caps(spark):
    angles = [55, 75, 90, 105, 125, 15, 25, 35, 145, 155, 165]
    made = ln.squash(seeds_at(spark, angles), DIPOLE, TraceOptions(rtol=1e-8)).orderBy("line_id").toPandas()["q_perp"].to_numpy()
    theta = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(angles)), "t": np.radians(angles)}))
    exact = theta.select("k", DIPOLE.q_exact(F.col("t"), F.lit(1.01)).alias("q")).orderBy("k").toPandas()["q"].to_numpy()
    assert np.abs(made[:5] - 2.0).max() < 1e-5
    assert np.abs(made / exact - 1).max() < 1e-4


def test_seed_outside_the_shell_fails(spark):
    with pytest.raises(Exception, match="outside the shell"):
        ln.trace_lines(seeds_at(spark, [60], radius=3.0), DIPOLE).collect()


def test_step_budget_and_reversal_codes(spark):
    lines = ln.trace_lines(seeds_at(spark, [90]), DIPOLE, TraceOptions(max_steps=3)).first()
    assert (lines["end_b"], lines["end_f"], lines["foot_b_x"]) == (3, 3, None)


def test_options_are_checked():
    with pytest.raises(ValueError):
        TraceOptions(cfl=1.0)


# interpolation


def test_linear_field_and_gradient(spark, one):
    spec = GridSpec(48, 48, 96, inner=1.0, outer=2.5)
    at = [c.alias(n) for c, n in zip(linear(F.col("x"), F.col("y"), F.col("z")), B)]
    nodes = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", *at)
    df, frame = points(spark)
    got = sample_tiles(df, nodes, spec, B, ["pid"], mode="gradient", tiling=Tiling(spec, 13, 17)).orderBy("pid").toPandas()
    xyz = frame[["x", "y", "z"]].to_numpy()
    assert np.abs(got[B].to_numpy() - (OFFSET + xyz @ GRADIENT.T)).max() < 2e-4
    jac = got[[f"d{a}_{b}" for b in B for a in "xyz"]].to_numpy().reshape(-1, 3, 3)
    assert np.median(np.abs(jac - GRADIENT)) < 2e-3


def test_tile_size_does_not_change_values(spark, one):
    spec = GridSpec(12, 16, 24, inner=1.0, outer=2.5)
    nodes = dipole_nodes(one, spec)
    df, _ = points(spark, 300, 1.0, 2.5)
    reads = [
        sample_tiles(df, nodes, spec, B, ["pid"], tiling=t).orderBy("pid").toPandas()[B].to_numpy()
        for t in (Tiling(spec), Tiling(spec, 3, 4), Tiling(spec, 5, 16))
    ]
    joined = stencil.interpolate(df, nodes, spec, B, ["pid"]).orderBy("pid").toPandas()[B].to_numpy()
    assert np.abs(reads[0] - reads[1]).max() < 1e-13
    assert np.abs(reads[0] - reads[2]).max() < 1e-13
    assert np.abs(reads[0] - joined).max() < 1e-12


def test_crowded_tile_is_split(spark, one):
    """Two thirds of all points in one tile, spread over several tasks."""
    from heliospark.operators import tiles

    spec = GridSpec(12, 16, 24, inner=1.0, outer=2.5)
    nodes = dipole_nodes(one, spec)
    df, frame = points(spark, 3000, 1.0, 2.5)
    crowd = df.withColumns({"x": F.when(F.col("pid") % 3 > 0, F.lit(1.2)).otherwise(F.col("x")), "y": F.when(F.col("pid") % 3 > 0, F.lit(0.1)).otherwise(F.col("y")), "z": F.when(F.col("pid") % 3 > 0, F.lit(0.2)).otherwise(F.col("z"))})
    whole = sample_tiles(crowd, nodes, spec, B, ["pid"]).orderBy("pid").toPandas()
    before, sizes = tiles.ROWS_PER_TASK, tiles.tile_join.__defaults__
    try:
        tiles.tile_join.__defaults__ = (100,)
        split = sample_tiles(crowd, nodes, spec, B, ["pid"], tiling=Tiling(spec, 4, 4)).orderBy("pid").toPandas()
    finally:
        tiles.tile_join.__defaults__ = sizes
    assert before == tiles.ROWS_PER_TASK
    assert len(split) == 3000
    assert np.abs(whole[B].to_numpy() - split[B].to_numpy()).max() < 1e-13


def test_scalar_near_the_pole(spark, one):
    spec = GridSpec(16, 48, 96, inner=1.0, outer=2.5)
    nodes = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", F.col("x").alias("f"))
    t, phi = np.meshgrid(np.linspace(0.001, 2.2 * spec.theta_step, 12), np.linspace(0.1, 6.2, 15))
    frame = pd.DataFrame({"snapshot_id": 0, "pid": np.arange(t.size), "x": (1.8 * np.sin(t) * np.cos(phi)).ravel(), "y": (1.8 * np.sin(t) * np.sin(phi)).ravel(), "z": (1.8 * np.cos(t)).ravel()})
    got = sample_tiles(spark.createDataFrame(frame), nodes, spec, ["f"], ["pid"], mode="skip_nan", outside="null").orderBy("pid").toPandas()
    assert np.abs(got["f"] - frame["x"]).max() < 5e-3


# nearest neighbours and fits


def clustered_cells(n=900):
    rng = np.random.default_rng(3)
    spread = rng.uniform(-2, 2, (n // 3, 3))
    dense = 0.01 * rng.normal(size=(n // 3, 3)) + [1.2, 0.3, -0.4]
    same = np.tile([[0.5, -1.0, 0.25]], (n - 2 * (n // 3), 1))
    xyz = np.vstack([spread, dense, same])
    return pd.DataFrame({"snapshot_id": 0, "cell_id": rng.permutation(n), **{c: xyz[:, i] for i, c in enumerate("xyz")}})


@pytest.mark.parametrize("k", [1, 9])
def test_knn_is_exact_on_clusters_and_copies(spark, k):
    """A third of the cells in a tight cluster, a third at one position."""
    cells = clustered_cells()
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.uniform(-3, 3, (60, 3)), rng.normal(size=(30, 3)) * 0.01 + [1.2, 0.3, -0.4], [[0.5, -1.0, 0.25]] * 5, [[40.0, 0, 0]]])
    targets = pd.DataFrame({"snapshot_id": 0, "pid": np.arange(len(xyz)), **{c: xyz[:, i] for i, c in enumerate("xyz")}})
    got = resample.knn_join(spark.createDataFrame(targets), spark.createDataFrame(cells), k).orderBy("pid", "rank").toPandas()
    gap = np.sqrt(((xyz[:, None] - cells[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(-1))
    for p in range(len(xyz)):
        order = np.lexsort((cells["cell_id"], gap[p]))[:k]
        mine = got[got["pid"] == p]
        assert np.allclose(mine["distance"], gap[p][order], atol=1e-12)
        if np.unique(np.round(gap[p][order], 12)).size == k or p >= 90:
            assert list(mine["cell_id"]) == list(cells["cell_id"].to_numpy()[order])


def test_knn_splits_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(resample, "BUCKET_CAP", 40)
    cells = clustered_cells(600)
    targets = cells.head(50).rename(columns={"cell_id": "pid"})
    got = resample.knn_join(spark.createDataFrame(targets), spark.createDataFrame(cells), 5).groupBy("pid").count().toPandas()
    assert len(got) == 50 and (got["count"] == 5).all()


def test_fit_returns_a_linear_field(spark, one):
    rng = np.random.default_rng(11)
    n = 4000
    r, u, phi = rng.uniform(0.9, 2.6, n), rng.uniform(-1, 1, n), rng.uniform(0, 2 * np.pi, n)
    s = np.sqrt(1 - u * u)
    xyz = np.stack([r * s * np.cos(phi), r * s * np.sin(phi), r * u], axis=1)
    b = OFFSET + xyz @ GRADIENT.T
    cells = pd.DataFrame({"snapshot_id": 0, "cell_id": np.arange(n), **{c: xyz[:, i] for i, c in enumerate("xyz")}, **{c: b[:, i] for i, c in enumerate(B)}})
    nodes = gen.grid_nodes(one, GridSpec(8, 12, 24, inner=1.0, outer=2.5)).select("snapshot_id", F.col("node_id").alias("pid"), "x", "y", "z")
    fit = resample.mls_fit(nodes, spark.createDataFrame(cells), B, 30).join(nodes.select("pid", "x", "y", "z"), "pid").toPandas()
    exact = OFFSET + fit[["x", "y", "z"]].to_numpy() @ GRADIENT.T
    assert np.abs(fit[B].to_numpy() - exact).max() < 1e-6


def test_effective_neighbours_rounds_half_to_even():
    assert resample.effective_neighbours(1000) == 30
    assert resample.effective_neighbours(4_000_000) == 60
    assert resample.effective_neighbours(2_166_667 * 2, k=30) == round(30 * 4_333_334 / 2_000_000)


def test_neighbours_follow_the_number_of_cells(spark):
    rng = np.random.default_rng(8)
    sizes = {0: 300, 1: 1000}
    cells = pd.DataFrame([(k, i, *rng.normal(size=3)) for k, n in sizes.items() for i in range(n)], columns=["snapshot_id", "cell_id", "x", "y", "z"])
    points = spark.createDataFrame([(k, p, 0.1 * p, 0.0, 0.0) for k in sizes for p in range(5)], "snapshot_id long, pid long, x double, y double, z double")
    wanted = resample._effective(spark.createDataFrame(cells), 12, reference=400).collect()
    assert {(r["snapshot_id"], r["_wanted"]) for r in wanted} == {(k, resample.effective_neighbours(n, 12, 400)) for k, n in sizes.items()}
    near = resample._around(points, spark.createDataFrame(cells), resample._effective(spark.createDataFrame(cells), 12, 400), max(r["_wanted"] for r in wanted), "pid", [], resample.T.ArrayType(resample._PAIR), resample._pairs)
    assert {(r["snapshot_id"], len(r["_near"])) for r in near.collect()} == {(k, resample.effective_neighbours(n, 12, 400)) for k, n in sizes.items()}


# tracing tile by tile


def whole_grid(nodes, spec):
    """The field as one tile."""
    return ln.GridField(nodes, spec, Tiling(spec, block_r=spec.n_r, block_t=spec.n_theta))


def test_long_steps_stay_within_their_tiles(spark, one):
    spec = GridSpec(40, 48, 48, inner=1.0, outer=2.5)
    nodes = dipole_nodes(one, spec)
    seeds = seeds_at(spark, [20, 90, 150])
    opt = ln.TraceOptions(cfl=0.9)
    tiles = Tiling(spec, 10, 12, halo=ln.GridField(nodes, spec).frontier_tiling(opt.cfl).halo)
    whole, moved = [ln.trace_lines(seeds, f, opt).orderBy("line_id").toPandas() for f in (whole_grid(nodes, spec), ln.GridField(nodes, spec, tiles))]
    assert (whole[["end_b", "end_f"]] == moved[["end_b", "end_f"]]).all().all()
    assert np.abs(whole["len_f"] - moved["len_f"]).max() < 1e-10


def test_curve_of_many_nodes(spark):
    nodes = spark.range(200_000).select(F.lit(0).alias("snapshot_id"), F.col("id").cast("double").alias("k"), (2.0 * F.col("id")).alias("v"))
    rows = spark.createDataFrame([(0, x) for x in (-1.0, 0.25, 131071.5, 150000.5, 199000.5, 3e5)], "snapshot_id long, at double")
    got = [r["out"] for r in interp_table(rows, nodes, F.col("at"), "k", "v", "out").orderBy("at").collect()]
    assert got == [0.0, 0.5, 262143.0, 300001.0, 398001.0, 399998.0]


def test_frontier_tracing_equals_whole_grid(spark, one):
    spec = GridSpec(40, 48, 48, inner=1.0, outer=2.5)
    nodes = dipole_nodes(one, spec)
    seeds = seeds_at(spark, [20, 35, 60, 90, 120, 150])
    whole = ln.trace_lines(seeds, whole_grid(nodes, spec)).orderBy("line_id").toPandas()
    tiles = Tiling(spec, 10, 12, halo=18)
    moved = ln.trace_lines(seeds, ln.GridField(nodes, spec, tiles)).orderBy("line_id").toPandas()
    assert (whole[["end_b", "end_f"]] == moved[["end_b", "end_f"]]).all().all()
    numbers = [c for c in whole.columns if c.startswith(("foot", "len"))]
    assert np.abs(whole[numbers] - moved[numbers]).max().max() < 1e-10


def test_frontier_transport_and_paths(spark, one):
    spec = GridSpec(40, 48, 48, inner=1.0, outer=2.5)
    nodes = dipole_nodes(one, spec)
    seeds = seeds_at(spark, [30, 80, 140])
    tiles = Tiling(spec, 8, 10, halo=18)
    fields = [whole_grid(nodes, spec), ln.GridField(nodes, spec, tiles)]
    q = [ln.squash(seeds, f).orderBy("line_id").toPandas()["q_perp"].to_numpy() for f in fields]
    assert np.abs(q[0] / q[1] - 1).max() < 1e-8
    paths = [ln.join_paths(ln.trace_halves(seeds, f, store_path=True)).orderBy("line_id", "seq").toPandas() for f in fields]
    assert len(paths[0]) == len(paths[1])
    assert np.abs(paths[0][["x", "y", "z"]] - paths[1][["x", "y", "z"]]).max().max() < 1e-10


# volume builders


def test_builders_agree_on_a_coarse_dipole(spark, one):
    spec = GridSpec(8, 12, 16, inner=1.0, outer=2.5)
    exact = volume.volume_reference(one, DIPOLE, spec).orderBy("node_id").toPandas()
    voxel = volume.volume_per_voxel(one, DIPOLE, spec, supersample=4).orderBy("node_id").toPandas()
    painted = volume.volume_paint(one, DIPOLE, spec, supersample=4).orderBy("node_id").toPandas()
    assert len(exact) == len(voxel) == len(painted) == spec.size
    floor = math.log10(2.0)
    assert exact["log_q"].notna().all() and exact["log_q"].min() > floor - 1e-3
    both = exact["log_q"].notna() & voxel["log_q"].notna()
    assert both.mean() > 0.95
    assert np.median(np.abs(exact["log_q"] - voxel["log_q"])[both]) < 0.05
    some = painted["log_q"].notna()
    assert some.mean() > 0.9
    assert np.median(np.abs(exact["log_q"] - painted["log_q"])[some]) < 0.15
    polar = (voxel["i_t"] == 0) & (voxel["i_r"] == 4)
    assert (voxel["polarity"][polar] == 1).all()
    assert (painted["polarity"][some].abs() <= 1).all()


# images


def test_camera_handedness_and_roll():
    look, right, up = Camera(look=(1, 0, 0)).basis()
    assert np.allclose(right, [0, 1, 0]) and np.allclose(up, [0, 0, 1])
    look, right, up = Camera(look=(1, 0, 0), roll=math.radians(35)).basis()
    assert np.allclose(np.cross(right, up), look) and abs(up @ [0, 0, 1] - math.cos(math.radians(35))) < 1e-12
    with pytest.raises(ValueError):
        Camera(look=(0, 0, 1)).basis()


def test_tiles_do_not_change_a_rendering(spark, one):
    spec = GridSpec(10, 16, 20, inner=1.0, outer=2.5)
    log_q = F.when(F.sin(7 * F.col("phi")) + F.cos(5 * F.col("theta")) > 1.6, None).otherwise(0.5 + F.col("theta"))
    vol = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", log_q.alias("log_q"), F.lit(1).alias("polarity"))
    camera = Camera.from_sub_observer(25, 10, 15, fov=6.0, height=12, width=12)
    px = gen.pixels(one, camera)
    images = [
        los.render_los(vol, spec, px, camera, step=0.05, tiling=t).orderBy("pixel_id").drop("prow", "pcol").toPandas().astype(float)
        for t in (Tiling(spec), Tiling(spec, 3, 4))
    ]
    assert np.nanmax(np.abs(images[0].to_numpy() - images[1].to_numpy())) < 1e-9
    assert (images[0].isna() == images[1].isna()).all().all()


def test_density_on_a_coarser_grid(spark, one):
    """The weighting density may live on a coarser grid of the same shell."""
    fine, coarse = GridSpec(16, 24, 24, inner=1.0, outer=2.5), GridSpec(8, 12, 12, inner=1.0, outer=2.5)
    vol = gen.grid_nodes(one, fine).select("snapshot_id", "i_r", "i_t", "i_p", (F.col("theta") + 0.5).alias("log_q"), F.lit(1).alias("polarity"))
    ne = gen.grid_nodes(one, coarse).select("snapshot_id", "i_r", "i_t", "i_p", (1.0 / F.col("r") ** 2).alias("ne"))
    camera = Camera(fov=6.0, height=8, width=8)
    px = gen.pixels(one, camera)
    made = [
        los.render_los(vol, fine, px, camera, step=0.1, density=(ne, coarse), tiling=t).orderBy("pixel_id").toPandas()
        for t in (Tiling(fine), Tiling(fine, 5, 7), Tiling(fine, 1, 1))
    ]
    for other in made[1:]:
        for c in ("signal_0", "den_1"):
            assert np.nanmax(np.abs(made[0][c] - other[c])) < 1e-9
    assert made[0]["signal_0"].notna().sum() > 10


def test_polarization_of_a_power_law(spark, one):
    """Density r^-g far from the sun polarizes as (g + 1) / (g + 3)."""
    spec = GridSpec(192, 8, 8, inner=1.0, outer=30.0)
    ne = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", F.pow("r", F.lit(-6.0)).alias("ne"))
    camera = Camera(fov=24.0, height=1, width=32)
    sums = los.brightness_sums(ne, spec, gen.pixels(one, camera), camera, step=0.01, u=0.0)
    got = brightness.finalize_brightness(sums, "none").toPandas()
    far = got[(got["rho"] > 6) & (got["rho"] < 10)]
    assert len(far) and np.abs(far["polarized"] / far["total"] - 7 / 9).max() < 0.02


def test_composite_and_run(spark, one):
    spec = GridSpec(8, 12, 16, inner=1.0, outer=2.5)
    vol = gen.grid_nodes(one, spec).select("snapshot_id", "i_r", "i_t", "i_p", (0.5 + F.sin("theta")).alias("log_q"), F.lit(1).alias("polarity"))
    cfg = pipeline.RunConfig(grid=spec, camera=Camera(fov=6.0, height=24, width=24), step=0.05, occult="composite")
    image = pipeline.render_volume(vol, spec, cfg).toPandas()
    disk = image[image["rho"] < 0.8]
    assert len(image) == 576 and image[["image_0", "image_1", "image_2"]].min().min() >= 0
    assert disk["signal_0"].notna().any() and image["grayscale"].between(0, 1).all()


def test_presets_of_weights():
    w = im.LARGE_FOV.weights(np.array([0.0]), np.array([2.0]), np)
    assert np.allclose([float(c[0]) for c in w], [2**-3, 2**-2, 2**-1.5])
    assert abs(im.SMALL_FOV.scale_heights[0] * 695.7 - 21) < 1e-12
