"""Sides of a join that grow with the rows stay off the driver, however small their files are."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions.grid import GridSpec
from heliospark.llm import similar, simhash
from heliospark.operators import generators, resample, stencil, tiles
from heliospark.session import materialise
from heliospark.sources import store
from heliospark.sources.structured import block_of, mesh_points

COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in ("snapshot_id", "tile", "points", "nodes")])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, tiles.BROADCAST_ROWS])
def test_tile_join_broadcasts_counts_only(spark, monkeypatch, few):
    monkeypatch.setattr(tiles, "BROADCAST_ROWS", few)

    def counted(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        n = min(rows.num_rows, 1)
        keys = [rows.column(c).slice(0, n) for c in ("snapshot_id", "tile")]
        return pa.table([*keys, *(pa.array([t.num_rows] * n, pa.int64()) for t in (rows, nodes))], names=COUNTED.names)

    key = [(F.col("id") % 7).alias("snapshot_id"), (F.col("id") % 3).alias("tile")]
    points = materialise(spark.range(2000).where("id % 21 <> 5").select("id", F.sha2(F.col("id").cast("string"), 256).alias("tag"), *key), "points")
    nodes = materialise(spark.range(4200).select(F.lit(1.0).alias("v"), *key), "nodes")
    joined = tiles.tile_join(points, nodes, ["id"], counted, COUNTED, rows_per_task=40)
    assert "BuildLeft" not in plan(joined)
    got = joined.groupBy("snapshot_id", "tile").agg(F.sum("points").alias("points"), F.min("nodes").alias("low"), F.max("nodes").alias("high"), F.count("*").alias("tasks"))
    rows = got.collect()
    assert len(rows) == 20 and sum(r.points for r in rows) == points.count()
    assert all(r.low == r.high == 200 and r.tasks > 1 for r in rows)


def test_structured_nodes_are_not_broadcast(spark):
    grid = spark.range(3 * 4 * 5).select(
        F.lit(0).cast("long").alias("snapshot_id"),
        F.floor(F.col("id") / 20).alias("i_r"), F.floor(F.col("id") % 20 / 5).alias("i_t"), (F.col("id") % 5).alias("i_p")
    )
    rows = grid.select("*", (1.0 + F.col("i_r")).alias("r"), (0.5 + F.col("i_t")).alias("theta"), (F.col("i_p") * 1.2).alias("phi"))
    rows = materialise(rows.withColumn("value", F.col("r") + 10 * F.col("theta")), "set")
    block = block_of(rows)
    points = mesh_points(block.axes)
    assert points.count() == 60
    # one node is missing: it counts for nothing, and a point on it alone is left out
    held = resample.StructuredBlock(block.nodes.where("NOT (i_r = 1 AND i_t = 2 AND i_p = 3)"), block.axes)
    named = points.where("i_r < 2 AND i_t < 3").withColumnsRenamed({f"i_{a}": f"h_{a}" for a in "rtp"})
    read = resample.resample_structured(named, held, ["value"], ["h_r", "h_t", "h_p"])
    assert "Broadcast" not in plan(read)
    got = {(r.h_r, r.h_t, r.h_p): r.value for r in read.collect()}
    for (i, j, _), v in ((k, v) for k, v in got.items() if k != (1, 2, 3)):
        assert abs(v - (1.0 + i + 10 * (0.5 + j))) < 1e-9
    assert len(got) >= 29


def test_stencils_read_rings_and_bands(spark):
    """Points are spread over few rows, nodes are not broadcast, and a hole in a map gives NULL where a stencil meets it."""
    spec = GridSpec(5, 20, 6, inner=1.0, outer=2.5)
    grid = generators.grid_nodes(spark.createDataFrame([(0,)], "snapshot_id long"), spec)
    nodes = materialise(grid.withColumn("v", F.col("i_r") + F.cos("theta")), "nodes")
    points = materialise(grid.select("snapshot_id", F.col("node_id").alias("pid"), *[(F.col(c) * 0.999).alias(c) for c in "xyz"]), "points")
    read = stencil.interpolate(points, nodes, spec, ["v"], ["pid"])
    assert "Broadcast" not in plan(read) and plan(read).count("Generate explode") <= 3
    assert read.where("v IS NOT NULL").count() == spec.size

    maps = nodes.where("i_r = 0").select("snapshot_id", F.lit(0).cast("long").alias("sphere"), "i_t", "i_p", F.cos("theta").alias("log_q"))
    feet = grid.where("i_r = 0").select(
        "snapshot_id", F.col("node_id").alias("pid"), F.lit(0).cast("long").alias("sphere"),
        *[(F.col(c) + 0.25 * step).alias(c) for c, step in (("theta", spec.theta_step), ("phi", spec.phi_step))], "i_t", "i_p",
    )
    found = stencil.boundary_lookup(feet, maps.where("NOT (i_t = 9 AND i_p = 2)"), spec.n_theta, spec.n_phi, ["pid"])
    assert "Broadcast" not in plan(found)
    for row in found.join(feet, ["snapshot_id", "pid"]).collect():
        # one row and one azimuth of nodes before a foot, two after
        near = 7 <= row.i_t <= 10 and (2 - row.i_p) % 6 in (5, 0, 1, 2)
        assert (row.log_q is None) == near
        assert near or abs(row.log_q - math.cos(row.theta)) < 1e-2


def test_files_at_rest_do_not_follow_the_snapshots(spark, tmp_path):
    spec = GridSpec(4, 4, 4)
    rows = generators.grid_nodes(spark.range(60).select(F.col("id").alias("snapshot_id")), spec)
    rows = rows.select("snapshot_id", "i_r", "i_t", "i_p", (F.col("snapshot_id") + 0.25 * F.col("i_p")).alias("log_q"))
    store.write_volume(str(tmp_path / "volume"), rows, spec, {})
    frame = rows.select("snapshot_id", (F.col("i_r") * 16 + F.col("i_t") * 4 + F.col("i_p")).alias("pixel_id"), F.col("log_q").alias("mean"))
    back = store.write_frames(str(tmp_path / "frames"), frame, ["mean"])
    for name in ("volume/log_q", "frames"):
        assert len(list((tmp_path / name).rglob("*.parquet"))) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = store.read_volume(spark, str(tmp_path / "volume"))[0]["log_q"]
    assert back.count() == 60 * spec.size and read.exceptAll(rows).isEmpty() and rows.exceptAll(read).isEmpty()


def near_by_hand(points, cells, k):
    out = set()
    for p in points:
        gaps = sorted((math.dist(p[2:], c[2:5]), c[1]) for c in cells if c[0] == p[0])
        out |= {(*p[:2], rank, cell) for rank, (_, cell) in enumerate(gaps[:k], 1)}
    return out


@pytest.mark.parametrize("most", [0, 40, 2048])
def test_small_snapshots_settle_in_one_block(spark, monkeypatch, most):
    """Snapshots of few cells go as one block each; those of more, and few beside more, give the same."""
    spot = lambda i, a: tuple(((i * m + a) % 101) / 25.0 - 2.0 for m in (37, 59, 83))
    cells = [(s, 1000 * s + i, *spot(i, s), f"c{i}") for s, n in ((0, 30), (1, 90), (2, 3)) for i in range(n)]
    points = [(s, 100 * s + i, *spot(7 * i + 3, s)) for s in range(4) for i in range(12)]
    at = "x double, y double, z double"
    held = spark.createDataFrame(cells + [(0, 999, None, 0.0, 0.0, "nowhere")], f"snapshot_id long, cell_id long, {at}, tag string")
    asked = spark.createDataFrame(points + [(0, 99, None, 0.0, 0.0)], f"snapshot_id long, pid long, {at}")
    monkeypatch.setattr(resample, "WHOLE_CELLS", most)
    if most == 2048:  # no rounds at all
        monkeypatch.setattr(resample, "_knn_round", None)
    for k in (1, 3):
        got = {(r.snapshot_id, r.pid, r["rank"], r.cell_id) for r in resample.knn_join(asked, held, k).collect()}
        assert got == near_by_hand(points, cells, k)
    tags = {(r.snapshot_id, r.pid, 1, r.cell_id) for r in resample.resample_nearest(asked, held, ["tag"]).collect() if r.tag == f"c{r.cell_id % 1000}"}
    assert tags == near_by_hand(points, cells, 1)


def test_tiles_of_much_work_keep_their_tasks(spark):
    """Spark puts the tiles of small tables into one task by their bytes; a superstep's work is not in its bytes."""

    def counted(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        n = min(rows.num_rows, 1)
        keys = [rows.column(c).slice(0, n) for c in ("snapshot_id", "tile")]
        return pa.table([*keys, *(pa.array([t.num_rows] * n, pa.int64()) for t in (rows, nodes))], names=COUNTED.names)

    key = [(F.col("id") % 7).alias("snapshot_id"), (F.col("id") % 3).alias("tile")]
    points = materialise(spark.range(420).select("id", *key), "points")
    nodes = materialise(spark.range(840).select(F.lit(1.0).alias("v"), *key), "nodes")
    made = [tiles.tile_join(points, nodes, ["id"], counted, COUNTED, tasks=tasks) for tasks in (5, None)]
    assert made[0].rdd.getNumPartitions() == 5
    assert sorted(made[0].collect()) == sorted(made[1].collect()) and made[0].count() == 21


def test_fingerprints_are_not_broadcast(spark):
    # the files of the fingerprints are small, their probes are some fifty times as many rows
    marks = materialise(spark.range(2000).select(F.xxhash64("id").alias("mark")), "marks")
    links = simhash.near_links(marks, 4)
    assert "Broadcast" not in plan(links)
    assert links.count() == 0


def test_pairs_of_texts_are_not_broadcast(spark):
    placed = materialise(spark.range(100).selectExpr("id % 5 AS key", "id AS node", "10L AS size", "0L AS place", "id AS root"), "placed")
    pairs = similar.apart_pairs(placed, similar.SimilarOptions())
    assert "Broadcast" not in plan(pairs)
    assert pairs.count() == 5 * 20 * 19 // 2
