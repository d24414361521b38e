"""Readers and writers on small files with known content."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heliospark.functions.grid import GridSpec
from heliospark.sources import cfmesh, store, structured, sunjson, tecplot, text_rows

# three triangles around a top, each raised from radius 1 to radius 4
BASE = [(1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, 1)]
NODES = BASE + [tuple(4 * c for c in n) for n in BASE]
TRIANGLES = [(0, 1, 4), (1, 2, 4), (2, 3, 4)]
STATES = [f"{2 + k} 0 0 0 {10 + k} {20 - k} {3 * k} 0.{5 + k} 0" for k in range(3)]
FIELD = [[10 + k, 20 - k, 3 * k] for k in range(3)]
CENTRES = [5 / 6, -5 / 6, -5 / 6]


def sectioned() -> str:
    def surface(name, raised, ends):
        return [f"!TRS_NAME {name}", "!NB_GEOM_ENTS 3", "!LIST_GEOM_ENT", *[f"3 1 {' '.join(str(n + raised) for n in t)} {e}" for t, e in zip(TRIANGLES, ends)]]

    elements = [" ".join(map(str, [*t, *(n + 5 for n in t), k])) for k, t in enumerate(TRIANGLES)]
    lines = ["!COOLFLUID_VERSION 1.0", "!NB_DIM 3", "!NB_EQ 9", "!NB_NODES 10 0", "!NB_STATES 3 0", "!NB_ELEM 3", "!ELEM_TYPES Prism", "!NB_NODES_PER_TYPE 6"]
    lines += ["!LIST_ELEM", *elements, *surface("Floor", 0, (0, 1, 2)), *surface("Lid", 5, (0, 1, 2))]
    lines += ["!LIST_NODE", *[" ".join(map(str, n)) for n in NODES], "!LIST_STATE 1", *STATES, "!END", "unread"]
    return "\n".join(lines) + "\n"


def zoned(extra: str = "", packing: str = "BLOCK", where: str = "([1-3]=NODAL,[4-12]=CELLCENTERED)") -> str:
    names = "x0 x1 x2 rho u v w Bx By Bz p phi".split()
    lines = ['TITLE = "a fan of prisms"', "VARIABLES = " + ", ".join(f'"{n}"' for n in names)]
    lines += [f"ZONE N=10, E=3, ZONETYPE=FEBRICK, DATAPACKING={packing}, VARLOCATION={where}, SOLUTIONTIME=2.5"]
    lines += [" ".join(str(n[a]) for n in NODES) for a in range(3)] + [" ".join(c) for c in zip(*[s.split() for s in STATES])]
    bricks = [[a, b, c, c, a + 5, b + 5, c + 5, c + 5] for a, b, c in TRIANGLES]
    return "\n".join(lines + [" ".join(str(n + 1) for n in brick) for brick in bricks]) + "\n" + extra


@pytest.fixture(params=["whole", "split"])
def splitting(spark, request):
    """Read files whole, and cut into pieces of a few dozen bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    if request.param == "split":
        spark.conf.set(key, "61")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_sectioned_mesh(spark, tmp_path, splitting):
    (tmp_path / "a.CFmesh").write_text(sectioned())
    mesh = cfmesh.read_cfmesh(spark, str(tmp_path))
    cells = cfmesh.cells_of(mesh).orderBy("cell_id").toPandas()
    assert cells[["Bx", "By", "Bz"]].to_numpy().tolist() == FIELD
    assert cells["rho"].tolist() == [2, 3, 4] and cells["x"].tolist() == CENTRES
    faces = mesh.faces.select("file", "source_name", "face_id", F.explode("node_ids").alias("node_id"))
    tags = cfmesh.mesh_boundary_tag(faces, mesh.nodes).orderBy("role").collect()
    assert [(t["role"], t["source_name"], round(t["mean_radius"], 12)) for t in tags] == [("inner", "Floor", 1.0), ("outer", "Lid", 4.0)]
    assert sorted(r["adjacent_cell"] for r in mesh.faces.where("source_name = 'Lid'").collect()) == [0, 1, 2]
    info = cfmesh.solution_info(mesh).first()
    assert (info["n_nodes"], info["n_cells"], info["inner_radius"], info["outer_radius"]) == (10, 3, 1.0, 4.0)


def test_corners_carry_no_path(spark):
    """Two files of equal node ids: the join of the corners moves a short name of the file, and files stay apart."""
    rows = [(f, n, float(n + 10 * k), 0.0, 1.0) for k, f in enumerate(("file:/a", "file:/b")) for n in range(3)]
    nodes = spark.createDataFrame(rows, "file string, node_id long, x double, y double, z double")
    elements = nodes.groupBy("file").agg(F.collect_list("node_id").alias("node_ids")).select("file", F.lit(0).cast("long").alias("cell_id"), "node_ids", F.lit(0).cast("long").alias("state_id"))
    states = nodes.select("file", F.col("x").alias("rho"), F.col("node_id").alias("state_id")).where("state_id = 0")
    got = cfmesh.cells_of(cfmesh.Mesh(nodes, elements, states, nodes, nodes, ("rho",)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [("(file" in line or "AND (file" in line) for line in plan.splitlines() if "Join" in line and "node_id" in line] == [False]
    assert sorted((r.file, r.cell_id, r.x, r.rho) for r in got.collect()) == [("file:/a", 0, 1.0, 0.0), ("file:/b", 0, 11.0, 10.0)]


def test_wrong_variable_count(spark, tmp_path):
    (tmp_path / "a.CFmesh").write_text(sectioned())
    with pytest.raises(Exception, match="NB_EQ=9"):
        cfmesh.read_cfmesh(spark, str(tmp_path), ("rho", "Bx")).states.collect()


@pytest.mark.parametrize("where", ["([1-3]=NODAL,[4-12]=CELLCENTERED)", "([4,5]=CELLCENTERED, [6-12] = CellCentered)"])
def test_zone_file(spark, tmp_path, splitting, where):
    (tmp_path / "a.plt").write_text(zoned(where=where))
    zone = tecplot.read_tecplot(spark, str(tmp_path))
    cells = cfmesh.mesh_prism_center(zone.corners, zone.nodes).join(zone.cells, ["file", "cell_id"]).orderBy("cell_id").toPandas()
    assert cells[["Bx", "By", "Bz"]].to_numpy().tolist() == FIELD
    assert cells["x"].tolist() == CENTRES and {"vx", "vy", "vz", "psi"} <= set(cells.columns)
    ends = cfmesh.mesh_boundary_synth(zone.nodes).first()
    assert (round(ends["inner_radius"], 12), round(ends["outer_radius"], 12)) == (1.0, 4.0)
    assert zone.zones.first()["solution_time"] == 2.5


def test_zone_lines_meet_blocks_once(spark, tmp_path):
    """One table of placed lines serves nodes, cells and corners; a line may hold values of several blocks."""
    text = zoned()
    head, body = text[: text.index("ZONE")], text[text.index("ZONE") :].split("\n", 1)
    words = body[1].split()
    (tmp_path / "a.plt").write_text(head + body[0] + "\n" + "\n".join(" ".join(words[k : k + 7]) for k in range(0, len(words), 7)) + "\n")
    zone = tecplot.read_tecplot(spark, str(tmp_path))
    for table in (zone.nodes, zone.cells, zone.corners):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    cells = cfmesh.mesh_prism_center(zone.corners, zone.nodes).join(zone.cells, ["file", "cell_id"]).orderBy("cell_id").toPandas()
    assert cells[["Bx", "By", "Bz"]].to_numpy().tolist() == FIELD and cells["x"].tolist() == CENTRES


def test_zone_file_refusals(spark, tmp_path):
    point, second, short = tmp_path / "p", tmp_path / "s", tmp_path / "t"
    point.mkdir(), second.mkdir(), short.mkdir()
    (short / "a.plt").write_text(zoned().rsplit("\n", 2)[0] + "\n")
    (point / "a.plt").write_text(zoned(packing="POINT"))
    (second / "a.plt").write_text(zoned("1 2 3\n"))
    with pytest.raises(Exception, match="BLOCK"):
        tecplot.read_tecplot(spark, str(point)).nodes.collect()
    with pytest.raises(Exception, match="cut short"):
        tecplot.read_tecplot(spark, str(short)).cells.collect()
    with pytest.raises(Exception, match="more than one zone"):
        tecplot.read_tecplot(spark, str(second)).corners.collect()


def test_structured_set_names(spark):
    names = spark.createDataFrame([("rho002.parquet",), ("run_br.parquet",)], "n string").select(structured.variable_of(F.col("n"))).collect()
    assert [r[0] for r in names] == ["rho", "br"]
    with pytest.raises(Exception, match="not exactly one variable"):
        spark.createDataFrame([("density.parquet",)], "n string").select(structured.variable_of(F.col("n"))).collect()
    with pytest.raises(ValueError, match="lacks"):
        structured.align_structured({})


def line_tables(spark):
    lines = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 1), (0, 3, 0, 3)], "snapshot_id long, line_id long, end_b long, end_f long")
    path = [(0, k, s, 1.0 + 0.5 * s, 0.0, 0.0) for k in (1, 2, 3) for s in range(3)]
    return lines, spark.createDataFrame(path, "snapshot_id long, line_id long, seq long, x double, y double, z double")


def test_lines_as_json(spark):
    lines, paths = line_tables(spark)
    text = sunjson.single_document(sunjson.line_documents(lines, paths), F.lit("2024-04-08 18:17:00").cast("timestamp")).first()["document"]
    document = json.loads(text)
    assert document["type"] == "SunJSON" and document["time"] == "2024-04-08T18:17:00"
    assert [g["topology"] for g in document["geometry"]] == ["closed", "open"]
    assert document["geometry"][0] == {"type": "line", "coordinates": [[1.0, 0.0, 0.0], [1.5, 0.0, 0.0], [2.0, 0.0, 0.0]], "colors": [[255, 255, 255, 255]], "thickness": 0.004, "topology": "closed"}
    with pytest.raises(Exception, match="incomplete"):
        sunjson.line_documents(lines, paths, keep=F.lit(True)).collect()


def test_volume_format_is_checked(spark, tmp_path):
    spec = GridSpec(4, 4, 4)
    rows = pd.DataFrame([(0, r, t, p, 0.5) for r in range(4) for t in range(4) for p in range(4)], columns=["snapshot_id", "i_r", "i_t", "i_p", "log_q"])
    store.write_volume(str(tmp_path / "v"), spark.createDataFrame(rows), spec, {"a": 1})
    channels, grids, provenance = store.read_volume(spark, str(tmp_path / "v"))
    assert channels["log_q"].count() == 64 and "polarity" not in channels and grids["volume"] == spec and provenance == {"a": 1}
    spark.createDataFrame([("other", "{}", "{}")], "format string, grids string, provenance string").write.json(str(tmp_path / "w" / "meta"))
    with pytest.raises(ValueError, match="format"):
        store.read_volume(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="no volume"):
        store.read_volume(spark, str(tmp_path / "missing"))


def test_grid_rules():
    for bad in ((3, 8, 8), (8, 3, 8), (8, 8, 7)):
        with pytest.raises(ValueError):
            GridSpec(*bad)
    with pytest.raises(ValueError):
        GridSpec(8, 8, 8, spacing="cubic")


def test_cell_centers_by_blocks(spark):
    """Cells that list their nodes have the centres that a join corner by corner gives, wherever their nodes lie."""
    nodes = spark.range(1000).where("id % 97 <> 5").selectExpr("id % 2 AS file", "id AS node_id", "sin(id) AS x", "IF(id % 13 = 0, NULL, cos(id)) AS y", "id * 0.5D AS z")
    lists = spark.range(300).selectExpr("id % 2 AS file", "id AS cell_id", "array(id, id + 2, id + 64, (id * 37) % 1000, id, 5L, 2000L, NULL) AS node_ids")
    lists = lists.unionAll(spark.sql("SELECT 0L, 900L, array(2000L, 5L)")).unionAll(spark.sql("SELECT 1L, 901L, array(13L)")).unionAll(spark.sql("SELECT 1L, 902L, CAST(NULL AS ARRAY<BIGINT>)"))
    corners = lists.select("file", "cell_id", F.explode("node_ids").alias("node_id"))
    want = {(r.file, r.cell_id): r for r in cfmesh.mesh_prism_center(corners, nodes).collect()}
    got = {(r.file, r.cell_id): r for r in cfmesh.cell_centers(lists, nodes).collect()}
    assert set(got) == set(want) and (0, 900) not in got and got[1, 901].y is None
    for k, r in want.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(r[2:], got[k][2:]))


@pytest.mark.parametrize("most", [text_rows.BROADCAST_ROWS, 0])
def test_lines_of_few_files_stay_where_they_are_read(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(text_rows, "BROADCAST_ROWS", most)
    text = "!NB_EQ 2\n!LIST_ELEM\n0 1 2 0\n!LIST_NODE\n0 0 0\n1 0 0\n0 1 0\n!LIST_STATE 1\n7 8\n!END\n"
    for k in range(3):
        (tmp_path / f"mesh{k}.CFmesh").write_text(text)
    mesh = cfmesh.read_cfmesh(spark, str(tmp_path), ("rho", "p"))
    states = mesh.states
    moved = states._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    assert (moved > 0) == (most == 0)
    assert sorted((r.state_id, r.rho, r.p) for r in states.collect()) == [(0, 7.0, 8.0)] * 3
