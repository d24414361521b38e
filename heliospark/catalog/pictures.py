"""Field-line pictures, sources, sinks and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark.catalog import sql as q
from heliospark.catalog.inputs import CAMERA, GRID, Inputs, big, query, r6, with_views
from heliospark.catalog.lines import SHORT, rays, uniform_field
from heliospark.catalog.scalars import DIP, DIPOLE
from heliospark.functions import imaging as im
from heliospark.functions.camera import Camera
from heliospark.functions.grid import GridSpec
from heliospark.operators import generators as gen
from heliospark.operators import lines as ln
from heliospark.operators import picture as pic
from heliospark.operators import volume as vol
from heliospark.plans import pipeline
from heliospark.session import large, scratch_path
from heliospark.sources import cfmesh, store, structured, sunjson, tecplot

RGB = ("red", "green", "blue")
LANDS = "(end_b IN (0, 1) AND end_f IN (0, 1))"


# field-line pictures


@query("keep_lines", with_views("lines", final=f"""SELECT snapshot_id, line_id FROM (SELECT *, CASE WHEN line_id % 2 = 0 THEN 'front' ELSE 'ring' END AS part FROM lines) a
    WHERE {LANDS} AND (part = 'ring' OR (end_b = 0 AND end_f = 0 AND len_b + len_f < 12e-1))"""))
def keep_lines(d: Inputs):
    part = F.when(F.col("line_id") % 2 == 0, F.lit("front")).otherwise(F.lit("ring"))
    return pic.keep_lines(d.lines.withColumn("part", part)).select("snapshot_id", "line_id")


FIRST = "(end_b = 0 OR end_f <> 0)"
FOOT = {f"{c}": f"CASE WHEN {FIRST} THEN foot_b_{c} ELSE foot_f_{c} END" for c in "xyz"}
RADIAL = "(" + " + ".join(f"({DIP[c]})*{c}" for c in "xyz") + ")"


def _tone(k: int) -> str:
    p, n, g = im.OPEN_POSITIVE[k], im.OPEN_NEGATIVE[k], im.CLOSED_GREY[k]
    return f"CASE WHEN NOT opened THEN {g}e0 WHEN {RADIAL} >= 0 THEN {p}e0 ELSE {n}e0 END"


LINE_COLOURS = {"ft": f"SELECT snapshot_id, line_id, {LANDS} AND (end_b = 1 OR end_f = 1) AS opened, " + ", ".join(f"{e} AS {c}" for c, e in FOOT.items()) + " FROM lines",
                "fr": "SELECT *, sqrt(x*x + y*y + z*z) AS r FROM ft"}


@query("line_colours", with_views("lines", more=LINE_COLOURS, final=f"SELECT snapshot_id, line_id, {r6(**{n: _tone(k) for k, n in enumerate(RGB)})} FROM fr"))
def line_colours(d):
    return pic.line_colours(d.lines, DIPOLE).select("snapshot_id", "line_id", *RGB)


TONES = {n: f"(({k + 2}*line_id % 7) + 1)/8e0" for k, n in enumerate(RGB)}


def toned(d: Inputs):
    keys = d.line_values.select("snapshot_id", "line_id")
    return keys.select("*", *[(((k + 2) * F.col("line_id") % 7 + 1) / 8.0).alias(n) for k, n in enumerate(RGB)])


SEGMENTS = {"pj": "SELECT *, y/25e-2 + 115e-1 AS c, 115e-1 - z/25e-2 AS w FROM paths",
    "sg": "SELECT *, lead(c) OVER o AS c1, lead(w) OVER o AS w1, lead(x) OVER o AS x1 FROM pj WINDOW o AS (PARTITION BY line_id ORDER BY seq)",
    "seg": f"""SELECT snapshot_id, line_id, seq, c AS col0, w AS row0, c1 AS col1, w1 AS row1, 5e-1*(x + x1) AS depth,
        6e-1 + 4e-1*greatest(least(5e-1*(5e-1*(x + x1)/25e-1 + 1e0), 1e0), 0e0) AS alpha, {', '.join(f'{e} AS {n}' for n, e in TONES.items())} FROM sg WHERE c1 IS NOT NULL"""}
COLS = ("col0", "row0", "col1", "row1", "depth", "alpha", *RGB)


@query("line_segments", with_views("paths", more=SEGMENTS, final=f"SELECT snapshot_id, line_id, seq, {r6(**{c: c for c in COLS})} FROM seg"))
def line_segments(d):
    return pic.line_segments(d.paths, toned(d), CAMERA, 2.5).select("snapshot_id", "line_id", "seq", *COLS)


SPLAT = SEGMENTS | {"nn": "SELECT *, CAST(ceil(sqrt(power(col1 - col0, 2) + power(row1 - row0, 2))) AS BIGINT) + 1 AS n FROM seg",
    "kk": "SELECT *, unnest(range(n)) AS k FROM nn", "pt": "SELECT *, col0 + k/greatest(n - 1, 1)*(col1 - col0) AS c, row0 + k/greatest(n - 1, 1)*(row1 - row0) AS w FROM kk",
    "of": "SELECT p.*, CAST(floor(c) AS BIGINT) + a.d - 2 AS px, CAST(floor(w) AS BIGINT) + b.d - 2 AS py FROM pt p, (SELECT CAST(range AS BIGINT) AS d FROM range(5)) a, (SELECT CAST(range AS BIGINT) AS d FROM range(5)) b",
    "wt": "SELECT *, greatest(least(125e-2 - sqrt(power(px - c, 2) + power(py - w, 2)), 1e0), 0e0)*alpha AS g FROM of WHERE px BETWEEN 0 AND 23 AND py BETWEEN 0 AND 23",
    "spl": f"SELECT snapshot_id, py*24 + px AS pixel_id, least(sum(g), 1e0) AS alpha, {', '.join(f'sum(g*{n})/greatest(sum(g), 1e0) AS {n}' for n in RGB)} FROM wt WHERE g > 0 GROUP BY snapshot_id, py*24 + px"}


def splats(d: Inputs):
    return pic.splat_segments(pic.line_segments(d.paths, toned(d), CAMERA, 2.5), CAMERA)


@query("splat_segments", with_views("paths", more=SPLAT, final=f"SELECT snapshot_id, pixel_id, {r6(**{c: c for c in ('alpha', *RGB)})} FROM spl"))
def splat_segments(d):
    return splats(d)


DISK = "greatest(least(45e-1 - sqrt(power(pcol - 115e-1, 2) + power(prow - 115e-1, 2)), 1e0), 0e0)"
FLAT = {"pix": q.pixels(), "flat": f"SELECT snapshot_id, pixel_id, {DISK} AS alpha, " + ", ".join(f"{DISK}*(25e0/255e0) AS {n}" for n in RGB) + " FROM pix"}


@query("disk_flat", with_views("snapshots", more=FLAT, final=f"SELECT snapshot_id, pixel_id, {r6(**{c: c for c in ('alpha', *RGB)})} FROM flat"))
def disk_flat(d):
    return pic.disk_flat(gen.pixels(d.snapshots, CAMERA), CAMERA, 1.0)


NEAR = {"pix": q.pixels(), "dk": f"SELECT snapshot_id, pixel_id, {DISK} AS alpha, oy AS y0, oz AS z0, sqrt(1e0 - power(least(rho, 1e0 - 1e-9), 2)) AS x0 FROM pix WHERE {DISK} > 0",
    "sf": "SELECT *, sqrt(x0*x0 + y0*y0 + z0*z0) AS sz FROM dk", "su": "SELECT snapshot_id, pixel_id, alpha, sz, x0*(1e0 + 1e-9)/sz AS x, y0*(1e0 + 1e-9)/sz AS y, z0*(1e0 + 1e-9)/sz AS z FROM sf",
    "sr": "SELECT *, sqrt(x*x + y*y + z*z) AS r FROM su", "rb": f"SELECT *, {RADIAL}/sz*(1e0 + 2e-1*snapshot_id) AS b FROM sr",
    "lv": "SELECT snapshot_id, quantile_cont(abs(b), 0.97) AS lv FROM rb GROUP BY snapshot_id",
    "sd": "SELECT snapshot_id, pixel_id, alpha, greatest(least(b/lv, 1e0), -1e0) AS s FROM rb JOIN lv USING (snapshot_id)"}
MAGNET = {n: f"alpha*({p}e0*(1e0 - abs(s)) + {o}e0*greatest(s, 0e0) + {i}e0*greatest(-s, 0e0))" for n, p, o, i in zip(RGB, im.PHOTOSPHERE, im.OUTWARD_RED, im.INWARD_BLUE)}


@query("disk_magnetogram", with_views("snapshots", more=NEAR, final=f"SELECT snapshot_id, pixel_id, {r6(alpha='alpha', **MAGNET)} FROM sd"))
def disk_magnetogram(d):
    surface = ln.attach_b(pic.disk_surface(gen.pixels(d.snapshots, CAMERA), CAMERA, 1.0), DIPOLE, ["pixel_id"])
    stronger = 1.0 + 0.2 * F.col("snapshot_id")
    return pic.disk_magnetogram(surface.withColumns({f"b_{c}": F.col(f"b_{c}") * stronger for c in "xyz"}))


@query("layer_over", with_views("snapshots", "paths", more=SPLAT | FLAT, final=f"""SELECT p.snapshot_id, p.pixel_id, {r6(**{n: f'(s_{n} + f_{n}*(1e0 - s_a))' for n in RGB})} FROM
    (SELECT p.snapshot_id, p.pixel_id, coalesce(s.alpha, 0e0) AS s_a, {', '.join(f'coalesce(s.{n}, 0e0) AS s_{n}, f.{n} AS f_{n}' for n in RGB)} FROM pix p
     JOIN flat f USING (snapshot_id, pixel_id) LEFT JOIN spl s USING (snapshot_id, pixel_id)) p"""))
def layer_over(d):
    pixel_table = gen.pixels(d.snapshots, CAMERA)
    return pic.layers_over(pixel_table, [pic.disk_flat(pixel_table, CAMERA, 1.0), splats(d)])


@query("view_fieldlines")
def view_fieldlines(d):
    image, _ = pic.view_fieldlines(d.snapshots, uniform_field(d), Camera(fov=6.0, height=32, width=32))
    return image


LATTICE = {"lat": """SELECT snapshot_id, id AS line_id, 13e-1*(1e0 + 1e-9)*sin(theta)*cos(phi) AS x, 13e-1*(1e0 + 1e-9)*sin(theta)*sin(phi) AS y, 13e-1*(1e0 + 1e-9)*cos(theta) AS z
    FROM (SELECT snapshot_id, id, (floor(id/20e0) + 5e-1)*pi()/20e0 AS theta, (id % 20 + 5e-1)*pi()/10e0 AS phi
          FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(400)) t) a"""}
ENDS = dict(r_b="sqrt(bx*bx + b_y*b_y + bz*bz)", r_f="sqrt(fx*fx + fy*fy + fz*fz)")


@query("export_lines", with_views("snapshots", more=LATTICE | rays("lat"), final=f"SELECT snapshot_id, line_id, 'open' AS topology, {r6(**ENDS)} FROM two"))
def export_lines(d):
    """Every seed of a lattice as a JSON document, parsed back: the radii of both ends of its line and its kind."""
    lines, paths = pic.export_lines(d.snapshots, uniform_field(d), 1.3, n_theta=20, n_phi=20, opt=SHORT)
    docs = sunjson.line_documents(lines, paths)
    geometry = F.from_json("geometry", "type string, coordinates array<array<double>>, colors array<array<int>>, thickness double, topology string")
    g = docs.select("snapshot_id", "line_id", geometry.alias("g")).select("snapshot_id", "line_id", "g.topology", "g.coordinates")
    radius = lambda k: F.get(F.element_at("coordinates", k), F.lit(0))
    return g.select("snapshot_id", "line_id", "topology", radius(1).alias("r_b"), radius(-1).alias("r_f"))


# mesh tables: points serve as nodes, six to a cell; cells' field from the same rows


def mesh_nodes(d: Inputs):
    return d.points.select("snapshot_id", F.col("pid").alias("node_id"), "x", "y", "z")


CENTERS = {"ctr": "SELECT c.snapshot_id, c.cell_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM corners c JOIN points p ON p.pid = c.node_id GROUP BY c.snapshot_id, c.cell_id"}


@query("mesh_prism_center", with_views("corners", "points", more=CENTERS, final=f"SELECT snapshot_id, cell_id, {r6(x='x', y='y', z='z')} FROM ctr"))
def mesh_prism_center(d):
    return cfmesh.mesh_prism_center(d.corners, mesh_nodes(d), "snapshot_id")


@query("mesh_state_to_cell", with_views("cells", final=f"""SELECT a.snapshot_id, a.cell_id, s.cell_id AS state_id, {r6(rho='s.rho', b_x='s.b_x')} FROM cells a
    JOIN cells s ON s.snapshot_id = a.snapshot_id AND s.cell_id = a.snapshot_id*1000 + (a.cell_id*7 % 1000)"""))
def mesh_state_to_cell(d):
    elements = d.cells.select("snapshot_id", "cell_id", (F.col("snapshot_id") * 1000 + F.col("cell_id") * 7 % 1000).alias("state_id"))
    states = d.cells.select("snapshot_id", F.col("cell_id").alias("state_id"), "rho", "b_x")
    return cfmesh.mesh_state_to_cell(elements, states, "snapshot_id").select("snapshot_id", "cell_id", "state_id", "rho", "b_x")


FACES = {"fc": "SELECT snapshot_id, CASE WHEN r < 13e-1 THEN 'Inlet' ELSE 'Outlet' END AS source_name, r FROM points WHERE r < 13e-1 OR r > 22e-1"}
TAGS = f"SELECT snapshot_id, CASE source_name WHEN 'Inlet' THEN 'inner' ELSE 'outer' END AS role, source_name, count(*) AS n_faces, {r6(mean_radius='avg(r)')} FROM fc GROUP BY snapshot_id, source_name"


@query("mesh_boundary_tag", with_views("points", more=FACES, final=TAGS))
def mesh_boundary_tag(d):
    return cfmesh.mesh_boundary_tag(d.faces, mesh_nodes(d), "snapshot_id")


@query("mesh_boundary_synth", with_views("points", more={"e": "SELECT snapshot_id, min(r) AS lo, max(r) AS hi FROM points GROUP BY snapshot_id"}, final=f"""SELECT p.snapshot_id,
    {r6(inner_radius='avg(r) FILTER (WHERE r <= lo + 1e-3*greatest(hi - lo, hi))', outer_radius='avg(r) FILTER (WHERE r >= hi - 1e-3*greatest(hi - lo, hi))')} FROM points p JOIN e USING (snapshot_id) GROUP BY p.snapshot_id"""))
def mesh_boundary_synth(d):
    return cfmesh.mesh_boundary_synth(mesh_nodes(d), "snapshot_id")


# text sources: mesh files are written from the same tables (one per snapshot) and read back


def _lines(df, snapshot, section: int, order, text):
    return df.select(snapshot.alias("snapshot_id"), F.lit(section).alias("part"), order.cast("long").alias("row"), text.alias("line"))


def write_cfmesh(d: Inputs) -> str:
    """One sectioned mesh file per snapshot: 1500 nodes, 1500 cells, two tagged surfaces."""
    path = scratch_path(d.spark, "cfmesh")
    snap = F.col("snapshot_id")
    local = lambda c: (F.col(c) - snap * 1500).cast("string")
    words = lambda *c: F.concat_ws(" ", *c)
    nodes, faces = mesh_nodes(d), d.faces
    corners = d.prisms.withColumn("cell", F.col("cell_id") - snap * 1500)
    cells = corners.groupBy("snapshot_id", "cell").agg(F.sort_array(F.collect_list(F.struct("slot", local("node_id").alias("n")))).alias("c"))
    states = d.points.select("snapshot_id", (F.col("pid") - snap * 1500).alias("cell"), "v", "x", "y", "z")
    value = [F.log("v"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y"), F.col("z"), F.lit(0.1), F.lit(0.0)]

    def heads(part, *lines):
        numbered = d.snapshots.select("snapshot_id", F.posexplode(F.array(*[F.lit(t) for t in lines])).alias("k", "t"))
        return _lines(numbered, snap, part, F.col("k"), F.col("t"))

    surface = lambda part, name: _lines(faces.where(F.col("source_name") == name), snap, part, F.col("face_id"), words(F.lit("1"), F.lit("1"), local("node_id"), F.lit("0")))
    counts = faces.groupBy("snapshot_id", "source_name").count()
    number = lambda part, name: _lines(counts.where(F.col("source_name") == name), snap, part, F.lit(0), F.concat(F.lit("!NB_GEOM_ENTS "), F.col("count").cast("string")))
    parts = [
        heads(0, "!COOLFLUID_VERSION 1.0", "!NB_DIM 3", "!NB_EQ 9", "!NB_NODES 1500 0", "!NB_STATES 1500 0", "!NB_ELEM 1500", "!ELEM_TYPES Prism", "!NB_NODES_PER_TYPE 6", "!LIST_ELEM"),
        _lines(cells, snap, 1, F.col("cell"), words(F.array_join(F.transform("c", lambda e: e["n"]), " "), F.col("cell").cast("string"))),
        heads(2, "!NB_TRSs 2", "!TRS_NAME Inlet"), number(3, "Inlet"), heads(4, "!LIST_GEOM_ENT"), surface(5, "Inlet"),
        heads(6, "!TRS_NAME Outlet"), number(7, "Outlet"), heads(8, "!LIST_GEOM_ENT"), surface(9, "Outlet"),
        heads(10, "!EXTRA_VARS", "!LIST_NODE"), _lines(nodes, snap, 11, F.col("node_id"), words(*[F.col(c).cast("string") for c in "xyz"])),
        heads(12, "!LIST_STATE 1"), _lines(states, snap, 13, F.col("cell"), words(*[v.cast("string") for v in value])), heads(14, "!END"),
    ]
    return _write_text(parts, path)


def _write_text(parts, path: str) -> str:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ordered = rows.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "part", "row")
    ordered.select("snapshot_id", "line").write.partitionBy("snapshot_id").text(path)
    return path


def snapshot_of_file():
    return F.regexp_extract("file", r"snapshot_id=(\d+)", 1).cast("long").alias("snapshot_id")


MESH_SQL = {"st": "SELECT snapshot_id, pid - snapshot_id*1500 AS cell_id, ln(v) AS rho, x AS b_x, y AS b_y, z AS b_z FROM points",
            "ct": "SELECT c.snapshot_id, c.cell_id - c.snapshot_id*1500 AS cell_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM prisms c JOIN points p ON p.pid = c.node_id GROUP BY c.snapshot_id, c.cell_id"}
MESH_CELLS = f"SELECT t.snapshot_id, t.cell_id, {r6(x='t.x', y='t.y', z='t.z', rho='s.rho', b_x='s.b_x', b_y='s.b_y', b_z='s.b_z')} FROM ct t JOIN st s ON s.snapshot_id = t.snapshot_id AND s.cell_id = t.cell_id"


@query("src_cfmesh", with_views("points", "prisms", more=MESH_SQL, final=MESH_CELLS))
def src_cfmesh(d):
    mesh = cfmesh.read_cfmesh(d.spark, write_cfmesh(d))
    named = {"Bx": "b_x", "By": "b_y", "Bz": "b_z"}
    return cfmesh.cells_of(mesh).select(snapshot_of_file(), "cell_id", "x", "y", "z", "rho", *[F.col(a).alias(b) for a, b in named.items()])


INFO = f"""SELECT snapshot_id, CAST(1500 AS BIGINT) AS n_nodes, CAST(1500 AS BIGINT) AS n_cells, {r6(inner_radius='a', outer_radius='b')}, n AS n_faces, m.model,
    'rho,vx,vy,vz,Bx,By,Bz,p,psi' AS variables, m.normalization FROM t CROSS JOIN (VALUES ('mhd', 'corona'), ('polytropic', 'unit')) m(model, normalization)"""


@query("solution_info", with_views("points", more=FACES | {"t": "SELECT snapshot_id, avg(r) FILTER (WHERE source_name = 'Inlet') AS a, avg(r) FILTER (WHERE source_name = 'Outlet') AS b, count(*) AS n FROM fc GROUP BY snapshot_id"}, final=INFO))
def solution_info(d):
    mesh = cfmesh.read_cfmesh(d.spark, write_cfmesh(d))
    both = cfmesh.solution_info(mesh).unionByName(cfmesh.solution_info(mesh, "polytropic", "unit"))
    return both.select(snapshot_of_file(), "*").drop("file")


def write_tecplot(d: Inputs) -> str:
    """The same meshes as block-packed zone files, ten values a line."""
    path = scratch_path(d.spark, "tecplot")
    snap = F.col("snapshot_id")
    names = ("x0", "x1", "x2", "rho", "u", "v", "w", "Bx", "By", "Bz", "p", "phi")
    zone = "ZONE N=1500, E=1500, ZONETYPE=FEBRICK, DATAPACKING=BLOCK, VARLOCATION=([1-3]=NODAL,[4-12]=CELLCENTERED)"
    head = d.snapshots.select("snapshot_id", F.posexplode(F.array(F.lit('TITLE = "made"'), F.lit("VARIABLES = " + " ".join(f'"{n}"' for n in names)), F.lit(zone))).alias("k", "t"))
    parts = [_lines(head, snap, 0, F.col("k"), F.col("t"))]
    place = F.col("pid") - snap * 1500

    def block(df, at, part, value):
        rows = df.select(snap, at.alias("i"), value.cast("string").alias("s")).groupBy("snapshot_id", F.floor(F.col("i") / 10).alias("row"))
        return _lines(rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]), " ").alias("t")), snap, part, F.col("row"), F.col("t"))

    for k, c in enumerate("xyz"):
        parts.append(block(d.points, place, 1 + k, F.col(c)))
    for k, v in enumerate([F.log("v"), *[F.lit(0.0)] * 3, F.col("x"), F.col("y"), F.col("z"), F.lit(0.1), F.lit(0.0)]):
        parts.append(block(d.points, place, 4 + k, v))
    corners = d.prisms.withColumn("n", F.col("node_id") - snap * 1500 + 1).groupBy("snapshot_id", (F.col("cell_id") - snap * 1500).alias("cell"))
    bricks = corners.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "n"))), lambda e: e["n"].cast("string")).alias("c"))
    text = F.concat_ws(" ", *[F.get("c", F.lit(k)) for k in (0, 1, 2, 2, 3, 4, 5, 5)])
    parts.append(_lines(bricks, snap, 20, F.col("cell"), text))
    return _write_text(parts, path)


@query("src_tecplot", with_views("points", "prisms", more=MESH_SQL, final=MESH_CELLS))
def src_tecplot(d):
    zone = tecplot.read_tecplot(d.spark, write_tecplot(d))
    cells = cfmesh.mesh_prism_center(zone.corners, zone.nodes).join(zone.cells, ["file", "cell_id"])
    named = {"Bx": "b_x", "By": "b_y", "Bz": "b_z"}
    return cells.select(snapshot_of_file(), "cell_id", "x", "y", "z", "rho", *[F.col(a).alias(b) for a, b in named.items()])


# a staggered set: each variable on its own axes, half a cell off on one of them

SHIFTED = {"rho": (0.0, 0.0, 0.0), "br": (0.5, 0.0, 0.0), "bt": (0.0, 0.5, 0.0), "bp": (0.0, 0.0, 0.5)}


def write_structured(d: Inputs) -> str:
    path = scratch_path(d.spark, "structured")
    for k, (name, (sr, stt, sp)) in enumerate(SHIFTED.items()):
        r, theta, phi = 1.0 + 0.15 * (F.col("i_r") + sr), (F.col("i_t") + 0.5 + stt) * GRID.theta_step, (F.col("i_p") + sp) * GRID.phi_step
        value = F.col("ne") * (1.0 + k) if name == "rho" else r * (1.0 + k) + theta
        rows = d.nodes.select("snapshot_id", "i_r", "i_t", "i_p", r.alias("r"), theta.alias("theta"), phi.alias("phi"), value.alias("value"))
        rows.write.parquet(f"{path}/{name}002.parquet")
    return path


MESHED = {"mp": "SELECT snapshot_id, i_r, i_t, i_p, ne AS rho, 1e0 + 15e-2*i_r AS r, (i_t + 5e-1)*pi()/15e0 AS theta, i_p*pi()/10e0 AS phi FROM nodes",
          "mv": "SELECT *, r*2e0 + theta AS v0, r*3e0 + theta AS v1, r*4e0 + theta AS v2 FROM mp"}
SPUN = dict(b_x="v0*sin(theta)*cos(phi) + v1*cos(theta)*cos(phi) - v2*sin(phi)", b_y="v0*sin(theta)*sin(phi) + v1*cos(theta)*sin(phi) + v2*cos(phi)", b_z="v0*cos(theta) - v1*sin(theta)")


@query("src_structured_set", with_views("nodes", more=MESHED, final=f"SELECT snapshot_id, i_r, i_t, i_p, {r6(rho='rho', **SPUN)} FROM mv"))
def src_structured_set(d):
    """Variables linear in r and theta come back exactly, also where alignment extends past an axis end."""
    spark, path = d.spark, write_structured(d)
    blocks = {v: structured.block_of(spark.read.parquet(f"{path}/{v}002.parquet")) for v in SHIFTED}
    return structured.align_structured(blocks).select("snapshot_id", "i_r", "i_t", "i_p", "rho", "b_x", "b_y", "b_z")


@query("structured_field", with_views("nodes", more=MESHED, final=f"SELECT snapshot_id, i_r, i_t, i_p, {r6(rho='rho', **SPUN)} FROM mv"))
def structured_field(d):
    """A set found by its names, read back and brought onto the grid of the run by its own axes."""
    spec = GridSpec(GRID.n_r, GRID.n_theta, GRID.n_phi, inner=1.0, outer=1.0 + 0.15 * (GRID.n_r - 1), spacing="uniform")
    field, _ = pipeline.build_field(structured.read_structured(d.spark, write_structured(d)), pipeline.RunConfig(grid=spec))
    return field.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "rho", "b_x", "b_y", "b_z")


# sinks and facts


@query("sink_volume", with_views("nodes", final=f"""SELECT snapshot_id, i_r, i_t, i_p, {r6(log_q='log_q', ne='ne')}, {big(polarity='polarity', sign='sign(b_x*x + b_y*y + b_z*z)')} FROM nodes"""))
def sink_volume(d):
    """A volume with every channel, written and read back."""
    path = scratch_path(d.spark, "volume")
    signs = vol.radial_sign_grid(d.nodes)
    store.write_volume(path, d.volume, GRID, {"input": "orders"}, signs, GRID, d.density, GRID, dtype="float64")
    channels, grids, _ = store.read_volume(d.spark, path)
    if grids["volume"] != GRID:
        raise ValueError("the grid did not survive")
    key = ["snapshot_id", "i_r", "i_t", "i_p"]
    out = channels["log_q"]
    for name in ("polarity", "radial_sign", "density"):
        out = out.join(large(channels[name]), key)
    return out.select(*key, "log_q", "ne", "polarity", "sign")


@query("src_volume", with_views("nodes", final=f"""SELECT snapshot_id, {r6(covered_fraction='avg(CASE WHEN log_q IS NOT NULL THEN 1e0 ELSE 0e0 END)')},
    count(*) FILTER (WHERE CAST(log_q AS FLOAT) < {q.LOG_FLOOR}) AS sub_floor FROM nodes GROUP BY snapshot_id"""))
def src_volume(d):
    """A volume stored at single precision, loaded and measured."""
    path = scratch_path(d.spark, "volume")
    store.write_volume(path, d.volume, GRID, {"input": "orders"})
    return vol.coverage(store.read_volume(d.spark, path)[0]["log_q"])


@query("volume_provenance", with_views("nodes", more={"m": f"SELECT snapshot_id, count(*) FILTER (WHERE log_q < {q.LOG_FLOOR}) AS n FROM nodes GROUP BY snapshot_id"},
    final="SELECT snapshot_id, 'heliospark-volume-v1' AS format, '{\"path\": \"orders\"}' AS input, '{\"n_r\": 5}' AS field, '{\"builder\": \"paint\"}' AS volume, '{\"sub_floor\":' || n || '}' AS metrics FROM m"))
def volume_provenance(d):
    metrics = vol.coverage(d.volume).drop("covered_fraction")
    return store.volume_provenance({"path": "orders"}, {"n_r": GRID.n_r}, {"builder": "paint"}, metrics)


@query("sink_sunjson", with_views("paths", "lines", more={"k": f"SELECT line_id FROM lines WHERE {LANDS}"}, final="""
    SELECT p.snapshot_id, p.line_id, p.seq, (round(sqrt(x*x + y*y + z*z), 6) + 0e0) AS r, (round(degrees(asin(greatest(least(z/sqrt(x*x + y*y + z*z), 1e0), -1e0))), 6) + 0e0) AS lat,
    CASE WHEN l.end_b = 0 AND l.end_f = 0 THEN 'closed' ELSE 'open' END AS topology FROM paths p JOIN k ON k.line_id = p.line_id JOIN lines l ON l.line_id = p.line_id"""))
def sink_sunjson(d):
    """Complete lines written as JSON, parsed back to vertices."""
    ends = d.lines.select("line_id", "end_b", "end_f")
    lines = d.line_values.select("snapshot_id", "line_id").join(ends, "line_id")
    docs = sunjson.line_documents(lines, d.paths)
    geometry = F.from_json("geometry", "type string, coordinates array<array<double>>, colors array<array<int>>, thickness double, topology string")
    rows = docs.select("snapshot_id", "line_id", geometry.alias("g")).select("snapshot_id", "line_id", "g.topology", F.posexplode("g.coordinates").alias("k", "c"))
    return rows.select("snapshot_id", "line_id", (F.col("k") + 1).alias("seq"), F.get("c", F.lit(0)).alias("r"), F.get("c", F.lit(2)).alias("lat"), "topology")


@query("sink_frames", with_views("snapshots", "nodes", more={"pix": q.pixels()}, final=f"SELECT snapshot_id, pixel_id, prow, pcol, {r6(px='CAST(CAST(px AS FLOAT) AS DOUBLE)', py='CAST(CAST(py AS FLOAT) AS DOUBLE)', rho='CAST(CAST(rho AS FLOAT) AS DOUBLE)', mean='CAST(CAST(CASE WHEN pcol % 3 = 0 THEN py ELSE (px + py)/2e0 END AS FLOAT) AS DOUBLE)')} FROM pix"))
def sink_frames(d):
    """Frames at rest; the channel mean leaves missing channels out."""
    from heliospark.operators.los import frame_mean

    table = gen.pixels(d.snapshots, CAMERA)
    mean = frame_mean([F.when(F.col("pcol") % 3 != 0, F.col("px")), F.col("py")])
    frame = table.withColumn("mean", mean)
    return store.write_frames(scratch_path(d.spark, "frames"), frame, ["mean"]).select("snapshot_id", "pixel_id", "prow", "pcol", "px", "py", "rho", "mean")


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(d):
    """The hash of each row's content; ``store.content_hash`` is the same over files."""
    rows = d.spark.read.parquet(f"{d.sf_dir}/documents.parquet")
    return rows.select("doc_id", store.short_hash(F.col("text")).alias("content_hash"))


@query("julian_date", f"""SELECT event_id, {big(jd_day='floor(jd)')}, {r6(jd_part='jd - floor(jd)')} FROM (SELECT event_id, epoch_us(ts)/864e8 + 24405875e-1 AS jd FROM events) a""")
def julian_date(d):
    """Day number and part of the day, so that rounding does not meet the limit of a double."""
    jd = d.table("events").select("event_id", store.julian_date(F.col("ts")).alias("jd"))
    return jd.select("event_id", F.floor("jd").alias("jd_day"), (F.col("jd") - F.floor("jd")).alias("jd_part"))


# whole job: every snapshot's cells to finished pixels


@query("run_pipeline")
def run_pipeline(d):
    cfg = pipeline.RunConfig(grid=GridSpec(6, 6, 12, inner=1.0, outer=2.5), camera=Camera(fov=6.0, height=16, width=16), resolution_factor=1, supersample=1)
    return pipeline.run_pipeline(d.cells, cfg).drop("prow", "pcol")
