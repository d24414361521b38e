"""Stencil, nearest-neighbour and lookup joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark.catalog import sql as q
from heliospark.catalog.inputs import GRID, Inputs, big, query, r6, snapped, with_views, xyz
from heliospark.functions import radiation as rad
from heliospark.functions.geometry import cart_to_sph
from heliospark.operators import resample as rs
from heliospark.operators import stencil as st
from heliospark.operators.lookup import interp_table
from heliospark.operators.resample import StructuredBlock
from heliospark.operators.tiles import nearest_voxel, sample_tiles

ID = ["pid"]
KEEP = "snapshot_id, pid"

RAW_T, RAW_P = "CAST(floor(ft) AS BIGINT) - 1", "CAST(floor(fp) AS BIGINT) - 1"
GHOSTS = with_views("points", more={"s": q.spherical("points", "pid"), "i": q.index("s", "pid")}, final="{}")


@query("ghost_theta", GHOSTS.format(f"""SELECT pid, CASE WHEN {RAW_T} < 0 THEN -1 - ({RAW_T}) ELSE {RAW_T} END AS i_t,
    ({RAW_P} + CASE WHEN {RAW_T} < 0 THEN 10 ELSE 0 END + 20) % 20 AS i_p FROM i"""))
def ghost_theta(d: Inputs):
    _, ft, fp = GRID.index_of(*cart_to_sph(*xyz()))
    i_t, i_p = st.ghost_theta(GRID, F.floor(ft) - 1, F.floor(fp) - 1)
    return d.points.select("pid", i_t.alias("i_t"), i_p.alias("i_p"))


@query("ghost_phi", GHOSTS.format(f"SELECT pid, ({RAW_P} + 20) % 20 AS i_p FROM i"))
def ghost_phi(d):
    _, _, fp = GRID.index_of(*cart_to_sph(*xyz()))
    return d.points.select("pid", st.ghost_phi(GRID, F.floor(fp) - 1).alias("i_p"))


@query("ghost_radial", with_views("nodes", more={"pad": q.padded(["log_q", "ne"])}, final=f"SELECT snapshot_id, i_r, i_t, i_p, {r6(log_q='log_q', ne='ne')} FROM pad WHERE i_r < 0 OR i_r > 4"))
def ghost_radial(d):
    return st.ghost_radial(d.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "log_q", "ne"), GRID, ["log_q", "ne"])


B = ["b_x", "b_y", "b_z"]
TRICUBIC = with_views("points", "nodes", more=q.stencil_steps("points", KEEP, B), final=f"SELECT snapshot_id, pid, {r6(**{c: c for c in B})} FROM read")


@query("tricubic", TRICUBIC)
def tricubic(d):
    points = d.points.select("snapshot_id", "pid", "x", "y", "z")
    return sample_tiles(points, d.field_nodes, GRID, B, ID).drop("x", "y", "z")


@query("tricubic_join", TRICUBIC)
def tricubic_join(d):
    """The long-table form of the same read."""
    return st.interpolate(d.points, d.field_nodes, GRID, B, ID)


def _gradient_sql() -> str:
    """Chain rule from index slopes to Cartesian ones."""
    jac = {"r": ("x/r", "y/r", "z/r"), "t": ("cos(theta)*cos(phi)/r", "cos(theta)*sin(phi)/r", "-sin(theta)/r"), "p": ("-sin(phi)/(r*sin(theta))", "cos(phi)/(r*sin(theta))", "0e0")}
    per = {"r": "4e0/(r*ln(25e-1))", "t": "15e0/pi()", "p": "10e0/pi()"}
    out = {c: c for c in B}
    for c in B:
        for k, axis in enumerate("xyz"):
            out[f"d{axis}_{c}"] = " + ".join(f"{c}_{a}*({per[a]})*({jac[a][k]})" for a in "rtp")
    return f"SELECT snapshot_id, pid, {r6(**out)} FROM read JOIN sph USING (snapshot_id, pid)"


@query("tricubic_gradient", with_views("points", "nodes", more=q.stencil_steps("points", KEEP, B, slopes=True), final=_gradient_sql()))
def tricubic_gradient(d):
    points = d.points.select("snapshot_id", "pid", "x", "y", "z")
    return sample_tiles(points, d.field_nodes, GRID, B, ID, mode="gradient").drop("x", "y", "z")


CELLS_IN = """SELECT snapshot_id, cell_id, x, y, z FROM cells WHERE sqrt(x*x + y*y + z*z) >= 1e0 AND sqrt(x*x + y*y + z*z) <= 25e-1"""
OUTER_JOIN = "SELECT c.snapshot_id, c.cell_id, {} FROM cells c LEFT JOIN read r ON c.snapshot_id = r.snapshot_id AND c.cell_id = r.cell_id"


@query("tricubic_skip_nan", with_views("cells", "nodes", more={"inside": CELLS_IN} | q.stencil_steps("inside", "snapshot_id, cell_id", ["log_q"], skip=True), final=OUTER_JOIN.format(r6(log_q="r.log_q"))))
def tricubic_skip_nan(d):
    rows = d.cells.select("snapshot_id", "cell_id", "x", "y", "z")
    return sample_tiles(rows, d.volume, GRID, ["log_q"], ["cell_id"], mode="skip_nan", outside="null").drop("x", "y", "z")


@query("sample_density", with_views("cells", "nodes", more={"inside": CELLS_IN} | q.stencil_steps("inside", "snapshot_id, cell_id", ["ne"]), final=OUTER_JOIN.format(r6(ne="coalesce(r.ne, 0e0)"))))
def sample_density(d):
    rows = d.cells.select("snapshot_id", "cell_id", "x", "y", "z")
    return sample_tiles(rows, d.density, GRID, ["ne"], ["cell_id"], outside="zero").drop("x", "y", "z")


NEAR_T = "CAST(floor(ft + 5e-1) AS BIGINT)"


@query("sample_nearest", with_views("points", "nodes", more={"s": q.spherical("points", KEEP), "i": q.index("s", KEEP), "n": f"""
    SELECT snapshot_id, pid, CAST(floor(fr + 5e-1) AS BIGINT) AS i_r, CASE WHEN {NEAR_T} > 14 THEN 29 - {NEAR_T} ELSE {NEAR_T} END AS i_t,
    (CAST(floor(fp + 5e-1) AS BIGINT) + CASE WHEN {NEAR_T} > 14 THEN 10 ELSE 0 END) % 20 AS i_p FROM i"""},
    final=f"SELECT snapshot_id, pid, {big(polarity='v.polarity')} FROM n JOIN nodes v USING (snapshot_id, i_r, i_t, i_p)"))
def sample_nearest(d):
    i_r, i_t, i_p = nearest_voxel(GRID, *xyz())
    keyed = d.points.select("snapshot_id", "pid", i_r.alias("i_r"), i_t.alias("i_t"), i_p.alias("i_p"))
    return keyed.join(d.volume.select("snapshot_id", "i_r", "i_t", "i_p", "polarity"), st.NODE_KEY).select("snapshot_id", "pid", "polarity")


SIGN_NODES = "SELECT snapshot_id, i_r, i_t, i_p, sign(b_x*x + b_y*y + b_z*z) AS sg FROM nodes"


@query("sample_radial_sign", with_views("points", "nodes", more={"sn": SIGN_NODES} | {k: (q.padded(["sg"], "sn") if k == "pad" else v) for k, v in q.stencil_steps("points", KEEP, ["sg"]).items()},
    final=f"SELECT snapshot_id, pid, {big(sign='sign(round(sg, 9))')} FROM read"))
def sample_radial_sign(d):
    from heliospark.operators.volume import radial_sign_grid

    points = d.points.select("snapshot_id", "pid", "x", "y", "z")
    read = sample_tiles(points, radial_sign_grid(d.nodes), GRID, ["sign"], ID)
    return read.select("snapshot_id", "pid", F.signum(F.round("sign", 9)).cast("long").alias("sign"))


# foot look-up on sphere maps: the inner and outer node layers serve as the maps

FEET = " UNION ALL ".join(
    f"SELECT snapshot_id, line_id, CAST({k} AS BIGINT) AS side, CASE WHEN end_{s} IN (0, 1) THEN end_{s} END AS sphere, theta_{s} AS theta, phi_{s} AS phi FROM lines"
    for k, s in enumerate("bf"))
MAPS = "SELECT snapshot_id, CASE WHEN i_r = 0 THEN 0 ELSE 1 END AS sphere, i_t, i_p, log_q FROM nodes WHERE i_r IN (0, 4)"
FT, FP = "(theta/(pi()/15e0) - 5e-1)", "(phi/(pi()/10e0))"
LT, LP = f"CAST(floor({FT}) AS BIGINT) + t.d - 1", f"CAST(floor({FP}) AS BIGINT) + p.d - 1"
WT, WP = q.W.format(d="t.d", t=f"({FT} - floor({FT}))"), q.W.format(d="p.d", t=f"({FP} - floor({FP}))")
LOOKUP = {"feet": FEET, "maps": MAPS, "ft16": f"""SELECT snapshot_id, line_id, side, sphere,
    CASE WHEN {LT} < 0 THEN -1 - ({LT}) WHEN {LT} > 14 THEN 29 - ({LT}) ELSE {LT} END AS i_t,
    ({LP} + CASE WHEN {LT} < 0 OR {LT} > 14 THEN 10 ELSE 0 END + 20) % 20 AS i_p, ({WT})*({WP}) AS w
    FROM feet CROSS JOIN {q.FOUR} t CROSS JOIN {q.FOUR} p WHERE sphere IS NOT NULL""",
    "got": """SELECT f.snapshot_id, f.line_id, f.side, CASE WHEN count(m.log_q) = 16 THEN sum(f.w*m.log_q) END AS log_q FROM ft16 f
    JOIN maps m ON f.snapshot_id = m.snapshot_id AND f.sphere = m.sphere AND f.i_t = m.i_t AND f.i_p = m.i_p GROUP BY f.snapshot_id, f.line_id, f.side""",
    "foot_q": "SELECT f.snapshot_id, f.line_id, f.side, g.log_q FROM feet f LEFT JOIN got g ON f.snapshot_id = g.snapshot_id AND f.line_id = g.line_id AND f.side = g.side"}


def sphere_maps(d: Inputs):
    ends = d.volume.where(F.col("i_r").isin(0, GRID.n_r - 1))
    return ends.select("snapshot_id", F.when(F.col("i_r") == 0, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("sphere"), "i_t", "i_p", "log_q")


@query("boundary_lookup", with_views("lines", "nodes", more=LOOKUP, final=f"SELECT snapshot_id, line_id, side, {r6(log_q='log_q')} FROM foot_q"))
def boundary_lookup(d):
    from heliospark.operators.volume import feet_rows

    return st.boundary_lookup(feet_rows(d.lines), sphere_maps(d), GRID.n_theta, GRID.n_phi, ["line_id", "side"])


# nearest neighbours: points of a snapshot against its cells

GAP = "sqrt((p.x - c.x)*(p.x - c.x) + (p.y - c.y)*(p.y - c.y) + (p.z - c.z)*(p.z - c.z))"
KNN = """SELECT snapshot_id, pid, rank, cell_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, pid ORDER BY distance, cell_id) AS rank FROM (
    SELECT p.snapshot_id, p.pid, c.cell_id, {gap} AS distance FROM points p JOIN cells c ON p.snapshot_id = c.snapshot_id) a) b WHERE rank <= {k}"""


@query("knn_join", with_views("points", "cells", more={"k": KNN.format(gap=GAP, k=30)}, final=f"SELECT snapshot_id, pid, {big(rank='rank')}, cell_id, {r6(distance='distance')} FROM k"))
def knn_join(d):
    return rs.knn_join(d.points, d.cells, 30)


@query("resample_nearest", with_views("points", "cells", more={"k": KNN.format(gap=GAP, k=1)}, final=f"SELECT snapshot_id, pid, cell_id, {r6(b_x='b_x', rho='rho')} FROM k JOIN cells USING (snapshot_id, cell_id)"))
def resample_nearest(d):
    return rs.resample_nearest(d.points, d.cells, ["b_x", "rho"])


SHIFT = ("1e0", "(c.x - p.x)", "(c.y - p.y)", "(c.z - p.z)")
SUMS = {f"n{i}{j}": f"sum(w*a{i}*a{j})" for i in range(4) for j in range(i, 4)} | {f"rho_{i}": f"sum(w*a{i}*rho)" for i in range(4)}


@query("mls_normal", with_views("points", "cells", more={"k": KNN.format(gap=GAP, k=30), "h": "SELECT snapshot_id, pid, greatest(avg(distance), 1e-30) AS h FROM k GROUP BY snapshot_id, pid",
    "t": "SELECT k.snapshot_id, k.pid, exp(-power(k.distance/h.h, 2)) AS w, c.rho, " + ", ".join(f"{e} AS a{i}" for i, e in enumerate(SHIFT)) + """ FROM k
    JOIN h ON k.snapshot_id = h.snapshot_id AND k.pid = h.pid JOIN points p ON p.pid = k.pid JOIN cells c ON c.cell_id = k.cell_id"""},
    final=f"SELECT snapshot_id, pid, {r6(**SUMS)} FROM t GROUP BY snapshot_id, pid"))
def mls_normal(d):
    return rs.mls_normal(d.points, d.cells, ["rho"], 30)


LINEAR = {"b_x": "3e-1 + 5e-1*x - 2e-1*y + 1e-1*z", "b_y": "-7e-1 + 4e-1*y - 3e-1*z", "b_z": "11e-1 + 2e-1*x + 1e-1*y - 6e-1*z"}


@query("mls_fit", with_views("points", "cells", final=f"SELECT p.snapshot_id, p.pid, {r6(**LINEAR)} FROM points p WHERE p.snapshot_id IN (SELECT snapshot_id FROM cells)"))
def mls_fit(d):
    """The cells' field is linear in position, so the fit must return it everywhere (to the size of its ridge)."""
    fit = rs.mls_fit(d.points, d.cells, B, 30).join(d.points.select("pid", "x", "y", "z"), "pid")
    return fit.select("snapshot_id", "pid", *[snapped(F.col(c), F.expr(e), 1e-5).alias(c) for c, e in LINEAR.items()])


# trilinear on native axes: the nodes of the volume serve as a structured solution


def structured(d: Inputs, value: str) -> StructuredBlock:
    from heliospark.sources.structured import block_of

    return block_of(d.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "r", "theta", "phi", F.col(value).alias("value")))


LR = "CAST(least(floor(fr), 3) AS BIGINT)"
LTT = "CAST(least(floor(greatest(least(ft, 14e0), 0e0)), 13) AS BIGINT)"
TRI = {"s": q.spherical("points", KEEP), "i": q.index("s", KEEP), "base": f"""SELECT snapshot_id, pid, {LR} AS a, {LTT} AS b, CAST(floor(fp) AS BIGINT) AS c,
    (r - power(25e-1, {LR}/4e0))/(power(25e-1, ({LR} + 1)/4e0) - power(25e-1, {LR}/4e0)) AS u, greatest(least(ft, 14e0), 0e0) - {LTT} AS v, fp - floor(fp) AS w FROM i""",
    "eight": """SELECT snapshot_id, pid, a + i.d AS i_r, b + j.d AS i_t, (c + k.d) % 20 AS i_p,
    (CASE i.d WHEN 0 THEN 1e0 - u ELSE u END)*(CASE j.d WHEN 0 THEN 1e0 - v ELSE v END)*(CASE k.d WHEN 0 THEN 1e0 - w ELSE w END) AS wt FROM base
    CROSS JOIN (SELECT CAST(range AS BIGINT) AS d FROM range(2)) i CROSS JOIN (SELECT CAST(range AS BIGINT) AS d FROM range(2)) j CROSS JOIN (SELECT CAST(range AS BIGINT) AS d FROM range(2)) k"""}


@query("resample_structured", with_views("points", "nodes", more=TRI, final=f"SELECT e.snapshot_id, e.pid, {r6(value='sum(wt*n.ne)')} FROM eight e JOIN nodes n USING (snapshot_id, i_r, i_t, i_p) GROUP BY e.snapshot_id, e.pid"))
def resample_structured(d):
    return rs.resample_structured(d.points, structured(d, "ne"), ["value"], ID)


# one-dimensional lookups


@query("interp_table", with_views("points", "paths", more={"curve": "SELECT snapshot_id, seq AS k, avg(x*x + z) AS v FROM paths GROUP BY snapshot_id, seq",
    "want": "SELECT snapshot_id, pid, r*4e1 - 5e1 AS t FROM points", "lim": "SELECT snapshot_id, min(k) AS lo, max(k) AS hi FROM curve GROUP BY snapshot_id",
    "pos": "SELECT a.snapshot_id, a.pid, greatest(least(a.t, CAST(hi AS DOUBLE)), CAST(lo AS DOUBLE)) AS t, CAST(least(floor(greatest(least(a.t, CAST(hi AS DOUBLE)), CAST(lo AS DOUBLE))), hi - 1) AS BIGINT) AS j FROM want a JOIN lim USING (snapshot_id)"},
    final=f"SELECT p.snapshot_id, p.pid, {r6(value='a.v + (p.t - p.j)*(b.v - a.v)')} FROM pos p JOIN curve a ON a.snapshot_id = p.snapshot_id AND a.k = p.j JOIN curve b ON b.snapshot_id = p.snapshot_id AND b.k = p.j + 1"))
def interp_table_(d):
    curve = d.paths.groupBy("snapshot_id", F.col("seq").alias("k")).agg(F.avg(F.col("x") * F.col("x") + F.col("z")).alias("v"))
    at = d.points.select("snapshot_id", "pid", "r")
    return interp_table(at, curve, F.col("r") * 40.0 - 50.0, "k", "v", "value").drop("r")


@query("interp_coefficients", with_views("points", more={"coef": q.coefficient_table(), "got": q.table_read("points", "pid")}, final=f"SELECT pid, {r6(c_tan='c_tan', c_pol='c_pol')} FROM got"))
def interp_coefficients(d):
    c_tan, c_pol = rad.table_lookup(F.col("r"), 1.0, 2.5, 0.6, 10.0)
    return d.points.select("pid", c_tan.alias("c_tan"), c_pol.alias("c_pol"))
