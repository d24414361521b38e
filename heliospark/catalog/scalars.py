"""Row generators and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark.catalog import sql as q
from heliospark.catalog.inputs import CAMERA, GRID, Inputs, big, query, r6, with_views, xyz
from heliospark.functions import fields as fx
from heliospark.functions import geometry as g
from heliospark.functions import imaging as im
from heliospark.functions import radiation as rad
from heliospark.functions.camera import Camera
from heliospark.functions.grid import GridSpec, index_columns, keys_slopes, keys_weights, voxel_bin
from heliospark.operators import generators as gen
from heliospark.operators import lines as ln

DIPOLE = fx.DipoleField()
TILTED = Camera.from_sub_observer(30.0, 20.0, 35.0, fov=6.0, height=24, width=24)


def named(columns, names: str):
    return [c.alias(n) for c, n in zip(columns, names.split())]


# generators

@query("gen_grid_nodes", with_views("snapshots", final=f"""
    SELECT snapshot_id, node_id, i_r, i_t, i_p, {r6(r='r', theta='theta', phi='phi', x='r*sin(theta)*cos(phi)', y='r*sin(theta)*sin(phi)', z='r*cos(theta)')}
    FROM (SELECT *, power(25e-1, i_r/4e0) AS r, (i_t + 5e-1)*pi()/15e0 AS theta, i_p*pi()/10e0 AS phi
          FROM (SELECT snapshot_id, id AS node_id, CAST(floor(id/300e0) AS BIGINT) AS i_r, CAST(floor((id % 300)/20e0) AS BIGINT) AS i_t, id % 20 AS i_p
                FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(1500)) t) a) b"""))
def gen_grid_nodes(d: Inputs):
    return gen.grid_nodes(d.snapshots, GRID)


def _lonlat(radius: str) -> str:
    return with_views("snapshots", final=f"""
    SELECT snapshot_id, i_t, i_p, seed_id, {r6(theta='theta', phi='phi', x=f'{radius}*sin(theta)*cos(phi)', y=f'{radius}*sin(theta)*sin(phi)', z=f'{radius}*cos(theta)')}
    FROM (SELECT snapshot_id, id AS seed_id, CAST(floor(id/24e0) AS BIGINT) AS i_t, id % 24 AS i_p,
                 (floor(id/24e0) + 5e-1)*pi()/12e0 AS theta, (id % 24 + 5e-1)*pi()/12e0 AS phi
          FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(288)) t) a""")


@query("gen_lonlat", _lonlat("(1e0*(1e0 + 1e-9))"))
def gen_lonlat(d):
    return gen.lonlat_points(d.snapshots, 12, 24, 1.0, nudge=True)


@query("gen_lonlat_shell", _lonlat("18e-1"))
def gen_lonlat_shell(d):
    return gen.lonlat_points(d.snapshots, 12, 24, 1.8, nudge=False)


FIB = """SELECT snapshot_id, seed_id, sqrt(1e0 - power(1e0 - (2e0*seed_id + 1e0)/{n}e0, 2))*cos(seed_id*(pi()*(3e0 - sqrt(5e0))))*(1e0 + 1e-9) AS x,
    sqrt(1e0 - power(1e0 - (2e0*seed_id + 1e0)/{n}e0, 2))*sin(seed_id*(pi()*(3e0 - sqrt(5e0))))*(1e0 + 1e-9) AS y,
    (1e0 - (2e0*seed_id + 1e0)/{n}e0)*(1e0 + 1e-9) AS z FROM snapshots, (SELECT CAST(range AS BIGINT) AS seed_id FROM range({n})) t"""


@query("gen_fibonacci", with_views("snapshots", more={"f": FIB.format(n=500)}, final=f"SELECT snapshot_id, seed_id, {r6(x='x', y='y', z='z')} FROM f"))
def gen_fibonacci(d):
    return gen.fibonacci_seeds(d.snapshots, 500, 1.0)


@query("gen_sphere_seeds", with_views("snapshots", final=f"""
    SELECT snapshot_id, i_t, i_p, seed_id, {r6(x='25e-1*(1e0 - 1e-9)*sin(theta)*cos(phi)', y='25e-1*(1e0 - 1e-9)*sin(theta)*sin(phi)', z='25e-1*(1e0 - 1e-9)*cos(theta)')}
    FROM (SELECT snapshot_id, id AS seed_id, CAST(floor(id/24e0) AS BIGINT) AS i_t, id % 24 AS i_p,
                 (floor(id/24e0) + 5e-1)*pi()/12e0 AS theta, (id % 24)*pi()/12e0 AS phi
          FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(288)) t) a"""))
def gen_sphere_seeds(d):
    return gen.sphere_seeds(d.snapshots, 2.5, 12, 24, 1.0, 2.5)


RING = """SELECT snapshot_id, seed_id, 0e0 AS x, cos(2e0*pi()*seed_id/{n}e0)*(1e0 + 1e-9) AS y, sin(2e0*pi()*seed_id/{n}e0)*(1e0 + 1e-9) AS z
    FROM snapshots, (SELECT CAST(range AS BIGINT) AS seed_id FROM range({n})) t"""


@query("gen_limb_ring", with_views("snapshots", more={"f": RING.format(n=90)}, final=f"SELECT snapshot_id, seed_id, {r6(x='x', y='y', z='z')} FROM f"))
def gen_limb_ring(d):
    return gen.limb_ring(d.snapshots, 90, 1.0, CAMERA)


@query("gen_view_seeds", with_views("snapshots", more={"f": FIB.format(n=400), "k": RING.format(n=90)}, final=f"""
    SELECT snapshot_id, seed_id, {r6(x='x', y='y', z='z')}, 'front' AS part FROM f WHERE x > 0
    UNION ALL SELECT snapshot_id, seed_id + 400, {r6(x='x', y='y', z='z')}, 'ring' AS part FROM k"""))
def gen_view_seeds(d):
    return gen.view_seeds(d.snapshots, CAMERA, 1.0, 400, 90)


@query("gen_pixels", with_views("snapshots", more={"pix": q.pixels()}, final=f"""
    SELECT snapshot_id, pixel_id, prow, pcol, {r6(px='px', py='py', rho='rho', ox='ox', oy='oy', oz='oz')} FROM pix"""))
def gen_pixels(d):
    return gen.pixels(d.snapshots, CAMERA)


@query("gen_los_samples", with_views("snapshots", more={"pix": q.pixels(), "smp": q.samples(inside=False)}, final=f"""
    SELECT snapshot_id, pixel_id, k, {r6(s='s', x='x', y='y', z='z', r='r')} FROM smp"""))
def gen_los_samples(d):
    rows = gen.los_samples(gen.pixels(d.snapshots, CAMERA), CAMERA, 2.5, 0.1)
    return rows.select("snapshot_id", "pixel_id", "k", "s", "x", "y", "z", "r")


# coordinates

SPH = with_views("points", more={"s": q.spherical("points", "pid")}, final="{}")


@query("cart_to_sph", SPH.format(f"SELECT pid, {r6(r='r', theta='theta', phi='phi')} FROM s"))
def cart_to_sph(d):
    return d.points.select("pid", *named(g.cart_to_sph(*xyz()), "r theta phi"))


@query("sph_to_cart", with_views("points", final=f"SELECT pid, {r6(x='x', y='y', z='z')} FROM points"))
def sph_to_cart(d):
    return d.points.select("pid", *named(g.sph_to_cart(F.col("r"), F.col("theta"), F.col("phi")), "x y z"))


@query("coord_jacobian", with_views("points", final=f"""SELECT pid, {r6(
    j_00='sin(theta)*cos(phi)', j_01='sin(theta)*sin(phi)', j_02='cos(theta)', j_10='cos(theta)*cos(phi)/r', j_11='cos(theta)*sin(phi)/r',
    j_12='-sin(theta)/r', j_20='-sin(phi)/(r*sin(theta))', j_21='cos(phi)/(r*sin(theta))', j_22='0e0')} FROM points"""))
def coord_jacobian(d):
    rows = g.coord_jacobian(*xyz())
    return d.points.select("pid", *[rows[i][j].alias(f"j_{i}{j}") for i in range(3) for j in range(3)])


VEC = dict(r='v0*sin(theta)*cos(phi) + v1*sin(theta)*sin(phi) + v2*cos(theta)', t='v0*cos(theta)*cos(phi) + v1*cos(theta)*sin(phi) - v2*sin(theta)', p='-v0*sin(phi) + v1*cos(phi)')
CAR = dict(x='v0*sin(theta)*cos(phi) + v1*cos(theta)*cos(phi) - v2*sin(phi)', y='v0*sin(theta)*sin(phi) + v1*cos(theta)*sin(phi) + v2*cos(phi)', z='v0*cos(theta) - v1*sin(theta)')
V3 = "(SELECT *, v/1e5 AS v0, 1e0 - v/1e5 AS v1, v/3e5 AS v2 FROM points) a"
def components():
    return F.col("v") / 1e5, 1.0 - F.col("v") / 1e5, F.col("v") / 3e5


@query("vec_cart_to_sph", with_views("points", final=f"SELECT pid, {r6(v_r=VEC['r'], v_t=VEC['t'], v_p=VEC['p'])} FROM {V3}"))
def vec_cart_to_sph(d):
    return d.points.select("pid", *named(g.vec_cart_to_sph(*components(), *xyz()), "v_r v_t v_p"))


@query("vec_sph_to_cart", with_views("points", final=f"SELECT pid, {r6(v_x=CAR['x'], v_y=CAR['y'], v_z=CAR['z'])} FROM {V3}"))
def vec_sph_to_cart(d):
    return d.points.select("pid", *named(g.vec_sph_to_cart(*components(), *xyz()), "v_x v_y v_z"))


@query("vec_file_angles", with_views("points", final=f"""SELECT pid, {r6(b_x=CAR['x'], b_y=CAR['y'], b_z=CAR['z'])}
    FROM (SELECT pid, v0, v1, v2, phi, theta*11e-1 - 1e-1 AS theta FROM {V3}) b"""))
def vec_file_angles(d):
    theta = F.col("theta") * 1.1 - 0.1
    return d.points.select("pid", *named(g.vec_file_angles(*components(), theta, F.col("phi")), "b_x b_y b_z"))


# grid maps

LAWS = [GridSpec(5, 15, 20, 1.0, 2.5, law) for law in ("logarithmic", "power", "uniform")]


@query("spacing_law", with_views("points", final="\nUNION ALL ".join(
    f"SELECT pid, '{law}' AS law, {r6(u=u, radius=rad_, slope=s)} FROM points" for law, u, rad_, s in (
        ("logarithmic", "ln(r)/ln(25e-1)", "power(25e-1, (r - 1e0)/15e-1)", "power(25e-1, (r - 1e0)/15e-1)*ln(25e-1)"),
        ("power", "(sqrt(r) - 1e0)/(sqrt(25e-1) - 1e0)", "power(1e0 + (sqrt(25e-1) - 1e0)*(r - 1e0)/15e-1, 2)",
         "2e0*(1e0 + (sqrt(25e-1) - 1e0)*(r - 1e0)/15e-1)*(sqrt(25e-1) - 1e0)"),
        ("uniform", "(r - 1e0)/15e-1", "1e0 + 15e-1*((r - 1e0)/15e-1)", "15e-1")))))
def spacing_law(d):
    t = (F.col("r") - 1.0) / 1.5
    rows = [
        F.struct(F.lit(s.spacing).alias("law"), s.parameter(F.col("r")).alias("u"), s.radius(t).alias("radius"), s.radius_slope(t).alias("slope"))
        for s in LAWS
    ]
    return d.points.select("pid", F.explode(F.array(*rows)).alias("e")).select("pid", "e.*")


IDX = with_views("points", more={"s": q.spherical("points", "pid"), "i": q.index("s", "pid")}, final="{}")


@query("index_map", IDX.format(f"SELECT pid, {r6(fr='fr', ft='ft', fp='fp', d_r='4e0/(r*ln(25e-1))', d_t='15e0/pi()', d_p='10e0/pi()')} FROM i"))
def index_map(d):
    slope = GRID.index_slope(F.col("r"))
    return d.points.select("pid", *named(index_columns(GRID, *xyz()), "fr ft fp"), slope[0].alias("d_r"), F.lit(slope[1]).alias("d_t"), F.lit(slope[2]).alias("d_p"))


CELL = "least(r*ln(25e-1)/4e0, r*pi()/15e0, greatest(r*sin(theta)*pi()/10e0, r*pi()/15e0))"


@query("cell_extent", with_views("points", final=f"SELECT pid, {r6(cell=CELL)} FROM points"))
def cell_extent(d):
    return d.points.select("pid", GRID.cell_extent(F.col("r"), F.col("theta")).alias("cell"))


VOXEL = "(least(greatest(floor(fr), 0), 4)*15 + least(greatest(floor(ft), 0), 14))*20 + floor(fp) % 20"


@query("voxel_bin", IDX.format(f"SELECT pid, {big(voxel=VOXEL)} FROM i"))
def voxel_bin_(d):
    return d.points.select("pid", voxel_bin(GRID, *xyz()).alias("voxel"))


CELL_R = "sqrt(x*x + y*y + z*z)"


@query("in_domain", with_views("cells", final=f"SELECT cell_id, {CELL_R} >= 1e0 AND {CELL_R} <= 25e-1 AS inside FROM cells"))
def in_domain(d):
    return d.cells.select("cell_id", g.in_shell(g.norm(*xyz()), 1.0, 2.5).alias("inside"))


@query("require_interior", with_views("points", final="SELECT snapshot_id, count(*) AS n_inside FROM points GROUP BY snapshot_id"))
def require_interior(d):
    from heliospark.operators.lines import check_seeds

    checked = check_seeds(d.points, 1.0, 2.5)
    return checked.groupBy("snapshot_id").agg(F.count("x").alias("n_inside"))


KEPT = f"greatest(least({CELL_R}, 25e-1*(1e0 - 1e-9)), 1e0*(1e0 + 1e-9))/{CELL_R}"


@query("clip_radius", with_views("cells", final=f"SELECT cell_id, {r6(x=f'x*{KEPT}', y=f'y*{KEPT}', z=f'z*{KEPT}')} FROM cells"))
def clip_radius(d):
    return d.cells.select("cell_id", *named(g.clip_radius(*xyz(), 1.0, 2.5), "x y z"))


@query("radial_distance", with_views("cells", final=f"SELECT cell_id, {r6(r=CELL_R)} FROM cells"))
def radial_distance(d):
    return d.cells.select("cell_id", g.norm(*xyz()).alias("r"))


# the observer stands over longitude 30 and latitude 20 degrees; east and north there, then turned by a roll of 35 degrees
SKY = """SELECT *, x*cos(la)*cos(lo) + y*cos(la)*sin(lo) + z*sin(la) AS toward, y*cos(lo) - x*sin(lo) AS east,
    z*cos(la) - x*sin(la)*cos(lo) - y*sin(la)*sin(lo) AS north
    FROM points, (SELECT radians(3e1) AS lo, radians(2e1) AS la, radians(35e0) AS turn) a"""


@query("project_points", with_views("points", more={"sky": SKY}, final=f"""SELECT pid, {r6(pcol='(east*cos(turn) - north*sin(turn))/25e-2 + 115e-1',
    prow='115e-1 - (east*sin(turn) + north*cos(turn))/25e-2', depth='toward')} FROM sky"""))
def project_points(d):
    return d.points.select("pid", *named(TILTED.project(*xyz()), "pcol prow depth"))


# closed-form field

M, BG = "(15625e-3/3225e-2)", "(1e0/3225e-2)"
DIP = {"x": f"3e0*{M}*z*x/power(r, 5)", "y": f"3e0*{M}*z*y/power(r, 5)", "z": f"(3e0*{M}*z*z/power(r, 5) - {M}/power(r, 3) + {BG})"}


def _jac(i: int, j: int) -> str:
    a, b = "xyz"[i], "xyz"[j]
    lead = [f"{a}" if j == 2 else "", "z" if i == j else "", f"{b}" if i == 2 else ""]
    total = " + ".join(t for t in lead if t) or "0e0"
    return f"(3e0*{M}*({total})/power(r, 5) - 15e0*{M}*z*{a}*{b}/power(r, 7))"


JAC = {f"j_{i}{j}": _jac(i, j) for i in range(3) for j in range(3)}
DIPOLE_STEP = {"dip": "SELECT pid, r, theta, x, y, z, " + ", ".join(f"{e} AS b_{c}" for c, e in DIP.items()) + ", " + ", ".join(f"{e} AS {n}" for n, e in JAC.items()) + " FROM points"}


@query("dipole_field", with_views("points", more=DIPOLE_STEP, final=f"SELECT pid, {r6(**{n: n for n in ('b_x', 'b_y', 'b_z', *JAC)})} FROM dip"))
def dipole_field(d):
    rows = DIPOLE.jacobian(*xyz())
    return d.points.select("pid", *named(DIPOLE.b(*xyz()), "b_x b_y b_z"), *[rows[i][j].alias(f"j_{i}{j}") for i in range(3) for j in range(3)])


FLUX = "(r*r + 3125e-2/r)"


@query("dipole_flux", with_views("points", final=f"SELECT pid, {r6(flux=f'{FLUX}*sin(theta)*sin(theta)')} FROM points"))
def dipole_flux(d):
    return d.points.select("pid", DIPOLE.flux(*xyz()).alias("flux"))


@query("dipole_separatrix", with_views("points", final=f"SELECT pid, {r6(theta=f'asin(sqrt(1875e-2/{FLUX}))')} FROM points"))
def dipole_separatrix(d):
    return d.points.select("pid", DIPOLE.separatrix(F.col("r")).alias("theta"))


FOOT2 = f"least(sin(theta)*sin(theta)*{FLUX}/3225e-2, 1e0)"
EDGE2 = "(1875e-2/3225e-2)"
STRETCH = f"(625e-2/{EDGE2}*(3e0/3225e-2)*sqrt(greatest(1e0 - foot2/{EDGE2}, 0e0))/sqrt(1e0 - foot2 + power(14625e-3/3225e-2, 2)*foot2))"


@query("dipole_q_exact", with_views("points", more={"f": f"SELECT pid, {FOOT2} AS foot2 FROM points"}, final=f"""
    SELECT pid, {r6(q=f'CASE WHEN asin(sqrt(foot2)) < asin(sqrt({EDGE2})) THEN {STRETCH} + 1e0/nullif({STRETCH}, 0e0) ELSE 2e0 END')} FROM f"""))
def dipole_q_exact(d):
    return d.points.select("pid", DIPOLE.q_exact(F.col("theta"), F.col("r")).alias("q"))


@query("characteristic_length", with_views("points", final=f"SELECT pid, {r6(grid=CELL, closed_form='2e-2*15e-1')} FROM points"))
def characteristic_length(d):
    return d.points.select("pid", GRID.cell_extent(F.col("r"), F.col("theta")).alias("grid"), F.lit(DIPOLE.characteristic_length()).alias("closed_form"))


@query("reference_strength", with_views("nodes", more={"pad": q.padded(["b_x", "b_y", "b_z"])}, final=f"SELECT snapshot_id, {r6(b_max='max(sqrt(b_x*b_x + b_y*b_y + b_z*b_z))')} FROM pad GROUP BY snapshot_id"))
def reference_strength(d):
    from heliospark.operators.lines import reference_strength as op

    return op(d.field_nodes, GRID)


# deviation algebra

MAG = "sqrt(b_x*b_x + b_y*b_y + b_z*b_z)"
UG = {"n": f"SELECT *, {MAG} AS m, b_x/{MAG} AS h_0, b_y/{MAG} AS h_1, b_z/{MAG} AS h_2 FROM dip",
      "al": "SELECT *, " + ", ".join(f"h_0*j_0{j} + h_1*j_1{j} + h_2*j_2{j} AS a_{j}" for j in range(3)) + " FROM n",
      "gr": "SELECT pid, " + ", ".join(f"(j_{i}{j} - h_{i}*a_{j})/m AS g_{i}{j}" for i in range(3) for j in range(3)) + " FROM al"}


@query("unit_gradient", with_views("points", more=DIPOLE_STEP | UG, final=f"SELECT pid, {r6(**{f'g_{i}{j}': f'g_{i}{j}' for i in range(3) for j in range(3)}, **{f'd_{i}': f'g_{i}0*1e0 + g_{i}1*2e0 - g_{i}2' for i in range(3)})} FROM gr"))
def unit_gradient(d):
    rows = DIPOLE.jacobian(*xyz())
    df = d.points.select("pid", *named(DIPOLE.b(*xyz()), "b_x b_y b_z"), *[rows[i][j].alias(f"j_{i}{j}") for i in range(3) for j in range(3)])
    df = ln.with_unit_gradient(df)
    grad = [[F.col(f"g_{i}{j}") for j in range(3)] for i in range(3)]
    moved = fx.advect(grad, (F.lit(1.0), F.lit(2.0), F.lit(-1.0)))
    return df.select("pid", *[F.col(f"g_{i}{j}") for i in range(3) for j in range(3)], *named(moved, "d_0 d_1 d_2"))


BASIS = {"n": f"SELECT pid, b_x/{MAG} AS h_0, b_y/{MAG} AS h_1, b_z/{MAG} AS h_2 FROM dip",
         "ax": """SELECT *, CASE WHEN abs(h_0) <= abs(h_1) AND abs(h_0) <= abs(h_2) THEN 0 WHEN abs(h_1) <= abs(h_2) THEN 1 ELSE 2 END AS a FROM n""",
         "raw": "SELECT *, " + ", ".join(f"CASE WHEN a = {k} THEN 1e0 ELSE 0e0 END - (CASE a WHEN 0 THEN h_0 WHEN 1 THEN h_1 ELSE h_2 END)*h_{k} AS r_{k}" for k in range(3)) + " FROM ax",
         "un": "SELECT *, " + ", ".join(f"r_{k}/sqrt(r_0*r_0 + r_1*r_1 + r_2*r_2) AS u_{k}" for k in range(3)) + " FROM raw"}


@query("seed_basis", with_views("points", more=DIPOLE_STEP | BASIS, final=f"SELECT pid, {r6(u_x='u_0', u_y='u_1', u_z='u_2', w_x='h_1*u_2 - h_2*u_1', w_y='h_2*u_0 - h_0*u_2', w_z='h_0*u_1 - h_1*u_0')} FROM un"))
def seed_basis(d):
    df = ln.with_seed_basis(ln.attach_b(d.points, DIPOLE, ["pid"]))
    return df.select("pid", "u_x", "u_y", "u_z", "w_x", "w_y", "w_z")


SLIDE = "((d_0*x + d_1*y + d_2*z)/(b_x*x + b_y*y + b_z*z))"
SAFE = "abs(b_x*x + b_y*y + b_z*z) > 1e-3"


@query("reproject", with_views("points", more=DIPOLE_STEP | {"dv": "SELECT *, 1e0 AS d_0, 2e0 AS d_1, -1e0 AS d_2 FROM dip"}, final=f"""
    SELECT pid, {r6(**{f'd_{c}': f'CASE WHEN {SAFE} THEN d_{k} - {SLIDE}*b_{c} END' for k, c in enumerate('xyz')})} FROM dv"""))
def reproject(d):
    b = DIPOLE.b(*xyz())
    out = fx.reproject((F.lit(1.0), F.lit(2.0), F.lit(-1.0)), b, xyz())
    safe = F.abs(g.dot(b, xyz())) > 1e-3
    return d.points.select("pid", *[F.when(safe, c).alias(f"d_{n}") for c, n in zip(out, "xyz")])


def _dots(a, b):
    return "(" + " + ".join(f"{p}*{s}" for p, s in zip(a, b)) + ")"


AF, BF, AB, BB = ("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"), ("v/1e5", "x", "1e0")


@query("master_formula", with_views("points", final=f"""SELECT pid, {r6(q=f"(v/1e5)/(r*r)*({_dots(AF, AF)}*{_dots(BB, BB)} + {_dots(AB, AB)}*{_dots(BF, BF)} - 2e0*{_dots(AF, BF)}*{_dots(AB, BB)})")} FROM points"""))
def master_formula(d):
    v = F.col("v") / 1e5
    q_ = fx.master_formula(xyz(), (F.col("y"), F.col("z"), F.col("x")), (F.col("z"), F.col("x"), F.col("y")), (v, F.col("x"), F.lit(1.0)), v, F.col("r") * F.col("r"))
    return d.points.select("pid", q_.alias("q"))


def _slid(dev, b, n):
    """Reprojected vector as three SQL expressions."""
    s = f"({_dots(dev, n)}/{_dots(b, n)})"
    return [f"({dev[k]} - {s}*{b[k]})" for k in range(3)]


def _q_sql() -> str:
    fb, ff = [f"foot_b_{c}" for c in "xyz"], [f"foot_f_{c}" for c in "xyz"]
    bb, bf = [f"bb_{c}" for c in "xyz"], [f"bf_{c}" for c in "xyz"]
    ub, wb, uf, wf = ([f"{n}_{c}" for c in "xyz"] for n in ("ub", "wb", "uf", "wf"))
    out = []
    for nb, nf, pre in ((bb, bf, f"sqrt({_dots(bf, bf)})*sqrt({_dots(bb, bb)})"),
                        (fb, ff, f"abs({_dots(bf, ff)}/sqrt({_dots(ff, ff)})*{_dots(bb, fb)}/sqrt({_dots(fb, fb)}))")):
        a, b_, c, e = _slid(uf, bf, nf), _slid(wf, bf, nf), _slid(ub, bb, nb), _slid(wb, bb, nb)
        out.append(f"{pre}*({_dots(a, a)}*{_dots(e, e)} + {_dots(c, c)}*{_dots(b_, b_)} - 2e0*{_dots(a, b_)}*{_dots(c, e)})")
    return r6(q_perp=f"CASE WHEN ok THEN {out[0]} END", q=f"CASE WHEN ok THEN {out[1]} END")


def _mixed(n: int) -> str:
    """Invented but smooth foot field and deviations of a line, from its feet."""
    cols = []
    for side in "bf":
        x, y, z = (f"foot_{side}_{c}" for c in "xyz")
        cols += [f"{x}*2e0 + {y}*3e-1 AS b{side}_x", f"{y}*2e0 - {x}*3e-1 AS b{side}_y", f"{z}*15e-1 AS b{side}_z",
                 f"{y} AS u{side}_x", f"{z} AS u{side}_y", f"{x} + 1e0 AS u{side}_z", f"{z} - 1e0 AS w{side}_x", f"{x} AS w{side}_y", f"{y} AS w{side}_z"]
    return f"SELECT line_id, end_b IN (0, 1) AND end_f IN (0, 1) AS ok, foot_b_x, foot_b_y, foot_b_z, foot_f_x, foot_f_y, foot_f_z, {', '.join(cols)} FROM lines"


@query("assemble_q", with_views("lines", more={"m": _mixed(0)}, final=f"SELECT line_id, {_q_sql()} FROM m"))
def assemble_q(d):
    df = d.lines
    for s in "bf":
        x, y, z = (F.col(f"foot_{s}_{c}") for c in "xyz")
        new = {f"b_{s}_x": x * 2.0 + y * 0.3, f"b_{s}_y": y * 2.0 - x * 0.3, f"b_{s}_z": z * 1.5}
        new |= {f"u_{s}_x": y, f"u_{s}_y": z, f"u_{s}_z": x + 1.0, f"w_{s}_x": z - 1.0, f"w_{s}_y": x, f"w_{s}_z": y}
        df = df.withColumns(new)
    return ln.assemble(df.withColumn("b0", F.lit(1.0))).select("line_id", "q_perp", "q")


@query("safe_log10", with_views("points", final=f"SELECT pid, {r6(log_q='CASE WHEN v - 15e4 > 0 THEN log10(v - 15e4) END')} FROM points"))
def safe_log10(d):
    return d.points.select("pid", fx.safe_log10(F.col("v") - 150000.0).alias("log_q"))


@query("mass_to_electron", with_views("cells", final=f"SELECT cell_id, {r6(ne='rho/127e-2')} FROM cells"))
def mass_to_electron(d):
    return d.cells.select("cell_id", (F.col("rho") / rad.MEAN_MOLECULAR_WEIGHT).alias("ne"))


# scattering, weights, colours

WIDE = "(1e0 + v/25e3)"
CLOSED, T2 = q.minnaert(WIDE), f"power(asin(1e0/{WIDE}), 2)"
FAR = {"a": f"{T2} - 5e0/6e0*{T2}*{T2}", "b": f"2e0/3e0*{T2} - 22e0/45e0*{T2}*{T2}", "c": f"{T2} - {T2}*{T2}/3e0", "d": f"2e0/3e0*{T2} - 2e0/9e0*{T2}*{T2}"}
COEF = {k: f"CASE WHEN {WIDE} >= 1e1 THEN {FAR[k]} ELSE {CLOSED[k]} END" for k in "abcd"}


@query("thomson_coeffs", with_views("points", more={"m": "SELECT pid, " + ", ".join(f"{e} AS {k}" for k, e in COEF.items()) + " FROM points"},
    final=f"SELECT pid, {r6(a='a', b='b', c='c', d='d', c_tan='4e-1*c + 6e-1*d', c_pol='4e-1*a + 6e-1*b')} FROM m"))
def thomson_coeffs(d):
    r = 1.0 + F.col("v") / 25e3
    return d.points.select("pid", *named(rad.minnaert(r), "a b c d"), *named(rad.intensity_coefficients(r), "c_tan c_pol"))


CT, CP = q.coefficients("r")


@query("thomson_intensity", with_views("points", final=f"SELECT pid, {r6(total=f'2e0*{CT} - {CP}*sin(theta)*sin(theta)', polarized=f'{CP}*sin(theta)*sin(theta)')} FROM points"))
def thomson_intensity(d):
    rho = F.col("r") * F.sin("theta")
    c = rad.intensity_coefficients(F.col("r"))
    return d.points.select("pid", *[rad.thomson_intensity(rho, F.col("r"), *c, m).alias(n) for m, n in (("K", "total"), ("pB", "polarized"))])


@query("channel_weights", with_views("points", more={"w": f"SELECT pid, {q.weights()}, " + ", ".join(f"exp(-r/({h}e0/6957e-1)) AS n_{k}" for k, h in enumerate((21, 84, 140))) + " FROM (SELECT pid, r, z AS s FROM points) a"},
    final=f"SELECT pid, {r6(**{c: c for c in ('w_0', 'w_1', 'w_2', 'n_0', 'n_1', 'n_2')})} FROM w"))
def channel_weights(d):
    wide, near = im.LARGE_FOV.weights(F.col("z"), F.col("r")), im.SMALL_FOV.weights(F.col("z"), F.col("r"))
    return d.points.select("pid", *named(wide, "w_0 w_1 w_2"), *named(near, "n_0 n_1 n_2"))


RHO = "sqrt(y*y + z*z)"


@query("occult_mask", with_views("points", final=f"SELECT pid, {RHO} < 12e-1 AND x < -sqrt(greatest(144e-2 - {RHO}*{RHO}, 0e0)) AS hidden FROM points"))
def occult_mask(d):
    return d.points.select("pid", im.occulted(F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.col("x"), 1.2).alias("hidden"))


@query("eclipse_alpha", with_views("points", final=f"SELECT pid, {r6(soft=q.alpha(RHO, '1e0', '3e-1'), hard=f'CASE WHEN {RHO} >= 1e0 THEN 1e0 ELSE 0e0 END')} FROM points"))
def eclipse_alpha(d):
    rho = F.sqrt(F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return d.points.select("pid", im.eclipse_alpha(rho, 1.0, 0.3).alias("soft"), im.eclipse_alpha(rho, 1.0, 0.0).alias("hard"))


def _ramp_sql(t: str, stops, c: int) -> str:
    n = len(stops) - 1
    parts = [f"WHEN {t} < {k + 1} THEN {stops[k][c]}e0 + ({stops[k + 1][c]}e0 - {stops[k][c]}e0)*({t} - {k})" for k in range(n - 1)]
    k = n - 1
    return f"CASE {' '.join(parts)} ELSE {stops[k][c]}e0 + ({stops[k + 1][c]}e0 - {stops[k][c]}e0)*({t} - {k}) END"


SIGNED = "(v/25e4 - 1e0)"
T1 = f"(greatest(least({SIGNED}, 1e0), -1e0) + 1e0)"
RGB = ("red", "green", "blue")


@query("colour_ramp", with_views("points", final=f"""SELECT pid, {r6(**{f'pol_{n}': _ramp_sql(T1, im.POLARITY_STOPS, c) for c, n in enumerate(RGB)},
    **{f'map_{n}': _ramp_sql(f'(2e0*{T1})', im.MAP_STOPS, c) for c, n in enumerate(RGB)})} FROM points"""))
def colour_ramp(d):
    v = F.col("v") / 25e4 - 1.0
    return d.points.select("pid", *named(im.ramp(v, im.POLARITY_STOPS), "pol_red pol_green pol_blue"), *named(im.ramp(v, im.MAP_STOPS), "map_red map_green map_blue"))


# a colour at full value 8e-1 loses up to its saturation (45e-2 of it) with the distance of its channel on the hue circle
HSV = {n: f"8e-1 - 36e-2*greatest(0e0, least(1e0, k_{n}, 4e0 - k_{n}))" for n in RGB}
TURN = {"red": 5, "green": 3, "blue": 1}


@query("hsv_rainbow", with_views("lines", more={"h": "SELECT line_id, (row_number() OVER (PARTITION BY snapshot_id ORDER BY line_id) - 1)*6180339887498949e-16 AS u FROM lines",
    "g": "SELECT line_id, " + ", ".join(f"{n}e0 + 6e0*u - 6e0*floor(({n}e0 + 6e0*u)/6e0) AS k_{c}" for c, n in TURN.items()) + " FROM h"}, final=f"SELECT line_id, {r6(**HSV)} FROM g"))
def hsv_rainbow(d):
    from heliospark.operators.picture import line_colours

    return line_colours(d.lines, None, "rainbow").select("line_id", *RGB)


@query("slog_q", with_views("nodes", final=f"SELECT snapshot_id, i_r, i_t, i_p, {r6(slog='sign(polarity)*CASE WHEN log_q IS NOT NULL THEN greatest(log_q, log10(2e0)) END')} FROM nodes"))
def slog_q(d):
    return d.volume.select("snapshot_id", "i_r", "i_t", "i_p", im.slog_q(F.col("log_q"), F.col("polarity")).alias("slog"))


@query("sunjson_coords", with_views("paths", more={"a": "SELECT *, degrees(atan2(y, x)) AS l, sqrt(x*x + y*y + z*z) AS r FROM paths"},
    final=f"SELECT line_id, seq, {r6(r='r', lon='CASE WHEN l < 0 THEN l + 36e1 ELSE l END', lat='degrees(asin(greatest(least(z/r, 1e0), -1e0)))')} FROM a"))
def sunjson_coords(d):
    return d.paths.select("line_id", "seq", *named(im.sun_coordinates(*xyz()), "r lon lat"))


FR = "((r - 1e0)/15e-1)"


@query("keys_weights", with_views("points", more={"t": f"SELECT pid, d, {FR} AS t FROM points CROSS JOIN {q.FOUR} f"},
    final=f"SELECT pid, d AS tap, {r6(w=q.W.format(d='d', t='t'), s=q.DW.format(d='d', t='t'))} FROM t"))
def keys_weights_(d):
    t = (F.col("r") - 1.0) / 1.5
    rows = [F.struct(F.lit(k).alias("tap"), w.alias("w"), s.alias("s")) for k, (w, s) in enumerate(zip(keys_weights(t), keys_slopes(t)))]
    return d.points.select("pid", F.explode(F.array(*rows)).alias("e")).select("pid", "e.*")
