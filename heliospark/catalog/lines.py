"""Field lines and the volume built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark.catalog import sql as q
from heliospark.catalog.inputs import GRID, Inputs, big, query, r6, with_views
from heliospark.catalog.scalars import BASIS
from heliospark.catalog.stencils import LOOKUP, sphere_maps
from heliospark.functions.grid import GridSpec
from heliospark.operators import lines as ln
from heliospark.operators import stencil as st
from heliospark.operators import volume as vol
from heliospark.operators.ranks import join_few
from heliospark.operators.stepper import TraceOptions
from heliospark.operators.tiles import Tiling


def line_seeds(d: Inputs):
    return d.seeds.select("snapshot_id", "line_id", "x", "y", "z")


# a uniform field on each snapshot's nodes: cubic reads are exact, lines are straight, feet are where they meet the spheres


def rays(source: str) -> dict[str, str]:
    """Steps from seeds (snapshot_id, line_id, x, y, z) to both feet, end codes and lengths."""
    return {
        "ray": f"""SELECT snapshot_id, line_id, x, y, z, s, nx/size AS nx, ny/size AS ny, nz/size AS nz
            FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS size FROM (SELECT snapshot_id, line_id, x, y, z, 37e-2*(1 + snapshot_id % 3) AS nx, -2e-1 AS ny, 6e-1 AS nz
            FROM {source}) a, (VALUES (-1e0), (1e0)) side(s)) b""",
        "hit": """SELECT *, x*x + y*y + z*z AS rr, s*(x*nx + y*ny + z*nz) AS along FROM ray""",
        "foot": """SELECT *, CASE WHEN along < 0 AND along*along - rr + 1e0 > 0 THEN 0 ELSE 1 END AS code,
            CASE WHEN along < 0 AND along*along - rr + 1e0 > 0 THEN -along - sqrt(along*along - rr + 1e0) ELSE -along + sqrt(along*along - rr + 625e-2) END AS t FROM hit""",
        "two": """SELECT b.snapshot_id, b.line_id, b.nx, b.ny, b.nz, b.code AS end_b, f.code AS end_f, b.t AS len_b, f.t AS len_f,
            b.x - b.t*b.nx AS bx, b.y - b.t*b.ny AS b_y, b.z - b.t*b.nz AS bz, f.x + f.t*f.nx AS fx, f.y + f.t*f.ny AS fy, f.z + f.t*f.nz AS fz
            FROM foot b JOIN foot f ON b.line_id = f.line_id AND b.snapshot_id = f.snapshot_id WHERE b.s < 0 AND f.s > 0""",
    }


FEET = dict(len_b="len_b", len_f="len_f", foot_b_x="bx", foot_b_y="b_y", foot_b_z="bz", foot_f_x="fx", foot_f_y="fy", foot_f_z="fz")
#: Steps short enough that none passes over a chord of the inner sphere.
SHORT = TraceOptions(cfl=0.1)
TRACED = with_views("seeds", more=rays("seeds"), final=f"SELECT snapshot_id, line_id, {big(end_b='end_b', end_f='end_f')}, {r6(**FEET)} FROM two")


def uniform_field(d: Inputs) -> ln.GridField:
    """One direction per snapshot, as strong as its nodes' mean value."""
    strength = d.nodes.groupBy("snapshot_id").agg((1.0 + F.avg("ne")).alias("size"))
    turned = 0.37 * (1 + F.col("snapshot_id") % 3)
    b = [(F.col("size") * k).alias(c) for c, k in (("b_x", turned), ("b_y", F.lit(-0.2)), ("b_z", F.lit(0.6)))]
    return ln.GridField(join_few(d.nodes, strength).select("snapshot_id", "i_r", "i_t", "i_p", *b), GRID)


@query("trace_lines", TRACED)
def trace_lines(d):
    """Feet, end codes and lengths of every line of a field on grid nodes."""
    lines = ln.trace_lines(line_seeds(d), uniform_field(d), SHORT)
    return lines.select("snapshot_id", "line_id", "end_b", "end_f", *FEET)


@query("trace_lines_grid", TRACED)
def trace_lines_grid(d):
    """The same over tiles of a few nodes: lines pass from tile to tile."""
    field = uniform_field(d)
    tiled = ln.GridField(field.nodes, field.spec, Tiling(field.spec, block_r=2, block_t=4, halo=field.frontier_tiling(SHORT.cfl).halo))
    return ln.trace_lines(line_seeds(d), tiled, SHORT).select("snapshot_id", "line_id", "end_b", "end_f", *FEET)


@query("fold_halves", with_views("lines", final=f"""SELECT snapshot_id, line_id, {big(end_b='end_b', end_f='end_f')}, {r6(len_b='len_b', len_f='len_f',
    **{f'foot_{s}_{c}': f'foot_{s}_{c}' for s in 'bf' for c in 'xyz'})} FROM lines"""))
def fold_halves(d):
    """Half rows made from whole lines fold back to them."""
    half = [
        F.struct(F.lit(sign).alias("direction"), F.col(f"end_{s}").cast("long").alias("code"), F.col(f"len_{s}").alias("arc"), F.array(*ln.vector(f"foot_{s}")).alias("state"))
        for s, sign in (("b", -1.0), ("f", 1.0))
    ]
    rows = d.lines.select("snapshot_id", "line_id", F.explode(F.array(*half)).alias("h")).select("snapshot_id", "line_id", "h.*")
    return ln.fold_halves(rows)


@query("join_paths", with_views("paths", more={"n": "SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM paths"}, final=f"""
    SELECT snapshot_id, line_id, {big(seq='n - seq + 1')}, {r6(x='x', y='y', z='z')} FROM n
    UNION ALL SELECT snapshot_id, line_id, {big(seq='n + seq - 1')}, {r6(x='2e0*x', y='2e0*y', z='2e0*z')} FROM n WHERE seq > 1"""))
def join_paths(d):
    """Both half paths are made from one polyline: the backward one as it is, the forward one doubled."""
    vertex = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "z")))
    lists = d.paths.groupBy("snapshot_id", "line_id").agg(vertex.alias("v"))
    flat = lambda k: F.flatten(F.transform("v", lambda e: F.array(e["x"] * k, e["y"] * k, e["z"] * k)))
    halves = F.explode(F.array(F.struct(F.lit(-1.0).alias("direction"), flat(1.0).alias("path")), F.struct(F.lit(1.0).alias("direction"), flat(2.0).alias("path"))))
    return ln.join_paths(lists.select("snapshot_id", "line_id", halves.alias("h")).select("snapshot_id", "line_id", "h.*"))


LANDS = "(end_b IN (0, 1) AND end_f IN (0, 1))"
FLAGS = {"is_complete": LANDS, "is_closed": "end_b = 0 AND end_f = 0", "is_open": f"{LANDS} AND (end_b = 1 OR end_f = 1)", "is_incomplete": f"NOT {LANDS}",
         "is_null": "end_b = 2 OR end_f = 2", "is_stalled": "end_b = 4 OR end_f = 4", "is_deflected": "end_b = 5 OR end_f = 5"}


@query("classify_lines", with_views("lines", final="SELECT snapshot_id, line_id, " + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items()) + " FROM lines"))
def classify_lines(d):
    flags = ln.classify(F.col("end_b"), F.col("end_f"))
    return d.lines.select("snapshot_id", "line_id", *[e.alias(n) for n, e in flags.items()])


COUNTS = {n: f"count(*) FILTER (WHERE {FLAGS[f'is_{n}']})" for n in ("closed", "open", "null", "stalled", "deflected")}
COUNTS["max_steps"] = f"count(*) FILTER (WHERE NOT {LANDS} AND NOT ({FLAGS['is_null']}) AND NOT ({FLAGS['is_stalled']}) AND NOT ({FLAGS['is_deflected']}))"


@query("line_summary", with_views("lines", final="SELECT snapshot_id, " + ", ".join(f'{e} AS "{n}"' for n, e in COUNTS.items()) + " FROM lines GROUP BY snapshot_id"))
def line_summary(d):
    return ln.line_summary(d.lines)


# the basis of a straight line is carried unchanged
CARRIED = {"dir": "SELECT DISTINCT snapshot_id, nx AS b_x, ny AS b_y, nz AS b_z FROM ray"} | {k: v.replace("pid", "snapshot_id").replace("FROM dip", "FROM dir") for k, v in BASIS.items()}
U, W = ("u_0", "u_1", "u_2"), ("h_1*u_2 - h_2*u_1", "h_2*u_0 - h_0*u_2", "h_0*u_1 - h_1*u_0")
DEVIATIONS = {f"{n}_{side}_{c}": e for side in "bf" for n, parts in (("u", U), ("w", W)) for c, e in zip("xyz", parts)}


@query("transport_lines", with_views("seeds", more=rays("seeds") | CARRIED, final=f"""SELECT snapshot_id, line_id, {big(end_b='end_b', end_f='end_f')}, {r6(**FEET, **DEVIATIONS)}
    FROM two JOIN un USING (snapshot_id)"""))
def transport_lines(d):
    """Feet and the two deviations carried to each of them."""
    fld = uniform_field(d)
    seeds = ln.with_seed_basis(ln.attach_b(line_seeds(d), fld, ["line_id"]))
    return ln.transport_lines(seeds, fld, SHORT).select("snapshot_id", "line_id", "end_b", "end_f", *FEET, *DEVIATIONS)


# Q of a straight tube: 2 between planes normal to it, and from the slants of both spheres between spheres
SLANT = {"b": "abs(nx*bx + ny*b_y + nz*bz)/sqrt(bx*bx + b_y*b_y + bz*bz)", "f": "abs(nx*fx + ny*fy + nz*fz)/sqrt(fx*fx + fy*fy + fz*fz)"}


@query("squash", with_views("seeds", more=rays("seeds") | {"sl": f"SELECT *, {SLANT['b']} AS cb, {SLANT['f']} AS cf FROM two"},
    final=f"SELECT snapshot_id, line_id, {r6(log_q_perp='log10(2e0)', log_q='log10(cb/cf + cf/cb)', len_b='len_b', len_f='len_f')} FROM sl"))
def squash(d):
    result = ln.squash(line_seeds(d), uniform_field(d), SHORT)
    return result.select("snapshot_id", "line_id", F.log10("q_perp").alias("log_q_perp"), F.log10("q").alias("log_q"), "len_b", "len_f")


@query("squash_summary", with_views("lines", final=f"""SELECT snapshot_id, count(*) FILTER (WHERE {LANDS}) AS n_valid, count(*) AS n_total,
    {r6(median_q=f'median(value) FILTER (WHERE {LANDS})', min_log_q='min(log10(value))', max_log_q='max(log10(value))')} FROM lines GROUP BY snapshot_id"""))
def squash_summary(d):
    return ln.squash_summary(d.lines.withColumn("q_perp", F.col("value")))


# feet to line values

TWO_FEET = "SELECT line_id, max(log_q) FILTER (WHERE side = 0) AS b, max(log_q) FILTER (WHERE side = 1) AS f FROM foot_q GROUP BY line_id"


@query("combine_feet", with_views("lines", "nodes", more=LOOKUP | {"two": TWO_FEET}, final=f"SELECT line_id, {r6(log_q='log10(5e-1*(power(1e1, b) + power(1e1, f)))')} FROM two"))
def combine_feet(d):
    feet = st.boundary_lookup(vol.feet_rows(d.lines), sphere_maps(d), GRID.n_theta, GRID.n_phi, ["line_id", "side"])
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("log_q")))
    two = feet.groupBy("line_id").agg(side(0).alias("b"), side(1).alias("f"))
    return two.select("line_id", vol.combine_feet(F.col("b"), F.col("f")).alias("log_q"))


RB, RF = "sin(foot_b_x*3e0 + foot_b_y)", "2e0*sin(foot_f_y*4e0 + foot_f_z)"
SB = f"coalesce(CASE WHEN end_b = 0 THEN sign({RB}) END, 0)"
SF = f"coalesce(CASE WHEN end_f = 0 THEN sign({RF}) END, 0)"
AB, AF = f"(CASE WHEN end_b = 0 THEN abs({RB}) ELSE -1e0 END)", f"(CASE WHEN end_f = 0 THEN abs({RF}) ELSE -1e0 END)"


@query("line_polarity", with_views("lines", final=f"""SELECT line_id, {big(neutral=f'sign({SB} + {SF})', dominant=f'CASE WHEN end_b <> 0 AND end_f <> 0 THEN 0 WHEN {AB} >= {AF} THEN {SB} ELSE {SF} END')} FROM lines"""))
def line_polarity(d):
    radial = (F.sin(F.col("foot_b_x") * 3.0 + F.col("foot_b_y")), 2.0 * F.sin(F.col("foot_f_y") * 4.0 + F.col("foot_f_z")))
    return d.lines.select("line_id", *[vol.line_polarity(F.col("end_b"), F.col("end_f"), *radial, closed=c).alias(c) for c in ("neutral", "dominant")])


# painting

LEG = "sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2))"
ARC = {"leg": f"SELECT *, coalesce({LEG}, 0e0) AS leg FROM paths WINDOW w AS (PARTITION BY line_id ORDER BY seq)",
       "arc": "SELECT *, sum(leg) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM leg"}
CELL = "least(r*ln(25e-1)/4e0, r*pi()/15e0, greatest(sqrt(x*x + y*y)*pi()/10e0, r*pi()/15e0))"
PAINT = ARC | {
    "seg": f"""SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(s) OVER w AS s1,
        max(s) OVER (PARTITION BY line_id) AS total, min({CELL}) OVER (PARTITION BY line_id) AS cell
        FROM (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM arc) a WINDOW w AS (PARTITION BY line_id ORDER BY seq)""",
    "num": "SELECT line_id, CAST(floor(max(total)/(5e-1*max(cell))) AS BIGINT) AS n, max(total) AS total FROM seg GROUP BY line_id",
    "ks": "SELECT line_id, total, n, unnest(range(n + 1)) AS k FROM num",
    "smp": """SELECT g.snapshot_id, g.line_id, CAST(k.k AS BIGINT) AS k, g.x + t*(g.x1 - g.x) AS x, g.y + t*(g.y1 - g.y) AS y, g.z + t*(g.z1 - g.z) AS z
        FROM (SELECT ks.line_id, ks.k, ks.k*(ks.total/ks.n) AS at, ks.n FROM ks) k
        JOIN seg g ON g.line_id = k.line_id AND ((k.at >= g.s AND k.at < g.s1 AND k.k < k.n) OR (k.k = k.n AND g.s < g.total AND g.s1 >= g.total)),
        LATERAL (SELECT least((k.at - g.s)/(g.s1 - g.s), 1e0) AS t) u"""}


@query("path_arclength", with_views("paths", more=ARC, final=f"SELECT line_id, seq, {r6(s='s')} FROM arc"))
def path_arclength(d):
    return vol.path_arclength(d.paths).select("line_id", "seq", "s")


@query("path_resample", with_views("paths", more=PAINT, final=f"SELECT line_id, k, {r6(x='x', y='y', z='z')} FROM smp"))
def path_resample(d):
    return vol.path_resample(d.paths, GRID).select("line_id", "k", "x", "y", "z")


VOXELS = PAINT | {"s2": q.spherical("smp", "snapshot_id, line_id, k"), "i2": q.index("s2", "snapshot_id, line_id, k"),
    "vx": "SELECT snapshot_id, line_id, k, CAST((least(greatest(floor(fr), 0), 4)*15 + least(greatest(floor(ft), 0), 14))*20 + floor(fp) % 20 AS BIGINT) AS voxel FROM i2",
    "vox": "SELECT * FROM (SELECT *, lag(voxel) OVER (PARTITION BY line_id ORDER BY k) AS pv FROM vx) a WHERE pv IS NULL OR pv <> voxel"}


def painted_voxels(d: Inputs):
    return vol.path_voxels(vol.path_resample(d.paths, GRID), GRID)


@query("path_voxels", with_views("paths", more=VOXELS, final="SELECT snapshot_id, line_id, k, voxel FROM vox"))
def path_voxels(d):
    return painted_voxels(d)


SUMS = VOXELS | {"acc": """SELECT v.snapshot_id, v.voxel, sum(power(1e1, l.log_q)) AS sum_q, count(*) AS n_lines, sum(l.polarity*power(1e1, l.log_q)) AS sum_pol
    FROM vox v JOIN line_values l ON v.line_id = l.line_id WHERE l.log_q IS NOT NULL GROUP BY v.snapshot_id, v.voxel"""}


@query("paint_accumulate", with_views("paths", "line_values", more=SUMS, final=f"SELECT snapshot_id, voxel, n_lines, {r6(sum_q='sum_q', sum_pol='sum_pol')} FROM acc"))
def paint_accumulate(d):
    return vol.paint_accumulate(painted_voxels(d), d.line_values)


NODE_ID = "(i_r*15 + i_t)*20 + i_p"


def node_keys(d: Inputs):
    return d.nodes.select("snapshot_id", GRID.flat_id(F.col("i_r"), F.col("i_t"), F.col("i_p")).alias("node_id"), "i_r", "i_t", "i_p")


@query("paint_finalize", with_views("paths", "line_values", "nodes", more=SUMS | {"nk": f"SELECT snapshot_id, {NODE_ID} AS voxel, i_r, i_t, i_p FROM nodes"},
    final=f"""SELECT n.snapshot_id, n.voxel, n.i_r, n.i_t, n.i_p, {r6(log_q='log10(a.sum_q/a.n_lines)')}, {big(polarity='coalesce(sign(round(a.sum_pol, 6)), 0)')}
    FROM nk n LEFT JOIN acc a ON n.snapshot_id = a.snapshot_id AND n.voxel = a.voxel"""))
def paint_finalize(d):
    sums = vol.paint_accumulate(painted_voxels(d), d.line_values).withColumn("sum_pol", F.round("sum_pol", 6))
    return vol.paint_finalize(sums, node_keys(d))


@query("radial_sign_grid", with_views("nodes", final=f"SELECT snapshot_id, i_r, i_t, i_p, {big(sign='sign(b_x*x + b_y*y + b_z*z)')} FROM nodes"))
def radial_sign_grid(d):
    return vol.radial_sign_grid(d.nodes)


@query("volume_pack", with_views("nodes", final=f"SELECT snapshot_id, {NODE_ID} AS node_id, i_r, i_t, i_p, {r6(log_q='log_q')}, {big(polarity='CASE WHEN log_q IS NOT NULL THEN polarity END')} FROM nodes"))
def volume_pack(d):
    node_id = GRID.flat_id(F.col("i_r"), F.col("i_t"), F.col("i_p"))
    values = d.volume.where(F.col("log_q").isNotNull()).select("snapshot_id", node_id.alias("node_id"), "log_q", "polarity")
    return vol.volume_pack(values, node_keys(d))


@query("covered_fraction", with_views("nodes", final=f"SELECT snapshot_id, {r6(covered_fraction='avg(CASE WHEN log_q IS NOT NULL THEN 1e0 ELSE 0e0 END)')} FROM nodes GROUP BY snapshot_id"))
def covered_fraction(d):
    return vol.coverage(d.volume).drop("sub_floor")


@query("sub_floor_count", with_views("nodes", final=f"SELECT snapshot_id, count(*) FILTER (WHERE log_q < {q.LOG_FLOOR}) AS sub_floor FROM nodes GROUP BY snapshot_id"))
def sub_floor_count(d):
    return vol.coverage(d.volume).drop("covered_fraction")


# builders on a field on nodes, on a grid of each snapshot

COARSE = GridSpec(6, 8, 12, inner=1.0, outer=2.5)
RAYS_IN = {"node": """SELECT snapshot_id, id AS line_id, r*sin(theta)*cos(phi) AS x, r*sin(theta)*sin(phi) AS y, r*cos(theta) AS z
    FROM (SELECT snapshot_id, id, greatest(least(power(25e-1, floor(id/96e0)/5e0), 25e-1*(1e0 - 1e-9)), 1e0 + 1e-9) AS r,
          (floor((id % 96)/12e0) + 5e-1)*pi()/8e0 AS theta, (id % 12)*pi()/6e0 AS phi
          FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(576)) t) a"""}
NODE = "snapshot_id, line_id AS node_id, CAST(floor(line_id/96e0) AS BIGINT) AS i_r, CAST(floor((line_id % 96)/12e0) AS BIGINT) AS i_t, line_id % 12 AS i_p"


@query("boundary_map", with_views("snapshots", final=f"""SELECT snapshot_id, sphere, CAST(floor(id/12e0) AS BIGINT) AS i_t, id % 12 AS i_p, {r6(log_q='log10(2e0)')}
    FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(96)) t, (SELECT CAST(range AS BIGINT) AS sphere FROM range(2)) s"""))
def boundary_map(d):
    """Maps of the inner and the outer sphere."""
    return vol.boundary_maps(d.snapshots, uniform_field(d), COARSE.n_theta, COARSE.n_phi)


@query("volume_reference", with_views("snapshots", more=RAYS_IN, final=f"SELECT {NODE}, {r6(log_q='log10(2e0)')} FROM node"))
def volume_reference(d):
    return vol.volume_reference(d.snapshots, uniform_field(d), COARSE)


# a line that comes from the inner sphere is positive, one that ends there negative
@query("volume_per_voxel", with_views("snapshots", more=RAYS_IN | rays("node"), final=f"""SELECT {NODE}, {r6(log_q='log10(2e0)')},
    {big(polarity='CASE WHEN end_b = 0 THEN 1 WHEN end_f = 0 THEN -1 ELSE 0 END')} FROM two"""))
def volume_per_voxel(d):
    return vol.volume_per_voxel(d.snapshots, uniform_field(d), COARSE, supersample=2, opt=SHORT)


@query("volume_paint")
def volume_paint(d):
    return vol.volume_paint(d.snapshots, uniform_field(d), COARSE, supersample=2)
