"""Line-of-sight images, brightness frames and shell maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark.catalog import sql as q
from heliospark.catalog.inputs import CAMERA, GRID, STEP, Inputs, big, query, r6, with_views
from heliospark.functions import imaging as im
from heliospark.functions import radiation as rad
from heliospark.operators import brightness as br
from heliospark.operators import generators as gen
from heliospark.operators import los
from heliospark.operators.stencil import NODE_KEY
from heliospark.operators.tiles import nearest_voxel, sample_tiles
from heliospark.plans import pipeline

PX = "snapshot_id, pixel_id"
CH = (0, 1, 2)
SAMPLE_KEY = "snapshot_id, pixel_id, k"
NEAR_T = "CAST(floor(ft + 5e-1) AS BIGINT)"

# every in-shell sample with its value and sign
SAMPLES = {"pix": q.pixels(), "smp": q.samples()} | q.stencil_steps("smp", SAMPLE_KEY, ["log_q"], skip=True) | {
    "near": f"""SELECT {SAMPLE_KEY}, CAST(floor(fr + 5e-1) AS BIGINT) AS i_r, CASE WHEN {NEAR_T} > 14 THEN 29 - {NEAR_T} ELSE {NEAR_T} END AS i_t,
        (CAST(floor(fp + 5e-1) AS BIGINT) + CASE WHEN {NEAR_T} > 14 THEN 10 ELSE 0 END) % 20 AS i_p FROM idx""",
    "val": f"""SELECT m.snapshot_id, m.pixel_id, m.k, m.s, m.r, m.rho, v.log_q, CAST(n.polarity AS DOUBLE) AS sgn, m.w_0, m.w_1, m.w_2
        FROM (SELECT *, {q.weights()} FROM smp) m JOIN read v USING ({SAMPLE_KEY}) JOIN near e USING ({SAMPLE_KEY})
        JOIN (SELECT snapshot_id, i_r, i_t, i_p, polarity FROM nodes) n ON n.snapshot_id = e.snapshot_id AND n.i_r = e.i_r AND n.i_t = e.i_t AND n.i_p = e.i_p"""}
CL = q.clamp("log_q", q.LOG_FLOOR, "7e0")
MEAN = "(w_0 + w_1 + w_2)/3e0"


def _sums(scale: str = "1e0", on: str = "true") -> str:
    ok = f"FILTER (WHERE {on} AND log_q IS NOT NULL)"
    parts = []
    for c in CH:
        parts += [f"sum(w_{c}*{scale}*{CL}) {ok} AS num_{c}", f"sum(w_{c}*{scale}) {ok} AS den_{c}", f"sum(w_{c}) FILTER (WHERE {on}) AS on_{c}"]
    parts += [f"sum({MEAN}) {ok} AS ref_valid", f"sum({MEAN}) FILTER (WHERE {on}) AS ref_path", f"sum({MEAN}*sgn) {ok} AS pol_num",
              f"count(*) {ok} AS n_valid", f"count(*) FILTER (WHERE {on} AND log_q < {q.LOG_FLOOR}) AS n_low", f"count(*) FILTER (WHERE {on} AND log_q > 7e0) AS n_high"]
    return f"SELECT {PX}, {', '.join(parts)} FROM val GROUP BY {PX}"


COLUMNS = {f"signal_{c}": f"CASE WHEN den_{c} > 0 THEN num_{c}/den_{c} END" for c in CH}
BUDGETS = {f"{k}_{c}": f"coalesce({k}_{c}, 0e0)" for k in ("den", "on") for c in CH}
COVER = {"coverage": "CASE WHEN ref_path > 0 THEN coalesce(ref_valid, 0e0)/ref_path ELSE 0e0 END"}
POLAR = {"polarity": "CASE WHEN ref_valid > 0 THEN pol_num/ref_valid END"}
TALLY = {c: f"coalesce({c}, 0)" for c in ("n_valid", "n_low", "n_high")}
LOS_SQL = {"los": f"SELECT p.snapshot_id, p.pixel_id, p.rho, {', '.join(f'{e} AS {n}' for n, e in (COLUMNS | BUDGETS | COVER | POLAR | TALLY).items())} FROM pix p LEFT JOIN sums USING ({PX})"}
LOS_STEPS = SAMPLES | {"sums": _sums()} | LOS_SQL


def pixel_table(d: Inputs):
    return gen.pixels(d.snapshots, CAMERA)


def sample_table(d: Inputs, step: float = STEP):
    """In-shell samples with value and sign, in relational form."""
    rows = gen.los_samples(pixel_table(d), CAMERA, GRID.outer, step).where((F.col("r") >= GRID.inner) & (F.col("r") <= GRID.outer))
    i_r, i_t, i_p = nearest_voxel(GRID, F.col("x"), F.col("y"), F.col("z"))
    rows = rows.select("snapshot_id", "pixel_id", "k", "rho", "s", "r", "x", "y", "z", i_r.alias("i_r"), i_t.alias("i_t"), i_p.alias("i_p"))
    read = sample_tiles(rows, d.volume, GRID, ["log_q"], ["pixel_id", "k"], mode="skip_nan", outside="null")
    signs = d.volume.select(*NODE_KEY, F.col("polarity").cast("double").alias("sign"))
    return read.join(signs, NODE_KEY).withColumn("on_path", F.lit(True))


def los_table(d: Inputs, **options):
    return los.render_los(d.volume, GRID, pixel_table(d), CAMERA, step=STEP, **options)


@query("los_weighted_average", with_views("snapshots", "nodes", more=SAMPLES | {"sums": _sums()}, final=f"""SELECT {PX}, {r6(**{f'signal_{c}': f'CASE WHEN den_{c} > 0 THEN num_{c}/den_{c} END' for c in CH}, **{f'den_{c}': f'coalesce(den_{c}, 0e0)' for c in CH})} FROM sums"""))
def los_weighted_average(d):
    out = los.los_columns(los.los_sums(sample_table(d), im.LARGE_FOV))
    return out.select("snapshot_id", "pixel_id", *[f"{k}_{c}" for k in ("signal", "den") for c in CH])


@query("los_clamp", with_views("nodes", final=f"""SELECT snapshot_id, i_r, i_t, i_p, {r6(both=f'CASE WHEN log_q IS NOT NULL THEN {CL} END', upper='CASE WHEN log_q IS NOT NULL THEN least(log_q, 7e0) END')} FROM nodes"""))
def los_clamp(d):
    have = F.col("log_q").isNotNull()
    return d.volume.select(*NODE_KEY, F.when(have, los.los_clamp(F.col("log_q"))).alias("both"), F.when(have, los.los_clamp(F.col("log_q"), floor=False)).alias("upper"))


@query("los_clamp_counts", with_views("snapshots", "nodes", more=SAMPLES, final=f"SELECT snapshot_id, count(*) FILTER (WHERE log_q < {q.LOG_FLOOR}) AS n_low, count(*) FILTER (WHERE log_q > 7e0) AS n_high, count(log_q) AS n_valid FROM val GROUP BY snapshot_id"))
def los_clamp_counts(d):
    return los.clamp_counts(sample_table(d))


@query("los_budgets", with_views("snapshots", "nodes", more=SAMPLES | {"sums": _sums()}, final=f"SELECT {PX}, {r6(**{f'on_{c}': f'on_{c}' for c in CH}, **COVER)} FROM sums"))
def los_budgets(d):
    out = los.los_columns(los.los_sums(sample_table(d), im.LARGE_FOV))
    return out.select("snapshot_id", "pixel_id", "on_0", "on_1", "on_2", "coverage")


@query("los_polarity", with_views("snapshots", "nodes", more=SAMPLES | {"sums": _sums()}, final=f"SELECT {PX}, {r6(**POLAR)} FROM sums"))
def los_polarity(d):
    return los.los_columns(los.los_sums(sample_table(d), im.LARGE_FOV)).select("snapshot_id", "pixel_id", "polarity")


THOMSON = {"tap_d": "SELECT * FROM tap", "pad_d": q.padded(["ne"]), "ned": f"""SELECT k.snapshot_id, k.pixel_id, k.k, sum(k.w*n.ne) AS ne FROM tap_d k
    JOIN pad_d n ON k.snapshot_id = n.snapshot_id AND k.i_r = n.i_r AND k.i_t = n.i_t AND k.i_p = n.i_p GROUP BY k.snapshot_id, k.pixel_id, k.k""",
    "coef": q.coefficient_table(), "tc": q.table_read("smp", SAMPLE_KEY),
    "valt": f"SELECT v.*, ne*(2e0*c_tan - c_pol*rho*rho/(r*r)) AS th FROM val v JOIN ned USING ({SAMPLE_KEY}) JOIN tc USING ({SAMPLE_KEY})"}
THOMSON_SUMS = _sums("th").replace("FROM val ", "FROM valt ")


@query("los_thomson", with_views("snapshots", "nodes", more=SAMPLES | THOMSON | {"sums": THOMSON_SUMS} | LOS_SQL,
    final=f"SELECT {PX}, {r6(**{n: n for n in [*COLUMNS, *BUDGETS, 'coverage']})} FROM los"))
def los_thomson(d):
    out = los_table(d, density=(d.density, GRID))
    return out.select("snapshot_id", "pixel_id", *COLUMNS, *BUDGETS, "coverage")


@query("render_los", with_views("snapshots", "nodes", more=LOS_STEPS, final=f"SELECT {PX}, {r6(**{n: n for n in [*COLUMNS, *BUDGETS, 'coverage', 'polarity']})}, {big(**{n: n for n in TALLY})} FROM los"))
def render_los(d):
    out = los_table(d)
    return out.select("snapshot_id", "pixel_id", *COLUMNS, *BUDGETS, "coverage", "polarity", *TALLY)


HIDDEN = "NOT (rho < 1e0 AND s < -sqrt(greatest(1e0 - rho*rho, 0e0)))"


@query("render_los_opaque", with_views("snapshots", "nodes", more=SAMPLES | {"sums": _sums(on=HIDDEN)} | LOS_SQL, final=f"SELECT {PX}, {r6(**{n: n for n in [*COLUMNS, 'coverage', 'polarity']})} FROM los"))
def render_los_opaque(d):
    return los_table(d, occult="opaque").select("snapshot_id", "pixel_id", *COLUMNS, "coverage", "polarity")


MODES = {"balanced": "signal_{c}*on_{c}", "raw": "signal_{c}*den_{c}", "coverage": "signal_{c}*den_{c}/nullif(coverage, 0e0)"}


@query("display_magnitude", with_views("snapshots", "nodes", more=LOS_STEPS, final=f"SELECT {PX}, {r6(**{f'{m}_{c}': e.format(c=c) for m, e in MODES.items() for c in CH})} FROM los"))
def display_magnitude(d):
    col = lambda k, c: F.col(f"{k}_{c}")
    made = [los.display_magnitude(m, col("signal", c), col("den", c), col("on", c), F.col("coverage")).alias(f"{m}_{c}") for m in MODES for c in CH]
    return los_table(d).select("snapshot_id", "pixel_id", *made)


@query("percentile_stretch", with_views("points", more=q.stretch(["v", "r"], "points", "snapshot_id, pid", anchor="theta < 15e-1"), final=f"SELECT snapshot_id, pid, {r6(v='v', r='r')} FROM scaled"))
def percentile_stretch(d):
    return los.percentile_stretch(d.points, ["v", "r"], anchor=F.col("theta") < 1.5).select("snapshot_id", "pid", "v", "r")


CUT = {"cut": f"SELECT {PX}, rho, {q.alpha('rho')} AS al, " + ", ".join(f"CASE WHEN {q.alpha('rho')} > 0 THEN signal_{c} END AS signal_{c}" for c in CH) + ", "
       + ", ".join(f"on_{c}" for c in CH) + f", CASE WHEN {q.alpha('rho')} > 0 THEN coverage ELSE 0e0 END AS coverage, polarity, n_valid, n_low, n_high FROM los",
       "mag": f"SELECT *, (signal_0 + signal_1 + signal_2)/3e0 AS gray, " + ", ".join(f"signal_{c}*on_{c} AS m_{c}" for c in CH) + " FROM cut"}
FINISH = LOS_STEPS | CUT | q.stretch(["gray", "m_0", "m_1", "m_2"], "mag", f"{PX}, rho, al, coverage, polarity, n_valid, n_low, n_high, signal_0, signal_1, signal_2")
SHOWN = r6(grayscale="gray*al", coverage="coverage", **{f"image_{c}": f"m_{c}*al" for c in CH})


@query("render_finish", with_views("snapshots", "nodes", more=FINISH, final=f"SELECT {PX}, {SHOWN} FROM scaled"))
def render_finish(d):
    return los.render_finish(los_table(d)).select("snapshot_id", "pixel_id", "grayscale", "coverage", "image_0", "image_1", "image_2")


@query("render_hue", with_views("snapshots", "nodes", more=FINISH, final="SELECT {px}, {cols} FROM scaled".format(px=PX, cols=r6(**{
    f"image_{c}": f"gray*al*CASE WHEN coalesce(polarity, 0e0) < 0 THEN {im.POLARITY_STOPS[0][c]}e0 + ({im.POLARITY_STOPS[1][c]}e0 - {im.POLARITY_STOPS[0][c]}e0)*(coalesce(polarity, 0e0) + 1e0) "
    f"ELSE {im.POLARITY_STOPS[1][c]}e0 + ({im.POLARITY_STOPS[2][c]}e0 - {im.POLARITY_STOPS[1][c]}e0)*coalesce(polarity, 0e0) END" for c in CH}))))
def render_hue(d):
    return los.render_finish(los_table(d), hue=True).select("snapshot_id", "pixel_id", "image_0", "image_1", "image_2")


@query("render_metrics", with_views("snapshots", "nodes", more=FINISH, final=f"""SELECT snapshot_id, {r6(mean_coverage='avg(coverage) FILTER (WHERE coverage > 0)',
    lower_clamped='sum(n_low)/sum(n_valid)', upper_clamped='sum(n_high)/sum(n_valid)')} FROM scaled GROUP BY snapshot_id"""))
def render_metrics(d):
    return los.render_metrics(los.render_finish(los_table(d)))


# composite: two finished images stand in, made from one line-of-sight table

LAYER = {"base": f"SELECT {PX}, rho, coverage, polarity, signal_0, signal_1, signal_2, m_0*al AS a_0, m_1*al AS a_1, m_2*al AS a_2 FROM scaled",
         "disk": f"SELECT {PX}, coverage AS dcov, signal_0 AS t_0, signal_1 AS t_1, signal_2 AS t_2 FROM los",
         "lay": "SELECT b.*, d.dcov, d.t_0, d.t_1, d.t_2, " + ", ".join(f"coalesce(d.t_{c}, 0e0)/1e1 AS b_{c}" for c in CH) + f" FROM base b JOIN disk d USING ({PX})",
         "des": "SELECT *, " + ", ".join(f"(b_0 + b_1 + b_2)/3e0 + 6e-1*(b_{c} - (b_0 + b_1 + b_2)/3e0) AS l_{c}" for c in CH) + " FROM lay",
         "rng": """SELECT snapshot_id, avg((a_0 + a_1 + a_2)/3e0) FILTER (WHERE rho > 102e-2 AND rho < 11e-1) AS o,
            avg((l_0 + l_1 + l_2)/3e0) FILTER (WHERE rho > 9e-1 AND rho < 98e-2) AS i FROM des GROUP BY snapshot_id""",
         "ton": """SELECT d.*, coalesce(CASE WHEN r.i > 0 THEN 8e-1*r.o/r.i END, 8e-1) AS tone, greatest(least((115e-2 - rho)/15e-2, 1e0), 0e0) AS g FROM des d JOIN rng r USING (snapshot_id)""",
         "wei": "SELECT *, CASE WHEN rho < 1e0 THEN 1e0 ELSE g*g*(3e0 - 2e0*g) END AS w FROM ton"}
BLEND = {f"image_{c}": f"1e0 - (1e0 - a_{c})*(1e0 - greatest(least(l_{c}*tone*w, 1e0), 0e0))" for c in CH}
FILL = {f"signal_{c}": f"CASE WHEN signal_{c} IS NULL AND rho < 1e0 THEN t_{c} ELSE signal_{c} END" for c in CH}
WHOLE = "CASE WHEN rho < 1e0 AND signal_0 IS NULL AND signal_1 IS NULL AND signal_2 IS NULL THEN dcov ELSE coverage END"


@query("render_composite", with_views("snapshots", "nodes", more=FINISH | LAYER, final=f"SELECT {PX}, {r6(**BLEND, **FILL, coverage=WHOLE)} FROM wei"))
def render_composite(d):
    table = los_table(d)
    base = los.render_finish(table)
    disk = table.withColumns({f"image_{c}": F.coalesce(F.col(f"signal_{c}"), F.lit(0.0)) / 10.0 for c in CH})
    return los.render_composite(base, disk).select("snapshot_id", "pixel_id", *BLEND, *FILL, "coverage")


# brightness

BRIGHT = {"pix": q.pixels(), "smp": q.samples()} | q.stencil_steps("smp", SAMPLE_KEY, ["ne"]) | {
    "coef": q.coefficient_table(), "tc": q.table_read("smp", SAMPLE_KEY),
    "bs": f"""SELECT {PX}, sum(ne*c_tan)*1e-1 AS k_tan, sum(ne*c_pol*rho*rho/(r*r))*1e-1 AS k_pol FROM smp JOIN read USING ({SAMPLE_KEY}) JOIN tc USING ({SAMPLE_KEY}) GROUP BY {PX}""",
    "frm": f"SELECT p.snapshot_id, p.pixel_id, p.rho, coalesce(k_pol, 0e0)*{q.alpha('rho')} AS polarized, (2e0*coalesce(k_tan, 0e0) - coalesce(k_pol, 0e0))*{q.alpha('rho')} AS total FROM pix p LEFT JOIN bs USING ({PX})"}


def frame(d: Inputs):
    return br.finalize_brightness(los.brightness_sums(d.density, GRID, pixel_table(d), CAMERA, STEP))


@query("los_brightness", with_views("snapshots", "nodes", more=BRIGHT, final=f"SELECT {PX}, {r6(polarized='polarized', total='total')} FROM frm"))
def los_brightness(d):
    return frame(d).select("snapshot_id", "pixel_id", "polarized", "total")


DEG = "CASE WHEN total > 0 THEN polarized/total ELSE 0e0 END"


@query("polarization", with_views("snapshots", "nodes", more=BRIGHT, final=f"SELECT {PX}, {r6(p=DEG)} FROM frm"))
def polarization(d):
    return frame(d).select("snapshot_id", "pixel_id", br.polarization(F.col("polarized"), F.col("total")).alias("p"))


@query("brightness_metrics", with_views("snapshots", "nodes", more=BRIGHT, final=f"""SELECT snapshot_id, {r6(median_polarization='median(polarized/total) FILTER (WHERE total > 0)',
    pb_decades='log10(max(polarized) FILTER (WHERE polarized > 0)/min(polarized) FILTER (WHERE polarized > 0))')} FROM frm GROUP BY snapshot_id"""))
def brightness_metrics(d):
    return br.brightness_metrics(frame(d))


# model curves and detrending, on brightness-like frames made from the points (impact parameter r, image v)

SAMPLES_N, NODES_N, RINGS_N, FIT_N = 65, 33, 16, 33


def _profile(source: str, keep: str, rho: str, a: str, n: int, name: str) -> dict[str, str]:
    """CTE steps ending in ``name``: trapezoid of the polarized model at each row of ``source``."""
    ds = f"sqrt(greatest(625e-2 - {rho}*{rho}, 0e0))/{n - 1}e0"
    return {f"{name}_s": f"""SELECT *, sqrt({rho}*{rho} + power(k*({ds}), 2)) AS rr, greatest(sqrt({rho}*{rho} + power(k*({ds}), 2)), 1e0) AS r,
            CASE WHEN k IN (0, {n - 1}) THEN 1e0 ELSE 2e0 END*({ds}) AS e, row_number() OVER () AS uid FROM {source}, (SELECT CAST(range AS BIGINT) AS k FROM range({n})) t""",
            f"{name}_c": q.table_read(f"{name}_s", f"uid, {keep}, {rho} AS rho_, {a} AS a_, rr, q.r, e"),
            name: f"SELECT {keep}, coalesce(sum(e*power(1e1, a_/r)*c_pol*rho_*rho_/(r*r)) FILTER (WHERE rr >= 1e0), 0e0) AS model FROM {name}_c GROUP BY {keep}"}


PROF = {"coef": q.coefficient_table(), "pr": "SELECT snapshot_id, pid, r AS prho FROM points"} | _profile("pr", "snapshot_id, pid", "prho", "432e-2", SAMPLES_N, "prof")


@query("hydrostatic_profile", with_views("points", more=PROF, final=f"SELECT snapshot_id, pid, {r6(model='model')} FROM prof"), digits=6)
def hydrostatic_profile(d):
    return br.hydrostatic_profile(d.points, F.col("r"), F.lit(br.NEWKIRK_EXPONENT), ["snapshot_id", "pid"], "model", 1.0, 2.5, samples=SAMPLES_N)


def curve_frame(d: Inputs):
    """Pixels with an impact parameter and a falling, noisy brightness."""
    image = F.exp(-4.0 * (F.col("r") - 1.0)) * (0.5 + F.col("v") / 5e5)
    return d.points.select("snapshot_id", F.col("pid").alias("pixel_id"), F.col("r").alias("rho"), image.alias("image"))


FRAME = {"fr": "SELECT snapshot_id, pid AS pixel_id, r AS rho, exp(-4e0*(r - 1e0))*(5e-1 + v/5e5) AS image FROM points"}
NEWKIRK = FRAME | {"coef": q.coefficient_table(), "top": "SELECT snapshot_id, max(rho) AS top FROM fr GROUP BY snapshot_id",
    "nod": f"SELECT snapshot_id, top, CAST(range AS BIGINT) AS nd, top*range/{NODES_N - 1}e0 AS nrho FROM top, range({NODES_N})"} | _profile("nod", "snapshot_id, top, nd", "nrho", "432e-2", SAMPLES_N, "prof") | {
    "rf": f"SELECT snapshot_id, 105e-2/top*{NODES_N - 1}e0 AS p FROM top",
    "ref": "SELECT f.snapshot_id, a.model + (f.p - floor(f.p))*(b.model - a.model) AS ref FROM rf f JOIN prof a ON a.snapshot_id = f.snapshot_id AND a.nd = CAST(floor(f.p) AS BIGINT) JOIN prof b ON b.snapshot_id = f.snapshot_id AND b.nd = a.nd + 1",
    "ps": f"SELECT f.*, f.rho/t.top*{NODES_N - 1}e0 AS p, CAST(least(floor(f.rho/t.top*{NODES_N - 1}e0), {NODES_N - 2}) AS BIGINT) AS j FROM fr f JOIN top t USING (snapshot_id)",
    "mo": "SELECT s.snapshot_id, s.pixel_id, s.rho, s.image, a.model + (s.p - s.j)*(b.model - a.model) AS model FROM ps s JOIN prof a ON a.snapshot_id = s.snapshot_id AND a.nd = s.j JOIN prof b ON b.snapshot_id = s.snapshot_id AND b.nd = s.j + 1",
    "vig": "SELECT m.snapshot_id, m.pixel_id, m.rho, CASE WHEN m.model > 0 AND m.rho >= 105e-2 THEN m.image*(r.ref/m.model) ELSE 0e0 END AS image FROM mo m JOIN ref r USING (snapshot_id)"}
DETAIL = dict(nodes=NODES_N, samples=SAMPLES_N)


@query("vignette_newkirk", with_views("points", more=NEWKIRK, final=f"SELECT {PX}, {r6(image='image')} FROM vig"))
def vignette_newkirk(d):
    return br.vignette_newkirk(curve_frame(d), "image", 1.05, 1.0, 2.5, **DETAIL).select("snapshot_id", "pixel_id", "image")


EDGE = f"(lo + {{}}*((hi - lo)/{RINGS_N}e0))"
RING = FRAME | {"lit": "SELECT * FROM fr WHERE image > 0 AND rho >= 105e-2", "spn": "SELECT snapshot_id, min(rho) AS lo, max(rho) AS hi FROM lit GROUP BY snapshot_id",
    "edg": f"SELECT snapshot_id, CAST(range AS BIGINT) AS ring, {EDGE.format('range')} AS e0, {EDGE.format('(range + 1)')} AS e1 FROM spn, range({RINGS_N})",
    "st": "SELECT e.snapshot_id, e.ring, count(*) AS n, median(l.image) AS m FROM edg e JOIN lit l ON l.snapshot_id = e.snapshot_id AND l.rho >= e.e0 AND l.rho < e.e1 GROUP BY e.snapshot_id, e.ring",
    "good": "SELECT snapshot_id, ring, log10(m) AS lg, row_number() OVER w AS k, count(*) OVER (PARTITION BY snapshot_id) AS n FROM st WHERE n >= 8 WINDOW w AS (PARTITION BY snapshot_id ORDER BY ring)",
    "off": "SELECT g.snapshot_id, g.ring, g.n, g.lg, greatest(least(g.k + o.d, g.n), 1) AS kk FROM good g, (SELECT CAST(range AS BIGINT) - 2 AS d FROM range(5)) o",
    "smo": "SELECT o.snapshot_id, o.ring, power(1e1, CASE WHEN max(o.n) > 5 THEN avg(g.lg) ELSE max(o.lg) END) AS median FROM off o JOIN good g ON g.snapshot_id = o.snapshot_id AND g.k = o.kk GROUP BY o.snapshot_id, o.ring",
    "rings": "SELECT e.snapshot_id, e.ring, 5e-1*(e.e0 + e.e1) AS center, s.median FROM edg e LEFT JOIN smo s ON s.snapshot_id = e.snapshot_id AND s.ring = e.ring"}


@query("ring_medians", with_views("points", more=RING, final=f"SELECT snapshot_id, ring, {r6(center='center', median='median')} FROM rings"))
def ring_medians(d):
    return br.ring_medians(curve_frame(d), "image", 1.05, RINGS_N)


FIT = RING | {"coef": q.coefficient_table(), "tri": "SELECT r.*, 15e-1 + range*5e-2 AS a FROM rings r, range(91) WHERE median > 0"} | _profile("tri", "snapshot_id, ring, a, median", "center", "a", FIT_N, "cur") | {
    "sc": "SELECT snapshot_id, a, var_pop(log10(median) - log10(model)) AS v FROM cur WHERE model > 0 GROUP BY snapshot_id, a",
    "best": "SELECT snapshot_id, arg_min(a, v) AS exponent FROM sc GROUP BY snapshot_id",
    "bas": "SELECT r.*, b.exponent - 9e-1 AS ae FROM rings r JOIN best b USING (snapshot_id)"} | _profile("bas", "snapshot_id, ring, center, median", "center", "ae", SAMPLES_N, "env") | {
    "nd": "SELECT snapshot_id, center, median AS mu, median/model AS en, lead(center) OVER w AS c1, lead(median) OVER w AS mu1, lead(median/model) OVER w AS en1, row_number() OVER w AS k, count(*) OVER (PARTITION BY snapshot_id) AS n FROM env WHERE median > 0 AND model > 0 WINDOW w AS (PARTITION BY snapshot_id ORDER BY center)",
    "at2": "SELECT f.snapshot_id, f.pixel_id, f.rho, f.image, d.mu + t*(d.mu1 - d.mu) AS mu, d.en + t*(d.en1 - d.en) AS en FROM fr f JOIN nd d ON d.snapshot_id = f.snapshot_id AND d.c1 IS NOT NULL AND (f.rho >= d.center OR d.k = 1) AND (f.rho < d.c1 OR d.k = d.n - 1), LATERAL (SELECT greatest(least((f.rho - d.center)/(d.c1 - d.center), 1e0), 0e0) AS t) u",
    "ada": "SELECT snapshot_id, pixel_id, rho, CASE WHEN image > 0 AND rho >= 105e-2 AND mu > 0 THEN en*power(image/mu, 3) ELSE 0e0 END AS image FROM at2"}


@query("fit_exponent", with_views("points", more=FIT, final=f"SELECT snapshot_id, {r6(exponent='exponent')} FROM best"))
def fit_exponent(d):
    rings = br.ring_medians(curve_frame(d), "image", 1.05, RINGS_N)
    return br.fit_exponent(rings, 1.0, 2.5, samples=FIT_N)


@query("vignette_adaptive", with_views("points", more=FIT, final=f"SELECT {PX}, {r6(image='image')} FROM ada"))
def vignette_adaptive(d):
    out = br.vignette_adaptive(curve_frame(d), "image", 1.05, 1.0, 2.5, samples=SAMPLES_N, fit_samples=FIT_N, n_rings=RINGS_N)
    return out.select("snapshot_id", "pixel_id", "image")


@query("stretch_frame", with_views("points", more=FRAME | q.stretch(["image"], "fr", PX, anchor="image > 0", log=True), final=f"SELECT {PX}, {r6(image='image')} FROM scaled"))
def stretch_frame(d):
    return br.stretch_frame(curve_frame(d), "image").select("snapshot_id", "pixel_id", "image")


@query("brightness_display", with_views("points", more=NEWKIRK | q.stretch(["image"], "vig", PX, anchor="image > 0", log=True), final=f"SELECT {PX}, {r6(display='image')} FROM scaled"))
def brightness_display(d):
    pair = curve_frame(d).withColumn("polarized", F.col("image")).withColumn("total", F.col("image") * 2.0)
    return br.brightness_display(pair, "polarized", "newkirk", 1.05, 1.0, 2.5, **DETAIL).select("snapshot_id", "pixel_id", "display")


# shell map

SHELL = {"sh": """SELECT snapshot_id, seed_id, 18e-1*sin(theta)*cos(phi) AS x, 18e-1*sin(theta)*sin(phi) AS y, 18e-1*cos(theta) AS z
    FROM (SELECT snapshot_id, id AS seed_id, (floor(id/36e0) + 5e-1)*pi()/18e0 AS theta, (id % 36 + 5e-1)*pi()/18e0 AS phi
          FROM snapshots, (SELECT CAST(range AS BIGINT) AS id FROM range(648)) t) a"""}
MAP = SHELL | {"sn": "SELECT snapshot_id, i_r, i_t, i_p, log_q, sign(b_x*x + b_y*y + b_z*z) AS sg FROM nodes"} | {
    k: (q.padded(["log_q", "sg"], "sn") if k == "pad" else v) for k, v in q.stencil_steps("sh", "snapshot_id, seed_id", ["log_q", "sg"], skip=True).items()}


def shell_map(d: Inputs):
    from heliospark.operators.volume import radial_sign_grid

    return pipeline.qmap_slice(d.volume, GRID, radial_sign_grid(d.nodes), GRID, 1.8, 18, 36)


@query("qmap_slice", with_views("snapshots", "nodes", more=MAP, final=f"SELECT snapshot_id, seed_id, {r6(log_q='log_q')}, {big(radial_sign='sign(sg)')} FROM read"))
def qmap_slice(d):
    return shell_map(d).select("snapshot_id", "seed_id", "log_q", "radial_sign")


@query("qmap_metrics", with_views("snapshots", "nodes", more=MAP, final=f"""SELECT snapshot_id, {r6(coverage='avg(CASE WHEN log_q IS NOT NULL THEN 1e0 ELSE 0e0 END)',
    sub_floor_fraction=f'count(*) FILTER (WHERE log_q < {q.LOG_FLOOR})/count(log_q)')} FROM read GROUP BY snapshot_id"""))
def qmap_metrics(d):
    return pipeline.qmap_metrics(shell_map(d))


assert rad.CROSSOVER > GRID.outer  # the checking SQL states the closed form only
