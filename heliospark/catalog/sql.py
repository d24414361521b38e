"""Pieces of the checking queries: plain SQL statements of the formulas, independent of the Spark code."""

from __future__ import annotations

W = (
    "CASE {d} WHEN 0 THEN -5e-1*{t}*{t}*{t} + {t}*{t} - 5e-1*{t} WHEN 1 THEN 15e-1*{t}*{t}*{t} - 25e-1*{t}*{t} + 1e0 "
    "WHEN 2 THEN -15e-1*{t}*{t}*{t} + 2e0*{t}*{t} + 5e-1*{t} ELSE 5e-1*{t}*{t}*{t} - 5e-1*{t}*{t} END"
)
DW = (
    "CASE {d} WHEN 0 THEN -15e-1*{t}*{t} + 2e0*{t} - 5e-1 WHEN 1 THEN 45e-1*{t}*{t} - 5e0*{t} "
    "WHEN 2 THEN -45e-1*{t}*{t} + 4e0*{t} + 5e-1 ELSE 15e-1*{t}*{t} - 1e0*{t} END"
)
FOUR = "(SELECT CAST(range AS BIGINT) AS d FROM range(4))"


def spherical(source: str, keep: str) -> str:
    """Angles of the positions of a table."""
    return f"""SELECT {keep}, x, y, z, r, acos(greatest(least(z/r, 1e0), -1e0)) AS theta,
        CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2e0*pi() ELSE atan2(y, x) END AS phi
        FROM (SELECT {keep}, x, y, z, sqrt(x*x + y*y + z*z) AS r FROM {source}) s"""


def index(source: str, keep: str) -> str:
    """Fractional indices on the 5 x 15 x 20 log grid of the inputs."""
    return f"""SELECT {keep}, x, y, z, r, theta, phi, ln(r)/ln(25e-1)*4e0 AS fr, theta/(pi()/15e0) - 5e-1 AS ft,
        CASE WHEN phi/(pi()/10e0) >= 20e0 THEN phi/(pi()/10e0) - 20e0 ELSE phi/(pi()/10e0) END AS fp FROM {source}"""


def padded(columns: list[str], source: str = "nodes") -> str:
    """Nodes with two ghost layers at each radial end; NULL where a source layer is missing."""
    cols = ", ".join(columns)
    parts = [f"SELECT snapshot_id, i_r, i_t, i_p, {cols} FROM {source}"]
    for ghost, layers in ((-1, (0, 1, 2)), (-2, (0, 1, 2)), (5, (4, 3, 2)), (6, (4, 3, 2))):
        w = ("3e0", "-3e0", "1e0") if ghost in (-1, 5) else ("6e0", "-8e0", "3e0")
        sums = ", ".join(f"{w[0]}*a.{c} + ({w[1]})*b.{c} + {w[2]}*c.{c} AS {c}" for c in columns)
        parts.append(
            f"""SELECT a.snapshot_id, CAST({ghost} AS BIGINT) AS i_r, a.i_t, a.i_p, {sums} FROM {source} a
            JOIN {source} b ON a.snapshot_id = b.snapshot_id AND a.i_t = b.i_t AND a.i_p = b.i_p AND b.i_r = {layers[1]}
            JOIN {source} c ON a.snapshot_id = c.snapshot_id AND a.i_t = c.i_t AND a.i_p = c.i_p AND c.i_r = {layers[2]}
            WHERE a.i_r = {layers[0]}"""
        )
    return " UNION ALL ".join(parts)


def taps(source: str, keep: str, slopes: bool = False) -> str:
    """64 rows per indexed point with node keys and weights."""
    q = {a: (f"{a}.d", f"(f{a} - floor(f{a}))") for a in "rtp"}
    w = {a: W.format(d=d, t=t) for a, (d, t) in q.items()}
    dw = {a: DW.format(d=d, t=t) for a, (d, t) in q.items()}
    weights = f"({w['r']})*({w['t']})*({w['p']}) AS w"
    if slopes:
        weights += f", ({dw['r']})*({w['t']})*({w['p']}) AS w_r, ({w['r']})*({dw['t']})*({w['p']}) AS w_t, ({w['r']})*({w['t']})*({dw['p']}) AS w_p"
    raw_t, raw_p = "CAST(floor(ft) AS BIGINT) + t.d - 1", "CAST(floor(fp) AS BIGINT) + p.d - 1"
    past = f"({raw_t} < 0 OR {raw_t} > 14)"
    return f"""SELECT {keep}, CAST(floor(fr) AS BIGINT) + r.d - 1 AS i_r,
        CASE WHEN {raw_t} < 0 THEN -1 - ({raw_t}) WHEN {raw_t} > 14 THEN 29 - ({raw_t}) ELSE {raw_t} END AS i_t,
        ({raw_p} + CASE WHEN {past} THEN 10 ELSE 0 END + 20) % 20 AS i_p, {weights}
        FROM {source} CROSS JOIN {FOUR} r CROSS JOIN {FOUR} t CROSS JOIN {FOUR} p"""


def stencil_steps(source: str, keep: str, columns: list[str], skip: bool = False, slopes: bool = False) -> dict[str, str]:
    """CTE steps ending in ``read``: one row per point with the value of each column."""
    keys = ", ".join(f"k.{c.strip()}" for c in keep.split(","))
    out = []
    for c in columns:
        if skip:
            kept = f"sum(CASE WHEN n.{c} IS NOT NULL THEN k.w END)"
            out.append(f"CASE WHEN abs({kept}) > 1e-6 THEN sum(k.w*n.{c})/{kept} END AS {c}")
        else:
            out.append(f"CASE WHEN count(n.{c}) = 64 THEN sum(k.w*n.{c}) END AS {c}")
            if slopes:
                out += [f"sum(k.w_{a}*n.{c}) AS {c}_{a}" for a in "rtp"]
    return {
        "sph": spherical(source, keep),
        "idx": index("sph", keep),
        "tap": taps("idx", keep, slopes),
        "pad": padded(columns),
        "read": f"""SELECT {keys}, {', '.join(out)} FROM tap k LEFT JOIN pad n
            ON k.snapshot_id = n.snapshot_id AND k.i_r = n.i_r AND k.i_t = n.i_t AND k.i_p = n.i_p GROUP BY {keys}""",
    }


def pixels(name: str = "snapshots") -> str:
    """24 x 24 pixels per snapshot, field of view 6, camera on +x."""
    return f"""SELECT snapshot_id, pixel_id, prow, pcol, px, py, sqrt(px*px + py*py) AS rho, 0e0 AS ox, px AS oy, py AS oz
        FROM (SELECT snapshot_id, id AS pixel_id, CAST(floor(id/24e0) AS BIGINT) AS prow, id % 24 AS pcol,
                     (id % 24 - 115e-1)*25e-2 AS px, (115e-1 - floor(id/24e0))*25e-2 AS py
              FROM {name}, (SELECT CAST(range AS BIGINT) AS id FROM range(576)) t) p"""


def samples(source: str = "pix", inside: bool = True) -> str:
    """51 samples per ray at step 0.1, only those in the shell."""
    where = "WHERE r >= 1e0 AND r <= 25e-1" if inside else ""
    return f"""SELECT * FROM (SELECT snapshot_id, pixel_id, k, rho, s, ox + s AS x, oy AS y, oz AS z, sqrt(rho*rho + s*s) AS r
        FROM (SELECT *, -25e-1 + k*(5e0/50e0) AS s FROM {source}, (SELECT CAST(range AS BIGINT) AS k FROM range(51)) t) a) b {where}"""


def minnaert(r: str) -> dict[str, str]:
    """Coefficients A, B, C, D by the closed form (valid inside radius 10)."""
    s, c = f"(1e0/({r}))", f"sqrt(greatest(1e0 - 1e0/(({r})*({r})), 0e0))"
    limb = f"(CASE WHEN {c} > 1e-12 THEN {c}*{c}/{s}*ln((1e0 + {s})/greatest({c}, 1e-12)) ELSE 0e0 END)"
    return {
        "a": f"({c}*{s}*{s})",
        "b": f"(-(1e0 - 3e0*{s}*{s} - (1e0 + 3e0*{s}*{s})*{limb})/8e0)",
        "c": f"(4e0/3e0 - {c} - {c}*{c}*{c}/3e0)",
        "d": f"((5e0 + {s}*{s} - (5e0 - {s}*{s})*{limb})/8e0)",
    }


def coefficients(r: str) -> tuple[str, str]:
    """Tangential and polarized coefficient at limb darkening 0.6."""
    m = minnaert(r)
    return f"(4e-1*{m['c']} + 6e-1*{m['d']})", f"(4e-1*{m['a']} + 6e-1*{m['b']})"


def coefficient_table() -> str:
    """4096 log-spaced nodes over the shell 1 to 2.5."""
    c_tan, c_pol = coefficients("r")
    return f"""SELECT j, {c_tan} AS c_tan, {c_pol} AS c_pol FROM
        (SELECT CAST(range AS BIGINT) AS j, exp(ln(25e-1)*range/4095e0) AS r FROM range(4096)) t"""


def table_read(source: str, keep: str) -> str:
    """Both coefficients of each row of ``source`` (column r), linear in ln r between table nodes."""
    at = "greatest(least(ln(r)/(ln(25e-1)/4095e0), 4095e0), 0e0)"
    return f"""SELECT {keep}, a.c_tan*(1e0 - f) + b.c_tan*f AS c_tan, a.c_pol*(1e0 - f) + b.c_pol*f AS c_pol
        FROM (SELECT *, CAST(floor({at}) AS BIGINT) AS j, {at} - floor({at}) AS f FROM {source}) q
        JOIN coef a ON a.j = q.j JOIN coef b ON b.j = least(q.j + 1, 4095)"""


def clamp(e: str, low: str, high: str) -> str:
    return f"greatest(least({e}, {high}), {low})"


LOG_FLOOR = "log10(2e0)"
SIGMA = "(pi()/9e0/sqrt(2e0*ln(2e0)))"


def weights() -> str:
    """Three channel weights of the wide preset at (s, r)."""
    g = f"exp(-5e-1*(s/(r*{SIGMA}))*(s/(r*{SIGMA})))"
    return f"{g}*power(r, -3e0) AS w_0, {g}*power(r, -2e0) AS w_1, {g}*power(r, -15e-1) AS w_2"


def alpha(rho: str, radius: str = "1e0", soft: str = "3e-2") -> str:
    t = f"greatest(least(({rho} - ({radius} - {soft}))/{soft}, 1e0), 0e0)"
    return f"({t}*{t}*(3e0 - 2e0*{t}))"


def stretch(columns: list[str], source: str, keep: str, anchor: str | None = None, log: bool = False) -> dict[str, str]:
    """CTE steps ending in ``scaled``."""
    val = {c: f"log10(greatest({c}, 1e-300))" if log else c for c in columns}
    pre = ", ".join(f"{v} AS {c}" for c, v in val.items())
    hold = f", {anchor} AS ok" if anchor else ", true AS ok"
    lim = ", ".join(
        f"coalesce(quantile_cont({c}, {p}) FILTER (WHERE ok), quantile_cont({c}, {p})) AS {n}_{c}"
        for c in columns for n, p in (("lo", 0.01), ("hi", 0.995))
    )
    out = ", ".join(
        f"CASE WHEN p.{c} IS NULL THEN 0e0 ELSE greatest(least((p.{c} - lo_{c})/CASE WHEN hi_{c} > lo_{c} THEN hi_{c} - lo_{c} ELSE 1e0 END, 1e0), 0e0) END AS {c}"
        for c in columns
    )
    kept = ", ".join(f"p.{k.strip()}" for k in keep.split(","))
    return {
        "pre": f"SELECT {keep}, {pre}{hold} FROM {source}",
        "lim": f"SELECT snapshot_id, {lim} FROM pre GROUP BY snapshot_id",
        "scaled": f"SELECT {kept}, {out} FROM pre p JOIN lim USING (snapshot_id)",
    }
