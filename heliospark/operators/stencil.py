"""Stencil joins in long form: expand taps, equi-join rings or bands of nodes, sum the weights.

The relational twin of ``tiles``: every step is a Column expression, a join or a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.geometry import cart_to_sph
from heliospark.functions.grid import GridSpec, keys_weights
from heliospark.session import large

NODE_KEY = ["snapshot_id", "i_r", "i_t", "i_p"]
MIN_KEPT_WEIGHT = 1e-6


def ghost_theta(spec: GridSpec, i_t: Column, i_p: Column) -> tuple[Column, Column]:
    """A row past a pole is the mirrored row half a turn away; azimuth wraps."""
    past = (i_t < 0) | (i_t >= spec.n_theta)
    mirrored = (
        F.when(i_t < 0, -1 - i_t).when(i_t >= spec.n_theta, 2 * spec.n_theta - 1 - i_t).otherwise(i_t)
    )
    turned = i_p + F.when(past, F.lit(spec.n_phi // 2)).otherwise(F.lit(0))
    return mirrored.cast("long"), ghost_phi(spec, turned)


def ghost_phi(spec: GridSpec, i_p: Column) -> Column:
    return F.pmod(i_p, F.lit(spec.n_phi)).cast("long")


def ghost_radial(nodes: DataFrame, spec: GridSpec, values: list[str]) -> DataFrame:
    """Two ghost layers at each radial end, by the quadratic through the three nearest layers."""
    n = spec.n_r
    # ghost layer, source layer, coefficient
    recipe = []
    for depth, weights in ((1, (3.0, -3.0, 1.0)), (2, (6.0, -8.0, 3.0))):
        for k, w in enumerate(weights):
            recipe += [(-depth, k, w), (n - 1 + depth, n - 1 - k, w)]
    by_source: dict[int, list] = {}
    for ghost, source, w in recipe:
        by_source.setdefault(source, []).append(F.struct(F.lit(ghost).alias("g"), F.lit(w).alias("w")))
    uses = None
    for source, parts in by_source.items():
        here = F.col("i_r") == source
        uses = F.when(here, F.array(*parts)) if uses is None else uses.when(here, F.array(*parts))
    rows = nodes.where(F.col("i_r").isin(list(by_source))).withColumn("_use", F.explode(uses))
    full = {v: F.count(v) == 3 for v in values}
    return (
        rows.groupBy("snapshot_id", F.col("_use.g").cast("long").alias("i_r"), "i_t", "i_p")
        .agg(*[F.when(full[v], F.sum(F.col("_use.w") * F.col(v))).alias(v) for v in values])
        .select(*NODE_KEY, *values)
    )


def pad_radial(nodes: DataFrame, spec: GridSpec, values: list[str]) -> DataFrame:
    core = nodes.select(*[F.col(c).cast("long").alias(c) for c in NODE_KEY], *values)
    return core.unionByName(ghost_radial(core, spec, values))


def _taps(fraction: Column, base: Column) -> Column:
    weights = keys_weights(fraction)
    return F.array(*[F.struct((base + (d - 1)).cast("long").alias("i"), weights[d].alias("w")) for d in range(4)])


def interpolate(
    points: DataFrame,
    nodes: DataFrame,
    spec: GridSpec,
    values: list[str],
    row_id: list[str],
    skip_missing: bool = False,
    at=("x", "y", "z"),
) -> DataFrame:
    """Tricubic values of node columns at each point, keyed by snapshot_id and ``row_id``.

    Missing taps make the value NULL, or are left out of sum and weight with ``skip_missing``.
    """
    keys = ["snapshot_id", *row_id]
    fr, ft, fp = spec.index_of(*cart_to_sph(*(F.col(c) for c in at)))
    fr = F.least(F.greatest(fr, F.lit(-1.0)), F.lit(spec.n_r - 1.0))
    df = points.select(*keys, fr.alias("_fr"), ft.alias("_ft"), fp.alias("_fp"))
    for axis in "rt":
        f = F.col(f"_f{axis}")
        df = df.withColumn(f"_{axis}", F.explode(_taps(f - F.floor(f), F.floor(f))))
    i_t, turned = ghost_theta(spec, F.col("_t.i"), F.floor("_fp").cast("long"))
    taps = df.select(*keys, F.col("_r.i").alias("i_r"), i_t.alias("i_t"), turned.alias("_bp"), (F.col("_r.w") * F.col("_t.w")).alias("_w"), "_fp")
    # the four azimuths of a tap are read on its ring, so a point is spread over 16 rows and not 64
    on = ["snapshot_id", "i_r", "i_t"]
    joined = taps.join(large(rings(pad_radial(nodes, spec, values), on, values)), on, "left")
    weights = keys_weights(F.col("_fp") - F.floor("_fp"))
    sides = [(on_ring(ghost_phi(spec, F.col("_bp") + (d - 1))), F.col("_w") * weights[d]) for d in range(4)]
    nil = F.lit(0.0)
    out, sums = [], []
    for k, v in enumerate(values):
        held = [n[v].isNotNull() for n, _ in sides]
        sums += [
            sum(F.coalesce(w * n[v], nil) for n, w in sides).alias(f"_s{k}"),
            sum(h.cast("int") for h in held).alias(f"_n{k}"),
            sum(F.when(h, w).otherwise(nil) for h, (_, w) in zip(held, sides)).alias(f"_k{k}"),
        ]
        total, kept = F.sum(f"_s{k}"), F.sum(f"_k{k}")
        whole = F.abs(kept) > MIN_KEPT_WEIGHT if skip_missing else F.sum(f"_n{k}") == 64
        out.append(F.when(whole, total / kept if skip_missing else total).alias(v))
    return joined.select(*keys, *sums).groupBy(*keys).agg(*out)


def rings(nodes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per ring of azimuths: ``_ring``, its nodes in order and without holes, and ``_first``, where it starts.

    A stencil then reads its azimuths at one place, so a point is spread over rings instead of nodes.
    """
    node = F.struct(F.col("i_p").cast("long").alias("i_p"), *values)
    df = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("_ring"))
    df = df.withColumn("_first", F.get("_ring", F.lit(0))["i_p"])
    last = F.element_at("_ring", -1)["i_p"]
    at = lambda i: F.get(F.filter("_ring", lambda n: n["i_p"] == i), F.lit(0))
    whole = F.size("_ring") == last - F.col("_first") + 1
    return df.withColumn("_ring", F.when(whole, F.col("_ring")).otherwise(F.transform(F.sequence("_first", last), at)))


def on_ring(i_p: Column) -> Column:
    """The node of a ring at an azimuth index; NULL where there is none."""
    return F.get("_ring", (i_p - F.col("_first")).cast("int"))


def boundary_lookup(feet: DataFrame, maps: DataFrame, n_theta: int, n_phi: int, row_id: list[str]) -> DataFrame:
    """Bicubic log Q of a foot on the map of its sphere; a missing tap makes the value NULL.

    ``feet`` has snapshot_id, row_id, sphere, theta, phi (sphere NULL where there is no foot);
    ``maps`` has snapshot_id, sphere, i_t, i_p, log_q.
    """
    import math

    from heliospark.functions.geometry import TWO_PI

    keys = ["snapshot_id", *row_id]
    df = feet.select(
        *keys,
        "sphere",
        (F.col("theta") / (math.pi / n_theta) - 0.5).alias("_ft"),
        (F.pmod(F.col("phi"), F.lit(TWO_PI)) / (TWO_PI / n_phi)).alias("_fp"),
    )
    # a foot goes to the one band of map rows that holds its stencil
    base, turn = F.floor("_ft").cast("long"), F.floor("_fp").cast("long")
    feet = df.select(
        *keys, "sphere", F.floor((base + 1) / BAND).cast("long").alias("band"), F.pmod(base + 1, F.lit(BAND)).cast("int").alias("_q"),
        turn.alias("_bp"), (F.col("_ft") - base).alias("_at"), (F.col("_fp") - turn).alias("_ap"),
    )
    joined = feet.join(large(_bands(maps, n_theta, n_phi)), ["snapshot_id", "sphere", "band"], "left")
    w_t, w_p = keys_weights(F.col("_at")), keys_weights(F.col("_ap"))
    azimuth = [F.pmod(F.col("_bp") + (d - 1), F.lit(n_phi)).cast("int") for d in range(4)]
    row = lambda k: F.get("_rows", F.col("_q") + k)
    total = sum(w_t[k] * sum(w_p[d] * F.get(row(k), azimuth[d]) for d in range(4)) for k in range(4))
    return joined.select(*keys, total.alias("log_q"))


#: Rows of a map that lie in one band, besides the three that a stencil reaches beyond them.
BAND = 8


def _bands(maps: DataFrame, n_theta: int, n_phi: int) -> DataFrame:
    """Bands of map rows (``_rows``: arrays over the azimuth), rows past a pole included; what is missing is NULL."""
    ring = rings(maps, ["snapshot_id", "sphere", "i_t"], ["log_q"])
    place = lambda j, turned: F.struct(j.cast("long").alias("j"), F.lit(turned).alias("turn"))
    i_t, half = F.col("i_t"), n_phi // 2
    copies = F.array(place(i_t, 0), F.when(i_t < 2, place(-1 - i_t, half)), F.when(i_t >= n_theta - 2, place(2 * n_theta - 1 - i_t, half)))
    rows = ring.withColumn("_c", F.explode(copies)).where(F.col("_c").isNotNull())
    around = F.sequence(F.lit(0).cast("long"), F.lit(n_phi - 1).cast("long"))
    values = F.transform(around, lambda i: F.get("_ring", (F.pmod(i + F.col("_c.turn"), F.lit(n_phi)) - F.col("_first")).cast("int"))["log_q"])
    # a band of bases from BAND * b - 1 on reads rows from BAND * b - 2 on
    first, last = F.floor((F.col("_c.j") - BAND) / BAND), F.floor((F.col("_c.j") + 2) / BAND)
    rows = rows.select("snapshot_id", "sphere", F.col("_c.j").alias("_j"), values.alias("_v"), F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))).alias("band"))
    at = F.col("_j") - (F.col("band") * BAND - 2)
    slots = [F.max(F.when(at == k, F.col("_v"))).alias(f"_r{k}") for k in range(BAND + 3)]
    bands = rows.where((at >= 0) & (at < BAND + 3)).groupBy("snapshot_id", "sphere", "band").agg(*slots)
    return bands.select("snapshot_id", "sphere", F.col("band").cast("long").alias("band"), F.array(*[F.col(f"_r{k}") for k in range(BAND + 3)]).alias("_rows"))
