"""Scattered-light frames and their radial detrending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.functions import imaging as im
from heliospark.functions import radiation as rad
from heliospark.operators.generators import counter
from heliospark.operators.lookup import even_curve, interp_table
from heliospark.operators.los import percentile_stretch
from heliospark.operators.ranks import quantiles
from heliospark.session import materialise

NEWKIRK_EXPONENT = 4.32
PROFILE_NODES = 1024
PROFILE_SAMPLES = 2048
FIT_SAMPLES = 512
RINGS = 256
MIN_RING_PIXELS = 8
MARGIN = 0.9
GAIN = 3.0
#: First exponent, step and number of candidates of the fit (1.5 to 6.0).
FIT_GRID = (1.5, 0.05, 91)


def finalize_brightness(sums: DataFrame, occult="eclipse", r_occult=1.0, softness=0.03) -> DataFrame:
    """Polarized and total brightness from k_tan, k_pol (already times the step)."""
    if occult not in ("eclipse", "none"):
        raise ValueError(f"occult is 'eclipse' or 'none', not {occult!r}")
    alpha = im.eclipse_alpha(F.col("rho"), r_occult, softness) if occult == "eclipse" else F.lit(1.0)
    kept = [c for c in sums.columns if c not in ("k_tan", "k_pol")]
    return sums.select(
        *kept,
        (F.col("k_pol") * alpha).alias("polarized"),
        ((2.0 * F.col("k_tan") - F.col("k_pol")) * alpha).alias("total"),
    )


def polarization(polarized: Column, total: Column) -> Column:
    return F.when(total > 0, polarized / total).otherwise(F.lit(0.0))


def brightness_metrics(frame: DataFrame) -> DataFrame:
    """Median polarization of lit pixels and the decades spanned by polarized brightness."""
    p = F.when(F.col("total") > 0, polarization(F.col("polarized"), F.col("total")))
    lit = F.when(F.col("polarized") > 0, F.col("polarized"))
    frame = materialise(frame, "frame")
    middle = quantiles(frame, {"_p": p}, [0.5]).select("snapshot_id", F.coalesce(F.get("_p", F.lit(0)), F.lit(0.0)).alias("median_polarization"))
    decades = frame.groupBy("snapshot_id").agg(F.coalesce(F.log10(F.max(lit) / F.min(lit)), F.lit(0.0)).alias("pb_decades"))
    return middle.join(decades, "snapshot_id")


def hydrostatic_profile(
    nodes: DataFrame, rho: Column, exponent: Column, keys: list[str], out: str, r_inner: float, r_outer: float,
    frame: str = "polarized", u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER, samples=PROFILE_SAMPLES,
) -> DataFrame:
    """Model brightness at an impact parameter: a trapezoid over half a line of sight through
    the density 10^(exponent / r). ``keys`` identify a node; other columns are dropped.

    Samples are exploded and summed per node; partial sums keep the shuffle at one row per node.
    """
    reach = F.sqrt(F.greatest(F.lit(r_outer * r_outer) - rho * rho, F.lit(0.0)))
    df = nodes.select(*keys, rho.alias("_rho"), exponent.cast("double").alias("_a"), (reach / (samples - 1)).alias("_ds"))
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    s = F.col("_k") * F.col("_ds")
    df = df.withColumn("_r", F.sqrt(F.col("_rho") * F.col("_rho") + s * s))
    r = F.greatest(F.col("_r"), F.lit(r_inner))
    c_tan, c_pol = rad.table_lookup(r, r_inner, r_outer, u, crossover)
    light = rad.thomson_intensity(F.col("_rho"), r, c_tan, c_pol, "pB" if frame == "polarized" else "K")
    end = F.when(F.col("_k").isin(0, samples - 1), F.lit(1.0)).otherwise(F.lit(2.0))
    term = F.when(F.col("_r") >= r_inner, end * F.pow(F.lit(10.0), F.col("_a") / r) * light * F.col("_ds"))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias(out))


def vignette_newkirk(
    frame: DataFrame, image: str, reference_radius: float, r_inner: float, r_outer: float, kind="polarized",
    u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER, nodes=PROFILE_NODES, samples=PROFILE_SAMPLES,
) -> DataFrame:
    """Image times reference over model brightness; 0 below the reference radius or where the model is 0."""
    top = frame.groupBy("snapshot_id").agg(F.max("rho").alias("_top"))
    grid = counter(frame, "_node", nodes).join(top, "snapshot_id")
    rho = F.col("_top") * F.col("_node") / (nodes - 1)
    profile = hydrostatic_profile(
        grid, rho, F.lit(NEWKIRK_EXPONENT), ["snapshot_id", "_node"], "_model", r_inner, r_outer, kind, u, crossover, samples
    )
    level = even_curve(
        top, profile, F.least(F.lit(reference_radius), F.col("_top")), "_node", "_model", F.col("_top"), nodes, "_ref"
    )
    peak = profile.groupBy("snapshot_id").agg(F.max("_model").alias("_peak"))
    fallback = F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(F.lit(1.0))
    level = level.join(peak, "snapshot_id").select(
        "snapshot_id", "_top", F.when(F.col("_ref") > 0, F.col("_ref")).otherwise(fallback).alias("_ref")
    )
    df = even_curve(
        frame.join(level, "snapshot_id"), profile, F.col("rho"), "_node", "_model", F.col("_top"), nodes, "_model"
    )
    shown = (F.col("_model") > 0) & (F.col("rho") >= reference_radius)
    detrended = F.when(shown, F.col(image) * F.col("_ref") / F.col("_model")).otherwise(F.lit(0.0))
    return df.withColumn(image, F.coalesce(detrended, F.lit(0.0))).select(*frame.columns)


def ring_medians(frame: DataFrame, image: str, floor: float, n_rings: int = RINGS) -> DataFrame:
    """Median brightness of equal-width rings of positive pixels, smoothed over good rings.

    Rows: snapshot_id, ring, center, median (NULL for a ring with too few pixels).
    """
    lit = frame.where((F.col(image) > 0) & (F.col("rho") >= floor)).select("snapshot_id", "rho", F.col(image).alias("_v"))
    span = lit.groupBy("snapshot_id").agg(F.min("rho").alias("_lo"), F.max("rho").alias("_hi"))
    edge = lambda k: F.col("_lo") + k * ((F.col("_hi") - F.col("_lo")) / n_rings)
    # ring k holds edge k <= rho < edge k+1; the outermost pixel itself belongs to no ring
    guess = F.floor(F.try_divide(F.col("rho") - F.col("_lo"), (F.col("_hi") - F.col("_lo")) / n_rings))
    ring = F.when(F.col("rho") < edge(guess), guess - 1).when(F.col("rho") >= edge(guess + 1), guess + 1).otherwise(guess)
    ringed = lit.join(span, "snapshot_id").withColumn("ring", ring.cast("long"))
    ringed = ringed.where(F.col("rho") < edge(F.lit(n_rings)))
    stats = ringed.groupBy("snapshot_id", "ring").agg(F.count(F.lit(1)).alias("_n"), F.median("_v").alias("_m"))
    good = stats.where(F.col("_n") >= MIN_RING_PIXELS).select("snapshot_id", "ring", F.log10("_m").alias("_log"))
    # five-point mean over consecutive good rings, the end values repeated; kept raw up to five rings
    w = Window.partitionBy("snapshot_id").orderBy("ring")
    whole = Window.partitionBy("snapshot_id")
    total = F.lit(0.0)
    first = F.first("_log").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last("_log").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for d in (-2, -1, 0, 1, 2):
        near = F.lead("_log", d).over(w) if d > 0 else F.lag("_log", -d).over(w) if d < 0 else F.col("_log")
        total = total + F.coalesce(near, last if d > 0 else first)
    smooth = F.when(F.count(F.lit(1)).over(whole) > 5, total / 5.0).otherwise(F.col("_log"))
    medians = good.select("snapshot_id", "ring", F.pow(F.lit(10.0), smooth).alias("median"))
    rings = span.withColumn("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rings - 1).cast("long"))))
    center = 0.5 * (edge(F.col("ring")) + edge(F.col("ring") + 1))
    return rings.select("snapshot_id", "ring", center.alias("center")).join(medians, ["snapshot_id", "ring"], "left")


def fit_exponent(rings: DataFrame, r_inner, r_outer, kind="polarized", u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER, samples=FIT_SAMPLES) -> DataFrame:
    """Exponent whose model curve leaves the least variance of log residuals, per snapshot."""
    start, step, n = FIT_GRID
    good = rings.where(F.col("median") > 0)
    tries = good.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("a", start + F.col("_j") * step)
    keys = ["snapshot_id", "ring", "a", "median"]
    curve = hydrostatic_profile(tries, F.col("center"), F.col("a"), keys, "_c", r_inner, r_outer, kind, u, crossover, samples)
    residual = F.log10("median") - F.when(F.col("_c") > 0, F.log10("_c"))
    scores = curve.groupBy("snapshot_id", "a").agg(F.var_pop(residual).alias("_var"), F.count(F.lit(1)).alias("_n"))
    best = F.min_by("a", F.struct(F.coalesce(F.col("_var"), F.lit(float("inf"))), F.col("a")))
    return scores.groupBy("snapshot_id").agg(
        F.when(F.max("_n") >= MIN_RING_PIXELS, best).otherwise(F.lit(NEWKIRK_EXPONENT)).alias("exponent")
    )


def vignette_adaptive(
    frame: DataFrame, image: str, reference_radius: float, r_inner: float, r_outer: float, kind="polarized",
    u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER, margin=MARGIN, gain=GAIN, samples=PROFILE_SAMPLES, fit_samples=FIT_SAMPLES,
    n_rings=RINGS,
) -> DataFrame:
    """Divide by the ring medians, raise the structure, and shape it by a flattened model envelope."""
    rings = ring_medians(frame, image, reference_radius, n_rings)
    exponent = fit_exponent(rings, r_inner, r_outer, kind, u, crossover, fit_samples)
    based = rings.join(exponent, "snapshot_id", "left").withColumn(
        "_a", F.coalesce("exponent", F.lit(NEWKIRK_EXPONENT)) - margin
    )
    curve = hydrostatic_profile(
        based, F.col("center"), F.col("_a"), ["snapshot_id", "center", "median"], "_c", r_inner, r_outer, kind, u, crossover, samples
    )
    curve = curve.select(
        "snapshot_id", "center", F.when(F.col("median") > 0, F.col("median")).alias("_mu"),
        F.when((F.col("_c") > 0) & (F.col("median") > 0), F.col("median") / F.col("_c")).alias("_env"),
    )
    df = interp_table(frame, curve, F.col("rho"), "center", "_env", "_env")
    df = interp_table(df, curve, F.col("rho"), "center", "_mu", "_mu")
    shown = (F.col(image) > 0) & (F.col("rho") >= reference_radius) & (F.col("_mu") > 0)
    value = F.when(shown, F.col("_env") * F.pow(F.col(image) / F.col("_mu"), F.lit(gain)))
    return df.withColumn(image, F.coalesce(value, F.lit(0.0))).select(*frame.columns)


def stretch_frame(frame: DataFrame, image: str, scaling="log", percentiles=(1.0, 99.5), valid: Column | None = None) -> DataFrame:
    """Stretch a brightness frame, anchored on positive pixels or on a mask (masked pixels give 0)."""
    anchor = F.col(image) > 0 if valid is None else valid
    out = percentile_stretch(frame.withColumn("_keep", anchor), [image], scaling, percentiles, F.col("_keep"))
    if valid is not None:
        out = out.withColumn(image, F.when(F.col("_keep"), F.col(image)).otherwise(F.lit(0.0)))
    return out.drop("_keep")


def brightness_display(
    frame: DataFrame, choice="polarized", vignette="newkirk", reference_radius=1.0, r_inner=1.0, r_outer=12.5, scaling="log",
    percentiles=(1.0, 99.5), u=rad.LIMB_DARKENING, crossover=rad.CROSSOVER, **detail,
) -> DataFrame:
    """Frame choice, detrending and stretch: adds the column ``display``."""
    if choice not in ("polarized", "total"):
        raise ValueError(f"choice is 'polarized' or 'total', not {choice!r}")
    df = frame.withColumn("display", F.col(choice))
    args = dict(image="display", reference_radius=reference_radius, r_inner=r_inner, r_outer=r_outer, kind=choice, u=u, crossover=crossover)
    if vignette == "newkirk":
        df = vignette_newkirk(df, **args, **detail)
    elif vignette == "adaptive":
        df = vignette_adaptive(df, **args, **detail)
    elif vignette != "none":
        raise ValueError(f"vignette is 'newkirk', 'adaptive' or 'none', not {vignette!r}")
    return stretch_frame(df, "display", scaling, percentiles)
