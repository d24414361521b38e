"""Staggered structured variables brought onto one mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.geometry import sph_to_cart, vec_file_angles
from heliospark.operators.ranks import join_few
from heliospark.operators.resample import StructuredBlock, resample_structured
from heliospark.session import large, task_count

#: Names a file of a set may carry.
SET_VARIABLES = ("rho", "br", "bt", "bp", "vr", "vt", "vp", "t", "p")
NEEDED = ("br", "bt", "bp")


def variable_of(file_name: Column) -> Column:
    """The variable a file of a set holds: its one alphabetic token that is a known name."""
    tokens = F.regexp_extract_all(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.lit("([A-Za-z]+)"), F.lit(1))
    known = F.filter(tokens, lambda t: t.isin(*SET_VARIABLES))
    message = F.concat(F.lit("not exactly one variable name in "), file_name)
    return F.when(F.size(known) == 1, F.get(known, F.lit(0))).otherwise(F.raise_error(message).cast("string"))


def member_of(file_path: Column) -> Column:
    """The name of a set's member: a file's own, or that of its folder where this is a Parquet table."""
    parts = F.split(file_path, "/")
    folder = F.element_at(parts, -2)
    return F.when(folder.endswith(".parquet"), folder).otherwise(F.element_at(parts, -1))


def read_structured(spark: SparkSession, path: str) -> dict[str, StructuredBlock]:
    """A folder of Parquet files or tables (snapshot_id, i_r, i_t, i_p, r, theta, phi, value), each named by its variable."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rows = rows.withColumn("variable", variable_of(member_of(F.col("_metadata.file_path"))))
    present = [r[0] for r in rows.select("variable").distinct().limit(len(SET_VARIABLES)).collect()]
    missing = [v for v in NEEDED if v not in present]
    if missing:
        raise ValueError(f"the set lacks {missing}")
    return {v: block_of(rows.where(F.col("variable") == v)) for v in (*NEEDED, "rho") if v in present}


def block_of(rows: DataFrame) -> StructuredBlock:
    """Split node rows that repeat their axis values into a block and its axes."""
    axis = F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(f"i_{a}").cast("long").alias("idx"), F.col(c).alias("value"))
        for a, c in zip("rtp", ("r", "theta", "phi"))
    ])
    axes = rows.select("snapshot_id", F.explode(axis).alias("_a")).select("snapshot_id", "_a.*")
    axes = axes.groupBy("snapshot_id", "axis", "idx").agg(F.max("value").alias("value"))
    return StructuredBlock(rows.select("snapshot_id", "i_r", "i_t", "i_p", "value"), axes)


def mesh_points(axes: DataFrame) -> DataFrame:
    """Every node of the mesh that three axes span."""
    lists = [F.collect_list(F.when(F.col("axis") == a, F.struct("idx", "value"))).alias(f"_{a}") for a in "rtp"]
    out = axes.groupBy("snapshot_id").agg(*lists)
    for a, c in zip("rtp", ("r", "theta", "phi")):
        out = out.withColumn("_n", F.explode(f"_{a}")).withColumns({f"i_{a}": F.col("_n.idx"), c: F.col("_n.value")}).drop("_n", f"_{a}")
        if a == "r":
            out = out.repartition(task_count(axes.sparkSession), "snapshot_id", "i_r")
    return out


def cells_of(aligned: DataFrame, axes: DataFrame) -> DataFrame:
    """The nodes of an aligned set as cells (snapshot_id, cell_id, x, y, z, values) for the resamplers of scattered cells."""
    sizes = axes.groupBy("snapshot_id").agg(*[F.max(F.when(F.col("axis") == a, F.col("idx") + 1)).alias(f"_n{a}") for a in "tp"])
    cell = (F.col("i_r") * F.col("_nt") + F.col("i_t")) * F.col("_np") + F.col("i_p")
    values = [c for c in aligned.columns if c in ("x", "y", "z", "b_x", "b_y", "b_z", "rho")]
    return join_few(aligned, sizes).select("snapshot_id", cell.cast("long").alias("cell_id"), *values)


def align_structured(variables: dict[str, StructuredBlock]) -> DataFrame:
    """All variables on the density mesh (the br mesh where there is no density), B in Cartesian components.

    Half-cell staggering is bridged by trilinear interpolation, extended linearly past an axis end.
    """
    missing = [v for v in NEEDED if v not in variables]
    if missing:
        raise ValueError(f"the set lacks {missing}")
    home = "rho" if "rho" in variables else "br"
    points = mesh_points(variables[home].axes)
    key = ["snapshot_id", "i_r", "i_t", "i_p"]
    out = points
    for name, block in variables.items():
        if name == home:
            value = block.nodes.select(*key, F.col("value").alias(name))
        else:
            named = points.withColumnsRenamed({f"i_{a}": f"h_{a}" for a in "rtp"})
            at = resample_structured(named, block, ["value"], ["h_r", "h_t", "h_p"], clamp_ends=False)
            value = at.withColumnsRenamed({f"h_{a}": f"i_{a}" for a in "rtp"} | {"value": name})
        out = out.join(large(value), key)
    b = vec_file_angles(F.col("br"), F.col("bt"), F.col("bp"), F.col("theta"), F.col("phi"))
    xyz = sph_to_cart(F.col("r"), F.col("theta"), F.col("phi"))
    named = [c.alias(n) for c, n in zip(xyz, "xyz")] + [c.alias(f"b_{n}") for c, n in zip(b, "xyz")]
    return out.select(*key, "r", "theta", "phi", *named, *(["rho"] if "rho" in variables else []))
