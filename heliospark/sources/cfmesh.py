"""Sectioned ASCII mesh files (keyword lines start with ``!``) as tables, one snapshot per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.operators.stencil import on_ring, rings
from heliospark.session import large
from heliospark.sources.text_rows import beside, few_files, numbered, section_rows, text_rows

#: Nodes of a block that corners are read from at once.
BLOCK = 64
VARIABLES = ("rho", "vx", "vy", "vz", "Bx", "By", "Bz", "p", "psi")


@dataclass(frozen=True)
class Mesh:
    """Tables of one or many native solutions, keyed by ``file``."""

    nodes: DataFrame
    elements: DataFrame
    states: DataFrame
    faces: DataFrame
    header: DataFrame
    variables: tuple[str, ...]


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def read_cfmesh(spark: SparkSession, path: str, variables: tuple[str, ...] | None = None) -> Mesh:
    names = tuple(variables or VARIABLES)
    rows = text_rows(spark, path)
    few = few_files(rows)
    keyword = rows.where(F.col("line").startswith("!")).select(
        "file", "split", "row",
        F.regexp_extract("line", r"^(\S+)", 1).alias("key"),
        F.trim(F.regexp_extract("line", r"^\S+(.*)$", 1)).alias("rest"),
    )
    w = Window.partitionBy("file").orderBy("split", "row")
    marks = keyword.select(
        "*",
        F.lead("split").over(w).alias("e_split"),
        F.lead("row").over(w).alias("e_row"),
        F.last(F.when(F.col("key") == "!TRS_NAME", F.col("rest")), ignorenulls=True).over(w).alias("surface"),
        F.count_if(F.col("key") == "!END").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_ended"),
    ).where(F.col("_ended") == 0)
    header = marks.groupBy("file").agg(F.map_from_entries(
        F.collect_list(F.when(~F.col("key").isin("!TRS_NAME", "!NB_GEOM_ENTS", "!END") & ~F.col("key").startswith("!LIST_"), F.struct("key", "rest")))
    ).alias("header"))
    header = header.select("file", "header", _checked_equations(len(names)).alias("n_equations"))
    lists = marks.where(F.col("key").startswith("!LIST_")).select(
        "file",
        F.when(F.col("key") == "!LIST_GEOM_ENT", F.concat(F.lit("face:"), F.col("surface"))).otherwise(F.col("key")).alias("section"),
        F.col("split").alias("s_split"), F.col("row").alias("s_row"), "e_split", "e_row",
    )
    body = numbered(section_rows(rows.where(~F.col("line").startswith("!") & (F.trim("line") != "")), lists, few), ["file", "section"], few=few)
    body = body.withColumn("w", _words(F.col("line")))
    part = lambda name: body.where(F.col("section") == name)
    # filters may be evaluated in any order, so a cast must not fail on a row another filter drops
    number = lambda k, kind: F.get("w", F.lit(k)).try_cast(kind)
    nodes = part("!LIST_NODE").select(
        "file", F.col("number").alias("node_id"), *[number(k, "double").alias(c) for k, c in enumerate("xyz")]
    )
    # an element line holds its node ids, then its state id
    corners = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda c: c.try_cast("long"))
    elements = part("!LIST_ELEM").select(
        "file", F.col("number").alias("cell_id"), corners.alias("node_ids"), F.try_element_at("w", F.lit(-1)).try_cast("long").alias("state_id")
    )
    states = part("!LIST_STATE").join(beside(few, header.select("file", "n_equations")), "file").select(
        "file", F.when(F.col("n_equations").isNotNull(), F.col("number")).alias("state_id"),
        *[number(k, "double").alias(n) for k, n in enumerate(names)],
    )
    size = F.greatest(F.coalesce(F.get("w", F.lit(0)).try_cast("int"), F.lit(0)), F.lit(0))
    faces = body.where(F.col("section").startswith("face:")).select(
        "file", F.substring("section", 6, 1_000).alias("source_name"), F.col("number").alias("face_id"),
        F.transform(F.slice("w", F.lit(3), size), lambda c: c.try_cast("long")).alias("node_ids"),
        F.get("w", size + 2).try_cast("long").alias("adjacent_cell"),
    )
    return Mesh(nodes, elements, states, faces, header, names)


def _checked_equations(n: int) -> Column:
    """NB_EQ, failing the job where it is not the number of variable names."""
    stated = F.get(F.split(F.col("header")["!NB_EQ"], r"\s+"), F.lit(0)).cast("int")
    message = F.concat(F.lit(f"{n} variable names given, but the file states NB_EQ="), F.coalesce(stated.cast("string"), F.lit("nothing")))
    return F.when(stated == n, stated).otherwise(F.raise_error(message).cast("int"))


def mesh_state_to_cell(elements: DataFrame, states: DataFrame, key: str = "file") -> DataFrame:
    """Attach each cell's state vector by its state id."""
    return elements.join(states, [key, "state_id"])


def mesh_prism_center(corners: DataFrame, nodes: DataFrame, key: str = "file") -> DataFrame:
    """Cell centre: the mean of its node positions; ``corners`` has cell_id and node_id rows."""
    return (
        corners.join(nodes, [key, "node_id"])
        .groupBy(key, "cell_id")
        .agg(*[F.avg(c).alias(c) for c in "xyz"])
    )


def cell_centers(cells: DataFrame, nodes: DataFrame, key: str = "file") -> DataFrame:
    """As ``mesh_prism_center`` for cells that list their nodes (``node_ids``): a cell goes to the blocks of nodes that it lies
    in, mostly one, and each block adds up its corners, so neither corners nor their positions move one by one."""
    block = lambda n: F.floor(n / BLOCK)
    place = lambda n: F.pmod(n, F.lit(BLOCK)).cast("int")
    held = rings(nodes.select(key, block(F.col("node_id")).alias("node_id_block"), place(F.col("node_id")).alias("i_p"), *"xyz"), [key, "node_id_block"], list("xyz"))
    asked = cells.select(key, "cell_id", "node_ids", F.explode(F.array_distinct(F.transform("node_ids", block))).alias("node_id_block"))
    inside = F.transform(F.filter("node_ids", lambda n: block(n) == F.col("node_id_block")), place)
    met = asked.select(key, "cell_id", "node_id_block", inside.alias("_at")).join(large(held), [key, "node_id_block"])
    # a node that is missing counts for nothing
    met = met.select(key, "cell_id", F.filter(F.transform("_at", on_ring), lambda n: n.isNotNull()).alias("_n")).where(F.size("_n") > 0)
    total = lambda c: F.aggregate("_n", F.lit(0.0), lambda s, n: s + F.coalesce(n[c], F.lit(0.0)))
    known = lambda c: F.size(F.filter("_n", lambda n: n[c].isNotNull()))
    sums = [part(c).alias(f"_{k}{c}") for k, part in (("s", total), ("c", known)) for c in "xyz"]
    mean = [F.try_divide(F.sum(f"_s{c}"), F.sum(f"_c{c}")).alias(c) for c in "xyz"]
    return met.select(key, "cell_id", *sums).groupBy(key, "cell_id").agg(*mean)


def mesh_boundary_tag(face_nodes: DataFrame, nodes: DataFrame, key: str = "file") -> DataFrame:
    """Mean node radius of each tagged surface and its role in order of radius."""
    radius = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    surfaces = (
        face_nodes.join(nodes, [key, "node_id"])
        .groupBy(key, "source_name")
        .agg(F.avg(radius).alias("mean_radius"), F.countDistinct("face_id").alias("n_faces"))
    )
    w = Window.partitionBy(key)
    place = F.row_number().over(w.orderBy("mean_radius")) - 1
    two = F.count(F.lit(1)).over(w) == 2
    role = F.when(two & (place == 0), F.lit("inner")).when(two, F.lit("outer")).otherwise(
        F.concat(F.lit("boundary_"), place.cast("string"))
    )
    return surfaces.select(key, role.alias("role"), "source_name", "n_faces", "mean_radius")


def mesh_boundary_synth(nodes: DataFrame, key: str = "file", tolerance: float = 1e-3) -> DataFrame:
    """Inner and outer shell where no surface is tagged: nodes next to the radial extremes."""
    sized = nodes.withColumn("_r", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    ends = sized.groupBy(key).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    slack = tolerance * F.greatest(F.col("_hi") - F.col("_lo"), F.col("_hi"))
    low, high = F.col("_r") <= F.col("_lo") + slack, F.col("_r") >= F.col("_hi") - slack
    return (
        sized.join(ends, key)
        .groupBy(key)
        .agg(F.avg(F.when(low, F.col("_r"))).alias("inner_radius"), F.avg(F.when(high, F.col("_r"))).alias("outer_radius"))
    )


def cells_of(mesh: Mesh) -> DataFrame:
    """Cell centres with every variable."""
    # rows carry a 64-bit name of their file: its path folds well on disk but not in memory
    name = F.xxhash64("file").alias("_file")
    centers = cell_centers(mesh.elements.select(name, "cell_id", "node_ids"), mesh.nodes.select(name, "node_id", *"xyz"), "_file")
    cells = mesh_state_to_cell(mesh.elements, mesh.states).withColumn("_file", F.xxhash64("file"))
    out = centers.join(cells, ["_file", "cell_id"])
    return out.select("file", "cell_id", *[c for c in out.columns if c not in ("_file", "file", "cell_id")])


def solution_info(mesh: Mesh, model: str = "mhd", normalization: str = "corona") -> DataFrame:
    """One row per solution: counts, variables, boundary radii."""
    face_nodes = mesh.faces.select("file", "source_name", "face_id", F.explode("node_ids").alias("node_id"))
    tags = mesh_boundary_tag(face_nodes, mesh.nodes).groupBy("file").agg(
        F.max(F.when(F.col("role") == "inner", F.col("mean_radius"))).alias("inner_radius"),
        F.max(F.when(F.col("role") == "outer", F.col("mean_radius"))).alias("outer_radius"),
        F.sum("n_faces").alias("n_faces"),
    )
    return (
        mesh.nodes.groupBy("file").agg(F.count(F.lit(1)).alias("n_nodes"))
        .join(mesh.elements.groupBy("file").agg(F.count(F.lit(1)).alias("n_cells")), "file")
        .join(tags, "file")
        .select("*", F.lit(model).alias("model"), F.lit(",".join(mesh.variables)).alias("variables"), F.lit(normalization).alias("normalization"))
    )
