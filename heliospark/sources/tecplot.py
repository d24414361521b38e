"""Block-packed ASCII zone files as tables, one snapshot per file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.session import materialise
from heliospark.sources.text_rows import after, numbered, text_rows

BRICK = 8
# Fixed values of the file format: the columns of a brick whose repeated corners make it a prism, and names of variables.
PRISM_SLOTS = (0, 1, 2, 4, 5, 6)
COORDINATES = {"x0": "x", "x1": "y", "x2": "z"}
RENAMED = {"u": "vx", "v": "vy", "w": "vz", "phi": "psi"}


@dataclass(frozen=True)
class ZoneTables:
    """nodes(file, node_id, x, y, z), cells(file, cell_id, variables), corners(file, cell_id, slot, node_id), zones."""

    nodes: DataFrame
    cells: DataFrame
    corners: DataFrame
    zones: DataFrame
    variables: tuple[str, ...]


def _fail(text: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def _pieces(text: Column, opened: str, closed: str) -> Column:
    """The parts of a list between commas that stand outside brackets."""
    return F.transform(F.split(text, rf",(?![^{opened}{closed}]*{closed})"), lambda p: F.trim(p))


def _fact(key: str) -> Column:
    """What the zone line, cut into ``key = value`` pieces, says for a key; NULL where it says nothing."""
    left = lambda p: F.upper(F.trim(F.substring_index(p, "=", 1)))
    said = F.get(F.filter("facts", lambda p: left(p) == key), F.lit(0))
    return F.trim(F.substring(said, F.instr(said, "=") + 1, F.length(said)))


def _count(key: str, needed: Column, otherwise: str) -> Column:
    number = F.coalesce(_fact(key).try_cast("long"), _fail(f"the zone states no {key}=", "long"))
    return F.when(needed, number).otherwise(_fail(otherwise, "long"))


def _zones(rows: DataFrame) -> DataFrame:
    """Header facts per file: where the body starts, counts, names."""
    words = ("title", "variables", "zone")
    head = rows.select("file", F.struct("split", "row").alias("at"), F.trim("line").alias("line"))
    head = head.withColumn("word", F.lower(F.regexp_substr("line", F.lit("^[A-Za-z]+")))).where(F.col("word").isin(*words))
    firsts = {w: F.min(F.when(F.col("word") == w, F.struct("at", "line"))) for w in words}
    zones = head.groupBy("file").agg(*[e.alias(w) for w, e in firsts.items()]).select(
        "file", F.col("title.line").alias("title"), F.split("variables.line", '"').alias("quoted"),
        _pieces(F.substring("zone.line", 5, 1_000_000), r"\(", r"\)").alias("facts"), "zone.at",
    )
    blocked = F.upper(_fact("DATAPACKING")) == "BLOCK"
    bricks = F.upper(_fact("ZONETYPE")) == "FEBRICK"
    return zones.select(
        "file", F.trim(F.substring("title", F.instr("title", "=") + 1, 1_000_000)).alias("title"),
        F.filter("quoted", lambda _, i: i % 2 == 1).alias("names"),
        _count("N", blocked, "only DATAPACKING=BLOCK is read").alias("n_nodes"),
        _count("E", bricks, "only ZONETYPE=FEBRICK is read").alias("n_cells"),
        F.btrim(F.coalesce(_fact("VARLOCATION"), F.lit("")), F.lit("() ")).alias("where"),
        F.coalesce(_fact("SOLUTIONTIME").try_cast("double"), F.lit(0.0)).alias("solution_time"),
        F.col("at.split").alias("s_split"), F.col("at.row").alias("s_row"),
    )


def _blocks(zones: DataFrame) -> DataFrame:
    """One row per variable block (and one for the connectivity) with its token range."""
    # each piece is [1-3,7]=KIND: its numbers become the slots (from 0) of that kind
    numbers = lambda p: F.split(F.btrim(F.substring_index(p, "=", 1), F.lit("[] ")), ",")
    ends = lambda x: (F.substring_index(x, "-", 1).try_cast("int"), F.substring_index(x, "-", -1).try_cast("int"))
    slots = lambda p: F.flatten(F.transform(numbers(p), lambda x: F.sequence(*ends(x))))
    located = zones.select(
        "file", F.explode(F.filter(_pieces(F.col("where"), r"\[", r"\]"), lambda p: F.instr(p, "=") > 0)).alias("piece")
    ).select("file", F.upper(F.trim(F.substring_index("piece", "=", -1))).alias("kind"), F.explode(slots(F.col("piece"))).alias("slot"))
    kinds = located.groupBy("file", (F.col("slot") - 1).alias("slot")).agg(F.first("kind").alias("kind"))
    rows = zones.select("file", "n_nodes", "n_cells", F.posexplode("names").alias("slot", "name")).join(kinds, ["file", "slot"], "left")
    nodal = F.coalesce(F.col("kind"), F.lit("NODAL")) == "NODAL"
    rows = rows.select("file", "slot", "name", "n_nodes", "n_cells", nodal.alias("nodal"))
    rows = rows.withColumn("length", F.when(F.col("nodal"), F.col("n_nodes")).otherwise(F.col("n_cells")))
    tail = zones.select(
        "file", F.size("names").alias("slot"), F.lit("#corners").alias("name"), "n_nodes", "n_cells", F.lit(False).alias("nodal"),
        (F.col("n_cells") * BRICK).alias("length"),
    )
    w = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(w), F.lit(0))
    return rows.unionByName(tail).select("file", "name", "nodal", "length", start.alias("start"))


def read_tecplot(spark: SparkSession, path: str) -> ZoneTables:
    """Token numbers place every value in its block, so files split freely."""
    rows = text_rows(spark, path)
    zones = materialise(_zones(rows), "zones")
    # variable names decide the columns, so the one header line is read here
    names = [r["names"] for r in zones.select("names").distinct().limit(2).collect()]
    if len(names) != 1 or not names[0]:
        raise ValueError("the files do not share one VARIABLES line")
    body = rows.join(zones.select("file", "s_split", "s_row"), "file").where(
        after(F.col("split"), F.col("row"), F.col("s_split"), F.col("s_row")) & (F.trim("line") != "")
    )
    body = body.select("file", "split", "row", F.split(F.trim("line"), r"\s+").alias("w"))
    placed = numbered(body, ["file"], F.size("w"), "first")
    # the body must hold exactly what the zone states; the check sits in a join key, so it always runs
    held = body.groupBy("file").agg(F.sum(F.size("w")).alias("_held"))
    stated = F.sum("length").over(Window.partitionBy("file"))
    problem = F.when(F.col("_held") > F.col("_stated"), F.lit("more than one zone, or values beyond it")).otherwise(F.lit("the body is cut short"))
    spans = (
        _blocks(zones).withColumn("_stated", stated).join(held, "file", "left")
        .withColumn("start", F.when(F.col("_held") == F.col("_stated"), F.col("start")).otherwise(F.raise_error(problem).cast("long")))
        .select(F.col("file").alias("_file"), "name", "length", "start")
    )
    # a line meets the blocks that it holds values of, and only then its tokens become rows; written once, as three tables read it
    end, close = F.col("first") + F.size("w"), F.col("start") + F.col("length")
    lines = placed.join(spans, (F.col("file") == F.col("_file")) & (F.col("first") < close) & (end > F.col("start")))
    low = F.greatest(F.col("first"), F.col("start"))
    part = F.slice("w", (low - F.col("first") + 1).cast("int"), (F.least(end, close) - low).cast("int"))
    lines = materialise(lines.select("file", "name", (low - F.col("start")).alias("i"), part.alias("w")), "zone-lines")
    values = lines.select("file", "name", "i", F.posexplode("w").alias("_k", "token")).select("file", "name", (F.col("i") + F.col("_k")).alias("i"), "token")
    coordinates = [n for n in names[0] if n in COORDINATES]
    fields = [n for n in names[0] if n not in COORDINATES]
    if len(coordinates) != 3:
        raise ValueError(f"the nodal coordinates {tuple(COORDINATES)} are not all in the file")
    pick = lambda n, out: F.max(F.when(F.col("name") == n, F.col("token").try_cast("double"))).alias(out)
    nodes = values.where(F.col("name").isin(coordinates)).groupBy("file", F.col("i").alias("node_id")).agg(
        *[pick(n, COORDINATES[n]) for n in coordinates]
    )
    cells = values.where(F.col("name").isin(fields)).groupBy("file", F.col("i").alias("cell_id")).agg(
        *[pick(n, RENAMED.get(n, n)) for n in fields]
    )
    slot = F.array_position(F.array(*[F.lit(s) for s in PRISM_SLOTS]), (F.col("i") % BRICK).cast("int"))
    corners = values.where(F.col("name") == "#corners").select(
        "file", F.floor(F.col("i") / BRICK).cast("long").alias("cell_id"), (slot - 1).cast("long").alias("slot"),
        (F.col("token").try_cast("long") - 1).alias("node_id"),
    ).where(F.col("slot") >= 0)
    return ZoneTables(nodes, cells, corners, zones, tuple(RENAMED.get(n, n) for n in fields))
