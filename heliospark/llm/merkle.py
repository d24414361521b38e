"""A Merkle manifest of a table with a proof for every row, by pointer jumping.

A row's leaf is the digest of its columns. The leaves of a group (a language) rise by id; runs of eight become their
digest until one is left, the group's root, and the groups' roots likewise give the root of the table. A node knows the
run it stands in: a step (run, place) towards its parent. Repeated self-joins of the table of inner nodes double the
distance of the ancestor that a node points at and join the steps, until every node has all steps to the root. The rows
(seven of eight nodes) jump last and once: over their parent, which by then reaches the root, so that a row's proof is
never shuffled.

Rows get their places from a range-partitioned sort and the sizes of the parts before, at any size of a group. An inner
node has eight children and a round's joins meet at most 8 ** distance nodes in one ancestor; no group is held by a task.

Nulls: a null column counts as ``-``; a null group comes first; null ids come first within a group. Rows with equal ids
rise by their leaf, so that the result does not depend on how the table is stored; repeated rows are leaves of their own.
A single row is its group's root. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.frames import discard, materialise, parts, task_count

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a sorted part; levels that one grouping builds; hex digits of a digest; the tree of the groups' roots.
PART = 1 << 18
LEVELS = 3
HEX = 64
TOP = -1


@dataclass(frozen=True)
class ManifestOptions:
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    order: str = "doc_id"
    fan: int = 8


def digest(columns: list[Column]) -> Column:
    """SHA-256 over the columns: ``-`` where null, else its bytes in UTF-8, a colon, and the value."""
    shown = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def depth_of(size: Column, fan: int) -> Column:
    """Levels above ``size`` nodes."""
    return F.size(F.filter(F.array(*(F.lit(fan**k) for k in range(21))), lambda x: x < size))


def placed(rows: DataFrame, group: list[str], order: list[str], number: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part`` and ``at``, sizes): the rows of a sorted part are numbered; sizes has each part's groups.

    A row's place in its group is ``at - first + before`` of its (part, group).
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    out = rows.repartitionByRange(number, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    out = materialise(out.withColumn("part", F.shiftright("at", 33)), "placed")
    sizes = out.groupBy("part", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    over = Window.partitionBy(*(F.col(c) for c in group)) if group else Window.partitionBy(F.lit(0))
    before = F.sum("rows").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return out, sizes.withColumns({"before": F.coalesce(before, F.lit(0)), "size": F.sum("rows").over(over)})


def grown(leaves: DataFrame, fan: int, deepest: int) -> DataFrame:
    """All inner nodes over (tree, depth, idx, digest): tree, depth, level, idx, digest and the run of their children."""
    block = fan**LEVELS
    spark, out = leaves.sparkSession, None
    for low in range(0, max(deepest, 1), LEVELS):
        inside = F.sort_array(F.collect_list(F.struct("idx", "digest")))["digest"]
        held = leaves.where(F.col("depth") > low).groupBy("tree", "depth", F.floor(F.col("idx") / block).alias("block")).agg(inside.alias("d0"))
        nodes = []
        for k in range(1, LEVELS + 1):
            below = F.col(f"d{k - 1}")
            starts = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fan).cast("int"))
            held = held.withColumn(f"r{k}", F.transform(starts, lambda i: F.array_join(F.slice(below, i * fan + 1, fan), "")))
            held = held.withColumn(f"d{k}", F.transform(f"r{k}", lambda r: F.sha2(r, 256)))
            first = F.col("block") * (block // fan**k)
            named = F.transform(
                f"r{k}",
                lambda r, i: F.struct(
                    F.lit(low + k).alias("level"), (first + i).alias("idx"), F.col(f"d{k}")[i].alias("digest"), r.alias("run")
                ),
            )
            nodes.append(F.when(F.col("depth") >= low + k, named).otherwise(F.array().cast("array<struct<level:int,idx:bigint,digest:string,run:string>>")))
        level = materialise(held.select("tree", "depth", F.explode(F.concat(*nodes)).alias("n")).select("tree", "depth", "n.*"), "nodes")
        out = level if out is None else out.unionByName(level)
        leaves = level.where(F.col("level") == low + LEVELS)
    return out


def jumped(nodes: DataFrame, fan: int, distance: int) -> DataFrame:
    """tree, level, idx and steps of every node below the root: all steps to it."""
    root = F.col("last")  # a node without parent
    name = F.when(F.col("depth") == F.col("level"), F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx")))
    name = F.when(F.col("tree") == TOP, F.struct("tree", "level", "idx")).otherwise(F.coalesce(name, F.struct("tree", "level", "idx")))
    step = lambda i: F.array(F.struct(F.col("run"), i.alias("place")))
    places = F.sequence(F.lit(0), (F.length("run") / HEX).cast("int") - 1)
    child = nodes.where((F.col("level") > 1) | (F.col("tree") == TOP)).withColumn("up", F.when(~root, name)).withColumn("i", F.explode(places))
    now = child.select("tree", (F.col("level") - 1).alias("level"), (F.col("idx") * fan + F.col("i")).alias("idx"), "up", step(F.col("i")).alias("steps"))
    now, reach = materialise(now, "jumps"), 1
    while reach < distance:
        far = now.where((F.col("tree") == TOP) | (F.col("level") > reach))
        far = far.select(F.struct("tree", "level", "idx").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        near = now.where(F.col("up").isNotNull()).join(far, "up")
        near = near.select("tree", "level", "idx", F.col("next").alias("up"), F.concat("steps", "more").alias("steps"))
        later = materialise(now.where(F.col("up").isNull()).unionByName(near), "jumps")
        discard(now)
        now, reach = later, 2 * reach
    return now.select("tree", "level", "idx", "steps")


def proofs(rows: DataFrame, options: ManifestOptions = ManifestOptions()) -> DataFrame:
    """``rows`` has the group, the order, ``leaf`` and any others; adds ``subroot``, ``root`` and ``proof``.

    ``proof`` is an array of steps (run, place) from the leaf to the root: the digests of a run one after another, and
    which of them is on the way.
    """
    fan, spark = options.fan, rows.sparkSession
    rows = rows.select(F.struct(*rows.columns).alias("row"), F.col(options.group).alias("g"), F.col(options.order).alias("o"), "leaf")
    rows = materialise(rows, "leaves")
    number = max(task_count(spark), parts(rows.count(), PART))
    sorted_rows, sizes = placed(rows, ["g"], ["o", "leaf"], number)
    discard(rows)
    sizes = materialise(sizes, "sizes")
    groups, group_sizes = placed(sizes.groupBy("g").agg(F.max("size").alias("size")), [], ["g"], parts(sizes.count(), PART))
    groups = groups.join(group_sizes.select("part", "first", "before", F.col("size").alias("groups")), "part")
    groups = groups.select("g", (F.col("at") - F.col("first") + F.col("before")).alias("tree"), depth_of(F.col("size"), fan).alias("depth"), "groups")
    groups = materialise(groups, "groups")
    deepest, n_groups = groups.agg(F.max("depth"), F.max("groups")).first()
    deepest, top = deepest or 0, next(k for k in range(64) if fan**k >= (n_groups or 1))
    sizes = sizes.alias("s").join(groups.alias("t"), F.col("s.g").eqNullSafe(F.col("t.g")))
    sizes = sizes.select("part", F.col("s.g").alias("g"), "first", "before", "tree", "depth")
    leaves = sorted_rows.alias("r").join(sizes.alias("s"), (F.col("r.part") == F.col("s.part")) & F.col("r.g").eqNullSafe(F.col("s.g")))
    leaves = materialise(leaves.select("row", "leaf", "tree", "depth", (F.col("at") - F.col("first") + F.col("before")).alias("idx")), "leaves")
    discard(sorted_rows)

    nodes = grown(leaves.select("tree", "depth", "idx", F.col("leaf").alias("digest")), fan, deepest)
    tops = nodes.where(F.col("level") == F.col("depth")).select("tree", "digest").unionByName(leaves.where("depth = 0").select("tree", F.col("leaf").alias("digest")))
    upper = grown(tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top).alias("depth"), F.col("tree").alias("idx"), "digest"), fan, top)
    last = F.col("level") == F.col("depth")
    every = nodes.withColumn("last", last & F.lit(top == 0)).unionByName(upper.withColumn("last", last))
    ways = jumped(every, fan, deepest - 1 + top if deepest else top)

    low = nodes.where("level = 1").select("tree", "idx", F.col("depth") == 1, "run").toDF("t", "block", "only", "run")
    low = low.unionByName(leaves.where("depth = 0").select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("only"), F.lit(None).cast("string").alias("run")))
    at = F.when(F.col("only"), F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("t").alias("idx")))
    at = F.coalesce(at, F.struct(F.col("t").alias("tree"), F.lit(1).alias("level"), F.col("block").alias("idx")))
    ways = ways.select(F.struct("tree", "level", "idx").alias("at"), "steps")
    low = low.withColumn("at", at).join(ways, "at", "left").select("t", "block", "run", "steps")
    low = materialise(low, "ways")
    discard(nodes, upper, ways)

    block = F.floor(F.col("idx") / fan)
    met = leaves.join(low, (F.col("tree") == F.col("t")) & (block == F.col("block")), "left")
    first = F.array(F.struct("run", (F.col("idx") % fan).cast("int").alias("place")))
    none = F.array().cast("array<struct<run:string,place:int>>")
    proof = F.concat(F.when(F.col("run").isNotNull(), first).otherwise(none), F.coalesce("steps", none))
    met = met.withColumn("proof", proof)
    root = F.when(F.size("proof") == 0, F.col("leaf")).otherwise(F.sha2(F.element_at("proof", -1)["run"], 256))
    subroot = F.when(F.col("depth") == 0, F.col("leaf")).otherwise(F.sha2(F.get("proof", F.col("depth") - 1)["run"], 256))
    return met.select("row.*", subroot.alias("subroot"), root.alias("root"), "proof")


def beside(step: Column) -> tuple[Column, Column]:
    """The digests of a step's run before and after the one on the way."""
    cut = step["place"] * HEX
    return step["run"].substr(F.lit(1), cut), step["run"].substr(cut + HEX + 1, F.length(step["run"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, one after another, left to right and level by level."""
    return F.array_join(F.transform(proof, lambda s: F.concat(*beside(s))), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof's siblings."""

    def up(now: Column, step: Column) -> Column:
        before, after = beside(step)
        return F.sha2(F.concat(before, now, after), 256)

    return F.aggregate(proof, leaf, up)


def audit(docs: DataFrame, options: ManifestOptions = ManifestOptions()) -> DataFrame:
    """Proofs of all rows, and what they say of a copy in which every third id's text was lower-cased (A-Z).

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    columns = [F.col(f"`{c}`") for c in options.columns]
    touched = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    other = digest([F.translate("text", UPPER, LOWER) if c == "text" else F.col(f"`{c}`") for c in options.columns])
    rows = docs.select("doc_id", options.group, digest(columns).alias("leaf"), F.when(touched, other).alias("altered"))
    out = proofs(rows, options)
    back = folded(F.coalesce("altered", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
