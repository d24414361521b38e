"""Exact percentiles of each snapshot, and joins with one row per snapshot, at any number of rows.

Values are counted (equal ones once), put into buckets that rise with the value, and only the buckets that hold a wanted
rank are ordered. So no snapshot's values meet in one buffer: what a window holds is one row per bucket, or the
different values of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.session import materialise

#: Buckets per doubling of a value, and more of them than the smallest double needs.
PER_OCTAVE, SHIFT = 256, 1 << 19
#: Rows that are broadcast; a larger table is joined by salted keys.
BROADCAST_ROWS, SALTS = 200_000, 64


def _bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * PER_OCTAVE).cast("long") + SHIFT
    return F.when(F.isnan(v), 1 << 40).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("long")


def quantiles(rows: DataFrame, wanted: dict[str, Column], levels: list[float]) -> DataFrame:
    """snapshot_id and, for each wanted value, an array of its interpolated quantiles at the levels (0 to 1).

    NULL values do not count; a snapshot without any other gives NULL.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), v.cast("double").alias("v")) for n, v in wanted.items()]))
    key = ["snapshot_id", "what"]
    counted = rows.select("snapshot_id", each.alias("e")).select("snapshot_id", "e.what", "e.v").groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted.withColumn("bucket", _bucket(F.col("v"))), "ranks")
    present = counted.where(F.col("v").isNotNull())
    buckets = present.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *key, "bucket", "n", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*key)).alias("total")
    )
    # ranks on both sides of each level's position, in the bucket that holds them
    position = lambda q: (F.col("total") - 1) * F.lit(q)
    ranks = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(position(q)).alias("rank")) for k, q in enumerate(levels) for up in (0, 1)])
    asked = buckets.withColumn("r", F.explode(ranks)).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("n")))
    asked = asked.select(*key, "bucket", "before", "total", "r.level", "r.up", "r.rank")
    inside = present.join(asked.select(*key, "bucket").distinct(), [*key, "bucket"], "left_semi")
    within = Window.partitionBy(*key, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    met = inside.join(asked, [*key, "bucket"]).where(
        (F.col("rank") - F.col("before") >= F.col("start")) & (F.col("rank") - F.col("before") < F.col("start") + F.col("n"))
    )
    at = lambda k, up: F.max(F.when((F.col("level") == k) & (F.col("up") == up), F.col("v")))
    share = lambda q: F.max(position(q) - F.floor(position(q)))
    found = met.groupBy(*key).agg(F.array(*[at(k, 0) * (1 - share(q)) + at(k, 1) * share(q) for k, q in enumerate(levels)]).alias("q"))
    out = found.groupBy("snapshot_id").agg(*[F.max(F.when(F.col("what") == n, F.col("q"))).alias(n) for n in wanted])
    return counted.select("snapshot_id").distinct().join(out, "snapshot_id", "left")


def join_few(rows: DataFrame, few: DataFrame, how: str = "inner") -> DataFrame:
    """Join a table of one row per snapshot, which may hold any share of ``rows``, on snapshot_id.

    The few rows are written and counted; up to BROADCAST_ROWS they are broadcast, more are spread by a salt.
    """
    few = materialise(few, "few")
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), "snapshot_id", how)
    salted = few.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["snapshot_id", "_salt"], how).drop("_salt")


def row_ranks(rows: DataFrame, order: str, out: str) -> DataFrame:
    """Append the place (from 0) of each row of a snapshot in the order of a column.

    Rows are dealt to ranges of (snapshot, column); a place is the one inside the range plus the sizes of earlier ranges.
    """
    ranged = materialise(rows.repartitionByRange("snapshot_id", order).withColumn("_range", F.spark_partition_id()), "ranges")
    key = ["snapshot_id", "_range"]
    earlier = Window.partitionBy("snapshot_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    placed = ranged.withColumn("_place", inside).join(sizes, key)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_place")).cast("long").alias(out))
