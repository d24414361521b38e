"""One-dimensional linear lookup joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def interp_table(
    rows: DataFrame, nodes: DataFrame, at: Column, key: str, value: str, out: str, by: list[str] | None = None
) -> DataFrame:
    """Append ``out``: the value of a piecewise-linear curve at ``at``, held constant beyond its ends.

    The curve (a bounded table per snapshot) becomes one sorted array per key, so large row tables are
    neither ranged over nor shuffled beyond the equi-join on the key.
    """
    by = by or ["snapshot_id"]
    points = nodes.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    curve = points.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v")))).alias("_c")
    )
    keys, n = F.transform("_c", lambda e: e["k"]), F.size("_c")
    joined = rows.withColumn("_at", at).join(curve, by, "left").withColumn("_ks", keys)
    # number of nodes at or below the position, found by halving on the sorted keys
    spot = _rank(F.col("_ks"), F.col("_at"), n)
    joined = joined.withColumn("_i", F.least(F.greatest(spot, F.lit(1)), n - 1))
    low, high = F.get("_c", F.col("_i") - 1), F.get("_c", F.col("_i"))
    share = F.least(F.greatest(F.try_divide(F.col("_at") - low["k"], high["k"] - low["k"]), F.lit(0.0)), F.lit(1.0))
    single = F.get("_c", F.lit(0))["v"]
    value_at = F.when(n == 1, single).otherwise(low["v"] + share * (high["v"] - low["v"]))
    return joined.select(*rows.columns, F.when(F.col("_at").isNotNull(), value_at).alias(out))


def _rank(keys: Column, at: Column, n: Column) -> Column:
    """How many sorted keys are <= at: a bisection that starts at the highest power of two the keys reach."""
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda step: step <= n)
    return F.aggregate(
        steps,
        F.lit(0),
        lambda i, step: F.when((i <= n - step) & (F.get(keys, i + step - 1) <= at), i + step).otherwise(i),
    )


def even_curve(
    rows: DataFrame, nodes: DataFrame, at: Column, number: str, value: str, top: Column, size: int, out: str
) -> DataFrame:
    """As ``interp_table`` for evenly spaced nodes 0..size-1 on [0, top]: the bracket is arithmetic."""
    position = F.least(F.greatest(F.coalesce(F.try_divide(at, top), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * (size - 1)
    curve = nodes.groupBy("snapshot_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(number, value))), lambda e: e[value]).alias("_v")
    )
    df = rows.withColumn("_x", position).join(curve, "snapshot_id", "left")
    i = F.least(F.floor("_x"), F.lit(size - 2)).cast("int")
    low, high = F.get("_v", i), F.get("_v", i + 1)
    return df.select(*rows.columns, (low + (F.col("_x") - i) * (high - low)).alias(out))


