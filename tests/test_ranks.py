"""Exact percentiles and few-row joins."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from heliospark.operators import ranks


def test_quantiles_equal_those_of_sorted_values(spark):
    rng = np.random.default_rng(4)
    values = {
        0: rng.normal(0, 1, 3000),
        1: np.r_[np.zeros(900), rng.integers(-3, 4, 500), 1e-300, -1e300],
        2: np.array([5.0]),
        3: 10.0 ** rng.uniform(-12, 12, 2000),
    }
    rows = pd.DataFrame([(k, float(x)) for k, v in values.items() for x in v], columns=["snapshot_id", "v"])
    df = spark.createDataFrame(rows).unionAll(spark.createDataFrame([(4, None), (0, None)], "snapshot_id long, v double"))
    levels = [0.0, 0.01, 0.5, 0.995, 1.0]
    got = {r["snapshot_id"]: r for r in ranks.quantiles(df, {"a": F.col("v"), "b": -F.col("v")}, levels).collect()}
    for k, v in values.items():
        for name, sign in (("a", 1), ("b", -1)):
            assert np.allclose(got[k][name], np.quantile(sign * v, levels), rtol=1e-12)
    assert got[4]["a"] is None and len(got) == 5


def test_few_rows_joined_by_salt(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("snapshot_id"), "id")
    few = spark.createDataFrame([(0, "x"), (1, "y")], "snapshot_id long, name string")
    want = sorted(map(tuple, ranks.join_few(rows, few, "left").collect()), key=repr)
    most, ranks.BROADCAST_ROWS = ranks.BROADCAST_ROWS, 1
    try:
        salted = ranks.join_few(rows, few, "left").select("snapshot_id", "id", "name").collect()
    finally:
        ranks.BROADCAST_ROWS = most
    assert sorted(map(tuple, salted), key=repr) == want
