"""Results are shown at the decimals, and by the rounding, of the SQL that checks them."""

import duckdb
import numpy as np
import pandas as pd

from heliospark.catalog.inputs import rounded


def test_values_next_to_a_half(spark):
    # products of prices in cents, as the densities of the inputs: many lie at, or one bit beside, half of the last decimal
    prices = 1.25 + 2.5 * np.arange(400, 180_000, 37)
    rows = pd.DataFrame({"k": np.arange(len(prices)), "v": (1.0 + 0.2) * (0.5 + prices / 1e6)})  # noqa: F841
    got = rounded(spark.createDataFrame(rows)).toPandas().sort_values("k")
    want = duckdb.sql("SELECT k, (round(v, 6) + 0e0) AS v FROM rows ORDER BY k").df()
    assert (got["v"].to_numpy() == want["v"].to_numpy()).all()


def test_signs_and_missing_values(spark):
    got = rounded(spark.sql("SELECT id, CASE id WHEN 0 THEN -1e-9 WHEN 1 THEN -25e-1 WHEN 2 THEN CAST('NaN' AS DOUBLE) END AS v FROM range(4)"), 0).orderBy("id").collect()
    assert str(got[0].v) == "0.0" and got[1].v == -3.0 and np.isnan(got[2].v) and got[3].v is None
