"""Connected components of a table of links, by alternating stars.

Each round links every node's larger neighbours to its smallest one (large star), then every node and its smaller
neighbours to the smallest of them (small star). The number of rounds grows with the logarithm of the longest chain.
Every round is written to the shared folder, which cuts the lineage; only counts and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm.frames import discard, materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    if large:
        links = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = links.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of one ordered type -> (u, v): every node but the smallest of its component, and that smallest."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = materialise(links, "links")
    state = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links
        state = now
        before, links = links, materialise(_stars(_stars(links, True), False), "links")
        discard(before)
