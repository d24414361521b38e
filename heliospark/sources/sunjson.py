"""Field lines as JSON polylines of radius, longitude and latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.imaging import sun_coordinates
from heliospark.operators.lines import classify
from heliospark.session import large

DECIMALS = 6
THICKNESS = 0.004
WHITE = (255, 255, 255, 255)
LINE = ["snapshot_id", "line_id"]


def line_documents(lines: DataFrame, paths: DataFrame, keep: Column | None = None) -> DataFrame:
    """One geometry object per complete line, as JSON text.

    ``lines`` may carry red, green, blue in [0, 1]. An explicit ``keep`` that selects an incomplete line
    fails the job; without one, incomplete lines are dropped.
    """
    flag = classify(F.col("end_b"), F.col("end_f"))
    if keep is None:
        kept = lines.where(flag["is_complete"])
    else:
        guard = F.when(flag["is_complete"], F.lit(True)).otherwise(
            F.raise_error(F.lit("keep selects an incomplete line")).cast("boolean")
        )
        kept = lines.where(keep).where(guard)
    if {"red", "green", "blue"} <= set(lines.columns):
        level = lambda c: F.bround(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")
        colour = F.array(level("red"), level("green"), level("blue"), F.lit(255))
    else:
        colour = F.array(*[F.lit(v) for v in WHITE])
    topology = F.when(flag["is_closed"], F.lit("closed")).otherwise(F.lit("open"))
    kept = kept.select(*LINE, colour.alias("_colour"), topology.alias("_topology"))
    at = [F.round(c, DECIMALS) for c in sun_coordinates(F.col("x"), F.col("y"), F.col("z"))]
    vertices = paths.select(*LINE, F.struct("seq", F.array(*at).alias("p")).alias("_v"))
    # a line has a bounded number of steps, so its vertices fit one row
    lists = vertices.groupBy(*LINE).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    geometry = F.struct(
        F.lit("line").alias("type"),
        F.transform("_vs", lambda v: v["p"]).alias("coordinates"),
        F.array("_colour").alias("colors"),
        F.lit(THICKNESS).alias("thickness"),
        F.col("_topology").alias("topology"),
    )
    return kept.join(large(lists), LINE).select(*LINE, F.to_json(geometry).alias("geometry"))


def document_time(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")


def write_sunjson(path: str, documents: DataFrame, timestamp: str) -> None:
    """One JSON object per line; with the file ends it forms one document of the whole snapshot.

    The geometry objects are written in parallel, one text row each, headed by the document's fields.
    """
    head = F.to_json(F.struct(F.lit("SunJSON").alias("type"), document_time(F.to_timestamp(F.lit(timestamp))).alias("time")))
    spark = documents.sparkSession
    spark.range(1).select(head.alias("value")).write.text(f"{path}/head")
    documents.select("snapshot_id", F.col("geometry").alias("value")).write.partitionBy("snapshot_id").text(f"{path}/lines")


def single_document(documents: DataFrame, timestamp: Column) -> DataFrame:
    """The whole snapshot as one JSON text, for pictures small enough to be one document."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line_id", "geometry"))), lambda e: e["geometry"])
    joined = documents.groupBy("snapshot_id").agg(F.array_join(parts, ",").alias("_g"))
    return joined.select(
        "snapshot_id",
        F.concat(F.lit('{"type":"SunJSON","time":"'), document_time(timestamp), F.lit('","geometry":['), F.col("_g"), F.lit("]}")).alias("document"),
    )
