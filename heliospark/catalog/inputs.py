"""Inputs of the registered queries, derived from the driver's tables.

Every table has one snapshot per 1500 orders (or 1000 events, or 15 users), so all work grows with the data.
The same SELECT text runs in Spark and in the checking database.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.camera import Camera
from heliospark.functions.grid import GridSpec
from heliospark.session import ship_package

GRID = GridSpec(5, 15, 20, inner=1.0, outer=2.5)
CAMERA = Camera(fov=6.0, height=24, width=24)
STEP = 0.1

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# order of definition; later ones may use earlier ones
VIEWS: dict[str, str] = {
    "points": """
        SELECT CAST(floor(pid/1500e0) AS BIGINT) AS snapshot_id, pid, r, theta, phi,
               r*sin(theta)*cos(phi) AS x, r*sin(theta)*sin(phi) AS y, r*cos(theta) AS z, v
        FROM (SELECT o_orderkey AS pid, o_totalprice AS v,
                     1e0 + 15e-1*((o_orderkey*7919 % 9973) + 5e-1)/9973e0 AS r,
                     pi()*((o_orderkey*6007 % 9967) + 5e-1)/9967e0 AS theta,
                     2e0*pi()*((o_orderkey*5003 % 9949) + 5e-1)/9949e0 AS phi
              FROM {orders}) a""",
    "nodes": """
        SELECT snapshot_id, i_r, i_t, i_p, r, theta, phi, x, y, z,
               CASE WHEN gap THEN NULL
                    ELSE 2e-1 + 45e-1*exp(-power((theta - pi()/2)/35e-2, 2))*(1e0 + 5e-1*sin(4e0*phi))
                         + 15e-1*exp(-power((r - 18e-1)/2e-1, 2)) + v/1e6 END AS log_q,
               CASE WHEN v < 15e4 THEN -1 WHEN v > 35e4 THEN 1 ELSE 0 END AS polarity,
               exp(-(r - 1e0)/3e-1)*(1e0 + 2e-1*cos(2e0*phi))*(5e-1 + v/1e6) AS ne,
               125e-1/86e-1*z*x/power(r, 5) + 1e-2*(v/5e5 - 5e-1) AS b_x,
               125e-1/86e-1*z*y/power(r, 5) - 1e-2*(v/5e5 - 5e-1) AS b_y,
               125e-1/86e-1*z*z/power(r, 5) - 125e-1/258e-1/power(r, 3) + 1e-1/3225e-3 AS b_z
        FROM (SELECT *, r*sin(theta)*cos(phi) AS x, r*sin(theta)*sin(phi) AS y, r*cos(theta) AS z
              FROM (SELECT snapshot_id, i_r, i_t, i_p, v, gap,
                           power(25e-1, i_r/4e0) AS r, (i_t + 5e-1)*pi()/15e0 AS theta, i_p*pi()/10e0 AS phi
                    FROM (SELECT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id,
                                 CAST(floor((o_orderkey % 1500)/300e0) AS BIGINT) AS i_r,
                                 CAST(floor((o_orderkey % 300)/20e0) AS BIGINT) AS i_t,
                                 o_orderkey % 20 AS i_p, o_totalprice AS v,
                                 o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS gap
                          FROM {orders}) a) b) c""",
    "cells": """
        SELECT CAST(floor(cell_id/1000e0) AS BIGINT) AS snapshot_id, cell_id, x, y, z, rho,
               3e-1 + 5e-1*x - 2e-1*y + 1e-1*z AS b_x,
               -7e-1 + 4e-1*y - 3e-1*z AS b_y,
               11e-1 + 2e-1*x + 1e-1*y - 6e-1*z AS b_z
        FROM (SELECT cell_id, rho, r*sin(theta)*cos(phi) AS x, r*sin(theta)*sin(phi) AS y, r*cos(theta) AS z
              FROM (SELECT event_id AS cell_id, value AS rho,
                           9e-1 + 17e-1*((event_id*7919 % 9973) + 5e-1)/9973e0 AS r,
                           acos(1e0 - 2e0*((event_id*6007 % 9967) + 5e-1)/9967e0) AS theta,
                           2e0*pi()*((event_id*5003 % 9949) + 5e-1)/9949e0 AS phi
                    FROM {events}) a) b""",
    "paths": """
        SELECT CAST(floor(line_id/15e0) AS BIGINT) AS snapshot_id, line_id, seq,
               r*sin(theta)*cos(phi) AS x, r*sin(theta)*sin(phi) AS y, r*cos(theta) AS z
        FROM (SELECT line_id, seq, 1e0 + 15e-1*(seq - 5e-1)/n AS r,
                     pi()*(((line_id*41 % 97) + 5e-1)/97e0*8e-1 + 1e-1 + 5e-2*sin(seq*3e-1)) AS theta,
                     2e0*pi()*((line_id*61 % 101) + 5e-1)/101e0 + 2e-2*seq AS phi
              FROM (SELECT user_id AS line_id,
                           CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq,
                           count(*) OVER (PARTITION BY user_id) AS n
                    FROM {events}) a) b""",
    "line_values": """
        SELECT CAST(floor(user_id/15e0) AS BIGINT) AS snapshot_id, user_id AS line_id,
               CASE WHEN user_id % 11 = 0 THEN NULL ELSE log10(2e0 + avg(value)) END AS log_q,
               CAST(user_id % 3 AS BIGINT) - 1 AS polarity
        FROM {events} GROUP BY user_id""",
    "lines": """
        SELECT snapshot_id, line_id, end_b, end_f, len_b, len_f, value,
               CASE WHEN end_b = 0 THEN 1e0 WHEN end_b = 1 THEN 25e-1 END*sin(theta_b)*cos(phi_b) AS foot_b_x,
               CASE WHEN end_b = 0 THEN 1e0 WHEN end_b = 1 THEN 25e-1 END*sin(theta_b)*sin(phi_b) AS foot_b_y,
               CASE WHEN end_b = 0 THEN 1e0 WHEN end_b = 1 THEN 25e-1 END*cos(theta_b) AS foot_b_z,
               CASE WHEN end_f = 0 THEN 1e0 WHEN end_f = 1 THEN 25e-1 END*sin(theta_f)*cos(phi_f) AS foot_f_x,
               CASE WHEN end_f = 0 THEN 1e0 WHEN end_f = 1 THEN 25e-1 END*sin(theta_f)*sin(phi_f) AS foot_f_y,
               CASE WHEN end_f = 0 THEN 1e0 WHEN end_f = 1 THEN 25e-1 END*cos(theta_f) AS foot_f_z,
               theta_b, phi_b, theta_f, phi_f
        FROM (SELECT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id, o_orderkey AS line_id, o_totalprice AS value,
                     CASE WHEN o_orderkey*31 % 17 < 9 THEN 0 WHEN o_orderkey*31 % 17 < 14 THEN 1 ELSE o_orderkey*31 % 17 - 12 END AS end_b,
                     CASE WHEN o_orderkey*37 % 19 < 9 THEN 0 WHEN o_orderkey*37 % 19 < 15 THEN 1 ELSE o_orderkey*37 % 19 - 13 END AS end_f,
                     ((o_orderkey*43 % 983) + 5e-1)/983e0 AS len_b, ((o_orderkey*47 % 977) + 5e-1)/977e0 AS len_f,
                     pi()*((o_orderkey*53 % 971) + 5e-1)/971e0 AS theta_b, 2e0*pi()*((o_orderkey*59 % 967) + 5e-1)/967e0 AS phi_b,
                     pi()*((o_orderkey*67 % 953) + 5e-1)/953e0 AS theta_f, 2e0*pi()*((o_orderkey*71 % 947) + 5e-1)/947e0 AS phi_f
              FROM {orders}) q""",
    "seeds": """
        SELECT snapshot_id, line_id, theta, 101e-2*sin(theta)*cos(7e-1) AS x, 101e-2*sin(theta)*sin(7e-1) AS y, 101e-2*cos(theta) AS z
        FROM (SELECT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id, o_orderkey AS line_id,
                     pi()*(5e-2 + 9e-1*((o_orderkey*89 % 9973) + 5e-1)/9973e0) AS theta FROM {orders}) a""",
    "snapshots": "SELECT DISTINCT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id FROM {orders}",
    "prisms": """
        SELECT snapshot_id, snapshot_id*1500 + (k - slot + 1500) % 1500 AS cell_id, slot, node_id
        FROM (SELECT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id, o_orderkey AS node_id, o_orderkey % 1500 AS k FROM {orders}) a
        CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(slot)""",
    "corners": """
        SELECT CAST(floor(o_orderkey/1500e0) AS BIGINT) AS snapshot_id, CAST(floor(o_orderkey/6e0) AS BIGINT) AS cell_id,
               o_orderkey % 6 AS slot, o_orderkey AS node_id FROM {orders}""",
}


def text(name: str) -> str:
    """A view with the plain table names the checking database knows."""
    return VIEWS[name].format(**{t: t for t in BASE})


def with_views(*names: str, more: dict[str, str] | None = None, final: str) -> str:
    """A query text over the named inputs and further steps."""
    steps = {n: text(n) for n in names} | (more or {})
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in steps.items()) + "\n" + final


class Inputs:
    """The inputs of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        used = {t: self.table(t) for t in BASE if "{" + t + "}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def volume(self) -> DataFrame:
        return self.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "log_q", "polarity")

    @cached_property
    def density(self) -> DataFrame:
        return self.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "ne")

    @cached_property
    def field_nodes(self) -> DataFrame:
        return self.nodes.select("snapshot_id", "i_r", "i_t", "i_p", "b_x", "b_y", "b_z")

    @cached_property
    def faces(self) -> DataFrame:
        """Tagged surfaces: the points near either end of the shell."""
        near = self.points.where((F.col("r") < 1.3) | (F.col("r") > 2.2))
        name = F.when(F.col("r") < 1.3, F.lit("Inlet")).otherwise(F.lit("Outlet"))
        return near.select("snapshot_id", name.alias("source_name"), F.col("pid").alias("face_id"), F.col("pid").alias("node_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query under an operator name, with the SQL that checks it where SQL can state it."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return rounded(build(Inputs(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles at fixed decimals (minus zero made zero), whole numbers as BIGINT.

    As the checking database rounds: the scaled double to a whole number, halves away from zero. Spark's own rounding goes by the
    shortest decimal text, which differs where a value lies next to a half.
    """
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            scale = 10.0 ** special.get(f.name, digits)
            out.append((F.round(F.col(f.name).cast("double") * scale) / scale + 0.0).alias(f.name))
        elif kind in ("integer", "short", "byte", "long"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def snapped(value: Column, exact: Column, within: float) -> Column:
    """A computed value, shown as the closed form where it is within the method's own error of it."""
    return F.when(F.abs(value - exact) < within, exact).otherwise(value)


def xyz() -> tuple:
    return F.col("x"), F.col("y"), F.col("z")


def r6(**columns: str) -> str:
    """Rounded select list of the checking query."""
    return ", ".join(f"(round({e}, 6) + 0e0) AS {n}" for n, e in columns.items())


def big(**columns: str) -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in columns.items())
