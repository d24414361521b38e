"""Volumes, frames and small file facts at rest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.grid import GridSpec

VOLUME_FORMAT = "heliospark-volume-v1"
_KEY = ["snapshot_id", "i_r", "i_t", "i_p"]


def write_volume(
    path: str, volume: DataFrame, spec: GridSpec, provenance: dict, radial_sign: DataFrame | None = None,
    sign_spec: GridSpec | None = None, density: DataFrame | None = None, density_spec: GridSpec | None = None, dtype: str = "float32",
) -> None:
    """One Parquet table per channel, ordered by snapshot, and one metadata row.

    A snapshot lies together in few files, whose statistics lead a reader of one snapshot to it; there is no folder per
    snapshot, so the number of files follows the size and not the number of snapshots.
    """
    kinds = {"float32": "float", "float64": "double"}
    if dtype not in kinds:
        raise ValueError(f"dtype is 'float32' or 'float64', not {dtype!r}")
    grids = {"volume": spec.as_dict()}

    def put(name: str, df: DataFrame) -> None:
        df.repartitionByRange("snapshot_id", "i_r").sortWithinPartitions(*_KEY).write.parquet(f"{path}/{name}")

    put("log_q", volume.select(*_KEY, F.col("log_q").cast(kinds[dtype])))
    if "polarity" in volume.columns:
        put("polarity", volume.select(*_KEY, F.col("polarity").cast("tinyint")))
    if radial_sign is not None:
        grids["radial_sign"] = (sign_spec or spec).as_dict()
        put("radial_sign", radial_sign.select(*_KEY, F.col("sign").cast("tinyint")))
    if density is not None:
        grids["density"] = (density_spec or spec).as_dict()
        put("density", density.select(*_KEY, F.col("ne").cast(kinds[dtype])))
    spark = volume.sparkSession
    meta = [(VOLUME_FORMAT, json.dumps(grids), json.dumps(provenance))]
    spark.createDataFrame(meta, "format string, grids string, provenance string").coalesce(1).write.json(f"{path}/meta")


def read_volume(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, GridSpec], dict]:
    """Channels by name, grids by name and the provenance record; other formats are refused."""
    try:
        meta = spark.read.schema("format string, grids string, provenance string").json(f"{path}/meta").first()
    except Exception as error:
        raise ValueError(f"{path} holds no volume: {error}") from error
    if meta is None or meta["format"] != VOLUME_FORMAT:
        found = None if meta is None else meta["format"]
        raise ValueError(f"{path} is in format {found!r}; this reads {VOLUME_FORMAT!r}")
    grids = {name: GridSpec(**g) for name, g in json.loads(meta["grids"]).items()}
    channels = {"log_q": F.col("log_q").cast("double")}
    for name in ("polarity", "radial_sign", "density"):
        if name in grids or name == "polarity":
            channels[name] = F.col({"radial_sign": "sign", "density": "ne"}.get(name, name))
    out = {}
    for name, value in channels.items():
        try:
            rows = spark.read.parquet(f"{path}/{name}")
        except Exception:
            if name == "polarity":
                continue
            raise
        column = rows.columns[[c not in _KEY for c in rows.columns].index(True)]
        kind = "double" if name in ("log_q", "density") else "long"
        out[name] = rows.select(*[F.col(c).cast("long").alias(c) for c in _KEY], F.col(column).cast(kind).alias(column))
    return out, grids, json.loads(meta["provenance"])


def volume_provenance(input_facts: dict, field_facts: dict, volume_facts: dict, metrics: DataFrame) -> DataFrame:
    """The record kept with a volume: what went in, the resolved settings, coverage; one row per snapshot."""
    blocks = {"input": input_facts, "field": field_facts, "volume": volume_facts}
    fixed = {k: F.lit(json.dumps(v)) for k, v in blocks.items()}
    measured = F.struct(*[F.col(c) for c in metrics.columns if c != "snapshot_id"])
    return metrics.select(
        "snapshot_id", F.lit(VOLUME_FORMAT).alias("format"), *[v.alias(k) for k, v in fixed.items()],
        F.to_json(measured).alias("metrics"),
    )


def write_frames(path: str, frame: DataFrame, values: list[str], camera=None) -> DataFrame:
    """Pixel frames as FLOAT with their plane-of-sky axes, ordered by snapshot."""
    keys = [c for c in ("snapshot_id", "pixel_id", "prow", "pcol") if c in frame.columns]
    axes = [c for c in ("px", "py", "rho", "theta", "phi") if c in frame.columns]
    out = frame.select(*keys, *[F.col(c).cast("float") for c in [*axes, *values]])
    ordered = out.repartitionByRange("snapshot_id", "pixel_id" if "pixel_id" in keys else keys[-1])
    ordered.sortWithinPartitions(*keys).write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def short_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a binary or text column."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def content_hash(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``short_hash`` of each file; a file is one row, so it stays below 2 GiB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file_name"), short_hash(F.col("content")).alias("content_hash"))


def julian_date(ts: Column) -> Column:
    """UTC wall-clock time (TIMESTAMP_NTZ) to Julian date."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz")) / 86_400e6 + 2_440_587.5
