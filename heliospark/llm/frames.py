"""Small DataFrame helpers of the text operators."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.session import discard, materialise, scratch_path, ship_package, task_count

__all__ = ["prepare", "discard", "materialise", "scratch_path", "ship_package", "task_count", "table", "text_bytes", "parts", "fold", "field", "boxed", "release"]


#: Rows of a batch that a Python task gets at a time: documents are large rows.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the batches they get; call it once per session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one pass that sizes the work of those that follow."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def parts(amount: int, each: int, least: int = 1) -> int:
    """How many parts of about the given size, as a power of two."""
    return max(least, 1 << max(0, math.ceil(math.log2(max(1, amount) / each))))


def fold(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(by)).cast("long")


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """A column's field, nullable, under a new name."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one, ``doc``: names of added columns then clash with none of them. ``select("doc.*")`` undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def release() -> None:
    """Gives the memory that a task's arrays have left back to the system: Spark keeps its Python workers for later tasks,
    and what one stage left unused in them adds to what the next one needs."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
