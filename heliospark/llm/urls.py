"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Host, path and rules are DataFrame expressions. URLs that a rule judges are the labelled ones; a bounded sample of them
trains the trees (MLlib), which judge all others by length, depth, digit ratio, entropy, parameter counts and the share of
their host's suffix. Suffix shares count every row; suffixes fall into SUFFIXES hashed bins, so what is sent to the tasks
has a fixed size. Rules are a short list in the plan.

Null urls and such without ``://`` have an empty host and path, fit no rule and are judged by the trees. With labels of
one kind only all others get that verdict, without any the verdict is ``allow``. Repeated rows are judged alike. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.flat import byte_set, texts_of
from heliospark.llm.frames import field

#: Rules of the registered query: verdict and host with path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SUFFIXES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlOptions:
    train_rows: int = 20_000
    trees: int = 20
    depth: int = 4
    seed: int = 7


def split_url(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER), F.regexp_extract(whole, parts, 2)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def suffix(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIXES)).cast("int")


def features(rows: DataFrame, shares: np.ndarray) -> DataFrame:
    """Adds ``x``: lexical features of ``url``. ``shares``: the share of all rows for each bin of suffixes."""
    schema = T.StructType([*(field(rows, c) for c in rows.columns), T.StructField("x", T.ArrayType(T.DoubleType()))])
    digits, letters = byte_set(range(48, 58)), byte_set([*range(65, 91), *range(97, 123)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            host = np.array([len(h) for h in batch.column("host").to_pylist()], float)
            path = np.array([len(p) for p in batch.column("path").to_pylist()], float)
            share = np.log(shares[np.asarray(batch.column("suffix"))] + 1e-6)
            for a, b, data, offsets in texts_of(batch, "url"):
                row = np.repeat(np.arange(b - a), np.diff(offsets))
                counts = np.zeros((b - a, 256))
                np.add.at(counts, (row, data), 1)
                n = np.maximum(counts.sum(axis=1), 1)
                p = counts / n[:, None]
                entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
                columns.append(
                    np.stack(
                        [
                            counts.sum(axis=1),
                            counts[:, ord("/")],
                            counts[:, digits].sum(axis=1) / n,
                            counts[:, letters].sum(axis=1) / n,
                            entropy,
                            counts[:, ord("=")],
                            counts[:, ord("&")],
                            counts[:, ord("?")] + counts[:, ord("#")],
                            counts[:, ord("-")] + counts[:, ord("_")],
                            counts[:, ord(".")],
                        ],
                        axis=1,
                    )
                )
            x = np.column_stack([np.concatenate(columns), host, path, share]) if columns else np.zeros((0, 13))
            listed = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "x"])

    return rows.mapInArrow(scan, schema)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, options: UrlOptions = UrlOptions()) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' chance of ``block``; null where a rule decides)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, given = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": given, "suffix": suffix(F.col("host"))})
    counts = np.zeros(SUFFIXES)
    found = {}
    for bin_, kind, n in rows.groupBy("suffix", "given").count().collect():  # at most 3 x SUFFIXES rows
        counts[bin_] += n
        found[kind] = found.get(kind, 0) + n
    shares = counts / max(counts.sum(), 1)
    labelled = found.get("allow", 0) + found.get("block", 0)
    columns = ["page_id", "host", "path", "rule"]
    if not (found.get("allow") and found.get("block")):
        only = "block" if found.get("block") else "allow"
        return rows.select(*columns, F.coalesce("given", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    share = int(1_000_000 * min(1.0, options.train_rows / labelled))
    sample = rows.where(F.col("given").isNotNull() & (F.pmod(F.xxhash64(F.lit("train"), "page_id", "url"), F.lit(1_000_000)) < share))
    train = features(sample, shares).select(array_to_vector("x").alias("features"), (F.col("given") == "block").cast("double").alias("label"))
    kinds = [r[0] for r in train.select("label").distinct().collect()]  # 0 and 1
    if len(kinds) < 2:
        only = "block" if kinds == [1.0] else "allow"
        return rows.select(*columns, F.coalesce("given", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, seed=options.seed).fit(train)
    scored = features(rows, shares).withColumn("features", array_to_vector("x"))
    scored = model.transform(scored).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("given", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*columns, verdict.alias("verdict"), F.when(F.col("given").isNull(), F.col("score")).alias("score"))

