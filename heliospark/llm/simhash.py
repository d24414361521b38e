"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has a bit where over half of its shingles' hashes have it. Two fingerprints that differ in at most
``distance`` bits are linked. The 64 bits are put into parts, correlated bits together; each part gets an own threshold,
-1 (not searched) upwards, such that thresholds plus one add up to ``distance + 1``. Then a pair within the distance is
within some part's threshold, for otherwise every part would differ in one bit more than its threshold. Thresholds and
the number of parts are those of least cost (probes and estimated candidates) by dynamic programming. A fingerprint
probes all values of a part within its threshold; what it meets is verified on all bits inside the join.

Equal fingerprints are one node, so copies are never paired. Statistics for the parts are sums over all fingerprints
(64 x 64 counts); no fingerprint or link reaches the driver.
Null text is the empty text; texts without words have fingerprint zero and are linked like any other. Repeated rows
share a component. A component of null ids only has a null id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.components import components
from heliospark.llm.frames import boxed, field, materialise
from heliospark.session import large

BITS = 64


@dataclass(frozen=True)
class SimHashOptions:
    words: int = 4
    seed: int = 42
    distance: int = 4


def simhash(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows with so many hashes each: bits set in over half of them."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8)).reshape(-1, BITS)
        first = (np.cumsum(sizes) - sizes)[full]
        count = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * count > sizes[full, None], axis=1).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, options: SimHashOptions) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""
    schema = T.StructType([field(docs, "doc_id"), T.StructField("mark", T.LongType())])
    n, seed = options.words, options.seed

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                digests: list[int] = []
                sizes = []
                for text in part.column("text").to_pylist():
                    words = text.encode().lower().split() if text else []
                    if len(words) > n:
                        shingles = map(b" ".join, zip(*(words[j:] for j in range(n))))
                    else:
                        shingles = [b" ".join(words)] if words else []
                    before = len(digests)
                    digests += [xxh64_intdigest(s, seed) for s in shingles]
                    sizes.append(len(digests) - before)
                marks = simhash(np.array(digests, np.uint64), np.array(sizes, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "mark"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def bit_counts(marks: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set: sums over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            bits = ((np.asarray(batch.column(0)).view(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), rows))], ["at", "n"])

    found = marks.select("mark").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for at, n in found:  # 4,097 sums
        flat[at] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(total: int, pairs: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of nearly equal size; a part grows by the bit most correlated with those it has."""
    share = pairs.diagonal() / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs((pairs / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: tied[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: tied[b, group].sum()))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def near_chance(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, ... ``most`` or fewer of the given bits."""
    out = np.zeros(most + 1)
    out[0] = 1
    for p in share:
        differ = 2 * p * (1 - p)
        out = out * (1 - differ) + np.append(0, out[:-1]) * differ
    return np.cumsum(out)


def allocate(total: int, pairs: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost; the thresholds plus one add up to ``distance + 1``."""
    total = max(total, 1)
    share = pairs.diagonal() / total
    best: tuple[float, list] = (np.inf, [])
    for parts in range(min(2, distance + 1), distance + 2):
        groups = group_bits(total, pairs, parts)
        costs = []
        for group in groups:
            chance = near_chance(share[group], distance)
            probes = np.cumsum([comb(len(group), t) for t in range(distance + 1)])
            costs.append(np.append(0, total * probes + total * total / 2 * chance))
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list]] = {}
            for spent, (value, chosen) in table.items():
                for more in range(distance + 2 - spent):
                    new = (value + cost[more], [*chosen, more - 1])
                    if spent + more not in step or new[0] < step[spent + more][0]:
                        step[spent + more] = new
            table = step
        value, chosen = table[distance + 1]
        if value < best[0]:
            best = (value, list(zip(groups, chosen)))
    return [(group, most) for group, most in best[1] if most >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def near_links(marks: DataFrame, distance: int) -> DataFrame:
    """Pairs (u < v) of different fingerprints within the distance. ``marks``: each fingerprint once."""
    spark = marks.sparkSession
    total, pairs = bit_counts(marks)
    plan = allocate(total, pairs, distance)
    masks, flips = [], []
    for part, (group, most) in enumerate(plan):
        mask = sum(1 << b for b in group)
        masks.append((part, _signed(mask)))
        flips += [
            (part, _signed(mask), _signed(sum(1 << b for b in chosen))) for t in range(most + 1) for chosen in combinations(group, t)
        ]
    index = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("part"), F.lit(m).cast("long").alias("mask")) for p, m in masks]))
    probe = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).cast("int").alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip"))
                for p, m, x in flips
            ]
        )
    )
    kept = marks.select(F.col("mark").alias("v"), index.alias("p")).select("v", "p.part", F.col("v").bitwiseAND(F.col("p.mask")).alias("key"))
    asked = marks.select(F.col("mark").alias("u"), probe.alias("p")).select(
        "u", "p.part", F.col("u").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key")
    )
    verified = (asked["part"] == kept["part"]) & (asked["key"] == kept["key"]) & (asked["u"] < kept["v"])
    verified &= F.bit_count(asked["u"].bitwiseXOR(kept["v"])) <= distance
    # Spark sizes neither side by the rows that the explode makes of one
    return asked.join(large(kept), verified).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest id that links reach."""
    named = materialise(fingerprints(docs, options), "marks")
    nodes = materialise(named.groupBy("mark").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("mark"), options.distance))
    placed = nodes.join(large(roots.select(F.col("u").alias("mark"), F.col("v").alias("root"))), "mark", "left")
    placed = placed.select("mark", "least", F.coalesce("root", "mark").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    component = placed.join(large(least), "root").select("mark", "component_id")
    return named.join(large(component), "mark").select(
        "doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, options: SimHashOptions = SimHashOptions()) -> DataFrame:
    """One document of each component: the one with the smallest id. Of identical rows one stays."""
    first = near_duplicates(docs, options).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = boxed(docs).withColumn("id", F.col("doc.doc_id"))
    kept = kept.join(large(first), F.col("id").eqNullSafe(first["doc_id"]), "left_semi")
    same = Window.partitionBy("id", F.xxhash64("doc.text")).orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(same)).where("copy = 1").select("doc.*")
