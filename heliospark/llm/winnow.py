"""Benchmark decontamination by winnowing.

Of every ``span - k + 1`` consecutive hashes of k-word grams the smallest (the last of equal ones) is kept as a
fingerprint. Two texts that share ``span`` words hold the same such window and so keep the same gram of it. Fingerprints
of documents and benchmark items are joined, and each hit is extended word by word to both sides; a run of at least
``span`` equal words is an occurrence. An item of fewer words is looked for whole, by a gram of its own length at
every position. Words are compared as text, so no hash collision can count.

A filter of fixed size (BLOOM_BITS) over the benchmark's fingerprints keeps other grams from being shuffled; a larger
benchmark only lets more of them through. A passage that most documents share is split by a salt of the document.

Null texts have no words. A document without words is clean. Items without words are never hit. Items are told apart by
item_id as text (null: the empty string), so repeated items count once. Repeated documents are judged one by one; null
doc_id is kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.flat import LOWER, WORD_BYTES, mix, prefix_hashes, span_hashes, texts_of, word_spans
from heliospark.llm.frames import boxed, field, materialise, task_count

BLOOM_BITS = 1 << 24
SALTS = 16

MARK = "array<struct<gram:bigint,at:int,need:int,before:array<string>,after:array<string>>>"
_MARK = pa.list_(
    pa.struct(
        [
            ("gram", pa.int64()),
            ("at", pa.int32()),
            ("need", pa.int32()),
            ("before", pa.list_(pa.string())),
            ("after", pa.list_(pa.string())),
        ]
    )
)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + size]
    return mix(out + np.uint64(n))


def winnow(grams: np.ndarray, rows: np.ndarray, k: int, span: int) -> np.ndarray:
    """Positions of the kept grams; ``rows`` tells the row of each word, windows do not cross rows."""
    window = span - k + 1
    if len(grams) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    inside = np.flatnonzero(rows[: len(views)] == rows[span - 1 : span - 1 + len(views)])
    least = np.full(len(views), np.iinfo(np.uint64).max, np.uint64)
    last = np.zeros(len(views), np.int64)
    for j in range(window):
        value = grams[j : j + len(views)]
        lower = value <= least
        least = np.where(lower, value, least)
        last[lower] = j
    kept = np.zeros(len(grams), bool)
    kept[inside + last[inside]] = True
    return np.flatnonzero(kept)


def _places(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return grams % np.uint64(bits), (grams >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)


def fingerprints(
    table: DataFrame, key: str, k: int, span: int, short: tuple[int, ...] | None, bloom: np.ndarray | None
) -> DataFrame:
    """Per row: a row id, the key, the number of words and the kept grams with the words around them.

    ``short``: lengths of short items to look for at every position; None for the benchmark itself, whose items below
    ``span`` words are one gram. ``bloom``: a packed filter that a gram has to pass.
    """
    names = ("uid", "key", "n_words", "marks")
    schema = T.StructType(
        [T.StructField("uid", T.LongType()), field(table, key, "key"), T.StructField("n_words", T.LongType())]
        + T._parse_datatype_string(f"marks {MARK}").fields
    )
    bits = BLOOM_BITS

    def passing(grams: np.ndarray) -> np.ndarray:
        if bloom is None:
            return np.ones(len(grams), bool)
        one, two = _places(grams, bits)
        seen = [(bloom[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in (one, two)]
        return (seen[0] & seen[1]).astype(bool)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_of(batch, "text"):
                low = LOWER[data]
                starts, ends, rows = word_spans(low, offsets, WORD_BYTES)
                hashes = span_hashes(prefix_hashes(low), starts, ends)
                n_words = np.bincount(rows, minlength=b - a)
                first = np.cumsum(n_words) - n_words
                found: list[tuple[np.ndarray, np.ndarray, int]] = []
                grams = gram_hashes(hashes, k)
                at = winnow(grams, rows, k, span)
                found.append((at, grams[at], span))
                lengths = range(1, span) if short is None else short
                for n in lengths:
                    if short is None:
                        at = first[n_words == n]
                        grams = gram_hashes(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
                    else:
                        grams = gram_hashes(hashes, n)
                        at = np.flatnonzero(rows[: len(grams)] == rows[n - 1 :][: len(grams)])
                        grams = grams[at]
                    found.append((at, mix(grams ^ np.uint64(n)), n))
                marks: list[list] = [[] for _ in range(b - a)]
                for at, grams, need in found:
                    ok = passing(grams)
                    for p, gram in zip(at[ok].tolist(), grams[ok].view(np.int64).tolist()):
                        row = rows[p]
                        lo, hi = first[row], first[row] + n_words[row]
                        word = [
                            low[starts[j] : ends[j]].tobytes().decode("utf-8", "replace")
                            for j in range(max(lo, p - span + k), min(hi, p + span))
                        ]
                        cut = p - max(lo, p - span + k)
                        if need < span:
                            cut, word = 0, word[cut : cut + need]
                        marks[row].append((gram, p - int(lo), need, word[:cut][::-1], word[cut:]))
                rows_out = [
                    [dict(zip(("gram", "at", "need", "before", "after"), m)) for m in doc] for doc in marks
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").slice(a, b - a),
                        batch.column("key").slice(a, b - a),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(rows_out, _MARK),
                    ],
                    names,
                )

    given = table.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col("text").alias("text"))
    return given.mapInArrow(scan, schema)


def _filter(items: DataFrame) -> np.ndarray:
    """The fixed-size filter over the benchmark's grams; at most BLOOM_BITS / 64 rows reach the driver."""
    bits = BLOOM_BITS
    schema = "word bigint, mask bigint"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.asarray(batch.column(0)).view(np.uint64)
            p = np.unique(np.concatenate(_places(grams, bits)))
            mask = np.left_shift(np.uint64(1), p & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).view(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    out = np.zeros(bits // 64, np.uint64)
    found = items.select("gram").mapInArrow(places, schema).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[np.asarray(found.column("word").combine_chunks())] = np.asarray(found.column("mask").combine_chunks()).view(np.uint64)
    return out.view(np.uint8)


def _shared(left: Column, right: Column) -> Column:
    """How many leading words two lists share."""
    unequal = F.array_position(F.zip_with(left, right, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    longest = F.greatest(F.size(left), F.size(right))
    return F.when(unequal == 0, longest).otherwise(unequal - 1).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 7, span: int = 13) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    spread = task_count(spark)
    items = materialise(
        fingerprints(benchmark, "item_id", k, span, None, None)
        .select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("item"), F.explode("marks").alias("m"))
        .select("item", "m.gram", "m.need", F.col("m.before").alias("item_before"), F.col("m.after").alias("item_after"))
        .distinct(),
        "items",
    )
    short = tuple(sorted(r[0] for r in items.select("need").where(F.col("need") < span).distinct().collect()))  # below span
    base = materialise(fingerprints(docs, "doc_id", k, span, short, _filter(items)), "marks")
    marks = base.select("uid", F.explode("marks").alias("m")).select(
        "uid", "m.gram", "m.need", "m.at", "m.before", "m.after", F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt")
    )
    salted = items.withColumn("salt", F.explode(F.array([F.lit(s) for s in range(SALTS)])))
    hits = (
        marks.repartition(spread, "gram", "salt")
        .join(salted, ["gram", "need", "salt"])
        .select(
            "uid",
            "item",
            "need",
            "at",
            _shared(F.col("before"), F.col("item_before")).alias("left"),
            _shared(F.col("after"), F.col("item_after")).alias("right"),
        )
        .where((F.col("right") >= F.least(F.lit(k), F.col("need"))) & (F.col("left") + F.col("right") >= F.col("need")))
        .select("uid", "item", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("end"))
    )
    hits = materialise(hits.distinct(), "hits")
    words = (
        hits.select("uid", "first", "end")
        .distinct()
        .select("uid", F.explode(F.sequence("first", F.col("end") - 1)).alias("word"))
        .distinct()
        .groupBy("uid")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        hits.select("uid", "item")
        .distinct()
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        base.select("uid", F.col("key").alias("doc_id"), "n_words")
        .join(words, "uid", "left")
        .join(named, "uid", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.encode(F.array_join(listed, ","), "UTF-8"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 7, span: int = 13) -> DataFrame:
    """The documents that are not contaminated, told apart by id and text."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    judged = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, k, span)
    bad = judged.where("contaminated").select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.text").alias("text")).distinct()
    bad = materialise(bad, "contaminated")  # few: Spark then knows its size and need not move the texts
    rows = boxed(docs)
    same = rows["doc.doc_id"].eqNullSafe(bad["id"]) & (F.xxhash64(rows["doc.text"]) == bad["text"])
    return rows.join(bad, same, "left_anti").select("doc.*")
