"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. A letter trigram is the product of its
letters' vectors, rotated by their place; a text is the sum of its trigrams' vectors, a language the sum of its training
texts' vectors, each scaled to length one. A text gets the language whose prototype has the largest cosine with it.

Words are runs of letters, lower-cased; a blank before and after each counts as a letter. A null text, one without any
letter, and every text where nothing could be learned is ``und`` with score 0. Ties go to the language that sorts first.
Prototypes are learned from at most about ``train_rows`` rows of each language, chosen by a hash of doc_id: a documented
bound on the training sample; the sample comes from the whole table. Repeated rows are judged one by one; a null doc_id is
kept, counts as not held out and is not learned from. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.flat import mix
from heliospark.llm.frames import boxed, field, fold, release

UNKNOWN = "und"
#: Rows and characters of a batch of texts that are turned into vectors at a time.
ROWS, CHARS = 96, 1 << 18


@dataclass(frozen=True)
class LanguageOptions:
    size: int = 512
    train_rows: int = 10_000
    most_languages: int = 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case form of every letter's code point, 0 for all other characters."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letter_vectors(points: np.ndarray, size: int) -> np.ndarray:
    """Random signs of each code point; 0 stands for the blank."""
    seeds = mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    words = mix(seeds[:, None] + np.arange(1, size // 64 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def vectors(texts: list[str], size: int) -> np.ndarray:
    """The bundled vector of each text, a row of zeros where it has no letter."""
    out = np.zeros((len(texts), size), np.float32)
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(["", *texts, ""])).encode("utf-32-le"), np.uint32)
    rows = np.concatenate(([0], np.repeat(np.arange(len(texts)), lengths)))
    low = _letters()[points]
    kept = low > 0
    kept[1:] |= kept[:-1]
    kept[:-1] |= low[1:] > 0
    low, rows = low[kept], rows[kept]
    # a run of other characters may have left two blanks; one is enough
    double = np.zeros(len(low), bool)
    double[1:] = (low[1:] == 0) & (low[:-1] == 0)
    low, rows = low[~double], rows[~double]
    if len(low) < 3:
        return out
    alphabet, code = np.unique(low, return_inverse=True)
    n = len(alphabet)
    middle = np.flatnonzero(low[1:-1] > 0) + 1
    row = rows[middle]
    keys = (code[middle - 1].astype(np.int64) * n + code[middle]) * n + code[middle + 1]
    if n <= 128:
        present = np.flatnonzero(np.bincount(keys, minlength=n**3))
        place = np.empty(n**3, np.int32)
        place[present] = np.arange(len(present), dtype=np.int32)
        at = place[keys]
    else:
        present, at = np.unique(keys, return_inverse=True)
    base = letter_vectors(alphabet, size)
    for lo in range(0, len(present), 1 << 13):  # bounds the vectors made at a time
        part = present[lo : lo + (1 << 13)]
        grams = np.roll(base, 2, axis=1)[part // (n * n)] * np.roll(base, 1, axis=1)[part // n % n] * base[part % n]
        inside = (at >= lo) & (at < lo + len(part)) if len(present) > len(part) else slice(None)
        counts = np.bincount(row[inside] * len(part) + (at[inside] - lo), minlength=len(texts) * len(part))
        out += counts.reshape(len(texts), len(part)).astype(np.float32) @ grams.astype(np.float32)
    return out


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for k, text in enumerate(texts):
        if k > first and (k - first >= ROWS or size + len(text) > CHARS):
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def learn(docs: DataFrame, options: LanguageOptions) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from the rows that are not held out."""
    given = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    sizes = {r["lang"]: r["count"] for r in given.groupBy("lang").count().limit(options.most_languages + 1).collect()}
    if len(sizes) > options.most_languages:
        raise ValueError(f"more than {options.most_languages} languages")
    if not sizes:
        return [], np.zeros((0, options.size))
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, options.train_rows / n))).otherwise(share)
    chosen = given.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    size = options.size

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in batches_of(texts):
                each = unit(vectors(texts[a:b], size))
                for k, lang in enumerate(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + each[k]
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(range(size), pa.int32()), pa.array(total)], ["lang", "at", "x"])

    total = chosen.select("lang", "text").mapInArrow(bundle, "lang string, at int, x double")
    rows = total.groupBy("lang", "at").agg(F.sum(F.round(F.col("x") * 2**20).cast("long")).alias("x")).collect()  # languages x size
    names = sorted({r["lang"] for r in rows})
    model = np.zeros((len(names), size))
    for r in rows:
        model[names.index(r["lang"]), r["at"]] = r["x"]
    return names, unit(model)


def predictions(rows: DataFrame, names: list[str], model: np.ndarray, options: LanguageOptions) -> DataFrame:
    """``key`` of the rows with lang_pred and score. The text is a column, or else a field of the key."""
    size = options.size
    schema = T.StructType([field(rows, "key"), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            column = batch.column("text") if "text" in batch.schema.names else batch.column("key").field("text")
            for k in range(0, batch.num_rows, 256):
                texts = [t or "" for t in column.slice(k, 256).to_pylist()]
                for a, b in batches_of(texts):
                    if not names:
                        langs += [UNKNOWN] * (b - a)
                        scores += [0.0] * (b - a)
                        continue
                    cosine = unit(vectors(texts[a:b], size)) @ model.T
                    best = np.round(cosine, 12).argmax(axis=1)
                    some = np.array([any(map(str.isalpha, t)) for t in texts[a:b]])
                    langs += [names[j] if s else UNKNOWN for j, s in zip(best, some)]
                    scores += np.where(some, np.clip(cosine[np.arange(b - a), best], 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])
        release()

    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score (the cosine, at least 0)."""
    found = predictions(docs.select(F.col("doc_id").alias("key"), "text"), *learn(docs, options), options)
    held = F.coalesce(fold(F.col("key"), 5) == 0, F.lit(False))
    return found.select(F.col("key").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, options: LanguageOptions = LanguageOptions(), chars: int = 200, least: float = 0.1) -> DataFrame:
    """The documents in a known language.

    Rejected are those without a language, and those of at least ``chars`` characters whose cosine is below ``least``:
    a shorter text holds too few trigrams to be told from noise and stays.
    """
    found = predictions(boxed(docs).select(F.col("doc").alias("key")), *learn(docs, options), options)
    sure = (F.char_length("key.text") < chars) | (F.col("score") >= least)
    return found.where((F.col("lang_pred") != UNKNOWN) & sure).select("key.*")
