"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are summed over all training texts. A pair's count is put into levels, each twice the one
before; the filter holds (pair, 1), ..., (pair, level). A pair is looked up by probing level after level until one is
missing, which gives its count up to a factor and never too high but for the filter's errors. The filter has one part for
each range of names, with so many bits for each of its entries; it grows with the pairs and holds all of them.

The score of a token after another is ``(1 - mix) * word + mix * pair / context``: its share of all training tokens
(smoothed, see ``base_score``) and that of the pair among the context's. As levels only lower a count, the sum over all
tokens does not pass 1 but for the filter's errors. A text starts after a start mark and ends with an end token.

Neither word counts nor the filter are broadcast: texts are dealt to slices of some MB, each slice asks the ranges for the
counts of its different words and the levels of its different pairs, and the answers meet the slice's texts. Words are known by 64-bit hashes.

Null is the empty text, which is the end token alone. Without training texts every token has base probability 1.
A null doc_id is not held out and learned from. Repeated rows count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.counts import cuts, merged, pack_counts, totals
from heliospark.llm.flat import LOWER, SOLID_BYTES, mix, planes, prefix_hashes, runs, span_hashes, texts_of, unplanes, word_spans
from heliospark.llm.frames import field, fold, materialise, parts, text_bytes

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Tokens that a task counts before it passes the counts on; bytes of text of a slice; bytes of names of a range.
TOKENS = 1 << 21
SLICE = 4 << 20
RANGE = 4 << 20

COUNTS = "kind int, range long, names binary, counts binary"


@dataclass(frozen=True)
class ModelOptions:
    #: Of one filter; those of a range follow from its entries.
    bits: int = 1 << 28
    probes: int = 3
    bits_each: int = 12
    least: int = 1
    mix: float = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tokens of all rows, each row closed by the end token, and how many each row has."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, SOLID_BYTES)
    words = span_hashes(prefix_hashes(low), starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    out = np.full(len(words) + len(n), END, np.uint64)
    out[np.arange(len(words)) + rows] = words
    return out, n + 1


def contexts(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty_like(names)
    out[1:] = names[:-1]
    out[(np.cumsum(sizes) - sizes)] = START
    return out


def pair_names(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x2545F4914F6CDD1D) + names)


def distinct(names: np.ndarray) -> np.ndarray:
    """Each name once, rising. Names are sorted: ``np.unique`` without inverse hashes them, which takes far longer."""
    names = np.sort(names)
    return names[runs(names)[0]]


def count_tokens(docs: DataFrame, ranges: int) -> DataFrame:
    """Counts of words (kind 1) and of pairs (kind 2) of each range, summed within tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def passed() -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in ("kind", "range", "names", "counts")}
            for kind, column in ((1, 0), (2, 1)):
                names, counts = totals(np.concatenate([h[column] for h in held]))
                at = cuts(names, ranges)
                for k in np.flatnonzero(np.diff(at)):
                    packed = pack_counts(names[at[k] : at[k + 1]], counts[at[k] : at[k + 1]])
                    for values, value in zip(out.values(), (kind, int(k), *packed)):
                        values.append(value)
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

        for batch in batches:
            for _, _, data, offsets in texts_of(batch, "text"):
                names, sizes = tokens(data, offsets)
                held.append((names, pair_names(contexts(names, sizes), names)))
                size += len(names)
                if size >= TOKENS:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    return docs.select("text").mapInArrow(scan, COUNTS)


def filter_places(names: np.ndarray, level: int, ranges: int, options: ModelOptions) -> Iterator[np.ndarray]:
    """The bits of (name, level): each probe stays in the part of the filter that belongs to the name's range."""
    each = options.bits // ranges
    part = names >> np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else np.zeros(len(names), np.uint64)
    one = mix(names + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    two = (one >> np.uint64(32)) | np.uint64(1)
    for j in range(options.probes):
        yield part * np.uint64(each) + (one + np.uint64(j) * two) % np.uint64(each)


def levels_of(counts: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts / least, 1)) + 1e-9).astype(np.int64)


def level_counts(filter_: np.ndarray, names: np.ndarray, least: int, ranges: int, options: ModelOptions) -> np.ndarray:
    """Counts by repeated membership probes; 0 where level 1 is missing."""
    out = np.zeros(len(names))
    left = np.arange(len(names))
    for level in range(1, 64):
        inside = np.ones(len(left), bool)
        for at in filter_places(names[left], level, ranges, options):
            inside &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        left = left[inside]
        if not len(left):
            break
        out[left] = least * 2.0 ** (level - 1)
    return out


def range_filter(names: np.ndarray, counts: np.ndarray, options: ModelOptions) -> bytes:
    """The part of the filter that holds all levels of a range's pairs."""
    names, counts = names[counts >= options.least], counts[counts >= options.least]
    level = levels_of(counts, options.least)
    bits = np.zeros(64 * max(1, -(-int(level.sum()) * options.bits_each // 64)), bool)
    options = replace(options, bits=len(bits))
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in filter_places(names[level >= q], q, 1, options):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


def range_levels(part: bytes, names: np.ndarray, options: ModelOptions) -> np.ndarray:
    """The level of each pair in its range's part of the filter; 0 where it is missing."""
    counts = level_counts(np.frombuffer(part, np.uint8), names, options.least, 1, replace(options, bits=8 * len(part)))
    return np.where(counts > 0, levels_of(counts, options.least), 0).astype(np.uint8)


def _at_once(asked: list[bytes], found_of: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What is found for the names of all slices together: with more input a slice asks a range for fewer of them."""
    each = [unplanes(raw) for raw in asked]
    found = found_of(np.concatenate([np.zeros(0, np.uint64), *each]))
    return np.split(found, np.cumsum([len(e) for e in each])[:-1]) if each else []


def word_answers(names: np.ndarray, counts: np.ndarray, asked: list[bytes]) -> list[bytes]:
    """The counts of the words that each slice asks a range for."""

    def found(wanted: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return np.where(names[at] == wanted, counts[at], 0)

    return [planes(x) for x in _at_once(asked, found)]


def pair_answers(part: bytes | None, asked: list[bytes], options: ModelOptions) -> list[bytes]:
    """The levels of the pairs that each slice asks a range for; a range without a part has no pairs."""
    none = lambda wanted: np.zeros(len(wanted), np.uint8)
    return [x.tobytes() for x in _at_once(asked, none if part is None else lambda wanted: range_levels(part, wanted, options))]


def score(docs: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    size = text_bytes(docs)
    ranges = parts(2 * size, RANGE)
    slices = parts(size, SLICE)
    train = docs.where(F.coalesce(fold(F.col("doc_id"), 5) != 1, F.lit(True)))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        names, counts = merged(rows)
        kind = key[0].as_py()
        total, different = int(counts.sum()), len(names)
        packed = (range_filter(names, counts, options), b"") if kind == 2 else pack_counts(names, counts)
        return pa.table(
            {
                "kind": pa.array([kind], pa.int32()),
                "range": pa.array([key[1].as_py()], pa.int64()),
                "names": pa.array([packed[0]], pa.binary()),
                "counts": pa.array([packed[1]], pa.binary()),
                "total": pa.array([total], pa.int64()),
                "different": pa.array([different], pa.int64()),
            }
        )

    added = COUNTS + ", total long, different long"
    counted = materialise(count_tokens(train, ranges).groupBy("kind", "range").applyInArrow(add, added), "counts")
    n_all, n_different = (int(x or 0) for x in counted.where("kind = 1").agg(F.sum("total"), F.sum("different")).first())

    def all_tokens(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a slice's texts, how many each text has, and the pairs that the tokens end."""
        held = [tokens(d, o) for _, _, d, o in texts_of(rows, "text")]
        names, sizes = (np.concatenate([h[j] for h in held]) for j in range(2))
        return names, sizes, pair_names(contexts(names, sizes), names)

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        found: dict[str, list] = {c: [] for c in ("kind", "range", "names")}
        words, _, pairs = all_tokens(rows)
        for kind, names in enumerate((distinct(words), distinct(pairs)), 1):
            at = cuts(names, ranges)
            for k in np.flatnonzero(np.diff(at)):
                for values, value in zip(found.values(), (kind, int(k), planes(names[at[k] : at[k + 1]]))):
                    values.append(value)
        return pa.table(
            {
                "kind": pa.array(found["kind"], pa.int32()),
                "range": pa.array(found["range"], pa.int64()),
                "slice": pa.array([key[0].as_py()] * len(found["kind"]), pa.int64()),
                "names": pa.array(found["names"], pa.binary()),
            }
        )

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        raws = asked.column("names").to_pylist()
        if key[0].as_py() == 1:
            out = word_answers(*merged(known), raws)
        else:
            out = pair_answers(known.column("names")[0].as_py() if known.num_rows else None, raws, options)
        return pa.table({"slice": asked.column("slice"), "kind": asked.column("kind"), "range": asked.column("range"), "counts": pa.array(out, pa.binary())})

    out_schema = T.StructType(
        [field(docs, "doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )

    def assess(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        token, sizes, pair = all_tokens(rows)
        names, word_at = np.unique(token, return_inverse=True)
        pairs, pair_at = np.unique(pair, return_inverse=True)
        starts = {1: cuts(names, ranges), 2: cuts(pairs, ranges)}
        counts, levels = np.zeros(len(names), np.int64), np.zeros(len(pairs), np.uint8)
        for kind, k, raw in zip(*(answers.column(c).to_pylist() for c in ("kind", "range", "counts"))):
            part = slice(starts[kind][k], starts[kind][k + 1])
            if kind == 1:
                counts[part] = unplanes(raw).astype(np.int64)
            else:
                levels[part] = np.frombuffer(raw, np.uint8)
        first = np.cumsum(sizes) - sizes
        count = counts[word_at]
        chance = (count + 0.5) / (n_all + 0.5 * (n_different + 1))
        context = np.empty(len(token))
        context[1:] = count[:-1]
        context[first] = counts[names == END].sum()
        level = levels[pair_at]
        times = np.where(level > 0, options.least * 2.0 ** (level.astype(np.int64) - 1), 0)
        share = np.minimum(times / np.maximum(context, 1), 1) * (context > 0)
        mixed = np.log10((1 - options.mix) * chance + options.mix * share)
        columns = [sizes, *(np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10(chance), mixed))]
        return pa.table([rows.column("doc_id"), *map(pa.array, columns)], [f.name for f in out_schema])

    key = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(slices)).alias("slice")
    texts = docs.select("doc_id", "text", key)
    asked = texts.select("slice", "doc_id", "text").groupBy("slice").applyInArrow(ask, "kind int, range long, slice long, names binary")
    known = counted.select("kind", "range", "names", "counts").groupBy("kind", "range")
    answers = asked.groupBy("kind", "range").cogroup(known).applyInArrow(answer, "slice long, kind int, range long, counts binary")
    scored = texts.select("slice", "doc_id", "text").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(assess, out_schema)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
