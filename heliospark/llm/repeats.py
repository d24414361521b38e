"""Suffix-array removal of repeated byte strings, by a difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. A difference cover D modulo v is a
set of residues such that any two positions, moved on by one same shift below v, both fall on residues of D. So two
equal strings of ``length`` bytes hold, at one same shift, two sampled positions that agree for ``length - v + 1`` bytes.

1. Sampled positions get the names of three consecutive blocks. The triples are sorted (ranges of names to a task) and
   those that occur twice are told apart. A name is a hash of what it names, so equal names need no renumbering, and the
   one recursion that is needed is a name made of the names of its blocks.
2. Remaining suffixes are merged in: a position not above a repeated sample by v or more may start a repeated string.
   All others are settled. Those positions get the name of their whole ``length``-byte prefix.
3. These are sorted likewise and neighbours compared: an equal neighbour means that the string occurs elsewhere.

Equal texts are one class, whose copies are counted; a class of two or more is covered whole (from ``length`` bytes on).
So copies are never compared. Classes are dealt to slices of a few MB by their digest and names to ranges; both numbers
grow with the input, so that every task holds a few MB whatever the skew. A name travels once per slice.
The cover's modulus is at most half of ``length``: 181 for 400 bytes, 73 for 200.

With ``words``, a covered run goes only if it has over so many whole words or ``size`` bytes: passages by words, whose
bytes vary with the language, are found as runs of shorter strings.
Names are 64-bit hashes: two different strings are taken for equal with chance n / 2**64 for n candidate positions.

Null is the empty text. Repeated rows are copies of each other. Extra columns are ignored by ``repeated_bytes`` and kept
by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm.flat import SOLID_BYTES, mix, planes, prefix_hashes, runs, span_hashes, unplanes
from heliospark.llm.frames import boxed, discard, materialise, parts, release, text_bytes

#: Bytes of text of a slice, and bytes of names of a range, on average.
SLICE = 4 << 20
RANGE = 4 << 20
#: Bytes of a text whose names are made at a time.
BLOCK = 1 << 20

CLASSES = "slice long, digest binary, text binary, copies long"
NAMES = "range long, slice long, names binary, twice binary"
ANSWERS = "slice long, range long, again binary"


@lru_cache
def difference_cover(r: int = 2) -> tuple[int, np.ndarray]:
    """The modulus 24r(r+1) + 12r + 13 and a cover of 6r + 4 residues, by Colbourn and Ling's rule."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    cover = np.cumsum([0, *steps])
    modulus = 24 * r * r + 36 * r + 13
    assert len({int(a - b) % modulus for a in cover for b in cover}) == modulus
    return modulus, cover


def cover_for(length: int) -> int:
    """The largest r whose modulus is at most half of the length."""
    r = 0
    while 48 * (r + 1) ** 2 + 72 * (r + 1) + 26 <= length:
        r += 1
    return r


def sampled(n: int, r: int = 2) -> np.ndarray:
    """Positions below n whose residue is in the cover."""
    modulus, cover = difference_cover(r)
    at = (np.arange(0, n, modulus)[:, None] + cover).ravel()
    return at[at < n]


def string_names(data: np.ndarray, at: np.ndarray, length: int, blocks: int = 1) -> np.ndarray:
    """Names of the strings of so many bytes at the given (rising) positions, each made of the names of its blocks."""
    out = np.zeros(len(at), np.uint64)
    edges = np.linspace(0, length, blocks + 1).astype(np.int64)
    for lo in range(0, len(data), BLOCK):
        a, b = np.searchsorted(at, (lo, lo + BLOCK))
        if a == b:
            continue
        prefix = prefix_hashes(data[lo : lo + BLOCK + length])
        here, name = at[a:b] - lo, np.zeros(b - a, np.uint64)
        for first, last in zip(edges[:-1], edges[1:]):
            name = mix(name * np.uint64(0x2545F4914F6CDD1D) + span_hashes(prefix, here + first, here + last))
        out[a:b] = name
    return out


class Slice:
    """The classes of one slice in the order of their digests."""

    def __init__(self, rows: pa.Table):
        seen: dict[bytes, list] = {}
        for digest, text, copies in zip(*(rows.column(c).to_pylist() for c in ("digest", "text", "copies"))):
            known = seen.setdefault(digest, [None, 0])
            known[0] = text if known[0] is None else known[0]
            known[1] += copies
        self.digests = sorted(seen)
        self.texts = [np.frombuffer(seen[d][0] or b"", np.uint8) for d in self.digests]
        self.copies = [seen[d][1] for d in self.digests]


def ask(slice_: int, names: np.ndarray, ranges: int) -> pa.Table:
    """Names of a slice, sorted, each once, cut into ranges; and which of them the slice has twice."""
    names = np.sort(names)
    starts, sizes = runs(names)
    once, twice = names[starts], sizes > 1
    cuts = np.searchsorted(once, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - ranges.bit_length() + 1)) if ranges > 1 else np.zeros(1, np.int64)
    cuts = np.append(cuts, len(once))
    full = np.flatnonzero(np.diff(cuts))
    return pa.table(
        {
            "range": pa.array(full, pa.int64()),
            "slice": pa.array(np.full(len(full), slice_), pa.int64()),
            "names": pa.array([planes(once[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
            "twice": pa.array([np.packbits(twice[cuts[k] : cuts[k + 1]]).tobytes() for k in full], pa.binary()),
        }
    )


def compare_neighbours(rows: pa.Table) -> pa.Table:
    """Sorts the names of a range over all slices; a name with an equal neighbour occurs again."""
    lists = [unplanes(x) for x in rows.column("names").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(rows.column("twice").to_pylist(), lists)]
    names, again = np.concatenate(lists), np.concatenate(twice).astype(bool)
    order = np.argsort(names, kind="stable")
    near = names[order]
    equal = near[1:] == near[:-1]
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    cuts = np.cumsum([0, *map(len, lists)])
    packed = [np.packbits(again[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"slice": rows.column("slice"), "range": rows.column("range"), "again": pa.array(packed, pa.binary())})


def answered(names: np.ndarray, ranges: int, answers: pa.Table) -> np.ndarray:
    """For each of the slice's names (as asked), whether it occurs again."""
    once, back = np.unique(names, return_inverse=True)
    shift = np.uint64(64 - ranges.bit_length() + 1)
    bounds = np.searchsorted(once, np.arange(ranges, dtype=np.uint64) << shift) if ranges > 1 else np.zeros(1, np.int64)
    bounds = np.append(bounds, len(once))
    again = np.zeros(len(once), bool)
    for k, bits in zip(answers.column("range").to_pylist(), answers.column("again").to_pylist()):
        a, b = bounds[k], bounds[k + 1]
        again[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return again[back]


def _covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Flags of the positions in any of the intervals [first, last)."""
    step = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def _spans(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)), axis=1)


def _passages(spans: np.ndarray, data: np.ndarray, words: int, size: int) -> np.ndarray:
    """Those of the spans that have over so many whole words or ``size`` bytes."""
    solid = _spans(SOLID_BYTES[data])
    held = np.searchsorted(solid[:, 1], spans[:, 1], "right") - np.searchsorted(solid[:, 0], spans[:, 0])
    return spans[(held > words) | (spans[:, 1] - spans[:, 0] >= size)]


def _within(spans: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(a, b) for a, b in spans]) if len(spans) else np.zeros(0, np.int64)


def class_results(docs: DataFrame, length: int = 400, keep_text: bool = False, words: int = 0, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """One row per different text: digest, n_bytes, n_removed, n_spans, kept_sha256[, kept: null where unchanged].

    The second table is a written one that the first reads.
    """
    total = text_bytes(docs)
    r = cover_for(length)
    modulus, cover = difference_cover(r)
    sample = length - modulus + 1
    slices = parts(total, SLICE)
    ranges = parts(8 * total * len(cover) // modulus, RANGE)
    exact_ranges = parts(2 * total, RANGE)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[bytes, int] = {}

        def rows(slice_, digest, text, copies):
            columns = [pa.array(slice_, pa.int64()), pa.array(digest, pa.binary()), pa.array(text, pa.binary()), pa.array(copies, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["slice", "digest", "text", "copies"])

        place = lambda d: int.from_bytes(d[:6], "little") % slices
        for batch in batches:
            new = []
            for text in batch.column(0).to_pylist():
                digest = hashlib.sha256(text).digest()
                if digest in more:
                    more[digest] += 1
                else:
                    more[digest] = 0
                    new.append((place(digest), digest, text, 1))
            if new:
                yield rows(*zip(*new))
        rest = [(place(d), d, None, n) for d, n in more.items() if n]
        if rest:
            yield rows(*zip(*rest))

    def sample_names(part: Slice) -> list[np.ndarray]:
        return [string_names(t, sampled(len(t) - sample + 1, r), sample, 3) if len(t) >= length else np.zeros(0, np.uint64) for t in part.texts]

    def triples(key: tuple, rows: pa.Table) -> pa.Table:
        release()
        names = sample_names(Slice(rows))
        return ask(key[0].as_py(), np.concatenate(names), ranges)

    def merge(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        part = Slice(rows)
        names = sample_names(part)
        again = np.split(answered(np.concatenate([np.zeros(0, np.uint64), *names]), ranges, answers), np.cumsum([len(n) for n in names])[:-1])
        out: dict[str, list] = {c: [] for c in ("digest", "text", "copies", "starts", "goes")}
        for digest, text, copies, flags in zip(part.digests, part.texts, part.copies, again):
            spans = np.zeros((0, 2), np.int64)
            if flags.any():
                at = sampled(len(text) - sample + 1, r)[flags]
                starts = len(text) - length + 1
                spans = _spans(_covered(starts, np.minimum(np.maximum(at - modulus + 1, 0), starts), np.minimum(at + 1, starts)))
            goes = copies < 2 or not words or len(_passages(np.array([[0, len(text)]]), text, words, size)) > 0
            for column, value in zip(out.values(), (digest, text.tobytes(), copies, spans.astype("<i8").tobytes(), goes)):
                column.append(value)
        slice_ = pa.array([key[0].as_py()] * len(part.digests), pa.int64())
        columns = [pa.array(v, kind) for v, kind in zip(out.values(), (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()))]
        return pa.table([slice_, *columns], ["slice", *out])

    def prefix_names(rows: pa.Table) -> tuple[list, list[np.ndarray], list[np.ndarray]]:
        rows = rows.sort_by("digest")
        listed = list(zip(*(rows.column(c).to_pylist() for c in ("digest", "text", "whole", "starts"))))
        at = [_within(np.frombuffer(s, "<i8").reshape(-1, 2)) for *_, s in listed]
        return listed, at, [string_names(np.frombuffer(t, np.uint8), p, length) for (_, t, *_), p in zip(listed, at)]

    def prefixes(key: tuple, rows: pa.Table) -> pa.Table:
        release()
        return ask(key[0].as_py(), np.concatenate(prefix_names(rows)[2]), exact_ranges)

    def finish(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        listed, at, names = prefix_names(rows)
        again = np.split(answered(np.concatenate([np.zeros(0, np.uint64), *names]), exact_ranges, answers), np.cumsum([len(n) for n in names])[:-1])
        out: dict[str, list] = {c: [] for c in ("digest", "n_bytes", "n_removed", "n_spans", "kept")}
        for (digest, text, whole, _), starts, flags in zip(listed, at, again):
            if whole:  # a copied class only lends its strings to the others
                continue
            starts = starts[flags]
            gone = _covered(len(text), starts, starts + length)
            if words:
                spans = _passages(_spans(gone), np.frombuffer(text, np.uint8), words, size)
                gone = _covered(len(text), spans[:, 0], spans[:, 1])
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(out.values(), (digest, len(text), int(gone.sum()), len(_spans(gone)), kept)):
                column.append(value)
        sha = pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())
        kept = pa.array([k if keep_text and n else None for k, n in zip(out["kept"], out["n_removed"])], pa.binary())
        numbers = [pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")]
        return pa.table([pa.array(out["digest"], pa.binary()), *numbers, sha, kept], ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    text = docs.select(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("text"))
    classed = text.mapInArrow(classes, CLASSES)
    asked = classed.groupBy("slice").applyInArrow(triples, NAMES)
    answers = asked.groupBy("range").applyInArrow(compare_neighbours, ANSWERS)
    merged = classed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(merge, "slice long, digest binary, text binary, copies long, starts binary, goes boolean")
    whole = (F.col("copies") > 1) & (F.length("text") >= length)
    open_ = F.length("starts") > 0
    merged = materialise(
        merged.select("slice", "digest", "copies", "starts", "goes", F.length("text").cast("long").alias("n_bytes"), whole.alias("whole"), F.when(open_, F.col("text")).alias("text")),
        "classes",
    )
    found = merged.where("text is not null")
    asked = found.groupBy("slice").applyInArrow(prefixes, NAMES)
    answers = asked.groupBy("range").applyInArrow(compare_neighbours, ANSWERS)
    finished = (
        found.groupBy("slice")
        .cogroup(answers.groupBy("slice"))
        .applyInArrow(finish, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    none = F.lit(None).cast("binary")
    settled = merged.where("text is null and not whole").select(
        "digest", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("digest")).alias("kept_sha256"), none.alias("kept")
    )
    copied = merged.where("whole").select(
        "digest",
        "n_bytes",
        F.when(F.col("goes"), F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.col("goes").cast("long").alias("n_spans"),
        F.when(F.col("goes"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        (F.when(F.col("goes"), F.lit(b"")) if keep_text else none).alias("kept"),
    )
    return settled.unionAll(copied).unionAll(finished), merged


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.encode(text, "UTF-8"), F.lit(b"")), 256))


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""
    rows = docs.select("doc_id", _digest("text").alias("digest"))
    return rows.join(class_results(docs, length)[0], "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 400, words: int = 0, size: int = 0) -> DataFrame:
    """The documents with the kept text; characters cut by a span are dropped, documents of which nothing stays go."""

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.array([x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), kept], ["digest", "kept"])

    results, scratch = class_results(docs, length, True, words, size)
    changed = results.where("n_removed > 0").select("digest", "kept")
    changed = materialise(changed.mapInArrow(valid, "digest binary, kept string"), "changed")
    discard(scratch)
    joined = boxed(docs).withColumn("digest", _digest("doc.text")).join(changed, "digest", "left").where("kept is null or kept <> ''")
    columns = {"text": F.coalesce("kept", "doc.text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("kept").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("kept")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
