"""Alignment of two tokenizers: byte groups, links of token ids, and how usual each link is in the corpus.

A text is encoded by both tokenizers. The byte offsets at which their tokens end are two rising lists; those in both cut
the tokens into groups. The shorter list of a text drives a galloping search into the longer one: steps of 1, 2, 4, ... from
where the last search ended, then a binary search of the last step. Texts are searched side by side: the short list is
dealt to lanes of LANE ends, each lane gallops once from its text's start and then on from end to end. Common indices
slice the groups; differences of their ranks are how many tokens of either side overlap in a group.

Every pair of an A and a B token in a group is a link. A pair of ids counts once for each text that has it linked. Texts are
packed into slices of some MB; a slice counts its different pairs before anything is shuffled, the counts are added up by
range of A ids (which also gives the highest count of each A id), and the slice gets the sums of its pairs back. A slice
and its texts' pairs (as places in the slice's list) are written once and met once with the answers. A pair that all texts
have is one entry of each slice. Ranges are split by slice where there are many.

A group in which many tokens meet is counted by its different ids and how often they occur, so that a long run of one
character is few pairs. Null and empty texts, and such that either tokenizer does not give back byte by byte after a
leading space, have no tokens. A null doc_id is kept, repeated rows count as often as they occur, extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from heliospark.llm.flat import flat_texts, mix, portions, runs
from heliospark.llm.frames import field, materialise, parts, text_bytes

#: Ends of a lane; links of a group above which its different ids are counted first.
LANE = 32
WIDE = 256
#: Bytes of text of a slice and of a range of A ids; slices of a part of a range; bits of a B id.
SLICE = 8 << 20
RANGE = 32 << 20
SPLIT = 256
B_BITS = 15
#: Fixed: how byte-level vocabularies of this kind cut words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that are too long for ``tiktoken``'s pattern.
BLANK = re.compile(r"\s{500}")


@dataclass(frozen=True)
class AlignOptions:
    #: A file of ``tokenizers`` with byte-level tokens, a model of ``sentencepiece``, and the ranks of the first vocabulary
    #: for ``tiktoken`` (optional): the same ids, in less time.
    a: str
    b: str
    ranks: str | None = None


class Bytes:
    """The bytes of each id, and whether ids give back the bytes of texts."""

    def __init__(self, each: list[bytes]):
        self.sizes = np.array([len(x) for x in each])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(each), np.uint8)

    def faithful(self, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        sizes = self.sizes[ids]
        joined = self.flat[np.repeat(self.starts[ids], sizes) + within(sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        if joined == b"".join(raw) and np.array_equal(np.diff(ends, prepend=0), [len(r) for r in raw]):
            return np.ones(len(raw), bool)
        return np.array([joined[x:y] == r for x, y, r in zip([0, *ends.tolist()], ends.tolist(), raw)], bool)


class Pair:
    """Both tokenizers, the bytes of each id, and the ids as they are written into a group list."""

    def __init__(self, options: AlignOptions):
        import sentencepiece

        self.a, a_bytes = byte_level(options)
        model = sentencepiece.SentencePieceProcessor(model_file=options.b)
        self.b = lambda texts: model.encode(texts, num_threads=1) if texts else []
        b_bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = Bytes(a_bytes), Bytes(b_bytes)
        if len(a_bytes) > 1 << (31 - B_BITS) or len(b_bytes) > 1 << B_BITS:
            raise ValueError(f"ids of a pair have to fit into {31 - B_BITS} and {B_BITS} bits")
        numbers = [[f"{i}{end}".encode() for i in range(max(len(a_bytes), len(b_bytes)))] for end in (",", "|", ";", "")]
        self.width, self.numbers = len(numbers[0]), [x for n in numbers for x in n]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of both and how many each text has: none where the bytes do not come back."""
        spaced = [f" {t}" if t else "" for t in texts]
        raw = [t.encode() for t in spaced]
        (a, n_a), (b, n_b) = flat(self.a(spaced)), flat(self.b(texts))
        fine = self.a_bytes.faithful(a, n_a, raw) & self.b_bytes.faithful(b, n_b, raw)
        if not fine.all():
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
            n_a, n_b = n_a * fine, n_b * fine
        return a, n_a, b, n_b


def byte_level(options: AlignOptions) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """An encoder of texts without special tokens, and the bytes of its ids."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_file(options.a)
    model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown}
    byte |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    names = model.get_vocab()
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = bytes(byte.get(c, 63) for c in name)
    slow = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    if not options.ranks:
        return slow, out
    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, Path(options.ranks).read_bytes().splitlines())}
    model_ = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [slow([t])[0] if BLANK.search(t) else model_.encode_ordinary(t) for t in texts], out


_pairs: dict[AlignOptions, Pair] = {}


def pair_of(options: AlignOptions) -> Pair:
    if options not in _pairs:
        _pairs[options] = Pair(options)
    return _pairs[options]


def seek(x: np.ndarray, rising: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first place in [lo, hi) whose value is not below x, else hi: exponential, then binary search."""
    lo, far, step = lo.copy(), lo.copy(), 1
    going = np.flatnonzero(far < hi)
    while len(going):
        going = going[rising[far[going]] < x[going]]
        lo[going] = far[going] + 1
        far[going] = np.minimum(far[going] + step, hi[going])
        going = going[far[going] < hi[going]]
        step *= 2
    left = np.flatnonzero(lo < far)
    while len(left):
        middle = (lo[left] + far[left]) >> 1
        below = rising[middle] < x[left]
        lo[left[below]] = middle[below] + 1
        far[left[~below]] = middle[~below]
        left = left[lo[left] < far[left]]
    return lo


def gallop(short: np.ndarray, long: np.ndarray, short_at: np.ndarray, long_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that both lists have, text by text; ``short_at`` and ``long_at`` are (start, end) of each text."""
    lanes = -(-(short_at[1] - short_at[0]) // LANE)
    text = np.repeat(np.arange(len(lanes)), lanes)
    start = short_at[0][text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    size = np.minimum(short_at[1][text] - start, LANE)
    hi = long_at[1][text]
    found = np.full(len(short), -1)
    at = long_at[0][text]
    for k in range(LANE):
        on = np.flatnonzero(size > k)
        if not len(on):
            break
        x = short[start[on] + k]
        at[on] = seek(x, long, at[on], hi[on])
        same = on[at[on] < hi[on]]
        same = same[long[at[same]] == short[start[same] + k]]
        found[start[same] + k] = at[same]
    hits = np.flatnonzero(found >= 0)
    return hits, found[hits]


@dataclass
class Groups:
    """Flat ids of the texts of a portion, tokens of each text, and for each group its text and sizes."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def grouped(texts: list[str], pair: Pair) -> Groups:
    a, n_a, b, n_b = pair.encode(texts)
    ends_a, ends_b = np.cumsum(pair.a_bytes.sizes[a]), np.cumsum(pair.b_bytes.sizes[b])
    at_a, at_b = (np.stack((np.cumsum(n) - n, np.cumsum(n))) for n in (n_a, n_b))
    fewer = n_a <= n_b
    one = gallop(ends_a, ends_b, at_a[:, fewer], at_b[:, fewer])
    two = gallop(ends_b, ends_a, at_b[:, ~fewer], at_a[:, ~fewer])
    last_a, last_b = (np.sort(np.concatenate(x)) for x in ((one[0], two[1]), (one[1], two[0])))
    return Groups(a, b, n_a, n_b, np.searchsorted(at_a[1], last_a, "right"), np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1))


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def spelled(g: Groups, pair: Pair) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    upto_a, upto_b = np.cumsum(g.size_a), np.cumsum(g.size_b)
    codes = np.empty(len(g.a) + len(g.b), np.int64)
    place_a = np.arange(len(g.a)) + np.repeat(upto_b - g.size_b, g.size_a)
    place_b = np.arange(len(g.b)) + np.repeat(upto_a, g.size_b)
    codes[place_a], codes[place_b] = g.a, g.b
    codes[place_a[upto_a - 1]] += pair.width
    ends = place_b[upto_b - 1]
    last = np.append(g.text[1:] != g.text[:-1], True)[: len(ends)]
    codes[ends] += np.where(last, 3, 2) * pair.width
    at = np.cumsum(g.n_a + g.n_b).tolist()
    number = pair.numbers.__getitem__
    codes = codes.tolist()
    return [b"".join(map(number, codes[x:y])) for x, y in zip([0, *at], at)]


def links(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair of ids, links) for each pair of each text, rising."""
    wide = g.size_a * g.size_b > WIDE
    first_a, first_b = np.cumsum(g.size_a) - g.size_a, np.cumsum(g.size_b) - g.size_b
    narrow = np.flatnonzero(~wide)
    n_b = g.size_b[narrow]
    per = g.size_a[narrow] * n_b
    k = within(per)
    of = np.repeat(np.arange(len(narrow)), per)
    names = (g.text[narrow][of].astype(np.uint64) << np.uint64(31)) | (
        g.a[first_a[narrow][of] + k // n_b[of]] << B_BITS | g.b[first_b[narrow][of] + k % n_b[of]]
    ).astype(np.uint64)
    found = [(names, np.ones(len(names), np.int64))]
    for w in np.flatnonzero(wide).tolist():
        a, many_a = np.unique(g.a[first_a[w] : first_a[w] + g.size_a[w]], return_counts=True)
        b, many_b = np.unique(g.b[first_b[w] : first_b[w] + g.size_b[w]], return_counts=True)
        names = (np.uint64(g.text[w]) << np.uint64(31)) | (a[:, None] << B_BITS | b[None, :]).ravel().astype(np.uint64)
        found.append((names, (many_a[:, None] * many_b[None, :]).ravel()))
    names, many = (np.concatenate(x) for x in zip(*found))
    if len(found) == 1:
        names = np.sort(names)
        starts, many = runs(names)
    else:
        order = np.argsort(names, kind="stable")
        names = names[order]
        starts, _ = runs(names)
        many = np.add.reduceat(many[order], starts)
    names = names[starts]
    return (names >> np.uint64(31)).astype(np.int64), (names & np.uint64((1 << 31) - 1)).astype(np.int64), many


def range_of(pairs: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each pair, by its A id."""
    return (mix((pairs >> B_BITS).astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by byte planes and folded."""
    width = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << (8 * w))
    raw = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes() if len(values) else b""
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, size = raw[0], int.from_bytes(raw[1:9], "little")
    flat_ = np.frombuffer(pa.decompress(raw[9:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat_.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def texts_in(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str], int]]:
    """(first row, last row, texts, bytes) of a batch, portion by portion."""
    _, offsets = flat_texts(batch.column("text"))
    for a, b in portions(offsets):
        yield a, b, [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()], int(offsets[b] - offsets[a])


def slices(docs: DataFrame, ranges: int, options: AlignOptions) -> DataFrame:
    """One row for some MB of texts: their own columns as lists, their pairs, and what the slice asks each range for."""
    lists = [("doc_id", docs.schema["doc_id"].dataType), *((c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", T.StringType())]
    schema = T.StructType([T.StructField("slice", T.LongType()), *(T.StructField(c, T.ArrayType(t)) for c, t in lists)])
    schema = schema.add("counts", T.BinaryType()).add("gaps", T.BinaryType()).add("many", T.BinaryType())
    schema = schema.add("asks", T.ArrayType(T._parse_datatype_string("struct<range:int,pairs:binary,counts:binary>")))
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(options)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def passed() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            columns = [np.concatenate([h[k] for h in held]) for k in range(1, 5)]
            shas = [s for h in held for s in h[5]]
            per, pairs, many = (np.concatenate([h[k] for h in held]) for k in (6, 7, 8))
            different, back = np.unique(pairs, return_inverse=True)
            in_texts = np.bincount(back, minlength=len(different))
            where = range_of(different, ranges)
            order = np.argsort(where, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[back]
            text = np.repeat(np.arange(len(per)), per)
            sort = np.argsort((text << 32) | place)
            place, many = place[sort], many[sort]
            gaps = np.diff(place, prepend=0)
            starts = (np.cumsum(per) - per)[per > 0]
            gaps[starts] = place[starts]
            where = where[order]
            asks = []
            for a, n in zip(*(x.tolist() for x in runs(where))):
                some = order[a : a + n]
                asks.append({"range": int(where[a]), "pairs": packed(np.diff(different[some], prepend=0)), "counts": packed(in_texts[some])})
            row = [number + passed.done, ids, *map(pa.array, columns), pa.array(shas, pa.string())]
            passed.done += 1
            whole = [pa.array([row[0]])]
            for k, values in enumerate(row[1:], 1):
                whole.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(arrow.field(k).type))
            whole += [pa.array([packed(per)]), pa.array([packed(gaps)]), pa.array([packed(many)]), pa.array([asks], arrow.field("asks").type)]
            return pa.RecordBatch.from_arrays(whole, schema=arrow)

        passed.done = 0
        for batch in batches:
            for a, b, texts, amount in texts_in(batch):
                g = grouped(texts, pair)
                text, pairs, many = links(g)
                said = spelled(g, pair)
                shas = [hashlib.sha256(s).hexdigest() if s else "" for s in said]
                n = len(texts)
                groups = np.bincount(g.text, minlength=n)
                total = np.bincount(g.text, g.size_a * g.size_b, minlength=n).astype(np.int64)
                held.append((batch.column("doc_id").slice(a, b - a), g.n_a, g.n_b, groups, total, shas, np.bincount(text, minlength=n), pairs, many))
                size += amount
                if size >= SLICE:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, rising, and the sum of its counts."""
    pairs = [np.cumsum(unpacked(x)) for x in rows.column("pairs").to_pylist()]
    counts = [unpacked(x) for x in rows.column("counts").to_pylist()]
    names, counts = np.concatenate([np.zeros(0, np.int64), *pairs]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(names, kind="stable")
    names = names[order]
    starts, _ = runs(names)
    return names[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def align(docs: DataFrame, options: AlignOptions) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    size = text_bytes(docs)
    ranges = parts(size, RANGE)
    splits = parts(size, SPLIT * SLICE)
    cut = materialise(slices(docs, ranges, options), "slices")
    asks = cut.select("slice", F.explode("asks").alias("ask")).select("slice", "ask.*", F.pmod("slice", F.lit(splits)).alias("split"))

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        pairs, counts = summed(rows)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "pairs": [packed(np.diff(pairs, prepend=0))], "counts": [packed(counts)]})

    totals = asks.select("range", "split", "pairs", "counts").groupBy("range", "split").applyInArrow(add, "range int, pairs binary, counts binary")
    totals = totals.groupBy("range").applyInArrow(add, "range int, pairs binary, counts binary")
    totals = totals.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))))

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        pairs, counts = summed(known)
        starts, sizes = runs(pairs >> B_BITS)
        best = np.repeat(np.maximum.reduceat(counts, starts), sizes) == counts if len(starts) else counts
        told = 2 * counts + best
        out = [packed(told[np.searchsorted(pairs, np.cumsum(unpacked(x)))]) for x in asked.column("pairs").to_pylist()]
        return pa.table({"slice": asked.column("slice"), "range": asked.column("range"), "told": pa.array(out, pa.binary())})

    asked = asks.select("range", "split", "slice", "pairs").groupBy("range", "split")
    answers = asked.cogroup(totals.select("range", "split", "pairs", "counts").groupBy("range", "split")).applyInArrow(answer, "slice long, range int, told binary")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([field(docs, "doc_id"), *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("groups_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def finish(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        told = sorted(zip(answered.column("range").to_pylist(), answered.column("told").to_pylist()))
        told = np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for _, x in told)])
        per, gaps, many = (unpacked(rows.column(c)[0].as_py()) for c in ("counts", "gaps", "many"))
        upto = np.cumsum(gaps)
        first = np.cumsum(per) - per
        before = np.zeros(len(per), np.int64)
        full = (per > 0) & (first > 0)
        before[full] = upto[first[full] - 1]
        told = told[upto - np.repeat(before, per)]

        def of_texts(values: np.ndarray) -> pa.Array:
            total = np.concatenate(([0], np.cumsum(values)))
            return pa.array(total[first + per] - total[first])

        own = {c: rows.column(c).combine_chunks().flatten() for c in ("doc_id", *numbers[:4], "groups_sha256")}
        own |= {"n_best": of_texts(many * (told & 1)), "count_sum": of_texts(many * (told >> 1))}
        return pa.table([own[c].cast(arrow.field(c).type) for c in arrow.names], schema=arrow)

    whole = cut.drop("asks").groupBy("slice").cogroup(answers.groupBy("slice"))
    return whole.applyInArrow(finish, schema)


def alignments(docs: DataFrame, options: AlignOptions) -> DataFrame:
    """doc_id, the ids of both tokenizers and the sizes of the groups on either side."""
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes")
    schema = T.StructType([field(docs, "doc_id"), *(T.StructField(c, T.ArrayType(T.LongType())) for c in names)])
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(options)
        for batch in batches:
            for a, b, texts, _ in texts_in(batch):
                g = grouped(texts, pair)
                groups = np.bincount(g.text, minlength=len(texts))
                columns = [batch.column("doc_id").slice(a, b - a)]
                for values, sizes in ((g.a, g.n_a), (g.b, g.n_b), (g.size_a, groups), (g.size_b, groups)):
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values)))
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(k).type) for k, c in enumerate(columns)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)
