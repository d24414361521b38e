"""Packing of documents into sequences: cutting stock by column generation.

A document's ids are cut at multiples of the capacity; whole pieces fill a sequence each. The lengths of the remaining
pieces, rounded up to a unit, make a histogram of at most capacity/unit kinds. On it a linear program chooses how often
each pattern (a multiset of kinds that fits into one sequence) is used; new patterns come from a knapsack dynamic program
over the program's prices. Pattern counts are rounded down, the rest is filled largest first. Pieces of a kind are
ranked and the ranks are dealt to the slots of the patterns.

Only the histogram (at most capacity/unit x SALTS counts) reaches the driver. No piece, sequence or token does.
Null text is the empty text; an empty text is the end id alone. Repeated rows are packed as often as they occur. A null
doc_id is kept. Extra columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from heliospark.llm.flat import LOWER, byte_set, prefix_hashes, span_hashes, texts_of, word_spans
from heliospark.llm.frames import field, materialise, release

#: Ranks of one kind of length are counted in so many parts, so that a length that most documents share is split.
SALTS = 256
#: Words whose ids a worker remembers; beyond it it starts anew. Results do not depend on it.
REMEMBERED = 1_000_000

_tokenizers: dict[str, "WordIds"] = {}
#: All bytes but the blank and the line feed, at which texts are cut into words.
INSIDE = byte_set(b" \n", invert=True)


class WordIds:
    """Ids of texts by a tokenizer that lets no token cross white space, remembering the ids of words.

    Words are cut at blanks and line feeds, which that tokenizer drops. A full stop or comma after an ASCII letter at a
    word's end is a word of its own, and ASCII letters are lower-cased, as that tokenizer does either. Words are known by
    64-bit hashes; each different one is given to the tokenizer once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")}
        self.forget()

    def forget(self) -> None:
        """Names of the known words, rising; the place of each one's ids, and how many it has."""
        self.names = np.zeros(0, np.uint64)
        self.places, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _alone(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[list[int]]:
        """Of words of letters only: one call for all, cut at the tokens that end a word."""
        ids = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        cuts = [k + 1 for k, i in enumerate(ids) if i in self.ends]
        if len(cuts) != len(words) or (cuts and cuts[-1] != len(ids)):
            return self._alone(words)
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, names: np.ndarray, words: list[str]) -> None:
        """Adds words by their (rising) names."""
        ids: list[list[int]] = [[]] * len(words)
        letters = [word.isalpha() for word in words]
        for ask, kind in ((self._letters, True), (self._alone, False)):
            chosen = [k for k, plain in enumerate(letters) if plain is kind]
            for k in range(0, len(chosen), 4096):
                part = chosen[k : k + 4096]
                for j, found in zip(part, ask([words[j] for j in part])):
                    ids[j] = found
        sizes = np.array([len(i) for i in ids], np.int64)
        flat = np.array([i for found in ids for i in found], np.uint32)
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.names, names)
        self.places = np.insert(self.places, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.names = np.insert(self.names, at, names)
        self.used += len(flat)

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each closed by the end id, and how many each row has."""
        raw = data.tobytes()
        low = data if b"<|" in raw else LOWER[data]
        starts, ends, rows = word_spans(low, offsets, INSIDE)
        last, before = low[ends - 1], low[np.maximum(ends - 2, starts)]
        marked = ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
        at = np.arange(len(starts)) + np.cumsum(marked) - marked
        firsts, lasts, owner = (np.zeros(len(starts) + int(marked.sum()), np.int64) for _ in range(3))
        firsts[at], lasts[at], owner[at] = starts, ends - marked, rows
        mark = at[marked] + 1
        firsts[mark], lasts[mark], owner[mark] = ends[marked] - 1, ends[marked], rows[marked]
        names, where, back = np.unique(span_hashes(prefix_hashes(low), firsts, lasts), return_index=True, return_inverse=True)
        if len(self.names) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.names, names)
        known = spot < len(self.names)
        known[known] = self.names[spot[known]] == names[known]
        if not known.all():
            new = where[~known]
            text = raw if low is data else low.tobytes()
            self.learn(names[~known], [text[a:b].decode() for a, b in zip(firsts[new].tolist(), lasts[new].tolist())])
            spot = np.searchsorted(self.names, names)
        spot = spot[back]
        sizes = self.sizes[spot]
        upto = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        ids = self.flat[np.repeat(self.places[spot] - upto, sizes) + np.arange(total)]
        n = len(offsets) - 1
        count = np.bincount(owner, sizes, minlength=n).astype(np.int64) + 1
        out = np.full(total + n, end_id, "<u4")
        out[np.arange(total) + np.repeat(owner, sizes)] = ids
        return out, count


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


@dataclass(frozen=True)
class PackOptions:
    tokenizer: str
    capacity: int = 4096
    unit: int = 8
    end_id: int = 2
    keep_ids: bool = False


def pieces(docs: DataFrame, options: PackOptions) -> DataFrame:
    """The documents' ids, cut at multiples of the capacity: one row per piece."""
    schema = T.StructType(
        [field(docs, "doc_id"), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))]
        + [T.StructField("ids", T.BinaryType())] * options.keep_ids
    )
    arrow_schema = to_arrow_schema(schema)
    capacity = options.capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(options.tokenizer)
        for batch in batches:
            for a, b, data, offsets in texts_of(batch, "text"):
                ids, sizes = encoder.ids(data, offsets, options.end_id)
                n_pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), n_pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * capacity
                length = np.minimum(sizes[row] - start, capacity)
                first = (np.cumsum(sizes) - sizes)[row] + start
                raw = memoryview(ids).cast("B")
                parts = [raw[4 * x : 4 * (x + n)] for x, n in zip(first.tolist(), length.tolist())]
                columns = [batch.column("doc_id").slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length)]
                columns += [pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[row])]
                if options.keep_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)
        release()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def generate_patterns(demand: np.ndarray, gap: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each, how many of every kind) and how often each is used, from the relaxed cutting-stock program.

    ``demand[t]`` counts pieces of t + 1 units; a sequence holds ``len(demand)`` units. Revised simplex from the patterns
    of one kind each; a column enters while the knapsack finds one worth more than 1. Ends at the optimum or once the
    bound of the knapsack value shows that the use is within ``gap`` of it.
    """
    room = len(demand)
    kinds = np.flatnonzero(demand) + 1
    m = len(kinds)
    need = demand[kinds - 1].astype(float)
    basis = np.zeros((m, m))
    np.fill_diagonal(basis, room // kinds)
    inverse = np.diag(1.0 / (room // kinds))
    use = inverse @ need
    back, worth, pick = np.zeros(room + 1), np.zeros(room), np.zeros(room + 1, np.int64)
    index = np.full(room, -1)
    index[kinds - 1] = np.arange(m)
    for _ in range(40 * m):
        prices = inverse.sum(axis=0)
        worth[kinds - 1] = prices
        for c in range(1, room + 1):  # back[room - c] is the best worth of c units
            values = back[room - c + 1 :] + worth[:c]
            at = int(values.argmax())
            better = values[at] > back[room - c + 1]
            back[room - c] = values[at] if better else back[room - c + 1]
            pick[c] = at if better else -1
        if back[0] <= 1 + 1e-9 or use.sum() <= (prices @ need) / back[0] * (1 + gap):
            break
        column, c = np.zeros(m), room
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[index[pick[c]]] += 1
                c -= pick[c] + 1
        change = inverse @ column
        rising = change > 1e-9
        ratio = np.where(rising, use / np.where(rising, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        use = use - step * change
        use[out] = step
        basis[:, out] = column
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
    patterns = np.zeros((m, room), np.int64)
    patterns[:, kinds - 1] = np.rint(basis.T).astype(np.int64)
    return patterns, np.maximum(use, 0)


def round_patterns(demand: np.ndarray, patterns: np.ndarray, use: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold every piece: rounded down, then the rest largest first."""
    chosen = [(p, int(n)) for p, n in zip(patterns, np.floor(use + 1e-7)) if n > 0]
    left = demand.astype(np.int64).copy()
    for p, n in chosen:
        left -= p * n
    left = np.maximum(left, 0)
    while left.any():
        room, bin_ = len(demand), np.zeros(len(demand), np.int64)
        while room > 0:
            fit = np.flatnonzero(left[:room] - bin_[:room] > 0)
            if not len(fit):
                break
            kind = int(fit[-1])
            n = min(room // (kind + 1), int(left[kind] - bin_[kind]))
            bin_[kind] += n
            room -= n * (kind + 1)
        times = int((left[bin_ > 0] // bin_[bin_ > 0]).min())
        chosen.append((bin_, times))
        left -= bin_ * times
    return chosen


def slots(demand: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ranks, kind by kind: where a run starts, its first sequence, and where each kind starts.

    Rank r of kind t is number ``base[t] + r``; the run that holds it gives the sequence, one further for each rank.
    """
    chosen = round_patterns(demand, *generate_patterns(demand)) if demand.any() else []
    firsts = np.cumsum([0, *(n for _, n in chosen)])
    starts, sequences, base, at = [], [], np.zeros(len(demand), np.int64), 0
    for kind in range(len(demand)):
        base[kind] = at
        for (p, n), first in zip(chosen, firsts):
            for _ in range(p[kind]):
                starts.append(at)
                sequences.append(int(first))
                at += n
    return np.array(starts, np.int64), np.array(sequences, np.int64), base


def pack(docs: DataFrame, options: PackOptions) -> DataFrame:
    """Pieces of all documents with the sequence and the offset in it that each one has."""
    kinds = -(-options.capacity // options.unit)
    cut = materialise(pieces(docs, options), "pieces")
    cut = cut.withColumn("kind", F.ceil(F.col("length") / options.unit).cast("int") - 1).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int")
    )
    counts = np.zeros((kinds, SALTS), np.int64)
    for kind, salt, n in cut.groupBy("kind", "salt").count().collect():  # at most kinds x SALTS rows
        counts[kind, salt] = n
    starts, sequences, base = slots(counts.sum(axis=1))
    before = base[:, None] + np.cumsum(counts, axis=1) - counts

    schema = T.StructType([f for f in cut.schema if f.name not in ("kind", "salt", "rank")] + [T.StructField("sequence_id", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, salt, rank = (np.asarray(batch.column(c)) for c in ("kind", "salt", "rank"))
            number = before[kind, salt] + rank
            run = np.searchsorted(starts, number, "right") - 1
            kept = [batch.column(f.name) for f in schema if f.name != "sequence_id"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences[run] + number - starts[run])], [f.name for f in schema])

    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("kind", "salt").orderBy("doc_id", "start")) - 1)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    return ranked.mapInArrow(deal, schema).withColumn(
        "offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )
