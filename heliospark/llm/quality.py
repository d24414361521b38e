"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

Every word (lower-cased) falls into one of ``words`` bins by its hash, with the logarithm of its count, all bins scaled
to length one. Beside them stand statistics of the text's structure and its length (metadata). Each feature has a weight
and a vector of ``rank`` numbers; a pair of features adds the product of their vectors. All pairs of a text are summed in
linear time: half the square of the sum less the sum of squares.

It is trained on at most about ``train_rows`` labelled rows, chosen from all by a hash of doc_id (a documented bound), by
Adam on the log loss in small batches on the driver, which holds that bounded sample and the model only.

Null is the empty text; an empty text gets a score from the bias and the statistics. Rows without a label, a null label
or one besides 0 and 1 are not learned from; without both labels the score is their share (0.5 without any). Repeated
labels count as often as they occur. A null doc_id is kept and not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.flat import LOWER, SOLID_BYTES, byte_set, prefix_hashes, runs, span_hashes, texts_of, word_spans
from heliospark.llm.frames import field, fold

STATISTICS = 14


@dataclass(frozen=True)
class QualityOptions:
    words: int = 4096
    rank: int = 8
    train_rows: int = 12_000
    epochs: int = 12
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def featurize(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bins and values of the words, and a table of statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(n), size)
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, SOLID_BYTES)
    hashes = span_hashes(prefix_hashes(low), starts, ends)
    bins = (hashes % np.uint64(words)).astype(np.int64)
    cells = np.sort(rows * words + bins)
    first, count = runs(cells)
    cells = cells[first]
    row, bin_ = cells // words, cells % words
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / np.maximum(norm, 1e-9)[row]

    def share(inside: np.ndarray) -> np.ndarray:
        return np.bincount(row_of, inside[data], minlength=n) / np.maximum(size, 1)

    n_words = np.bincount(rows, minlength=n)
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(rows[order][new], minlength=n)
    lines_s, lines_e, line_rows = word_spans(data, offsets, byte_set([10], invert=True))
    line_hash = span_hashes(prefix_hashes(data), lines_s, lines_e)
    order = np.lexsort((line_hash, line_rows))
    again = np.zeros(len(order), bool)
    again[1:] = (line_rows[order][1:] == line_rows[order][:-1]) & (line_hash[order][1:] == line_hash[order][:-1])
    n_lines = np.bincount(line_rows, minlength=n)
    repeated = np.bincount(line_rows[order][again], minlength=n)
    table = np.stack(
        [
            np.log1p(size) / 10,
            np.log1p(n_words) / 10,
            np.bincount(rows, ends - starts, minlength=n) / np.maximum(n_words, 1) / 10,
            distinct / np.maximum(n_words, 1),
            share(byte_set(range(48, 58))),
            share(byte_set(range(65, 91))),
            share(byte_set(b".,;:!?")) * 4,
            share(byte_set(b"!")) * 4,
            share(byte_set(b"#$%&*+/<=>@[]^_`{|}~\\")) * 4,
            share(byte_set(b"\n")) * 4,
            share(byte_set(range(128, 256))),
            repeated / np.maximum(n_lines, 1),
            np.bincount(line_rows, lines_e - lines_s, minlength=n) / np.maximum(n_lines, 1) / 500,
            (size == 0).astype(float),
        ],
        axis=1,
    )
    return row, bin_, value, np.minimum(table, 3.0)


class Machine:
    def __init__(self, features: int, options: QualityOptions):
        rng = np.random.default_rng(options.seed)
        self.bias, self.weights = 0.0, np.zeros(features)
        self.vectors = rng.normal(0, 0.05, (features, options.rank))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Linear part and all pairs, by half the square of the sum less the sum of squares."""
        pairs = ((x @ self.vectors) ** 2 - (x * x) @ (self.vectors**2)).sum(axis=1) / 2
        return self.bias + x @ self.weights + pairs

    def raw_sparse(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, rest: np.ndarray, words: int) -> np.ndarray:
        """The same over rows given as cells of words and a table of statistics."""
        n = len(rest)
        total = rest @ self.vectors[words:]
        squares = (rest * rest) @ (self.vectors[words:] ** 2)
        out = self.bias + rest @ self.weights[words:] + np.bincount(rows, values * self.weights[columns], minlength=n)
        for f in range(self.vectors.shape[1]):
            part = values * self.vectors[columns, f]
            total[:, f] += np.bincount(rows, part, minlength=n)
            squares[:, f] += np.bincount(rows, part * part, minlength=n)
        return out + (total**2 - squares).sum(axis=1) / 2


def chance(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(cells: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray, labels: np.ndarray, options: QualityOptions) -> Machine:
    rng = np.random.default_rng(options.seed)
    features = options.words + STATISTICS
    model = Machine(features, options)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model.bias = float(np.log(share / (1 - share)))
    moments = [np.zeros((features, options.rank + 1)) for _ in range(2)]
    step = 0
    for _ in range(options.epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), options.batch):
            chosen = order[k : k + options.batch]
            x = np.zeros((len(chosen), features))
            for i, j in enumerate(chosen):
                x[i, cells[j][0]] = cells[j][1]
            x[:, options.words :] = rest[chosen]
            total = x @ model.vectors
            pairs = (total**2 - (x * x) @ (model.vectors**2)).sum(axis=1) / 2
            error = (chance(model.bias + x @ model.weights + pairs) - labels[chosen]) / len(chosen)
            slope = np.empty((features, options.rank + 1))
            slope[:, 0] = x.T @ error
            slope[:, 1:] = x.T @ (error[:, None] * total) - ((x * x).T @ error)[:, None] * model.vectors
            now = np.column_stack((model.weights, model.vectors))
            slope += options.decay * now
            step += 1
            moments[0] = 0.9 * moments[0] + 0.1 * slope
            moments[1] = 0.999 * moments[1] + 0.001 * slope * slope
            now -= options.rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            model.weights, model.vectors = now[:, 0].copy(), now[:, 1:].copy()
            model.bias -= options.rate * float(error.sum())
    return model


def learn(docs: DataFrame, labels: DataFrame, options: QualityOptions) -> Machine | float:
    """The machine, or a constant score where the labels do not allow one."""
    known = labels.where(F.col("quality").isin(0, 1) & F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(False)))
    known = known.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
    total = known.count()
    if not total:
        return 0.5
    share = int(1_000_000 * min(1.0, options.train_rows / total))
    sample = known.where(F.pmod(F.xxhash64(F.lit("train"), "_id"), F.lit(1_000_000)) < share)  # about train_rows rows
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_label", "text")
    words = options.words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_of(batch, "text"):
                row, bin_, value, table = featurize(data, offsets, words)
                cuts = np.append(np.searchsorted(row, np.arange(b - a)), len(row)).astype(np.int32)
                stats = np.arange(b - a + 1, dtype=np.int32) * STATISTICS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(a, b - a).cast(pa.string()),
                        batch.column("_label").slice(a, b - a).cast(pa.int32()),
                        pa.ListArray.from_arrays(cuts, bin_.astype(np.int32)),
                        pa.ListArray.from_arrays(cuts, value.astype(np.float32)),
                        pa.ListArray.from_arrays(stats, table.astype(np.float32).ravel()),
                    ],
                    ["id", "label", "bins", "values", "table"],
                )

    found = rows.mapInArrow(scan, "id string, label int, bins array<int>, values array<float>, table array<float>").toArrow()
    found = found.sort_by("id")
    y = np.asarray(found.column("label").combine_chunks()).astype(float)
    if len(y) < 2 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    cells = [(b.values.to_numpy(), v.values.to_numpy()) for b, v in zip(found.column("bins").combine_chunks(), found.column("values").combine_chunks())]
    rest = np.array(found.column("table").to_pylist())
    return fit(cells, rest, y, options)


def score(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    model = learn(docs, labels, options)
    words = options.words
    schema = T.StructType([field(docs, "doc_id"), T.StructField("score", T.DoubleType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in texts_of(batch, "text"):
                if isinstance(model, Machine):
                    out = chance(model.raw_sparse(*featurize(data, offsets, words), words))
                else:
                    out = np.full(b - a, model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(out)], ["doc_id", "score"])

    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return (
        docs.select("doc_id", "text")
        .mapInArrow(scan, schema)
        .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
