"""Near duplicates by similarity of word shingles: SimHash with an exact check, completed by an exact self-join of sets.

Two texts are linked where the sets of their five-word shingles (ASCII case folded, white space as one space) have a
Jaccard similarity of 0.8 or more; a text of fewer words is one shingle. Sets have SimHash fingerprints (bits that over
half of the shingles have); ``simhash.near_links`` finds those within ``distance`` bits by the generalised pigeonhole
principle, and what it finds is verified on whole sets. Fingerprints at the least similarity differ in about 9.7 bits, so
they alone would miss pairs; the others are found by an exact join: with the shingles in one
order for all texts, the first ``n - ceil(0.8 n) + 1`` of both texts have one in common. The order is rare first, by
counts in 2**18 buckets of hashes over all texts (a bucket that holds several shingles only makes the order worse, not
the result), so that common lines and passages are not what texts meet in. What meets is pruned by sizes and by the
places of the first common shingle and by counts of both sets' shingles in bins, which bound what they share from above,
and verified on whole sets inside the join.

Texts with equal sets are one node. All that share a shingle are, with the pairs of near fingerprints, first tried against one pivot for each shingle (the set with
the fewest rarer ones, which of a group of near copies is the text that they were made of), then
those that are not yet in one component are tried in pairs, so a large group of near copies is not paired throughout.
Shingles and sets have 64-bit names. Of each component the row with the smallest id stays; where all ids are null, one row.
Null text is the empty text; texts without words are equal. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.components import components
from heliospark.llm.counts import cuts
from heliospark.llm.flat import LOWER, SOLID_BYTES, mix, planes, prefix_hashes, runs, span_hashes, texts_of, unplanes, word_spans
from heliospark.llm.frames import boxed, discard, field, materialise, parts, release, text_bytes
from heliospark.llm.simhash import near_links, simhash
from heliospark.session import large

#: Bits of a bucket's number; entries that a task holds before it passes them on; bytes of entries of a range.
BUCKETS = 18
ENTRIES = 1 << 19
RANGE = 8 << 20
#: Bins that a set's shingles are counted in: what two sets share is at most the sum of the lesser counts.
BINS = 256
#: Bits of the table that tells which sets are asked for; a set too many is dropped in the join.
ASKED = 23

ENTRY = ("keys", "nodes", "sizes", "places")
SHARED = "key long, node long, size long, place long, pivot long, pivot_size long, pivot_place long"


@dataclass(frozen=True)
class SimilarOptions:
    words: int = 5
    #: Least similarity as a fraction.
    part: int = 4
    whole: int = 5
    #: Bits in which fingerprints of candidates differ at most.
    distance: int = 4


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's different shingles, rising."""
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets, SOLID_BYTES)
    words = span_hashes(prefix_hashes(low), starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count

    def named(at: np.ndarray, length: int) -> np.ndarray:
        out = mix(words[at] + np.uint64(length))
        for j in range(1, length):
            out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[at + j])
        return out

    full = named(np.arange(max(0, len(words) - n + 1)), n)
    short = [named(first[count == k], k) for k in range(1, n)]
    seen = [0] * n
    out = []
    for at, k in zip(first.tolist(), count.tolist()):
        if k >= n:
            out.append(np.unique(full[at : at + k - n + 1]))
        elif k:
            out.append(short[k - 1][seen[k] : seen[k] + 1])
            seen[k] += 1
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(grams: np.ndarray) -> np.uint64:
    return mix(np.add.reduce(mix(grams), keepdims=True, dtype=np.uint64) + np.uint64(len(grams)))[0]


def bin_counts(grams: np.ndarray) -> bytes | None:
    """How many shingles a set has in each bin; none where a count does not fit a byte."""
    counts = np.bincount((grams & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def sets_of(batch: pa.RecordBatch, options: SimilarOptions) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """(first row, last row, shingles, names of the sets) of a batch, portion by portion."""
    for a, b, data, offsets in texts_of(batch, "text"):
        grams = shingles(data, offsets, options.words)
        yield a, b, grams, np.array([set_name(g) for g in grams], np.uint64)


def name_sets(docs: DataFrame, options: SimilarOptions) -> DataFrame:
    """doc_id, a hash of the text, the name of its set, the set's fingerprint and its counts by bin."""
    schema = T.StructType([field(docs, "doc_id"), *(T.StructField(c, T.LongType()) for c in ("seal", "node", "mark")), T.StructField("bins", T.BinaryType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            bins: list[bytes | None] = []
            for _, _, grams, some in sets_of(batch, options):
                names.append(some)
                marks.append(simhash(np.concatenate(grams), np.array([len(g) for g in grams], np.int64)))
                bins += map(bin_counts, grams)
            numbers = [pa.array(np.concatenate(x).view(np.int64)) for x in (names, marks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seal"), *numbers, pa.array(bins, pa.binary())], schema.names)
        release()

    return docs.select("doc_id", F.xxhash64("text").alias("seal"), "text").mapInArrow(scan, schema)


def bucket_counts(docs: DataFrame, options: SimilarOptions) -> np.ndarray:
    """In how many texts a shingle of each bucket is: fixed-size sums over all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKETS, np.int64)
        for batch in batches:
            for _, _, grams, _ in sets_of(batch, options):
                total += np.bincount((np.concatenate(grams) >> np.uint64(64 - BUCKETS)).astype(np.int64), minlength=len(total))
        chunks = total.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([planes(c) for c in chunks])], ["chunk", "counts"])
        release()

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(unplanes(c).astype(np.int64) for c in rows.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()]), "counts": pa.array([planes(total)])})

    schema = "chunk long, counts binary"
    out = np.zeros((64, 1 << (BUCKETS - 6)), np.int64)
    for chunk, counts in docs.select("text").mapInArrow(scan, schema).groupBy("chunk").applyInArrow(add, schema).collect():  # 64 rows
        out[chunk] = unplanes(counts)
    return out.ravel()


def shared_entries(docs: DataFrame, counts: np.ndarray, options: SimilarOptions) -> DataFrame:
    """The first shingles of each set that another set has among its first: each with its set, place and a pivot."""
    spark = docs.sparkSession
    ranges = parts(text_bytes(docs), RANGE)
    common = spark.sparkContext.broadcast(counts)
    part, whole = options.part, options.whole

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        order = common.value

        def passed() -> pa.RecordBatch:
            keys = np.concatenate([h[0] for h in held])
            rising = np.argsort(keys, kind="stable")
            at = cuts(keys[rising], ranges)
            full = np.flatnonzero(np.diff(at))
            columns = (np.concatenate([h[j] for h in held])[rising] for j in range(4))  # one at a time
            packed = [pa.array([planes(c[at[k] : at[k + 1]]) for k in full], pa.binary()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *packed], ["range", *ENTRY])

        for batch in batches:
            for _, _, grams, names in sets_of(batch, options):
                for g, name in zip(grams, names):
                    n = len(g)
                    if n:
                        first = g[np.lexsort((g, order[(g >> np.uint64(64 - BUCKETS)).astype(np.int64)]))][: n - -(-part * n // whole) + 1]
                        held.append((first, np.full(len(first), name), np.full(len(first), n), np.arange(len(first))))
                        size += len(first)
                        if size >= ENTRIES:
                            yield passed()
                            held, size = [], 0
        if held:
            yield passed()
        held = []
        release()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        release()
        keys, nodes, sizes, places = (np.concatenate([unplanes(x) for x in rows.column(c).to_pylist()]) for c in ENTRY)
        order = np.lexsort((nodes, keys))
        keys, nodes, sizes, places = keys[order], nodes[order], sizes[order], places[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes, sizes, places = keys[once], nodes[once], sizes[once], places[once]
        starts, lengths = runs(keys)
        more = np.repeat(lengths > 1, lengths)
        keys, nodes, sizes, places = keys[more], nodes[more], sizes[more], places[more]
        starts, lengths = runs(keys)
        order = np.lexsort((mix(nodes), places, keys))
        pivot = np.repeat(order[starts], lengths)  # the set with the fewest rarer shingles: the text that copies were made of
        columns = (keys, nodes, sizes, places, nodes[pivot], sizes[pivot], places[pivot])
        return pa.table([pa.array(c.astype(np.uint64).view(np.int64)) for c in columns], [c.split()[0] for c in SHARED.split(", ")])

    packed = docs.select("text").mapInArrow(scan, "range long, " + ", ".join(f"{c} binary" for c in ENTRY))
    return packed.groupBy("range").applyInArrow(meet, SHARED)


def may_be(a: tuple[Column, Column], b: tuple[Column, Column], options: SimilarOptions) -> Column:
    """Whether two sets (size, place) that meet first at these places can be similar enough."""
    (m, i), (n, j) = a, b
    part, whole = options.part, options.whole
    return (
        (m * whole >= n * part)
        & (n * whole >= m * part)
        & ((F.least(m - i, n - j)) * (part + whole) >= (m + n) * part)
    )


def likely(pairs: DataFrame, nodes: DataFrame, options: SimilarOptions) -> DataFrame:
    """Those of the pairs (u, v) whose counts by bin allow enough shared shingles: a bound from above, so no similar pair is
    lost, and whole sets are moved for few others. ``nodes``: node, bins."""
    part, whole = options.part, options.whole

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            known = pc.and_(pc.is_valid(rows.column("a")), pc.is_valid(rows.column("b")))
            yield from rows.filter(pc.invert(known)).select(["u", "v"]).to_batches()  # no counts: nothing is known
            rows = rows.filter(known)
            a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in "ab")
            shared, both = (x.sum(axis=1, dtype=np.int64) for x in (np.minimum(a, b), a.astype(np.uint16) + b))
            yield from rows.filter(pa.array(shared * (part + whole) >= both * part)).select(["u", "v"]).to_batches()

    met = pairs.join(large(nodes.select(F.col("node").alias("u"), F.col("bins").alias("a"))), "u")
    met = met.join(large(nodes.select(F.col("node").alias("v"), F.col("bins").alias("b"))), "v")
    return met.select("u", "v", "a", "b").mapInArrow(scan, "u long, v long")


def verified(docs: DataFrame, pairs: DataFrame, options: SimilarOptions) -> DataFrame:
    """Those of the pairs (u, v) of set names whose sets are similar enough."""
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << ASKED, bool)
        for batch in batches:
            table[(np.asarray(batch.column(0)).view(np.uint64) >> np.uint64(64 - ASKED)).astype(np.int64)] = True
        chunks = np.packbits(table).reshape(64, -1)
        full = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([chunks[k].tobytes() for k in full], pa.binary())], ["chunk", "bits"])

    def either(key: tuple, rows: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows.column("bits").to_pylist()])
        return pa.table({"chunk": pa.array([key[0].as_py()]), "bits": pa.array([bits.tobytes()])})

    table = np.zeros((64, 1 << (ASKED - 9)), np.uint8)
    schema = "chunk long, bits binary"
    for chunk, bits in asked.mapInArrow(marks, schema).groupBy("chunk").applyInArrow(either, schema).collect():  # 64 rows, 1 MB
        table[chunk] = np.frombuffer(bits, np.uint8)
    wanted = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        sent: set[int] = set()  # copies leave a task once
        for batch in batches:
            for _, _, grams, names in sets_of(batch, options):
                at = names >> np.uint64(64 - ASKED)
                hit = np.flatnonzero((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1)
                hit = [r for r, name in zip(hit.tolist(), names[hit].tolist()) if not (name in sent or sent.add(name))]
                for k in range(0, len(hit), 64):
                    some = hit[k : k + 64]
                    values = [grams[r].view(np.int64) for r in some]
                    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
                    yield pa.RecordBatch.from_arrays([pa.array(names[some].view(np.int64)), lists], ["node", "grams"])
        release()

    found = docs.select("text").mapInArrow(scan, "node long, grams array<long>")
    sets = materialise(found.join(large(asked), "node", "left_semi").dropDuplicates(["node"]), "sets")
    met = pairs.join(large(sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))), "u")
    met = met.join(large(sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))), "v")
    both = F.size(F.array_intersect("a", "b"))
    enough = both * (options.part + options.whole) >= (F.size("a") + F.size("b")) * options.part
    out = materialise(met.where(enough).select("u", "v"), "links")
    discard(sets)
    return out


def apart_pairs(placed: DataFrame, options: SimilarOptions) -> DataFrame:
    """Pairs (u, v) of sets of different roots that share a key and may be similar; ``placed``: key, node, size, place, root.

    Of two similar sets the smaller one has the key among its first ``n - ceil(2 part n / (part + whole)) + 1`` shingles,
    about half of those it is entered with, and is not smaller than part/whole of the other: so only those entries are
    joined with all, by key and class of size. Long passages that many texts of one size share are not joined where the
    texts have rarer shingles of their own.
    """
    part, whole = options.part, options.whole
    size = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(whole / part)) + 1e-9).cast("int")
    few = F.col("place") < F.col("size") - F.ceil(F.col("size") * (2 * part) / (part + whole) - 1e-6) + 1
    a = placed.withColumn("sizes", size).alias("a")
    b = placed.where(few).withColumn("sizes", F.explode(F.array(size, size + 1, size + 2))).alias("b")
    larger = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.node") > F.col("b.node")))
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.sizes") == F.col("b.sizes")) & larger & (F.col("a.root") != F.col("b.root"))
    apart &= may_be((F.col("a.size"), F.col("a.place")), (F.col("b.size"), F.col("b.place")), options)
    return a.join(large(b), apart).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def marked_pairs(nodes: DataFrame, options: SimilarOptions) -> DataFrame:
    """Pairs (u, v) of set names by fingerprints; ``nodes``: node, mark. Sets of one fingerprint are tried against one of
    them, and these against each other where the fingerprints are near."""
    marks = materialise(nodes.groupBy("mark").agg(F.min("node").alias("least")), "marks")
    same = nodes.join(large(marks), "mark").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    first, second = marks.select(F.col("mark").alias("u"), F.col("least").alias("a")), marks.select(F.col("mark").alias("v"), F.col("least").alias("b"))
    near = near_links(marks.select("mark"), options.distance).join(large(first), "u").join(large(second), "v")
    pairs = materialise(same.unionAll(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))), "marked")
    discard(marks)
    return pairs


def similar_links(docs: DataFrame, nodes: DataFrame, options: SimilarOptions) -> DataFrame:
    """Pairs (u, v) of set names that are similar, enough of them to connect all that are. ``nodes``: node, mark, bins."""
    marked = marked_pairs(nodes.select("node", "mark"), options)
    shared = materialise(shared_entries(docs, bucket_counts(docs, options), options), "shared")
    size, place = F.col("size"), F.col("place")
    tried = shared.where(F.col("node") != F.col("pivot")).where(may_be((size, place), (F.col("pivot_size"), F.col("pivot_place")), options))
    tried = tried.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v"))
    tried = materialise(marked.unionAll(tried).distinct(), "tried")
    discard(marked)
    able = materialise(likely(tried, nodes, options), "likely")
    links = verified(docs, able, options)
    discard(able)
    label = components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    placed = materialise(shared.select("key", "node", "size", "place").join(large(label), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    discard(shared)
    rest = materialise(likely(apart_pairs(placed, options).join(large(tried), ["u", "v"], "left_anti"), nodes, options), "rest")
    discard(placed, tried)
    return links.unionAll(verified(docs, rest, options))


def without_similar(docs: DataFrame, options: SimilarOptions = SimilarOptions()) -> DataFrame:
    """One document of each component: the one with the smallest id. Of identical rows one stays."""
    named = name_sets(docs, options)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "seal")
    nodes = materialise(named.groupBy("node").agg(F.min(rank).alias("least"), F.min("mark").alias("mark"), F.min("bins").alias("bins")), "nodes")
    roots = components(similar_links(docs, nodes.select("node", "mark", "bins"), options)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    first = nodes.join(large(roots), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    first = first.select(F.struct(F.col("least.doc_id").alias("id"), "least.seal").alias("key")).distinct()
    first = materialise(first, "first")  # all that the result reads
    discard(nodes)
    # a struct equals another with a null in the same place, so join and window share one key and the texts move once
    kept = boxed(docs).withColumn("key", F.struct(F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("seal")).cast(first.schema["key"].dataType))
    kept = kept.join(large(first), "key", "left_semi")
    same = Window.partitionBy("key").orderBy(F.lit(0))
    return kept.withColumn("copy", F.row_number().over(same)).where("copy = 1").select("doc.*")
