"""Near duplicates of the pipeline against Jaccard similarity of all pairs."""

from __future__ import annotations

import random
import sys
from pathlib import Path

from brute import awkward, awkward_texts, empty, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from heliospark.llm import similar  # noqa: E402
from heliospark.llm.similar import BINS, SimilarOptions, apart_pairs, bucket_counts, likely, marked_pairs, name_sets, shared_entries  # noqa: E402

SF = "/root/testdata/sf0.01"


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def kept_ids(docs) -> set:
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            m, n = len(sets[a]), len(sets[b])
            if 5 * m >= 4 * n and 5 * n >= 4 * m:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (m + n - both):
                    root[top(a)] = top(b)
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return set(least.values())


def stage(spark, df):
    return dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, SF)


def test_long_texts_with_scattered_edits_are_near_duplicates(spark):
    rows = []
    for k in range(30):
        words = prose(k, 300 + 20 * k).split()
        rows.append((2 * k, " ".join(words)))
        for at in random.Random(k).sample(range(len(words)), max(1, len(words) * (k % 5) // 100)):
            words[at] = "edited"
        rows.append((2 * k + 1, " ".join(words)))
    group = prose(99, 400).split()
    for k in range(60):  # a group of near copies, some of them linked only through others
        group[7 * k % 400] = f"step{k}"
        rows.append((1000 + k, " ".join(group)))
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    want = kept_ids(rows)
    assert {r.doc_id for r in got.collect()} == want and len(want) < 45


def test_near_duplicates_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in stage(spark, docs).collect()} == kept_ids([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_of_one_size_that_share_a_passage_are_not_paired(spark):
    """Texts made mostly of one passage stay below the similarity: they must not meet in all pairs."""
    shared = prose(1, 800)
    rows = [(k, f"{shared} {prose(1000 + k, 160, 5000)}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = SimilarOptions()
    entries = shared_entries(docs, bucket_counts(docs, options), options).withColumn("root", F.col("node"))
    assert entries.select("node").distinct().count() == 120  # they do share first shingles
    assert apart_pairs(entries, options).count() < 120
    assert stage(spark, docs).count() == 120


def test_near_duplicates_of_awkward_rows(spark):
    got = stage(spark, awkward(spark))
    assert got.columns == awkward(spark).columns
    assert {r.doc_id for r in got.collect()} - {None} == kept_ids(awkward_texts())
    assert stage(spark, empty(spark)).count() == 0


def test_near_fingerprints_are_tried(spark):
    """Sets within the fingerprints' distance are candidates, those of one fingerprint too; what is not similar is dropped."""
    texts = [prose(k // 3, 400) for k in range(30)]
    for k in range(0, 30, 3):  # one word of 400, then some 60
        texts[k + 1] = texts[k].replace(texts[k].split()[200], "edited", 1)
        texts[k + 2] = " ".join("edited" if j % 7 == 3 else w for j, w in enumerate(texts[k].split()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    options = SimilarOptions()
    nodes = name_sets(docs, options).select("node", "mark").distinct()
    bits = {r.node: r.mark for r in nodes.collect()}
    pairs = {(r.u, r.v) for r in marked_pairs(nodes, options).collect()}
    least = {m: min(n for n in bits if bits[n] == m) for m in bits.values()}
    near = {(min(a, b), max(a, b)) for a in least.values() for b in least.values() if a != b and ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 4}
    assert pairs == near | {(least[m], n) for n, m in bits.items() if least[m] != n}
    assert len(pairs) >= 5
    assert {r.doc_id for r in stage(spark, docs).collect()} == kept_ids(list(enumerate(texts)))


def test_counts_by_bin_drop_no_similar_pair(spark):
    rng = random.Random(11)
    sets = {k: set(rng.sample(range(1 << 60), 150)) for k in range(30)}
    for k in range(30):  # 30 + k share ever more of the other's, 60 + k some tenth
        for base, kept in ((30, 90 + 2 * k), (60, 20)):
            sets[base + k] = set(rng.sample(sorted(sets[k]), kept)) | set(rng.sample(range(1 << 60), 150 - kept))
    sets[90] = {j * BINS for j in range(256)}  # 256 in one bin
    sets[91] = {j * BINS for j in range(300, 700)}
    sets[92] = {7}
    counts = {k: similar.bin_counts(np.array(sorted(s), np.uint64)) for k, s in sets.items()}
    assert counts[90] is None and counts[91] is None
    pairs = [(k, b + k) for k in range(30) for b in (30, 60)] + [(90, 91), (90, 92), (1, 92)]
    enough = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    nodes = spark.createDataFrame([(k, c) for k, c in counts.items()], "node long, bins binary")
    got = {(r.u, r.v) for r in likely(spark.createDataFrame(pairs, "u long, v long"), nodes, SimilarOptions()).collect()}
    assert {p for p in pairs if enough(*p)} <= got
    assert {(90, 91), (90, 92)} <= got and (1, 92) not in got
    assert not any((k, 60 + k) in got for k in range(30))
    assert likely(spark.createDataFrame([(90, 91)], "u long, v long"), nodes, SimilarOptions()).count() == 1
