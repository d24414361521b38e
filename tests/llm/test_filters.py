"""Packing, contamination, repeated strings and near duplicates against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from brute import awkward, awkward_texts, contamination, empty, near, prose, repeats, rows_of
from pyspark.sql import functions as F

from heliospark.llm import repeats as repeated
from heliospark.llm.pack import PackOptions, generate_patterns, pack, round_patterns
from heliospark.llm.queries import public_tokenizer
from heliospark.llm.simhash import allocate, near_duplicates, without_near_duplicates
from heliospark.llm.winnow import contamination as measured
from heliospark.llm.winnow import gram_hashes, winnow, without_contaminated


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).repartition(3).persist()


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_keeps_every_id_once(docs, capacity):
    from tokenizers import Tokenizer

    got = pack(docs, PackOptions(public_tokenizer(), capacity=capacity, keep_ids=True)).toPandas()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= capacity and 1 - filled.sum() / (capacity * len(filled)) < 0.2
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    tokenizer = Tokenizer.from_file(public_tokenizer())
    want = sorted((repr(d), (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in awkward_texts())
    ids = []
    for (doc_id, total), group in got.groupby(["doc_id", "doc_tokens"], dropna=False):
        group = group.sort_values(["start", "ids_crc32"])
        assert (group.ids.map(zlib.crc32) == group.ids_crc32).all() and (group.ids.map(len) == 4 * group.length).all()
        copies = (group.start == 0).sum()
        assert group.length.sum() == copies * total
        whole = tuple(np.frombuffer(b"".join(group.ids[::copies]), "<u4").tolist())
        ids += [(repr(None if np.isnan(doc_id) else int(doc_id)), whole)] * copies
    assert sorted(ids) == want


def test_patterns_hold_all_pieces():
    rng = np.random.default_rng(3)
    for demand in (rng.integers(0, 50, 64), np.eye(64, dtype=int)[30] * 1000, rng.integers(0, 2, 64)):
        chosen = round_patterns(demand, *generate_patterns(demand))
        held = sum(p * n for p, n in chosen)
        assert (held >= demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in chosen)
        assert sum(n for _, n in chosen) <= 1.02 * max((demand * np.arange(1, 65)).sum() / 64, demand[32:].sum(), demand[30] / 2) + 12


def test_pack_of_nothing(spark):
    assert pack(empty(spark), PackOptions(public_tokenizer())).count() == 0


ITEMS = [
    (1, prose(1, 120)[50:260]),
    (2, "one two"),
    (2, "one two"),
    (3, "ONE"),
    (4, None),
    (5, "..."),
    (None, prose(103, 30)),
    (6, "one two three four five six seven eight nine ten eleven twelve"),
    (7, prose(108, 13)),
    (8, prose(9, 40_000, 3000)[5000:5200]),
    (9, "日本語のテキスト です"),
]


def test_contamination(spark, docs):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, uid int")
    assert rows_of(measured(docs, items)) == contamination(awkward_texts(), ITEMS)
    bad = {r[0] for r in contamination(awkward_texts(), ITEMS) if r[5]}
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in awkward_texts() if d is None or d not in bad}


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(measured(docs, none)) == contamination(awkward_texts(), [])
    assert measured(empty(spark), none).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(5)
    for words in (rng.integers(0, 4, 500).astype(np.uint64), np.zeros(100, np.uint64)):
        kept = winnow(gram_hashes(words, 7), np.zeros(len(words), int), 7, 13)
        assert all(((kept >= k) & (kept <= k + 6)).any() for k in range(len(words) - 12))


def test_repeats(docs):
    assert rows_of(repeated.repeated_bytes(docs)) == repeats(awkward_texts())


def test_text_without_repeats(docs):
    kept = repeated.without_repeats(docs)
    assert kept.columns == docs.columns
    gone = {(d, n) for d, n, removed, *_ in repeats(awkward_texts()) if n == removed > 0}
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(
        repr(d) for d, t in awkward_texts() if (d, len((t or "").encode())) not in gone
    )
    assert {r.doc_id: r.text for r in kept.collect()}[403] == "A."


def test_passages_by_words(spark):
    """A passage of over 50 words goes below 400 bytes too, a shorter one stays; 400 bytes go whatever their words."""
    short, long, few = (" ".join(prose(k, 200).split()[:n]) for k, n in ((1, 40), (2, 52), (3, 20)))
    solid = "x".join(prose(4, 200).split())[:450]
    assert 200 <= len(short) and len(long) < 400
    own = [prose(10 + k, 60, 5000) for k in range(8)]
    rows = [(k, f"{own[k]}\n{p}\n{own[k + 4]}") for k, p in enumerate((short, short, long, long))]
    rows += [(k, f"{prose(30 + k, 60, 5000)}\n{solid}\n{prose(40 + k, 60, 5000)}") for k in (4, 5)]
    rows += [(k, t) for k, t in ((6, f"{few} {solid[:150]}"), (7, f"{few} {solid[:150]}"), (8, long), (9, long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in repeated.without_repeats(docs, length=200, words=50, size=400).collect()}
    before = dict(rows)
    assert set(kept) == set(range(8))
    for k in (0, 1, 6, 7):
        assert kept[k] == before[k]
    for k, p in ((2, long), (3, long), (4, solid), (5, solid)):
        assert p not in kept[k] and len(before[k]) - len(p) - 8 <= len(kept[k]) <= len(before[k]) - len(p)
    assert rows_of(repeated.repeated_bytes(docs, 200)) == repeats(rows, 200)


def test_repeats_of_nothing(spark):
    assert repeated.repeated_bytes(empty(spark)).count() == 0
    assert repeated.without_repeats(empty(spark)).count() == 0


def test_difference_cover_and_blocks():
    modulus, cover = repeated.difference_cover()
    data = np.frombuffer(prose(5, 3000).encode(), np.uint8)
    at = repeated.sampled(len(data) - 220)
    assert set((at % modulus).tolist()) == set(cover.tolist())
    block, repeated.BLOCK = repeated.BLOCK, 1000
    try:
        small = repeated.string_names(data, at, 220, 3)
    finally:
        repeated.BLOCK = block
    assert (small == repeated.string_names(data, at, 220, 3)).all()


def test_near_duplicates(docs):
    assert rows_of(near_duplicates(docs)) == near(awkward_texts())


def test_one_document_of_each_component_stays(docs):
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert found == sorted({c for d, _, c in near(awkward_texts()) if d is not None and c == d})


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("total", [3, 50_000, 5_000_000])
def test_thresholds_add_up(total):
    rng = np.random.default_rng(1)
    bits = rng.random((2000, 64)) < rng.uniform(0.2, 0.8, 64)
    pairs = (bits.T.astype(float) @ bits) * total / 2000
    plan = allocate(total, pairs, 4)
    assert sum(most + 1 for _, most in plan) == 5 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_texts_meet_the_contaminated_ones_as_a_written_table(spark):
    """A side of unknown size would make Spark move all texts."""
    docs = spark.createDataFrame([(k, " ".join(f"a{k}b{j}" for j in range(30))) for k in range(8)], "doc_id long, text string")
    clean = without_contaminated(docs, docs.where("doc_id in (2, 5)").select(F.col("doc_id").alias("item_id"), "text"))
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan
    assert {r.doc_id for r in clean.collect()} == {0, 1, 3, 4, 6, 7}
