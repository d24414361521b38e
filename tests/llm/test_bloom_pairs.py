"""Every counted pair is in the pair model, whatever the number of pairs."""

from __future__ import annotations

import numpy as np

from heliospark.llm import bloom_lm
from heliospark.llm.bloom_lm import ModelOptions, score
from heliospark.llm.flat import planes, unplanes


def test_a_range_holds_all_its_pairs():
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64))
    counts = np.maximum(1, rng.zipf(1.7, len(names)) % 10_000)
    options = ModelOptions()
    part = bloom_lm.range_filter(names, counts, options)
    levels = bloom_lm.range_levels(part, names, options)
    assert (levels >= 1 + np.floor(np.log2(counts))).all()
    other = rng.integers(1 << 63, (1 << 64) - 1, 60_000, dtype=np.uint64)
    assert (bloom_lm.range_levels(part, other, options) > 0).mean() < 0.05
    assert len(bloom_lm.range_filter(names[:10], counts[:10], options)) < len(part) / 100


def test_pairs_seen_once_keep_their_term(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(300)]
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()
    assert got and all(r.score > r.base_score + 20 for r in got)


def test_a_range_answers_all_slices_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64))
    counts = np.maximum(1, rng.zipf(1.7, len(names)) % 10_000)
    options = ModelOptions()
    part = bloom_lm.range_filter(names, counts, options)
    asked = [np.sort(rng.choice(names, n, replace=False)) for n in (0, 1, 40, 3_000)] + [names[:7] + np.uint64(1)]
    raws = [planes(a) for a in asked]
    alone = [bloom_lm.range_levels(part, a, options).tobytes() for a in asked]
    calls, levels = [], bloom_lm.range_levels
    monkeypatch.setattr(bloom_lm, "range_levels", lambda *a: calls.append(1) or levels(*a))
    assert bloom_lm.pair_answers(part, raws, options) == alone and len(calls) == 1
    assert bloom_lm.pair_answers(None, raws, options) == [bytes(len(a)) for a in asked]
    count = dict(zip(names.tolist(), counts.tolist()))
    got = [unplanes(r).tolist() for r in bloom_lm.word_answers(names, counts, raws)]
    assert got == [[count.get(x, 0) for x in a.tolist()] for a in asked]
    assert bloom_lm.word_answers(names, counts, []) == bloom_lm.pair_answers(part, [], options) == []
