"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

from __future__ import annotations

import sys
from pathlib import Path

from brute import awkward, awkward_texts, contamination, repeats
from test_similar import kept_ids

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from heliospark.session import materialise  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_keeps_what_each_stage_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "repeated_strings", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = materialise(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        if name == "near_duplicates":
            assert set(after) == kept_ids(before)
        if name == "repeated_strings":
            assert set(after) == {d for d, n, gone, *_ in repeats(before) if not n or gone < n}
        if name == "decontamination":
            assert set(after) == {r[0] for r in contamination(before, items) if not r[5]}
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(after)


def test_stages_stand_awkward_rows(spark):
    now = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = materialise(stage(spark, now, SF), name)
        assert now.columns == columns
    assert 0 < now.count() < len(awkward_texts())
    nothing = now.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
