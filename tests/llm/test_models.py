"""Fingerprints, learned operators and chat formatting."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest
from brute import awkward, awkward_texts, base_scores, empty, fold, likeness, order_minhash, prose, spelled

from heliospark.llm import bloom_lm
from heliospark.llm.chat import example_texts, examples, formatted, read_back
from heliospark.llm.language import identify, recognised
from heliospark.llm.order_minhash import edited_pairs
from heliospark.llm.quality import score as quality
from heliospark.llm.queries import ORACLES, QUERIES
from heliospark.llm.urls import RULES, judge

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check import compare, database  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).repartition(3).persist()


def test_order_minhash(docs):
    seal = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = sorted(((d, t or "") for d, t in awkward_texts()), key=lambda r: (r[0] is not None, r[0] or 0, seal(r[1])))
    assert len({d for d, _ in rows}) < len(set(rows)) < len(rows)
    want = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, other = order_minhash(text), order_minhash(edited), order_minhash(after)
        near = round(likeness(own, changed), 9), round(likeness(own, other), 9)
        want.append((doc_id, len(text), seal(edited), spelled(own), spelled(changed), *near))
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in edited_pairs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_order_minhash_of_nothing(spark):
    assert edited_pairs(empty(spark)).count() == 0


def test_order_minhash_tells_edits_from_other_texts(spark):
    got = QUERIES["op4_order_minhash"](spark, SF).toPandas()
    assert (got.near_edited > got.near_next + 0.2).mean() > 0.97


def test_base_scores(docs):
    got = sorted((tuple(r)[:6] for r in bloom_lm.score(docs).collect()), key=repr)
    want = base_scores(awkward_texts())
    assert sorted(repr(r[:5]) for r in got) == sorted(repr(r[:5]) for r in want)
    assert np.allclose(sorted(r[5] for r in got), sorted(r[5] for r in want), rtol=1e-9)


def test_language_model_beats_words_on_held_out_texts(spark):
    got = QUERIES["op7_bloom_lm"](spark, SF).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score <= 0).all()


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(2)
    options = bloom_lm.ModelOptions(bits=1 << 18)
    names, counts = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)), rng.integers(2, 500, 5000)
    for ranges in (1, 16):
        bits = np.zeros(1 << 18, bool)
        level = bloom_lm.levels_of(counts[: len(names)], 2)
        for q in range(1, level.max() + 1):
            for at in bloom_lm.filter_places(names[level >= q], q, ranges, options):
                bits[at] = True
        packed = np.packbits(bits, bitorder="little")
        found = bloom_lm.level_counts(packed, names, 2, ranges, options)
        assert (found >= 2.0**level).all() and (found == 2.0**level).mean() > 0.9
        unknown = bloom_lm.level_counts(packed, rng.integers(0, 1 << 62, 5000).astype(np.uint64), 2, ranges, options)
        assert (unknown > 0).mean() < 0.05


def test_language_model_of_nothing(spark):
    assert bloom_lm.score(empty(spark)).count() == 0
    held = [k for k in range(100) if fold(k, 5) == 1][:3]
    only = bloom_lm.score(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in only] == [(True, 3, 0, 0, 0.0, only[0].score)] * 3


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op2_language"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_awkward_rows(spark, docs):
    got = identify(docs).collect()
    assert len(got) == len(awkward_texts())
    by = {r.doc_id: r for r in got}
    for k in (400, 401, 402, 404):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[403].lang_pred != "und" and all(r.held_out == (fold(r.doc_id, 5) == 0) for r in got)
    kept = recognised(docs)
    assert kept.columns == docs.columns and not {400, 401, 402, 404} & {r.doc_id for r in kept.collect()}
    assert identify(empty(spark)).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert identify(unlabelled).first().lang_pred == "und"


def test_quality_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op10_quality"](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    ones = got.quality == 1
    area = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert area > 0.9 and (got.predicted == (got.score >= 0.5)).all()


def test_quality_of_awkward_rows(spark, docs):
    marks = [(d, k % 2, None) for k, (d, _) in enumerate(awkward_texts())] + [(1, None, 0), (2, 7, 0), (None, 1, 1)]
    got = quality(docs, spark.createDataFrame(marks, "doc_id long, quality int, score int")).collect()
    assert len(got) == len(awkward_texts()) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(d, 1) for d, _ in awkward_texts()], "doc_id long, quality int")
    assert {r.score for r in quality(docs, one).collect()} == {1.0}
    assert quality(empty(spark), one).count() == 0


URLS = [
    "http://Example.ORG/es/1",
    "https://www.example.org/en/17?x=1",
    "https://www.example.org/en/27#top",
    "ftp://a.org",
    "http://org/x",
    "http://myorg/x",
    "http://x.COM/fr/1?a=b&c=d",
    "http://x.com/de/",
    "http://x.com/DE/",
    "http://x.net/fr/",
    "no scheme.org/",
    "",
    None,
    "://",
    "http://user@x.org:80/a://b",
    "http://x.com?/fr/",
    "http://ünï.com/fr/ü",
    "http://x.net/" + "a" * 50_000,
]


def test_urls(spark):
    rows = [(k, u, "x", 1) for k, u in enumerate(URLS * 3)] + [(None, "http://y.net/", "x", 1)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host string, given int")).collect()
    assert len(got) == len(rows)
    for row in got:
        url = "http://y.net/" if row.page_id is None else URLS[row.page_id % len(URLS)]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = rest
            for c in "/?#":
                host = host.split(c)[0]
            path = rest[len(host) :].split("?")[0].split("#")[0]
            host = host.translate({k: k + 32 for k in range(65, 91)})
        fits = [
            (len(rule), rule, kind)
            for kind, rule in RULES
            if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])
        ]
        want = max(fits, default=(0, None, None))
        assert (row.host, row.path, row.rule) == (host, path, want[1])
        assert row.verdict == want[2] if want[1] else row.verdict in ("allow", "block")


def test_urls_without_both_labels(spark):
    schema = "page_id long, url string"
    assert judge(spark.createDataFrame([], schema)).count() == 0
    assert {r.verdict for r in judge(spark.createDataFrame([(1, "http://a.net/")], schema)).collect()} == {"allow"}
    assert {r.verdict for r in judge(spark.createDataFrame([(1, "http://a.net/"), (2, "http://a.com/de/")], schema)).collect()} == {"block"}


def test_chat_against_sql(spark):
    got = QUERIES["op8_chat"](spark, SF).toPandas()
    assert compare(got, database(SF).execute(ORACLES["op8_chat"]).df()) is None


SAID = ["</s>[INST] ok [/INST]", "", None, "[\\INST] <\\\\s> <s", "[ROLE]x[/ROLE]", "<s>", " blank ", "[/INST]", "é\n[INST]", prose(3, 5000)]


def test_chat_reads_back_awkward_turns(spark):
    roles = ["user", "assistant", "system", None, "assistant", "[/ROLE]"]
    rows = [(c, t, roles[(c + t) % 6], SAID[(7 * c + t) % 10], "x") for c in range(8) for t in range(c * 3)]
    rows += [(50, 0, "user", "a", "x"), (50, 0, "user", "a", "x"), (50, None, "assistant", "b", "x"), (None, 1, "assistant", "c", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    pieces = formatted(turns)
    got = {r.conv_id: r for r in read_back(pieces).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted(((t is not None, t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        loss = "".join(x for *_, r, x in mine if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    written = {(e.conv_id, e.place): e for e in example_texts(pieces).collect()}
    assert len(written) == sum(r[2] == "assistant" for r in rows)
    assert all(e.text.startswith("<s>") and e.text[e.loss_end :] == "</s>" for e in written.values())
    spans = examples(pieces).collect()
    assert len(spans) == len(written)
    for e in spans:
        whole = written[e.conv_id, e.place]
        assert (e.loss_start, e.loss_end) == (whole.loss_start, whole.loss_end) == (e.context_chars, e.context_chars + len(e.target) - 4)
        assert whole.text[e.context_chars :] == e.target
    longest = max((e for e in spans if e.conv_id == 7), key=lambda e: e.place)
    before = sorted((p for p in pieces.collect() if p.conv_id == 7 and p.place < longest.place), key=lambda p: p.place)
    assert written[7, longest.place].text == "".join(p.piece for p in before) + " " + longest.target
    assert read_back(formatted(turns.limit(0))).count() == 0
