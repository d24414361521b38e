"""Alignment of two tokenizers against plain code, and both ways to the first one's ids."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heliospark.llm.align import AlignOptions, align, alignments, gallop, packed, pair_of, unpacked

OPTIONS = AlignOptions(*map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")))
PLAIN = AlignOptions(OPTIONS.a, OPTIONS.b)


def plain(docs):
    a = Tokenizer.from_file(OPTIONS.a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=OPTIONS.b)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in shown]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(rest)}
    rows, counts = [], Counter()
    for doc_id, text in docs:
        one = a.encode(" " + text, add_special_tokens=False).ids if text else []
        two = b.encode(text) if text else []
        sizes_a = [len(a.id_to_token(i)) for i in one]
        pieces = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in two]
        whole = (" " + text).encode() if text else b""
        if bytes(byte[c] for i in one for c in a.id_to_token(i)) != whole or b"".join(pieces) != whole:
            one, two, sizes_a, pieces = [], [], [], []
        ends_a, ends_b = np.cumsum(sizes_a).tolist(), np.cumsum([len(x) for x in pieces]).tolist()
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((one[x:i], two[y:j]))
            x, y = i, j
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        counts.update(links.keys())
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((doc_id, one, two, groups, links, said))
    best: dict[int, int] = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for doc_id, one, two, groups, links, said in rows:
        n_best = sum(n for pair, n in links.items() if counts[pair] == best[pair[0]])
        total = sum(n * counts[pair] for pair, n in links.items())
        sha = hashlib.sha256(said.encode()).hexdigest() if said else ""
        out.append((doc_id, len(one), len(two), len(groups), sum(links.values()), n_best, total, sha))
    return sorted(out, key=repr), {d: (o, t, [len(g) for g, _ in gs], [len(h) for _, h in gs]) for d, o, t, gs, _, _ in rows}


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MORE = [(500, "\u2581 piece mark"), (501, " " * 3000 + "x"), (502, "1234567890" * 40), (503, "=" * 700 + "ab" * 300), (504, "l\r\n\n don't we'll")]


@pytest.mark.parametrize("name", ["awkward", "sf0.001"])
def test_align_equals_plain_code(spark, monkeypatch, name):
    if name == "awkward":
        docs = brute.awkward(spark).where("length(text) < 5000 or text is null")
        docs = docs.select("doc_id", "text", "slice", "range", "key").union(spark.createDataFrame([(*r, 0, 0, "") for r in MORE], "doc_id long, text string, a int, b int, c string"))
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 5000 or text is null").repartition(3)
        for constant, value in (("SLICE", 20_000), ("RANGE", 30_000), ("SPLIT", 2)):  # several slices, ranges and splits
            monkeypatch.setattr(f"heliospark.llm.align.{constant}", value)
    got = align(docs, OPTIONS)
    assert got.columns == ["doc_id", *COLUMNS[1:5], "n_best", "count_sum", "groups_sha256"]
    rows, ids = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert brute.rows_of(got.select(*COLUMNS)) == rows
    for r in alignments(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), OPTIONS).collect():
        assert (r.a_ids, r.b_ids, r.a_sizes, r.b_sizes) == ids[r.doc_id]


def test_no_rows(spark):
    assert align(brute.empty(spark), OPTIONS).collect() == []


def test_gallop_finds_what_both_have():
    rng = random.Random(5)
    for _ in range(200):
        lists, at = ([], []), ([], [])
        for _ in range(rng.randrange(1, 6)):
            base = max([0, *(x[-1] for x in lists if x)])
            for x, a in zip(lists, at):
                first = len(x)
                x += sorted(rng.sample(range(base + 1, base + 400), rng.choice((0, 1, 30, 33, 200))))
                a.append((first, len(x)))
        short, long = (np.array(x, np.int64) for x in lists)
        one, two = gallop(short, long, np.array(at[0]).T, np.array(at[1]).T)
        expected = [(i, long_at + (lists[1][long_at:long_end].index(v))) for (i0, i1), (long_at, long_end) in zip(*at) for i, v in enumerate(lists[0][i0:i1], i0) if v in lists[1][long_at:long_end]]
        assert list(zip(one.tolist(), two.tolist())) == expected


def test_both_ways_to_the_ids_agree():
    fast, plain_ = pair_of(OPTIONS).a, pair_of(PLAIN).a
    rng = random.Random(7)
    signs = " \n\t'\"aAbs1.9éß日\u2581\U0001f600\u00a0\u3000\r\x00tdlvreLL"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += [" " * 100_000, "a" * 5000, "<|endoftext|>", "\n" * 499 + "x"]
    assert fast(texts) == plain_(texts)


def test_packed_numbers_come_back():
    for values in ([], [0], [255, 256, 3], [1 << 40, 0, 7]):
        assert unpacked(packed(np.array(values, np.int64))).tolist() == values
