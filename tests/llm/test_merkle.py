"""Manifest and proofs against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from heliospark.llm.merkle import ManifestOptions, audit, folded, proofs

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(leaves: list[str]) -> tuple[str, list[list[tuple[list, list]]]]:
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for k, way in enumerate(ways):
            run, place = runs[at[k] // 8], at[k] % 8
            way.append((run[:place], run[place + 1 :]))
            at[k] //= 8
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], ways


def plain(rows):
    found = {}
    for d, s, lang, n, t in rows:
        own = other = leaf((d, s, lang, n, t))
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            other = leaf((d, s, lang, n, t.translate(brute.ASCII_LOWER)))
        found.setdefault(lang, []).append((d, own, other))
    langs = sorted(found, key=lambda x: (x is not None, (x or "").encode()))
    ranked = [sorted(found[x], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for x in langs]
    trees = [climbed([r[1] for r in mine]) for mine in ranked]
    root, upper = climbed([t[0] for t in trees])
    out = []
    for mine, (subroot, ways), above in zip(ranked, trees, upper):
        for (d, own, other), way in zip(mine, ways):
            now, beside = other, ""
            for before, after in way + above:
                beside += "".join(before + after)
                now = h("".join([*before, now, *after]))
            out.append((d, own, subroot, root, h(beside), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["awkward", "sf0.001", "one", "many langs"])
def test_audit_equals_the_plain_tree(spark, name):
    if name == "awkward":
        docs = brute.awkward(spark)
    elif name == "one":
        docs = brute.awkward(spark).where("doc_id = 5")
    elif name == "many langs":
        docs = brute.awkward(spark).withColumn("lang", F.concat(F.lit("l"), F.col("uid") % 70))
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    assert brute.rows_of(audit(docs)) == plain(rows)


def test_no_rows(spark):
    assert audit(brute.empty(spark)).collect() == []


def test_proofs_of_own_columns(spark):
    rows = spark.range(600).select("id", (F.col("id") % 2).alias("half"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = proofs(rows, ManifestOptions(group="half", order="id"))
    assert out.columns == ["id", "half", "leaf", "subroot", "root", "proof"]
    assert out.where(folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 600
    assert out.where(folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")).count() == 0
    assert [len(r.proof) for r in out.collect()] == [4] * 600  # 300 -> 38 -> 5 -> 1, then two halves
