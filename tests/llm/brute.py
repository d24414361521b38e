"""Plain versions of the text operators, and tables with the awkward rows that all of them have to stand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, uid long, key string, slice long, "
    "range long, kind int, mark long, digest binary, start long, rank int, lang_pred string, _kept string"
)
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    stock = ["".join(random.Random(k).choices("abcdefghiéßñ", k=2 + k % 9)) for k in range(words)]
    return " ".join(rng.choice(stock).capitalize() if rng.random() < 0.1 else rng.choice(stock) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    shared = prose(1, 120)
    near = prose(2, 200)
    rows = [(k, prose(100 + k, 5 + 17 * k % 160)) for k in range(40)]
    rows += [(100 + k, shared) for k in range(25)]  # a third of the rows are copies
    rows += [(200 + k, f"{prose(300 + k, 30)} {shared} {prose(400 + k, 30)}") for k in range(6)]
    rows += [(300 + k, near.replace(" ", "  ", k) + f" end{k}") for k in range(4)]
    rows += [
        (400, None),
        (401, ""),
        (402, " \n\t "),
        (403, "A."),
        (404, "12345 --- !!! 67"),
        (405, "<|endoftext|> a<|ENDOFTEXT|>b </s>[INST] ok [/INST]"),
        (406, "日本語のテキスト です。 漢字 カタカナ"),
        (407, "a" * 3000),
        (408, "\x00\x1f control\x85next\u2028line\u00a0blank \U0001f600 emoji e\u0301 ÀÉ İ ẞ"),
        (409, prose(9, 40_000, 3000)),
        (410, f"{shared[:700]}{shared[:700]}"),
        (None, "No id here, only words of a text without any id."),
        (None, None),
        (411, "twice the same row " * 3),
        (411, "twice the same row " * 3),
        (412, "one"),
        (413, "one two"),
        (414, "one two three four five six seven"),
    ]
    return rows


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns with likely names."""
    rows = []
    for k, (doc_id, text) in enumerate(awkward_texts()):
        lang = None if k % 11 == 0 else ("xx" if k % 2 else "yy")
        rows.append((doc_id, text, lang, None if k % 5 == 0 else "s", None if text is None else len(text), None if k % 3 else 0.5, k, "k", k, k, k, k, b"x", k, k, "zz", "t"))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fold(doc_id, by: int):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SOLID = re.compile("[^\x20\x09-\x0d]+")


def contamination(docs, items, span: int = 13):
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = WORDS.findall((text or "").translate(ASCII_LOWER))
        for k in range(max(1, len(words) - span + 1) if words else 0):
            windows.setdefault(tuple(words[k : k + span]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        words = WORDS.findall((text or "").translate(ASCII_LOWER))
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if items_hit := windows.get(tuple(words[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= items_hit
        n_hit = sum(hit)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), n_hit, len(found), sha, n_hit > 0 and 20 * n_hit >= len(words)))
    return sorted(out, key=repr)


def repeats(docs, length: int = 400):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for doc_id, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def simhash(text: str | None, n: int = 4) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(docs, distance: int = 4):
    marks = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= distance:
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted(((d, f"{m:016x}", least.get(root(k))) for k, ((d, _), m) in enumerate(zip(docs, marks))), key=repr)


TOKEN = re.compile("[A-Za-z0-9À-ɏ]+|[^ \t\n\x0b\f\rA-Za-z0-9À-ɏ]")


def _xxh(parts: list[bytes]) -> int:
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed)
    return seed


def order_minhash(text: str, k: int = 3) -> dict[int, int]:
    wrap, low = (1 << 64) - 1, (1 << 28) - 1
    words = TOKEN.findall(text)
    if len(words) >= k:
        grams = [(_xxh([w.encode() for w in words[i : i + k]]) << 28) & wrap | i for i in range(len(words) - k + 1)]
    else:
        grams = [(_xxh([" ".join(words).encode()]) << 28) & wrap] if words else []
    number: Counter = Counter()
    ranked = []
    for x in sorted(grams):
        ranked.append((_xxh([struct.pack("<q", x >> 28), struct.pack("<i", number[x >> 28])]) << 28) & wrap | x & low)
        number[x >> 28] += 1
    bins: dict[int, list] = {}
    for x in sorted(ranked, key=lambda x: x ^ (1 << 63)):
        bins.setdefault(x >> 58, []).append(x)
    out = {}
    order = list(bins)
    for j, b in enumerate(order):
        two = (bins[b] + bins[order[(j + 1) % len(order)]])[: min(2, len(ranked))]
        h = _xxh([struct.pack("<q", x >> 28) for x in sorted(two, key=lambda x: x & low)])
        out[b] = (h - (1 << 64) if h >> 63 else h) % 65536
    return out


def likeness(a: dict, b: dict) -> float:
    either = a.keys() | b.keys()
    return math.sqrt(sum(a.get(k) == b.get(k) for k in either) / len(either)) if either else 1.0


def spelled(entries: dict) -> str:
    return "".join(f"{k * 65536 + v:06x}" for k, v in sorted(entries.items(), key=lambda x: x[0] ^ 32))


def base_scores(docs):
    tokens = [(d, SOLID.findall((t or "").translate(ASCII_LOWER)) + [None]) for d, t in docs]
    counts: Counter = Counter()
    for doc_id, words in tokens:
        if fold(doc_id, 5) != 1:
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    rows = [
        (d, fold(d, 5) == 1, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        for d, w in tokens
    ]
    return sorted(rows, key=repr)
