"""Order MinHash fingerprints, in DataFrame expressions only.

A text's k-mers are ``k`` neighbouring tokens (a run of Latin letters and digits, or any other single character that is no
white space). Each k-mer is numbered by its occurrence, so repetitions count. The hash of k-mer and number puts it into
one of 64 bins, and of every bin the two k-mers with the smallest hashes are taken, in the order in which they stand in
the text; a bin with one k-mer takes the next bin's smallest as its second, the last bin the first one's. The hash of that
tuple is the bin's entry: moving, inserting or deleting text changes entries as edits do, which a plain set of k-mers does
not see. A bin without k-mers has no entry; a text with one k-mer has that alone.

Likeness is the square root (two k-mers a tuple) of the share of equal entries among the bins that either has; 1 for two
texts without tokens. Equal texts have equal fingerprints.

Null text is the empty text, a text below k tokens has them all as its one k-mer. doc_id is a whole number; null is an id and
sorts first. Every row is a document: rows that share an id follow each other by the SHA-256 of their texts, and of equal
rows each is followed by its copy, the last by what comes after. Equal rows are worked out once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.frames import materialise

K = 3
#: A k-mer's hash is kept above the bits of its position.
PLACE_BITS = 28
BIN_SHIFT = 58
TOKEN = "[A-Za-z0-9\\u00C0-\\u024F]+|[^\\\\sA-Za-z0-9\\u00C0-\\u024F]"
NULL_ID = -(1 << 63)


def _packed(hash_: str, place: str) -> str:
    return f"shiftleft({hash_}, {PLACE_BITS}) | cast({place} as bigint)"


def _hash(x: str) -> str:
    return f"shiftrightunsigned({x}, {PLACE_BITS})"


def _place(x: str) -> str:
    return f"({x} & {(1 << PLACE_BITS) - 1}L)"


def _bin(x: str) -> str:
    return f"shiftrightunsigned({x}, {BIN_SHIFT})"


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the bins' entries, bin and 16 bits of hash each, in the order of the bins."""
    grams = ", ".join(["x"] + [f"get(_tokens, i + {j})" for j in range(1, K)])
    first = lambda array, of: f"filter(sequence(0, size({array}) - 1), i -> i = 0 or {of(f'get({array}, i)')} <> {of(f'get({array}, i - 1)')})"
    empty = "cast(array() as array<bigint>)"
    second = "get(_ranked, (i + 1) % size(_ranked))"
    entry = f"""case when size(_ranked) = 1 then xxhash64({_hash('get(_ranked, i)')})
        when {_place('get(_ranked, i)')} < {_place(second)} then xxhash64({_hash('get(_ranked, i)')}, {_hash(second)})
        else xxhash64({_hash(second)}, {_hash('get(_ranked, i)')}) end"""
    return (
        rows.withColumn("_tokens", F.expr(f"regexp_extract_all({text}, '{TOKEN}', 0)"))
        .withColumn(
            "_kmers",
            F.expr(
                f"""sort_array(case
                when size(_tokens) >= {K} then transform(slice(_tokens, 1, greatest(size(_tokens) - {K - 1}, 0)), (x, i) -> {_packed(f'xxhash64({grams})', 'i')})
                when size(_tokens) > 0 then array({_packed("xxhash64(array_join(_tokens, ' '))", '0')})
                else {empty} end)"""
            ),
        )
        .withColumn("_runs", F.expr(f"case when size(_kmers) > 0 then {first('_kmers', _hash)} else cast(array() as array<int>) end"))
        .withColumn(
            "_ranked",
            F.expr(
                f"""sort_array(case when size(_runs) = size(_kmers)
                then transform(_kmers, x -> {_packed(f"xxhash64({_hash('x')}, 0)", _place('x'))})
                else flatten(transform(_runs, (r, j) -> transform(
                    slice(_kmers, r + 1, coalesce(get(_runs, j + 1), size(_kmers)) - r),
                    (x, n) -> {_packed(f"xxhash64({_hash('x')}, n)", _place('x'))}))) end)"""
            ),
        )
        .withColumn("_bins", F.expr(f"case when size(_ranked) > 0 then {first('_ranked', _bin)} else cast(array() as array<int>) end"))
        .withColumn(out, F.expr(f"transform(_bins, i -> cast({_bin('get(_ranked, i)')} * 65536 + pmod({entry}, 65536) as int))"))
        .drop("_tokens", "_kmers", "_runs", "_ranked", "_bins")
    )


def likeness(a: Column, b: Column) -> Column:
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, 16))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.sqrt(F.size(F.array_intersect(a, b)) / either))


def spelled(entries: Column) -> Column:
    return F.lower(F.array_join(F.transform(entries, lambda e: F.lpad(F.hex(e), 6, "0")), ""))


def _different(docs: DataFrame) -> DataFrame:
    """The different rows: key, seal and text, and how many copies each has."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), text.alias("text"))
    rows = rows.withColumn("seal", F.sha2(F.encode("text", "UTF-8"), 256))
    return rows.groupBy("key", "seal").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def following(rows: DataFrame) -> DataFrame:
    """Adds ``next``: key and seal of the row that follows in ascending order, the first after the last.

    Rows are put into ranges; inside a range the window's neighbour follows, the last row of a range is followed by the
    first of the next range. There are as many ranges as shuffle partitions, and only their first rows come together.
    """
    ranged = materialise(rows.repartitionByRange("key", "seal").withColumn("_range", F.spark_partition_id()), "ranges")
    this = F.struct("key", "seal")
    inside = ranged.withColumn("next", F.lead(this).over(Window.partitionBy("_range").orderBy("key", "seal")))
    starts = ranged.groupBy("_range").agg(F.min(this).alias("_first"))
    order = Window.orderBy("_range")
    ends = starts.select("_range", F.lead("_first").over(order).alias("_after"), F.min("_first").over(Window.partitionBy()).alias("_least"))
    return inside.join(F.broadcast(ends), "_range").withColumn("next", F.coalesce("next", "_after", "_least")).drop("_range", "_after", "_least")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter of the code points replaced by the first as many of the next document.
    """
    texts = _different(docs)
    own = with_fingerprint(texts.withColumn("n_chars", F.char_length("text").cast("long")), "text", "entries")
    own = materialise(own.select("key", "seal", "copies", "n_chars", "entries"), "fingerprints")
    places = following(own.select("key", "seal", "copies", F.expr("n_chars div 4").alias("cut")))
    copied = F.struct(F.struct("key", "seal").alias("next"), (F.col("copies") - 1).alias("times"))
    last = F.struct("next", F.lit(1).cast("long").alias("times"))
    places = places.select("key", "seal", "cut", F.explode(F.array(copied, last)).alias("to")).where("to.times > 0")
    places = materialise(places.select("key", "seal", "cut", "to.*"), "following")
    heads = (
        texts.join(
            places.select(F.struct("key", "seal").alias("for"), F.col("next.key").alias("key"), F.col("next.seal").alias("seal"), "cut", "times"),
            ["key", "seal"],
        )
        .join(own.select("key", "seal", F.col("entries").alias("next_entries")), ["key", "seal"])
        .select("for.*", "times", F.expr("substring(text, 1, cast(cut as int))").alias("head"), "next_entries")
    )
    rows = texts.drop("copies").join(own, ["key", "seal"]).join(heads, ["key", "seal"])
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), head)"))
    rows = with_fingerprint(rows.drop("text", "head"), "edited", "edited_entries")
    shown = rows.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        spelled(F.col("entries")).alias("fingerprint"),
        spelled(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
        "times",
    )
    return shown.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_copy")
