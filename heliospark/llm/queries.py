"""The registered queries of these operators and, where SQL states them, their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliospark.llm.frames import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return add


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.pack import PackOptions, pack

    return pack(table(spark, sf_dir, "documents"), PackOptions(public_tokenizer()))


@query()
def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.winnow import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.repeats import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query()
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


@query(r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces AS (
    SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>)', '\1\2\\\3', 'g'))
              + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
                     ELSE 17 + length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?ROLE\]|/?s>)', '\1\2\\\3', 'g')) END AS size
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(size) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id""")
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.chat import formatted, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    control = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return read_back(formatted(turns.unionByName(control)))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.bloom_lm import score

    return score(table(spark, sf_dir, "documents"))


@query()
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.order_minhash import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


@query(r"""
WITH RECURSIVE
docs AS (
    SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
    FROM (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(
              string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
              lambda a, v: xor(xor(a, v) // 2, (xor(a, v) % 2) * 3988292384))) AS crc FROM documents)),
shown AS (
    SELECT doc_id, lang, text, other,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
    FROM docs),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS altered FROM shown)),
tree AS (
    SELECT lang, 0 AS level, pos AS idx, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, min(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) WHERE n > 1 GROUP BY lang, idx // 8),
subroots AS (
    SELECT lang, digest AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
    FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS top FROM tree) WHERE level = top),
upper AS (
    SELECT 0 AS level, place AS idx, subroot AS digest FROM subroots
    UNION ALL
    SELECT min(level) + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY idx // 8),
steps AS (
    SELECT a.lang, a.level, a.idx,
           coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
           coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
    FROM tree a JOIN tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.idx // 8 = b.idx // 8
    GROUP BY ALL),
upper_steps AS (
    SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
           coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
    FROM upper a JOIN upper b ON a.level = b.level AND a.idx // 8 = b.idx // 8 GROUP BY ALL),
climb AS (
    SELECT lang, pos, 0 AS level, pos AS idx, altered AS now, '' AS proof FROM leaves
    UNION ALL
    SELECT c.lang, c.pos, c.level + 1, c.idx // 8, sha256(s.before || c.now || s.after), c.proof || s.before || s.after
    FROM climb c JOIN steps s ON c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND c.idx = s.idx
    JOIN subroots t ON c.lang IS NOT DISTINCT FROM t.lang WHERE c.level < t.depth),
climb_on AS (
    SELECT c.lang, pos, 0 AS level, place AS idx, now, proof
    FROM climb c JOIN subroots t ON c.lang IS NOT DISTINCT FROM t.lang AND c.level = t.depth
    UNION ALL
    SELECT c.lang, c.pos, c.level + 1, c.idx // 8, sha256(s.before || c.now || s.after), c.proof || s.before || s.after
    FROM climb_on c JOIN upper_steps s ON c.level = s.level AND c.idx = s.idx WHERE c.level < (SELECT max(level) FROM upper))
SELECT l.doc_id, l.leaf, t.subroot, u.digest AS root, sha256(c.proof) AS proof_sha256, c.now AS folded_root, c.now = u.digest AS verified
FROM leaves l JOIN subroots t ON l.lang IS NOT DISTINCT FROM t.lang
JOIN climb_on c ON l.lang IS NOT DISTINCT FROM c.lang AND l.pos = c.pos
JOIN (SELECT * FROM upper WHERE level = (SELECT max(level) FROM upper)) u ON c.level = u.level""")
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.merkle import audit

    return audit(table(spark, sf_dir, "documents"))


@query()
def op13_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.template import extract

    return extract(table(spark, sf_dir, "pages"))


@query()
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heliospark.llm.align import AlignOptions, align

    names = ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")
    return align(table(spark, sf_dir, "documents"), AlignOptions(*map(public_tokenizer, names)))
