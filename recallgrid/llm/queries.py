"""Queries over the driver's tables, one per operator of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, chat, curves, divergence, langid, layout, mixing, ngram_join, packing, semantic_dedup, toxicity, url_trust, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_weight")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.compare_edited(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    messages = said.unionByName(more).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digest(chat.format_chats(messages))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out_flag(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.document_layout(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic_dedup.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_pack, op2_url_filter, op3_mix, op4_fingerprint, op5_ngram_join, op6_chat, op7_warc, op8_toxicity, op9_neighbours, op10_language, op11_layout, op12_divergence, op13_semantic_dedup)}

# SQL, for DuckDB

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: The driver's pages hold no links between hosts, so trust and distrust are the shares of a host's pages that rules allow and block.
S_URL = rf"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in url_trust.RULES)}) t(verdict, rule, own, start)),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {UPPER_LOWER}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT page_id, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM p JOIN rules ON (host = own OR suffix(host, '.' || own)) AND starts_with(path, start) GROUP BY page_id),
j AS (SELECT p.*, r.rule, r.verdict FROM p LEFT JOIN r USING (page_id)),
h AS (SELECT host, (count_if(verdict = 'block') - count_if(verdict = 'allow')) / count(*) AS lead FROM j WHERE host <> '' GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN lead >= {url_trust.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN h ON j.host = h.host"""

S_NGRAM = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS both_n, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * shared >= 75 * (both_n - shared)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.least, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) m ON s.doc_id = m.a"""


def _s_escape(c: str) -> str:
    return rf"regexp_replace(replace({c}, '\', '\\'), '([<\[])({chat.CONTROL_TAILS})', '\1\\\2', 'g')"


S_CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
sum({len(chat.TURN + chat.TEXT + chat.END)} + len({_s_escape("role")}) + len({_s_escape("text")}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d"""

S_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS holder FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND page_id <> holder THEN holder END AS refers_to FROM h)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

#: The nearest of all rows; where a window holds all rows, as at this size, that is what is found.
S_NEAREST = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), ok AS (SELECT * FROM e WHERE len(v) = len(list_filter(v, lambda x: isfinite(x))) AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM ok q JOIN ok c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

#: CRC-32 of a number's decimal digits, bit by bit: a byte comes in by xor, then eight shifts (-1).
S_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
_S_KEYS = ("source", "lang", "length", "date")
_S_Z = " + ".join(f"(({k}_c // {1 << (layout.BITS - 1 - b)}) % 2) * {1 << (4 * layout.BITS - 1 - 4 * b - i)}" for b in range(layout.BITS) for i, k in enumerate(_S_KEYS))
_S_MEET = lambda lo, hi: " AND ".join(f"{lo.format(k)} <= c.{k}_c + {r} AND {hi.format(k)} >= c.{k}_c - {r}" for k, r in zip(_S_KEYS, (0, 0, 1, 1)))

S_LAYOUT = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length, {S_CRC} % 365 AS date FROM documents),
k AS (SELECT doc_id, {", ".join(f"8 * (rank() OVER (ORDER BY {k} NULLS FIRST) - 1) // count(*) OVER () AS {k}_c" for k in _S_KEYS)} FROM d),
z AS (SELECT *, {_S_Z} AS z FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z),
f AS (SELECT *, position // {layout.FILE_ROWS} AS file FROM p),
b AS (SELECT file, {", ".join(f"min({k}_c) AS {k}_lo, max({k}_c) AS {k}_hi" for k in _S_KEYS)} FROM f GROUP BY file),
c AS (SELECT DISTINCT z, {", ".join(f"{k}_c" for k in _S_KEYS)} FROM f),
t AS (SELECT c.z, count(*) AS files_touched FROM c JOIN b ON {_S_MEET("b.{}_lo", "b.{}_hi")} GROUP BY c.z),
m AS (SELECT c.z, count(DISTINCT o.file) AS files_matching FROM c JOIN (SELECT DISTINCT file, {", ".join(f"{k}_c" for k in _S_KEYS)} FROM f) o ON {_S_MEET("o.{}_c", "o.{}_c")} GROUP BY c.z)
SELECT doc_id, f.z::BIGINT AS z, position, file, files_touched, files_matching, concat_ws(',', {", ".join(f"{k}_lo, {k}_hi" for k in _S_KEYS)}) AS file_bounds FROM f JOIN b USING (file) JOIN t ON f.z = t.z JOIN m ON f.z = m.z"""

S_DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cnt AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL) s USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, (1 + ({divergence.UNIT}::HUGEINT * (coalesce(c.c, 0) + {divergence.SMOOTH})) // (g.n + {divergence.SMOOTH} * l.v))::BIGINT AS p, (1 + ({divergence.UNIT}::HUGEINT * (k.c + {divergence.SMOOTH})) // (l.n + {divergence.SMOOTH} * l.v))::BIGINT AS q
FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {divergence.TERMS}"""

S_DEDUP = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), ok AS MATERIALIZED (SELECT * FROM e WHERE v IS NOT NULL AND len(v) = len(list_filter(v, lambda x: isfinite(x))) AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON len(x.v) = len(y.v) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {semantic_dedup.COSINE}),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = vec_id"""

ORACLES: dict[str, str] = {"op2_url_filter": S_URL, "op5_ngram_join": S_NGRAM, "op6_chat": S_CHAT, "op7_warc": S_WARC, "op9_neighbours": S_NEAREST, "op11_layout": S_LAYOUT, "op12_divergence": S_DIVERGENCE, "op13_semantic_dedup": S_DEDUP}
