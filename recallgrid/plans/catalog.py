"""The query catalogue: each operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import text as T
from ..operators import evaluate, extract, index, merge, package, prompt, redact, retrieve
from ..shared import new_path
from ..sources.exports import export_messages, export_texts
from ..sources.vectors import VectorTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def tab(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# SQL fragments


def lit(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def s_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def s_tokens(c: str) -> str:
    cut = r"list_filter(list_transform(regexp_extract_all(lower(" + c + r"), '[a-z0-9][a-z0-9+#._\-]*'), lambda x: trim(x, '._-')), lambda x: len(x) >= 2 and not list_contains(" + lit(C.STOPWORDS) + ", x))"
    return (
        f"list_transform({cut}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN x WHEN len(x) > 5 AND suffix(x, 'ies') THEN left(x, len(x) - 3) || 'y' WHEN len(x) > 6 AND suffix(x, 'ing') THEN left(x, len(x) - 3) "
        "WHEN len(x) > 5 AND suffix(x, 'ed') THEN left(x, len(x) - 2) WHEN len(x) > 3 AND suffix(x, 's') AND NOT regexp_matches(x, '(ss|us|is)$') THEN left(x, len(x) - 1) ELSE x END)"
    )


def s_estimate(c: str) -> str:
    s = s_strip(c)
    return rf"CASE WHEN {s} = '' THEN 0 ELSE greatest(1, ceil((len({s}) / 4.0::DOUBLE + len(regexp_extract_all({s}, '\S+')) * 1.3::DOUBLE) / 2.0::DOUBLE)) END::BIGINT"


def s_norm(c: str) -> str:
    return "lower(" + s_strip(rf"regexp_replace({c}, '\s+', ' ', 'g')") + ")"


def s_id(category: str, content: str) -> str:
    return f"substr(sha1({category} || chr(31) || {s_norm(content)}), 1, 12)"


def s_sentences(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: {s_strip('x')}), lambda x: len(x) > 10)"


# A memory of items made from the table part: 7 packages, 6 categories.
S_ITEMS = (
    f"items AS (SELECT 'pkg_' || (p_partkey % 7) AS package, {lit(C.CATEGORIES)}[1 + (p_partkey % 6)] AS category, p_partkey::BIGINT AS pos, 'Use ' || p_name || ' for lot ' || (p_partkey % 50) AS content, "
    f"0.5 + (p_partkey % 5) / 10.0::DOUBLE AS confidence, 'rule:' || (p_partkey % 4) AS source, 'chat_' || (p_partkey % 3) AS origin FROM part)"
)


def items(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return tab(spark, sf, "part").select(
        F.concat(F.lit("pkg_"), k % 7).alias("package"), F.get(F.array(*[F.lit(c) for c in C.CATEGORIES]), (k % 6).cast("int")).alias("category"), k.cast("long").alias("pos"),
        F.concat(F.lit("Use "), "p_name", F.lit(" for lot "), (k % 50).cast("string")).alias("content"), (F.lit(0.5) + (k % 5) / F.lit(10.0)).alias("confidence"),
        F.concat(F.lit("rule:"), (k % 4).cast("string")).alias("source"), F.concat(F.lit("chat_"), (k % 3).cast("string")).alias("origin"),
    ).withColumn("id", T.item_id(F.col("category"), F.col("content")))


# Retrieval

S_DOCUMENTS_ASKED = f"""
d AS (SELECT doc_id AS item_id, {s_tokens("coalesce(text, '')")} AS t FROM documents),
q AS (SELECT item_id AS query_id, {s_tokens("coalesce(text, '')")} AS t FROM benchmark)"""
S_SCORED = """
st AS (SELECT count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM d),
qt AS (SELECT query_id, term, min(list_position(t, term)) AS qpos FROM (SELECT query_id, t, unnest(t) AS term FROM q) GROUP BY query_id, term),
tf AS (SELECT item_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT query_id, qt.term, qpos, avgdl, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN df ON qt.term = df.term CROSS JOIN st),
ce AS (SELECT query_id, sum(idf * 2.5) AS ceiling FROM w GROUP BY query_id),
hit AS (SELECT query_id, item_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS raw, string_agg(w.term, ' ' ORDER BY qpos) AS matched FROM tf JOIN w ON tf.term = w.term GROUP BY query_id, item_id),
lex AS (SELECT query_id, item_id, least(1.0, raw / ceiling) AS lexical, round(least(1.0, raw / ceiling), 4) AS score, matched FROM hit JOIN ce USING (query_id))"""
S_BM25 = f"""{S_DOCUMENTS_ASKED}, {S_SCORED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM lex)"""


def bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    found = index.search(tab(spark, sf, "documents"), tab(spark, sf, "benchmark"), k, "doc_id", "text", "item_id", "text")
    return found.select("query_id", "item_id", "score", F.array_join("matched", " ").alias("matched"), "rank")


@query(f"WITH {S_BM25} SELECT query_id, item_id, score, matched, rank FROM ranked WHERE rank <= 5")
def retrieve_bm25_topk(spark, sf):
    return bm25(spark, sf, 5)


@query(f"WITH {S_BM25} SELECT query_id, count(*) AS n, count_if(score >= 0.3) AS kept, count_if(score < 0.3) AS below FROM lex GROUP BY query_id")
def retrieve_min_score(spark, sf):
    return index.score_counts(tab(spark, sf, "documents"), tab(spark, sf, "benchmark"), 0.3, "doc_id", "text", "item_id", "text")


@query(f"WITH {S_BM25} SELECT query_id, item_id, score, rank FROM ranked WHERE rank <= 5")
def retrieve_kept_index(spark, sf):
    """Two thirds of the documents make an index that is kept, the rest is appended; all benchmark passages are searched for in it."""
    d, path = tab(spark, sf, "documents"), new_path(spark, "kept-index")
    index.append(spark, path, d.filter("doc_id % 3 <> 0"), "doc_id", "text")
    index.append(spark, path, d.filter("doc_id % 3 = 0"), "doc_id", "text")
    return index.top_k(index.opened(spark, path), tab(spark, sf, "benchmark"), 5, "item_id", "text").select("query_id", "item_id", "score", "rank")


@query(f"WITH {S_BM25} SELECT query_id, item_id, 'Matched ' || array_to_string(list_transform(string_split(matched, ' ')[1:6], lambda x: '''' || x || ''''), ', ') || ' (lexical ' || printf('%.2f', score) || ')' AS reason FROM ranked WHERE rank <= 3")
def retrieve_reason(spark, sf):
    top = bm25(spark, sf, 3)
    return top.select("query_id", "item_id", T.reason(F.split("matched", " "), F.col("score")).alias("reason"))


S_FOLD = "list_reduce(l, lambda a, x: CASE WHEN a.n >= 5 THEN a WHEN a.used + x.used > 400 THEN {'used': a.used, 'n': a.n, 'dropped': a.dropped + 1} ELSE {'used': a.used + x.used, 'n': a.n + 1, 'dropped': a.dropped} END, {'used': 0::BIGINT, 'n': 0::BIGINT, 'dropped': 0::BIGINT})"


@query(
    f"WITH {S_BM25}, tok AS (SELECT doc_id AS item_id, {s_estimate('text')} AS tokens FROM documents), l AS (SELECT query_id, list({{'used': tokens, 'n': 0::BIGINT, 'dropped': 0::BIGINT}} ORDER BY rank) AS l FROM ranked JOIN tok USING (item_id) GROUP BY query_id), "
    f"f AS (SELECT query_id, {S_FOLD} AS f FROM l) SELECT query_id, f.used AS used, f.n AS picked, f.dropped AS dropped FROM f"
)
def retrieve_token_budget(spark, sf):
    fold = lambda cands: retrieve.budget_state(cands, 5, 400)
    return index.budgeted(tab(spark, sf, "documents"), tab(spark, sf, "benchmark"), 5, 400, T.estimate_tokens(F.col("text")), fold, "doc_id", "text", "item_id", "text")


S_SCORES = "SELECT query_id, round(coalesce(hits, 0) / greatest(1, least(3, coalesce(selected, 3))), 4) AS precision, round(coalesce(hits, 0) / relevant, 4) AS recall, round(coalesce(1 / first, 0), 4) AS rr FROM rel LEFT JOIN sel USING (query_id) LEFT JOIN h USING (query_id)"


@query(
    f"WITH {S_BM25}, r AS (SELECT doc_id % (SELECT max(item_id) + 1 FROM benchmark) AS query_id, doc_id AS item_id FROM labels WHERE quality = 1), rel AS (SELECT query_id, count(*) AS relevant FROM r GROUP BY query_id), top AS (SELECT * FROM ranked WHERE rank <= 3), "
    f"sel AS (SELECT query_id, count(*) AS selected FROM top GROUP BY query_id), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM top SEMI JOIN r USING (query_id, item_id) GROUP BY query_id) {S_SCORES}"
)
def evaluate_retrieval(spark, sf):
    asked = tab(spark, sf, "benchmark").agg(F.max("item_id").alias("most"))
    relevant = tab(spark, sf, "labels").filter("quality = 1").crossJoin(F.broadcast(asked)).select((F.col("doc_id") % (F.col("most") + 1)).alias("query_id"), F.col("doc_id").alias("item_id"))
    return evaluate.retrieval_scores(bm25(spark, sf, 3), relevant, 3)


@query(f"SELECT t.term AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({s_tokens('text')}) AS term FROM documents) t GROUP BY t.term")
def document_frequency(spark, sf):
    words = tab(spark, sf, "documents").select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n, sum(len(t))::BIGINT AS total, round(avg(len(t)), 4) AS avgdl FROM (SELECT {s_tokens('text')} AS t FROM documents)")
def corpus_stats(spark, sf):
    t = tab(spark, sf, "documents").select(F.size(T.tokenize(F.col("text"))).alias("dl"))
    return t.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 4).alias("avgdl"))


@query("SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) p ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_top_k(spark, sf):
    v = tab(spark, sf, "embeddings")
    probe = v.filter("vec_id = 0").first()["embedding"]
    return retrieve.vector_top_k(v, probe, 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("WITH s AS (SELECT v.vec_id, greatest(0, least(1, list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]))) AS c, (v.vec_id % 11) / 10.0::DOUBLE AS lex FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 1) p) SELECT vec_id, round(0.5 * lex + 0.5 * c, 4) AS score FROM s")
def hybrid_score(spark, sf):
    v = tab(spark, sf, "embeddings")
    probe = F.array(*[F.lit(float(x)) for x in v.filter("vec_id = 1").first()["embedding"]])
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), retrieve.cosine(F.col("embedding"), probe)))
    return v.select("vec_id", F.round(0.5 * ((F.col("vec_id") % 11) / F.lit(10.0)) + 0.5 * c, 4).alias("score"))


@query("SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 3) p ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_table_nearest(spark, sf):
    """Every vector is written reversed, then as it is; the last writes are searched after a fold."""
    v = tab(spark, sf, "embeddings")
    probe = v.filter("vec_id = 3").first()["embedding"]
    kept = VectorTable(spark, new_path(spark, "vectors"), len(probe), "long")
    kept.save(v.withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding")
    kept.save(v, "vec_id", "embedding")
    kept.compact()
    return kept.nearest(list(probe), 10).select(F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"))


def s_assembled(package: str, query: str, least: float) -> str:
    """The items of a package with their scores, in the order in which they are tried."""
    order = f"score DESC, confidence DESC, list_position({lit(C.CATEGORIES)}, category), id"
    return f"""WITH {S_ITEMS}, p AS (SELECT *, {s_id('category', 'content')} AS id, {s_estimate('content')} AS tokens FROM items WHERE package = '{package}'),
d AS (SELECT id AS item_id, {s_tokens("content || ' ' || source")} AS t FROM p), q AS (SELECT 0 AS query_id, {s_tokens(f"'{query}'")} AS t), {S_SCORED},
c AS (SELECT p.*, coalesce(lexical, 0) AS lexical, coalesce(score, 0) AS score, matched FROM p LEFT JOIN lex ON p.id = lex.item_id),
ok AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM c WHERE score >= {least} AND (score > 0 OR {least} > 0))"""


S_PICK = "list_reduce(l, lambda a, x: CASE WHEN len(a.picked) >= 8 OR a.used + x.used > 60 THEN a ELSE {'used': a.used + x.used, 'picked': list_concat(a.picked, x.picked)} END, {'used': 0::BIGINT, 'picked': []::BIGINT[]})"


@query(
    f"{s_assembled('pkg_1', 'which lot uses spring green', 0.0)}, f AS (SELECT {S_PICK} AS f FROM (SELECT list({{'used': tokens, 'picked': [place]}} ORDER BY place) AS l FROM ok)) "
    "SELECT list_position(f.f.picked, place)::INT AS rank, id, category, content, score, 'Matched ' || array_to_string(list_transform(string_split(matched, ' ')[1:6], lambda x: '''' || x || ''''), ', ') || ' (lexical ' || printf('%.2f', lexical) || ')' AS reason, tokens FROM ok, f WHERE list_contains(f.f.picked, place)"
)
def retrieve_assembled(spark, sf):
    chosen, _ = retrieve.assemble(items(spark, sf).filter("package = 'pkg_1'"), "which lot uses spring green", retrieve.RetrievalOptions(top_k=8, token_budget=60))
    return chosen.select("rank", "id", "category", "content", "score", "reason", "tokens")


@query(
    f"{s_assembled('pkg_2', 'lot 7', 0.2)}, s AS (SELECT coalesce(sum(tokens) FILTER (place <= 5), 0)::BIGINT AS used, count(*) AS passed FROM ok), a AS (SELECT count(*) AS n, count_if(score < 0.2) AS low, sum(tokens)::BIGINT AS tokens FROM c) "
    "SELECT n AS considered, (CASE WHEN passed > 5 THEN 0 ELSE low END)::INT AS dropped_below_min_score, 0::BIGINT AS dropped_for_budget, used AS tokens_selected, n AS total_items, tokens AS tokens_full_memory, greatest(0, tokens - used) AS tokens_saved_vs_full_memory, greatest(0, 5000 - used) AS tokens_saved_vs_transcript FROM s, a"
)
def retrieve_summary(spark, sf):
    return retrieve.assemble(items(spark, sf).filter("package = 'pkg_2'"), "lot 7", retrieve.RetrievalOptions(top_k=5, min_score=0.2), transcript_tokens=5000)[1]


# Text functions


@query(f"SELECT doc_id, {s_estimate('text')} AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return tab(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, sum({s_estimate('text')})::BIGINT AS tokens, count(*) AS turns FROM conversations GROUP BY conv_id")
def transcript_tokens(spark, sf):
    c = tab(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("turns"))


@query(f"SELECT doc_id, {s_id(chr(39) + 'facts' + chr(39), 'text')} AS id FROM documents")
def item_ids(spark, sf):
    return tab(spark, sf, "documents").select("doc_id", T.item_id(F.lit("facts"), F.col("text")).alias("id"))


@query(f"SELECT doc_id, len(s)::BIGINT AS n, coalesce(list_sum(list_transform(s, lambda x: len(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, {s_sentences('text')} AS s FROM documents)")
def split_sentences(spark, sf):
    s = tab(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("chars"))


S_HTML = "html"
for _p, _to in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)<br\s*/?\s*>", "\n"), (r"(?i)</(p|div|h[1-6]|li|tr)>", "\n"), (r"<[^>]+>", " ")):
    S_HTML = f"regexp_replace({S_HTML}, '{_p}', '{_to}', 'g')"
for _p, _to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    S_HTML = f"replace({S_HTML}, '{_p}', '{_to}')"
S_HTML = s_strip(rf"regexp_replace(regexp_replace({S_HTML}, '\n{{3,}}', chr(10) || chr(10), 'g'), '  +', ' ', 'g')")


@query(f"SELECT page_id, md5(t) AS digest, len(t)::BIGINT AS chars FROM (SELECT page_id, {S_HTML} AS t FROM pages)")
def html_to_text(spark, sf):
    t = tab(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("chars"))


S_ROLE = "CASE WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'user' END"
S_TRANSCRIPT = f"tr AS (SELECT conv_id, string_agg(upper(left({S_ROLE}, 1)) || substr({S_ROLE}, 2) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    c = tab(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.initcap(T.role(F.col("role"))), F.lit(": "), "text").alias("line"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("l")).select("conv_id", F.array_join("l.line", "\n\n").alias("t"))


@query(f"WITH {S_TRANSCRIPT} SELECT conv_id, md5(t) AS digest, len(t)::BIGINT AS chars FROM tr")
def format_transcript(spark, sf):
    return transcripts(spark, sf).select("conv_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("chars"))


@query(f"SELECT conv_id, {S_ROLE} AS role, count(*) AS turns, sum(len({s_strip('text')}))::BIGINT AS chars FROM conversations WHERE {s_strip('text')} <> '' GROUP BY conv_id, {S_ROLE}")
def parse_transcript(spark, sf):
    turns = transcripts(spark, sf).select("conv_id", F.explode(T.transcript_turns(F.col("t"))).alias("x"))
    return turns.groupBy("conv_id", "x.role").agg(F.count("*").alias("turns"), F.sum(F.length("x.content")).alias("chars"))


# Every conversation as a chat export: turn i hangs under turn (i - 1) / 2, whose list names its turns in falling order; each third turn has parts, and of each seven one is a tool's.
S_EXPORT = f"""m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
walk AS (SELECT conv_id, i, [0::BIGINT] AS path FROM m WHERE i = 0 UNION ALL SELECT m.conv_id, m.i, list_append(path, -m.i) FROM walk JOIN m ON m.conv_id = walk.conv_id AND m.i > 0 AND (m.i - 1) // 2 = walk.i),
told AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY len(path), path) - 1 AS place FROM (SELECT conv_id, path, CASE WHEN m.i % 7 = 3 THEN 'tool' ELSE role END AS role, CASE WHEN m.i % 3 = 0 THEN text || chr(10) || 'seen' ELSE text END AS text FROM walk JOIN m USING (conv_id, i)) WHERE role IN ('user', 'assistant', 'system') AND {s_strip("text")} <> '')"""


def exports(spark: SparkSession, sf: str) -> DataFrame:
    c = tab(spark, sf, "conversations").select("conv_id", "turn", *[F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text")])
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))

    def node(x, i):
        under = F.filter(F.array(2 * i + 2, 2 * i + 1), lambda j: j < F.size("l"))
        parts = F.to_json(F.array(x["text"], F.lit("seen")))
        plain = F.to_json(F.array(x["text"]))
        content = F.when(i % 3 == 0, F.concat(F.lit('{"parts":[{"asset":1},'), F.substr(parts, F.lit(2)), F.lit("}"))).otherwise(F.substr(plain, F.lit(2), F.length(plain) - 2))
        parent = F.when(i == 0, "null").otherwise(F.concat(F.lit('"n'), F.floor((i - 1) / 2).cast("string"), F.lit('"')))
        children = F.to_json(F.transform(under, lambda j: F.concat(F.lit("n"), j.cast("string"))))
        role = F.when(i % 7 == 3, F.lit('["tool"]')).otherwise(F.to_json(F.array(x["role"])))
        return F.concat(F.lit('"n'), i.cast("string"), F.lit('":{"parent":'), parent, F.lit(',"children":'), children, F.lit(',"message":{"author":{"role":'), F.substr(role, F.lit(2), F.length(role) - 2), F.lit('},"content":'), content, F.lit("}}"))

    raw = F.concat(F.lit('[{"title":"Talk '), F.col("conv_id").cast("string"), F.lit('","mapping":{'), F.array_join(F.transform("l", node), ","), F.lit("}}]"))
    return turns.select("conv_id", raw.alias("raw"))


@query(f"WITH RECURSIVE {S_EXPORT} SELECT conv_id AS key, place, role, md5(text) AS digest FROM told")
def export_tree(spark, sf):
    return export_messages(exports(spark, sf), "conv_id", "raw").select("key", F.col("place").cast("long").alias("place"), "role", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    f"WITH RECURSIVE {S_EXPORT}, b AS (SELECT conv_id, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) || chr(10) ORDER BY place) AS t FROM told GROUP BY conv_id), "
    "t AS (SELECT conv_id, chr(10) || '=== Conversation: Talk ' || conv_id || ' ===' || chr(10) || coalesce(chr(10) || chr(10) || t, '') AS t FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id)) SELECT conv_id AS key, md5(t) AS digest, len(t)::BIGINT AS chars FROM t"
)
def export_transcripts(spark, sf):
    return export_texts(exports(spark, sf), "conv_id", "raw").select("key", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query("SELECT c_custkey, CASE WHEN s = '' THEN 'imported_context' ELSE s END AS name FROM (SELECT c_custkey, trim(left(lower(trim(regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9]+', '_', 'g'), '_')), 64), '_') AS s FROM customer)")
def suggest_package_name(spark, sf):
    return tab(spark, sf, "customer").select("c_custkey", T.suggest_name(F.concat("c_name", F.lit("/"), "c_mktsegment")).alias("name"))


@query(r"SELECT page_id, n AS name, regexp_matches(trim(n), '^[A-Za-z0-9][A-Za-z0-9_.\-]{0,63}$') AND NOT contains(n, '..') AS ok FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN left(url, 20) WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'a..b' ELSE repeat('x', (page_id % 90)::INT) END AS n FROM pages)")
def package_name_check(spark, sf):
    k = F.col("page_id") % 4
    n = F.when(k == 0, F.left("url", F.lit(20))).when(k == 1, F.concat(F.lit("p"), "page_id")).when(k == 2, "a..b").otherwise(F.repeat(F.lit("x"), (F.col("page_id") % 90).cast("int")))
    return tab(spark, sf, "pages").select("page_id", n.alias("name")).withColumn("ok", T.package_name_ok(F.col("name")))


S_FILE = r"trim(regexp_replace(regexp_extract(regexp_replace(url, '[/\\]+$', ''), '([^/\\]*)$', 1), '[^A-Za-z0-9._\- ]+', '_', 'g'), ' .')"


@query(f"SELECT page_id, left(nullif({S_FILE}, ''), 128) AS name, coalesce(list_contains({lit(C.UPLOAD_SUFFIXES)}, lower(regexp_extract({S_FILE}, '(\\.[^.]*)$', 1))), false) AS ok FROM pages")
def safe_filename(spark, sf):
    return tab(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"), T.upload_ok(F.col("url")).alias("ok"))


@query("SELECT c_custkey, left(c_mktsegment, 3) || '…' || right(c_mktsegment, 2) AS phone, left(c_name, 1) || '***@x.org' AS mail, repeat('*', len(left(c_name, 4))) AS short FROM customer")
def mask_preview(spark, sf):
    return tab(spark, sf, "customer").select("c_custkey", T.preview(F.col("c_mktsegment")).alias("phone"), T.preview(F.concat(F.replace("c_name", F.lit(" "), F.lit("")), F.lit("@x.org"))).alias("mail"), T.preview(F.left("c_name", F.lit(4))).alias("short"))


# Extraction, over sentences made from orders

S_SAID = (
    "said AS (SELECT o_orderkey AS key, 'User: I''m Clerk. I decided to use ' || o_orderpriority || ' for order ' || (o_orderkey % 97) || '. I need to ship order ' || o_orderkey || ' soon. I already finished the todo for it. I prefer the style of Clerk#' || o_custkey || '. "
    "The deadline is ' || o_orderdate::DATE || ' as we know. I''m building a tracker for ' || o_orderstatus || ' orders.' AS t FROM orders)"
)


def said(spark: SparkSession, sf: str) -> DataFrame:
    o = tab(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"),
        F.concat(
            F.lit("User: I'm Clerk. I decided to use "), "o_orderpriority", F.lit(" for order "), (F.col("o_orderkey") % 97).cast("string"), F.lit(". I need to ship order "), F.col("o_orderkey").cast("string"), F.lit(" soon. I already finished the todo for it. I prefer the style of Clerk#"), F.col("o_custkey").cast("string"),
            F.lit(". The deadline is "), F.to_date("o_orderdate").cast("string"), F.lit(" as we know. I'm building a tracker for "), "o_orderstatus", F.lit(" orders."),
        ).alias("t"),
    )


def s_any(words) -> str:
    return "(" + " OR ".join("contains(lower(s), '" + w.replace("'", "''") + "')" for w in words) + ")"


def s_match(patterns) -> str:
    return "(" + " OR ".join("regexp_matches(s, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + ")"


S_RULES = {
    "identity": s_match(C.IDENTITY_PATTERNS),
    "projects": s_match(C.PROJECT_PATTERNS),
    "facts": s_any(C.FACT_KEYWORDS),
    "decisions": s_any(C.DECISION_KEYWORDS),
    "open_tasks": f"{s_any(C.TASK_KEYWORDS)} AND NOT {s_any(C.DONE_WORDS)}",
    "preferences": s_any(C.PREFERENCE_KEYWORDS),
}
S_EXTRACTED = (
    f"WITH {S_SAID}, sent AS (SELECT key, unnest(ss) AS s, generate_subscripts(ss, 1) AS spos FROM (SELECT key, {s_sentences(chr(39).join(['regexp_replace(t, ', '^User: ', ', ', '', ')']))} AS ss FROM said)), hit AS ("
    + " UNION ALL ".join(f"SELECT key, spos, s, '{c}' AS category, {C.CONFIDENCE[c]}::DOUBLE AS confidence, '{C.RULE_TAGS[c]}' AS source FROM sent WHERE {e}" for c, e in S_RULES.items())
    + f"), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, category, lower({s_strip('s')}) ORDER BY spos) AS r FROM hit) WHERE r = 1)"
)


@query(f"{S_EXTRACTED} SELECT key, category, row_number() OVER (PARTITION BY key, category ORDER BY spos) - 1 AS pos, {s_id('category', 's')} AS id, s AS content, confidence, source FROM once")
def extract_rules(spark, sf):
    return extract.extract(said(spark, sf), "key", "t").select("key", "category", F.col("pos").cast("long").alias("pos"), "id", "content", "confidence", "source")


@query(f"{S_EXTRACTED} SELECT category, count(*) AS n, round(avg(confidence), 4) AS confidence FROM once GROUP BY category")
def extract_counts(spark, sf):
    return extract.extract(said(spark, sf), "key", "t").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query(f"SELECT count(*) AS docs, sum(n)::BIGINT AS fired FROM (SELECT doc_id, len(list_filter({s_sentences('text')}, lambda x: regexp_matches(x, '(?i)' || '{C.IDENTITY_PATTERNS[0].replace(chr(39), chr(39) * 2)}'))) AS n FROM documents) WHERE n > 0")
def extract_identity_in_documents(spark, sf):
    s = tab(spark, sf, "documents").select("doc_id", F.size(F.filter(T.sentences(F.col("text")), lambda x: x.rlike("(?i)" + C.IDENTITY_PATTERNS[0]))).alias("n"))
    return s.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("fired"))


@query("SELECT o_orderkey AS key, 'facts' AS category, 0::BIGINT AS pos, 'Order ' || o_orderkey AS content, least(1.0, o_orderkey % 15 / 10.0)::DOUBLE AS confidence FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'decisions', 0, 'Ship it', 1.0 FROM orders WHERE o_orderkey % 5 <> 0")
def parse_model_replies(spark, sf):
    k = F.col("o_orderkey")
    good = F.concat(F.lit('```json\n{"facts": [{"content": " Order '), k.cast("string"), F.lit('", "confidence": '), ((k % 15) / F.lit(10.0)).cast("string"), F.lit('}, {"content": " "}], "decisions": ["Ship it", ""], "other": 1}\n```'))
    replies = tab(spark, sf, "orders").select("o_orderkey", F.when(k % 5 == 0, F.lit("not json")).otherwise(good).alias("r"))
    return extract.parse_replies(replies, "o_orderkey", "r").select("key", "category", F.col("pos").cast("long").alias("pos"), "content", "confidence")


# Redaction

S_EDGE = {"ssn": r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)", "ip_address": r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)"}
S_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
S_CRED = C.DETECTORS[3][4].replace("'", "''")


@query(f"SELECT doc_id, regexp_matches(text, '{S_EMAIL}') AS email, regexp_matches(text, '{S_CRED}') AS credential, regexp_matches(text, '{S_EDGE['ssn']}') AS ssn, regexp_matches(text, '{S_EDGE['ip_address']}') AS ip FROM documents")
def redaction_presence(spark, sf):
    p = {d[0]: d[4] for d in C.DETECTORS}
    t = F.col("text")
    return tab(spark, sf, "documents").select("doc_id", t.rlike(p["email"]).alias("email"), t.rlike(p["credential_assignment"]).alias("credential"), t.rlike(p["ssn"]).alias("ssn"), t.rlike(p["ip_address"]).alias("ip"))


S_LUHN = "list_sum(list_transform(list_reverse(string_split(digits, '')), lambda x, i: CASE WHEN i % 2 = 0 THEN CASE WHEN x::INT > 4 THEN x::INT * 2 - 9 ELSE x::INT * 2 END ELSE x::INT END)) % 10 = 0"


@query(f"SELECT o_orderkey, ({S_LUHN}) AS ok FROM (SELECT o_orderkey, '4' || lpad((o_orderkey * 7919)::VARCHAR, 15, '0') AS digits FROM orders)")
def luhn_check(spark, sf):
    return tab(spark, sf, "orders").select("o_orderkey", T.luhn_ok(F.concat(F.lit("4"), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 15, "0"))).alias("ok"))


@query()
def redaction_scan(spark, sf):
    return redact.findings(tab(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "f.*")


@query()
def redaction_report(spark, sf):
    return redact.report(tab(spark, sf, "documents"), "text")


@query()
def redact_items(spark, sf):
    d = tab(spark, sf, "documents").filter(redact.maybe_sensitive(F.col("text"))).select(F.lit("facts").alias("category"), F.col("text").alias("content"), F.lit("").alias("source"), F.lit(None).cast("array<struct<kind:string,count:int>>").alias("redactions"), F.lit("").alias("id"))
    return redact.redact_items(d)


# Packages


@query(f"WITH {S_ITEMS} SELECT package, category, pos, {s_id('category', 'content')} AS id, content FROM items")
def flatten_items(spark, sf):
    return package.flatten(items(spark, sf)).select("package", "category", "pos", "id", "content")


@query(f"WITH {S_ITEMS} SELECT category, count(*) AS n FROM items WHERE category IN ('facts', 'decisions') GROUP BY category")
def filter_categories(spark, sf):
    return items(spark, sf).filter(F.col("category").isin("facts", "decisions")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {S_ITEMS}, dim AS (SELECT unnest({lit(C.CATEGORIES)}) AS category) SELECT dim.category, count(i.pos) AS n FROM dim LEFT JOIN (SELECT * FROM items WHERE category <> 'facts') i ON dim.category = i.category GROUP BY dim.category")
def category_counts(spark, sf):
    return package.counts(items(spark, sf).filter("category <> 'facts'"))


@query(f"WITH {S_ITEMS}, x AS (SELECT *, {s_id('category', 'content')} AS id, list_position({lit(C.CATEGORIES)}, category) AS o FROM items) SELECT id, arg_max(pos, o * 10000000 + pos) AS pos FROM x GROUP BY id")
def items_by_id(spark, sf):
    return package.by_id(items(spark, sf)).select("id", "pos")


S_TWO = f"WITH {S_ITEMS}, x AS (SELECT *, {s_id('category', 'content')} AS id FROM items), l AS (SELECT * FROM x WHERE pos % 3 <> 0), r AS (SELECT * FROM x WHERE pos % 3 <> 1)"


@query(
    f"{S_TWO}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package, category, content ORDER BY pos) AS n FROM r) WHERE n = 1 AND (package, category, content) NOT IN (SELECT package, category, content FROM l)), "
    "e AS (SELECT package, category, max(pos) + 1 AS e FROM l GROUP BY package, category) SELECT package, category, pos, content FROM l UNION ALL SELECT f.package, f.category, row_number() OVER (PARTITION BY f.package, f.category ORDER BY f.pos) - 1 + coalesce(e, 0), content FROM fresh f LEFT JOIN e ON f.package = e.package AND f.category = e.category"
)
def append_items(spark, sf):
    x = items(spark, sf)
    out = package.append_new(x.filter("pos % 3 <> 0"), x.filter("pos % 3 <> 1"), ["package", "category"])
    return out.select("package", "category", F.col("pos").cast("long").alias("pos"), "content")


@query(f"{S_TWO} SELECT 'added' AS op, package, id, pos FROM r ANTI JOIN l USING (package, id) UNION ALL SELECT 'removed', package, id, pos FROM l ANTI JOIN r USING (package, id)")
def diff_items(spark, sf):
    x = items(spark, sf)
    return package.diff(x.filter("pos % 3 <> 0"), x.filter("pos % 3 <> 1"), ["package"]).select("op", "package", "id", "pos")


@query(f"WITH {S_ITEMS}, x AS (SELECT *, {s_id('category', 'content')} AS id FROM items), w AS (SELECT DISTINCT id FROM x WHERE pos % 10 = 3) SELECT pos, id FROM x ANTI JOIN w USING (id)")
def remove_items(spark, sf):
    x = items(spark, sf)
    return package.remove_items(x, x.filter("pos % 10 = 3").select("id"))[0].select("pos", "id")


S_EVENTS = "v AS (SELECT DISTINCT (date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) + 1)::BIGINT AS version, user_id || ':' || event_type AS id FROM events)"


def event_versions(spark: SparkSession, sf: str) -> DataFrame:
    e = tab(spark, sf, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("first"))
    return e.crossJoin(F.broadcast(first)).select((F.datediff(F.to_date("ts"), "first") + 1).cast("long").alias("version"), F.concat_ws(":", "user_id", "event_type").alias("id")).distinct()


def event_log(v: DataFrame) -> DataFrame:
    """Added and removed ids of each version against the one before."""
    after = v.select((F.col("version") + 1).alias("version"), "id")
    last = v.agg(F.max("version").alias("last"))
    added = v.join(after, ["version", "id"], "left_anti").withColumn("op", F.lit("added"))
    gone = after.join(v, ["version", "id"], "left_anti").crossJoin(F.broadcast(last)).filter("version <= last").select("version", "id").withColumn("op", F.lit("removed"))
    return added.unionByName(gone)


S_LOG = "lg AS (SELECT version, id, 'added' AS op FROM v WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.id = v.id AND w.version = v.version - 1) UNION ALL SELECT version + 1, id, 'removed' FROM v WHERE version < (SELECT max(version) FROM v) AND NOT EXISTS (SELECT 1 FROM v w WHERE w.id = v.id AND w.version = v.version + 1))"


@query(f"WITH {S_EVENTS}, {S_LOG} SELECT version, count_if(op = 'added') AS added, count_if(op = 'removed') AS removed FROM lg GROUP BY version")
def version_summary(spark, sf):
    v = event_versions(spark, sf)
    return package.version_summary(v.select("version").distinct(), event_log(v))


@query(f"WITH {S_EVENTS} SELECT id FROM v WHERE version = (SELECT max(version) - 5 FROM v)")
def rollback(spark, sf):
    v = event_versions(spark, sf)
    last = v.agg(F.max("version").alias("m")).first()["m"]
    shape = lambda d: d.withColumns({"category": F.lit("facts"), "pos": F.lit(0)})
    now = shape(v.filter(F.col("version") == last).select("id")).select("id", "category", "pos")
    return package.undo(now, shape(event_log(v)), last, last - 5).select("id")


@query(f"WITH {S_ITEMS} SELECT package, count(*) AS items, sum({s_estimate('content')})::BIGINT AS tokens FROM items GROUP BY package")
def package_summaries(spark, sf):
    return items(spark, sf).groupBy("package").agg(F.count("*").alias("items"), F.sum(T.estimate_tokens(F.col("content"))).alias("tokens"))


# Prompts

S_LABEL = f"{lit(C.PROMPT_LABELS)}[list_position({lit(C.CATEGORIES)}, category)]"
S_ORD = f"list_position({lit(C.CATEGORIES)}, category)"


def s_prompt(section: str, line: str, glue: str, wrap: str) -> str:
    return (
        f"WITH {S_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY package, category ORDER BY pos) AS n FROM items), c AS (SELECT package, category, string_agg({line}, chr(10) ORDER BY pos) AS body FROM n GROUP BY package, category), "
        f"b AS (SELECT package, string_agg({section}, {glue} ORDER BY {S_ORD}) AS block FROM c GROUP BY package) SELECT package, md5({wrap}) AS digest, len({wrap})::BIGINT AS chars FROM b"
    )


def rendered(spark, sf, fmt: str) -> DataFrame:
    b = prompt.render(items(spark, sf), fmt, ["package"])
    return b.select("package", F.md5(F.col("block").cast("binary")).alias("digest"), F.length("block").cast("long").alias("chars"))


@query(s_prompt(f"'## ' || {S_LABEL} || chr(10) || body", "'- ' || content", "chr(10) || chr(10)", "block"))
def prompt_markdown(spark, sf):
    return rendered(spark, sf, "markdown")


@query(s_prompt(f"'<' || category || '>' || chr(10) || '  <!-- ' || {S_LABEL} || ' -->' || chr(10) || body || chr(10) || '</' || category || '>'", "'  <item>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</item>'", "chr(10)", "'<context>' || chr(10) || block || chr(10) || '</context>'"))
def prompt_xml(spark, sf):
    return rendered(spark, sf, "xml")


@query(s_prompt(f"'[' || {S_LABEL} || ']' || chr(10) || body", "'  ' || n || '. ' || content", "chr(10) || chr(10)", "block"))
def prompt_plain(spark, sf):
    return rendered(spark, sf, "plain")


# Merging


@query(f"WITH {S_ITEMS}, x AS (SELECT *, {s_id('category', 'content')} AS id FROM items) SELECT category, pos, row_number() OVER (PARTITION BY category ORDER BY confidence DESC, len(content) DESC, origin, id, pos) AS rk FROM x")
def merge_order(spark, sf):
    return merge.rank_pool(items(spark, sf)).select("category", "pos", F.col("rk").cast("long").alias("rk"))


@query(f"WITH {S_ITEMS}, f AS (SELECT content, origin, min(pos) AS seen FROM items GROUP BY content, origin) SELECT content, string_agg(origin, ' | ' ORDER BY seen, origin) AS origins FROM f GROUP BY content")
def merge_origins(spark, sf):
    f = items(spark, sf).groupBy("content", "origin").agg(F.min("pos").alias("seen"))
    return f.groupBy("content").agg(F.sort_array(F.collect_list(F.struct("seen", "origin"))).alias("l")).select("content", F.array_join("l.origin", C.ORIGIN_SEPARATOR).alias("origins"))


@query("SELECT coalesce(string_agg(m, '+' ORDER BY m), 'merged') AS source_model FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)")
def merge_source_models(spark, sf):
    return merge.source_models(tab(spark, sf, "customer").withColumnRenamed("c_mktsegment", "source_model"))


S_NEG = "(" + " OR ".join("contains(lower({0}), '" + m.replace("'", "''") + "')" for m in C.NEGATIONS) + ")"


@query(f"SELECT o_orderkey, {S_NEG.format('o_comment')} AS negated FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'We avoid ' WHEN 1 THEN 'We never use ' ELSE 'We use ' END || o_custkey AS o_comment FROM orders)")
def negation_markers(spark, sf):
    c = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "We avoid ").when(F.col("o_orderkey") % 3 == 1, "We never use ").otherwise("We use "), F.col("o_custkey").cast("string"))
    return tab(spark, sf, "orders").select("o_orderkey", merge.negated(c).alias("negated"))


S_WORDS = f"SELECT item_id, list_sort(list_distinct({s_tokens('text')})) AS t FROM benchmark"


@query(f"WITH b AS ({S_WORDS}), w AS (SELECT item_id, unnest(t) AS w FROM b), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL HAVING count(*) >= 2) SELECT p.a, p.b, p.shared, round(p.shared / (len(x.t) + len(y.t) - p.shared), 4) AS jaccard FROM p JOIN b x ON x.item_id = p.a JOIN b y ON y.item_id = p.b")
def shared_term_pairs(spark, sf):
    base = tab(spark, sf, "benchmark").select("item_id", F.array_distinct(T.tokenize(F.col("text"))).alias("t"))
    w = base.select("item_id", F.explode("t").alias("w"), F.size("t").alias("n"))
    pairs = w.alias("x").join(w.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).agg(F.count("*").alias("shared"), F.max(F.col("x.n") + F.col("y.n")).alias("n"))
    return pairs.filter("shared >= 2").select("a", "b", "shared", F.round(F.col("shared") / (F.col("n") - F.col("shared")), 4).alias("jaccard"))


def merge_pool(spark, sf) -> DataFrame:
    return items(spark, sf)


@query()
def merge_items(spark, sf):
    return merge.merge(merge_pool(spark, sf))[0].select("category", "rk", "id", "content", "confidence", "origin")


@query()
def merge_duplicate_groups(spark, sf):
    return merge.merge(merge_pool(spark, sf))[1]


@query()
def merge_conflicts(spark, sf):
    """Conflicts among all items of part as they are, each under its rank."""
    return merge.conflicts(merge.rank_pool(items(spark, sf)))


# Evaluation


@query("SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM (SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(quality = 1 AND toxic <> 0) AS fp, count_if(quality <> 1 AND toxic = 0) AS fn FROM labels)")
def evaluate_labels(spark, sf):
    return evaluate.binary_scores(tab(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query(f"WITH t AS (SELECT conv_id, sum({s_estimate('text')})::DOUBLE AS whole, sum(CASE WHEN role = 'user' THEN {s_estimate('text')} ELSE 0 END)::DOUBLE AS sel FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN whole > 0 THEN round(1 - sel / whole, 4) ELSE 0 END AS saved FROM t")
def evaluate_token_savings(spark, sf):
    e = T.estimate_tokens(F.col("text"))
    t = tab(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(e).cast("double").alias("whole"), F.sum(F.when(F.col("role") == "user", e).otherwise(0)).cast("double").alias("sel"))
    return t.select("conv_id", evaluate.savings(F.col("sel"), F.col("whole")).alias("saved"))


@query(f"{S_EXTRACTED}, g AS (SELECT o_orderkey AS key, o_orderkey::VARCHAR AS word FROM orders) SELECT g.key, round(max(CASE WHEN contains(lower(s), lower(word)) THEN 1 ELSE 0 END), 4)::DOUBLE AS coverage, round(count_if(NOT contains(lower(s), lower(word))) / count(*), 4)::DOUBLE AS unmatched_ratio FROM g JOIN once ON g.key = once.key GROUP BY g.key")
def evaluate_extraction(spark, sf):
    found = extract.extract(said(spark, sf), "key", "t").withColumn("id", F.concat_ws("/", "category", "pos"))
    gold = tab(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0).alias("gold_idx"), F.array(F.col("o_orderkey").cast("string")).alias("keywords"))
    return evaluate.extraction_coverage(found, gold, "key").select("key", "coverage", "unmatched_ratio")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_k_per_key(spark, sf):
    o = tab(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rank", r.cast("long")).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")
