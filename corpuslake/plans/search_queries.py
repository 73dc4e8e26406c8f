"""Search, fusion, measures, conversations and prompts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import params, text
from corpuslake.operators import bm25, contain, context, dense, fuse, history, metrics
from corpuslake.sources import html

from .registry import Query, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


STOP = ", ".join(f"'{w}'" for w in params.STOPWORDS)
#: Terms of a text column, as a list.
TERMS = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda t: strlen(t) >= 2 AND t NOT IN (" + STOP + "))"
DOC_TERMS, ITEM_TERMS = TERMS.format(c="d.text"), TERMS.format(c="q.text")

BM25_CTES = f"""
    toks AS (SELECT doc_id, {DOC_TERMS} AS t FROM documents d),
    lens AS (SELECT doc_id, len(t) AS l FROM toks),
    stats AS (SELECT count(*) AS n, avg(l) AS a FROM lens),
    posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({ITEM_TERMS}) AS term FROM benchmark q)),
    scored AS (
        SELECT item_id AS query_id, p.doc_id,
               round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.5e0) / (tf + 1.5e0 * (0.25e0 + 0.75e0 * (l / a)))), 6) AS score
        FROM asked JOIN posts p USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN stats
        GROUP BY ALL),
    sparse_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("bm25_topk", f"WITH {BM25_CTES} SELECT query_id, rank, doc_id, score FROM sparse_all WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.bm25_topk(questions(spark, sf_dir), table(spark, sf_dir, "documents"))


@register("bm25_term_stats", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({DOC_TERMS}) AS term FROM documents d) GROUP BY term")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(table(spark, sf_dir, "documents"))


@register("bm25_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({DOC_TERMS})), 6) AS avg_length FROM documents d")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.corpus_stats(table(spark, sf_dir, "documents")).withColumn("avg_length", F.round("avg_length", 6))


@register("tokenize", f"SELECT doc_id, len({DOC_TERMS})::BIGINT AS n_terms, md5(array_to_string({DOC_TERMS}, ' ')) AS terms_md5 FROM documents d")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(terms).cast("long").alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


EMBED = """
    {p}w AS (SELECT id, term, count(*) AS n, md5(term) AS h FROM (SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM {t}) GROUP BY ALL),
    {p}b AS (SELECT id, (('0x' || h)::UHUGEINT % 384)::INTEGER AS bucket, sum(n * (1 - 2 * ((('0x' || h)::UHUGEINT >> 8) % 2)::INTEGER))::BIGINT AS w FROM {p}w GROUP BY ALL),
    {p}e AS (SELECT id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {p}b WHERE w <> 0)"""
DOC_EMBED, ITEM_EMBED = EMBED.format(p="d", id="doc_id", t="documents"), EMBED.format(p="q", id="item_id", t="benchmark")


@register("hash_embed", f"WITH {DOC_EMBED} SELECT id AS doc_id, bucket, round(w, 6) AS w FROM de")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.hash_embed(table(spark, sf_dir, "documents")).withColumn("w", F.round("w", 6))


DENSE_CTES = f"""{DOC_EMBED}, {ITEM_EMBED},
    cosines AS (SELECT qe.id AS query_id, de.id AS doc_id, round(sum(qe.w * de.w), 6) AS score FROM qe JOIN de USING (bucket) GROUP BY ALL HAVING sum(qe.w * de.w) > 0),
    dense_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cosines)"""


def dense_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = dense.embed(questions(spark, sf_dir), id_col="query_id").withColumnRenamed("doc_id", "query_id")
    found = dense.dense_topk(asked, dense.embed(table(spark, sf_dir, "documents")), k, id_col="doc_id", vector_col="vector")
    return found.where("score > 0").withColumnRenamed("id", "doc_id")


@register("dense_topk_hash", f"WITH {DENSE_CTES} SELECT query_id, rank, doc_id, score FROM dense_all WHERE rank <= 5")
def dense_topk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir, 5)


VECTOR_SQL = """
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, label AS collection, vec_id AS id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q CROSS JOIN embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, id) AS rank FROM s)
"""


def vector_hits(spark: SparkSession, sf_dir: str, floor: float | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("collection"), "embedding")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.dense_topk(asked, rows, 5, floor, groups=("collection",))


@register("dense_topk_by_collection", VECTOR_SQL + "SELECT query_id, collection, rank, id, score FROM r WHERE rank <= 5")
def dense_topk_by_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_hits(spark, sf_dir)


@register(
    "dense_topk_all_collections",
    VECTOR_SQL
    + """, m AS (SELECT query_id, collection, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r WHERE rank <= 5 AND score >= 0.1)
    SELECT query_id, collection, rank, id, score FROM m WHERE rank <= 5""",
)
def dense_topk_all_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.merged_topk(vector_hits(spark, sf_dir, 0.1), 5)


@register("vector_cosine", "SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", F.round(dense.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


HYBRID_CTES = f"""{BM25_CTES}, {DENSE_CTES},
    fused AS (
        SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.doc_id, s.doc_id) AS doc_id,
               coalesce(1e0 / (60 + d.rank), 0e0) + coalesce(1e0 / (60 + s.rank), 0e0) AS rrf, d.score AS dense, s.score AS sparse
        FROM (SELECT * FROM dense_all WHERE rank <= 10) d FULL OUTER JOIN (SELECT * FROM sparse_all WHERE rank <= 10) s ON d.query_id = s.query_id AND d.doc_id = s.doc_id),
    bounds AS (SELECT *, max(rrf) OVER w AS top, min(dense) OVER w AS lo, max(dense) OVER w AS hi FROM fused WINDOW w AS (PARTITION BY query_id)),
    blend AS (SELECT query_id, doc_id, round(0.7e0 * (rrf / top) + 0.3e0 * CASE WHEN dense IS NOT NULL AND hi > lo THEN (dense - lo) / (hi - lo) ELSE 0e0 END, 6) AS score FROM bounds),
    hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM blend)"""


def fused_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    pool = fuse.pool_size(k)
    return fuse.fuse(dense_hits(spark, sf_dir, pool), bm25.bm25_topk(questions(spark, sf_dir), table(spark, sf_dir, "documents"), pool))


@register("rank_fusion", f"WITH {HYBRID_CTES} SELECT query_id, doc_id, round(rrf, 6) AS rrf, dense, sparse FROM fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_hits(spark, sf_dir).withColumn("rrf", F.round("rrf", 6))


@register("hybrid_topk", f"WITH {HYBRID_CTES} SELECT query_id, rank, doc_id, score FROM hybrid WHERE rank <= 5")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.rerank(fused_hits(spark, sf_dir), 5)


def relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): documents that hold a question's text."""
    return contain.containing(table(spark, sf_dir, "documents"), questions(spark, sf_dir))


QRELS = "qrels AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = """
    per_query AS (
        SELECT r.query_id, coalesce(count(DISTINCT CASE WHEN h.doc_id = r.doc_id THEN h.doc_id END), 0) / n_rel AS recall,
               coalesce(count(DISTINCT CASE WHEN h.doc_id = r.doc_id THEN h.doc_id END) / nullif(count(DISTINCT h.rank), 0), 0e0) AS precision,
               coalesce(1e0 / min(CASE WHEN h.doc_id = r.doc_id THEN h.rank END), 0e0) AS rr
        FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_rel FROM qrels) r LEFT JOIN (SELECT * FROM {hits} WHERE rank <= 5) h USING (query_id)
        GROUP BY r.query_id, n_rel)"""


@register("relevance_by_containment", f"WITH {QRELS} SELECT * FROM qrels")
def relevance_by_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevant(spark, sf_dir)


@register("retrieval_metrics", f"WITH {BM25_CTES}, {QRELS}, {METRICS.format(hits='sparse_all')} SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr FROM per_query")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_query = metrics.retrieval_metrics(bm25_topk(spark, sf_dir), relevant(spark, sf_dir), 5)
    return per_query.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr")))


@register("retrieval_macro", f"WITH {BM25_CTES}, {QRELS}, {METRICS.format(hits='sparse_all')} SELECT count(*) AS n_queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(rr), 4) AS rr FROM per_query")
def retrieval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_average(metrics.retrieval_metrics(bm25_topk(spark, sf_dir), relevant(spark, sf_dir), 5))


@register("empty_rate", f"WITH {BM25_CTES} SELECT count(*) AS n_queries, round(avg(CASE WHEN h.query_id IS NULL THEN 1 ELSE 0 END), 4) AS empty_rate FROM benchmark LEFT JOIN (SELECT DISTINCT query_id FROM sparse_all) h ON item_id = query_id")
def empty_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.empty_rate(questions(spark, sf_dir), bm25_topk(spark, sf_dir))


#: White space beyond the line feed, as RE2 writes it.
BLANKS = r"\t\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: T1 without NFKC, which SQL lacks; ``clean_documents`` has it, and pytest holds that.
CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), "
    r"'\x{a0}', ' ', 'g'), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{2,}', ' ', 'g'), "
    rf"'[{BLANKS}]*\n[{BLANKS}]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n{BLANKS}]+|[\n{BLANKS}]+$', '', 'g')"
)


@register("clean_text", f"SELECT doc_id, md5({CLEAN}) AS clean_md5 FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cleaned, but for the compatibility forms."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"))


@register("clean_documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cleaned, compatibility forms too."""
    return text.clean_pages(table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("clean_md5"))


@register(
    "page_links",
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*>')) AS a, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*>'), 1) AS pos,
            regexp_extract_all(html, '(?s)<a\s[^>]*>(.*?)</a>', 1) AS inner_text FROM pages)
        SELECT page_id, (pos - 1)::INTEGER AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS url, greatest(round(1 - 0.1e0 * (pos - 1), 6), 0.5e0) AS score FROM m""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages")).select("page_id", "pos", "url", F.round("score", 6).alias("score"))


@register(
    "page_text",
    r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS text_md5 FROM pages""",
)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.plain_text(F.col("html"))).alias("text_md5"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")


@register("session_list", "SELECT conv_id AS session_id, max(turn) AS last_turn, count(*) AS n_messages FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, session_id LIMIT 50 OFFSET 5")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir)
    sessions = said.groupBy("session_id").agg(F.max("turn").alias("updated_at"), F.first("session_id").alias("title"))
    listed = history.list_sessions(sessions, said, 50, 5)
    return listed.select("session_id", F.col("updated_at").alias("last_turn"), "n_messages")


@register(
    "last_messages",
    """SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
       FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3""",
)
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_messages(messages(spark, sf_dir), 3).select("session_id", "turn", "role", "pos")


HISTORY_SQL = """
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, role || ': ' || coalesce(text, '') AS line FROM conversations),
    u AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) AS used FROM b WHERE back <= 12),
    h AS (SELECT conv_id AS session_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY turn) AS history FROM u WHERE back = 1 OR used <= 2000 GROUP BY conv_id)"""


@register("history_budget", f"WITH {HISTORY_SQL} SELECT session_id, n_lines, md5(history) AS history_md5 FROM h")
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_within(messages(spark, sf_dir)).select("session_id", "n_lines", F.md5("history").alias("history_md5"))


@register(
    "session_titles",
    r"""WITH f AS (SELECT conv_id AS session_id, nullif(trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g'), ' .:-–—'), '') AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
        SELECT session_id, CASE WHEN t IS NULL THEN 'New conversation' WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 57), ' [^ ]*$', '') || '...' END AS title FROM f""",
)
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.new_sessions(messages(spark, sf_dir))


@register("message_counts", "SELECT conv_id AS session_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.message_counts(messages(spark, sf_dir))


@register("delete_sessions", "SELECT conv_id AS session_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def delete_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = messages(spark, sf_dir)
    sessions = said.select("session_id").distinct()
    return history.delete_sessions(sessions, said, sessions.where("session_id % 3 = 0"))[1].select("session_id", "turn")


CONTEXT_SQL = f"""{BM25_CTES},
    blocks AS (SELECT query_id, rank, '[Source ' || rank || '] (' || source || ', ' || lang || ')' || chr(10) || text AS block FROM sparse_all JOIN documents USING (doc_id) WHERE rank <= 8),
    used AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank) AS u, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM blocks),
    kept AS (SELECT query_id, rank, CASE WHEN length(block) <= 4000 THEN block ELSE regexp_replace(left(block, 4000), ' [^ ]*$', '') || ' ...' END AS block FROM used WHERE i = 1 OR u <= 4000),
    packed AS (SELECT query_id, count(*) AS n_sources, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM kept GROUP BY query_id),
    contexts AS (SELECT item_id AS query_id, coalesce(n_sources, 0) AS n_sources, coalesce(context, 'No relevant context was found.') AS context FROM benchmark LEFT JOIN packed ON item_id = query_id)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = bm25.bm25_topk(questions(spark, sf_dir), docs, 8).join(docs.select("doc_id", "source", "lang", F.col("text").alias("body")), "doc_id")
    blocks = hits.withColumn("block", context.source_block(F.col("rank"), [F.col("source"), F.col("lang")], F.col("body")))
    return context.contexts(blocks.select("query_id", "rank", "block"), questions(spark, sf_dir))


@register("context_budget", f"WITH {CONTEXT_SQL} SELECT query_id, n_sources, md5(context) AS context_md5 FROM contexts")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("query_id", "n_sources", F.md5("context").alias("context_md5"))


@register("prompts", f"WITH {CONTEXT_SQL} SELECT item_id AS query_id, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || text) AS prompt_md5 FROM benchmark JOIN contexts ON item_id = query_id")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.prompts(packed(spark, sf_dir), questions(spark, sf_dir)).select("query_id", F.md5("prompt").alias("prompt_md5"))


WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


@register(
    "answer_faithfulness",
    f"""WITH {BM25_CTES}, best AS (SELECT query_id, {WORDS.format("b.text")} AS aw, {WORDS.format("d.text")} AS sw FROM sparse_all JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank = 1),
    words AS (SELECT query_id, 'a' AS side, unnest(aw) AS w, generate_subscripts(aw, 1) AS i FROM best UNION ALL SELECT query_id, 's', unnest(sw), generate_subscripts(sw, 1) FROM best),
    runs AS (SELECT query_id, side, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x || ' ' || lead(w, 3) OVER x AS g FROM words WINDOW x AS (PARTITION BY query_id, side ORDER BY i)),
    grams AS (SELECT query_id, g, bool_or(side = 'a') AS own, bool_or(side = 's') AS held FROM runs WHERE g IS NOT NULL GROUP BY query_id, g),
    shares AS (SELECT query_id, count(*) AS n_own, count(*) FILTER (WHERE held) AS shared FROM grams WHERE own GROUP BY query_id)
    SELECT query_id, round(coalesce(shared / n_own, 1e0), 6) AS faithfulness FROM best LEFT JOIN shares USING (query_id)""",
)
def answer_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each question's own words its best document holds, read whole."""
    docs = table(spark, sf_dir, "documents")
    best = bm25.bm25_topk(questions(spark, sf_dir), docs, 1).join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").join(questions(spark, sf_dir), "query_id")
    split = best.select("query_id", metrics.words(F.col("text")).alias("said"), metrics.words(F.col("body")).alias("read"))
    return split.select("query_id", F.round(metrics.shared_grams(F.col("said"), F.col("read")), 6).alias("faithfulness"))


@register(
    "word_recall",
    f"""WITH w AS (SELECT doc_id, list_distinct({WORDS.format("text")}) AS t, list_distinct({WORDS.format(CLEAN)}) AS e FROM documents)
    SELECT doc_id, round(CASE WHEN len(t) = 0 THEN 1e0 ELSE len(list_intersect(t, e)) / len(t) END, 6) AS recall FROM w""",
)
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each whole text that cleaning leaves."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.round(metrics.word_recall(text.clean_text(F.col("text")), F.col("text")), 6).alias("recall"))


#: DuckDB counts edits in bytes: letters beyond ASCII, one by one, as control characters, and what is left as one mark each.
ACCENTED = "".join(map(chr, [0xC4, 0xC7, 0xC8, 0xC9, 0xCA, 0xCD, 0xD1, 0xD3, 0xD6, 0xDC, 0xDF, 0xE4, 0xE7, 0xE8, 0xE9, 0xEA, 0xED, 0xF1, 0xF3, 0xF6, 0xFC]))
BYTEWISE = "translate({0}, '" + ACCENTED + "', " + " || ".join(f"chr({i + 1 if i < 8 else i + 6})" for i in range(len(ACCENTED))) + ")"


@register(
    "text_similarity",
    f"""WITH t AS (SELECT conv_id, turn, role, {BYTEWISE.format("text")} AS a FROM conversations)
    SELECT conv_id, turn, round(CASE WHEN greatest(length(a), length(role)) = 0 THEN 1e0 ELSE 1 - levenshtein(a, role) / greatest(length(a), length(role)) END, 6) AS similarity FROM t""",
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each turn's text, as it is, and its role are."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(metrics.similarity(F.col("text"), F.col("role")), 6).alias("similarity"))


@register("mask_sensitive", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|secret|token|api_key|authorization') THEN '***' ELSE md5(text) END AS shown FROM documents")
def mask_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_sensitive(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(masked == "***", masked).otherwise(F.md5(masked)).alias("shown"))


@register("evidence_tokens", "SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in params.EVIDENCE_STOPWORDS) + "))) AS n FROM conversations")
def evidence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.size(text.evidence_tokens(F.col("text"))).cast("long").alias("n"))


@register("latency_summary", """SELECT event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean, round((list_sort(list(value))[(count(*) - 1) // 2 + 1] + list_sort(list(value))[count(*) // 2 + 1]) / 2, 4) AS median,
    list_sort(list(value))[count(*) * 95 // 100 + 1] AS p95, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return metrics.latency_summary(samples)
