"""Branches of the router, checks of graphs, sessions and replies, scans and the growing index, with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import bm25, dense, fuse, graph, history, route
from corpuslake.sources import chunks as chunk_table
from corpuslake.sources import intake, synth
from corpuslake.sources.scratch import cut, shared_folder
from corpuslake.streaming import versions

from .academic_queries import GRAPH_SQL, stored_graph
from .advisor_queries import LINKS, SYLLABUS_CHUNKS, syllabus_chunks, web_rows
from .registry import Query, table
from .search_queries import BM25_CTES, DENSE_CTES, HYBRID_CTES, questions

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return add


@register(
    "hybrid_answers",
    f"""WITH {SYLLABUS_CHUNKS}, documents AS (SELECT chunk_id AS doc_id, text FROM chunked),
    benchmark AS (SELECT p_partkey AS item_id, 'Explain regulation ' || p_size AS text FROM part WHERE p_partkey % 6 = 2), {HYBRID_CTES}
    SELECT query_id, rank, doc_id AS key, score, 'hybrid' AS method FROM hybrid WHERE rank <= 5""",
)
def hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's branch for questions that hold an exact name or number: words and vectors fused, over chunks of syllabi."""
    asked = synth.questions(spark, sf_dir)
    chunks = cut(syllabus_chunks(spark, sf_dir).select("chunk_id", "text"))  # both searches read it

    def hybrid(some: DataFrame) -> DataFrame:
        mine = some.select("query_id", "text")
        vectors = dense.embed(mine, id_col="query_id").withColumnRenamed("doc_id", "query_id")
        pool = fuse.pool_size(5)
        near = dense.dense_topk(vectors, dense.embed(chunks, id_col="chunk_id"), pool, id_col="doc_id", vector_col="vector").where("score > 0").withColumnRenamed("id", "doc_id")
        words = bm25.bm25_topk(mine, chunks, pool, id_col="chunk_id")
        return fuse.rerank(fuse.fuse(near, words), 5).select("query_id", "rank", F.col("doc_id").alias("key"), "score", F.lit("hybrid").alias("method"))

    return route.dispatch(route.plan(asked), {"HYBRID": lambda some: route.once_per_text(some, hybrid)})


@register(
    "second_opinions",
    """SELECT p_partkey AS query_id,
        CASE WHEN p_partkey % 6 = 5 AND p_partkey % 4 = 0 THEN 'GRAPH' WHEN p_partkey % 6 IN (0, 1, 4) THEN 'GRAPH' WHEN p_partkey % 6 = 2 THEN 'HYBRID' WHEN p_partkey % 6 = 3 THEN 'WEB' ELSE 'NORMAL' END AS strategy,
        CASE WHEN p_partkey % 6 = 5 AND p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN 0.5e0 ELSE (p_partkey % 10) / 10e0 END WHEN p_partkey % 6 = 3 THEN 0.9e0 WHEN p_partkey % 6 = 5 THEN 0.7e0 ELSE 1e0 END AS confidence, false AS fallback FROM part""",
)
def second_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for which a model was asked too: it counts where the rules doubt and it names a strategy."""
    id_, tenth = F.col("p_partkey"), F.col("p_partkey") % 10
    raw = F.when(id_ % 4 == 0, F.when(id_ % 8 == 0, '{"strategy": "graph"}').otherwise(F.concat(F.lit('{"strategy": "Graph", "confidence": 0.'), tenth.cast("string"), F.lit("}")))).when(id_ % 4 == 1, '{"strategy": "ORACLE", "confidence": 1}').when(id_ % 4 == 2, "no reply")
    replies = table(spark, sf_dir, "part").select(id_.alias("query_id"), raw.alias("raw"))
    return route.plan(synth.questions(spark, sf_dir), route.model_verdicts(replies)).select("query_id", "strategy", "confidence", "fallback")


@register(
    "filtered_hits",
    f"""WITH {BM25_CTES}, h AS (SELECT query_id, rank, doc_id, lang, query_id % 2 = 0 AND lang = 'fr' OR query_id % 2 = 1 AS fits FROM sparse_all JOIN documents USING (doc_id) WHERE rank <= 8)
    SELECT query_id, rank, doc_id, lang FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS some_fit FROM h) WHERE fits OR NOT some_fit""",
)
def filtered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the type that every other question filters for, here a language, unless that leaves it none."""
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    hits = bm25.bm25_topk(asked, docs, 8).join(docs.select("doc_id", "lang"), "doc_id").withColumn("document_type", F.col("lang"))
    plans = asked.select("query_id", F.when(F.col("query_id") % 2 == 0, F.create_map(F.lit("document_type"), F.lit("fr"))).alias("filters"))
    return route.filter_by_type(hits, plans).select("query_id", "rank", "doc_id", "lang")


@register(
    "web_answers",
    f"""WITH {BM25_CTES}, {LINKS}, state AS (SELECT item_id AS query_id, item_id % 4 = 1 AS mixed, item_id % 3 = 0 AS ok FROM benchmark),
    parts AS (SELECT query_id, 0 AS part, rank, doc_id::VARCHAR AS doc_id, 'hybrid' AS method, NOT ok AS fallback FROM sparse_all JOIN state USING (query_id) WHERE rank <= 3 AND (mixed OR NOT ok)
        UNION ALL SELECT query_id, 1, k, url, 'web', false FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS k FROM web) JOIN state USING (query_id) WHERE k <= 4 AND ok)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank)::INTEGER AS rank, doc_id, method, fallback FROM parts""",
)
def web_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web branch: hits of the library before those of the web for mixed questions, and alone where the search failed or gave no sign."""
    asked = questions(spark, sf_dir)
    plans = asked.select("query_id", (F.col("query_id") % 4 == 1).alias("mixed"))
    status = asked.where("query_id % 3 < 2").select("query_id", (F.col("query_id") % 3 == 0).alias("ok"))
    hits = bm25.bm25_topk(asked, table(spark, sf_dir, "documents"), 3).select("query_id", "rank", F.col("doc_id").cast("string").alias("doc_id"), F.lit("hybrid").alias("method"))
    web = route.web_hits(web_rows(spark, sf_dir), 4).select("query_id", "rank", "doc_id", "method")
    return route.web_branch(plans, status, web, hits).select("query_id", "rank", "doc_id", "method", "fallback")


@register(
    "edge_checks",
    "WITH e AS (SELECT CASE p_size % 3 WHEN 0 THEN 'HAS_TOPIC' WHEN 1 THEN 'ABOUT' ELSE 'KNOWS' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'Subject' WHEN 1 THEN 'PastQuestion' ELSE 'Topic' END AS a, p_brand, p_type FROM part) SELECT type, a AS start_label, (type = 'HAS_TOPIC' AND a = 'Subject' OR type = 'ABOUT' AND a = 'PastQuestion') AS allowed, count(*) AS n FROM e GROUP BY ALL",
)
def edge_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to topics that the graph's rules allow and that they refuse."""
    kind = F.when(F.col("p_size") % 3 == 0, "HAS_TOPIC").when(F.col("p_size") % 3 == 1, "ABOUT").otherwise("KNOWS")
    start = F.when(F.col("p_partkey") % 3 == 0, "Subject").when(F.col("p_partkey") % 3 == 1, "PastQuestion").otherwise("Topic")
    edges = table(spark, sf_dir, "part").select(kind.alias("type"), start.alias("start_label"), F.col("p_brand").alias("start_key"), F.lit("Topic").alias("end_label"), F.col("p_type").alias("end_key"))
    allowed, refused = graph.split_allowed(edges)
    both = allowed.select("type", "start_label", F.lit(True).alias("allowed")).unionByName(refused.select("type", "start_label", F.lit(False).alias("allowed")))
    return both.groupBy("type", "start_label", "allowed").agg(F.count(F.lit(1)).alias("n"))


@register(
    "neighbours_of_subjects",
    f"WITH {GRAPH_SQL}, s AS (SELECT DISTINCT subject FROM syll UNION SELECT subject FROM paper_subjects) SELECT subject, 'out' AS way, count(*) AS n FROM s JOIN edges ON a = subject GROUP BY subject UNION ALL SELECT subject, 'in', count(*) FROM s JOIN edges ON b = subject GROUP BY subject",
)
def neighbours_of_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes are one edge of any kind away from each subject, each way."""
    edges = stored_graph(spark, sf_dir, graph.kinds_at("Subject"))[1]
    return graph.degrees(edges, "Subject").select(F.col("key").alias("subject"), "way", "n")


@register(
    "appended_messages",
    """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role FROM conversations), c AS (SELECT *, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'unknown role' WHEN conv_id % 4 = 0 THEN 'unknown session' END AS reason FROM m)
    SELECT conv_id AS session_id, reason, count(*) AS n, max(CASE WHEN reason IS NULL THEN turn END) AS updated_at FROM c GROUP BY conv_id, reason""",
)
def appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that sessions take and that they refuse, with the time of the last one taken."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role")).alias("role"), "text", F.col("turn").alias("created_at"))
    sessions = said.select("session_id").distinct().where("session_id % 4 <> 0").withColumn("updated_at", F.lit(-1).cast("long"))
    accepted, rejected, moved = history.append_messages(sessions, said)
    taken = accepted.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(moved, "session_id").select("session_id", F.lit(None).cast("string").alias("reason"), "n", "updated_at")
    return taken.unionByName(rejected.groupBy("session_id", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("updated_at", F.lit(None).cast("long")))


@register(
    "nearest_whatever_score",
    f"""WITH {DENSE_CTES}, every AS (SELECT q.id AS query_id, d.id AS doc_id FROM (SELECT DISTINCT id FROM qe) q CROSS JOIN (SELECT DISTINCT id FROM de) d),
    dots AS (SELECT qe.id AS query_id, de.id AS doc_id, sum(qe.w * de.w) AS s FROM qe JOIN de USING (bucket) GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round(coalesce(s, 0e0), 6) + 0e0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0e0), 6) DESC, doc_id) AS rank FROM every LEFT JOIN dots USING (query_id, doc_id))
    SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 200""",
)
def nearest_whatever_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 nearest documents of each question, those that have nothing in common with it or point away too."""
    asked = dense.embed(questions(spark, sf_dir), id_col="query_id").withColumnRenamed("doc_id", "query_id")
    found = dense.dense_topk(asked, dense.embed(table(spark, sf_dir, "documents")), 200, id_col="doc_id", vector_col="vector")
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), (F.col("score") + F.lit(0.0)).alias("score"))


@register("scanned_collection", "SELECT lpad(vec_id::VARCHAR, 9, '0') AS chunk_id, label::VARCHAR AS collection FROM embeddings WHERE label = 3")
def scanned_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table.scan(stored_vectors(spark, sf_dir), "3")


@register("scanned_page", "SELECT lpad(vec_id::VARCHAR, 9, '0') AS chunk_id, label::VARCHAR AS collection FROM embeddings WHERE label = 3 AND vec_id > 99 ORDER BY vec_id LIMIT 20")
def scanned_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of twenty chunks, those after the last id of the page before."""
    return chunk_table.scan(stored_vectors(spark, sf_dir), "3", "000000099", 20)


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("chunk_id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))


@register(
    "indexed_in_batches",
    """WITH b AS (SELECT o_custkey, o_orderkey % 5 + 1 AS v, max(o_orderkey) AS k FROM orders GROUP BY ALL), last AS (SELECT o_custkey, max(v) AS v, arg_max(k, v) AS k FROM b GROUP BY o_custkey)
    SELECT 'c' || o_custkey AS chunk_id, (o_custkey % 3)::VARCHAR AS collection, 'order ' || k AS text FROM last WHERE NOT (o_custkey % 7 = 0 AND v < 3)""",
)
def indexed_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' latest orders as chunks, indexed in five batches, the third of which deletes some, with compactions in between."""
    import uuid

    orders = table(spark, sf_dir, "orders")
    path = f"{shared_folder(orders)}/corpuslake-growing-{uuid.uuid4().hex}"
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    for version in range(1, 6):
        batch = orders.where(F.col("o_orderkey") % 5 + 1 == version).groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
        new = batch.select(key.alias("chunk_id"), (F.col("o_custkey") % 3).cast("string").alias("collection"), F.concat(F.lit("order "), F.col("k").cast("string")).alias("text"))
        gone = orders.where("o_custkey % 7 = 0").select(key.alias("chunk_id")) if version == 3 else None
        versions.index_batch(new, path, version, deleted=gone, fan_in=2)
    return versions.read_index(spark, path)


@register(
    "checked_replies",
    """SELECT page_id AS document_id, CASE page_id % 6 WHEN 0 THEN 'past_question' WHEN 5 THEN 'past_question' END AS document_type, CASE WHEN page_id % 6 = 0 THEN url END AS title,
        CASE page_id % 6 WHEN 1 THEN 'topics is not a list of strings' WHEN 2 THEN 'questions is not a list of objects' WHEN 3 THEN 'chapters is not a list of objects' WHEN 4 THEN 'no JSON object' END AS error FROM pages""",
)
def checked_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about pages: lists of another shape are refused, and the type is the one that is known."""
    n, quoted = F.col("page_id") % 6, F.to_json(F.struct(F.col("url").alias("title"), F.lit("syllabus").alias("document_type")))
    inner = F.substring(quoted, 2, 1_000_000)
    raw = F.when(n == 0, F.concat(F.lit('```json\n{"topics": ["a", "b"], "questions": [{"n": 1}], "chapters": [], '), inner, F.lit("\n```")))
    raw = raw.when(n == 1, F.concat(F.lit('{"topics": "a", '), inner)).when(n == 2, F.concat(F.lit('{"questions": ["q"], '), inner)).when(n == 3, F.concat(F.lit('{"chapters": {"a": 1}, '), inner)).when(n == 4, "nothing").otherwise('{"subtopics": null}')
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"), raw.alias("raw"), F.lit("past_question").alias("document_type"))
    out = intake.parse_replies(rows, "title string, document_type string, topics array<string>, subtopics array<string>")
    return out.select("document_id", "reply.document_type", "reply.title", "error")
