"""The registered queries: a Spark plan and the same in SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import templates, text as X
from ..operators import chat, chunk, relational, schedule, vector
from ..sources.tables import table
from .sql_tool import run_query

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    for name in ("listings", "prompts", "corpus", "imports"):
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("namespace"), F.col("embedding").alias("vector"))


# --- vectors

_SIM = "CASE WHEN dist IS NULL THEN 0.0 WHEN dist >= 1.0 THEN 1.0 WHEN dist < 0 THEN 1 - abs(dist) ELSE 1 - dist END"
_COS = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


# Every row whose id is divisible by 20 is a query, against all rows.
_EACH = f"SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS.format(a='e.embedding', b='q.embedding')} AS dist FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 20 = 0"
_RANKED = f"WITH s AS ({_EACH}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM s)"


@query(f"{_RANKED} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round({_SIM}, 6) AS score FROM r WHERE rank <= 4 AND {_SIM} >= 0.25")
def vector_topn(s, d):
    v = vectors(s, d)
    return vector.search_many(v, v.filter("id % 20 = 0")).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"{_RANKED} SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round({_SIM}, 6) AS score FROM r WHERE rank <= 4 AND {_SIM} >= 0.25")
def vector_topn_expressions(s, d):
    """The same in built-in expressions, without Python."""
    v = vectors(s, d)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "namespace", F.col("vector").alias("query"))
    return vector.search(v, q).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(f"{_RANKED} SELECT query_id, id FROM r WHERE rank <= 4 AND {_SIM} >= 0.1 AND id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def vector_search_pinned(s, d):
    v = vectors(s, d)
    pinned = table(s, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return vector.search_many(v, v.filter("id % 20 = 0"), threshold=0.1, pinned=pinned).select("query_id", "id")


@query("""SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS l2,
round(-list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS inner_product, round(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: abs(CAST(e.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))), 6) AS l1
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q""")
def vector_distances(s, d):
    v = vectors(s, d).select("id", "vector")
    return vector.distances(v, v.filter("id % 20 = 0"), digits=6)


@query("""SELECT vec_id AS id, round(CASE WHEN n = 0 THEN v[1] ELSE v[1] / n END, 6) AS first, round(CASE WHEN n = 0 THEN v[len(v)] ELSE v[len(v)] / n END, 6) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)""")
def vector_normalize(s, d):
    n = F.col("n")
    return vectors(s, d).select("id", vector.normalize(vector.as_doubles(F.col("vector"))).alias("n")).select("id", F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, -1), 6).alias("last"))


@query(f"SELECT event_id, round({_SIM.replace('dist', 'x')}, 6) AS score FROM (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value / 10 - 1 END AS x FROM events)")
def distance_to_similarity(s, d):
    x = F.when(F.col("user_id") % 7 == 0, None).otherwise(F.col("value") / 10 - 1)
    return table(s, d, "events").select("event_id", F.round(vector.similarity(x), 6).alias("score"))


@query(f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS ({_EACH}),
r AS (SELECT query_id, id, greatest(10, least(50, ceil(c.n * 0.1))) AS m, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM s JOIN c USING (label))
SELECT query_id, id FROM r WHERE r <= m""")
def rerank_candidates(s, d):
    v = vectors(s, d)
    return vector.candidates(v, v.filter("id % 20 = 0")).select("query_id", "id")


@query("SELECT label AS namespace, count(*) AS vectors FROM embeddings GROUP BY GROUPING SETS ((label), ())")
def namespace_counts(s, d):
    return vectors(s, d).rollup("namespace").agg(F.count(F.lit(1)).alias("vectors"))


# --- documents and text


@query(r"SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS words, CAST(len(regexp_split_to_array(text, '\s+')) AS INTEGER) AS words_any FROM documents")
def doc_word_count(s, d):
    return table(s, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.word_count_any_space(F.col("text")).alias("words_any"))


@query("SELECT doc_id, CASE WHEN floor(length(text) * 2 / 1024) >= 10 THEN CAST(ceil(length(text) / 8) AS BIGINT) END AS tokens FROM documents")
def doc_token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query()
def chunk_documents(s, d):
    return chunk.chunk_documents(table(s, d, "documents").select("doc_id", "text"))


@query("""SELECT page_id, 'doc: ' || '<document_metadata>' || chr(10) || 'sourceDocument: page ' || page_id || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'source: ' || url ELSE '' END || chr(10) || '</document_metadata>' || chr(10) || chr(10) AS header FROM pages""")
def chunk_header(s, d):
    source = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("link://"), "url")).otherwise(F.concat(F.lit("file://"), "url"))
    return table(s, d, "pages").select("page_id", chunk.header_text(F.concat(F.lit("page "), F.col("page_id").cast("string")), F.lit(""), source, "doc: ").alias("header"))


@query(r"""SELECT page_id, coalesce(h <> '' AND NOT (regexp_matches(h, '^(192|172|10|127)\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$') AND h NOT IN ('127.0.0.1', '0.0.0.0')), false) AS valid FROM (SELECT page_id, regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1) AS h FROM pages)""")
def url_validity(s, d):
    return table(s, d, "pages").select("page_id", X.valid_url(F.col("url")).alias("valid"))


@query(r"SELECT p_partkey, replace(lower(p_name || ' and ' || p_type), ' ', '-') AS slug, regexp_replace(p_name || ':' || p_type, '[<>:\"/\\|?*]', '', 'g') AS filename, '/' || lower(regexp_replace(p_name, '[^a-zA-Z0-9_-]', '-', 'g')) AS command FROM part")
def slugify(s, d):
    n, t = F.col("p_name"), F.col("p_type")
    return table(s, d, "part").select("p_partkey", X.slug(F.concat(n, F.lit(" & "), t)).alias("slug"), X.safe_filename(F.concat(n, F.lit(":"), t)).alias("filename"), X.command(n).alias("command"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR levenshtein(lower(p_name), 'ring') <= 3")
def fuzzy_search(s, d):
    return table(s, d, "part").filter(X.fuzzy_match(F.col("p_name"), " Ring ")).select("p_partkey", "p_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(s, d):
    return table(s, d, "events").select("event_id", X.json_value(F.col("props"), "k").alias("k"))


@query("SELECT c_custkey, left(c_name, 5) || '...' || right(c_name, 5) AS short, left(c_name, 22) AS cut FROM customer WHERE length(c_name) > 5")
def text_truncation(s, d):
    return table(s, d, "customer").filter(F.length("c_name") > 5).select("c_custkey", X.middle_truncate(F.col("c_name")).alias("short"), F.substring("c_name", 1, 22).alias("cut"))


@query("SELECT page_id, string_split(url, '://')[1] AS type, substr(url, instr(url, '://') + 3) AS source FROM pages")
def chunk_source(s, d):
    return table(s, d, "pages").select("page_id", X.chunk_source(F.col("url")).alias("x")).select("page_id", "x.type", "x.source")


@query("SELECT d.doc_id, 'title:' || d.source || '-timestamp:' || CAST(l.quality AS VARCHAR) AS identifier FROM documents d LEFT JOIN labels l USING (doc_id)")
def source_identifiers(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return x.select("doc_id", X.source_identifier(F.col("source"), F.col("quality").cast("string")).alias("identifier"))


@query("SELECT sha256(event_type || ':' || CAST(user_id AS VARCHAR)) AS key, min(event_id) AS first_event FROM events GROUP BY 1")
def dedupe_hash(s, d):
    return table(s, d, "events").groupBy(F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 256).alias("key")).agg(F.min("event_id").alias("first_event"))


@query("SELECT doc_id, floor(doc_id / 500) AS batch FROM documents")
def insert_batches(s, d):
    return relational.batches(table(s, d, "documents").select("doc_id"), "doc_id", 500).select("doc_id", F.col("batch").cast("double").alias("batch"))


@query("SELECT p.page_id FROM pages p WHERE sha256(p.html) <> sha256(CASE WHEN p.page_id % 3 = 0 THEN p.html || ' ' ELSE p.html END)")
def changed_documents(s, d):
    p = table(s, d, "pages")
    new = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("new"))
    return p.join(new, "page_id").filter(F.sha2("html", 256) != F.sha2("new", 256)).select("page_id")


@query("""SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)""")
def page_links(s, d):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


# --- listings, joins, counts

_ORDER = "o_orderdate DESC, o_orderkey"


@query("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) > 60 AS has_pages FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_listing(s, d):
    return relational.page(table(s, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 20).select("o_orderkey", "o_custkey", F.col("has_more").alias("has_pages"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice <= 100000 AND o_custkey <> 7 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filtered_listing(s, d):
    since = datetime(1995, 1, 1)
    clauses = [relational.Eq("o_orderstatus", "F"), relational.Among("o_orderpriority", ("1-URGENT", "5-LOW")), relational.Compare("o_totalprice", "<=", 100000.0), relational.Compare("o_custkey", "!=", 7), relational.Compare("o_orderdate", ">=", since)]
    return relational.where(table(s, d, "orders"), clauses).select("o_orderkey")


@query("SELECT o.o_orderkey, coalesce(c.c_name, 'unknown user') AS username, coalesce(n.n_name, 'deleted workspace') AS workspace FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
def listing_enriched(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    x = table(s, d, "orders").join(c, "o_custkey", "left").join(n, "c_nationkey", "left")
    return x.select("o_orderkey", F.coalesce("c_name", F.lit("unknown user")).alias("username"), F.coalesce("n_name", F.lit("deleted workspace")).alias("workspace"))


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < -900)")
def members_semi(s, d):
    c = table(s, d, "customer").filter("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(s, d, "nation").join(c, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_members_anti(s, d):
    return relational.without(table(s, d, "customer"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT o.o_orderkey FROM orders o WHERE o.o_custkey IN (SELECT c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_name = 'NATION_3')")
def semi_through_parent(s, d):
    n = table(s, d, "nation").filter("n_name = 'NATION_3'").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(s, d, "customer").join(n, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def relation_count(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count()
    return table(s, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("count", F.lit(0)).alias("orders"))


@query("SELECT round(coalesce(sum(value), 0), 2) AS total, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events WHERE user_id < 0")
def sum_null_zero(s, d):
    return table(s, d, "events").filter("user_id < 0").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("SELECT n_nationkey, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS users FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def collect_members(s, d):
    c = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",").alias("users"))
    return table(s, d, "nation").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("users", F.lit("")).alias("users"))


@query("SELECT n.n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n.n_nationkey) AS threads, (SELECT count(*) FROM supplier WHERE s_nationkey = n.n_nationkey) AS chats FROM nation n")
def workspace_counts(s, d):
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("threads"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("chats"))
    return table(s, d, "nation").join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").select("n_nationkey", F.coalesce("threads", F.lit(0)).alias("threads"), F.coalesce("chats", F.lit(0)).alias("chats"))


@query("SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def same_file_others(s, d):
    x = table(s, d, "supplier")
    return x.alias("a").join(x.alias("b"), F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey != b.s_suppkey")).select(F.col("a.s_suppkey").alias("s_suppkey"), F.col("b.s_suppkey").alias("other"))


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) IN (SELECT lower(trim(x)) FROM (SELECT unnest(string_split(' nation_1, NATION_3,nation_9', ',')) AS x))")
def slug_list_join(s, d):
    slugs = s.createDataFrame([(" nation_1, NATION_3,nation_9",)], "v string").select(F.explode(F.split("v", ",")).alias("x")).select(F.lower(F.trim("x")).alias("slug"))
    return table(s, d, "nation").withColumn("slug", F.lower("n_name")).join(slugs, "slug", "left_semi").select("n_nationkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_anti(s, d):
    return relational.without(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_ids(s, d):
    return table(s, d, "documents").select("doc_id").intersect(table(s, d, "labels").filter("quality = 1").select("doc_id"))


@query("SELECT 0 AS id, 'Default Thread' AS name UNION ALL SELECT n_nationkey + 1, n_name FROM nation")
def default_thread_union(s, d):
    return s.createDataFrame([(0, "Default Thread")], "id int, name string").unionByName(table(s, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name")))


@query("SELECT coalesce(a.k, b.k) AS label, coalesce(b.v, a.v) AS value FROM (SELECT n_name AS k, 'old' AS v FROM nation) a FULL JOIN (SELECT 'NATION_' || CAST(r_regionkey * 10 AS VARCHAR) AS k, r_name AS v FROM region) b ON a.k = b.k")
def upsert_settings(s, d):
    old = table(s, d, "nation").select(F.col("n_name").alias("label"), F.lit("old").alias("value"))
    new = table(s, d, "region").select(F.concat(F.lit("NATION_"), (F.col("r_regionkey") * 10).cast("string")).alias("label"), F.col("r_name").alias("value"))
    return relational.upsert(old, new, "label", "value")


@query("SELECT conv_id, turn, NOT (conv_id % 5 = 0 AND turn >= 2) AS include FROM conversations")
def soft_delete(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", (~((F.col("conv_id") % 5 == 0) & (F.col("turn") >= 2))).alias("include"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id = 1 AND turn >= 2) UNION ALL SELECT 1000000 + conv_id, turn FROM conversations WHERE conv_id = 2 AND turn <= 1")
def fork_and_delete(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    return c.filter("NOT (conv_id = 1 AND turn >= 2)").unionByName(c.filter("conv_id = 2 AND turn <= 1").withColumn("conv_id", F.col("conv_id") + 1000000))


@query("SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality = 1 END AS score, CASE WHEN l.quality IS NULL THEN '--' WHEN l.quality = 1 THEN 'GOOD' ELSE 'BAD' END AS rating FROM documents d LEFT JOIN labels l USING (doc_id)")
def feedback_rating(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", relational.feedback(F.col("quality")).alias("score"))
    return x.withColumn("rating", F.when(F.col("score").isNull(), "--").when(F.col("score"), "GOOD").otherwise("BAD"))


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS success, count(*) FILTER (WHERE quality = 0) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def status_report(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("success"), F.count_if(F.col("quality") == 0).alias("failed"))


@query("SELECT DISTINCT n_name AS branch, CASE WHEN n_name = 'NATION_7' THEN 0 ELSE 1 END AS place FROM nation")
def branch_order(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("branch"), F.when(F.col("n_name") == "NATION_7", 0).otherwise(1).alias("place")).distinct().orderBy("place", "branch")


@query("SELECT event_id, CASE WHEN value BETWEEN 0 AND 1 THEN value ELSE 0.25 END AS threshold, CASE WHEN user_id >= 1 THEN user_id ELSE 4 END AS top_n, greatest(1, least(value, 100)) AS bounded FROM events")
def parameter_fallbacks(s, d):
    v, u = F.col("value"), F.col("user_id")
    return table(s, d, "events").select("event_id", F.when(v.between(0, 1), v).otherwise(0.25).alias("threshold"), F.when(u >= 1, u).otherwise(4).alias("top_n"), F.greatest(F.lit(1.0), F.least(v, F.lit(100.0))).alias("bounded"))


# --- conversations


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def recent_k(s, d):
    return chat.recent(table(s, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "text")


_PAIRS = "p AS (SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"


@query(f"WITH {_PAIRS} SELECT * FROM p")
def pair_turns(s, d):
    return chat.pair_turns(table(s, d, "conversations"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n = 1")
def first_message(s, d):
    x = table(s, d, "conversations").filter("role = 'user'")
    return x.groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, '"' || conv_id || '","' || replace(replace(prompt, '"', '""'), chr(10), ' ') || '","' || replace(replace(response, '"', '""'), chr(10), ' ') || '"' AS line FROM p""")
def export_csv(s, d):
    x = chat.pair_turns(table(s, d, "conversations"))
    return x.select("conv_id", "turn", chat.csv_lines(x, ["conv_id", "prompt", "response"]).alias("line"))


@query(f"""WITH {_PAIRS} SELECT conv_id, count(*) * 2 + 1 AS messages, string_agg(prompt || chr(1) || response, chr(2) ORDER BY turn) AS joined FROM p GROUP BY conv_id""")
def export_jsonl_groups(s, d):
    x = chat.pair_turns(table(s, d, "conversations")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "prompt", "response"))).alias("m"))
    return x.select("conv_id", (F.size("m") * 2 + 1).cast("long").alias("messages"), F.array_join(F.transform("m", lambda t: F.concat(t.prompt, F.lit("\x01"), t.response)), "\x02").alias("joined"))


@query()
def export_jsonl(s, d):
    x = chat.pair_turns(table(s, d, "conversations")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "prompt", "response"))).alias("m"))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit("Given the following conversation, answer the last question.").alias("content")))
    pairs = F.flatten(F.transform("m", lambda t: F.array(F.struct(F.lit("user").alias("role"), t.prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), t.response.alias("content")))))
    return x.select("conv_id", F.to_json(F.struct(F.concat(system, pairs).alias("messages"))).alias("line"))


@query(f"WITH {_PAIRS} SELECT 'Answer.' AS instruction, prompt AS input, response AS output FROM p")
def export_alpaca(s, d):
    return chat.pair_turns(table(s, d, "conversations")).select(F.lit("Answer.").alias("instruction"), F.col("prompt").alias("input"), F.col("response").alias("output"))


@query("""SELECT source, doc_id FROM (SELECT d.source, d.doc_id, coalesce(sum(n_chars // 4) OVER (PARTITION BY d.source ORDER BY d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1) WHERE t < 2000""")
def pinned_budget(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id").withColumn("tokens", F.floor(F.col("n_chars") / 4))
    return chat.within_budget(x, ["source"], ["doc_id"], "tokens", 2000).select("source", "doc_id")


@query("""WITH f AS (SELECT conv_id AS q, conv_id * 10 + turn AS id, turn AS place FROM conversations WHERE turn < 2), h AS (SELECT conv_id AS q, conv_id * 10 + turn % 4 AS id, 10 - turn AS age FROM conversations WHERE turn >= 2 AND role <> 'system'),
e AS (SELECT q, id, 0 AS part, place FROM f UNION ALL SELECT q, id, 1, age FROM h), m AS (SELECT q, id, min(part * 1000 + place) AS k FROM e GROUP BY q, id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k, id) AS n FROM m)
SELECT q AS query_id, id, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 4 OR k < 1000""")
def source_backfill(s, d):
    c = table(s, d, "conversations")
    found = c.filter("turn < 2").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("turn").alias("place"))
    old = c.filter("turn >= 2 AND role != 'system'").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 10 + F.col("turn") % 4).alias("id"), (10 - F.col("turn")).alias("age"), F.lit(1.0).alias("score"), "text")
    return chat.fill_sources(found, old).select("query_id", "id", "rank")


@query("""SELECT doc_id, CASE WHEN len(w) < 40 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:greatest(CAST(floor(len(w) / 2) - floor((len(w) - 40) / 2 + 0.5) AS BIGINT), 0)], ' ') || chr(10) || chr(10) || '--prompt truncated for brevity--' || chr(10) || chr(10) || array_to_string(w[CAST(floor(len(w) / 2) + floor((len(w) - 40) / 2 + 0.5) AS BIGINT) + 1:], ' ') END AS cut FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def cannonball_words(s, d):
    return table(s, d, "documents").select("doc_id", chat.cannonball(F.split("text", " ", -1), 40).alias("cut"))


@query("SELECT conv_id, string_agg('[CONTEXT ' || turn || ']:' || chr(10) || text || chr(10) || '[END CONTEXT ' || turn || ']' || chr(10) || chr(10), '' ORDER BY turn) AS block FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations) GROUP BY conv_id")
def context_block(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t.text).alias("t"))
    return x.select("conv_id", chat.context_block(F.col("t")).alias("block"))


@query("SELECT conv_id, CAST(sum(ceil(length(text) / 4)) AS BIGINT) + 3 * count(*) + 5 AS tokens FROM conversations GROUP BY conv_id")
def token_stats(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(chat.token_stats(F.sum(F.ceil(F.length("text") / 4)), F.count(F.lit(1))).alias("tokens"))


@query("SELECT event_id, user_id + event_id AS total_tokens, CASE WHEN value > 0 THEN round(event_id / value, 4) END AS tps FROM events")
def llm_metrics(s, d):
    return table(s, d, "events").select("event_id", (F.col("user_id") + F.col("event_id")).alias("total_tokens"), F.when(F.col("value") > 0, F.round(F.col("event_id") / F.col("value"), 4)).alias("tps"))


# --- schedules


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - 1 AS earlier FROM events")
def quota_24h(s, d):
    return table(s, d, "events").select("event_id", schedule.earlier_within(["user_id"], "ts", 86400).alias("earlier"))


@query("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts - b >= INTERVAL 30 MINUTES")
def debounce(s, d):
    return schedule.debounced(table(s, d, "events"), ["event_type"], "ts", 1800, "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7 DAYS <= TIMESTAMP '2024-01-20'")
def stale_scan(s, d):
    x = table(s, d, "events").withColumn("due", schedule.next_due(F.col("ts"), F.lit(604800000)))
    return schedule.stale(x, "due", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT user_id, count(*) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 2 AND event_type IN ('error', 'click') GROUP BY user_id HAVING count(*) >= 2")
def consecutive_failures(s, d):
    return schedule.failing(table(s, d, "events"), ["user_id"], "ts", "event_id", F.col("event_type").isin("error", "click"), 2)


# --- templates and token streams


@query("""SELECT p_partkey, 'say hello about ' || p_name || '. /brief' AS expanded,
'Part ' || p_name || ' {unknown} [User zip] of ' || p_type AS filled FROM part""")
def prompt_templates(s, d):
    n = F.col("p_name")
    presets = [("/greet", "say hello about "), ("/brief", "Be brief.")]
    return table(s, d, "part").select(
        "p_partkey",
        templates.expand_commands(F.concat(F.lit("/greet "), n, F.lit(". /brief")), presets).alias("expanded"),
        templates.fill_variables(F.lit("Part {name} {unknown} {user.zip} of {type}"), {"name": n, "type": F.col("p_type")}).alias("filled"),
    )


@query("""SELECT p_partkey, regexp_replace(regexp_replace(p_type || p_name, '[^a-zA-Z0-9_-]', '-', 'g')[1:63], '[_-]$', '') AS dashed,
'tessera_' || regexp_replace(p_type || p_name, '[^a-zA-Z0-9_]', '_', 'g') AS underscored, 'ns_' || regexp_replace(p_type || p_name, '[^a-zA-Z0-9_]', '_', 'g') AS marked FROM part""")
def namespace_names(s, d):
    n = F.concat("p_type", "p_name")
    return table(s, d, "part").select("p_partkey", templates.dashed_namespace(n).alias("dashed"), templates.underscored_namespace(n).alias("underscored"), templates.marked_namespace(n).alias("marked"))


@query("""WITH c AS (SELECT *, min(CASE WHEN role = 'assistant' AND turn >= 3 THEN turn END) OVER (PARTITION BY conv_id) AS e FROM conversations), x AS (SELECT * FROM c WHERE e IS NULL OR turn <= e)
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS reply, CAST(0 AS BIGINT) AS prompt_tokens, CAST(coalesce(max(CASE WHEN turn = 2 THEN length(text) END), count(*) FILTER (WHERE text != '')) AS BIGINT) AS completion_tokens, bool_or(e IS NOT NULL) AS closed FROM x GROUP BY conv_id""")
def token_stream(s, d):
    c = table(s, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("token"), F.expr("CASE WHEN role = 'assistant' AND turn >= 3 THEN 'stop' END").alias("finish_reason"),
        F.lit(None).cast("int").alias("prompt_tokens"), F.expr("CASE WHEN turn = 2 THEN length(text) END").alias("completion_tokens"),
    )
    return chat.fold_tokens(c, "conv_id", "turn")


# --- guarded SQL


def _tool(name: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            table(s, d, t).createOrReplaceTempView(t)
        return run_query(s, sql)

    run.__name__ = name
    query(sql)(run)


_tool("sql_tool_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_tool("sql_tool_q3", "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10")
_tool("sql_tool_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_tool("sql_tool_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
