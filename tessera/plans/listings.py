"""Registered listings: parents included, checks of fields, visibility, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as X
from ..operators import listing, relational, schedule
from ..sources.tables import table
from .catalogue import query


@query("""SELECT o.o_orderkey, coalesce(c.c_name, 'unknown user') AS username, coalesce(n.n_name, 'unknown workspace') AS workspace FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def chats_with_embed_and_workspace(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0")
    x = listing.include(table(s, d, "orders"), c, ("o_custkey", "c_custkey"), {"username": "c_name", "nation": "c_nationkey"}, {"username": "unknown user"})
    x = listing.include(x, table(s, d, "nation"), ("nation", "n_nationkey"), {"workspace": "n_name"}, {"workspace": "unknown workspace"})
    return x.select("o_orderkey", "username", "workspace")


@query("SELECT event_id, coalesce(c_name, 'unknown user') AS username FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_id = c_custkey")
def event_logs_with_user(s, d):
    c = table(s, d, "customer").filter("c_acctbal > 0")
    return listing.include(table(s, d, "events"), c, ("user_id", "c_custkey"), {"username": "c_name"}, {"username": "unknown user"}).select("event_id", "username")


@query("SELECT e.event_id, a.c_name AS claimed_by, b.c_name AS created_by FROM events e LEFT JOIN customer a ON e.user_id = a.c_custkey LEFT JOIN customer b ON e.event_id % 2000 = b.c_custkey")
def invites_with_users(s, d):
    c = table(s, d, "customer")
    x = table(s, d, "events").withColumn("creator", F.col("event_id") % 2000)
    x = listing.include(x, c, ("user_id", "c_custkey"), {"claimed_by": "c_name"})
    return listing.include(x, c, ("creator", "c_custkey"), {"created_by": "c_name"}).select("event_id", "claimed_by", "created_by")


@query("SELECT s_suppkey, n_name AS workspace, 'default' AS role FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def workspace_user_details(s, d):
    return listing.include(table(s, d, "supplier"), table(s, d, "nation"), ("s_nationkey", "n_nationkey"), {"workspace": "n_name"}, how="inner").select("s_suppkey", "workspace", F.lit("default").alias("role"))


@query("""WITH d AS (SELECT doc_id, source AS name, lang, n_chars FROM documents), p AS (SELECT name, list_sort(list(DISTINCT doc_id % 7)) AS pinned FROM d WHERE lang = 'es' AND n_chars > 5000 GROUP BY name)
SELECT d.doc_id, array_to_string(coalesce(p.pinned, []), ',') AS pinned, EXISTS (SELECT 1 FROM d x WHERE x.name = d.name AND x.lang = 'de' AND x.n_chars > 5000) AS watched, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND false) AS cached FROM d LEFT JOIN p USING (name)""")
def documents_with_flags(s, d):
    x = table(s, d, "documents").select("doc_id", F.col("source").alias("name"), "lang", "n_chars")
    pinned = x.filter("lang = 'es' AND n_chars > 5000").select("name", (F.col("doc_id") % 7).alias("workspace_id"))
    out = listing.document_flags(x, pinned, x.filter("lang = 'de' AND n_chars > 5000"), x.filter("false"))
    return out.select("doc_id", F.array_join(F.transform("pinned", lambda v: v.cast("string")), ",").alias("pinned"), "watched", "cached")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus AS status, c.c_name AS owner FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_shipdate <= TIMESTAMP '1995-06-30'""")
def stale_queue_with_document(s, d):
    due = schedule.stale(table(s, d, "lineitem"), "l_shipdate", F.lit("1995-06-30").cast("timestamp"))
    x = listing.include(due, table(s, d, "orders"), ("l_orderkey", "o_orderkey"), {"status": "o_orderstatus", "cust": "o_custkey"}, how="inner")
    return listing.include(x, table(s, d, "customer"), ("cust", "c_custkey"), {"owner": "c_name"}).select("l_orderkey", "l_linenumber", "status", "owner")


@query("SELECT c_custkey, c_name AS thread, n_name AS workspace FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name), '0012') OR levenshtein(lower(c_name), '0012') <= 3")
def threads_found(s, d):
    x = table(s, d, "customer").filter(X.fuzzy_match(F.col("c_name"), "0012")).withColumnRenamed("c_name", "thread")
    return listing.include(x, table(s, d, "nation"), ("c_nationkey", "n_nationkey"), {"workspace": "n_name"}, how="inner").select("c_custkey", "thread", "workspace")


@query("SELECT o_orderkey, c_name AS username FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC")
def prompt_history_with_user(s, d):
    x = table(s, d, "orders").filter("o_orderstatus = 'P'")
    return listing.include(x, table(s, d, "customer"), ("o_custkey", "c_custkey"), {"username": "c_name"}).orderBy(F.desc("o_orderdate")).select("o_orderkey", "username")


@query("SELECT source, count(*) AS documents FROM documents GROUP BY source")
def documents_per_workspace(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT source AS docpath, array_to_string(list_sort(list(DISTINCT lang)), ',') AS workspaces FROM documents GROUP BY source")
def workspaces_per_path(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("docpath")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("workspaces"))


@query("SELECT DISTINCT l_partkey AS doc_id FROM lineitem")
def distinct_documents(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("doc_id")).distinct()


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS errors FROM events WHERE event_type <> 'view' GROUP BY user_id")
def unique_errors(s, d):
    x = table(s, d, "events").withColumn("error", F.when(F.col("event_type") != "view", F.col("event_type")))
    return listing.distinct_errors(x, "user_id", "error")


@query("SELECT event_id FROM events WHERE CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END IS NULL AND user_id = 8")
def default_thread_chats(s, d):
    x = table(s, d, "events").withColumn("thread", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    return listing.scoped(x, thread=None, user_id=8).select("event_id")


@query("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, 'S' || s_suppkey % 3 AS a, 'S' || c_custkey % 3 AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000) WHERE (a = 'S1' AND b = 'S2') OR (a = 'S2' AND b = 'S1')")
def conversation_between(s, d):
    x = table(s, d, "supplier").join(table(s, d, "customer"), F.col("s_nationkey") == F.col("c_nationkey"))
    side = lambda c: F.concat(F.lit("S"), (F.col(c) % 3).cast("string"))
    m = x.select("s_suppkey", "c_custkey", side("s_suppkey").alias("sender"), side("c_custkey").alias("receiver"), F.when(F.col("s_acctbal") > 5000, "success").otherwise("error").alias("state"))
    return listing.exchanged(m, "S1", "S2").select("s_suppkey", "c_custkey")


@query("SELECT doc_id, lang FROM documents WHERE 'title:' || source || '-timestamp:' || CASE WHEN doc_id % 5 = 0 THEN lang END IS DISTINCT FROM 'title:src0-timestamp:en'")
def pinned_by_identifier(s, d):
    x = table(s, d, "documents").withColumn("identifier", X.source_identifier(F.col("source"), F.when(F.col("doc_id") % 5 == 0, F.col("lang"))))
    pins = s.range(1).select(X.source_identifier(F.lit("src0"), F.lit("en")).alias("identifier"))
    return x.join(pins, "identifier", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents")
def without_content(s, d):
    """Omitted columns: the scan doesn't read the texts."""
    return table(s, d, "documents").drop("text", "n_chars")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'My Workspace' ELSE left(repeat(event_type, 60), 255) END AS name, CASE WHEN value >= 3 THEN value - 3 END AS temperature,
CASE WHEN user_id % 5 = 0 THEN 20 ELSE greatest(user_id - 10, 0) END AS history, CASE WHEN user_id % 7 = 0 THEN 0.25 ELSE least(1.0, greatest(0.0, value / 10 - 0.2)) END AS threshold,
CASE WHEN user_id % 3 = 0 THEN 4 ELSE greatest(1, user_id - 5) END AS top_n, CASE WHEN event_type = 'click' THEN 'query' ELSE 'chat' END AS mode, CASE WHEN event_type NOT IN ('view') THEN event_type END AS provider, 'default' AS search FROM events""")
def workspace_fields(s, d):
    v, u, t = F.col("value"), F.col("user_id"), F.col("event_type")
    word = F.lit("abc")
    fields = listing.workspace_fields(
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.repeat(t, 60)), (v - 3).cast("string"), F.when(u % 5 == 0, word).otherwise((u - 10).cast("string")), F.when(u % 7 == 0, word).otherwise((v / 10 - 0.2).cast("string")),
        F.when(u % 3 != 0, (u - 5).cast("string")), F.when(t == "click", "query").otherwise(t), F.when(t == "view", "none").otherwise(t), t,
    )
    return table(s, d, "events").select("event_id", *(c.alias(n) for n, c in fields.items()))


@query("""SELECT c_custkey, CASE WHEN length(n) > 100 THEN 'Username cannot be longer than 100 characters' WHEN length(n) < 2 THEN 'Username must be at least 2 characters'
WHEN NOT regexp_full_match(n, '[a-z0-9_\\-.]+') THEN 'Username can only hold lower case letters, numbers, periods, underscores and hyphens'
WHEN c_custkey % 11 = 0 THEN 'Invalid role. Allowed roles are: default, admin, manager' WHEN c_custkey % 13 = 0 THEN 'Daily message limit must be null or a number greater than or equal to 1' END AS problem
FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN c_name WHEN 2 THEN repeat('ab', 60) ELSE replace(lower(c_name), '#', '_') END AS n FROM customer)""")
def user_problems(s, d):
    k = F.col("c_custkey")
    n = F.when(k % 5 == 0, "x").when(k % 5 == 1, F.col("c_name")).when(k % 5 == 2, F.repeat(F.lit("ab"), 60)).otherwise(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")))
    daily = F.when(k % 13 == 0, "0").when(k % 2 == 0, "12")
    return table(s, d, "customer").select("c_custkey", listing.user_problem(n, F.when(k % 11 == 0, "owner").otherwise("admin"), daily, F.lit("")).alias("problem"))


@query("SELECT doc_id, doc_id % 4 <> 0 AS complete FROM documents")
def required_metadata(s, d):
    names = [f for f in listing.REQUIRED_FIELDS if f != "published"]
    whole = F.concat(F.lit("{"), *(F.lit(f'"{f}": 1, ') for f in names), F.lit('"more": 2'), F.when(F.col("doc_id") % 4 == 0, "").otherwise(', "published": null'), F.lit("}"))
    return table(s, d, "documents").select("doc_id", listing.has_required_fields(whole).alias("complete"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN ends_with(url, '.html') WHEN 1 THEN true ELSE false END AS watchable FROM pages")
def watchable_pages(s, d):
    kind = F.when(F.col("page_id") % 4 == 0, "link://").when(F.col("page_id") % 4 == 1, "github://").when(F.col("page_id") % 4 == 2, "file://")
    return table(s, d, "pages").select("page_id", listing.watchable(F.col("url"), F.concat(kind, "url")).alias("watchable"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE h IN ('ththre.example.com', 'ththan.example.com') END AS allowed FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h FROM pages)""")
def allowed_hosts(s, d):
    listed = F.when(F.col("page_id") % 3 == 1, "[not json").when(F.col("page_id") % 3 == 2, '["ththre.example.com", "ththan.example.com"]')
    return table(s, d, "pages").select("page_id", listing.host_allowed(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1), listed).alias("allowed"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey = 5)")
def visible_workspaces(s, d):
    members = table(s, d, "supplier").select(F.col("s_nationkey").alias("row_id"), F.col("s_suppkey").alias("user_id"))
    n = table(s, d, "nation").withColumnRenamed("n_nationkey", "id")
    return listing.visible(n, members, 5, "default").select(F.col("id").alias("n_nationkey"), "n_name")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'documents/' || CAST(page_id AS VARCHAR) END AS path, page_id % 3 <> 0 AS inside FROM pages")
def normal_paths(s, d):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/../../"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("../../documents//"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("documents/"), F.col("page_id").cast("string")))
    x = table(s, d, "pages").select("page_id", listing.normal_path(given).alias("path"))
    return x.withColumn("inside", F.coalesce(listing.within(F.lit("documents"), F.col("path")), F.lit(False)))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN greatest(1, CAST(floor(value) AS INTEGER)) ELSE 100 END AS lim FROM events")
def clamped_limits(s, d):
    e = F.col("event_id") % 4
    given = F.when(e == 0, "abc").when(e == 1, "-5").when(e == 2, F.col("value").cast("string"))
    return table(s, d, "events").select("event_id", listing.clamped_limit(given).alias("lim"))


@query("SELECT n_nationkey FROM nation UNION ALL (SELECT n_nationkey + 100 FROM nation ORDER BY n_nationkey DESC LIMIT 3)")
def taken_rows(s, d):
    n = table(s, d, "nation").select("n_nationkey")
    last = listing.taken(n, [F.desc("n_nationkey")], 3).select((F.col("n_nationkey") + 100).alias("n_nationkey"))
    return listing.taken(n, [F.asc("n_nationkey")], 0, zero_is_all=True).unionByName(last)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1")
def first_order(s, d):
    return listing.first(relational.where(table(s, d, "orders"), [relational.Eq("o_orderstatus", "F")]), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def pages_in_order(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return x.select("conv_id", F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))


@query("SELECT 'time' AS key, 'system' AS kind UNION ALL SELECT 'date', 'system' UNION ALL SELECT lower(n_name), 'user' FROM nation")
def prompt_variables(s, d):
    own = table(s, d, "nation").select(F.lower("n_name").alias("key"), F.lit("user").alias("kind"))
    return s.createDataFrame([("time", "system"), ("date", "system")], "key string, kind string").unionByName(own)


@query("SELECT DISTINCT c_nationkey AS id, c_mktsegment AS name FROM customer WHERE c_mktsegment ILIKE '%build%'")
def search_without_repeats(s, d):
    return table(s, d, "customer").filter(X.fuzzy_match(F.col("c_mktsegment"), "build")).select(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("name")).distinct()


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT r_name FROM region UNION ALL SELECT 'flow_' || s_suppkey FROM supplier WHERE s_acctbal > 0")
def agent_skills(s, d):
    n = table(s, d, "nation").withColumnRenamed("n_name", "name")
    flows = table(s, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("flow_"), F.col("s_suppkey").cast("string")).alias("name"))
    return listing.skills(n, n.filter("n_regionkey = 0"), table(s, d, "region").withColumnRenamed("r_name", "name"), flows)


@query("SELECT DISTINCT p_partkey AS doc_id, n_nationkey AS workspace_id FROM part JOIN nation ON lower(n_name) IN ('nation_' || p_size % 25, 'nation_' || p_size % 7)")
def uploaded_to_workspaces(s, d):
    size = F.col("p_size")
    docs = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit(" Nation_"), (size % 25).cast("string"), F.lit(",NATION_"), (size % 7).cast("string"), F.lit(" , none")).alias("slugs"))
    return listing.to_workspaces(docs, table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("slug")))


@query("SELECT event_id, event_id % 6 <> 0 AS include, CASE WHEN event_id % 6 = 0 THEN 'gone' ELSE event_type END AS event_type FROM events")
def invalidated_chats(s, d):
    x = table(s, d, "events").select("event_id", "event_type").withColumn("include", F.lit(True))
    return listing.rewritten(x, F.col("event_id") % 6 == 0, include=F.lit(False), event_type=F.lit("gone"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'new ' || event_type AS text FROM events""")
def edited_response(s, d):
    x = table(s, d, "events").select("event_id", J.with_value(F.col("props"), "text", F.concat(F.lit("new "), "event_type")).alias("j"))
    return x.select("event_id", J.value_at(F.col("j"), "k").alias("k"), J.value_at(F.col("j"), "['text']").alias("text"))


@query("SELECT event_id, user_id AS thread FROM events UNION ALL SELECT event_id, 1000 + user_id FROM events WHERE event_id <= user_id * 100 AND event_id % 5 <> 0 AND event_id % 7 <> 0")
def forked_thread(s, d):
    x = table(s, d, "events").select("event_id", F.col("user_id").alias("thread"), (F.col("event_id") % 5 != 0).alias("include"), F.when(F.col("event_id") % 7 == 0, "api").alias("api_session"))
    return listing.forked(x, "thread", F.col("thread") + 1000, F.col("thread") * 100, "event_id").select("event_id", "thread")


@query("SELECT s_nationkey AS workspace, s_suppkey AS member FROM supplier WHERE s_nationkey NOT IN (1, 2) UNION ALL SELECT n_nationkey, 7 FROM nation WHERE n_nationkey IN (1, 2)")
def replaced_members(s, d):
    old = table(s, d, "supplier").select(F.col("s_nationkey").alias("workspace"), F.col("s_suppkey").alias("member"))
    new = table(s, d, "nation").filter("n_nationkey IN (1, 2)").select(F.col("n_nationkey").alias("workspace"), F.lit(7).cast("long").alias("member"))
    return listing.replaced(old, new, "workspace")


@query("SELECT DISTINCT c_custkey AS user_id, n_nationkey AS workspace_id FROM customer JOIN nation ON n_nationkey IN (c_nationkey, c_custkey % 40)")
def claimed_invites(s, d):
    ids = F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit(", "), (F.col("c_custkey") % 40).cast("string"), F.lit("]"))
    return listing.claimed(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), ids.alias("workspace_ids")), table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


@query("SELECT c_custkey FROM customer WHERE c_name NOT IN ('Customer#000000003', 'Customer#000000005') AND c_custkey NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def deleted_in_bulk(s, d):
    gone = s.createDataFrame([("Customer#000000003",), ("Customer#000000005",)], "c_name string")
    x = relational.without(table(s, d, "customer"), gone, "c_name")
    return relational.without(x, table(s, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("""WITH n AS (SELECT conv_id, count(*) AS n, min(text) AS p FROM conversations WHERE role = 'user' GROUP BY conv_id), t AS (SELECT DISTINCT conv_id FROM conversations)
SELECT t.conv_id AS thread_id, CASE WHEN n = 1 AND t.conv_id % 5 <> 0 THEN CASE WHEN length(p) > 22 THEN left(p, 22) || '...' ELSE p END WHEN t.conv_id % 5 = 0 THEN 'Mine' ELSE 'Thread' END AS name FROM t LEFT JOIN n USING (conv_id)""")
def renamed_threads(s, d):
    c = table(s, d, "conversations").withColumnRenamed("conv_id", "thread_id")
    threads = c.select("thread_id").distinct().withColumn("name", F.when(F.col("thread_id") % 5 == 0, "Mine").otherwise("Thread"))
    return listing.renamed_threads(c.filter("role = 'user'").select("thread_id", F.col("text").alias("prompt")), threads)


@query("""SELECT filename, CASE WHEN old THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-08' END AS due FROM (SELECT source AS filename, bool_or(n_chars > 20000) AS w, bool_or(lang = 'de' AND n_chars > 5000) AS old FROM documents GROUP BY source) WHERE w""")
def watched_queue(s, d):
    x = table(s, d, "documents").withColumnRenamed("source", "filename")
    queue = x.filter("lang = 'de' AND n_chars > 5000").select("filename").distinct().withColumn("due", F.lit("2024-01-01").cast("timestamp"))
    return listing.toggled_watch(queue, x.select("filename", (F.col("n_chars") > 20000).alias("watched")), F.lit("2024-02-01").cast("timestamp"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'unwatch' WHEN doc_id % 10 = 2 THEN CASE WHEN doc_id % 7 >= 5 THEN 'unwatch' ELSE 'failed' END WHEN doc_id % 10 = 3 OR text = '' THEN CASE WHEN text = '' THEN CASE WHEN doc_id % 7 >= 5 THEN 'unwatch' ELSE 'failed' END ELSE 'success' END ELSE 'exited' END AS outcome FROM documents")
def sync_outcomes(s, d):
    k, t = F.col("doc_id") % 10, F.col("text")
    kind, new = F.when(k == 1, "ftp").otherwise("github"), F.when(k == 2, F.lit(None)).when((k == 3) & (t != ""), F.concat(t, F.lit("!"))).otherwise(t)
    return table(s, d, "documents").select("doc_id", listing.sync_outcome(kind, t, new, F.col("doc_id") % 7).alias("outcome"))


@query("""WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN props END AS a, CASE WHEN event_id % 3 = 0 THEN 'say "hi"' || chr(10) || 'x' END AS b FROM events), q AS (SELECT event_id, '"' || event_id || '"' AS i, '"' || event_type || '"' AS t,
'"' || replace(replace(coalesce(a, ''), '"', '""'), chr(10), ' ') || '"' AS qa, '"' || replace(replace(coalesce(b, ''), '"', '""'), chr(10), ' ') || '"' AS qb FROM x)
SELECT CAST(NULL AS BIGINT) AS place, 'event_id,event_type,note,props' AS line UNION ALL SELECT event_id, i || ',' || t || ',' || qb || ',' || qa FROM q""")
def export_csv_headers(s, d):
    e = F.col("event_id")
    more = F.map_from_entries(F.filter(F.array(F.struct(F.lit("props").alias("k"), F.when(e % 2 == 0, F.col("props")).alias("v")), F.struct(F.lit("note").alias("k"), F.when(e % 3 == 0, F.lit('say "hi"\nx')).alias("v"))), lambda p: p["v"].isNotNull()))
    return listing.csv_export(table(s, d, "events").withColumn("more", more), ["event_id", "event_type"], "more", "event_id")


@query("""SELECT c_custkey, '    {' || chr(10) || '        "c_custkey": ' || c_custkey || ',' || chr(10) || '        "c_name": "' || c_name || '"' || chr(10) || '    }' AS line FROM customer""")
def export_json(s, d):
    return table(s, d, "customer").select("c_custkey", listing.json_rows("c_custkey", "c_name").alias("line"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'API' WHEN c_custkey IS NULL THEN 'unknown user' ELSE c_name END AS username, CASE o_orderstatus WHEN 'F' THEN 'GOOD' WHEN 'O' THEN 'BAD' ELSE '--' END AS rating FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_custkey % 3 = 1""")
def export_rows(s, d):
    o = table(s, d, "orders").withColumn("user", F.when(F.col("o_custkey") % 3 == 1, F.col("o_custkey"))).withColumn("score", F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False))
    x = listing.include(o, table(s, d, "customer"), ("user", "c_custkey"), {"name": "c_name"})
    name = F.coalesce("name", F.when(F.col("o_custkey") % 3 == 0, "API").otherwise("unknown user"))
    return x.select("o_orderkey", name.alias("username"), F.when(F.col("score").isNull(), "--").when(F.col("score"), "GOOD").otherwise("BAD").alias("rating"))


@query()
def cooldown(s, d):
    return schedule.cooled_down(table(s, d, "events"), ["user_id"], "ts", 6 * 3600)
