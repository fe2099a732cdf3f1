"""Registered prompts: compression, history, context and JSON values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import templates
from ..functions import text as X
from ..operators import prompt, vector
from ..sources.tables import table
from .catalogue import _COS, _PAIRS, _SIM, query, vectors

_WORDS = "len(string_split({}, ' '))"


def _requests(s, d):
    """The last user turn of each conversation as a request, what was said before as its history."""
    c = table(s, d, "conversations")
    pairs = c.filter("role = 'user'").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("place"), F.col("text").alias("prompt"))
    last = pairs.groupBy("request_id").agg(F.max_by("prompt", "place").alias("user"), F.max("place").alias("last"))
    answers = c.filter("role = 'assistant'").select(F.col("conv_id").alias("request_id"), (F.col("turn") - 1).alias("place"), F.col("text").alias("response"))
    history = pairs.join(answers, ["request_id", "place"]).join(last.select("request_id", "last"), "request_id").filter("place < last").drop("last")
    return last.select("request_id", F.lit("You answer. Context: none").alias("system"), "user"), history


@query()
def compressed_messages(s, d):
    requests, history = _requests(s, d)
    x = prompt.compressed(requests, history, prompt.Window(700))
    return x.select("request_id", F.posexplode("messages").alias("place", "m")).select("request_id", "place", "m.role", "m.content")


@query()
def compressed_text(s, d):
    requests, history = _requests(s, d)
    return prompt.compressed(requests, history, prompt.Window(700), as_text=True)


# A request far under its window passes unchanged, one whose prompt is too long keeps that alone.
_WHOLE = """WITH l AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), u AS (SELECT c.conv_id AS request_id, c.text AS body, c.turn AS t FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.t),
h AS (SELECT p.conv_id AS request_id, p.turn, p.text AS prompt, a.text AS response FROM conversations p JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = p.turn + 1 AND a.role = 'assistant' JOIN u ON u.request_id = p.conv_id WHERE p.role = 'user' AND p.turn < u.t)"""


@query(_WHOLE + """, m AS (SELECT request_id, -1 AS turn, 'system' AS role, 'You answer. Context: none' AS content FROM u UNION ALL SELECT request_id, turn, 'user', prompt FROM h UNION ALL SELECT request_id, turn + 1, 'assistant', response FROM h UNION ALL SELECT request_id, t, 'user', body FROM u)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY turn) - 1 AS INTEGER) AS place, role, content FROM m""")
def uncompressed_messages(s, d):
    requests, history = _requests(s, d)
    x = prompt.compressed(requests, history, prompt.Window(10_000_000), messages=1000)
    return x.select("request_id", F.posexplode("messages").alias("place", "m")).select("request_id", "place", "m.role", "m.content")


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS tokens FROM documents")
def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", prompt.token_count(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN len(w) < 100 THEN text ELSE array_to_string(w[1:greatest(len(w) // 2 - CAST(floor((len(w) - 100) / 2 + 0.5) AS BIGINT), 0)], ' ') || chr(10) || chr(10) || '--prompt truncated for brevity--' || chr(10) || chr(10) ||
array_to_string(w[len(w) // 2 + CAST(floor((len(w) - 100) / 2 + 0.5) AS BIGINT) + 1:], ' ') END AS cut FROM (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents)""")
def middle_out(s, d):
    w = prompt.Window(100)

    @F.udf("string", useArrow=True)
    def cut(t):
        return None if t is None else w.middle_out(t, 100)

    return table(s, d, "documents").select("doc_id", cut("text").alias("cut"))


def _chats(s, d):
    c = table(s, d, "conversations")
    text = F.when(F.col("conv_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.concat(F.lit("re: "), F.col("turn").cast("string")).alias("text"), F.lit("chat").alias("type"))))
    return c.select("conv_id", "turn", F.when(F.col("turn") != 2, F.col("text")).alias("prompt"), text.alias("response"), F.timestamp_seconds(F.col("conv_id")).alias("created"), (F.col("turn") == 1).alias("score"))


@query("""SELECT conv_id, turn, part, CASE part WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE part WHEN 0 THEN text ELSE 're: ' || turn END AS content FROM conversations, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS part) WHERE conv_id % 5 <> 0 AND turn <> 2""")
def prompt_history(s, d):
    return prompt.prompt_history(_chats(s, d), ["conv_id", "turn"]).select("conv_id", "turn", "part", "role", "content")


@query("""SELECT conv_id * 100 + turn AS chat_id, conv_id AS sent_at, part, CASE part WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE part WHEN 0 THEN text ELSE 're: ' || turn END AS content, CASE part WHEN 1 THEN 'chat' END AS type, CASE part WHEN 1 THEN '[]' END AS sources,
CASE part WHEN 0 THEN '[]' END AS attachments, CASE part WHEN 1 THEN turn = 1 END AS score, CASE part WHEN 1 THEN '{}' END AS metrics FROM conversations, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS part) WHERE conv_id % 5 <> 0 AND turn <> 2""")
def shown_history(s, d):
    x = _chats(s, d).withColumn("id", F.col("conv_id") * 100 + F.col("turn"))
    return prompt.shown_history(x, "id", "created", "score")


@query("SELECT doc_id, left(text, 1000) || '...continued on in source document...' AS citation FROM documents")
def citations(s, d):
    return table(s, d, "documents").select("doc_id", prompt.citation(F.col("text")).alias("citation"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def attached_files(s, d):
    x = table(s, d, "documents").select("source", F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("location"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return prompt.attached_files(x, ["source"]).select("source", F.size("files").cast("long").alias("files"), "tokens")


def _context(s, d, driver):
    c = table(s, d, "conversations").withColumnRenamed("conv_id", "request_id")
    row = lambda where, place: c.filter(where).select("request_id", place.cast("long").alias("place"), (F.col("request_id") * 100 + F.col("turn") % 5).alias("id"), "text")
    t = F.col("turn")
    return prompt.assemble(c.select("request_id").distinct(), row("turn = 0", t), row("turn = 1", t), row("turn = 2", t), row("turn >= 2", 100 - t), prompt.DRIVERS[driver])


_PARTS = """WITH c AS (SELECT conv_id AS q, turn, conv_id * 100 + turn % 5 AS id, text FROM conversations), o AS (SELECT q, id, min(100 - turn) AS place, arg_min(text, 100 - turn) AS text FROM c WHERE turn >= 2 AND id NOT IN (SELECT id FROM c x WHERE x.q = c.q AND turn IN (0, 2)) GROUP BY q, id),
f AS (SELECT q, count(*) AS n FROM c WHERE turn = 2 GROUP BY q), b AS (SELECT o.*, row_number() OVER (PARTITION BY o.q ORDER BY place, id) + coalesce(f.n, 0) AS k FROM o LEFT JOIN f ON o.q = f.q),
e AS (SELECT q, 0 AS part, 'pin' AS origin, turn AS place, id, text FROM c WHERE turn = 0 {files} UNION ALL SELECT q, 2, 'search', turn, id, text FROM c WHERE turn = 2 {history})
SELECT q AS request_id, row_number() OVER (PARTITION BY q ORDER BY part, place, id) - 1 AS place, origin, id, text FROM e"""
_FILES, _OLD = "UNION ALL SELECT q, 1, 'file', turn, id, text FROM c WHERE turn = 1", "UNION ALL SELECT q, 3, 'history', place, id, text FROM b WHERE k <= 4"


@query(_PARTS.format(files=_FILES, history=_OLD))
def context_thread(s, d):
    return _context(s, d, "thread")


@query(_PARTS.format(files="", history=_OLD))
def context_api(s, d):
    return _context(s, d, "api")


@query(_PARTS.format(files="", history=""))
def context_completions(s, d):
    return _context(s, d, "completions")


@query("""SELECT conv_id AS request_id, CASE WHEN conv_id % 2 = 0 AND (conv_id % 14 NOT IN (SELECT label FROM embeddings) OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 3)) THEN CASE WHEN conv_id % 3 = 0 THEN 'no' ELSE 'There is no relevant information in this workspace to answer your query.' END END AS refusal FROM (SELECT DISTINCT conv_id FROM conversations)""")
def query_refusals(s, d):
    c = table(s, d, "conversations").withColumnRenamed("conv_id", "request_id")
    k = F.col("request_id")
    requests = c.select("request_id").distinct().select("request_id", (k % 14).cast("int").alias("namespace"), F.when(k % 2 == 0, "query").otherwise("chat").alias("mode"), F.when(k % 3 == 0, "no").alias("refusal_text"))
    return prompt.refused(requests, c.filter("turn >= 3"), vectors(s, d))


@query("SELECT doc_id, lower(left(text, 5)) AS summary FROM documents")
def summaries(s, d):
    return prompt.summarised(table(s, d, "documents"), lambda texts: [t[:5].lower() for t in texts])


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS.format(a="e.embedding", b="q.embedding")} AS dist, 1 / (1 + exp(-10 * list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))) AS x FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 20 = 0),
n AS (SELECT label, greatest(10, least(50, ceil(count(*) * 0.1))) AS m FROM embeddings GROUP BY label), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM s), k AS (SELECT c.*, CASE WHEN id % 6 = 0 THEN 0 ELSE x END AS rr FROM c JOIN n USING (label) WHERE r <= m),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, id) AS place FROM k) SELECT query_id, id, round(CASE WHEN rr = 0 THEN {_SIM} ELSE rr END, 6) AS score FROM t WHERE place <= 4 AND {_SIM} >= 0.25""")
def reranked_search(s, d):
    v = vectors(s, d)
    q = v.filter("id % 20 = 0")
    x = vector.candidates(v, q).join(v.select("id", F.col("vector").alias("_a")), "id").join(q.select(F.col("id").alias("query_id"), F.col("vector").alias("_b")), "query_id")
    score = F.when(F.col("id") % 6 == 0, 0.0).otherwise(X.sigmoid(10 * vector.dot(vector.as_doubles(F.col("_a")), vector.as_doubles(F.col("_b")))))
    return vector.rerank(x, score).select("query_id", "id", F.round("score", 6).alias("score"))


# --- JSON

_DOC = """'{"a": {"b": [1, {"c d": "x' || event_id || '"}], "n": null}, "t": "' || event_type || '", "f": true}'"""


def _doc():
    return F.concat(F.lit('{"a": {"b": [1, {"c d": "x'), F.col("event_id").cast("string"), F.lit('"}], "n": null}, "t": "'), F.col("event_type"), F.lit('", "f": true}'))


@query("SELECT event_id, 'x' || event_id AS nested, '1' AS number, event_type AS key, 'true' AS flag, CAST(NULL AS VARCHAR) AS missing, '' AS nothing, '' AS text FROM events")
def json_paths(s, d):
    j = _doc()
    paths = {"nested": "a.b[1]['c d']", "number": "a.b[0]", "key": '["t"]', "flag": "f", "missing": "a.z.q"}
    return table(s, d, "events").select("event_id", *(J.value_at(j, p).alias(n) for n, p in paths.items()), J.value_at(F.lit("{}"), "a").alias("nothing"), J.value_at(F.lit("no json"), "a").alias("text"))


@query("SELECT event_id, 'go ' || event_type || '/1/${a.none}' AS filled FROM events")
def json_substitution(s, d):
    return table(s, d, "events").select("event_id", J.substitute("go ${t}/${a.b[0]}/${a.none}", _doc()).alias("filled"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"k":' || event_id || '}' WHEN 1 THEN '{"k":' || event_id || '}' WHEN 2 THEN '[' || event_id || ']' ELSE NULL END AS json FROM events""")
def json_tolerant(s, d):
    e = F.col("event_id").cast("string")
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit('{"k": '), e, F.lit("}"))).when(k == 1, F.concat(F.lit("{k: "), e, F.lit(",}"))).when(k == 2, F.concat(F.lit("see ["), e, F.lit("] there"))).otherwise("nothing")
    return table(s, d, "events").select("event_id", J.tolerant(t).alias("json"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"big":"' || (event_id + 9007199254740992) || '","event_type":"' || event_type || '"}' AS json FROM events""")
def json_big_numbers(s, d):
    x = table(s, d, "events").select("event_id", (F.col("event_id") + 9007199254740992).alias("big"), "event_type")
    return x.select("event_id", J.stringify(x, "event_id", "big", "event_type").alias("json"))


@query("SELECT event_id, event_type AS a, 'new' AS b, CAST(NULL AS VARCHAR) AS c FROM events")
def json_merge(s, d):
    old = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("old"), F.lit("c"), F.lit("gone"))
    m = J.without_key(J.merged(old, F.create_map(F.lit("b"), F.lit("new"))), "c")
    return table(s, d, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("SELECT event_id, event_id % 3 <> 0 AS valid FROM events")
def chart_datasets(s, d):
    data = F.when(F.col("event_id") % 3 == 0, "[{bad").otherwise('[{"name": "a", "value": 1}]')
    return table(s, d, "events").select("event_id", J.is_json(data).alias("valid"))


@query("SELECT event_type AS meta_kind, value AS meta_inner_value, CAST(user_id AS VARCHAR) AS tags FROM events")
def flattened_objects(s, d):
    x = table(s, d, "events").select(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.struct("value", F.col("event_id").alias("id")).alias("inner")).alias("meta"), F.array(F.col("user_id").cast("string")).alias("tags"), F.array(F.struct("value")).alias("objects"))
    out = J.flattened(x)
    return out.withColumn("tags", F.array_join("tags", ","))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Missing name or arguments in function call.' WHEN 1 THEN 'Function name does not exist.' WHEN 2 THEN 'Missing required argument: query' WHEN 3 THEN 'Unknown argument: other provided but not in schema.' END AS problem FROM events""")
def tool_call_checks(s, d):
    k = F.col("event_id") % 5
    call = F.when(k == 0, '{"name": "find"}').when(k == 1, '{"name": "lost", "arguments": {}}').when(k == 2, '{"name": "find", "arguments": {"limit": 1}}').when(k == 3, '{"name": "find", "arguments": {"query": "a", "other": 2}}').otherwise('{"name": "find", "arguments": {"query": "a", "limit": 3}}')
    return table(s, d, "events").select("event_id", J.call_problem(call, {"find": (["query", "limit"], ["query"])}).alias("problem"))


@query("SELECT event_id, event_type || chr(10) || 'end' AS text, 'uploaded_image_0' AS name, CASE WHEN event_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime FROM events")
def message_parts(s, d):
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), url.cast("string").alias("url"))
    none = F.lit(None)
    parts = F.array(part("text", F.col("event_type"), none), part("image_url", none, F.when(F.col("event_id") % 2 == 0, "data:image/JPEG;base64,aa").otherwise("https://x/y")), part("text", F.lit("end"), none))
    x = table(s, d, "events").select("event_id", J.content_text(parts).alias("text"), J.attachments(parts)[0].alias("a"))
    return x.select("event_id", "text", "a.name", "a.mime")


# --- scalar functions


@query("SELECT event_id, strftime(ts, '%-I:%M:%S %p') AS long_time, strftime(ts, '%B %-d, %Y') AS long_date, strftime(ts, '%A, %B %-d, %Y %-I:%M %p') AS long_datetime, strftime(CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-05-06 17:08:09' ELSE to_timestamp(event_id)::TIMESTAMP END, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def time_formats(s, d):
    t, e = F.col("ts"), F.col("event_id")
    ms = F.when(e % 2 == 0, "soon").otherwise((e * 1000).cast("string"))
    now = F.lit("2024-05-06 17:08:09").cast("timestamp")
    return table(s, d, "events").select("event_id", X.long_time(t).alias("long_time"), X.long_date(t).alias("long_date"), X.long_datetime(t).alias("long_datetime"), X.shown_time(ms, now).alias("shown"), F.unix_timestamp("ts").alias("seconds"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] || upper(left(string_split(p_name, ' ')[2], 1)) || substr(string_split(p_name, ' ')[2], 2) || 'OfType' AS camel, replace(lower(p_name), ' ', '-') || '-dot-plus-bang' AS slug FROM part")
def names(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select("p_partkey", X.camel_case(F.concat(n, F.lit("-ofType"))).alias("camel"), X.workspace_slug(F.concat(n, F.lit(". + !"))).alias("slug"))


@query("SELECT event_id, round(1 / (1 + exp(-value)), 6) AS sigmoid, floor(value + 0.5) AS half_up, floor(event_id * 1000000 / 1e9) AS gb FROM events")
def numbers(s, d):
    return table(s, d, "events").select("event_id", F.round(X.sigmoid(F.col("value")), 6).alias("sigmoid"), X.rounded_half_up(F.col("value")).cast("double").alias("half_up"), X.gigabytes(F.col("event_id") * 1000000).cast("double").alias("gb"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '@agent,@x' ELSE '' END AS handles FROM conversations")
def agent_handles(s, d):
    t = F.when(F.col("turn") % 2 == 0, "@agent do  this\n@x now").otherwise("ask @agent")
    return table(s, d, "conversations").select("conv_id", "turn", F.array_join(X.agent_handles(t), ",").alias("handles"))


@query("SELECT page_id, CASE page_id % 4 WHEN 3 THEN NULL ELSE 'abcdefghij' || page_id % 10 END AS video FROM pages")
def youtube_ids(s, d):
    k, v = F.col("page_id") % 4, F.concat(F.lit("abcdefghij"), (F.col("page_id") % 10).cast("string"))
    url = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), v)).when(k == 1, F.concat(F.lit("https://www.youtube.com/watch?a=1&v="), v)).when(k == 2, F.concat(F.lit("https://youtube.com/shorts/"), v)).otherwise("https://example.com/")
    return table(s, d, "pages").select("page_id", X.youtube_id(url).alias("video"))


@query("SELECT conv_id, CAST(least(coalesce(CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id * 50 END, 1000), 1000) AS BIGINT) AS size FROM (SELECT DISTINCT conv_id FROM conversations)")
def chunk_sizes(s, d):
    from ..operators.chunk import chunk_size

    k = F.col("conv_id")
    return table(s, d, "conversations").select("conv_id").distinct().select("conv_id", chunk_size(F.when(k % 3 != 0, k * 50), 1000).cast("long").alias("size"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, prompt || ' at 3:04:05 PM' AS filled FROM p")
def template_time(s, d):
    from ..operators.chat import pair_turns

    now = F.lit("2024-01-02 15:04:05").cast("timestamp")
    x = pair_turns(table(s, d, "conversations"))
    return x.select("conv_id", "turn", F.concat("prompt", templates.fill_variables(F.lit(" at {time}"), {"time": X.long_time(now)})).alias("filled"))
