"""Listings as the application shows them: parents included, checks of fields, visibility and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that a stored document has to have.
REQUIRED_FIELDS = ["name", "type", "url", "title", "docAuthor", "description", "docSource", "chunkSource", "published", "wordCount", "token_count_estimate"]
#: Origins whose documents can be watched whatever their title.
WATCHABLE = ["youtube", "confluence", "github", "gitlab", "drupalwiki"]
ROLES = ["default", "admin", "manager"]


def include(rows: DataFrame, parent: DataFrame, on: tuple[str, str], columns: dict[str, str], defaults: dict[str, object] | None = None, how: str = "left") -> DataFrame:
    """``rows`` with columns of a parent, new name to its own; ``defaults`` stand where there is no parent."""
    mine, theirs = on
    p = parent.select(F.col(theirs).alias("_on"), *(F.col(c).alias(n) for n, c in columns.items()))
    x = rows.join(p, F.col(mine) == F.col("_on"), how).drop("_on")
    for n, v in (defaults or {}).items():
        x = x.withColumn(n, F.coalesce(n, F.lit(v)))
    return x


def scoped(rows: DataFrame, **scope: object) -> DataFrame:
    """Rows of a scope; None asks for null."""
    for c, v in scope.items():
        rows = rows.filter(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return rows


def taken(rows: DataFrame, order: list[Column], limit: int | None = None, zero_is_all: bool = False) -> DataFrame:
    """The first rows; None is all of them and so, for some listings, is 0."""
    rows = rows.orderBy(*order)
    return rows if limit is None or zero_is_all and limit == 0 else rows.limit(limit)


def first(rows: DataFrame, key: str) -> DataFrame:
    """The row of the smallest key, so that the answer is always the same one."""
    return rows.orderBy(key).limit(1)


def clamped_limit(given: Column, default: int = 100) -> Column:
    """A limit from a request: a whole number, 1 at least; the default for what is none."""
    return F.greatest(F.lit(1), F.coalesce(F.floor(given.try_cast("double")).cast("int"), F.lit(default)))


def exchanged(messages: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Successful messages (sender, receiver, state) from ``a``, to ``b``, or between both either way."""
    ok = messages.filter("state = 'success'")
    if a is not None and b is not None:
        return ok.filter(((F.col("sender") == a) & (F.col("receiver") == b)) | ((F.col("sender") == b) & (F.col("receiver") == a)))
    return ok.filter(F.col("sender") == a if a is not None else F.col("receiver") == b) if a or b else ok


def visible(rows: DataFrame, members: DataFrame, user: Column | int, role: str, key: str = "id") -> DataFrame:
    """All rows for admins and managers, those of the user's memberships for others."""
    if role in ("admin", "manager"):
        return rows
    return rows.join(members.filter(F.col("user_id") == user).select(F.col("row_id").alias(key)), key, "left_semi")


def workspace_fields(name: Column, temperature: Column, history: Column, threshold: Column, top_n: Column, mode: Column, provider: Column, search: Column) -> dict[str, Column]:
    """Fields of a workspace put right: defaults for what can't be read, bounds for numbers; all are given as text."""
    number = lambda c: F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    whole = lambda c: F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return {
        "name": F.when(F.coalesce(name, F.lit("")) == "", "My Workspace").otherwise(F.substring(name, 1, 255)),
        "temperature": F.when(number(temperature) >= 0, number(temperature)),
        "history": F.greatest(F.lit(0), F.coalesce(whole(history), F.lit(20))),
        "threshold": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(number(threshold), F.lit(0.25)))),
        "top_n": F.greatest(F.lit(1), F.coalesce(whole(top_n), F.lit(4))),
        "mode": F.when(mode.isin("chat", "query"), mode).otherwise("chat"),
        "provider": F.when(~provider.isin("", "none"), provider),
        "search": F.when(search.isin("default", "rerank"), search).otherwise("default"),
    }


def user_problem(name: Column, role: Column, daily: Column, bio: Column) -> Column:
    """The first thing wrong with a user's fields, null if nothing."""
    limit = daily.try_cast("double")
    return (
        F.when(F.length(name) > 100, "Username cannot be longer than 100 characters").when(F.length(name) < 2, "Username must be at least 2 characters")
        .when(~name.rlike(r"^[a-z0-9_\-.]+$"), "Username can only hold lower case letters, numbers, periods, underscores and hyphens")
        .when(~role.isin(*ROLES), f"Invalid role. Allowed roles are: {', '.join(ROLES)}")
        .when(daily.isNotNull() & (limit.isNull() | F.isnan(limit) | (limit < 1)), "Daily message limit must be null or a number greater than or equal to 1")
        .when(F.length(bio) > 1000, "Bio cannot be longer than 1,000 characters")
    )


def has_required_fields(metadata: Column) -> Column:
    """Has a JSON object all fields of a stored document?"""
    return F.coalesce(F.size(F.array_intersect(F.json_object_keys(metadata), F.array(*map(F.lit, REQUIRED_FIELDS)))) == len(REQUIRED_FIELDS), F.lit(False))


def watchable(title: Column, source: Column) -> Column:
    other = F.substring_index(source, "://", 1).isin(*WATCHABLE) & F.contains(source, F.lit("://"))
    return F.coalesce((source.startswith("link://") & title.endswith(".html")) | other, F.lit(False))


def host_allowed(host: Column, allowlist: Column) -> Column:
    """Without a list every host is allowed; a list that can't be read allows none."""
    listed = F.when(F.try_parse_json(allowlist).isNotNull(), F.from_json(allowlist, "array<string>"))
    return F.when(F.coalesce(allowlist, F.lit("")) == "", True).otherwise(F.coalesce(F.array_contains(listed, host), F.lit(False)))


def normal_path(path: Column) -> Column:
    """A path without leading steps upwards; null for what tries to leave its folder or names none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(path), r"^(\.\.(/|\\|$))+", ""), r"/{2,}", "/")
    return F.when(~plain.isin("..", ".", "/", "") & ~plain.rlike(r"(^|/)\.\.(/|$)"), plain)


def within(outer: Column, inner: Column) -> Column:
    """Does a normal path lie below another one?"""
    base = F.regexp_replace(outer, "/+$", "")
    return (base != F.regexp_replace(inner, "/+$", "")) & inner.startswith(F.concat(base, F.lit("/"))) & ~inner.rlike(r"(^|/)\.\.(/|$)")


def rewritten(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows with columns set where the condition holds: soft deletes and edits alike."""
    return rows.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def forked(rows: DataFrame, thread: str, into: Column, up_to: Column, key: str) -> DataFrame:
    """``rows`` and a copy, under another thread, of the visible rows up to a key that didn't come by a programming interface."""
    copy = rows.filter((F.col(key) <= up_to) & F.col("include") & F.col("api_session").isNull()).withColumn(thread, into)
    return rows.unionByName(copy.select(*rows.columns))


def replaced(rows: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """``rows`` with everything of the scopes of ``new`` replaced by it."""
    return rows.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new.select(*rows.columns))


def claimed(invites: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(user_id, workspace_id) of claimed invites (user_id, workspace_ids as JSON), workspaces that are gone left out."""
    ids = F.explode(F.from_json("workspace_ids", "array<bigint>"))
    return invites.select("user_id", ids.alias("workspace_id")).join(workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi").distinct().select("user_id", "workspace_id")


def to_workspaces(documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(doc_id, workspace_id): documents with ``slugs``, comma-separated, in every workspace (id, slug) named."""
    x = documents.select("doc_id", F.explode(F.split("slugs", ",")).alias("_s")).select("doc_id", F.lower(F.trim("_s")).alias("slug")).filter("slug != ''")
    return x.join(workspaces.select(F.col("id").alias("workspace_id"), F.lower("slug").alias("slug")), "slug").select("doc_id", "workspace_id").distinct()


def document_flags(documents: DataFrame, pinned: DataFrame, watched: DataFrame, cached: DataFrame) -> DataFrame:
    """``name``, the workspaces in which a document is pinned, whether it is watched and whether its vectors are cached."""
    pins = pinned.groupBy("name").agg(F.array_sort(F.collect_set("workspace_id")).alias("pinned"))
    flag = lambda df, c: df.select("name").distinct().withColumn(c, F.lit(True))
    x = documents.join(pins, "name", "left").join(flag(watched, "watched"), "name", "left").join(flag(cached, "cached"), "name", "left")
    return x.select(*documents.columns, F.coalesce("pinned", F.array().cast("array<bigint>")).alias("pinned"), F.coalesce("watched", F.lit(False)).alias("watched"), F.coalesce("cached", F.lit(False)).alias("cached"))


def renamed_threads(turns: DataFrame, threads: DataFrame, default: str = "Thread", length: int = 22) -> DataFrame:
    """(thread_id, name): a thread of the default name with exactly one prompt is named after it, a longer one cut."""
    one = turns.groupBy("thread_id").agg(F.count(F.lit(1)).alias("_n"), F.min("prompt").alias("_p"))
    x = threads.join(one, "thread_id", "left")
    short = F.when(F.length("_p") > length, F.concat(F.substring("_p", 1, length), F.lit("..."))).otherwise(F.col("_p"))
    return x.select("thread_id", F.when((F.col("_n") == 1) & (F.col("name") == default), short).otherwise(F.col("name")).alias("name"))


def distinct_errors(rows: DataFrame, scope: str, error: str) -> DataFrame:
    """The different errors of a scope in one text."""
    return rows.filter(F.col(error).isNotNull()).groupBy(scope).agg(F.array_join(F.array_sort(F.collect_set(error)), ", ").alias("errors"))


def skills(default: DataFrame, disabled: DataFrame, *more: DataFrame) -> DataFrame:
    """Names of default skills that are not disabled, and all of the others."""
    out = default.select("name").exceptAll(disabled.select("name"))
    for m in more:
        out = out.unionByName(m.select("name"))
    return out


def toggled_watch(queue: DataFrame, documents: DataFrame, now: Column, stale_after_ms: int = 604_800_000) -> DataFrame:
    """The queue (filename, due) with one entry for each watched filename, whatever number of workspaces has it, and none of unwatched ones.

    ``documents``: filename, watched.
    """
    wish = documents.groupBy("filename").agg(F.max("watched").alias("watched"))
    x = queue.join(wish, "filename", "full").filter(F.coalesce("watched", F.lit(True)))
    return x.select("filename", F.coalesce("due", now + F.make_dt_interval(secs=F.lit(stale_after_ms / 1000))).alias("due"))


def sync_outcome(kind: Column, old: Column, new: Column, failures: Column, most: int = 5) -> Column:
    """What a run over a watched document does with it."""
    return (
        F.when(~kind.isin("link", *WATCHABLE) | kind.isNull(), "unwatch").when(F.coalesce(new, F.lit("")) == "", F.when(failures >= most, "unwatch").otherwise("failed"))
        .when(new == old, "exited").otherwise("success")
    )


def csv_export(rows: DataFrame, fixed: list[str], extra: str, order: str) -> DataFrame:
    """(place, line): a header of the fixed columns and of all keys of a map column, sorted, and a line for each row; values quoted, missing ones empty."""
    from .chat import csv_value

    keys = rows.select(F.explode(F.map_keys(extra)).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("keys"))
    x = rows.join(F.broadcast(keys))
    values = F.array(*(csv_value(F.col(c)) for c in fixed))
    more = F.transform("keys", lambda k: csv_value(F.try_element_at(F.col(extra), k)))
    head = keys.select(F.lit(None).cast("bigint").alias("place"), F.array_join(F.concat(F.array(*map(F.lit, fixed)), "keys"), ",").alias("line"))
    return head.unionByName(x.select(F.col(order).cast("bigint").alias("place"), F.array_join(F.concat(values, more), ",").alias("line")))


def json_rows(*columns: str) -> Column:
    """A row as an object of an array indented by four spaces."""
    parts = [F.concat(F.lit(f'        "{c}": '), F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")) for c in columns]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *parts), F.lit("\n    }"))
