"""Read-only SQL for callers that are not trusted.

A statement is parsed, not run, and every node of its tree has to be known:
queries only, over views of the session by their plain names, with functions of
the list below.  Files by path, catalogs, calls into Java and functions that tell
of the machine are refused wherever they stand, subqueries included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_PLANS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union", "Intersect", "Except", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedWith", "UnresolvedHaving", "Window", "WithWindowDefinition", "Generate", "LocalRelation",
    "Range", "UnresolvedTableValuedFunction", "LateralJoin", "Pivot", "Unpivot", "BaseGroupingSets", "Tail",
}
_FUNCTIONS = set(
    """between ilike div mod negative positive
    abs acos add_months any any_value approx_count_distinct array array_contains array_distinct array_join array_max array_min array_position array_size array_sort array_union
    asin atan avg bool_and bool_or cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist
    current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear degrees dense_rank element_at endswith every
    exists exp extract factorial filter first first_value flatten floor format_number forall from_json from_unixtime get_json_object greatest hour if ifnull initcap instr isnan isnotnull isnull
    json_object_keys kurtosis lag last last_day last_value lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by
    md5 mean median min min_by minute mod mode month months_between named_struct now ntile nullif nvl nvl2 percent_rank percentile percentile_approx pi pmod position pow power quarter radians
    rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right rlike round row_number rpad rtrim second sequence sha1 sha2 sign
    sin size skewness slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg listagg struct substr substring substring_index sum tan to_date to_json
    to_timestamp transform translate trim trunc try_add try_cast try_divide try_element_at try_to_number try_to_timestamp typeof unix_timestamp upper var_pop var_samp variance weekday weekofyear
    when width_bucket year zip_with aggregate reduce grouping grouping_id nth_value bround try_avg try_sum date_from_unix_date timestamp_seconds to_char to_number""".split()
)
_TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "stack", "range", "json_tuple"}


def _items(seq: object) -> Iterator[object]:
    for i in range(seq.size()):
        yield seq.apply(i)


def _names(seq: object) -> list[str]:
    return [str(x) for x in _items(seq)]


def check_query(spark: SparkSession, sql: str) -> None:
    """Raise ``PermissionError`` unless the parsed statement is a query of known parts over views of the session."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    known = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    left, used = [(plan, True)], []
    while left:
        node, is_plan = left.pop()
        kind = node.getClass().getSimpleName()
        if is_plan:
            if node.nodeName() not in _PLANS:
                raise PermissionError(f"only queries may be run, this has {node.nodeName()}")
            if kind == "UnresolvedRelation":
                used.append(_names(node.multipartIdentifier()))
            elif kind == "UnresolvedTableValuedFunction":
                _allow(_names(node.name()), _TABLE_FUNCTIONS)
            elif kind == "UnresolvedWith":
                for x in _items(node.innerChildren()):
                    known.add(str(x.alias()).lower())
            elif kind == "Generate":
                left.append((node.generator(), False))
            left += [(x, True) for x in _items(node.children())]
            left += [(x, "plans.logical" in x.getClass().getName() or kind == "UnresolvedWith") for x in _items(node.innerChildren())]
            left += [(x, False) for x in _items(node.expressions())]
        else:
            if kind == "UnresolvedFunction":
                _allow(_names(node.nameParts()), _FUNCTIONS | _TABLE_FUNCTIONS)
            elif kind == "UnresolvedGenerator":
                _allow(_names(node.name().nameParts()) if hasattr(node.name(), "nameParts") else [node.name().funcName()], _TABLE_FUNCTIONS)
            elif kind in ("CallMethodViaReflection", "TryReflect"):
                raise PermissionError("calls into Java may not be made")
            if "SubqueryExpression" in [c.getSimpleName() for c in _ancestors(node)]:
                left.append((node.plan(), True))
            left += [(x, False) for x in _items(node.children())]
    for parts in used:
        if len(parts) != 1 or parts[0].lower() not in known:
            raise PermissionError(f"not a view of this session: {'.'.join(parts)}")


def _ancestors(node: object) -> Iterator[object]:
    c = node.getClass()
    while c is not None:
        yield c
        c = c.getSuperclass()


def _allow(parts: list[str], names: set[str]) -> None:
    if len(parts) != 1 or parts[0].lower() not in names:
        raise PermissionError(f"not an allowed function: {'.'.join(parts)}")


def run_query(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    """The result of a query, cut to ``rows`` where the caller asks for it."""
    sql = re.sub(r";\s*$", "", sql.strip())
    check_query(spark, sql)
    out = spark.sql(sql)
    return out if rows is None else out.limit(rows)


def run_enveloped(spark: SparkSession, sql: str, rows: int = 1000) -> dict:
    """``rows`` (at most so many), their ``count`` and ``error`` (null if there is none), as a tool returns them."""
    try:
        found = [r.asDict(recursive=True) for r in run_query(spark, sql, rows).collect()]
        return {"rows": found, "count": len(found), "error": None}
    except Exception as e:
        return {"rows": [], "count": 0, "error": str(e).splitlines()[0]}


def probe(spark: SparkSession) -> bool:
    """Does the connection answer?"""
    return spark.sql("SELECT 1").first()[0] == 1


def tables(spark: SparkSession) -> DataFrame:
    """``name`` of the session's views."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)
    return spark.createDataFrame([(n,) for n in names], "name string")


def columns(spark: SparkSession, view: str) -> DataFrame:
    """``name`` and ``type`` of a view's columns, in order."""
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(spark.table(view).dtypes)], "place int, name string, type string")
