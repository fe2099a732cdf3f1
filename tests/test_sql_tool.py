from __future__ import annotations

import pytest

GOOD = [
    "SELECT count(*) FROM tool_t;",
    "WITH c AS (SELECT id FROM tool_t WHERE id IN (SELECT id FROM tool_t)) SELECT max(id), row_number() OVER (ORDER BY id) FROM c GROUP BY id HAVING sum(id) > 0 ORDER BY 1 LIMIT 3",
    "SELECT * FROM VALUES (1, 2) v(a, b) JOIN tool_t ON a = id",
    "SELECT x FROM tool_t LATERAL VIEW explode(array(1, 2)) e AS x",
    "SELECT -id, id % 2, id div 2, 'a' || id, id & 1, ~id, extract(year FROM date '2024-01-01'), position('a' IN 'ba'), substring('abc' FROM 2), trim(BOTH ' ' FROM ' a ') FROM tool_t WHERE id BETWEEN 1 AND 3 AND NOT id IN (7) AND 'a' LIKE 'a%' AND 'a' ILIKE 'A' AND id IS NOT NULL AND id <=> id AND 'x' RLIKE 'x' AND 'ab' LIKE ANY ('a%', 'b%')",
    "SELECT count(DISTINCT id), sum(id) FILTER (WHERE id > 1), CAST(id AS string), array(1, 2)[0], map('a', 1)['a'], current_date, ceil(1.5) FROM tool_t GROUP BY ROLLUP (id)",
    "SELECT CASE WHEN EXISTS (SELECT 1 FROM tool_t) THEN id END, id::string FROM tool_t UNION ALL SELECT 1, '2'",
]
BAD = [
    "SELECT * FROM text.`/etc/hostname`", "SELECT EXISTS (SELECT * FROM text.`/etc/passwd`)", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT id FROM tool_t WHERE reflect('java.lang.System', 'exit', 1) = 1", "DROP TABLE tool_t", "SELECT * FROM `/etc/x`", "WITH c AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM c",
    "SELECT * FROM read_files('/x')", "SELECT input_file_name() FROM tool_t", "INSERT INTO tool_t SELECT 1", "SELECT id FROM tool_t ORDER BY (SELECT max(value) FROM text.`/etc/passwd`)",
    "SELECT * FROM default.tool_t", "SELECT * FROM VALUES (java_method('a', 'b')) v", "SELECT transform(array(1), x -> java_method('a', 'b'))", "SELECT x FROM tool_t LATERAL VIEW java_method('a') e AS x",
    "SELECT sum(id) OVER (ORDER BY try_reflect('a', 'b')) FROM tool_t", "SELECT * FROM tool_t JOIN LATERAL (SELECT * FROM text.`/etc/passwd`)", "SET x = 1", "CACHE TABLE tool_t", "SELECT system.builtin.java_method('a', 'b')",
]


def test_queries_run_and_nothing_else(spark):
    from tessera.plans.sql_tool import check_query, run_enveloped, run_query

    spark.range(5).createOrReplaceTempView("tool_t")
    for q in GOOD:
        run_query(spark, q).collect()
    for q in BAD:
        with pytest.raises(PermissionError):
            check_query(spark, q)
    assert run_enveloped(spark, "SELECT id FROM tool_t", 2)["count"] == 2 and "DropTable" in run_enveloped(spark, "DROP TABLE tool_t")["error"]


def test_connections():
    from tessera.sources.connections import build, parse

    whole = "mssql://us%20er:pa%40ss@h1:1433,h2/my%20db?encrypt=true&a%20b=c"
    got = parse(whole, "mssql")
    assert got == {"scheme": "mssql", "username": "us er", "password": "pa@ss", "hosts": [{"host": "h1", "port": 1433}, {"host": "h2"}], "endpoint": "my db", "options": {"encrypt": "true", "a b": "c"}}
    assert build(got, "mssql") == whole and build(None, "x") == "x://localhost"
    assert parse("mssql://user@localhost:1433/mydb", "mssql")["password"] is None and parse("db://h")["options"] is None
    for bad, scheme in (("mysql://a/b", "mssql"), ("no scheme", "db")):
        with pytest.raises(ValueError):
            parse(bad, scheme)
