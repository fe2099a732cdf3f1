from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_chunks():
    from tessera.operators.chunk import split_text

    text = "This is a test text to be split into chunks" * 2
    assert len(split_text(text, 20, 0)) == 5 and len(split_text(text, 30, 20)) == 6
    with pytest.raises(ValueError):
        split_text(text, 20, 21)
    long = "\n\n".join("word " * k for k in (5, 80, 400))
    assert all(len(c) <= 100 for c in split_text(long, 100, 10))
    assert "".join("".join(split_text(long, 100, 0)).split()) == "".join(long.split())


def test_header(spark):
    from tessera.operators.chunk import header_text

    row = spark.range(1).select(header_text(F.lit("T"), F.lit("p"), F.lit("link://https://example.com"), "x: ").alias("h"), header_text(F.lit(None), F.lit(""), F.lit("file://a"), "x: ").alias("n")).first()
    assert row.h == "x: <document_metadata>\nsourceDocument: T\npublished: p\nsource: https://example.com\n</document_metadata>\n\n" and row.n == "x: "


def test_functions(spark):
    from tessera.functions import text as X

    row = spark.range(1).select(
        X.word_count(F.lit("a  b ")), X.word_count(F.lit("")), X.json_value(F.lit('{"a": {"b": [1, 2, 3]}}'), "a.b[2]"), X.json_value(F.lit("no"), "a"),
        X.valid_url(F.lit("http://192.168.0.1/x")), X.valid_url(F.lit("http://127.0.0.1")), X.valid_url(F.lit("ftp://a.b")), X.middle_truncate(F.lit("abcdefghijklmn")),
        X.youtube_id(F.lit("https://youtu.be/abcdefghijk")), X.rounded_half_up(F.lit(-2.5)),
    ).first()
    assert list(row) == [4, 1, "3", "", False, True, False, "abcde...jklmn", "abcdefghijk", -2]


def test_templates(spark):
    from tessera.functions import templates as T

    presets = [("/a", "one $1 \\\\ "), ("/b-c", "two")]
    texts = ["/a x", "x /b-c", "say /a now", "x/a", "/RESET all", "", "no {y} {", "{x}{{x}{user.q}{}", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        T.expand_commands(F.col("t"), presets).alias("e"), T.fill_variables(F.col("t"), {"x": F.lit("{y}"), "y": F.lit("")}).alias("f")
    ).collect()
    assert [r.e for r in got[:5]] == ["one $1 \\\\ x", "xtwo", "sayone $1 \\\\ now", "x/a", "/reset"]
    assert [r.f for r in got[5:]] == ["", "no {y} {", "{y}{{x}[User q]{}", None] and got[8].e is None


def test_namespaces(spark):
    from tessera.functions import templates as T

    names = ["good_name", "-ab cd-", "a", "x" * 62 + "-yz", "1st", "ns_a b", "é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(*[f(F.col("n")) for f in (T.dashed_namespace, T.underscored_namespace, T.marked_namespace)]).collect()
    assert [r[0] for r in got[:6]] == ["good_name", "tessera-ab-cd", "tessera-a", "x" * 62, "1st", "ns_a-b"]
    assert [r[1] for r in got] == ["tessera_good_name", "tessera__ab_cd_", "tessera_a", "tessera_" + "x" * 62 + "_yz", "1st", "tessera_ns_a_b", "tessera__"]
    assert [r[2] for r in got[4:]] == ["ns_1st", "ns_a b", "ns__"]


def test_token_stream(spark):
    from tessera.operators.chat import fold_tokens

    rows = [("a", 1, "x", None, None, None), ("a", 2, "y", "", 7, None), ("a", 3, "z", "stop", None, 2), ("a", 4, "late", "stop", 9, 9), ("b", 1, "p", None, None, None), ("b", 2, "", None, None, None), ("c", 1, None, None, None, None)]
    made = spark.createDataFrame(rows, "k string, at int, token string, finish_reason string, prompt_tokens int, completion_tokens int")
    assert sorted(map(tuple, fold_tokens(made, "k", "at").collect())) == [("a", "xyz", 7, 2, True), ("b", "p", 0, 1, False), ("c", "", 0, 0, False)]


def test_similarity(spark):
    from tessera.operators.vector import similarity

    got = spark.createDataFrame([(0.25,), (1.0,), (1.7,), (-0.1,), (None,)], "d double").select(similarity(F.col("d")).alias("s")).collect()
    assert [round(r.s, 6) for r in got] == [0.75, 1.0, 1.0, 0.9, 0.0]


def test_sql_tool(spark):
    from tessera.plans.sql_tool import run_query

    spark.range(5).createOrReplaceTempView("numbers")
    assert run_query(spark, "WITH x AS (SELECT id FROM numbers WHERE id > 1) SELECT count(*) AS n FROM x;").first().n == 3
    for bad in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "INSERT INTO numbers SELECT 1", "SET a=b"):
        with pytest.raises(PermissionError):
            run_query(spark, bad)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_searches_take_every_20th_row_as_a_query(spark):
    import numpy as np

    from tessera.plans.catalogue import queries

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids, of = np.array([r.vec_id for r in rows]), np.array([r.label for r in rows])
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    nearest = {}
    for i in np.flatnonzero(ids % 20 == 0):
        same = np.flatnonzero(of == of[i])
        nearest[int(ids[i])] = sorted((round(1 - float(v[i] @ v[j]), 12), int(ids[j])) for j in same)
    q = queries()
    got = {(r.query_id, r.id): r.score for r in q["vector_topn"](spark, DATA).collect()}
    expected = {(i, j): 1 - d for i, x in nearest.items() for d, j in x[:4] if 1 - d >= 0.25}
    assert got.keys() == expected.keys() and all(abs(got[k] - min(expected[k], 1)) < 1e-5 for k in got)
    pinned = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    assert {tuple(r) for r in q["vector_search_pinned"](spark, DATA).collect()} == {(i, j) for i, x in nearest.items() for d, j in x[:4] if 1 - d >= 0.1 and j not in pinned}
    assert {tuple(r) for r in q["rerank_candidates"](spark, DATA).collect()} == {(i, j) for i, x in nearest.items() for _, j in x[: max(10, min(50, -(-len(x) // 10)))]}
    assert q["vector_distances"](spark, DATA).select("query_id", "id").distinct().count() == len(nearest) * len(ids)


def test_distances_of_blocks_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")

    from tessera.plans.catalogue import oracle_sql, queries

    v = [[((i * 37 + k * 11) % 23 - 11) / 7 for k in range(5)] for i in range(2100)]
    v[40], v[41], v[60], v[61] = [0.0] * 5, [0.0] * 5, None, None
    rows = [(i, x, i % 3) for i, x in enumerate(v)] + [(None, v[1], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = queries()["vector_distances"](spark, str(tmp_path))
    assert "zip_with" not in df._jdf.queryExecution().executedPlan().toString()  # no expression over each pair of rows
    named = ", ".join(df.columns)
    expected = con.sql(f"SELECT {named} FROM ({oracle_sql()['vector_distances']})").fetchall()
    assert len(expected) == 105 * 2101 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))


def test_distances_of_odd_vectors(spark):
    from tessera.operators.vector import distances

    made = lambda rows: spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {r.id: tuple(r)[2:] for r in distances(made([(1, [3.0, 4.0]), (2, [1.0]), (3, [1.0, None]), (4, None), (5, [0.0, 1.0])]), made([(9, [0.0, 2.0])])).collect()}
    assert got == {1: (1 - 0.8, 13**0.5, -8.0, 5.0), 2: (None,) * 4, 3: (None,) * 4, 4: (None,) * 4, 5: (0.0, 1.0, -2.0, 1.0)}
    empty = distances(made([(1, [])]), made([(2, [])])).first()
    assert tuple(empty) == (2, 1, None, 0.0, 0.0, None) and distances(made([]), made([])).count() == 0
    many = made([(i, [float(i)]) for i in range(2500)])
    n, low, high, total = distances(many, many).selectExpr("count(distinct query_id, id)", "min(l1)", "max(l1)", "sum(l1)").first()
    assert (n, low, high, total) == (2500 * 2500, 0.0, 2499.0, 2500 * (2500**2 - 1) / 3)
