from __future__ import annotations

import random
from datetime import datetime, timedelta
from uuid import UUID, uuid5

import pytest
from pyspark.sql import functions as F


def test_files(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "a.txt").write_text("hello world")
    (tmp_path / "b.bin").write_bytes(bytes(range(32)) * 40)
    (tmp_path / "c.odd").write_text("plain")
    (tmp_path / "e.md").write_text("")
    x = files.read_files(spark, str(tmp_path))
    assert {r.name: r.kind for r in x.collect()} == {"a.txt": "text", "b.bin": None, "c.odd": "text"}
    docs = {r.title: r for r in files.text_documents(x).collect()}
    assert sorted(docs) == ["a.txt", "c.odd"] and docs["a.txt"].wordCount == 2 and docs["a.txt"].docSource == "a text file uploaded by the user."
    box = b"From a@b.cd Mon Jan  1 00:00:00 2024\nSubject: Re. your Mail\nFrom: a@b.cd\n\nbody one\n\nFrom x\nFrom: q@b.cd\n\nbody two\n\nFrom y\nSubject: none\n\n\n"
    got = files.mail_rows(spark.createDataFrame([("m.mbox", bytearray(box)), ("empty", None)], "name string, content binary"))
    titles = [r[0] for r in got.orderBy("item").select(files.mail_title(F.col("subject"), F.col("item"), F.col("name"))).collect()]
    assert titles == ["Re-your-Mail.mbox", "msg_2-m.mbox"]


def test_pages(spark):
    from tessera.sources import pages as P

    site = {
        "http://s/d/": '<a href="a">A</a><a class=x href=\'/d/b?q=1&amp;r=2\'>B</a><a href="/other/">o</a><a href="http://t/">t</a>',
        "http://s/d/a": '<a href="b2">b2</a><a href="/d/">home</a>', "http://s/d/b2": '<a href="deep">x</a>',
    }
    df = spark.createDataFrame(list(site.items()), "url string, html string")
    assert [r.url for r in P.crawl(df, "http://s/d/", 1).orderBy("place").collect()] == ["http://s/d/", "http://s/d/a", "http://s/d/b?q=1&r=2"]
    assert [r.url for r in P.crawl(df, "http://s/d/", 5).orderBy("place").collect()][2:] == ["http://s/d/b?q=1&r=2", "http://s/d/b2", "http://s/d/deep"]
    assert P.crawl(df, "http://s/d/", 5, 2).count() == 2 and P.crawl(df, "http://no/", 2).count() == 1
    row = spark.range(1).select(P.inner_text(F.lit("<head><title>t</title></head><p>a &amp;lt; b<br>c<script>x</script></p><!-- n --><ul><li> d </li></ul>")).alias("t"), P.selected(F.lit('<div class="k m" id=i>one <b>two</b></div><div class="k">x<div>y</div></div><p class=k>z'), "div.k").alias("s"), P.code_as_fences(F.lit('a<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[x=1]]></ac:plain-text-body></ac:structured-macro>b\n\n\n\nc')).alias("c")).first()
    assert row.t == "a &lt; b\nc\nd" and row.s == ["one two", "xy"] and row.c == "a\n```\nx=1\n```\nb\n\nc"


def test_links_of_pages_with_one_url(spark, tmp_path):
    from tessera.plans.catalogue import queries

    rows = [(1, "http://s/d/", '<a href="/a">A</a><a href="/b">B</a>'), (2, "http://s/d/", '<a href="/a">A</a><a href="/c">C</a><a href="/c">C</a>'), (3, "http://s/e", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries()["resolved_links"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, "http://s/a"), (1, 1, "http://s/b"), (2, 0, "http://s/a"), (2, 1, "http://s/c"), (2, 2, "http://s/c")]


def test_selected_titles_decode_what_their_sql_decodes(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")

    from tessera.plans.catalogue import oracle_sql, queries
    from tessera.sources.pages import selected

    titles = ["a &amp;&amp; b&amp", " token = &quot;x&quot;\n", "a &lt; b &gt; c&amp;lt;d", "one <b>two</b>\n three", "\tä€𝄞 &nbsp;", ""]
    rows = [(i, f"<p>é\n\nx<h1>{t}</h1>\n<p>y") for i, t in enumerate(titles)] + [(10, "<p>none"), (11, None), (12, "<h1>a</h1><h1>b</h1>"), (13, "")]
    df = spark.createDataFrame(rows, "page_id bigint, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, queries()["selected_titles"](spark, str(tmp_path)).collect())) == sorted(con.sql(oracle_sql()["selected_titles"]).fetchall())
    texts = df.select("page_id", selected(F.col("html"), "h1").alias("t")).orderBy("page_id").collect()
    assert [r.t for r in texts[:4]] == [["a && b&"], ['token = "x"'], ["a < b > c&lt;d"], ["one two\n three"]] and [r.t for r in texts[6:]] == [[], None, ["a", "b"], []]


def test_vector_store(spark, tmp_path):
    from tessera.operators import store

    s = store.VectorStore(spark, str(tmp_path / "v"))
    assert s.rows().count() == 0
    encode = store.hashing_encoder(32)
    docs = spark.createDataFrame([(1, "a", "red green blue"), (2, "b", "one two three"), (3, "c", None)], "doc_id bigint, location string, text string")
    s.add(store.vectorized(docs, None, encode).withColumn("namespace", F.lit("n")))
    s.remember("n", "the cat sat", encode, 9)
    found = s.search("n", "green red blue", encode, threshold=0.9)
    assert found.filter("rank = 1").first().doc_id == 1 and found.filter("rank = 1").first().score > 0.99
    s.delete(spark.createDataFrame([(1,), (77,)], "doc_id bigint"))
    assert sorted(r.doc_id for r in s.rows().collect()) == [2, 9] and s.search("none", "x", encode).count() == 0
    s.drop("nothing")
    with pytest.raises(ValueError):
        s.search("", "x", encode)
    s.reset()
    assert s.rows().count() == 0
    name = "https://é.example/x"
    assert spark.range(1).select(store.name_uuid(F.lit(name))).first()[0] == str(uuid5(UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8"), name))


def test_cooldown_and_debounce(spark):
    from tessera.operators import schedule

    r = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(i, r.choice("ab"), start + timedelta(seconds=r.randrange(400_000))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, at timestamp")
    cooled, first = [], []
    for k in "ab":
        last = before = None
        for i, _, t in sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0])):
            if last is None or (t - last).total_seconds() >= 7200:
                cooled.append((k, t))
                last = t
            if before is None or (t - before).total_seconds() >= 7200:
                first.append(i)
            before = t
    assert sorted(map(tuple, schedule.cooled_down(df, ["k"], "at", 7200).collect())) == sorted(cooled)
    assert sorted(x.id for x in schedule.debounced(df, ["k"], "at", 7200, "id").collect()) == sorted(first)


def test_hashing_encoder_does_not_cancel():
    from tessera.operators.store import hashing_encoder

    norms = [float((v * v).sum()) for v in hashing_encoder(16)(["In. The.", "a b c", "", " "])]
    assert [round(n, 9) for n in norms] == [1, 1, 0, 0]
