from __future__ import annotations

import json
import random
import subprocess

from pyspark.sql import functions as F


def test_ignored_as_git_does(spark, tmp_path):
    from tessera.sources import repositories as R

    r = random.Random(5)
    paths = sorted({"/".join(r.choice(["a", "b", "c.md", "d[1]", "x y", "build", "#h", "ab.log", "!k"]) for _ in range(r.randrange(1, 5))) for _ in range(150)})
    sets = [
        ["*.md", "!c.md"], ["build/", "/a"], ["a/**/b"], ["a/*"], ["**/b/x y"], ["d\\[1\\]", "\\#h"], ["# no", "", "  ", "a?.log"], ["[!a-b]"], ["[ab]"], ["/a/b", "!/a/b/c.md"], ["**"], ["a/**"], ["!a", "b"], ["\\!k"], ["*", "!*/", "!*.md"], ["a//b"], ["x y   "],
    ]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for lines in sets:
        (tmp_path / ".gitignore").write_text("\n".join(lines) + "\n")
        said = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths) + "\0", capture_output=True, text=True).stdout
        want = {p for p in said.split("\0") if p}
        got = {x.p for x in df.filter(R.ignored(F.col("p"), lines)).collect()}
        assert got == want, (lines, got ^ want)


def test_repository_documents(spark):
    from tessera.sources import repositories as R

    files = spark.createDataFrame([("a.md", "x y"), ("s/b.md", "z"), ("e.md", ""), ("n.md", None)], "path string, content string")
    assert [(r.url, r.title, r.wordCount) for r in R.repository_files(files, "me", "gitlab", ["s/"]).collect()] == [("gitlab://a.md", "a.md", 2)]
    assert [r.title for r in R.repository_files(files, "me", recursive=False).collect()] == ["a.md"]
    one = spark.range(1)
    text = R.issue_text(F.lit(7), F.lit("T"), F.lit("D"), {"author": F.lit("ann"), "merge_request_count": F.lit("2"), "upvotes": F.lit("0"), "due_date": F.lit(None).cast("string"), "other": F.lit("x")}, {"labels": F.array(F.lit("p"), F.lit("q")), "assignees": F.array().cast("array<string>")}, F.array().cast("array<array<string>>"))
    assert one.select(text).first()[0] == "# T (7)\n\nD\n\n## Metadata\n\n- author: ann\n- merge request_count: 2\n- labels:\n  - p\n  - q"
    rows = spark.createDataFrame([(7, "T", "ann", None, "body text")], "iid int, title string, author string, description string, text string")
    got = R.issues(rows, "r").first()
    assert (got.title, got.url, got.docAuthor, got.wordCount) == ("Issue 7: T", "gitlab://issue-r-7", "ann", 2)


def test_wiki_and_transcript(spark):
    from tessera.sources import repositories as R

    rows = spark.createDataFrame([(1, "<p>a</p>", "t"), (2, None, "t"), (3, " ", "t"), (4, "<table><tr><th>one &amp; two</th><th>b</th></tr><tr><td>c</td></tr></table>", "t")], "i int, b string, t string")
    assert [r.x for r in rows.orderBy("i").select(R.wiki_body(F.col("b"), F.col("t")).alias("x")).collect()] == ["a", "t", "t", "ONE & TWO\nB\nc"]
    whole = {"actions": [{"updateEngagementPanelAction": {"content": {"transcriptRenderer": {"content": {"transcriptSearchPanelRenderer": {"body": {"transcriptSegmentListRenderer": {"initialSegments": [
        {"transcriptSegmentRenderer": {"snippet": {"runs": [{"text": " a"}, {"text": "b "}]}}}, {"transcriptSectionHeaderRenderer": {}}, {"transcriptSegmentRenderer": {"snippet": {"runs": [{"text": "c\n d"}]}}},
    ]}}}}}}}}]}
    df = spark.createDataFrame([(1, json.dumps(whole)), (2, "{}"), (3, None)], "i int, j string")
    assert [r.t for r in df.orderBy("i").select(R.transcript(F.col("j")).alias("t")).collect()] == ["ab c d", None, None]


def test_paged_rows(spark):
    from tessera.sources import repositories as R

    pages = {1: [(1, "a"), (2, None)], 2: [(3, "c")]}
    got = R.read_pages(spark, "test_pages_source", "id int, name string", lambda p: (pages.get(p, []), 2))
    assert got.rdd.getNumPartitions() == 2 and sorted(map(tuple, got.collect())) == [(1, "a"), (2, None), (3, "c")]
    assert R.read_pages(spark, "test_no_pages", "id int", lambda p: ([], 0)).count() == 0
