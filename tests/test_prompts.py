from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


def test_window_folds():
    """Each rule by itself, with tokens that are words."""
    from tessera.operators.chat import MARKER
    from tessera.operators.prompt import Window, compress_messages, compress_text, fit_history, fit_system

    w = Window(1000)
    say = lambda n, c="w": " ".join([c] * n)
    assert compress_messages(w, "sys", "hi", [("b", "c"), ("a", "d")]) == [("system", "sys"), ("user", "a"), ("assistant", "d"), ("user", "b"), ("assistant", "c"), ("user", "hi")]
    only = compress_messages(w, "sys", say(701), [])
    assert only == [("user", w.middle_out(say(701), 800))] and only[0][1] == say(701)
    long = compress_messages(w, "sys", say(1500), [])
    assert len(long) == 1 and MARKER in long[0][1] and w.count(long[0][1].replace(MARKER, " ")) == 800
    # History: 150 tokens.  One that is too long is shortened if among the three newest, else it ends the walk.
    assert fit_history(w, [("a", "b")] * 3) == [("a", "b")] * 3
    kept = fit_history(w, [("n", "n"), (say(200), say(10)), ("o", "o")])
    assert [p[1] for p in kept] == ["o", say(10), "n"] and MARKER in kept[1][0]
    assert fit_history(w, [("a", "a")] * 3 + [(say(200), "x"), ("z", "z")]) == [("a", "a")] * 3
    skipped = fit_history(w, [(say(68), say(68)), (say(60), say(60)), ("o", "o")])
    assert skipped == [("o", "o"), (say(68), say(68))]
    assert fit_system(w, say(149)) == say(149)
    s = fit_system(w, say(40) + " Context: " + say(300, "c"))
    assert s.startswith(say(18)) and "\nContext: " in s and s.count(MARKER) == 2
    assert MARKER not in fit_system(w, say(20) + " Context: " + say(10)) and "Context" not in fit_system(w, say(300), False)
    assert compress_text(w, "sys", "hi", [("a", "b")]) == "system: sys\nuser: a\nassistant: b\nuser: hi"


def test_compressed_tables_agree_with_single_calls(spark):
    from tessera.operators.prompt import Window, compress_messages, compressed

    r = random.Random(5)
    say = lambda: " ".join(f"t{r.randrange(9)}" for _ in range(r.choice([1, 20, 200, 900])))
    requests = [(i, say() if i % 4 else None, say()) for i in range(20)]
    history = [(i, t, say() if r.random() < 0.9 else None, say()) for i in range(18) for t in range(r.randint(0, 7))]
    got = {x.request_id: [tuple(m) for m in x.messages] for x in compressed(spark.createDataFrame(requests, "request_id int, system string, user string"), spark.createDataFrame(history, "request_id int, place int, prompt string, response string"), Window(1500), messages=5).collect()}
    for i, s, u in requests:
        newest = [(p or "", a or "") for _, _, p, a in sorted((h for h in history if h[0] == i), key=lambda h: -h[1])][:5]
        assert got[i] == compress_messages(Window(1500), s or "", u, newest)


def test_tokenizer_from_vocabulary(spark):
    P = pytest.importorskip("public_tokenizers")
    from tessera.operators.prompt import Window, byte_pairs, token_count

    t = byte_pairs(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(token_count(F.col("t"), t).alias("n")).collect()
    assert [r.n for r in got] == [2, 0, 0]
    assert t.decode(t.encode("déjà vu <|endoftext|>")) == "déjà vu <|endoftext|>" and Window(10, t).middle_out("one two three", 50) == "one two three"


def test_json(spark):
    from tessera.functions import json as J
    from tessera.operators.flows import at_path

    cases = {"a.b[0].c": "1", "a['x.y']": "2", 'a["b"][1]': "true", "a.b": '[{"c":1},true]', "a.none": None, "": "", "q[5]": None}
    text = '{"a": {"b": [{"c": 1}, true], "x.y": 2}, "q": [1]}'
    row = spark.range(1).select(*[J.value_at(F.lit(text), p).alias(f"c{i}") for i, p in enumerate(cases)], J.value_at(F.lit("x"), "a").alias("bad"), J.value_at(F.lit("[7]"), "[0]").alias("first")).first()
    assert list(row) == [*cases.values(), "", "7"]
    assert at_path(text, "a.b[0].c") == 1 and at_path(text, "a.b") == '[{"c":1},true]' and at_path("x", "a") == "" and at_path(text, "a.zz") is None
    for bad, good in {"{a: 1, 'b': 'x y', c: [1 2 3], d: None}": {"a": 1, "b": "x y", "c": [1, 2, 3], "d": None}, '{"a": "open': {"a": "open"}, "see {\"k\": [1]} ok": {"k": [1]}, "no": None, "12": 12}.items():
        assert J.parse_tolerant(bad) == good


def test_flows_and_loop():
    from tessera.operators.flows import Direct, Tool, Tools, chart_problem, filled, run_flow, run_loop

    assert filled({"u": "x/${a.b[0]}/${no}", "l": ["${a.b}"]}, {"a": {"b": [1]}}) == {"u": "x/1/${no}", "l": ["[1]"]}
    blocks = {"apiCall": lambda c, v: {"got": c["url"]}, "fail": lambda c, v: 1 / 0}
    steps = [{"type": "start", "config": {"variables": [{"name": "q", "value": "old"}, {"name": "k", "value": "v"}]}}, {"type": "apiCall", "config": {"url": "http://x/${q}/${k}", "responseVariable": "r"}}]
    out = run_flow(steps, blocks, {"q": "new"})
    assert out["success"] and out["variables"]["r"] == {"got": "http://x/new/v"}
    assert not run_flow([*steps, {"type": "fail", "config": {}}, steps[1]], blocks)["success"] and len(run_flow([{"type": "zz", "config": {}}, steps[1]], blocks)["results"]) == 1
    assert run_flow([{"type": "apiCall", "config": {"url": "u", "directOutput": True}}, {"type": "fail", "config": {}}], blocks)["direct"] == {"got": "u"}
    tools = Tools()
    tools.register(Tool("add", "", {"a": {}, "b": {}}, lambda a, b=0: a + b, ["a"]))
    tools.register(Tool("show", "", {}, lambda: Direct("raw")))
    assert tools.problem({"name": "add", "arguments": {"a": 1}}) is None and "a" in tools.problem({"name": "add", "arguments": {}}) and "Unknown argument: z" in tools.problem({"name": "add", "arguments": {"a": 1, "z": 2}})
    plan = iter([{"call": {"name": "lost", "arguments": {}}}, {"call": {"name": "add", "arguments": {"a": 1, "b": 2}}}, {"result": "done"}])
    asked = []
    assert run_loop(lambda m, t: (asked.append([x["content"] for x in m]), next(plan))[1], [{"role": "user", "content": "hi"}], tools) == "done"
    assert asked[-1] == ["hi", 'Function "lost" not found. Try again.', 3]
    assert run_loop(lambda m, t: {"call": {"name": "show", "arguments": {}}}, [], tools) == "raw"
    with pytest.raises(RuntimeError):
        run_loop(lambda m, t: {"call": {"name": "add", "arguments": {"a": 1}}}, [], tools, rounds=3)
    assert chart_problem("bar", "[]") is None and chart_problem("cube", "[]") and chart_problem("pie", "{")
