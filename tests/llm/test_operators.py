"""Each operator on small tables, against brute force and in the cases its docstring defines."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, shard string"


def words(t):
    return WORD.findall(t or "")


def corpus(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(150)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(40)
    out = []
    for i in range(n):
        t = prose(r.choice([0, 1, 3, 5, 30, 80, 200]))
        if i % 5 == 1 and out:
            t = r.choice(out)[1]
        if i % 7 == 2 and out and out[-1][1]:
            w = out[-1][1].split(" ")
            w[r.randrange(len(w))] = "Changed"
            t = " ".join(w)
        if i % 6 == 3:
            t = f"{t}\n{passage}\t{prose(5)}"
        out.append((i, t))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, prose(6000)), (1004, "x " * 500), (None, prose(30)), (1005, out[3][1]), (1005, out[3][1])]
    return [(i, t, "en", f"s{(i or 0) % 4}" if i != 7 else None, len(t or ""), "a", "b", "c") for i, t in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple(str(v) for v in x)


def test_quality_rules(docs, rows, empty):
    from tessera.llm.quality_rules import quality_rules

    got = sorted((tuple(r) for r in quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=key)
    expected = []
    for i, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(expected, key=key)
    assert quality_rules(docs).filter("base_failed AND kept").count() == 0
    assert quality_rules(empty).count() == 0


def test_lm_scoring(spark, docs, rows, empty):
    from tessera.llm.lm_scoring import score_documents

    tokens = [(i, words((t or "").translate(LOWER)) + [None]) for i, t, *_ in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(x for i, w in tokens if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, w in tokens)
    got = score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    # Words drawn independently hold nothing to learn beyond their counts; set phrases do.
    r = random.Random(6)
    phrases = [" ".join(f"w{r.randrange(60)}" for _ in range(6)) for _ in range(15)]
    phrased = [(i, " ".join(r.choice(phrases) for _ in range(20))) for i in range(200)]
    held = [x for x in score_documents(spark.createDataFrame(phrased, "doc_id bigint, text string")).collect() if x.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_documents(empty).count() == 0


def test_lm_scoring_has_every_repeated_ngram(spark):
    """A bigram and a trigram seen twice are arcs however small their share of the tokens, and score as the automaton in memory."""
    from tessera.llm import lm_scoring as lm

    r = random.Random(8)
    many = [(i, " ".join(f"v{int(r.paretovariate(0.7)) % 5000}" for _ in range(400))) for i in range(500)]
    rare = "rareone raretwo rarethree"
    made = many + [(i, f"{rare} {i}") for i in range(1000, 1100)]
    keep = [x for x in made[500:] if not lm.is_held_out(x[0])][:2]
    made = many + keep + [x for x in made[500:] if lm.is_held_out(x[0])][:1]
    texts = [(lm.is_held_out(i), t.split() + ["</s>"]) for i, t in made]
    c = Counter(w for out, ws in texts if not out for w in ws)
    vocabulary = sorted({w for _, ws in texts for w in ws})
    place = {w: k for k, w in enumerate(vocabulary)}
    two, three = Counter(), Counter()
    for out, ws in texts:
        if not out:
            x = [len(vocabulary)] + [place[w] for w in ws]
            two.update(zip(x, x[1:]))
            three.update(zip(x, x[1:], x[2:]))
    arcs = sorted([((a << 17) | b, n) for (a, b), n in two.items() if n > 1] + [((1 << 60) | (((a << 17) | b) << 17) | w, n) for (a, b, w), n in three.items() if n > 1])
    m = lm.build_automaton(np.arange(len(vocabulary)), np.array([c[w] for w in vocabulary]), np.array([k for k, _ in arcs], np.uint64), np.array([n for _, n in arcs]), sum(c.values()), len(c), c["</s>"])
    word = np.array([place[w] for _, ws in texts for w in ws])
    expected = m.traverse(word, np.cumsum([0] + [len(ws) for _, ws in texts]))
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(3)
    for more in ({}, {"group": 3000}):
        got = {x.doc_id: x for x in lm.score_documents(docs, **more).collect()}
        assert np.allclose([got[i].score for i, _ in made], expected, rtol=1e-9)
    last = got[made[-1][0]]
    assert last.held_out and last.score > last.base_score + 6


def test_automaton_is_a_distribution_and_pieces_agree():
    from tessera.llm import lm_scoring as lm

    hot = np.arange(10, 15, dtype=np.uint64)
    count = np.array([50, 40, 30, 20, 10])
    two = {(0, 1): 20, (1, 2): 10, (5, 0): 30, (2, 0): 9}
    three = {(0, 1, 2): 8, (5, 0, 1): 9}
    k = [(a << 17) | b for a, b in two] + [(1 << 60) | (((a << 17) | b) << 17) | c for a, b, c in three]
    order = np.argsort(np.array(k, np.uint64))
    m = lm.build_automaton(hot, count, np.array(k, np.uint64)[order], np.array([*two.values(), *three.values()])[order], 200, 60, 40)
    rest = 1 - (10**m.root).sum()
    for s in range(len(m.fail)):
        _, p = m.step(np.full(5, s), np.arange(5))
        assert abs((10**p).sum() + rest * 10 ** m.fall[s] - 1) < 1e-9
    word = np.array([random.Random(4).randint(-1, 4) for _ in range(300)])
    first = np.array([0, 10, 10, 250, 300])
    whole = []
    for a, b in zip(first, first[1:]):
        s, total = np.array([m.begin]), 0.0
        for x in word[a:b]:
            s, p = m.step(s, np.array([x]))
            total += p[0]
        whole.append(total)
    assert np.allclose(m.traverse(word, first), whole)


def test_decontamination(spark, docs, empty):
    from tessera.llm.decontamination import align, decontaminate, find_leaks

    r = random.Random(2)
    item = " ".join("".join(r.choice("mnopq") for _ in range(5)) for _ in range(30))
    edited = item.split(" ")
    for k in (4, 13, 22):
        edited[k] = "other"
    del edited[8]
    more = spark.createDataFrame([(5000, f"before it, {item.upper()}! after"), (5001, "x y z " + " ".join(edited)), (5002, " ".join(item.split(" ")[:6]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    assert sorted((x.doc_id, x.item_id) for x in find_leaks(both, bench).collect()) == [(5000, 1), (5000, 1), (5001, 1), (5001, 1)]
    assert decontaminate(both, bench).count() == both.count() - 2
    assert find_leaks(empty, bench).count() == 0
    assert find_leaks(both, bench.filter("false")).count() == 0

    def sw(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    pairs = [([r.randint(5, 9) for _ in range(r.randint(1, 9))], [r.randint(5, 9) for _ in range(r.randint(1, 12))]) for _ in range(200)]
    assert align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs]).tolist() == [sw(a, b) for a, b in pairs]


def test_decontamination_finds_excerpts(spark):
    from tessera.llm.decontamination import decontaminate, find_leaks

    r = random.Random(12)
    prose = lambda k: " ".join("".join(r.choice("fghijkl") for _ in range(6)) for _ in range(k))
    items = [prose(59).split(" "), prose(200).split(" ")]
    made = [(1, f"{prose(40)} {' '.join(items[0][20:45])} {prose(40)}"), (2, f"{prose(40)} {' '.join(items[1][100:190])} {prose(9)}"), (3, f"{prose(30)} {' '.join(items[1][60:73])}"), (4, f"{prose(30)} {' '.join(items[1][60:70])} {prose(5)}"), (5, prose(300))]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    assert sorted((x.doc_id, x.item_id) for x in find_leaks(docs, bench).collect()) == [(1, 0), (2, 1), (3, 1)]
    assert sorted(x.doc_id for x in decontaminate(docs, bench).collect()) == [4, 5]


def test_sharding(docs, rows, empty):
    from tessera.llm.sharding import shard_documents

    got = shard_documents(docs, 8).collect()
    assert len(got) == len(rows)
    by_text, slots, sums = defaultdict(set), defaultdict(list), Counter()
    text = {zlib.crc32((t or "").encode()): t for _, t, *_ in rows}
    for r in got:
        assert r.size == len((text[r.text_crc32] or "").encode()) + 16
        by_text[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(empty, 8).count() == 0


def test_minimax_is_smallest(spark):
    from tessera.llm.sharding import minimax_cuts

    r = random.Random(5)
    for n, shards in ((1, 3), (7, 3), (60, 5), (400, 9)):
        groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), r.choice([1, 5, 30, 200])) for i in range(n))
        capacity, first = minimax_cuts(spark.createDataFrame(groups, "key string, size bigint"), shards)

        def fits(c):
            used, left = 1, 0
            for _, s in groups:
                if s > c:
                    return False
                used, left = (used + 1, s) if left + s > c else (used, left + s)
            return used <= shards

        assert fits(capacity) and not fits(capacity - 1)
        sums = Counter()
        for k, s in groups:
            sums[sum(k >= f for f in first)] += s
        assert max(sums.values()) <= capacity and len(first) < shards


def test_jaccard_join(docs, rows, empty):
    from tessera.llm.jaccard_join import jaccard_components, keep_one_of_each

    sets = []
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), 1 << 60), 1 << 60 if i is None else i)
    expected = sorted((str(i), len(s), "None" if i is None else str(least[find(a)])) for a, (i, s) in enumerate(sets))
    got = jaccard_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected
    kept = [r.doc_id for r in keep_one_of_each(docs).collect()]
    assert sorted(map(str, kept)) == sorted({str(i) for i, _, c in expected if i == c or i == "None"})
    assert jaccard_components(empty).count() == 0


def test_html(spark):
    from tessera.llm.html_text import extract_text, main_text

    assert main_text(None, set()) == "" and main_text("", set()) == ""
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>A &amp; b</h1><p>one\n two<br>three<p>four <b>five</b></p><ul><li>x<li>y</ul><div class='comments'>no</div><script>var a='<p>';</script></article><footer>f</footer>"
    assert main_text(page, set()) == "A & b\none two three\nfour five\nx\ny"
    assert main_text("<p>tail &am", set()) == "tail &am" and main_text("plain < text", set()) == "plain < text"
    made = [(i, f"http://h.example/{i}", f"<body><div><b>Same block</b> everywhere</div><p>page {i}</p></body>") for i in range(8)] + [(100, None, "<p>a</p>"), (101, "http://other/", None), (101, "http://other/", None)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(made, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "page 3" and got[100] == "a" and got[101] == ""
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_copies_are_one_page(spark):
    from tessera.llm.html_text import extract_text

    article = "<body><nav>n{}</nav><article><h1>Head</h1><p>text</p><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table></article></body>"
    plain = "<body><div><h1>Title</h1><p>no article here</p></div></body>"
    made = [(i, f"http://a.example/{i}", article.format(i)) for i in range(8)] + [(20 + i, f"http://b.example/{i}", plain) for i in range(6)]
    made += [(40 + i, f"http://c.example/{i}", f"<body><div>Same block</div>{'<p>page %d</p>' % i if i < 8 else ''}</body>") for i in range(9)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(made, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == "Head\ntext\none\ntwo\ncell" for i in range(8))
    assert all(got[20 + i] == "Title\nno article here" for i in range(6))
    assert got[43] == "page 3" and got[48] == "Same block"


def test_personal_data(spark, docs):
    from tessera.llm.pii import base_spans, find_personal_data, redact
    from pyspark.sql import functions as F

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("a@.1 -2+") for _ in range(r.randint(0, 30)))
        s = base_spans(t)
        assert [m.span() for m in email.finditer(t)] == [x[:2] for x in s if x[2] == "email"]
        assert [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))] == [x[:2] for x in s if x[2] == "ip"]
        assert all(card.fullmatch(t[a:b]) for a, b, k in s if k == "card")
    made = spark.createDataFrame([(1, "é a.b@c.de call +1 (415) 555-2671, 4111 1111 1111 1111 from 10.2.3.4"), (2, "call (415) 555-2671 now"), (3, None), (4, "version 3 of 2024")], "doc_id bigint, text string")
    out = find_personal_data(made).withColumn("red", redact(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [(x.n_email, x.n_ip, x.n_card, x.n_phone) for x in out] == [(1, 1, 1, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert out[0].red == "é [email] call [phone], [card] from [ip]" and out[1].spans == "phone:5:19" and out[2].spans == "" and out[3].spans == ""


def test_classifier(spark, empty):
    from tessera.llm.quality_classifier import classify, fit_quality

    r = random.Random(3)
    made, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        made.append((i, " ".join(r.choice(["the", "and", "house", "river", "tree"]) if good else r.choice(["#$%", "BUY!!", "|"]) for _ in range(60))))
        labels.append((i, int(good), 0))
    d, q = spark.createDataFrame(made, "doc_id bigint, text string"), spark.createDataFrame([*labels, (1, None, 0), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = fit_quality(d, q)
    got = classify(d, model).collect()
    assert all(x.predicted == int(x.doc_id % 3 != 0) for x in got)
    assert classify(empty.select("doc_id", "text"), model).count() == 0
    constant = fit_quality(d, q.filter("false"))
    odd = classify(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), constant).collect()
    assert [x.score for x in odd] == [0.5, 0.5]


def test_mixing(docs, rows, empty):
    from tessera.llm.mixing import mix_documents

    got = mix_documents(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    ids = {str(i): s for i, _, _, s, *_ in rows}
    for r in got:
        s = ids[str(r.doc_id)]
        size[s] += r["size"]
        taken[s] += r.copies * r["size"]
        target[s] = r.target
        assert 0 <= r.copies <= 2
    most = max(r["size"] for r in got)
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1, 5, 2, 1]))
    want, open_, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 2 * size[s]]
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            open_.discard(s)
        if not over:
            break
    want |= {s: weights[s] * level for s in open_}
    assert all(abs(want[s] - target[s]) < 1e-6 for s in size)
    assert all(abs(taken[s] - target[s]) <= most for s in size)
    assert sorted(map(key, got)) == sorted(map(key, mix_documents(docs).collect()))
    assert mix_documents(empty).count() == 0


def test_substring_removal(docs, rows, empty):
    from tessera.llm.substring_dedup import remove_repeats

    unique = {(i, t) for i, t, *_ in rows}
    seen, expected = set(), {}
    for i, t in sorted(unique, key=lambda x: (x[0] is None, x[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            g = tuple(w[j : j + 20])
            if g in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(g)
        expected[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone) if not y))
    got = remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert all(expected[r.doc_id] == (r.n_words, r.n_removed, r.kept) for r in got)
    assert remove_repeats(empty).count() == 0


def test_fm_index():
    from tessera.llm.fm_index import FMIndex

    r = np.random.default_rng(1)
    text = r.integers(0, 4, 300)
    index = FMIndex(text, 5)
    for m in (1, 3, 5):
        patterns = r.integers(1, 4, (50, m))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.places[a:b]) == [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)] + ["the", "and", "of"] * 60
    made = [(i, " ".join(r.choice(vocabulary) for _ in range(80)), "en", f"s{i % 3}", 0) for i in range(120)]
    made += [(200 + i, made[i][1], "en", "s0", 0) for i in range(10)] + [(300 + i, "###$ BUY!! | " * 30 + str(i), "en", "s1", 0) for i in range(40)]
    item = " ".join(f"item{k}" for k in range(25))
    made.append((400, made[3][1][:200] + " " + item, "en", "s2", 0))
    spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 400), 0) for i, *_ in made], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    assert sorted(x.doc_id for x in left.collect()) == list(range(120))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 1.3 * 120 <= len(out) <= 1.7 * 120 and {x.doc_id for x in out} <= set(range(120))


def test_quality_rules_filters(spark, tmp_path):
    """A filter on the id reaches the scan, one on a statistic stays above the statistics."""
    from tessera.llm.quality_rules import quality_rules

    spark.createDataFrame([(1, "a b c a b c"), (2, None), (3, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    x = quality_rules(spark.read.parquet(str(tmp_path / "d"))).filter("doc_id < 3 AND n_words > 1")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(doc_id,3)" in plan and "rand(" not in plan
    assert [(r.doc_id, r.n_words, r.n_repeat_words) for r in x.collect()] == [(1, 6, 6)]
