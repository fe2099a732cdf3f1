"""Queries without SQL against plain loops, and cases that broke earlier versions."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import floor, log10, sqrt

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_ranks_by_unequal_odds(spark):
    """Copies by plain loops; the same loops with equal odds give another sample."""
    from tessera.llm.mixing import mix_documents

    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([1, 2, 5, 17, 60, 300, 900])), f"s{i % 3}" if i % 10 else None) for i in range(600)]
    got = {x.doc_id: x.copies for x in mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    of = defaultdict(list)
    for i, _, s in rows:
        of[s].append(i)
    weights = dict(zip(sorted(of, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    target, left, open_ = {}, 1.5 * sum(size.values()), set(of)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 2 * sum(size[i] for i in of[s])]
        if not over:
            break
        for s in over:
            target[s] = 2 * sum(size[i] for i in of[s])
            left -= target[s]
            open_.discard(s)
    target |= {s: weights[s] * level for s in open_}
    u = lambda i: (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def copies(equal_odds):
        out = {}
        for s, ids in of.items():
            m = {i: 1 + size[i].bit_length() for i in ids}
            low, high = 0.0, 100.0
            for _ in range(200):  # the factor, by bisection
                mid = (low + high) / 2
                low, high = (mid, high) if sum(size[i] * min(2.0, mid * m[i]) for i in ids) < target[s] else (low, mid)
            e = {i: min(2.0, low * m[i]) for i in ids}
            sure = {i: floor(e[i] + 1e-9) for i in ids}
            need, before = target[s] - sum(size[i] * sure[i] for i in ids), 0
            out |= sure
            p = {i: e[i] - sure[i] for i in ids if e[i] - sure[i] > 1e-6}
            for i in sorted(p, key=lambda i: u(i) if equal_odds else u(i) / (1 - u(i)) / (p[i] / (1 - p[i]))):
                out[i] += 2 * before + size[i] <= 2 * need
                before += size[i]
        return out

    assert got == copies(False) != copies(True)


def test_html_class_words_and_articles():
    from tessera.llm.html_text import main_text

    cases = {
        '<div class="layout no-sidebar"><article><p>a b</p></article></div>': "a b",
        '<article class="post social-policy"><p>x</p></article>': "x",
        '<main id="content-header-offset"><p>y</p></main>': "y",
        '<article><p>t</p><section id="related-work"><p>rw</p></section><div class="site-footer">no</div></article>': "t\nrw",
        "<form><main><p>z</p></main></form>": "z",
        '<div class="sidebar"><article>teaser</article></div><article>main</article>': "main",
        '<div class="page-header"><article>only</article></div>': "only",
        '<body><div class="ad">no</div><div class="ad-slot top">no</div><div id="cookie-banner">no</div><p>yes</p></body>': "yes",
    }
    assert {k: main_text(k, set()) for k in cases} == cases
    start = time.time()
    for n in (20_000,):
        main_text("<div>" * n + "x" + "</div>" * n, set())
        main_text("<p><td>" + "<span>" * n + "<hr>" * n, set())
    assert time.time() - start < 20


def test_html_against_counting_by_loops(spark):
    """Pages of neutral tags: recurrence alone decides, as counted by loops over serialised subtrees."""
    from tessera.llm.html_text import extract_text

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = {h: [line(r.randint(2, 9)) for _ in range(4)] for h in range(3)}
    pages = []
    for i in range(240):
        h = r.choices(range(4), [8, 4, 1, 1])[0]
        blocks = [("p", line(r.randint(1, 12))) for _ in range(r.randint(1, 4))]
        for t in shared.get(h, []):
            if r.random() < 0.6:
                blocks.insert(r.randint(0, len(blocks)), (r.choice(["p", "div"]) if r.random() < 0.1 else "div", t))
        if pages and r.random() < 0.1:
            blocks = list(r.choice([p for p in pages])[2])
        pages.append((i, h, blocks))
    on, texts = defaultdict(set), defaultdict(set)
    for _, h, blocks in pages:
        text = "\n".join(t for _, t in blocks)
        texts[h].add(text)
        for b in blocks:
            on[h, b].add(text)
    share = lambda h: max(0.03, min(0.3, 3 / sqrt(len(texts[h]))))
    template = {k for k, v in on.items() if len(v) >= 5 and len(v) >= share(k[0]) * len(texts[k[0]])}
    expected = {}
    for i, h, blocks in pages:
        left = [t for k, t in blocks if (h, (k, t)) not in template] or [t for _, t in blocks]
        expected[i] = "\n".join(left)
    assert template and any(len(expected[i].split("\n")) < len(b) for i, _, b in pages)
    made = [(i, f"https://h{h}.example/{i}", "<body>" + "".join(f"<{k}>{html.escape(t)}</{k}>" for k, t in blocks) + "</body>", "x") for i, h, blocks in pages]
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(made, "page_id bigint, url string, html string, text string")).collect()}
    assert got == expected


def test_html_template_inside_articles(spark):
    from tessera.llm.html_text import extract_text

    notice = "<p>Please sign up to read the rest of this story</p>"
    made = [(i, f"http://n.example/{i}", f"<article><h2>Summary</h2><p>story {i} body</p>{notice}<table><tr><td>yes</td></tr></table></article>") for i in range(12)]
    got = {x.page_id: x.text for x in extract_text(spark.createDataFrame(made, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Summary\nstory {i} body" for i in range(12)}


def test_decontamination_against_whole_alignment(spark):
    """Documents and items aligned as wholes, without seeds."""
    from tessera.llm.decontamination import find_leaks

    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    items = [(k, prose(r.choice([4, 8, 20, 45]))) for k in range(12)]
    docs = []
    for i in range(110):
        w = prose(r.randint(0, 80))
        if i % 2:
            x = list(r.choice(items)[1])
            for _ in range(r.randint(0, len(x) // 3)):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            a = r.randint(0, len(x) // 2)
            at = r.randint(0, len(w))
            w[at:at] = x[a:] if i % 3 else x
        docs.append((i, w))
    docs += [(200, None), (201, []), (202, prose(4000) + items[3][1])]

    def sw(a, b):
        row, best = np.zeros(len(b) + 1, int), 0
        b = np.array([hash(x) for x in b], np.int64)
        for x in a:
            new = [0]
            step = np.where(b == hash(x), 2, -1)
            for j in range(1, len(b) + 1):
                new.append(max(0, row[j - 1] + step[j - 1], row[j] - 1, new[-1] - 1))
            row = np.array(new)
            best = max(best, int(row.max()))
        return best

    expected = set()
    for i, w in docs:
        for k, x in items:
            s = sw(x, w or [])
            if s >= min(len(x), 26) and s >= min(2 * len(x), 12):
                expected.add((i, k, s))
    d = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in docs], "doc_id bigint, text string")
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in items], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id, x.score) for x in find_leaks(d, b).collect()}
    assert got == expected and len(got) > 20


def test_personal_data_against_patterns(spark):
    """All four kinds, the digest and what the method may add."""
    from tessera.llm.query_op7 import run
    from tessera.llm.pii import KINDS

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    r = random.Random(17)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+49 30.1234567", "10.0.0.1", "1.2.3.400", "1.2.3.4.5.6.7.8", "a@b.cd", "x.y@z-q.org.", "é@é.com", "5500 0000 0000 0004 +123456789", "+1 2", "00000000000000000000"]
    docs = []
    for i in range(800):
        t = "".join(r.choice([r.choice(pieces), r.choice("0123456789 +-().@a\n"), " word "]) for _ in range(r.randint(0, 25)))
        docs.append((i, t))
    docs += [(1000, None), (1001, ""), (1002, "1 " * 20000 + "+" * 5000 + "a@" * 5000)]
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = {x.doc_id: x for x in run(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = [(m.start(), k, f"{name}:{m.start()}:{m.end()}", name) for k, (name, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if good(name, m[0])]
        base.sort(key=lambda s: s[:2])
        x = got[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[3] == k for s in base) for k in patterns]
        assert x.base_sha256 == hashlib.sha256(",".join(s[2] for s in base).encode()).hexdigest()
        spans = x.spans.split(",") if x.spans else []
        assert Counter(spans) >= Counter(s[2] for s in base)
        for s in spans:
            kind, a, b = s.split(":")
            assert kind in KINDS and 0 <= int(a) < int(b) <= len(t)


def test_classifier_on_held_out_rows(spark):
    """Noisy labels that hang on two properties together; only rows that were never fitted count."""
    from tessera.llm.quality_classifier import classify, fit_quality

    r = random.Random(13)
    docs, labels = [], []
    for i in range(1500):
        symbols, short = r.random() < 0.5, r.random() < 0.5
        docs.append((i, " ".join((r.choice("#$%") if symbols and r.random() < 0.4 else r.choice(["river", "the", "and", "tree"])) for _ in range(15 if short else 200))))
        labels.append((i, int((symbols != short) != (r.random() < 0.05)), 0))
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = fit_quality(d, q)
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    flipped = spark.createDataFrame([(i, 1 - y if i in set(held) else y, 0) for i, y, _ in labels], "doc_id bigint, quality int, toxic int")
    again = fit_quality(d, flipped)
    got = {x.doc_id: x.score for x in classify(d, model).collect()}
    assert got == {x.doc_id: x.score for x in classify(d, again).collect()}
    truth = {i: y for i, y, _ in labels}
    assert sum((got[i] >= 0.5) == truth[i] for i in held) > 0.9 * len(held)


def test_lm_scoring_against_counted_backoff(spark):
    """Probabilities from counts, backing off by loops."""
    from tessera.llm.lm_scoring import is_held_out, score_documents

    r = random.Random(31)
    phrases = [" ".join(f"w{r.randrange(40)}" for _ in range(4)) for _ in range(30)]
    docs = [(i, " ".join(r.choice(phrases) for _ in range(r.randint(0, 8)))) for i in range(120)] + [(500, None)]
    texts = {i: WORD.findall(t or "") + ["\n"] for i, t in docs}
    train = [w for i, w in texts.items() if not is_held_out(i)]
    one, two, three = Counter(), Counter(), Counter()
    for w in train:
        one.update(w)
        two.update(zip(["^", *w], w))
        three.update(zip(["^", *w], w, w[1:]))
    n, v = sum(one.values()), len(one)
    one["^"] = len(train)
    two, three = ({k: c for k, c in x.items() if c > 1} for x in (two, three))
    p1 = lambda w: ((one[w] if w != "^" else 0) + 0.5) / (n + 0.5 * (v + 1))

    def p2(a, w):
        if (a, w) in two:
            return (two[a, w] - 0.75) / one[a]
        arcs = [x for (h, x) in two if h == a]
        if not arcs:
            return p1(w)
        seen, lower = sum((two[a, x] - 0.75) / one[a] for x in arcs), sum(p1(x) for x in arcs)
        return (1 - seen) / (1 - lower) * p1(w)

    def p3(a, b, w):
        if (a, b) not in two:
            return p2(b, w)
        if (a, b, w) in three:
            return (three[a, b, w] - 0.75) / two[a, b]
        arcs = [x for (g, h, x) in three if (g, h) == (a, b)]
        if not arcs:
            return p2(b, w)
        seen, lower = sum((three[a, b, x] - 0.75) / two[a, b] for x in arcs), sum(p2(b, x) for x in arcs)
        return (1 - seen) / (1 - lower) * p2(b, w)

    got = {x.doc_id: x.score for x in score_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for i, w in texts.items():
        h = ["^", *w]
        expected = sum(log10(p2("^", w[0]) if k == 1 else p3(h[k - 2], h[k - 1], h[k])) for k in range(1, len(h)))
        assert abs(got[i] - expected) < 1e-6 * max(1, abs(expected))


def test_jaccard_dissimilar_forms(spark):
    """Filled-in forms: one common list, no two alike; no pairs are made of them."""
    from tessera.llm.jaccard_join import jaccard_components

    form = " ".join(f"f{k}" for k in range(88))
    made = [(i, f"{form} " + " ".join(f"a{i}x{j}" for j in range(14))) for i in range(4000)]
    start = time.time()
    got = jaccard_components(spark.createDataFrame(made, "doc_id bigint, text string").repartition(4)).collect()
    assert all(x.component_id == x.doc_id for x in got) and len(got) == 4000
    assert time.time() - start < 60


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated ids and columns that clash, through each stage."""
    import corpus_pipeline

    r = random.Random(19)
    prose = lambda k: " ".join(r.choice(["the", "river", "house", "and", "tree", f"x{r.randrange(300)}"]) for _ in range(k))
    rows = [(i, prose(60), f"s{i % 2}", f"size{i}", 0.25, 9, "p", i) for i in range(60)]
    rows += [(100, None, "s0", "a", 0.5, 1, "p", 1), (101, "", None, "b", 0.5, 1, "p", 1), (None, prose(60), "s1", "c", 0.5, 1, "p", 1), (5, prose(60), "s1", "d", 0.5, 1, "p", 1), (7, rows[7][1], "s1", "size7", 0.25, 9, "p", 7), (103, rows[8][1], "s1", "e", 0.5, 1, "p", 1)]
    schema = "doc_id bigint, text string, source string, size string, score double, target int, predicted string, copies int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(40, 45)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, rows[9][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, known = docs, {tuple(x) for x in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns and left.schema == docs.schema
        got = [tuple(x) for x in left.collect()]
        assert set(got) <= known
        if name == "jaccard_join":
            ids = [x[0] for x in got]
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 103 not in ids
            assert [x for x in got if x[0] == 5] in ([rows[5]], [rows[63]])
        if name == "decontamination":
            assert 9 not in [x[0] for x in got]
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
