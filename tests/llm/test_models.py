"""The conditional random field and the block labeller: against enumeration, finite differences and a plain parser."""

import math
import random
import time
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from drawlens.llm import html_extract, lm, toxicity


def paths(e, t, s):
    """Every labelling of a chain with its weight."""
    for y in product((0, 1), repeat=len(e)):
        yield y, math.exp(s[y[0]] + sum(x for x, k in zip(e, y, strict=True) if k) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    e, t, s = r.standard_normal(9) * 2, r.standard_normal((2, 2)), r.standard_normal(2)
    begins = np.array([1, 0, 0, 0, 1, 0, 1, 0, 0], bool)
    p, pairs = toxicity.marginals(e, begins, t, s)
    for a, b in ((0, 4), (4, 6), (6, 9)):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((4, b - a))
        for y, w in paths(e[a:b], t, s):
            total += w
            one += w * np.array(y)
            for k in range(1, b - a):
                two[2 * y[k - 1] + y[k], k] += w
        assert np.allclose(p[a:b], one / total) and np.allclose(pairs[:, a + 1 : b], two[:, 1:] / total)
    assert np.allclose(toxicity.marginals(e, begins, t, s, paired=False)[0], p)


def sample(rows):
    own = toxicity.Sample((t.encode(), y) for t, y in rows)
    return own, [np.array(x, np.int64) for x in zip(*map(toxicity.features, own.words), strict=True)]


ROWS = [("good words here", False), ("bad thing here", True), ("so bad", True), ("fine", False), ("bad", True), ("words so", False)]


def document_likelihood(own, slots, model):
    """Brute force: of clean documents no token is toxic, of toxic ones at least one."""
    says, out = np.column_stack([model.weights[s].sum(1) for s in slots]), 0.0
    for d, toxic in zip(own.docs, own.toxic, strict=True):
        begins = np.zeros(len(d), bool)
        begins[0] = True
        weight = dict(paths(toxicity.emission(says[d], begins), model.transition, model.start))
        none = weight[(0,) * len(d)] / sum(weight.values())
        out += math.log(1 - none if toxic else none)
    return out


def token_likelihood(own, slots, model, marked):
    says, out = np.column_stack([model.weights[s].sum(1) for s in slots]), 0.0
    for d, toxic in zip(own.docs, own.toxic, strict=True):
        begins = np.zeros(len(d), bool)
        begins[0] = True
        weight = dict(paths(toxicity.emission(says[d], begins), model.transition, model.start))
        out += math.log(weight[tuple((marked[d] & toxic).astype(int))] / sum(weight.values()))
    return out


@pytest.mark.parametrize("by_document", [True, False])
@pytest.mark.parametrize("piece", [toxicity.PIECE, 4])
def test_gradient_is_that_of_the_likelihood(monkeypatch, by_document, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    r = np.random.default_rng(1)
    own, slots = sample(ROWS)
    model = toxicity.Field(r.standard_normal(toxicity.SLOTS) * 0.3, r.standard_normal((2, 2)), r.standard_normal(2))
    marked = None if by_document else np.array([w == b"bad" for w in own.words])
    value = (lambda: document_likelihood(own, slots, model)) if by_document else (lambda: token_likelihood(own, slots, model, marked))
    likelihood, *gradients, _ = toxicity.gradient(own, slots, model, marked)
    if by_document:
        assert math.isclose(likelihood, value(), rel_tol=1e-9)
    for x, g in zip((model.weights, model.transition, model.start), gradients, strict=True):
        flat, g = x.reshape(-1), g.reshape(-1)
        for k in [*np.flatnonzero(g)[:6].tolist()]:
            before = flat[k]
            flat[k] = before + 1e-5
            up = value()
            flat[k] = before - 1e-5
            down = value()
            flat[k] = before
            assert math.isclose(-(up - down) / 2e-5, g[k], rel_tol=1e-4, abs_tol=1e-6)


def test_documents_settle_what_forms_missed():
    """Toxic documents without a telling form: the label alone teaches their common words."""
    r = random.Random(0)
    clean = lambda: " ".join(f"w{r.randrange(60)}" for _ in range(12))
    rows = [(f"{clean()} alpha {clean()}" if i % 2 else clean(), bool(i % 2)) for i in range(60)]
    model = toxicity.fit(((t.encode(), y) for t, y in rows), rounds=(0, 60))
    total = toxicity.expected([t.encode() for t, _ in rows], model, toxicity.Emissions(model.weights))[2]
    assert ((model.probability(total) >= 0.5) == [y for _, y in rows]).mean() > 0.95


def test_toxicity_learns_and_marks(spark):
    r = random.Random(2)
    words_ = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*(r.choice(words_) for _ in range(30)), *(["vileword", "nasty"] if i % 3 == 0 else [])]), "x", 1.5) for i in range(300)] + [(300, None, "y", None), (301, "", "y", 0.0), (302, "vileword, " * 5, "z", 1.0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, id string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "q") for i in range(300)] + [(None, 1, "q"), (4, None, "q"), (5, 0, "q"), (5, 0, "q")], "doc_id bigint, toxic int, text string")
    model = toxicity.train(d, labels)
    again = d.union(d.where("doc_id = 3"))
    got = {}
    for x in toxicity.score_documents(again, model).collect():
        assert got.setdefault(x["doc_id"], x) == x
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(300)) and got[302]["predicted"] == 1
    assert got[300]["predicted"] == got[301]["predicted"] == 0 and 0 <= got[300]["score"] <= 1
    span = got[3]["spans"][0]
    assert rows[3][1][span["start"] : span["end"]] == "vileword nasty"
    assert all(x["held_out"] == (lm.fold(x["doc_id"], 5) == 0) for x in got.values())
    left = toxicity.drop_toxic(d, model)
    assert left.count() == 303 - 101 and left.columns == d.columns
    nothing = toxicity.train(d, labels.where("toxic > 5"))
    assert {x["score"] for x in toxicity.score_documents(d, nothing).collect()} == {0.0}
    empty = d.where("doc_id < 0")
    assert toxicity.score_documents(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    assert toxicity.train(empty, labels).score is None and toxicity.train(d, labels.where("doc_id < 0")).score is None


def test_toxicity_reads_very_long_texts_whole(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", 5000)
    r = random.Random(3)
    huge = next(i for i in range(1, 200, 2) if lm.fold(i, 5) != 0)
    text = lambda i: " ".join([*(f"w{r.randrange(99)}" for _ in range(30)), *(["vileword"] if i % 2 else [])])
    d = spark.createDataFrame([(i, "w1 " * (40_000 if i == huge else 0) + text(i)) for i in range(200)], "doc_id bigint, text string")
    model = toxicity.train(d, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score_documents(d, model).collect()}
    assert all(x["predicted"] == i % 2 for i, x in got.items()) and got[huge]["spans"][0]["start"] > 100_000


class Plain(HTMLParser):
    """Texts between block tags of a page whose tags are balanced."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.deaf = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.deaf += tag in ("script", "style", "svg")
        if tag in html_extract.BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.deaf -= tag in ("script", "style", "svg")
        if tag in html_extract.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.deaf:
            self.parts.append(data)


def test_blocks_equal_a_plain_parser():
    r = random.Random(7)

    def page(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.random()
            if kind < 0.45 or depth > 4:
                out.append(r.choice(["word ", "a &amp; b", " x  y\n", "&eacute;", "1 < 2 ", "<br>", "<br/>", "<!-- no > -->", "<svg width=1 />", "<script>var a = '<p>';</script>", "<svg><title>t</title></svg>", "<math><mi>m</mi></math>", "<object>o</object>", "<noscript>n</noscript>"]))
            else:
                tag = r.choice(["div", "section", "b", "em", "span", "blockquote", "article", "h2", "a"])
                attribute = r.choice(["", " class='x > y'", ' id="a b"', " data-x=1", " hidden"])
                out.append(f"<{tag}{attribute}>{page(depth + 1)}</{tag}>")
        return "".join(out)

    for _ in range(300):
        own = page(0)
        plain = Plain()
        plain.feed(own)
        plain.close()
        plain.flush()
        assert [b.text for b in html_extract.blocks(own)] == plain.out, own


def test_blocks_of_malformed_pages():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    read = html_extract.blocks("<html><head><title>no</title></head><body><p><b>One &amp; two<br>three<p>four<script>var t='</p>'</script> five</p><ul><li>a<li>b</ul><!-- x --><a href=x>l</a>")
    assert [b.text for b in read] == ["One & two three", "four five", "a", "b", "l"] and read[-1].linked == 1
    assert texts("<article><h1>T</h1><p>one <svg width=1 /> two <math/>three</p><p>four") == ["T", "one two three", "four"]
    assert texts("<p>a <noscript>b<p>c <object>d</p><canvas>e") == ["a b", "c d", "e"]
    assert texts("<p>a<script>lost") == ["a"] and texts("<p>a<svg>b") == ["ab"] and texts("<p>a<template>b") == ["ab"]
    assert texts('<p title="a > b">x</p><p title="y>z</p><p>w') == ["x", "z", "w"]
    assert texts("a < b <3 c <d") == ["a < b <3 c"] and texts("<head><title>t<body>x") == ["x"] and texts("</b></div>x</p>y") == ["xy"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e<dt>f</dl>") == ["a", "b", "c", "d", "e", "f"]


@pytest.mark.parametrize("page", [
    "<a" * 500_000, "<a \"'>" * 100_000, "<a b=\"'>" * 100_000, "<div>x" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "</section>" * 50_000,
    "<svg>" + "</svg " * 100_000, "<!--" * 100_000, "<" * 500_000, '<b a="" ' + 'a="" ' * 100_000 + ">", "<p class='" + "a " * 200_000 + "'>" + "<p>x" * 2000, "=" * 500_000, "<a =" + "= " * 200_000,
])
def test_blocks_take_linear_time(page):
    began = time.perf_counter()
    html_extract.blocks(page)
    assert time.perf_counter() - began < 10


def test_lstm_gradients():
    r = np.random.default_rng(0)
    model = html_extract.Labeller(3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [html_extract.blocks("<nav><a>x</a></nav><p>some words</p><div>z</div>"), html_extract.blocks("<p>q r</p>")]
    f, y = html_extract.Features(pages), np.array([0, 1, 0, 1], np.float32)
    loss = lambda: float(np.mean(np.logaddexp(0, z := model.logits(f)) - y * z))
    grad = model.gradients(f, y)
    for name in ("xf", "hf", "cb", "out"):
        flat = model.w[name].reshape(-1)
        k = int(r.integers(0, flat.size))
        before, step = flat[k], 1e-3
        flat[k] = before + step
        up = loss()
        flat[k] = before - step
        down = loss()
        flat[k] = before
        assert abs((up - down) / (2 * step) - grad[name].reshape(-1)[k]) < 1e-3


def test_extraction(spark):
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>A  title</h1><p>First &eacute;\nline.<p>Second line.</article><footer>&copy; us</footer>"
    long = "<article><h1>Long</h1>" + "<p>Some plain sentence of an article, told at length.</p>" * 3000 + "</article>"
    rows = spark.createDataFrame([(1, "u", page, "t", 1), (1, "u", page, "t", 2), (2, None, None, None, 3), (3, "u", "", "", 4), (None, None, long, "", 5)], "page_id bigint, url string, html string, text string, id int")
    got = html_extract.extract(rows).collect()
    texts = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got)
    main = "A title\nFirst é line.\nSecond line."
    assert texts[1:] == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0)] and texts[0][2] > 100_000
    assert html_extract.extract(rows.where("id < 0")).count() == 0


def test_labeller_on_unseen_pages():
    r = np.random.default_rng(123)
    pages, labels = zip(*(x for x in ((html_extract.blocks(p), own) for p, own in (html_extract.synthetic(r) for _ in range(150))) if len(x[0]) == len(x[1])), strict=True)
    got = html_extract.trained().label(list(pages))
    assert np.mean(np.concatenate(got) == np.concatenate([np.array(x, bool) for x in labels])) > 0.97


def test_toxicity_learns_from_texts_that_share_header_and_footer(spark):
    r = random.Random(4)
    frame = "one two three four five six seven {} more words at the very end of it"
    body = [(" ".join(r.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" if i % 2 else ""), i % 2) for i in range(200)]
    rows = [(i, frame.format(t), bad) for i, (t, bad) in enumerate(body)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, bad) for i, _, bad in rows], "doc_id bigint, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i]["predicted"] == bad for i, _, bad in rows)


def test_toxicity_keeps_both_labels_of_a_text():
    sample = toxicity.Sample([(b"a b c", True), (b"a b c", False), (b"a b c", True), (b"a b  c d", True)])
    assert sample.toxic.tolist() == [True, False, True] and [len(d) for d in sample.docs] == [3, 3, 4]


def plain_logits(w, page):
    """The labeller's forward pass over one page, block by block in double precision, from the sets of open names."""
    own = html_extract.blocks(page)
    w = {k: v.astype(float) for k, v in w.items()}
    open_now, xs = set(), []
    for i, b in enumerate(own):
        for m in b.moves:
            (open_now.add if m > 0 else open_now.remove)(abs(m) - 1)
        path = sum((w["path"][k] for k in open_now), w["path"][html_extract.slot("last=" + b.last, html_extract.PATHS)])
        words = [w["word"][html_extract.slot(x, html_extract.WORDS)] for x in b.text.lower().split()]
        xs.append(np.concatenate([path, sum(words) / len(words), html_extract.numbers(b, i / max(len(own) - 1, 1), b.depth)]))
    hidden = {}
    for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        n = html_extract.Labeller.HIDDEN
        state = cell = np.zeros(n)
        for i in order:
            g = xs[i] @ w[f"x{side}"] + state @ w[f"h{side}"] + w[f"c{side}"]
            take, forget, out = (1 / (1 + np.exp(-g[k * n : (k + 1) * n])) for k in range(3))
            cell = forget * cell + take * np.tanh(g[3 * n :])
            state = out * np.tanh(cell)
            hidden[side, i] = state
    return [float((np.concatenate([hidden["f", i], hidden["b", i], x]) @ w["out"] + w["bias"])[0]) for i, x in enumerate(xs)]


def test_forward_pass_equals_a_plain_loop():
    model = html_extract.trained()
    r = np.random.default_rng(5)
    pages = [html_extract.synthetic(r)[0] for _ in range(8)]
    pages.insert(3, "")
    pages.append("<div id=a><div class='b a'><p>one</div><p>two<div><b>three</b><i>four</i>")
    got = np.split(model.logits(html_extract.Features([html_extract.blocks(p) for p in pages])), np.cumsum([len(html_extract.blocks(p)) for p in pages])[:-1])
    for page, own in zip(pages, got, strict=True):
        assert np.allclose(own, plain_logits(model.w, page), atol=2e-2, rtol=1e-3)


def test_paths_have_no_bounds():
    """An id behind many class words, names far above the block, and many equal wrappers."""
    many = " ".join(f"u{i}" for i in range(40))
    own = html_extract.blocks(f"<div class='{many}' id=comments>" + "<div class=deep>" * 90 + "<p>x</p>" + "</div>" * 90 + "<p>y</p></div><p>z")
    at = lambda name: html_extract.slot(name, html_extract.PATHS) + 1
    assert [b.text for b in own] == ["x", "y", "z"]
    assert {at("i:comments"), at("c:deep"), at("c:u39")} <= set(own[0].moves) and own[0].moves.count(at("c:deep")) == 1
    assert -at("c:deep") in own[1].moves and -at("i:comments") not in own[1].moves and -at("i:comments") in own[2].moves


def test_examples_are_text_as_they_stand():
    own = html_extract.blocks("<p>a<xmp>if x < 3 &amp; <b>y</b></xmp><p>b</p><xmp>to the <i>end")
    assert [b.text for b in own] == ["a", "if x < 3 &amp; <b>y</b>", "b", "to the <i>end"]
