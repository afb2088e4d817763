import itertools
import random
import time

import numpy as np

from slidespark.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a = "</p>";</script></head><body><nav><a href="/x">menu one</a></nav>
<div class="ad">buy this</div><article><h1>Head &amp; line</h1><p>First   para<b>graph</b> &eacute;&#33;<br>more<p>Second one &lt;kept&gt;</article>
<div id="comments"><p>a reader says</p></div><form><input value="x">send</form><aside>side</aside><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE) == "Head & line First paragraph é! more Second one <kept>"
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<div class='sidebar'>x</div>") == ""
    assert H.main_text("<p>plain text</p> tail") == "plain text tail"
    assert "kept" in H.main_text("<body><article><p>kept <b") and "b" not in H.main_text("<article><p>kept <b").replace("kept", "")


def test_very_long_page():
    page = "<body><article>" + "".join(f"<p>word {i}</p>" for i in range(20000)) + "</article>" + "<div>" * 3000
    assert H.main_text(page).endswith("word 19999")


def test_min_cut_is_least():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 8)
        score = [r.choice([-3, -1, -0.5, 0.5, 1, 2]) + r.random() / 10 for _ in range(n)]
        edges = [(i, j, r.random() * 2) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda s: sum(abs(x) for x, on in zip(score, s, strict=True) if (x > 0) != on) + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: E731, B023
        best = min(map(cost, itertools.product((False, True), repeat=n)))
        assert abs(cost(H.min_cut(score, edges)) - best) < 1e-9


def test_query_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    out = H.digest(df).collect()
    assert sorted(x.n_chars for x in out) == [0, 53, 53] and all(x.n_chars == len(x.text) for x in out)
    assert H.digest(df.limit(0)).count() == 0
    assert H.extract(df).columns == ["page_id", "url", "html", "text", "n_chars"]


WEIGHTS = np.array([-1.0, -2.0, -1.0, 0.5, 0.5, -1.0, -2.0, 1.0, 0.5, 1.5, -1.0, 1.0, 0.0, -2.0])


def any_page(r, n):
    word = lambda: r.choice(["alpha", "Beta", "x7", "gamma.", "&amp;"])
    out = []
    for _ in range(n):
        text = " ".join(word() for _ in range(r.choice([1, 3, 12, 40])))
        out.append(r.choice(["<p>{}</p>", "<li>{}</li>", "<div>{}</div>", "<h2>{}</h2>", "<nav>{}</nav>", "<p><a href='u'>{}</a></p>", "<div class='promo'>{}</div>"]).format(text))
    if r.random() < 0.3:
        out.insert(r.randrange(n), "<article><p>inside</p></article>")
    return "<body>" + "".join(out)


def test_text_is_that_of_the_least_cut():
    r = random.Random(11)
    flipped = 0
    for _ in range(80):
        page = any_page(r, r.randint(1, 8))
        blocks = H.scan(page)
        score = [H.odds(b, WEIGHTS) for b in blocks]
        pull = {}
        for i, j in itertools.combinations(range(len(blocks)), 2):
            between = [b["holder"] for b in blocks[i + 1 : j]]
            pull[i, j] = H.NEXT * (j == i + 1) + H.SIBLING * (blocks[i]["holder"] == blocks[j]["holder"] not in between)
        cost = lambda s: sum(abs(x) for x, on in zip(score, s, strict=True) if (x > 0) != on) + sum(w for (i, j), w in pull.items() if s[i] != s[j])  # noqa: E731, B023
        ways = sorted(itertools.product((False, True), repeat=len(blocks)), key=cost)
        texts = {" ".join(b["text"] for b, on in zip(blocks, w, strict=True) if on) for w in ways if cost(w) < cost(ways[0]) + 1e-9}
        assert H.main_text(page, WEIGHTS) in texts
        flipped += H.label(blocks, WEIGHTS) != [x > 0 for x in score]
    assert flipped > 10


def test_known_containers_outweigh_all_neighbours():
    assert H.INSIDE - H.LEARNED > 2 * (H.NEXT + H.SIBLING) and -H.OUT - H.LEARNED > 2 * (H.NEXT + H.SIBLING)


def test_neighbours_decide_where_containers_say_nothing():
    short, long = "<p>Yes.</p>", "<p>" + "Words of a paragraph go on, " * 8 + "and end.</p>"
    page = f"<div>{long}{long}{short}{long}</div><div>{short}</div>"
    alone = [H.odds(b, WEIGHTS) > 0 for b in H.scan(page)]
    assert not alone[2] and H.label(H.scan(page), WEIGHTS)[2]


def test_undecided_pages_scale():
    r = random.Random(2)
    page = any_page(r, 30_000)
    began = time.perf_counter()
    H.main_text(page, WEIGHTS)
    assert time.perf_counter() - began < 30


def test_classifier_learns_from_known_containers(spark):
    page = "<nav><li><a>one</a></li><li><a>two</a></li></nav><article><p>" + "A sentence of some words, more words. " * 9 + "</p><p>Short one.</p></article>"
    w = H.train(spark.createDataFrame([(page,)] * 30 + [(None,)], "html string"))
    score = lambda html: H.odds(H.scan(html)[0], w)
    assert score("<div><p>Another sentence, of its own.</p></div>") > H.PLAIN > score("<div><li><a>three</a></li></div>")
    assert not H.train(spark.createDataFrame([("<p>x</p>",)], "html string")).any()
