import time

import pytest

from vqloom.llm import htmltext as H


def test_held_out_pages():
    model, wrong = H.default_model(), 0
    pages = H.labelled_pages(150, seed=77)
    for html, content in pages:
        runs = [" ".join("".join(n.text).split()) for n in H.parse(html) if n.tag == "#"]
        wrong += model.text(html) != " ".join(x for x in runs if x in content)
    assert wrong <= 9


def test_marginals_match_enumeration():
    import itertools
    import math

    nodes = H.parse("<div><p>a</p><ul><li>b c</li></ul></div><nav>x</nav>")
    features = [[i % 5, 7] for i in range(len(nodes))]
    unary = [0.3 * ((i * 7) % 5 - 2) for i in range(len(H.FEATURE_NAMES))]
    pair = [(0.4, -0.2 * k, 0.1, 0.5 * k) for k in range(H.EDGE_KINDS)]
    z, on, both = 0.0, [0.0] * len(nodes), {}
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(y[i] * sum(unary[f] for f in features[i]) for i in range(len(nodes)))
        s += sum(pair[H.edge_kind(n)][2 * y[n.up] + y[i]] for i, n in enumerate(nodes) if i)
        w = math.exp(s)
        z += w
        for i in range(len(nodes)):
            on[i] += w * y[i]
            both[i, y[nodes[i].up], y[i]] = both.get((i, y[nodes[i].up], y[i]), 0) + w
    prob, joint, total = H.marginals(nodes, features, unary, pair)
    assert math.isclose(total, math.log(z))
    for i in range(len(nodes)):
        assert math.isclose(prob[i], on[i] / z)
        if i:
            assert all(math.isclose(joint[i][2 * a + b], both[i, a, b] / z) for a in (0, 1) for b in (0, 1))


def test_text_rules(spark):
    html = "<html><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one<b>two</b>  three<br>four &eacute;.<p>Next one, a longer line of text. &lt;p&gt;<script>no()</script></article><footer>&copy; x</footer>"
    rows = [(1, "u", html), (2, "u", None), (3, "u", ""), (4, None, "<<<>>& &bogus; <p"), (5, "u", "<!-- <p>never -->"), (5, "u", "<!-- <p>never -->"), (None, "u", "<div>" * 3000 + "x"), (7, "u", "<p>" + "word " * 200_000 + "end.")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.op7_html(df).collect()}
    assert got[1]["text"] == "A & B onetwo three four é. Next one, a longer line of text. <p>"
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[5]["text"] == ""
    assert H.op7_html(df).count() == len(rows) and H.op7_html(df.limit(0)).count() == 0


#: Pages written by hand in the manner of common site software, none from the training grammar: parts, True for main text.
WRITTEN = [
    [("<html><body class='home blog'><div id='masthead'><a href='/'>The Garden Diary</a><p>Notes from a small plot</p></div><div id='primary' class='content-area'><div class='entry-content'>", None), ("<h1>Planting garlic in October</h1>", "Planting garlic in October"), ("<p>Garlic wants a cold spell, so put the cloves in before the first hard frost.</p>", "Garlic wants a cold spell, so put the cloves in before the first hard frost."), ("<p>Set them <em>two inches</em> deep, the flat end down, and cover the bed with straw.</p>", "Set them two inches deep, the flat end down, and cover the bed with straw."), ("</div></div><div id='secondary' class='widget-area sidebar'><h3>Recent posts</h3><ul><li><a href=1>Leeks</a></li><li><a href=2>Kale</a></li></ul></div><div id='footer'><p>&copy; The Garden Diary. All rights reserved.</p></div></body></html>", None)],
    [("<body><header class='site-header'><nav class='main-nav'><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></nav></header><main><article class='story comments-off'>", None), ("<h1>Ferry service returns after storm</h1>", "Ferry service returns after storm"), ("<p>The morning ferry left on time today for the first time in a week.</p>", "The morning ferry left on time today for the first time in a week."), ("<figure><img src=f.jpg><figcaption>The ferry at the north quay on Tuesday.</figcaption></figure>", "The ferry at the north quay on Tuesday."), ("<div class='ad-slot advert'><p>Book your summer cabin now and save.</p></div>", None), ("<p>Operators said that all sailings should run to the usual timetable until Sunday.</p>", "Operators said that all sailings should run to the usual timetable until Sunday."), ("</article></main><section id='comments'><h2>Comments</h2><div class='comment'><p>About time, I have been stuck here for days.</p></div></section><footer><p>Contact the newsroom.</p></footer>", None)],
    [("<body><div class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>Accept</button></div><nav class='breadcrumb'><ul><li><a href=/>Docs</a></li><li><a href=/api>Reference</a></li></ul></nav><div class='page-content'>", None), ("<h1>Reading a file</h1>", "Reading a file"), ("<p>Call the function with a path. It returns the whole content as one string.</p>", "Call the function with a path. It returns the whole content as one string."), ("<h2>Options</h2>", "Options"), ("<ul><li>encoding: the name of the encoding</li>", "encoding: the name of the encoding"), ("<li>mode: text or binary</li></ul>", "mode: text or binary"), ("<p>An error is raised if the file does not exist &amp; cannot be made.</p>", "An error is raised if the file does not exist & cannot be made."), ("</div><aside class='toc'><ul><li><a href=#a>Reading</a></li><li><a href=#b>Options</a></li></ul></aside><footer>Licensed under a free licence.</footer>", None)],
    [("<body><form class='search'><label>Search</label><input name=q><button>Go</button></form><div id='wrapper'><div id='article' class='no-sidebar'>", None), ("<h1>On keeping bees</h1>", "On keeping bees"), ("<p>A hive in spring is a busy place, and the keeper should be slow and calm.<br>Smoke helps.", "A hive in spring is a busy place, and the keeper should be slow and calm. Smoke helps."), ("<p>By June the colony may hold sixty thousand workers, all daughters of one queen.", "By June the colony may hold sixty thousand workers, all daughters of one queen."), ("<blockquote><p>The keeping of bees is like the direction of sunbeams.</p></blockquote>", "The keeping of bees is like the direction of sunbeams."), ("</div></div><div class='related'><h3>Related</h3><ul><li><a href=1>Honey cakes</a></li></ul></div>", None)],
]


@pytest.mark.parametrize("page", WRITTEN)
def test_pages_written_by_hand(page):
    want = " ".join(text for _, text in page if text)
    assert H.default_model().text("".join(html for html, _ in page)) == want


def test_one_name_does_not_decide():
    text = "A sentence that is long enough to be read as text."
    for names in ("comments-off article", "no-sidebar", "post with-sidebar", "content no-comments"):
        assert H.default_model().text(f'<div class="{names}"><h1>Title of it</h1><p>{text}</p><p>{text}</p></div>').endswith(text)


HOSTILE = ['<a "' * 300_000, "<a ='" * 250_000, "</div>" * 180_000, "<b>" * 150_000 + "</i>" * 150_000, "<font>" * 100_000 + "<p>" * 150_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000, "<p><td>" + "<font>" * 100_000 + "<div>" * 100_000, "<ul>" + "<li><b>" * 150_000, "<script>" * 130_000, "<!--" * 260_000, "<x" * 500_000]


@pytest.mark.parametrize("html", HOSTILE, ids=lambda h: h[:12])
def test_hostile_pages_stay_linear(html):
    began = time.time()
    assert H.parse(html) and time.time() - began < 10


def test_markup_in_scripts_stays_there():
    html = "<article><p>One sentence that stands before it all.</p><script>if (a<b && c == \"x\") d('</p>');</script><p>One sentence that stands behind it all.</p></article>"
    assert H.default_model().text(html) == "One sentence that stands before it all. One sentence that stands behind it all."
