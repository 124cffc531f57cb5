"""Main text of pages of several makes, and the scan against all regions."""

import random

from pyspark.sql import functions as F

from placewright.llm import op13_html_text as op13

from .test_simple_ops import oracle, same

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"
PLAIN = op13.Weights({}, op13.COSTS[0])
TEXT = ["The river rose again on Tuesday after a week of steady rain in the hills above the town.", "Wardens asked people near the old bridge to move their cars & boats before nightfall.", "By morning the water had reached the second step of the mill, where it stood for two days."]
BEFORE = '<header class="site-header"><h1>Daily Flood</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/w">Weather</a></li></ul></nav></header>'
NOTICE = '<div class="cookie-notice"><p>We use cookies to make this site better for you and for everybody else who reads it.</p><button>Accept all</button></div>'
ADVERT = '<div class="ad"><p>Buy our boots today, they are good boots for every kind of weather and for everyone.</p></div>'
SIDE = '<aside class="related"><h3>Related</h3><ul><li><a href="/1">Ten bridges to see</a></li><li><a href="/2">A mill restored</a></li></ul></aside>'
FORM = '<form action="/s"><label>Your mail address for our weekly letter about rivers and mills</label><input name="m"><textarea>write here</textarea></form>'
COMMENTS = '<section id="comments"><h3>2 comments</h3><article class="comment"><p>My cellar is full of water again, thank you for nothing.</p></article><div class="comment-body"><p>Ours too, and the wardens never came to us at all.</p></div></section>'
AFTER = "<footer><p>&copy; Daily Flood &middot; All rights reserved, as they are every year.</p></footer>"
WANT = " ".join(["A wet week", *TEXT])


def body(open_, close, middle=""):
    text = [t.replace("&", "&amp;") for t in TEXT]
    return f"{open_}<h1>A wet week</h1><p>{text[0]}</p><p>{text[1]}</p>{middle}<p>{text[2]}</p>{close}"


def page(inner):
    return f'<!DOCTYPE html><html><head><title>A wet week &ndash; Daily Flood</title><style>p{{margin:0}}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">{inner}</body></html>'


def test_oracle(spark):
    same(op13.op13_html_text(spark, SF), oracle(op13.ORACLE, SF))


def test_without_marks(spark):
    """What was learned from marked articles finds them where the marks are hidden."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = op13.fitted(pages)
    hidden = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    got = {r.page_id: r.text for r in op13.extract(hidden, weights).collect()}
    want = {r.page_id: r.text for r in op13.extract(pages, weights).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_makes():
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post"><div>', "</div></div>"), ('<main><section class="page-wrap"><article class="post">', "</article></section></main>")):
        for middle in ("", ADVERT, SIDE, FORM, "<script>track('<p>x</p>')</script>", '<div hidden><p>Not to be seen by anyone at all.</p></div>', "<!-- <p>left out</p> -->", '<noscript><p>Switch on scripts.</p></noscript>'):
            source = page(BEFORE + NOTICE + ADVERT + body(open_, close, middle) + SIDE + COMMENTS + FORM + AFTER)
            assert op13.main_text(source, PLAIN) == WANT, (open_, middle)


def test_mark_beats_text_beside_it():
    beside = "<div><p>" + "These words stand beside the article and nothing says what they are. " * 4 + "</p></div>"
    assert op13.main_text(page(beside + body("<article>", "</article>") + beside), PLAIN) == WANT


def test_own_header_and_holder():
    own = body('<article><header class="entry-header"><p>From our reporter in the hills.</p></header>', "</article>")
    assert op13.main_text(page(BEFORE + own), PLAIN) == "From our reporter in the hills. " + WANT
    assert op13.main_text(page('<div class="social-widget">' + body("<article>", "</article>") + "</div>"), PLAIN) == WANT


def test_text():
    cases = {
        "<p>a<b>b</b> <i>c</i>d<br>e</p><p> f\n\tg </p>": "ab cd e f g",
        "<p>x &lt;b&gt; &amp;amp; &#233;&#x20AC;&nbsp;y &am &copy</p>": "x <b> &amp; é€ y &am ©",
        "<p>1 < 2 and 3 > 2 </ p> <3 you</p>": "1 < 2 and 3 > 2 <3 you",
        "<P CLASS=lead>Upper <BR/>case</P><td>cell</td><td>two</td>": "Upper case cell two",
        "words <a href='x' title=\"a > b\">in</a> <a hre": "words in",
        "<p>open <b>bold <p>next</div></span> still": "open bold next still",
        "text <!-- never closed <p>more</p>": "text",
        "<title>t</title><p>a</p><script>x": "a",
        "<nav>never closed <p>but all there is</p>": "never closed but all there is",
        "<p a=\"b>c</p><p>d</p>": "c d",
        "": "", "<p></p>": "", "plain": "plain", "<": "<", "a </": "a </",
    }
    #: Tags cost nothing here, so all text is in the region.
    for source, want in cases.items():
        assert op13.main_text(source, op13.Weights({}, 0.0)) == want, source


def test_region_is_the_best():
    rng = random.Random(4)
    weights = op13.Weights({"word unmarked": 0.7, "link unmarked": 0.2, "p": 0.9, "/p": 0.6, "div": 0.1}, 4.0)
    for _ in range(300):
        tokens = [(0, rng.randint(1, 6), rng.random() < 0.3, False) if rng.random() < 0.5 else (-1, rng.choice(["p", "div", "b", "li"]), rng.random() < 0.5, False) for _ in range(rng.randint(0, 30))]
        p = op13.Page([["x"]], tokens)
        value = [n * weights.word(f, "unmarked") if b >= 0 else weights.tag(n, f, "unmarked") for b, n, f, _ in tokens]
        best = max((sum(value[i : j + 1]), -i, -j) for i in range(len(value)) for j in range(i, len(value))) if value else (0, 0, 0)
        found = op13.region(p, weights)
        if best[0] <= 0:
            assert found is None
        else:
            assert abs(sum(value[found[0] : found[1] + 1]) - best[0]) < 1e-9
            assert tokens[found[0]][0] >= 0 and tokens[found[1]][0] >= 0


def test_long_and_hostile():
    """Time stays in proportion to the length."""
    import time

    for unit in ("<p>a <b>b", "<div><a href=x>", "<", "<!", "</div>", '<p class="', "&amp", "<article>x", "<ul><li>a", "<!--", "<nav>", "<p><script>"):
        began = time.perf_counter()
        op13.main_text(unit * 60_000, PLAIN)
        assert time.perf_counter() - began < 8, unit


def test_odd(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, page(body("<article>", "</article>"))), (2, "u", "<p>a b</p>"), (2, "u", "<p>a b</p>"), (3, "v", "<p>" + "word " * 200_000 + "</p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in op13.extract(df, op13.fitted(df)).collect()), key=repr)
    texts = ["", "", WANT, "a b", "a b", ("word " * 200_000).strip()]
    assert got == sorted([(i, u, t, len(t)) for (i, u, _), t in zip(rows, texts, strict=True)], key=repr)
    assert op13.extract(df.limit(0), op13.fitted(df.limit(0))).count() == 0
