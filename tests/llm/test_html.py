import pytest

from rankweave.llm import html_extract as H

NEWS = (
    '<html><head><title>t</title><style>p{}</style></head><body><header class="top"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div class="wrap with-sidebar"><div class="story"><h1>Big &amp; small</h1><p>First <b>par</b>t<br>two.</p><div class="ad-slot">Buy</div>'
    "<p>Second   one\n here &#233;.</p><form><p>Sign up</p></form></div><aside>Other</aside></div><section class='comments'><p>So long comment that it is longer than all of the article itself, by far.</p></section>"
    "<footer>&copy; us</footer><script>var a = '<p>no</p>';</script></body></html>"
)
TEXT = "Big & small First part two. Second one here é."


def test_one_page():
    assert H.extract(NEWS, None) == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<p>a<!-- open <p>b", "a"), ("<script>x", ""), ("a < b &amp; c", "a < b & c"), ("<div><p>&am", "&am"), ("<article>x<b>y</article><footer>z", "xy")],
)
def test_broken_markup(html, text):
    assert H.extract(html, None) == text


def test_consensus_helps_a_page_that_misleads(spark):
    """On one page a related box outweighs the story; the host's other pages say where it is."""
    page = lambda story, box: f'<body><div class="story-{story[:1]}1"><p>{story}</p></div><div class="box"><p>{box}</p></div></body>'
    rows = [(k, "http://h.example/p", page("story " * 30, "small")) for k in range(5)]
    rows.append((5, "http://H.example:80/q", page("story", "long " * 50)))
    out = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert out[5].text == "story" and out[0].text == ("story " * 30).strip()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no url", NEWS), (3, "http://a.example/x", NEWS), (3, "http://a.example/x", NEWS), (None, "http://a.example/y", "")]
    df = spark.createDataFrame([(*r, "w", "h") for r in rows], "page_id long, url string, html string, winner string, host string")
    out = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract_pages(df).collect())
    assert [t[2] for t in out] == ["", "", TEXT, TEXT, TEXT] and all(t[3] == len(t[2]) for t in out)
    assert H.extract_pages(df.limit(0)).isEmpty()


@pytest.mark.parametrize("box", ["article", "div class=post"])
@pytest.mark.parametrize("first", ["<h1>Title</h1>", "<div class=lead><p>Title</p></div>"])
def test_text_beside_the_largest_child_stays(spark, box, first):
    page = lambda k: f"<body><{box}>{first.replace('Title', f'Title {k}')}<div class=entry><p>{f'long{k} ' * 30}</p></div></{box.split()[0]}></body>"
    text = lambda k: f"Title {k} " + (f"long{k} " * 30).strip()
    assert H.extract(page(1), None) == text(1)
    rows = [(k, "http://h.example/p", page(k)) for k in range(4)]
    out = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in out] == [text(k) for k in range(4)]


def test_pages_of_a_second_template_are_whole(spark):
    """The host's winning path holds no more than a teaser on them."""
    one = lambda k: f"<body><div class=story><p>{f'story{k} ' * 30}</p></div></body>"
    two = "<body><div class=story><p>teaser</p></div><div class=report><p>" + "report " * 50 + "</p></div></body>"
    rows = [(k, "http://h.example/p", one(k)) for k in range(5)] + [(5, "http://h.example/q", two)]
    out = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert out[5].text == "teaser " + ("report " * 50).strip() and out[0].text == ("story0 " * 30).strip()


@pytest.mark.parametrize("kind", ["content with-sidebar", "no-sidebar", "has-header", "content sidebar-left", "layout-with-left-rail", "post comments", "related"])
@pytest.mark.parametrize("brand", ["", "<div><h1>Site</h1></div>"])
def test_class_words_of_a_wrapper_do_not_empty_a_page(kind, brand):
    """Comments are the exception: beside other text they go, however long."""
    html = f'<body>{brand}<div class="{kind}"><h2>Head</h2><p>The article itself.</p><div class="ad">Buy</div></div><div class="share"><p>Like</p></div></body>'
    text = H.extract(html, None)
    if kind == "post comments":
        assert text == "Site" if brand else "Head The article itself." in text
    else:
        assert text == ("Site " if brand else "") + "Head The article itself."


def test_class_words_count_beside_an_article():
    assert H.extract("<article><p>Short.</p></article><div class=sidebar><p>Much longer than the article is.</p></div>", None) == "Short."


STORY = ("A long story sentence here. " * 10).strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<nav>x</nav><div class="post-form"><h2>Head</h2><p>{STORY}</p></div>', f"Head {STORY}"),
        (f'<div class="popular-science"><p>{STORY}</p></div><div class="other"><p>Short other text.</p></div>', f"{STORY} Short other text."),
        (f'<article><h1>T</h1><p>{STORY}</p><div class="alert"><p>A notice.</p></div><p>end</p></article>', f"T {STORY} end"),
        ('<nav><a href=/>Home</a></nav><div class=story><p><a href="/x">A story that is one link</a> yes</p></div>', "A story that is one link yes"),
    ],
)
def test_no_page_is_emptied_by_words_or_links(html, text):
    assert H.extract(f"<body>{html}</body>", None) == text
