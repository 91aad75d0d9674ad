import itertools
import random

from newsloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{margin:0}</style><script>var t="</p>";x(1);</script></head><body>
<div id="cookie-notice"><p>We use cookies. Please accept all of them now, it is for the best of us all.</p></div>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- ad 1 -->
<div class="ad">Buy now. This is a really great offer, and it ends today.</div>
<article><header><h2>Big   news &amp; more</h2></header><p><b>First para&shy;graph with<br>some words.<p>Short.</p>
<form><p>Leave your name and your mail address here. We write to you.</p></form>
<p>Last one, with several more words in it &lt;than&gt; before, &amp it ends.</p>
<div class="comments"><p>I disagree with all of this. It is nonsense, and I say so.</p></div></article>
<aside><p>Related: another story that may interest you. Read on.</p></aside><footer>&copy; 2024 Site. All rights.</footer>"""


def test_article_without_boilerplate():
    assert H.main_text(PAGE) == ("Big news & more First para­graph with some words. Short. "
                                 "Last one, with several more words in it <than> before, & it ends.")


def test_page_without_article_element():
    page = ("<body><div class='menu'><a href=1>Home</a> <a href=2>News</a></div><div class='story'>"
            "<p>A long paragraph of the story, with many words in it. It has two sentences.</p><p>Short one.</p>"
            "<p>Another long paragraph of the story, with many words in it. It ends here.</p></div>"
            "<div class='sidebar'><p>Weather today. Sunny, with some clouds, and rain later.</p></div>")
    text = H.main_text(page)
    assert text.startswith("A long") and "Short one." in text and "Weather" not in text and "Home" not in text


STORY = ("<p>A long paragraph of the story, with many words in it. It has two sentences.</p>"
         "<p>Another long paragraph of the story, with many words in it. It ends here.</p>")
STORY_TEXT = STORY.replace("</p><p>", " ").replace("<p>", "").replace("</p>", "")


def test_boilerplate_words_around_the_article():
    """One such word on an element that holds the article does not lose it; beside and inside it, it counts."""
    card = "<div class='related'><article><p>A card of another story. Read it.</p></article></div>"
    for page in (f"<html class='no-search'><body class='has-sidebar'><article>{STORY}</article></body></html>",
                 f"<body><div id='page-with-menu'><article>{STORY}</article>{card}</div></body>",
                 f"<body><article class='post social'>{STORY}<div class='comments'><p>I say no. Never.</p></div></article></body>",
                 f"<body class='sidebar'><main class='page-with-menu'>{STORY}</main></body>",
                 f"<body><div class='nav-header'><main><div class='has-sidebar'><article>{STORY}</article></div></main></div></body>",
                 f"<body><form id='f'><div class='sidebar'><p>Weather today. Sunny.</p></div><article>{STORY}</article></form>"):
        assert H.main_text(page) == STORY_TEXT, page
    nested = f"<article>{STORY}<article class='comment'><p>I disagree with all of this. It is wrong.</p></article></article>"
    assert H.main_text(nested) == STORY_TEXT


JUNK = ([f"<div class='{w}'>{{}}</div>" for w in (
            "ad", "advert", "sponsored", "cookie-notice", "notice", "gdpr-consent", "sidebar", "menu", "breadcrumbs", "footer",
            "share-bar", "comments", "related", "newsletter", "signup", "pagination", "copyright", "widget")]
        + ["<div id='comments'>{}</div>", "<section role='navigation'>{}</section>", "<div hidden>{}</div>", "<p class='ad'>{}</p>"]
        + [f"<{t}>{{}}</{t}>" for t in ("nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset")]
        + ["<article class='comment'>{}</article>", "<ul class='related'><li>{}</li></ul>", "<form><fieldset><div>{}</div></fieldset></form>"])


def test_junk_goes_at_any_length_and_place():
    """Every named kind x plain text or a paragraph inside x four lengths x before, between and behind the article's paragraphs, and outside."""
    first, second = STORY.split("</p>")[0] + "</p>", STORY.split("</p>")[1] + "</p>"
    for kind, inner, length in itertools.product(JUNK, ("{}", "<p>{}</p>"), (1, 4, 40, 900)):
        if kind.startswith("<p") and inner != "{}":
            continue
        text = " ".join(f"{w}." if i % 9 == 8 else w for i, w in enumerate(["filler", "words", "here"] * length))[:length * 6]
        junk = kind.format(inner.format(text))
        for body in (junk + first + second, first + junk + second, first + second + junk, first + junk + junk + second):
            assert H.main_text(f"<body><article>{body}</article></body>") == STORY_TEXT, junk[:80]
        for page in (f"{junk}<article>{STORY}</article>", f"<article>{STORY}</article>{junk}", f"{junk}{STORY}", f"{STORY}{junk}",
                     f"<div class='story'>{first}{junk}{second}</div>"):
            assert H.main_text(f"<body>{page}</body>") == STORY_TEXT, page[:120]


def test_pages_without_containers():
    assert H.main_text("<body><p>One plain page with no containers.</p><p>Tiny.</p></body>") == "One plain page with no containers. Tiny."
    assert H.main_text("Just text") == "Just text"
    assert H.main_text("<h1>Title</h1>Text after<p>and more") == "Title Text after and more"
    links = "<ul>" + "".join(f"<li><a href='{i}'>Link {i}</a>" for i in range(9)) + "</ul>"
    assert H.main_text(f"<body>{links}<p>The page says this much and no more.</p></body>") == "The page says this much and no more."


def test_given_pages():
    """The given pages state their article: its blocks, one after the other."""
    import html
    import re

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    assert len(rows) > 100
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert H.main_text(r["html"]) == " ".join(b for b in blocks if b), r["page_id"]


def test_deep_pages_take_linear_time():
    import time

    start = time.time()
    deep = "<div class='side'>" * 20_000 + "x" + "<p>word</p>" * 20_000 + "</span></center>" * 20_000
    H.main_text(deep)
    H.main_text("<article>" + "<div><p>some words here.</p>" * 20_000)
    assert time.time() - start < 60


def test_text_of_formulas_and_drawings():
    page = ("<article><p>We know that <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a=b</annotation></math> holds, and "
            "<svg><title>t</title><text>so</text></svg> does <object data='x'>this text</object> here.</p></article>")
    assert H.main_text(page) == "We know that a=b holds, and so does this text here."


def test_broken_markup():
    for page in ("", "<", "<p", "<article>a<b>c</i></article", "<!--", "<script>", "</p></div>", "<p>&#x110000; &bogus; &", "<a href='x>y"):
        assert isinstance(H.main_text(page), str)
    assert H.main_text("<article><p>One two three.<p>Four five six.</article>") == "One two three. Four five six."
    assert H.main_text("<article>" + "<div>" * 300 + "deep text here" + "</article>") == "deep text here"


def test_min_cut_is_minimal():
    random.seed(2)
    for _ in range(300):
        n = random.randint(1, 8)
        unary = [random.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, random.randint(1, 6)) for i in range(n) for j in range(i) if random.random() < 0.5]

        def cost(labels):
            return (sum(abs(c) for i, c in enumerate(unary) if (c > 0) != labels[i] and c)
                    + sum(c for i, j, c in edges if labels[i] != labels[j]))

        assert cost(H.min_cut(unary, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_spark_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "word. " * 60_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_text(df).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == [H.main_text(PAGE)] * 2
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert H.extract_text(df.limit(0)).collect() == []
