from pyspark.sql import functions as F

from newsloom.functions import html as H

PAGE = """<html><head><title>T</title>
<meta content="https://img.example/og.jpg" property="og:image">
<meta property="article:published_time" content="2025-11-28T14:23:17Z"></head>
<body><nav><a href="/x">x</a></nav><script>var s="</p>";</script><!-- c -->
<div class="ad">buy now buy now</div>
<article><h1>Head line</h1><p>First para has <b>four</b> words at least.<p>Second &amp; more &#233;t&#xE9; words here
</article><footer>f</footer></body></html>"""


def row(spark, expr, html=PAGE):
    return spark.createDataFrame([(html,)], "html string").select(expr.alias("r")).first().r


def test_paragraphs_unclosed_and_entities(spark):
    assert row(spark, H.paragraphs(H.container(H.remove_junk(F.col("html"))))) == [
        "First para has four words at least.", "Second & more été words here"]


def test_title_image_date(spark):
    assert row(spark, H.title(F.col("html"))) == "Head line"
    assert row(spark, H.image(F.col("html"))) == "https://img.example/og.jpg"
    assert row(spark, H.published(F.col("html"))) == "2025-11-28T14:23:17Z"
    vis = "<body><span>Posted 12 Jan 2025</span></body>"
    assert row(spark, H.published(F.col("html")), vis) == "Posted 12 Jan 2025"
    assert row(spark, H.image(F.col("html")), '<img class="x" src="/a.png">') == "/a.png"


def test_urls(spark):
    df = spark.createDataFrame([("//x/y",), ("/News/1",), ("rel/2",), ("javascript:void(0)",)], "h string")
    base = F.lit("https://site.example/sec/page.html")
    got = [r.u for r in df.select(H.normalize_url(F.col("h"), base).alias("u")).collect()]
    assert got == ["https://x/y", "https://site.example/News/1", "https://site.example/sec/rel/2", "https://site.example/sec/javascript:void(0)"]
    v = spark.createDataFrame([("javascript:void(0)",), ("/Gomhuria/123.html",), ("/Gomhuria/abc.html",),
                               ("https://other.com/Gomhuria/1.html",)], "u string")
    ok = [r.ok for r in v.select(H.valid_article_url(F.col("u"), "gomhuria", r"/Gomhuria/\d+\.html$").alias("ok")).collect()]
    assert ok == [False, True, False, False]
    assert row(spark, H.amp_url(F.lit("https://b.example/news/1/"))) == "https://b.example/news/1/amp"


def test_strip_html(spark):
    assert row(spark, H.strip_html(F.lit("<p>Tom &amp; <b>Jerry</b></p>"))) == "Tom & Jerry"


def test_nested_junk_removal_and_dot_segments(spark):
    from newsloom.functions import html_tree as HT
    page = ('<body><div class="related-box"><div><p>inner junk one</p></div><p>more junk</p></div>'
            '<article><p>Keep this paragraph text.</p><div class="share"><div>x</div></div></article>'
            '<!-- c --><script>var a="</p>";</script></body>')
    out = spark.createDataFrame([(page,)], "html string").select(HT.remove_junk_nested(F.col("html")).alias("h")).first().h
    assert "junk" not in out and "share" not in out and "script" not in out and "<!--" not in out
    assert "Keep this paragraph text." in out
    df = spark.createDataFrame([("../a/b.html",), ("./c",), ("/d",)], "h string")
    got = [r.u for r in df.select(HT.resolve_url(F.col("h"), F.lit("https://x.example/s/t/page.html")).alias("u")).collect()]
    assert got == ["https://x.example/s/a/b.html", "https://x.example/s/t/c", "https://x.example/d"]
