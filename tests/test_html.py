from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from garimpo.functions import html, url
from garimpo.sources import tables

PAGE = """<html><body><nav><p>menu</p></nav><h1>Tí<b>tulo</b> &amp; mais</h1><script>var t="</p>";</script>
<p>um<p> dois <a href="/x">link</a></p><div class="ad related-posts"><p>fora</p></div><footer><p>fim</p></footer></body></html>"""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "h string").select(column).first()[0]


def test_expressions(spark):
    assert one(spark, PAGE, html.title(F.col("h"))) == "Título &amp; mais"
    assert one(spark, PAGE, html.paragraphs(F.col("h"))) == "um dois link fora"
    assert one(spark, PAGE, html.links(F.col("h"))) == ["/x"]
    assert one(spark, None, html.paragraphs(F.col("h"))) is None


def test_parser_follows_classes_and_entities(spark):
    assert html.parse_page(PAGE) == ("Título & mais", "um dois link", ["/x"])
    assert html.parse_page('<p>x</p><div class="entry-content"><p>a</p><p></p></div>')[1] == "a "
    assert html.parse_page(None) == ("", "", [])
    row = one(spark, PAGE, html.extract(F.col("h")))
    assert (row["title"], row["body"]) == ("Título & mais", "um dois link")


def test_links_resolve_as_a_browser_does(spark):
    bases = ["https://a.example/x/y.html?q=1", "http://b.example", "http://b.example/d/"]
    hrefs = ["/p", "p.html", "../u", "./v/", "//c.example/k", "https://d.example/q#f", "#top", "", "mailto:x@y", " a/../b ", "../../..", "http://e.example", "p/./q/."]
    frame = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in frame.withColumn("got", html.resolved(F.col("h"), F.col("b"))).collect():
        link = urldefrag(r["h"].strip())[0]
        want = urljoin(r["b"], link) if link else None
        assert r["got"] == (want if want and want.startswith("http") else None), r
    odd = spark.createDataFrame([("sem host", "/p"), (None, "/p"), ("http://b.example", None), (None, "http://e.example/q")], "b string, h string")
    assert [r[0] for r in odd.select(html.resolved(F.col("h"), F.col("b"))).collect()] == [None, None, None, "http://e.example/q"]


def test_feeds_are_routed_by_type_or_address(spark):
    frame = spark.createDataFrame([("text/XML", "x"), ("text/html", "https://a.example/Sitemap.txt"), ("text/html", "x"), (None, None)], "m string, u string")
    assert [r[0] for r in frame.select(tables.is_feed(F.col("m"), F.col("u"))).collect()] == [True, True, False, False]


def test_feed_links(spark):
    feed = '<rss><channel><item><link> https://a.example/1 </link></item><item><title>x</title></item><item><link>/rel</link></item></channel></rss>'
    assert one(spark, feed, html.rss_links(F.col("h"))) == ["https://a.example/1"]
    assert html.feed_links("<rss><item>") == [] and html.feed_links(None) == []


def test_content_sufficient(spark):
    good = "<html>" + "<p>" + "a" * 90 + "</p>\n<p>" + "b" * 90 + "</p>\n" + " " * 400
    assert one(spark, good, html.content_sufficient(F.col("h"))) is True
    assert one(spark, good + "data-reactroot", html.content_sufficient(F.col("h"))) is False
    assert one(spark, good.replace("\n", ""), html.content_sufficient(F.col("h"))) is False
    assert one(spark, None, html.content_sufficient(F.col("h"))) is False


def test_domains(spark):
    cases = {"https://www.a.com/x": "a.com", "https://A.com:8080/": "a.com", "not a url": "not a url", "http://u:p@B.org?q": "b.org", None: None, "": ""}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, want string")
    assert all(r["want"] == r["got"] for r in rows.withColumn("got", url.domain(F.col("h"))).collect())
    assert one(spark, "not a url", url.trust_domain(F.col("h"))) == ""
