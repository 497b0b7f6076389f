"""Extraction on small pages, against the standard library's parser where it has an answer."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from webloom import CMS, GENERIC
from webloom.functions import markup as M
from webloom.operators.links import asset_table, link_table
from webloom.operators.rewrite import rewrite_pages

SNIPPETS = [
    '<a href="/x">x</a><A HREF=\'/y\'>y</A><a\nhref=/z>z</a>',
    '<a data-href="/no" href="/yes">x</a>',
    '<a title="1 > 0" href="/gt">x</a>',
    '<a title="see href=/not here" href="/quoted">x</a>',
    '<!-- <a href="/comment"> --><a href="/after">x</a>',
    '<script>var s = \'<a href="/script">\';</script><style>a{content:"<a href=x>"}</style><a href="/end">x</a>',
    '<a name="n">no link</a><a>none</a><abbr href="/abbr">',
    '<a href="/q?a=1&amp;b=2&eacute;&#233;&#x1F600;&bogus;">x</a>',
    '<a href>bare</a>',
    '<a class=5" href="/stray">x</a>',
    '<a href = "/spaces" >x</a><a href="">empty</a>',
    '<script src="/s.js"></script><a href="/after-script"/>',
    "plain text < b > and <a",
    "",
]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and "href" in dict(attrs):
            self.found.append(dict(attrs)["href"] or "")


def test_anchors_equal_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(SNIPPETS)), "i int, html string")
    got = {r.i: r.a for r in df.select("i", M.extract_anchors("html").alias("a")).collect()}
    for i, snippet in enumerate(SNIPPETS):
        parser = Anchors()
        parser.feed(snippet)
        assert got[i] == parser.found, snippet


def test_scanners_survive_hostile_pages(spark):
    hostile = [
        "<a " + "x" * 200_000,
        "<a " + "b=\"1\" " * 50_000 + 'href="/many">',
        "<!--" * 50_000,
        "<script>" + "<a href='/x'>" * 20_000,
        "<a href=\"" + "y" * 100_000 + "\">",
        "<div>" * 50_000 + "<main>x</main>",
        "<main>" * 20_000 + "</main>" * 20_000,
    ]
    df = spark.createDataFrame(list(enumerate(hostile)), "i int, html string").repartition(7)
    out = df.select(
        "i",
        F.size(M.extract_anchors("html")).alias("n"),
        F.size(M.extract_asset_refs("html")).alias("m"),
        F.length(M.extract_title("html", F.lit("http://h/x"))).alias("t"),
        F.length(M.extract_main_content("html")).alias("c"),
    )
    rows = {r.i: r for r in out.collect()}
    assert [rows[i].n for i in range(7)] == [0, 1, 0, 0, 1, 0, 0]
    assert rows[5].c == len("<main>x</main>")
    assert rows[6].c == len(hostile[6])


def test_time_is_linear(spark):
    """Twice the page takes about twice the time, also where no tag is ever closed."""
    import time

    def seconds(tag, size):
        page = spark.createDataFrame([(tag * (size // len(tag)),)], "html string").coalesce(1)
        scan = page.select(
            F.size(M.extract_anchors("html")),
            F.size(M.extract_asset_refs("html")),
            F.length(M.extract_title("html", F.lit("http://h/x"))),
            F.length(M.extract_main_content("html")),
            F.size(M.extract_form_fields("html", "f")),
        )
        best = 1e9
        for _ in range(2):
            start = time.perf_counter()
            scan.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    for tag in ("<a ", "<img ", "<script ", "<form ", "<x ", "<main ", '<a href="', "id="):
        assert seconds(tag, 200_000) < 3 * seconds(tag, 100_000) + 0.2, tag


def test_open_tags_are_dropped(spark):
    pages = ["<a href=/x>1</a><a href=/y", "<img src=/x><img src=/y ", "<script src=/x></script><script src=/y", "<title>t</title><title ", "<main>m</main><main "]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    rows = df.orderBy("i").select(M.extract_anchors("html").alias("a"), M.extract_asset_refs("html").alias("r"), M.extract_main_content("html").alias("m")).collect()
    assert rows[0].a == ["/x"] and [x.href for x in rows[1].r] == ["/x"] and [x.href for x in rows[2].r] == ["/x"]
    assert rows[4].m == "<main>m</main>"


REFERENCES = [
    "&sol;r&lbrack;&comma;1", "a&copy b", "&notit;", "&amp;amp;", "&#000000038;", "&#x26;&#X1F600", "&#0;&#128;&#x9F;", "&#xD800;&#1114112;&#99999999999999999999;",
    "&#1;&#xFFFE;&#xFDD0;", "&NotEqualTilde;", "&bogus;", "&", "&;", "&#;", "&#x;", "&ampx", "&lt&gt", "&CounterClockwiseContourIntegral;", "&Eacute&eacute;",
]


def test_references_equal_the_standard_library(spark):
    import html

    df = spark.createDataFrame(list(enumerate(REFERENCES)), "i int, t string")
    got = {r.i: r.u for r in df.select("i", M.unescape("t").alias("u")).collect()}
    for i, text in enumerate(REFERENCES):
        assert got[i] == html.unescape(text), text


def test_references_in_attributes(spark):
    cases = ["/q&sol;r&lbrack;&comma;1", "?a=1&copy=2", "?a=1&copyx", "?a=1&copy", "?a&amp;b&lt;&#38;", "?a&reg;&notit;", "?x&bogus;y"]
    want = ["/q/r[,1", "?a=1&copy=2", "?a=1&copyx", "?a=1\u00a9", "?a&b<&", "?a\u00ae&notit;", "?x&bogus;y"]
    df = spark.createDataFrame([(i, f'<a href="{c}">x</a>') for i, c in enumerate(cases)], "i int, html string")
    assert [r.a[0] for r in df.orderBy("i").select(M.extract_anchors("html").alias("a")).collect()] == want


def test_titles(spark):
    cases = [
        ("<title> A &amp; B &mdash; C\u00a0</title>", "http://h/x", "A & B \u2014 C"),
        ("<title></title>", "http://h/x", ""),
        ("<h1>none</h1>", "http://h/a/b.html", "b.html"),
        ("<h1>none</h1>", "http://h/a/", "Untitled"),
        ("<!-- <title>no</title> --><TITLE lang=en>Yes</TITLE>", "http://h/x", "Yes"),
        ("<script>'<title>no</title>'</script><title>Yes\n</title><title>second</title>", "http://h/x", "Yes"),
        ("<titles>no</titles>", "http://h/x", "x"),
    ]
    rows = spark.createDataFrame(cases, "html string, url string, want string").select("want", M.extract_title("html", "url").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_main_content(spark):
    cases = [
        ("<body><article>a</article><main>m</main></body>", "<main>m</main>"),
        ("<body><div id='content'>c</div><article>a</article></body>", "<article>a</article>"),
        ('<body><div class="content">x</div><div id="content"><div>in</div>out</div></body>', '<div id="content"><div>in</div>out</div>'),
        ('<p class="entry-content">e</p><div class="a content b"><div></div><div/>y</div><div>z</div>', '<div class="a content b"><div></div><div/>y</div>'),
        ('<p class="my-content">n</p><p class="entry-content">e</p>', '<p class="entry-content">e</p>'),
        ("<html><body class=k>all<p>b</body></html>", "<body class=k>all<p>b</body>"),
        ("<html><body>never closed</html>", "<body>never closed"),
        ("<body><main>open <p>x</body></html>", "<main>open <p>x"),
        ("<main>1<main>2</main>3</main>4", "<main>1<main>2</main>3</main>"),
        ("<main>a<!-- </main> -->b<script>'</main>'</script></main>c", "<main>a<!-- </main> -->b<script>'</main>'</script></main>"),
        ("<!-- <main>no</main> --><mainly>n</mainly><ARTICLE>Y</ARTICLE>", "<ARTICLE>Y</ARTICLE>"),
        ('<img class="content" src=x>after', '<img class="content" src=x>'),
        ("<p>nothing</p>", ""),
        ("", ""),
    ]
    rows = spark.createDataFrame(cases, "html string, want string").select("want", M.extract_main_content("html").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_form_fields(spark):
    html = (
        '<form id="other"><input type="hidden" name="no" value="1"></form>'
        '<form method=post id="loginform"><input type=hidden name=a value="1"><input type="hidden" name="b">'
        '<input type="text" name="log" value="x"><input type="hidden" value="nameless"><input type="hidden" name="a" value="2&amp;3"/></form>'
    )
    got = spark.createDataFrame([(html,), ("<p>",)], "html string").select(M.extract_form_fields("html", "loginform").alias("f")).collect()
    assert got[0].f == {"a": "2&3", "b": ""}
    assert got[1].f is None


PAGE = (
    '<html><head><link rel="stylesheet" href="/t/s.css?ver=1"><link href="/t/s.css"><link rel=icon href=\'i/icon.png\'>'
    '<script src="../j/a.js">var x = \'<img src="/no.png">\';</script><!-- <img src="/c.png"> --></head>'
    '<body><img data-src="/lazy.png" SRC=/i/p.png alt="src=/i/p.png"><img src="https://cdn.example/x.png"><a href="/t/s.css">css</a>'
    '<source src="/m/v.svg"></body></html>'
)


def test_rewrite_changes_only_saved_references(spark):
    pages = spark.createDataFrame([(1, "http://h.example/en/page", PAGE)], "page_id long, url string, html string")
    got = rewrite_pages(pages, CMS).collect()[0]
    assert got.path == "en/page/index.html"
    assert got.content == (
        '<html><head><link rel="stylesheet" href="/t/s.css?ver=1"><link href="../../t/s.css"><link rel=icon href="../i/icon.png">'
        '<script src="../../j/a.js">var x = \'<img src="/no.png">\';</script><!-- <img src="/c.png"> --></head>'
        '<body><img data-src="/lazy.png" src="../../i/p.png" alt="src=/i/p.png"><img src="https://cdn.example/x.png"><a href="/t/s.css">css</a>'
        '<source src="../../m/v.svg"></body></html>'
    )
    generic = rewrite_pages(pages, GENERIC).collect()[0]
    assert 'href="../../../css/s.css"' in generic.content and 'src="../../../images/p.png"' in generic.content


def test_asset_options(spark):
    pages = spark.createDataFrame([(1, "http://h.example/en/page", PAGE)], "page_id long, url string, html string")
    by_default = {r.asset_url for r in asset_table(pages, CMS).collect()}
    stripped = {r.asset_url for r in asset_table(pages, CMS.with_(strip_query_for_ext=True)).collect()}
    assert stripped - by_default == {"http://h.example/t/s.css?ver=1"}
    excluded = spark.createDataFrame([(1, "http://h.example/", '<img src="/wp-login.php"><a href="/wp-login.php">')], "page_id long, url string, html string")
    assert asset_table(excluded, CMS).count() == 0
    assert [r.dst for r in link_table(excluded).collect()] == ["http://h.example/wp-login.php"]
