"""Result pages of every site, article pages and listing payloads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticiario.operators.extract import extract_articles, extract_links
from noticiario.sources import readers
from noticiario.sources.rules import RULES

D = datetime

PAGES = {
    "eldiario": (
        """<a rel="bookmark" href="https://www.eldiario.com.co/fuera/">x</a>
        <div id="tdi_89" class="x"><div class="tdb_module td_module_wrap"><time class="entry-date" datetime="2023-05-06T10:00:00-05:00">x</time>
        <a href="https://www.eldiario.com.co/a/" rel="bookmark" title="t">A</a></div>
        <div class="td_module_wrap"><a rel="bookmark" href="https://www.eldiario.com.co/b/">B</a><time>marzo 3, 2026</time></div>
        <div class="td_module_wrap"><a rel="bookmark" href="https://www.eldiario.com.co/author/c/">C</a></div>
        <div class="td_module_wrap"><a rel="bookmark" href="https://otro.example/d/">D</a></div></div>""",
        [("https://www.eldiario.com.co/a/", D(2023, 5, 6)), ("https://www.eldiario.com.co/b/", D(2026, 3, 3))],
    ),
    "elcolombiano": (
        """<div class="x div_iter_url" data-urldestination="/antioquia/nota-1">a</div>
        <div class="div_iter_url" data-urldestination="/">b</div>""",
        [("https://www.elcolombiano.com/antioquia/nota-1", None)],
    ),
    "bcnoticias": (
        """<div class="td_module_wrap td-x"><a rel="bookmark" href="https://www.bcnoticias.com.co/a"><time datetime="2023-01-02T00:00">x</time></a></div>""",
        [("https://www.bcnoticias.com.co/a", D(2023, 1, 2))],
    ),
    "diariooccidente": (
        """<div class="border-bottom-1px-solid-gray"><a href="https://occidente.co/z">menu</a></div>
        <div class="main-content"><div class="p border-bottom-1px-solid-gray"><a href="https://occidente.co/a">x</a><p>martes 24 de febrero, 2026</p></div>
        <div class="border-bottom-1px-solid-gray"><a href="https://occidente.co/b">x</a><time datetime="">febrero 2, 2026</time></div>
        <div class="border-bottom-1px-solid-gray"><a href="https://x.example/c">x</a></div></div>""",
        [("https://occidente.co/a", D(2026, 2, 24)), ("https://occidente.co/b", D(2026, 2, 2))],
    ),
    "eltiempo": (
        """<article class="c-article c-article--x"><a class="x" href="/no">n</a><a class="page-link c" href="/nota-1?a=1&amp;b=2">x</a></article>""",
        [("https://www.eltiempo.com/nota-1?a=1&b=2", None)],
    ),
    "larepublica": (
        """<a class="result" href="/a">x</a><a class="result x" href="https://www.larepublica.co/b">x</a><a href="/c">x</a>""",
        [("https://www.larepublica.co/a", None), ("https://www.larepublica.co/b", None)],
    ),
    "portafolio": (
        """<article class="c-article"><a href="/a" class="page-link">x</a><time class="c-article__date" datetime="2023-04-15T10:30:00-05:00">x</time></article>
        <article class="c-article"><a class="page-link" href="https://x.example/b">x</a></article>
        <article class="c-article"><a class="page-link" href="https://www.portafolio.co/c">x</a></article>""",
        [("https://www.portafolio.co/a", D(2023, 4, 15)), ("https://www.portafolio.co/c", None)],
    ),
    "publimetro": (
        """<div class="gsc-webResult gsc-result"><a class="gs-title" href="https://www.publimetro.co/a">x</a><span>www.publimetro.co › 2023/07/09</span></div>
        <div class="gsc-webResult"><a class="gs-title" href="https://www.publimetro.co/tags/b">x</a></div>
        <div class="gsc-webResult"><a class="gs-title" href="https://x.example/b">x</a></div>""",
        [("https://www.publimetro.co/a", D(2023, 7, 9))],
    ),
    "las2orillas": (
        """<article class="mg-posts-sec-post"><h4 class="entry-title title"><a href="https://www.las2orillas.co/a">x</a></h4><span class="mg-blog-date"><a href="/2024">agosto 13, 2024</a></span></article>
        <article class="mg-posts-sec-post"><h4 class="entry-title"><a href="https://www.las2orillas.co/category/b">x</a></h4></article>""",
        [("https://www.las2orillas.co/a", D(2024, 8, 13))],
    ),
    "elheraldo": (
        """<div class="queryly_item_row"><a href="/a">x</a><div style="font:1px;color:#555;">03 mar 2026</div></div>
        <div class="queryly_item_row"><a href="/b">x</a></div>""",
        [("https://www.elheraldo.co/a", D(2026, 3, 3)), ("https://www.elheraldo.co/b", None)],
    ),
    "elpilon": (
        """<div><a href="/judicial">Sección</a><a href="/judicial/nota-1">x</a><time datetime="2024-01-15T10:30:00-05:00">x</time></div>
        <div><a href="/judicial/nota-2">sin fecha</a></div>""",
        [("https://elpilon.com.co/judicial/nota-1", D(2024, 1, 15, 10, 30))],
    ),
    "elmeridiano": (
        """<a href="/menu/x">m</a><a class="block p-4 border rounded-lg" href="/nota/1"><p>Judicial • 09/07/2023</p></a>""",
        [("https://elmeridiano.co/nota/1", D(2023, 7, 9))],
    ),
    "tronchandosinfronteras": (
        """<div class="td-module-container"><h3 class="td-module-title"><a href="https://trochandosinfronteras.info/lado">x</a></h3></div>
        <div class="wpb tdi_96 x"><div class="td-module-container"><h3 class="entry-title td-module-title"><a href="https://trochandosinfronteras.info/a">x</a></h3>
        <time class="entry-date td-module-date" datetime="2024-01-15T10:30:00-05:00">x</time></div></div>""",
        [("https://trochandosinfronteras.info/a", D(2024, 1, 15, 10, 30))],
    ),
    "enlacetelevision": (
        """<li class="mvp-blog-story-wrap left"><a href="https://enlacetelevision.com/a" rel="bookmark">x</a><span class="mvp-cd-date left">4 meses ago</span></li>""",
        [("https://enlacetelevision.com/a", D(2025, 9, 3))],
    ),
    "corrillos": (
        """<div class="col-md-12 col-lg-8"><article class="x"><h2 class="post-title"><a href="https://www.corrillos.com.co/a">x</a></h2><span class="post-meta-date post_post_item_Date"><i class="f"></i> agosto 13 de 2024</span></article></div>""",
        [("https://www.corrillos.com.co/a", D(2024, 8, 13))],
    ),
}


@pytest.mark.parametrize("source", list(RULES))
def test_site_rules(spark, source):
    html, expected = PAGES[source]
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    rows = extract_links(pages, RULES[source], now="2026-01-01 00:00:00").orderBy("pos").collect()
    assert [(r.link, r.fecha) for r in rows] == expected


def test_second_choice_of_items(spark):
    html = '<a href="/una">x</a><a class="x" href="/dos/partes">x</a>'
    pages = spark.createDataFrame([(html,)], "html string")
    got = [r.link for r in extract_links(pages, RULES["elmeridiano"]).collect()]
    assert got == ["https://elmeridiano.co/dos/partes"]


def test_article_page(spark):
    html = """<html><head><title>Caf&eacute; &amp; pan</title><style>p{}</style>
      <meta property="article:published_time" content="2024-01-15T10:30:00-05:00"></head>
      <body><nav>menú</nav><article><h1>T&#237;tulo</h1><p>Uno  <b>dos</b>.</p><!-- x --><script>var a="</p>";</script>
      <p> &laquo;tres&raquo; &#8212; cuatro&nbsp; </p></article><footer>pie</footer></body></html>"""
    pages = spark.createDataFrame(
        [(1, html), (2, "<body><p>solo</p></body>"), (3, "nada"), (4, None)], "i int, html string"
    )
    rows = {r.i: r for r in extract_articles(pages).collect()}
    assert rows[1].titulo == "Café & pan"
    assert rows[1].fecha == D(2024, 1, 15, 15, 30)
    assert rows[1].texto == "Título\nUno dos.\n«tres» — cuatro"
    assert rows[2].texto == "solo" and rows[2].titulo == ""
    assert rows[3].texto == "nada" and rows[3].fecha is None
    assert rows[4].texto is None


def test_references_are_decoded_once(spark):
    from noticiario.operators.extract import unescape

    df = spark.createDataFrame(
        [("&amp;lt; &#38;gt; &lt; &unknown; &#8364; & &aacute;&aacute;",), ("a",), (None,)], "t string"
    )
    got = [r[0] for r in df.select(unescape(F.col("t"))).collect()]
    assert got == ["&lt; &gt; < &unknown; € & áá", "a", None]


def test_payloads_that_are_no_json(spark):
    bad = spark.createDataFrame([(1, "broken"), (2, None), (3, "[]"), (4, "{}")], "i int, body string")
    assert readers.read_wp_posts(bad).count() == 0
    assert readers.read_queryly(bad).count() == 0
    assert readers.read_rss(bad).count() == 0


def test_unwrap_decodes_script_escapes(spark):
    wrapped = r"""x = JSON.parse('{\"items\":[{\"link\":\"/a\\/b\",\"pubdate\":\"ene 5, 2023\",\"title\":\"Caf\\u00e9 it\'s \\x41\"}],\"metadata\":{\"total\":7}}');"""
    df = spark.createDataFrame([(wrapped,)], "raw string")
    body = df.select(readers.unwrap_jsonp(F.col("raw")).alias("body"))
    row = readers.read_queryly(body, ["es_as_en"]).first()
    assert (row.link, row.fecha, row.total) == ("/a/b", D(2023, 1, 5), 7)


def test_references_never_fail(spark):
    from pyspark.sql import functions as F

    from noticiario.operators.extract import unescape

    cases = {
        "&#55357;&#56832; x": "😀 x", "&#55357; &#56832;": "� �", "&#65536;": "\U00010000", "&#128512;": "😀",
        "&#x27;&#X1f600;": "'😀", "&#999999999;": "�", "&#0;&#xFFFFFFFF;": "��",
        "&copy;&egrave;&euro;&NotEqualTilde;&copy b": "©è€≂̸© b", "&#150;&#x80;": "–€",
        "&#233;&eacute;&amp;#39;": "éé&#39;", "&bogus;": "&bogus;", "plain": "plain",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.u for r in df.select("t", unescape(F.col("t")).alias("u")).collect()} == cases


def test_every_reference_is_found_in_the_same_time(spark):
    import time
    from html.entities import html5

    from noticiario.functions import markup

    names = [name for name in html5 if name.endswith(";")]

    def seconds(name):
        pages = spark.createDataFrame([(f"&{name}" * 200_000,)], "t string")
        begun = time.time()
        assert pages.select(F.contains(markup.unescape(F.col("t")), F.lit("&" + name))).first()[0] is False
        return time.time() - begun

    first, last = names[0], names[-1]
    seconds(first)
    assert min(seconds(last) for _ in range(2)) < 2.5 * min(seconds(first) for _ in range(2))


def links_of(spark, source, html):
    pages = spark.createDataFrame([(html,)], "html string")
    return [r.link for r in extract_links(pages, RULES[source], now="2026-01-01 00:00:00").orderBy("pos").collect()]


def test_classes_are_whole_and_quotes_of_both_kinds(spark):
    html = """<article class="c-article-list-x"><a class="page-link" href="/no">x</a></article>
      <ARTICLE CLASS='x c-article'><A class='page-link' HREF='/si'>x</A></ARTICLE>""".replace("CLASS", "class")
    assert links_of(spark, "eltiempo", html) == ["https://www.eltiempo.com/si"]


@pytest.mark.parametrize("part", ["<script ", "<!-- ", "<title", "< ", "<nav>"])
def test_unclosed_tags_take_no_time(spark, part):
    import time

    from noticiario.operators import extract

    html = F.col("html")
    pages = spark.createDataFrame([(part * (1_000_000 // len(part)),)], "html string")
    begun = time.time()
    for column in (extract.without_furniture(html), extract.page_title(html), extract.strip_markup(html)):
        pages.select(F.length(column)).collect()
    assert time.time() - begun < 10


@pytest.mark.parametrize("part", ["<div>", "</div>", "<div></div>", "<article>", "<time datetime='2024-01-01T'>", "&#x1;", "&"])
def test_open_elements_take_no_time(spark, part):
    import time

    from noticiario.functions import markup

    html = F.col("html")
    pages = spark.createDataFrame([(part * (500_000 // len(part)),)], "html string")
    begun = time.time()
    for column in (F.size(markup.elements(html, "div|article")), F.length(markup.unescape(html))):
        pages.select(column).collect()
    assert time.time() - begun < 10


def test_elements_end_at_their_own_closing_tag(spark):
    from noticiario.functions import markup

    pages = {
        "<div a>x<div b>y</div>z</div>t<div c>u": ["<div a>x<div b>y</div>z", "<div b>y", "<div c>u"],
        "</div><DIV>x</DIV></div></div><div>y</div>": ["<DIV>x", "<div>y"],
        "<divider>a</divider><div-x>b</div-x>": [], "": [], "plain": [], None: None,
        "<div>" * 600 + "x" + "</div>" * 600: None,
    }
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    for r in df.select("html", markup.elements(F.col("html"), "div").alias("found")).collect():
        if r.html and r.html.startswith("<div><div>"):
            assert [len(e) for e in r.found] == [5 * (600 - k) + 1 + 6 * (599 - k) for k in range(600)]
        else:
            assert r.found == pages[r.html]


@pytest.mark.parametrize("source, html, expected", [
    # what follows the column is not read
    ("corrillos", """<div class="col-lg-8 col-md-12"><div><article><h2 class="post-title"><a href="https://corrillos.com.co/a">x</a></h2></article></div></div>
      <div class="side"><article><h2 class="post-title"><a href="https://corrillos.com.co/b">x</a></h2></article></div>""", ["https://corrillos.com.co/a"]),
    # an item without a link does not take one that follows it
    ("bcnoticias", """<div class="td_module_wrap"><div>no link</div></div><footer><a rel="bookmark" href="https://www.bcnoticias.com.co/pie">x</a></footer>""", []),
    # nor one of its own behind the heading
    ("las2orillas", """<article class="mg-posts-sec-post"><h4 class="entry-title">no link</h4><a href="https://www.las2orillas.co/otro">x</a></article>""", []),
    # commented and scripted markup is no markup
    ("eltiempo", """<!-- <article class="c-article"><a class="page-link" href="/no">x</a></article> -->
      <script>"<article class='c-article'><a class='page-link' href='/tampoco'>"</script><article class="c-article"><a class="page-link" href="/si">x</a></article>""", ["https://www.eltiempo.com/si"]),
    # the innermost element around a date; its link may follow in an inner one
    ("elpilon", """<div><a href="/menu/seccion">m</a><div><time datetime="2024-01-15T10:30:00-05:00">x</time><div><a href="/judicial/nota-1">x</a></div></div></div>""",
     ["https://elpilon.com.co/judicial/nota-1"]),
    # modules in modules
    ("eldiario", """<div id="tdi_89"><div class="td_module_wrap"><div class="x"><p>a</p></div><a rel="bookmark" href="https://www.eldiario.com.co/a">x</a></div></div>
      <div class="td_module_wrap"><a rel="bookmark" href="https://www.eldiario.com.co/fuera">x</a></div>""", ["https://www.eldiario.com.co/a"]),
])
def test_items_and_parts_end_where_they_close(spark, source, html, expected):
    assert links_of(spark, source, html) == expected


def test_one_article_of_a_page(spark):
    pages = {
        "<article>Uno</article>..<article>Relacionado</article>": "Uno",
        "<article><p>Corto</p></article><article><p>La nota <b>de</b> verdad</p></article>": "La nota de verdad",
        "<article><p>Nota</p><article>dentro</article><p>fin</p></article>x": "Nota\ndentro\nfin",
        "<body>a<article></article>b</body>": "", "<article><p>sin cerrar": "sin cerrar",
    }
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    got = extract_articles(df.withColumn("page", F.col("html"))).collect()
    assert {r.page: r.texto for r in got} == pages
