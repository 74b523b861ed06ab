"""Chat and page operators, the registered queries against SQL, and the pipeline."""

import hashlib
import html
import json
import re

import corpus_pipeline
import pytest
from checks.compare import compare, connect

from noticiario.llm import chat, exact_dedup, html_text, queries
from noticiario.llm.common import table


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_small, name):
    state, n = compare(
        spark, sf_small, queries.QUERIES[name], queries.ORACLE.get(name), connect(sf_small)
    )
    assert state in ("ok", "rows only") and n > 0


def test_pipeline(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    before = len(ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toArrow())
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    packed = corpus_pipeline.run(spark, sf_small)
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert len(left) < before


CONTROL = r"<|im_end|>\n<\|x <\\| %0A <|im_start|>"


def test_escape_is_reversible(spark):
    texts = [CONTROL, "<", "<\\", "<|", "|>", "a<\\\\|b", "", "%25"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).collect()
    assert all(r.u == r.t and "<|" not in r.e for r in rows)


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", CONTROL), (1, 1, "assistant", CONTROL + "\n"), (1, 2, "assistant", None),
        (1, None, None, "x"), (None, 0, "a\nb", "null conversation"), (2, 0, "<|im_end|>", ""),
        (2, 1, "user", "é🙂"), (2, 1, "user", "é🙂"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 4, None: 1, 2: 3}
    said = "".join(f"{a}\n{b}\n" for a, b in [
        ("user", CONTROL), ("assistant", CONTROL + "\n"), ("assistant", ""), ("", "x")])
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == len(CONTROL) + 1
    assert got[1].loss_sha256 == hashlib.sha256((CONTROL + "\n").encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"a\nb\nnull conversation\n").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256("<|im_end|>\n\nuser\né🙂\nuser\né🙂\n".encode()).hexdigest()
    assert chat.digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


LAYOUTS = [
    {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
    {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "extra": 1},
    {"instruction": "hi", "output": "yo"},
    {"instruction": "hi", "input": "", "output": "yo"},
    {"prompt": "hi", "completion": "yo"},
    {"question": "hi", "answer": "yo", "meta": {"role": [1]}},
]


def test_layouts_become_the_same_turns(spark):
    records = [(k, json.dumps(x)) for k, x in enumerate(LAYOUTS)]
    records += [(50, None), (51, "not json"), (52, json.dumps({"odd": 1}))]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = chat.turns_from_json(df, "record").orderBy("conv_id", "turn").collect()
    for k in range(len(LAYOUTS)):
        assert [(r.role, r.text) for r in got if r.conv_id == k] == [("user", "hi"), ("assistant", "yo")]
    assert [r.turn for r in got if r.conv_id >= 50] == [None] * 3
    for k, x in enumerate(LAYOUTS):
        columns = spark.read.json(spark.sparkContext.parallelize([json.dumps(x | {"conv_id": k})]))
        rows = chat.canonical_turns(columns).orderBy("turn").collect()
        assert [(r.conv_id, r.role, r.text) for r in rows] == [(k, "user", "hi"), (k, "assistant", "yo")]
    with pytest.raises(ValueError, match="odd"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, odd string"))


def test_fingerprints_tell_layouts_apart():
    assert len(chat.REGISTRY) == len(chat.MAPPINGS)
    assert chat.fingerprint({"a[].b", "c"}) == chat.fingerprint(["c", "a[].b", "c"])
    assert chat.fingerprint({"a.b"}) != chat.fingerprint({"a[].b"})


ARTICLE = (
    "<html><head><title>t</title><style>p{}</style></head><body class='has-sidebar'><nav>Menu</nav>"
    "<header><h1>Site</h1></header><aside>Side</aside><div class=\"cookie-notice\">Cookies</div>"
    "<article><header><h1>Title &amp; more</h1><p>By someone</p></header><p><b>One\n two<br>three"
    "<p>Four&nbsp;five &#x1F600; &lt;p&gt;</p><script>var a='</p><p>no';</script><ul><li>a<li>b</ul>"
    "<div class='share'>Share</div><form>Mail<input></form><!-- <p>no</p> -->"
    "<section id='comments'><article>Reader</article></section></article>"
    "<article>Short teaser</article><footer>&copy; x</footer></body></html>"
)


def test_page_parts():
    page = html_text.Page(ARTICLE)
    assert [b[0] for b in page.main()] == [
        "Title & more", "One two three", "Four five 😀 <p>", "a", "b",
    ]
    for odd in ("", "<", "<p", "a<b>c</b", "</p></p>", "<p title=\"x>y", "<!-- x", "<script>x", "&#xD800;&#x110000;&bogus;"):
        html_text.Page(odd)
    assert [b[0] for b in html_text.Page("a<p>b</div>c").main()] == ["a", "b", "c"]


@pytest.mark.parametrize("around", [
    "<article class='post has-sidebar'>{}</article>", "<article class='comments-open'>{}</article>",
    "<div class='content-with-sidebar'>{}</div>", "<div class='sidebar'><article>{}</article></div>",
    "<article class='social'>{}</article>", "<div class='widget'>{}</div>",
])
def test_hinted_elements_keep_articles(around):
    inner = (
        "<p>First paragraph of the article.</p><section id='related-work'><p>Related work is real.</p>"
        "</section><p class='social'>A social topic, in a paragraph that is long enough.</p>"
        "<div class='social'><a>Follow us on all of these many different networks</a></div>"
    )
    assert [b[0] for b in html_text.Page(f"<body>{around.format(inner)}</body>").main()] == [
        "First paragraph of the article.", "Related work is real.",
        "A social topic, in a paragraph that is long enough.",
    ]


def test_templates_of_a_host_go(spark):
    box = "<div><p>Welcome to our site, read on</p></div>"
    pages = [(k, f"https://x.org/{k}", f"<body>{box}<p>Own text {k}</p>") for k in range(8)]
    pages += [(20, "https://y.org/1", f"<body>{box}<p>Own</p>"), (21, None, None), (22, "odd", ""),
              (22, "odd", ""), (23, "https://x.org/a", ARTICLE)]
    copies = [(30 + k, f"https://z.org/{k}", "<article><p>Same article</p></article>") for k in range(9)]
    df = spark.createDataFrame(pages + copies, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(df.withColumn("host", df.url)).collect()}
    assert [got[k].text for k in range(8)] == [f"Own text {k}" for k in range(8)]
    assert got[20].text == "Welcome to our site, read on\nOwn"
    assert (got[21].text, got[21].n_chars, got[22].text) == ("", 0, "")
    assert all(got[30 + k].text == "Same article" for k in range(9))
    assert got[23].n_chars == len(got[23].text)
    assert html_text.extract(df.limit(0)).count() == 0


TEXT = " and what the article says at some length"


def test_copies_stay_and_notices_go(spark):
    shapes = {
        "wrapped": "<body><div id=page><article><p>One</p><p>Two</p></article></div></body>",
        "main": "<body><div><div role=main><p>One</p><p>Two</p></div></div></body>",
        "body": "<body><div><p>One</p></div><p>Two</p></body>",
    }
    pages = [(n, f"https://{h}.org/?utm_source={k}", page) for n, (h, page) in enumerate(shapes.items())
             for k in range(9)]
    # the host's size does not raise the count: a boxed notice on 9 of 1000 pages
    notice = "<div><p>This text was shortened for the archive.</p></div>"
    pages += [(100 + k, f"https://big.org/{k}", f"<div><article><p>Own {k}{TEXT}</p>{notice if k < 9 else ''}"
               "</article></div>") for k in range(1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert {r.text for r in got if r.page_id < 100} == {"One\nTwo"}
    assert all(r.text == f"Own {r.page_id - 100}{TEXT}" for r in got if r.page_id >= 100)


def test_article_text_stays_and_boxes_go(spark):
    """What real articles share stays; a box goes from articles, a plain menu from bodies."""
    said = "<h2>Background</h2><p>A sentence that many articles share.</p><ul><li>One item</li></ul>"
    box = "<figure><p>Support our newsroom</p></figure><p class=newsletter>Mail</p>"
    body = "<div><p>The same report, with another title.</p><p>It is long.</p></div>"
    menu = "<div><div>Home</div><div>Politics</div></div>"
    pages = [(k, f"https://a.org/{k}", f"<article><h1>T{k}</h1><p>Own {k} {'x ' * k}</p>{said}{box}</article>")
             for k in range(12)]
    pages += [(20 + k, f"https://b.org/{k}", f"<article><h1>T{k}</h1>{body}</article>") for k in range(12)]
    pages += [(40 + k, f"https://c.org/{k}", f"<body>{menu}<p>Own {k}</p></body>") for k in range(12)]
    # near copies: one word of a paragraph differs
    pages += [(60 + k, f"https://d.org/{k}", f"<article><h1>T</h1><p>First.</p><p>Word {k}.</p><p>Last.</p></article>")
              for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    wanted = {}
    for k in range(12):
        wanted[k] = "\n".join([f"T{k}", f"Own {k} {'x ' * k}".strip(), "Background",
                               "A sentence that many articles share."])
        wanted[20 + k] = f"T{k}\nThe same report, with another title.\nIt is long."
        wanted[40 + k] = f"Own {k}"
        wanted[60 + k] = f"T\nFirst.\nWord {k}.\nLast."
    for limit in (html_text.BROADCAST_HASHES, 0):
        html_text.BROADCAST_HASHES, kept = limit, html_text.BROADCAST_HASHES
        try:
            assert {r.page_id: r.text for r in html_text.extract(df).collect()} == wanted
        finally:
            html_text.BROADCAST_HASHES = kept


def test_whole_articles_of_the_given_pages(spark, sf_small):
    """The given pages hold their text in h1, p and br of one article."""
    pages = table(spark, sf_small, "pages")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", inner))
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_parsing_is_linear():
    for piece in ("<script ", "<p title=\"", "<!--", "<div>", "</div>", "<p>", "&#x1;", "<a b='"):
        html_text.Page(piece * 20_000)


def test_exact_dedup_is_native(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    for df in (exact_dedup.membership(docs), exact_dedup.dedup(docs)):
        plan = df._jdf.queryExecution().toString()
        for operator in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert operator not in plan
