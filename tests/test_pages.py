import json

from attesta.operators import page_text
from attesta.operators import pages as ops
from pyspark.sql import functions as F


def read(spark, html, url="https://example.com/page", **options):
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return page_text.extract_pages(df, **options).head()


def test_markdown_of_the_common_elements(spark):
    page = """<body><article><h3>Tide  tables</h3><p>High water at <i>six</i>, low at noon.</p><ol><li>spring</li><li>neap</li></ol>
    <blockquote>Mind the bar.</blockquote><pre>06:00  4.1 m</pre><hr><img src=t.png alt="gauge"><a href="../charts?y=9">chart <b>nine</b></a></article></body>"""
    lines = read(spark, page, "https://harbour.test/notes/today").markdown.splitlines()
    assert [x for x in lines if x.strip()] == [
        "### Tide tables", "High water at six, low at noon.", "- spring", "- neap", "> Mind the bar.", "```", "06:00 4.1 m", "```", "---",
        "![gauge]()[chartnine](https://harbour.test/charts?y=9)",
    ]


def test_frame_of_the_page_is_left_out(spark):
    frame = "<header>Masthead</header><aside>Weather</aside><form>Sign up</form><div id='newsletter-box'>Weekly</div><svg><text>icon</text></svg>"
    page = f"<body>{frame}<div><p>Ferry times changed on Monday.</p></div><noscript>turn scripts on</noscript></body>"
    assert read(spark, page).markdown == "Ferry times changed on Monday."


def test_structured_data_gives_the_body(spark):
    told = "The lighthouse was lit again. " * 12
    graph = {"@context": "x", "@graph": [{"@type": "WebSite"}, {"@type": "Report", "articleBody": told}]}
    page = f"<script type='application/ld+json'>{json.dumps(graph)}</script><script type='application/ld+json'>not json</script><article>Teaser</article>"
    doc = read(spark, page)
    assert (doc.strategy, doc.markdown, len(doc.jsonld)) == ("jsonld", told.strip(), 3)
    brief = {"@type": "Report", "articleBody": "Lit again."}
    assert read(spark, f"<script type='application/ld+json'>{json.dumps(brief)}</script><p>Teaser</p>").strategy == "body"


def test_head_columns(spark):
    head = """<html lang=nb><head><title> Fallback </title><meta name="twitter:title" content="Kystvakt"><meta property="og:description" content="">
    <meta name=description content="Vind og sj&oslash;"><meta name="author" content="A. Holm"><link rel="canonical" href="/kyst"></head>"""
    doc = read(spark, head + '<body><time datetime="2021-07-03">3 July</time><a href="//cdn.test/a">a</a><a href="tel:1">b</a><a href="#c">c</a></body>', "http://kyst.test/x")
    assert (doc.title, doc.description, doc.byline, doc.lang) == ("Kystvakt", "Vind og sj\u00f8", "A. Holm", "nb")
    assert (doc.canonical, doc.published_at, doc.links) == ("/kyst", "3 July", ["http://cdn.test/a"])
    assert read(spark, "<title>Only this</title>").title == "Only this"


def test_nothing_is_cut_unless_asked(spark):
    page = "<main>" + "<p>gull tern</p>" * 9_000 + "</main>"
    assert read(spark, page).word_count == 18_000
    assert read(spark, page, max_chars=500).markdown.endswith("truncated]")


def test_markup_that_is_none(spark):
    assert [read(spark, x).text for x in ("", "<", "<b", "no tags", "</div></p>x", "<table><td>1<td>2")] == ["", "<", "<b", "no tags", "x", "12"]


def test_pages_of_any_shape(spark):
    deep = "<div>" * 4_000 + "<p>below</p>" + "</div>" * 4_000
    shapes = {
        "<div><nav><div>x</div></nav>kept<footer>y<footer>z</footer></footer></div>": "kept",
        "<a href='/x'><img alt=' map '><br></a><a href='#top'>up</a>": "![map]()\nup",
        "<ul><li>one<ul><li> two </li></ul><li><span id=menu-toggle>three</span></ul>": "- onetwo\n- three",
        "<pre> a <b>b</b> <i>c</i>\n\td</pre>": "```\na b c\nd\n```",
        "<blockquote>first\n\nsecond</blockquote><blockquote></blockquote>": "> first\n> second",
        "a" + " " * 200_000 + "b\u00a0\x01\x02\x03": "a b",
        "<p>\u00a0</p><!-- gone --><p title='>'>5 &lt; 6 &amp;amp;</p>": "5 < 6 &amp;",
        deep: "below",
    }
    rows = [(i, None if i % 2 else "http://e.test/", html, "extra") for i, html in enumerate(shapes)] + [(99, "u", None, "extra")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_text.extract_pages(df)
    assert {r.page_id: r.markdown for r in got.collect()} == dict(enumerate(shapes.values())) | {99: ""}
    assert got.count() == len(rows) and page_text.page_metadata(df.limit(0)).count() == 0


def test_nothing_of_the_body_is_rendered_for_the_head(spark):
    df = spark.createDataFrame([(1, "u", "<title>t</title>")], "page_id long, url string, html string")
    plan = page_text.page_metadata(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "h[1-6]" not in plan and "blockquote" not in plan and "h[1-6]" in page_text.extract_pages(df)._jdf.queryExecution().optimizedPlan().toString()


def test_a_short_article_is_passed_over(spark):
    rest = "<section role=main>" + "<p>Sand moved along the spit all winter.</p>" * 9 + "</section>"
    assert read(spark, f"<article>In brief</article>{rest}").strategy == "role-main"
    assert read(spark, f"<article>In brief</article>{rest.replace(' role=main', '')}").strategy == "body"


def test_column_links_agree_with_the_tree(spark):
    html = """<body><nav><a href="/n">n</a></nav><a class="x" href='a/../b?q=1#f'>1</a><a href="//cdn.x/y">2</a><a href="?p=2">3</a><a href="/b?x=1&amp;y=2">4</a>
    <a href="javascript:x()">5</a><a href="tel:1">6</a><a href="/n2"></a><a href="/n2">7</a></body>"""
    url = "https://e.com/d/page.html?z=1"
    df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    tree = read(spark, html, url).links
    assert [r["url"] for r in ops.page_links(df).orderBy("pos").collect()] == tree
    assert ops.page_links(df, navigation=True).count() == len(tree) + 1


def test_links_without_quotes_in_comments_and_with_references(spark):
    page = """<p data-href='/no'><!-- <a href="/old">x</a> --><a href=/bare/x>1</a><a id=k href = '/q?a=1&#38;b=2'>2</a><A HREF="/c&#x26;d&amp;lt;">3</A>
    <a data-href="/no2">4</a><abbr href="/no3">5</abbr><a href="/last">6</a><!-- <a href="/never">"""
    df = spark.createDataFrame([(1, "http://e.test/", page)], "page_id long, url string, html string")
    got = [r["url"] for r in ops.page_links(df).orderBy("pos").collect()]
    assert got == [f"http://e.test/{x}" for x in ("bare/x", "q?a=1&b=2", "c&d&lt;", "last")]


def test_robots(spark):
    body = "# hello\nUser-agent: Other\nUser-agent: bot\nDisallow: /a/\nAllow: /a/b\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 3\n"
    files = spark.createDataFrame([("h", 200, body), ("e", 200, "User-agent: *\nDisallow:\n"), ("no", 401, None), ("gone", 500, None)], "host string, status int, body string")
    urls = spark.createDataFrame([(f"http://{h}{p}",) for h, p in (("h", "/a/b/c"), ("h", "/c"), ("e", ""), ("no", "/"), ("gone", "/x"), ("unseen", "/x"))], "url string")
    rules = ops.parse_robots(files)

    def ask(agent, **options):
        return {r["url"]: r["allowed"] for r in ops.robots_allowed(urls, rules, agent, **options).collect()}

    bot = ask("bot/1.0")
    assert bot == {"http://h/a/b/c": False, "http://h/c": True, "http://e": True, "http://no/": False, "http://gone/x": True, "http://unseen/x": True}
    assert ask("bot/1.0", longest=True)["http://h/a/b/c"]
    assert not ask("mozilla/5")["http://h/c"]


def test_gates(spark):
    log = spark.createDataFrame([("u", 200, None, "text/html; charset=x"), ("u", 503, None, "image/png"), ("u", None, "timeout", None), ("u", 404, None, "application/json")], "url string, status int, error_class string, content_type string")
    got = [(r["outcome"], r["handling"]) for r in ops.gate_content_type(ops.classify_fetch(log)).collect()]
    assert got == [("ok", "html"), ("retryable", "refused"), ("retryable", "raw"), ("error", "raw")]


def test_hot_host_schedule(spark):
    urls = spark.range(5000).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("h").alias("host"), (F.col("id") * 1000).alias("seq"), F.lit(None).cast("double").alias("crawl_delay"))
    got = ops.frontier_schedule(urls)
    assert got.agg(F.max("start_s"), F.count_distinct("position")).head() == (4999.0, 5000)
    assert got.filter(F.col("start_s") != F.col("seq") / 1000).count() == 0


def test_few_pages_are_in_python_at_once(spark):
    from attesta.operators import page_text

    pages = spark.createDataFrame([(1, "https://a.example/", "<p>one</p>"), (2, None, None)], "page_id int, url string, html string")
    out = page_text.extract_pages(pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [(r.page_id, r.text) for r in out.select("page_id", "text").orderBy("page_id").collect()] == [(1, "one"), (2, "")]
