"""Main text and URL filters against plain versions, and the registered queries."""

import random

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from attesta.llm import htmltext, queries, urlfilter, whitening
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field():
    return htmltext.train()


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c&amp;d<p>e<br>f<div>g</div>h") == ["a b c&d", "e f", "g", "h"]
    assert texts("<script>if (a<b) '</p>'</script>x<!-- <p>no --><style>p{}</style>y") == ["x y"]
    assert texts('<a title="x > y" href=/z>t</a> 1 < 2 & 3') == ["t 1 < 2 & 3"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("&lt;p&gt; &#233;&nbsp;x </p><!-- open") == ["<p> é x"]
    assert texts("") == [] and texts("<p></p><") == ["<"] and texts("plain") == ["plain"]


def test_long_and_broken_pages_end():
    assert texts("<p " * 20_000 + "x>") is not None
    assert texts('<a href="' * 5_000) is not None
    assert len(texts("<div>" * 300 + "a" + "</div>x" * 300)) == 301


def test_other_layouts_are_told_apart(field):
    rng, right, total = random.Random(77), 0, 0
    for _ in range(60):
        page, labels = htmltext.labelled_page(rng)
        found = htmltext.blocks(page)
        pairs = [(labels.get(b.text), y) for b, y in zip(found, field.decode(htmltext.features(found)))]
        right += sum(a == b for a, b in pairs if a is not None)
        total += sum(a is not None for a, _ in pairs)
    assert right / total > 0.98


MENU = "<nav class=menu><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer><p>© 2024 The Paper. All rights reserved.</p></footer>"
#: Pages written by hand, and the text that a reader would call the article.
BY_HAND = [
    ("<nav>Menu</nav><article><p>Hello world, this is news.</p></article>", "Hello world, this is news."),
    ("<article>Just text in it</article>", "Just text in it"),
    (f"<body>{MENU}<article>Closed on Monday.</article>{FOOT}</body>", "Closed on Monday."),
    (f"<body>{MENU}<main><h1>Notice</h1>The library is closed.<br>It opens again in May.</main>{FOOT}</body>", "Notice\nThe library is closed. It opens again in May."),
    (f"<body>{MENU}<article><h2>Rain</h2><p>It rained.</p></article><aside class=sidebar><h3>Related</h3><ul><li><a href=/a>More rain</a></li></ul></aside>{FOOT}</body>", "Rain\nIt rained."),
    (f"<div class=header>The Daily</div>{MENU}<div class=content><p>Two trains met.</p><p>Nobody was hurt, the police said, and both went on after an hour.</p></div>{FOOT}", "Two trains met.\nNobody was hurt, the police said, and both went on after an hour."),
    (f"{MENU}<article><p>Short.</p><div class=share><a href=/f>Share</a></div></article><section class=comments><h3>Comments</h3><div class=comment><p>I do not agree, at all.</p></div></section>{FOOT}", "Short."),
    (f'<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>{MENU}<main><article>A line of verse,<br>another line.</article></main>{FOOT}', "A line of verse, another line."),
]


def test_pages_written_by_hand(field):
    assert [htmltext.main_text(page, field) for page, _ in BY_HAND] == [text for _, text in BY_HAND]


def test_decoding_is_the_best_of_all_labellings(field):
    import itertools
    import random as rnd

    rng = rnd.Random(5)
    for _ in range(30):
        rows = htmltext.features(htmltext.blocks(htmltext.labelled_page(rng)[0]))[:9]
        own = [sum((field.weights[field.names[n]] for n in row if n in field.names), 0 * field.weights[0]) for row in rows]

        def score(labels):
            return sum(o[y] for o, y in zip(own, labels)) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
        assert abs(score(field.decode(rows)) - score(best)) < 1e-9


def test_repeated_pages_give_repeated_texts(spark, field):
    rows = spark.createDataFrame([(1, "u", BY_HAND[0][0], "x", 5)] * 3 + [(None, None, "<article>" + "word " * 200_000 + "</article>", None, 6)], "page_id long, url string, html string, text string, n_chars int")
    found = htmltext.extract(rows, field).collect()
    assert [r.text for r in found if r.page_id] == [BY_HAND[0][1]] * 3 and [r.n_chars for r in found if not r.page_id] == [999_999]


def test_pages_of_the_table(spark, field):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for row in htmltext.extract(pages, field).join(pages.select("page_id", "html"), "page_id").collect():
        article = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
        assert row.text == "\n".join(texts(article)) and row.n_chars == len(row.text)


def test_pages_without_text(spark, field):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<nav><a href=/>Home</a></nav>", "x")], "page_id bigint, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in htmltext.extract(pages, field).collect()] == [("", 0)] * 3
    assert htmltext.extract(pages.limit(0), field).count() == 0


def slow_verdict(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, urlfilter.DEFAULT))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://example.com/", "http://www.example.com/en/x?y#z", "http://a.b.example.com/en/",
    "http://notexample.com/en/", "http://x.net/es", "http://x.net/es/1", "http://x.net?/es/", "http://x.net#/es/", "ftp://a.net/fr/://b.com/", "http://É.NET/fr/",
    "http://.../es/", "http://net/es/", "http://" + "a." * 3_000 + "net/es/" + "x/" * 3_000, "http://x.com/en/\nq", "http://pre.org/path", "http://pre.org/patch",
]


@pytest.mark.parametrize("rules", [urlfilter.RULES, (("pre.org", "/pat", "block"), ("org", "/path", "allow"), ("pre.org", "", "allow"), ("net", "/es/", "allow"), ("net", "/es/", "block")), ()])
def test_url_verdicts(spark, rules):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(3, URLS[3], ""), (None, URLS[5], "")], "page_id bigint, url string, copies string")
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    got = urlfilter.judge(pages, table).collect()
    assert len(got) == len(URLS) + 2
    own = {(h, p): max(v for a, b, v in rules if (a, b) == (h, p)) for h, p, _ in rules}
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == slow_verdict(r.url, [(h, p, v) for (h, p), v in own.items()])


def test_no_urls(spark):
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string"), rules).count() == 0


@pytest.mark.parametrize("name", sorted(queries.checks()))
def test_registered_with_sql(spark, name):
    assert differences(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.checks())))
def test_registered_returns_every_row(spark, name):
    table = {"op5_warc": "pages", "op6_htmltext": "pages", "op11_whitening": "embeddings"}.get(name, "documents")
    rows = entry.queries()[name](spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count() * (whitening.COMPONENTS if name == "op11_whitening" else 1)


def test_pipeline_keeps_columns_and_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    done = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    assert done == ids and 0 < len(ids) < docs.count()
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert not done & bad


def test_a_shared_hash_prefix_is_no_hit(spark, monkeypatch):
    rules = spark.createDataFrame([("com", "/", "block"), ("a.com", "/", "allow"), ("net", "/x/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(
        [(i, u, "clash") for i, u in enumerate(("http://a.com/", "http://b.com/x", "http://a.net/y/", "http://a.net/x/", "http://org/", None))], "page_id long, url string, host string"
    )
    want = [("a.com/", "allow"), ("com/", "block"), (None, "allow"), ("net/x/", "block"), (None, "allow"), (None, "allow")]
    plain = urlfilter._digest
    for digest in (plain, lambda host, path: F.concat(F.lit("0" * 8), plain(host, path))):
        monkeypatch.setattr(urlfilter, "_digest", digest)
        got = urlfilter.judge(pages, rules).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == want
