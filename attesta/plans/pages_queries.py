"""Pages, fetch log, robots and frontier: registered queries and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import authority
from ..operators import page_text, work
from ..operators import pages as ops
from ..session import ship_package
from . import sql
from . import tables as t

QUERIES: dict = {}
CHECKS: dict = {}
AGENT = "attesta/1.0"


def query(name: str, check: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


# extraction ------------------------------------------------------------------------


def extracted(spark, sf_dir):
    ship_package(spark)
    return page_text.extract_pages(t.table(spark, sf_dir, "pages"))


def _tidy(x: str) -> str:
    """Markdown of the plain markup the given pages use."""
    for tag, text in (("h1", "# "), ("/h1", ""), ("p", ""), ("/p", ""), ("div class=\"ad\"", ""), ("/div", ""), ("article", ""), ("/article", "")):
        x = f"replace({x}, '<{tag}>', chr(10) || chr(10) || '{text}')"
    for markup, text in (("<br>", "\n"), ("<b>", ""), ("</b>", ""), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{markup}', '{text}')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_WORDS = rf"""
shaped AS (
  SELECT page_id, url, {_tidy("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS article,
         {_tidy("regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|</body>|</html>', '', 'g')")} AS body
  FROM pages
),
words AS (
  SELECT page_id, url, strategy, markdown, text, len(string_split(text, ' ')) AS word_count
  FROM (SELECT *, trim(regexp_replace(regexp_replace(markdown, '[#>*`\-\[\]()]', ' ', 'g'), '\s+', ' ', 'g')) AS text
        FROM (SELECT *, CASE WHEN length(article) > 200 THEN article ELSE body END AS markdown,
                     CASE WHEN length(article) > 200 THEN 'article' ELSE 'body' END AS strategy FROM shaped))
)"""


@query(
    "page_extract",
    sql.with_ctes(_WORDS)
    + r"""
SELECT w.page_id, trim(replace(regexp_extract(p.html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title,
       regexp_extract(p.html, '<html lang="([^"]*)"', 1) AS lang, w.strategy, w.word_count, w.markdown, w.text, 0::BIGINT AS links
FROM words w JOIN pages p USING (page_id)""",
)
def page_extract(spark, sf_dir):
    return extracted(spark, sf_dir).select(
        "page_id", "title", "lang", "strategy", "word_count", "markdown", "text", F.size("links").cast("long").alias("links")
    )


@query(
    "page_metadata",
    r"""
SELECT page_id, trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')) AS title,
       NULL::VARCHAR AS description, NULL::VARCHAR AS byline, NULL::VARCHAR AS published_at,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, NULL::VARCHAR AS canonical
FROM pages""",
)
def page_metadata(spark, sf_dir):
    ship_package(spark)
    return page_text.page_metadata(t.table(spark, sf_dir, "pages"))


@query(
    "page_quality",
    sql.with_ctes(_WORDS)
    + f"""
SELECT {sql.host('url')} AS host, strategy, count(*) AS pages, count(*) FILTER (WHERE word_count < 120) AS thin,
       round(avg(word_count), 4) AS mean_words
FROM words GROUP BY ALL""",
)
def page_quality(spark, sf_dir):
    return ops.page_quality(extracted(spark, sf_dir))


@query(
    "page_flags",
    sql.with_ctes(_WORDS)
    + """
SELECT page_id, word_count, CASE WHEN word_count < 120 THEN 'escalate' ELSE 'keep' END AS action,
       length(markdown) < 400 OR contains(markdown, 'Sign in to view') OR contains(markdown, 'Join LinkedIn') AS stub
FROM words""",
)
def page_flags(spark, sf_dir):
    return ops.flag_pages(extracted(spark, sf_dir)).select("page_id", "word_count", "action", "stub")


@query(
    "page_dedupe",
    sql.with_ctes(_WORDS)
    + f"""
SELECT kind, group_key, count(*) AS copies, min(page_id) AS canonical_id, arg_min(url, page_id) AS canonical_url
FROM (SELECT 'url' AS kind, {sql.url_normal('url')} AS group_key, page_id, url FROM words
      UNION ALL SELECT 'content', sha256(text), page_id, url FROM words) GROUP BY ALL""",
)
def page_dedupe(spark, sf_dir):
    return ops.page_groups(extracted(spark, sf_dir), "text")


@query(
    "page_changes",
    sql.with_ctes(_WORDS)
    + """,
caps AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS url, sha256(text) AS content_hash FROM words
),
lagged AS (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY page_id) AS previous_hash FROM caps)
SELECT url, page_id, content_hash, previous_hash, coalesce(content_hash <> previous_hash, false) AS changed FROM lagged""",
)
def page_changes(spark, sf_dir):
    """Pages of one site as successive captures of it."""
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    captures = extracted(spark, sf_dir).withColumn("url", site)
    return ops.page_changes(captures, "page_id", "text").select(
        "url", "page_id", "content_hash", "previous_hash", "changed"
    )


# links -------------------------------------------------------------------------------

_LINKS = r"""
hrefs AS (
  SELECT page_id, url AS page_url, unnest(l) AS href, generate_subscripts(l, 1) AS i
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
),
links AS (
  SELECT page_id, page_url, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, page_url, regexp_extract(page_url, '^(https?://[^/?#]*)', 1) || href AS url, min(i) AS i FROM hrefs GROUP BY ALL)
)"""


def links_of(spark, sf_dir):
    return ops.page_links(t.table(spark, sf_dir, "pages"), navigation=True)


@query("page_links", sql.with_ctes(_LINKS) + "SELECT page_id, page_url, pos, url FROM links")
def page_links(spark, sf_dir):
    return links_of(spark, sf_dir)


@query(
    "host_graph",
    sql.with_ctes(_LINKS)
    + f"SELECT {sql.host('page_url')} AS src_host, {sql.host('url')} AS dst_host, count(*) AS links FROM links GROUP BY ALL",
)
def host_graph(spark, sf_dir):
    return ops.host_graph(links_of(spark, sf_dir))


@query(
    "host_degrees",
    sql.with_ctes(_LINKS)
    + f"""
SELECT host, CAST(sum(oh) AS BIGINT) AS out_hosts, CAST(sum(ol) AS BIGINT) AS out_links, CAST(sum(ih) AS BIGINT) AS in_hosts, CAST(sum(il) AS BIGINT) AS in_links
FROM (SELECT s AS host, 1 AS oh, n AS ol, 0 AS ih, 0 AS il FROM g UNION ALL SELECT d, 0, 0, 1, n FROM g) GROUP BY host""".replace(
        "FROM g", f"FROM (SELECT {sql.host('page_url')} AS s, {sql.host('url')} AS d, count(*) AS n FROM links GROUP BY ALL)"
    ),
)
def host_degrees(spark, sf_dir):
    return ops.host_degrees(ops.host_graph(links_of(spark, sf_dir)))


# fetch log ------------------------------------------------------------------------------

_OUTCOME = """
classed AS (
  SELECT *, CASE WHEN error_class IN ('timeout', 'connect') THEN 'retryable' WHEN error_class IS NOT NULL THEN 'error'
                 WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'retryable' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS outcome,
         CASE WHEN error_class IS NOT NULL THEN error_class WHEN status >= 400 THEN 'HTTP ' || status END AS message,
         CASE WHEN content_type IN ('text/html', 'application/xhtml+xml') THEN 'html' WHEN content_type = 'text/plain' THEN 'raw' ELSE 'refused' END AS handling
  FROM attempts
)"""


@query("liveness", sql.with_ctes(t.FETCH_SQL) + "SELECT url, status FROM live")
def liveness(spark, sf_dir):
    return ops.liveness(t.fetch_log(spark, sf_dir))


@query(
    "fetch_outcomes",
    sql.with_ctes(t.FETCH_SQL, _OUTCOME) + "SELECT page_id, attempt, outcome, message, handling FROM classed",
)
def fetch_outcomes(spark, sf_dir):
    log = ops.gate_content_type(ops.classify_fetch(t.fetch_log(spark, sf_dir)))
    return log.select("page_id", "attempt", "outcome", "message", "handling")


@query(
    "retry_history",
    sql.with_ctes(t.FETCH_SQL, _OUTCOME)
    + """
SELECT url, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'retryable') AS retryable,
       last(status ORDER BY page_id, attempt) AS final_status, last(outcome ORDER BY page_id, attempt) AS final_outcome,
       last(message ORDER BY page_id, attempt) AS final_error
FROM classed GROUP BY url""",
)
def retry_history(spark, sf_dir):
    return ops.retry_history(t.fetch_log(spark, sf_dir))


@query(
    "deadline_cut",
    sql.with_ctes(t.FETCH_SQL)
    + """
SELECT page_id, attempt, finished_s <= 1000 AS completed, CASE WHEN finished_s <= 1000 THEN error_class ELSE 'cancelled: run deadline' END AS error
FROM attempts""",
)
def deadline_cut(spark, sf_dir):
    log = t.fetch_log(spark, sf_dir).withColumnRenamed("error_class", "error")
    return work.deadline_cut(log, "finished_s", F.lit(1000)).select("page_id", "attempt", "completed", "error")


# robots and frontier ----------------------------------------------------------------------


def robots_files(spark, sf_dir):
    """A robots file per host, of one of four makes."""
    make = F.length("host") % 4
    everyone = "User-agent: *\nDisallow: /en/  # English only by contract\nDisallow: /fr/1\nAllow: /\nCrawl-delay: 2\n"
    named = "User-agent: Attesta\nDisallow: /de/\nCrawl-delay: 0.5\n\nUser-agent: *\nDisallow: /\n"
    hosts = t.table(spark, sf_dir, "pages").select(authority(F.col("url")).alias("host")).distinct()
    return hosts.select(
        "host",
        F.when(make == 2, 403).when(make == 3, 404).otherwise(200).alias("status"),
        F.when(make == 0, everyone).when(make == 1, named).alias("body"),
    )


_ROBOTS = f"""
ruled AS (
  SELECT *, CASE make WHEN 0 THEN NOT (starts_with(path, '/en/') OR starts_with(path, '/fr/1'))
                      WHEN 1 THEN NOT starts_with(path, '/de/') WHEN 2 THEN false ELSE true END AS allowed,
         CASE make WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS crawl_delay
  FROM (SELECT *, {sql.host('url')} AS host, length({sql.host('url')}) % 4 AS make, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM @)
)"""


@query(
    "robots_allowed",
    sql.with_ctes(_ROBOTS.replace("@", "(SELECT page_id, url FROM pages)")) + "SELECT page_id, host, allowed, crawl_delay FROM ruled",
)
def robots_allowed(spark, sf_dir):
    urls = t.table(spark, sf_dir, "pages").select("page_id", "url")
    rules = ops.parse_robots(robots_files(spark, sf_dir))
    return ops.robots_allowed(urls, rules, AGENT).select("page_id", "host", "allowed", "crawl_delay")


_SCHEDULE = """
placed AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS position FROM @)
SELECT url, host, seq, position, (position - 1) * greatest(1.0::DOUBLE, coalesce(crawl_delay, 0)) AS start_s, (position - 1) % 4 AS lane FROM placed"""


@query(
    "frontier_schedule",
    sql.with_ctes(_ROBOTS.replace("@", "(SELECT page_id AS seq, url FROM pages)"), _SCHEDULE.replace("@", "ruled")),
)
def frontier_schedule(spark, sf_dir):
    urls = t.table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    rules = ops.parse_robots(robots_files(spark, sf_dir))
    out = ops.frontier_schedule(ops.robots_allowed(urls, rules, AGENT))
    return out.select("url", "host", "seq", "position", "start_s", "lane")


@query(
    "next_frontier",
    sql.with_ctes(
        _LINKS,
        "fresh AS (SELECT url, min(page_id * 100000 + pos) AS seq FROM links WHERE url NOT IN (SELECT url FROM pages) GROUP BY url)",
        _ROBOTS.replace("@", "fresh"),
        _SCHEDULE.replace("@", "(SELECT * FROM ruled WHERE allowed)"),
    ),
)
def next_frontier(spark, sf_dir):
    links = links_of(spark, sf_dir).withColumn("seq", F.col("page_id") * 100000 + F.col("pos"))
    rules = ops.parse_robots(robots_files(spark, sf_dir))
    out = ops.next_frontier(links, t.table(spark, sf_dir, "pages"), rules, AGENT)
    return out.select("url", "host", "seq", "position", "start_s", "lane")
