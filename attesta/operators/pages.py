"""Page and fetch-log jobs: liveness, gates, duplicates, link graph, robots and frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import content_hash
from ..functions.urls import authority, resolve, url_normal
from .ordered import previous_value, row_position

# fetch log ---------------------------------------------------------------------------


def _last_attempt(fetch_log: DataFrame, seq: str) -> DataFrame:
    last = F.max_by(F.struct("status", "error_class"), seq)
    return fetch_log.groupBy("url").agg(last.alias("_last"), F.count("*").alias("_attempts"))


def liveness_label(status: Column, error: Column) -> Column:
    return (
        F.when(error == "timeout", "dead_timeout")
        .when(error == "connect", "dead_connect")
        .when(error.isNotNull() | status.isNull(), "invalid")
        .when(status < 300, "ok")
        .when(status < 400, "redirect_ok")
        .otherwise(F.concat(F.lit("dead_"), status.cast("string")))
    )


def liveness(fetch_log: DataFrame, seq: str = "seq") -> DataFrame:
    """One label per URL, from its last attempt."""
    last = _last_attempt(fetch_log, seq)
    return last.select("url", liveness_label(F.col("_last.status"), F.col("_last.error_class")).alias("status"))


def classify_fetch(fetch_log: DataFrame) -> DataFrame:
    """Outcome of every attempt: ok, retryable, or a final error with its message."""
    status, error = F.col("status"), F.col("error_class")
    outcome = (
        F.when(error.isin("timeout", "connect"), "retryable")
        .when(error.isNotNull() | status.isNull(), "error")
        .when(status.isin(*fixed.RETRY_STATUS), "retryable")
        .when(status >= 400, "error")
        .otherwise("ok")
    )
    message = F.when(error.isNotNull(), error).when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string")))
    return fetch_log.withColumn("outcome", outcome).withColumn("message", message)


def gate_content_type(fetch_log: DataFrame) -> DataFrame:
    """html is extracted, other text is kept raw, the rest is refused; no type counts as text."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))

    def starts(options) -> Column:
        found = F.lit(False)
        for option in options:
            found = found | kind.startswith(option)
        return found

    handling = (
        F.when(starts(fixed.HTML_TYPES), "html").when((kind == "") | starts(fixed.TEXT_TYPES), "raw").otherwise("refused")
    )
    return fetch_log.withColumn("handling", handling)


def retry_history(fetch_log: DataFrame, seq: str = "seq") -> DataFrame:
    """Attempts per URL, how many asked for a retry, and how it ended."""
    tried = classify_fetch(fetch_log)
    last = F.max_by(F.struct("status", "outcome", "message"), seq)
    return (
        tried.groupBy("url")
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(F.col("outcome") == "retryable").alias("retryable"),
            last.alias("_last"),
        )
        .select("url", "attempts", "retryable", F.col("_last.status").alias("final_status"), F.col("_last.outcome").alias("final_outcome"), F.col("_last.message").alias("final_error"))
    )


# extracted pages -----------------------------------------------------------------------


def flag_pages(pages: DataFrame) -> DataFrame:
    """Thin pages go to the browser; sign-in stubs are misses, not pages."""
    stub = F.length(F.trim("markdown")) < fixed.STUB_CHARS
    for phrase in fixed.STUB_PHRASES:
        stub = stub | F.col("markdown").contains(phrase)
    return pages.withColumn(
        "action", F.when(F.col("word_count") < fixed.THIN_WORDS, "escalate").otherwise("keep")
    ).withColumn("stub", stub)


def page_quality(pages: DataFrame) -> DataFrame:
    """Per host: how pages were read, how many are thin, how long they are."""
    return (
        pages.withColumn("host", authority(F.col("url")))
        .groupBy("host", "strategy")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("word_count") < fixed.THIN_WORDS).alias("thin"),
            F.round(F.avg("word_count"), 4).alias("mean_words"),
        )
    )


def page_groups(pages: DataFrame, text: str, id_col: str = "page_id") -> DataFrame:
    """Groups of pages with one address or one content; the lowest id stands for the group."""
    forms = F.array(
        F.struct(F.lit("url").alias("kind"), url_normal(F.col("url")).alias("group_key")),
        F.struct(F.lit("content").alias("kind"), content_hash(F.col(text)).alias("group_key")),
    )
    keyed = pages.select(id_col, "url", F.explode(forms).alias("_f")).select(id_col, "url", "_f.*")
    return (
        keyed.filter(F.col("group_key").isNotNull())
        .groupBy("kind", "group_key")
        .agg(
            F.count("*").alias("copies"),
            F.min(id_col).alias("canonical_id"),
            F.min_by("url", id_col).alias("canonical_url"),
        )
    )


def page_changes(captures: DataFrame, seq: str, text: str) -> DataFrame:
    """Content hash of every capture, the one before it at the same URL, and whether it changed."""
    hashed = captures.withColumn("content_hash", content_hash(F.col(text)))
    out = previous_value(hashed, ["url"], [seq, "content_hash"], "content_hash", "previous_hash")
    changed = F.col("previous_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("previous_hash"))
    return out.withColumn("changed", changed)


# links ------------------------------------------------------------------------------------


def _without_tags(html: Column, tags) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


#: Character references for what addresses are made of; "&" is decoded last.
_REFERENCES = {"quot": '"', "apos": "'", "lt": "<", "gt": ">", "sol": "/", "colon": ":", "quest": "?", "num": "#", "equals": "=", "plus": "+", "amp": "&"}


def _decoded(value: Column) -> Column:
    plain = value
    for name, char in _REFERENCES.items():
        plain = F.regexp_replace(plain, rf"&(?:{name}|#0*{ord(char)}|#[xX]0*(?i:{ord(char):x}));", char)
    return F.when(value.contains("&"), plain).otherwise(value)


def page_links(pages: DataFrame, id_col: str = "page_id", navigation: bool = False) -> DataFrame:
    """Absolute http links of every page, each once, at its first position.

    Links in dropped parts (navigation, footer, forms …) are left out unless
    ``navigation`` is set; scripts, styles and comments never count. Values may stand in
    quotes or without, and character references in them are decoded.
    """
    tags = ("script", "style") if navigation else fixed.DROP_TAGS
    pattern = F.lit(r"""(?is)<a(?=\s)[^>]*?[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""")
    shown = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", " ")
    values = F.regexp_extract_all(_without_tags(shown, tags), pattern, F.lit(1))
    hrefs = F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")))
    wanted = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("^(?:javascript:|mailto:|tel:|#)"))
    absolute = F.transform(wanted, lambda h: resolve(F.col("url"), _decoded(h)))
    links = F.array_distinct(F.filter(absolute, lambda u: u.rlike("(?i)^https?:")))
    return pages.select(id_col, F.col("url").alias("page_url"), F.posexplode(links).alias("pos", "url"))


def host_graph(links: DataFrame) -> DataFrame:
    """Links between hosts with their number; a loop is a host linking to itself."""
    return (
        links.select(authority(F.col("page_url")).alias("src_host"), authority(F.col("url")).alias("dst_host"))
        .groupBy("src_host", "dst_host")
        .agg(F.count("*").alias("links"))
    )


def host_degrees(edges: DataFrame) -> DataFrame:
    """Hosts linked to and from, and the links on both sides."""
    ends = F.array(
        F.struct(F.col("src_host").alias("host"), F.lit(1).alias("out_hosts"), F.col("links").alias("out_links"), F.lit(0).alias("in_hosts"), F.lit(0).cast("long").alias("in_links")),
        F.struct(F.col("dst_host").alias("host"), F.lit(0).alias("out_hosts"), F.lit(0).cast("long").alias("out_links"), F.lit(1).alias("in_hosts"), F.col("links").alias("in_links")),
    )
    sums = [F.sum(c).alias(c) for c in ("out_hosts", "out_links", "in_hosts", "in_links")]
    return edges.select(F.explode(ends).alias("_e")).select("_e.*").groupBy("host").agg(*sums)


# robots ------------------------------------------------------------------------------------


def parse_robots(files: DataFrame) -> DataFrame:
    """``host, status, body`` to one row per host with its rule groups, in file order.

    One file is one row, so a host's rules never need to be gathered.
    """
    lines = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n"), "\n")
    stripped = F.transform(lines, lambda x: F.when(x == "", x).otherwise(F.trim(F.regexp_replace(x, "#.*$", ""))))
    kept = F.filter(
        F.zip_with(lines, stripped, lambda raw, s: F.struct(raw.alias("raw"), s.alias("s"))),
        lambda e: (e["raw"] == "") | e["s"].rlike(r"(?i)^(user-agent|allow|disallow|crawl-delay)\s*:"),
    )
    text = F.array_join(F.transform(kept, lambda e: e["s"]), "\n")
    marked = F.regexp_replace(text, r"(?im)^((?:allow|disallow|crawl-delay)[^\n]*)\n(?=user-agent)", "$1\n\n")

    def group(chunk: Column) -> Column:
        agents = F.regexp_extract_all(chunk, F.lit(r"(?im)^user-agent\s*:[ \t]*([^\n]*?)[ \t]*$"), F.lit(1))
        names = F.regexp_extract_all(chunk, F.lit(r"(?im)^(allow|disallow)\s*:[ \t]*([^\n]*?)[ \t]*$"), F.lit(1))
        paths = F.regexp_extract_all(chunk, F.lit(r"(?im)^(allow|disallow)\s*:[ \t]*([^\n]*?)[ \t]*$"), F.lit(2))
        rules = F.zip_with(
            names,
            paths,
            lambda n, p: F.struct(p.alias("path"), ((F.lower(n) == "allow") | (p == "")).alias("allow")),
        )
        delay = F.regexp_extract(chunk, r"(?im)^crawl-delay\s*:[ \t]*([0-9.]+)", 1).try_cast("double")
        return F.struct(F.transform(agents, F.lower).alias("agents"), rules.alias("rules"), delay.alias("crawl_delay"))

    groups = F.filter(
        F.transform(F.split(marked, "\n\n+"), group),
        lambda g: (F.size(g["agents"]) > 0) & ((F.size(g["rules"]) > 0) | g["crawl_delay"].isNotNull()),
    )
    return files.select("host", "status", F.when(F.col("status") == 200, groups).alias("groups"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str, longest: bool = False) -> DataFrame:
    """May ``agent`` fetch each URL, and how long must it wait between fetches.

    The first group naming the agent counts, else the first for everyone. In it the
    first matching rule decides or, with ``longest``, the longest. 401 and 403 forbid
    everything; any other failure to read the file forbids nothing.
    """
    token = F.lit(agent.split("/")[0].lower())
    target = F.regexp_replace(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^#]*)", 1), "^(?=\\?|$)", "/")
    named = F.filter("groups", lambda g: F.exists(g["agents"], lambda a: (a != "*") & F.contains(token, a)))
    anyone = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    ruling = F.coalesce(F.get(named, F.lit(0)), F.get(anyone, F.lit(0)))
    matching = F.filter(F.col("_group.rules"), lambda r: (r["path"] == "") | (r["path"] == "*") | F.startswith(F.col("_target"), r["path"]))
    if longest:
        ranked = F.transform(matching, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow")))
        decision = F.array_max(ranked)["allow"]
    else:
        decision = F.get(matching, F.lit(0))["allow"]
    return (
        urls.withColumn("host", authority(F.col("url")))
        .join(robots.withColumnRenamed("status", "_robots"), "host", "left")
        .withColumn("_group", ruling)
        .withColumn("_target", target)
        .withColumn("allowed", ~F.coalesce(F.col("_robots").isin(401, 403), F.lit(False)) & F.coalesce(decision, F.lit(True)))
        .withColumn("crawl_delay", F.col("_group.crawl_delay"))
        .drop("_robots", "groups", "_group", "_target")
    )


# frontier -----------------------------------------------------------------------------------


def frontier_schedule(urls: DataFrame, seq: str = "seq") -> DataFrame:
    """Earliest start of every URL, in order of arrival at its host, and its lane there."""
    placed = row_position(urls, ["host"], [seq, "url"], "position")
    delay = F.greatest(F.lit(fixed.HOST_DELAY_S), F.coalesce("crawl_delay", F.lit(0.0)))
    return placed.withColumn("start_s", (F.col("position") - 1) * delay).withColumn(
        "lane", (F.col("position") - 1) % fixed.HOST_LANES
    )


def next_frontier(links: DataFrame, fetched: DataFrame, robots: DataFrame, agent: str, seq: str = "seq") -> DataFrame:
    """New, allowed links with their place in the schedule; a link found often is fetched once."""
    new = links.groupBy("url").agg(F.min(seq).alias(seq)).join(fetched.select("url").distinct(), "url", "left_anti")
    allowed = robots_allowed(new, robots, agent).filter("allowed").drop("allowed")
    return frontier_schedule(allowed, seq)
