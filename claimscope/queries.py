"""Queries over the reference tables, each with an equivalent SQL text where SQL can express it.

Arrays are returned as joined strings or rows, so that results compare by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope.functions import html, text, urls
from claimscope.functions.providers import ExtractLinks, dictionary_segmenter, hashed_embedding
from claimscope.operators import classify, dom, domains, factcheck, feedback, keywords, models, paragraphs, redirects, segmentation, sentiment
from claimscope.operators.counters import Counters
from claimscope.plans import article, render
from claimscope.rules import ICON_URL, LATIN_STOP_WORDS, NO_VERDICT, REPORT_HEADINGS, SITE_RULES, STOP_WORDS, ban_lines, site_rules
from claimscope.session import shared_path, stored, table
from claimscope.sources import quarantine, readers
from claimscope.sources.replay import PageReplay
from claimscope.sources.seen import SeenLinks
from claimscope.streaming import posts
from claimscope.streaming.sink import FileSink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_HOST = f"nullif(lower(regexp_extract(url, '{urls.HOST}', 1)), '')"
_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(LATIN_STOP_WORDS))


def _decoded_sql(x: str) -> str:
    """The references that the test pages hold, the ampersand last."""
    for entity, character in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("#39", "''"), ("amp", "&")):
        x = f"replace({x}, '&{entity};', '{character}')"
    return x


def _stripped_sql(x: str) -> str:
    return f"trim({_decoded_sql(f"regexp_replace({x}, '<[^>]*>', '', 'g')")}, ' ')"


def _escaped_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


#: page_id, url, domain.
_DOMAINS = f"""
hosts AS (SELECT page_id, url, html, {_HOST} AS host FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS l FROM hosts),
domains AS (
  SELECT page_id, url, html, host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
    WHEN regexp_matches(array_to_string(l[-2:], '.'), '^(com|co|org|net|gov|edu|ac|idv)[.][a-z][a-z]$') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM labelled)"""
#: page_id, pos (from 1), text.
_PARAGRAPHS = f"""
marked AS (
  SELECT page_id, replace(replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'gs'), '<p>', chr(1)), '</article>', chr(1) || chr(2)) AS m
  FROM pages),
cut AS (SELECT page_id, list_filter(regexp_extract_all(m, chr(1) || '([^' || chr(1) || ']*)', 1), lambda x: NOT starts_with(x, chr(2))) AS parts FROM marked),
paras AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS raw FROM cut),
paragraphs AS (SELECT page_id, pos, {_stripped_sql("regexp_extract(raw, '^(.*?)(?:</p>|$)', 1, 's')")} AS text FROM paras)"""
#: Boilerplate by rule: lines of so many pages.
_BAN_PAGES, _BREAK_PAGES = 3, 6
_RECURRING = f"""
recurring AS (SELECT text, count(DISTINCT page_id) AS pages FROM paragraphs GROUP BY text),
ban AS (SELECT text FROM recurring WHERE pages >= {_BAN_PAGES}),
brk AS (SELECT text FROM recurring WHERE pages >= {_BREAK_PAGES})"""
#: doc_id, term, tf.
_COUNTS = f"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{text.TOKEN}')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term NOT IN ({_STOP}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
weights AS (SELECT doc_id, term, tf, df, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM counts JOIN df USING (term), n)"""
_TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS rank FROM weights)"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- URLs ---


@query(f"WITH {_DOMAINS} SELECT page_id, domain FROM domains")
def url_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.registered_domain(F.col("url")).alias("domain"))


#: Suffixes of the test hosts, a rule for any label below one, and an exception to it.
_SUFFIX_ROWS = ("com", "net", "org", "example.com", "*.example.net", "!www.example.net", "example.org")


@query(
    f"""WITH {_DOMAINS}, s AS (SELECT page_id, host, l, len(l) AS n, CASE
      WHEN host = 'www.example.net' OR ends_with(host, '.www.example.net') THEN 2
      WHEN ends_with(host, '.example.net') THEN 3
      WHEN host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org') THEN 2 ELSE 1 END AS k FROM (SELECT *, string_split(host, '.') AS l FROM (SELECT page_id, host FROM domains)))
    SELECT page_id, host, array_to_string(l[-k:], '.') AS suffix, array_to_string(l[-(k + 1):], '.') AS domain FROM s"""
)
def url_domain_by_table(spark: SparkSession, sf: str) -> DataFrame:
    suffixes = spark.createDataFrame([(x,) for x in _SUFFIX_ROWS], "suffix string")
    return domains.registered(table(spark, sf, "pages"), suffixes)


@query(
    r"""WITH q AS (SELECT page_id, string_split(replace(regexp_extract(url, '\?([^#]*)', 1), '+', ' '), '&') AS q FROM pages),
    p AS (SELECT page_id, unnest(list_filter(list_concat(q, q), lambda x: x <> '')) AS x FROM q)
    SELECT page_id, url_decode(CASE WHEN instr(x, '=') > 0 THEN left(x, instr(x, '=') - 1) ELSE x END) AS name, count(*) AS n_values FROM p GROUP BY ALL"""
)
def url_parameter_map(spark: SparkSession, sf: str) -> DataFrame:
    query_string = F.regexp_extract("url", r"\?([^#]*)", 1)
    twice = F.concat(F.lit("https://a.example/?"), query_string, F.lit("&"), query_string)  # every parameter is repeated
    found = table(spark, sf, "pages").select("page_id", F.explode(urls.parameter_map(twice)).alias("name", "values"))
    return found.select("page_id", "name", F.size("values").cast("long").alias("n_values"))


@query(f"WITH {_DOMAINS} SELECT host, count(*) AS n FROM domains GROUP BY host")
def url_host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH q AS (SELECT page_id, replace(regexp_extract(url, '\?([^#]*)', 1), '+', ' ') AS q FROM pages),
    p AS (SELECT page_id, unnest(list_filter(string_split(q, '&'), lambda x: x <> '')) AS x, unnest(range(1, len(list_filter(string_split(q, '&'), lambda x: x <> '')) + 1)) AS pos FROM q)
    SELECT page_id, pos, url_decode(CASE WHEN instr(x, '=') > 0 THEN left(x, instr(x, '=') - 1) ELSE x END) AS name,
      CASE WHEN instr(x, '=') > 0 THEN url_decode(substr(x, instr(x, '=') + 1)) END AS value FROM p"""
)
def url_params(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", F.posexplode(urls.parameters(F.col("url"))).alias("pos", "p"))
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), "p.name", "p.value")


@query("SELECT page_id, url AS target FROM pages")
def url_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    prefix = "https://redirect.example/l?u="
    wrapped = F.concat(F.lit(prefix), F.url_encode("url"), F.lit("&fbclid="), F.md5("url"))
    return table(spark, sf, "pages").select("page_id", urls.unwrapped(wrapped, prefix).alias("target"))


@query(
    f"""WITH {_DOMAINS}, l AS (SELECT page_id, host, regexp_extract_all(html, '{html.HREF}', 1) AS links FROM domains),
    e AS (SELECT page_id, host, unnest(links) AS href, unnest(range(1, len(links) + 1)) AS pos FROM l)
    SELECT page_id, pos, 'https://' || host || '/' || substr(href, 2) AS link FROM e"""
)
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), F.posexplode(html.links(F.col("html"))).alias("pos", "href"))
    relative = F.concat(F.lit("./"), F.col("href").substr(F.lit(2), F.length("href")))
    return found.select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), urls.absolute(relative, F.concat(F.lit("https://"), F.col("host"), F.lit("/"))).alias("link"))


@query(
    f"""WITH {_DOMAINS}, l AS (SELECT page_id, domain, unnest(regexp_extract_all(html, '{html.HREF}', 1)) AS href, unnest(range(1, len(regexp_extract_all(html, '{html.HREF}', 1)) + 1)) AS pos FROM domains),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id, pos) AS rank FROM l)
    SELECT domain, page_id, pos, href FROM r WHERE rank <= 12"""
)
def page_first12_links(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select(urls.registered_domain(F.col("url")).alias("domain"), "page_id", F.posexplode(html.links(F.col("html"))).alias("at", "href"))
    rows = found.select("domain", "page_id", (F.col("at") + 1).cast("long").alias("pos"), "href")
    return paragraphs.first_n(rows, ["domain"], ["page_id", "pos"], 12)


@query("SELECT p.page_id, coalesce(t.url, p.url) AS final_url FROM pages p LEFT JOIN pages t ON p.page_id % 3 = 0 AND t.page_id = p.page_id + 1")
def url_redirects(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    redirects = pages.where("page_id % 3 = 1").select((F.col("page_id") - 1).alias("src_id"), F.col("url").alias("dst"))
    return pages.join(redirects, F.col("page_id") == F.col("src_id"), "left").select("page_id", F.coalesce("dst", "url").alias("final_url"))


#: Each page's address leads to the next one of its domain; the last of example.net leads back to the first.
_CHAINS = f"""{_DOMAINS},
    named AS (SELECT page_id, url, domain, lead(url) OVER (PARTITION BY domain ORDER BY page_id) AS next, first_value(url) OVER (PARTITION BY domain ORDER BY page_id) AS first FROM domains),
    edges AS (SELECT url AS src, min(coalesce(next, CASE WHEN domain = 'example.net' THEN first END)) AS dst FROM named WHERE url IS NOT NULL GROUP BY url),
    redirects AS (SELECT * FROM edges WHERE dst IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {_CHAINS}, n AS (SELECT count(*) AS n FROM redirects),
    way AS (SELECT src, dst AS stop, CAST(1 AS BIGINT) AS hops FROM redirects UNION ALL SELECT way.src, r.dst, way.hops + 1 FROM way JOIN redirects r ON r.src = way.stop, n WHERE way.hops <= n.n),
    ends AS (SELECT src, stop, hops FROM way WHERE stop NOT IN (SELECT src FROM redirects))
    SELECT p.page_id, CASE WHEN r.src IS NULL THEN p.url ELSE e.stop END AS final_url, e.hops, r.src IS NOT NULL AND e.src IS NULL AS loop
    FROM pages p LEFT JOIN redirects r ON r.src = p.url LEFT JOIN ends e ON e.src = p.url"""
)
def redirect_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of as many hops as a domain has pages, and a loop."""
    pages = table(spark, sf, "pages").select("page_id", "url", urls.registered_domain(F.col("url")).alias("domain"))
    order = Window.partitionBy("domain").orderBy("page_id")
    back = F.when(F.col("domain") == "example.net", F.first_value("url").over(order))
    links = pages.select(F.col("url").alias("src"), F.coalesce(F.lead("url").over(order), back).alias("dst"))
    ends = redirects.followed(links)
    joined = pages.join(ends, F.col("url") == F.col("src"), "left")
    return joined.select("page_id", F.when(F.col("src").isNull(), F.col("url")).otherwise(F.col("final")).alias("final_url"), "hops", F.coalesce("loop", F.lit(False)).alias("loop"))


@query(
    f"""WITH t AS (SELECT page_id, {_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")} AS title FROM pages)
    SELECT page_id, 'https://search.example/?q=' || title AS plain, CASE WHEN contains(title, 'the') THEN right(title, 5) ELSE left(title, 5) END AS narrowed,
      replace('a b ' || left(title, 3), ' ', '.') AS selector FROM t"""
)
def search_urls(spark: SparkSession, sf: str) -> DataFrame:
    titled = table(spark, sf, "pages").select("page_id", F.coalesce(html.title(F.col("html")), F.lit("")).alias("title"))
    return titled.select(
        "page_id",
        urls.search_url("https://search.example/?q=", F.col("title")).alias("plain"),
        urls.narrowed_query(F.col("title"), "the").alias("narrowed"),
        urls.class_selector(F.concat(F.lit("a b "), F.left("title", F.lit(3)))).alias("selector"),
    )


_ENCODED = "replace(replace(replace(url_encode({}), '%20', '+'), '%2A', '*'), '~', '%7E')"


@query(
    f"""WITH t AS (SELECT page_id, {_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")} AS title FROM pages)
    SELECT page_id, 'https://search.example/?q=' || {_ENCODED.format("title")} || '&hl=zh-TW&site=https%3A%2F%2Fclaims.example%2F' AS address FROM t"""
)
def search_urls_encoded(spark: SparkSession, sf: str) -> DataFrame:
    titled = table(spark, sf, "pages").select("page_id", F.coalesce(html.title(F.col("html")), F.lit("")).alias("title"))
    return titled.select("page_id", urls.encoded_search_url("https://search.example/?", q=F.col("title"), hl=F.lit("zh-TW"), site=F.lit("https://claims.example/")).alias("address"))


@query(f"SELECT page_id, '{ICON_URL}' || {_HOST} AS icon FROM pages")
def url_icon(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.icon(F.col("url")).alias("icon"))


# --- pages ---


@query(f"SELECT page_id, nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, '') AS title FROM pages")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"SELECT page_id, translate(nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, ''), chr(13) || chr(10) || chr(9) || ' ' || chr(12288) || chr(160), '') AS title FROM pages")
def listing_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as listings need them, without any blanks."""
    return table(spark, sf, "pages").select("page_id", html.cleaned(html.title(F.col("html"))).alias("title"))


@query(
    f"""SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN nullif({_stripped_sql(f"regexp_extract(html, '{html.HEADING.replace('(?s)', '')}', 1, 's')")}, '') END,
      nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, ''), 'NONE') AS title FROM pages"""
)
def page_fallback_title(spark: SparkSession, sf: str) -> DataFrame:
    page = F.col("html")
    first = F.when(F.col("page_id") % 2 == 0, html.heading(page))
    return table(spark, sf, "pages").select("page_id", F.coalesce(first, html.title(page), F.lit("NONE")).alias("title"))


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.paragraphs(F.col("html")).alias("paras"))


def _paragraph_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs as a stored table: pages are parsed once, whatever reads the rows afterwards."""
    return stored(_rows(_paragraphs(spark, sf)), "paragraphs")


def _rows(paras: DataFrame) -> DataFrame:
    return paras.select("page_id", F.posexplode("paras").alias("at", "text")).select("page_id", (F.col("at") + 1).cast("long").alias("pos"), "text")


def _recurring(rows: DataFrame, least: int) -> DataFrame:
    return paragraphs.recurring_lines(rows, least)


def _content(rows: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), "")).alias("content_md5"))


_CONTENT = "page_id, count(*) AS paragraphs, md5(string_agg(text, '' ORDER BY pos)) AS content_md5"


@query(f"WITH {_PARAGRAPHS} SELECT page_id, pos, text FROM paragraphs")
def page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_paragraphs(spark, sf))


@query(f"WITH {_PARAGRAPHS} SELECT {_CONTENT} FROM paragraphs GROUP BY page_id")
def page_content(spark: SparkSession, sf: str) -> DataFrame:
    paras = _paragraphs(spark, sf).where(F.size("paras") > 0)
    return paras.select("page_id", F.size("paras").cast("long").alias("paragraphs"), F.md5(F.array_join("paras", "")).alias("content_md5"))


@query(f"WITH {_PARAGRAPHS}, {_RECURRING} SELECT {_CONTENT} FROM paragraphs WHERE text NOT IN (SELECT text FROM ban) GROUP BY page_id")
def page_content_skip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _paragraph_rows(spark, sf)
    return _content(paragraphs.rows_without(rows, _recurring(rows, _BAN_PAGES)))


@query(
    f"""WITH {_PARAGRAPHS}, {_RECURRING}, hits AS (SELECT page_id, min(pos) AS hit FROM paragraphs WHERE text IN (SELECT text FROM ban) GROUP BY page_id)
    SELECT {_CONTENT} FROM paragraphs LEFT JOIN hits USING (page_id) WHERE hit IS NULL OR pos < hit GROUP BY page_id"""
)
def page_content_break(spark: SparkSession, sf: str) -> DataFrame:
    rows = _paragraph_rows(spark, sf)
    return _content(paragraphs.rows_before(rows, _recurring(rows, _BAN_PAGES)))


@query(
    f"""WITH {_PARAGRAPHS}, hits AS (SELECT page_id, min(pos) AS hit FROM paragraphs WHERE contains(text, 'License') OR contains(text, 'the er') GROUP BY page_id)
    SELECT {_CONTENT} FROM paragraphs LEFT JOIN hits USING (page_id) WHERE hit IS NULL OR pos < hit GROUP BY page_id"""
)
def page_content_break_substr(spark: SparkSession, sf: str) -> DataFrame:
    cut = paragraphs.before_first(F.col("paras"), lambda p: F.contains(p, F.lit("License")) | F.contains(p, F.lit("the er")))
    return _content(_rows(_paragraphs(spark, sf).select("page_id", cut.alias("paras"))))


@query(
    f"""WITH {_PARAGRAPHS}, {_RECURRING}, kept AS (SELECT * FROM paragraphs WHERE text NOT IN (SELECT text FROM ban WHERE length(text) % 2 = 0)),
    hits AS (SELECT page_id, min(pos) AS hit FROM kept WHERE text IN (SELECT text FROM brk) GROUP BY page_id)
    SELECT {_CONTENT} FROM kept LEFT JOIN hits USING (page_id) WHERE hit IS NULL OR pos < hit GROUP BY page_id"""
)
def page_content_skip_break(spark: SparkSession, sf: str) -> DataFrame:
    rows = _paragraph_rows(spark, sf)
    kept = paragraphs.rows_without(rows, _recurring(rows, _BAN_PAGES).where(F.length("text") % 2 == 0))
    return _content(paragraphs.rows_before(kept, _recurring(rows, _BREAK_PAGES)))


@query(
    f"""WITH {_DOMAINS}, rules AS (SELECT * FROM (VALUES ('example.com', 'h1'), ('example.net', 'title')) r(domain, sel))
    SELECT page_id, domain, CASE WHEN sel = 'h1' THEN nullif({_stripped_sql(f"regexp_extract(html, '{html.HEADING.replace('(?s)', '')}', 1, 's')")}, '')
      ELSE nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, '') END AS title FROM domains JOIN rules USING (domain)"""
)
def site_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("example.com", "h1"), ("example.net", "title")], "domain string, sel string")
    pages = table(spark, sf, "pages").withColumn("domain", urls.registered_domain(F.col("url")))
    title = F.when(F.col("sel") == "h1", html.heading(F.col("html"))).otherwise(html.title(F.col("html")))
    return pages.join(F.broadcast(rules), "domain").select("page_id", "domain", title.alias("title"))


# --- links and lists ---


@query("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def link_seen(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_semi").select("page_id", "url")


def _seen_links(spark: SparkSession, sf: str) -> SeenLinks:
    """A store of a third of the pages' links, added in two parts that overlap."""
    pages, path = table(spark, sf, "pages"), shared_path(spark, "seen")
    seen = SeenLinks(spark, f"seen_{path.rpartition('-')[2]}", path, buckets=16)
    for rest in (6, 3):
        seen.add(pages.where(F.col("page_id") % rest == 0))
    return seen


@query("SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def link_seen_store(spark: SparkSession, sf: str) -> DataFrame:
    return _seen_links(spark, sf).seen(table(spark, sf, "pages").select("page_id", "url"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def link_unseen_store(spark: SparkSession, sf: str) -> DataFrame:
    return _seen_links(spark, sf).unseen(table(spark, sf, "pages").select("page_id", "url"))


@query("SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def link_unseen(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id", "url")


@query(f"WITH {_DOMAINS} SELECT page_id, host FROM domains WHERE host NOT IN (SELECT host FROM domains WHERE contains(host, 'pills') OR contains(host, 'casino'))")
def blocklist(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    black = pages.where(F.contains("host", F.lit("pills")) | F.contains("host", F.lit("casino"))).select("host").distinct()
    return pages.where("host is not null").join(black, "host", "left_anti").select("page_id", "host")


@query(f"WITH {_DOMAINS} SELECT host, min(page_id) AS page_id, count(*) AS seen FROM domains GROUP BY host")
def link_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return pages.groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("seen"))


@query(
    f"""WITH {_DOMAINS}, l AS (SELECT page_id, host, list_filter(regexp_extract_all(html, '{html.HREF}', 1), lambda x: NOT starts_with(x, 'javascript:')) AS links FROM domains)
    SELECT page_id, len(links) AS links FROM l WHERE len(links) > 0 AND contains(host, 'example.com')"""
)
def link_posts(spark: SparkSession, sf: str) -> DataFrame:
    links = F.filter(html.links(F.col("html")), lambda x: ~x.startswith("javascript:"))
    posts = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), links.alias("links"))
    return posts.where((F.size("links") > 0) & F.contains("host", F.lit("example.com"))).select("page_id", F.size("links").cast("long").alias("links"))


@query("SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 10")
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id").limit(10)


@query("SELECT page_id, length(html) AS size FROM pages WHERE url = (SELECT max(url) FROM pages)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    wanted = pages.agg(F.max("url").alias("wanted"))  # one row
    return pages.join(F.broadcast(wanted), F.col("url") == F.col("wanted")).select("page_id", F.length("html").cast("long").alias("size"))


@query(
    """WITH r AS (SELECT page_id, page_id % 5 AS k, url, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status FROM pages)
    SELECT page_id, url FROM r WHERE status = 200"""
)
def status_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("status", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200))
    return pages.where("status = 200").select("page_id", "url")


@query("SELECT conv_id, turn, 'Result ' || turn AS title, 'https://a.example/' || conv_id || '/' || turn AS link FROM conversations")
def search_json(spark: SparkSession, sf: str) -> DataFrame:
    record = F.to_json(F.array(F.struct(F.concat(F.lit("Result "), F.col("turn")).alias("title"), F.concat(F.lit("https://a.example/"), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("link"))))
    found = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(readers.search_results(record)).alias("r"))
    return found.select("conv_id", "turn", "r.title", "r.link")


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 1 END AS pos, CASE turn % 5 WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no array' WHEN 3 THEN 'without link' END AS reason, md5(role) AS title_md5
    FROM conversations WHERE turn % 5 IN (1, 2, 3) UNION ALL SELECT conv_id, turn, 0, '', md5(role) FROM conversations WHERE turn % 5 IN (0, 3)"""
)
def search_json_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Search answers made of the turns' texts: whole, cut off, an object in place of an array, an element without link, none."""
    kind = F.col("turn") % 5
    whole = F.to_json(F.struct(F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("link")))
    lacking = F.to_json(F.struct(F.col("role").alias("title")))
    body = F.when(kind == 0, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 1, F.concat(F.lit("["), whole)).when(kind == 2, whole).when(kind == 3, F.concat(F.lit("["), whole, F.lit(","), lacking, F.lit("]")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", body.alias("body"))
    good, bad = quarantine.json_arrays(rows, "body", {"title": "string", "link": "string"})
    fine = good.select("conv_id", "turn", "pos", F.lit("").alias("reason"), F.md5("title").alias("title_md5"))
    return fine.unionByName(bad.select("conv_id", "turn", "pos", "reason", F.md5("role").alias("title_md5")))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'too few fields' WHEN doc_id % 7 = 1 THEN 'too many fields' WHEN doc_id % 7 = 2 THEN 'a value of another type' ELSE '' END AS reason, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL"""
)
def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as CSV lines of which some are ragged or hold a word in place of a number; all come back, with their reasons."""
    path, kind = shared_path(spark, "ragged"), F.col("doc_id") % 7
    key, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    cells = F.when(kind == 0, F.array(key, quoted)).when(kind == 1, F.array(key, quoted, size, size)).when(kind == 2, F.array(key, quoted, F.lit("many"))).otherwise(F.array(key, quoted, size))
    table(spark, sf, "documents").where("text is not null").select(F.array_join(cells, ",")).write.text(path)
    good, bad = quarantine.csv(spark, path, "doc_id long, text string, n_chars long", header=False)
    # a broken record starts with its number and holds the quoted text
    text_of = F.replace(F.regexp_extract(quarantine.RECORD, r'(?s)^\d+,"(.*)"[^"]*$', 1), F.lit('""'), F.lit('"'))
    broken = bad.select(F.regexp_extract(quarantine.RECORD, r"^(\d+),", 1).cast("long").alias("doc_id"), quarantine.REASON, F.md5(text_of).alias("text_md5"))
    return good.select("doc_id", F.lit("").alias("reason"), F.md5("text").alias("text_md5")).unionByName(broken)


# --- posts ---


@query("SELECT conv_id, turn, md5(role || chr(10) || text) AS post_md5, length(role || chr(10) || text) AS chars FROM conversations WHERE text IS NOT NULL")
def post_text(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array("role", "text", F.lit("Show More"))
    posts = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", text.post_text(parts).alias("post"))
    return posts.select("conv_id", "turn", F.md5("post").alias("post_md5"), F.length("post").cast("long").alias("chars"))


@query(
    f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{html.HREF}', 1)) AS href, unnest(range(1, len(regexp_extract_all(html, '{html.HREF}', 1)) + 1)) AS pos FROM pages)
    SELECT page_id, pos, CASE WHEN pos % 2 = 0 THEN '[連結]' ELSE 'link' END AS text, href FROM l"""
)
def inline_links(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.transform(html.links(F.col("html")), lambda x, k: F.struct(F.when(k % 2 == 0, "link").otherwise("").alias("text"), x.alias("href")))
    script = F.array(F.struct(F.lit("run").alias("text"), F.lit("javascript:void(0)").alias("href")))
    found = table(spark, sf, "pages").select("page_id", F.posexplode(text.inline_links(F.concat(raw, script))).alias("at", "x"))
    return found.select("page_id", (F.col("at") + 1).cast("long").alias("pos"), "x.text", "x.href")


@query(
    f"""SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN url END AS url, CASE WHEN page_id % 4 NOT IN (0, 1) THEN {_HOST} END AS source,
      page_id % 4 <> 0 AS has_preview FROM pages"""
)
def link_preview(spark: SparkSession, sf: str) -> DataFrame:
    url, source = F.when(F.col("page_id") % 4 != 0, F.col("url")), F.when(~(F.col("page_id") % 4).isin(0, 1), urls.host(F.col("url")))
    none = F.lit(None).cast("string")
    found = table(spark, sf, "pages").select("page_id", text.preview(url, none, none, source).alias("p"))
    return found.select("page_id", "p.url", "p.source", F.col("p").isNotNull().alias("has_preview"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, 'NONE') AS source FROM documents")
def null_default(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.lit("NONE")).alias("source"))


# --- terms ---


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.TOKEN}') AS w FROM documents)
    SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t"""
)
def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{text.TOKEN}'), lambda x: x NOT IN ({_STOP})) AS w FROM documents)
    SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, ' ')) AS words_md5 FROM t"""
)
def doc_tokens_nostop(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", text.without(text.tokens(F.col("text")), LATIN_STOP_WORDS).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("words_md5"))


#: Words of made-up Chinese titles: content words, and stop words of the keyword extraction.
_ZH_WORDS = ("颱風", "登陸", "股市", "上漲", "醫院", "學校", "分享", "新聞", "討論", "這個")
_ZH_STOPPED = "('分享', '新聞', '討論', '這個')"
_ZH_SQL = "[" + ", ".join(f"'{x}'" for x in _ZH_WORDS) + "]"


@query(
    f"""WITH w AS (SELECT page_id, list_transform(range(2, 9), lambda k: ({_ZH_SQL})[1 + CAST((page_id * k + k * k) % 10 AS INTEGER)]) AS w FROM pages)
    SELECT page_id, array_to_string(w, ' ') AS segmented, array_to_string(list_filter(w, lambda x: x NOT IN {_ZH_STOPPED}), ' ') AS keywords FROM w"""
)
def title_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without blanks through the dictionary segmenter, then without the stop words."""
    words = F.array(*map(F.lit, _ZH_WORDS))
    at = lambda k: ((F.col("page_id") * k + k * k) % len(_ZH_WORDS) + 1).cast("int")
    titled = table(spark, sf, "pages").select("page_id", F.concat(*[F.element_at(words, at(k)) for k in range(2, 9)]).alias("title"))
    dictionary = spark.createDataFrame([(x, 10 + k) for k, x in enumerate(_ZH_WORDS)], "term string, freq int")
    cut = dictionary_segmenter(dictionary)
    segmented = titled.select("page_id", text.segmented_or_raw(F.col("title"), F.lit("zh-TW"), cut).alias("segmented"))
    return segmented.select("page_id", "segmented", F.array_join(text.without(F.split("segmented", " "), STOP_WORDS), " ").alias("keywords"))


#: kind, state, value, n, logp of the hidden Markov model over the documents' words.
_TAGS = r"""words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda x: x <> '') AS w FROM documents),
    word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS w FROM words),
    ch AS (SELECT doc_id, k, unnest(range(1, length(w) + 1)) AS i, length(w) AS n, w FROM word),
    tags AS (SELECT doc_id, k, i, substr(w, i, 1) AS c, CASE WHEN n = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = n THEN 'E' ELSE 'M' END AS s, lead(CASE WHEN n = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = n THEN 'E' ELSE 'M' END) OVER (PARTITION BY doc_id ORDER BY k, i) AS next FROM ch),
    seen AS (SELECT 'start' AS kind, s AS state, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM tags WHERE k = 1 AND i = 1 GROUP BY s UNION ALL SELECT 'emission', s, c, count(*) FROM tags GROUP BY s, c
      UNION ALL SELECT 'transition', s, next, count(*) FROM tags WHERE next IS NOT NULL GROUP BY s, next),
    possible(kind, state, value) AS (VALUES ('start', 'B', NULL), ('start', 'S', NULL), ('emission', 'B', NULL), ('emission', 'M', NULL), ('emission', 'E', NULL), ('emission', 'S', NULL), ('transition', 'B', 'M'), ('transition', 'B', 'E'),
      ('transition', 'M', 'M'), ('transition', 'M', 'E'), ('transition', 'E', 'B'), ('transition', 'E', 'S'), ('transition', 'S', 'B'), ('transition', 'S', 'S')),
    cells AS (SELECT kind, state, value, sum(n) AS n FROM (SELECT * FROM seen UNION ALL SELECT *, 0 FROM possible) GROUP BY ALL),
    sums AS (SELECT kind, CASE WHEN kind = 'start' THEN '' ELSE state END AS state, sum(n) AS total FROM cells GROUP BY ALL), v AS (SELECT count(DISTINCT value) AS v FROM seen WHERE kind = 'emission'),
    model AS (SELECT kind, c.state, value, CAST(n AS BIGINT) AS n, ln((n + 1.0) / (total + CASE WHEN kind = 'emission' THEN v + 1 ELSE 2 END)) AS logp FROM cells c JOIN sums s USING (kind), v WHERE s.state = CASE WHEN kind = 'start' THEN '' ELSE c.state END)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return segmentation.fit(stored(segmentation.state_counts(docs, letters), "states"))


@query(f"WITH {_TAGS} SELECT kind, state, value, n, round(logp, 6) AS logp FROM model")
def segmentation_model(spark: SparkSession, sf: str) -> DataFrame:
    """Start, transition and emission probabilities of the states of characters in the documents' words."""
    return _states(spark, sf).select("kind", "state", "value", "n", F.round("logp", 6).alias("logp"))


@query()  # cuts of equal probability are common, and SQL leaves open which one holds; a test tries all state sequences
def title_unknown_words(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without their blanks, cut into words by the states alone: no word of theirs is in a dictionary."""
    run = F.regexp_replace(F.lower(F.coalesce(html.title(F.col("html")), F.lit(""))), r"[^\p{L}]+", "")
    nothing = spark.createDataFrame([], "term string, freq int")
    cut = dictionary_segmenter(nothing, stored(_states(spark, sf), "model"), runs=r"[^\W\d_]+")
    return table(spark, sf, "pages").select("page_id", cut(run).alias("words"))


@query("SELECT lang, doc_id, md5(CASE WHEN lang = 'de' THEN replace(text, ' ', '/') ELSE text END) AS branch_md5 FROM documents")
def doc_lang_branch(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("lang") == "de", "zh-TW").otherwise(F.col("lang"))  # the tables have no Chinese; German stands for it
    own = text.segmented_or_raw(F.col("text"), lang, lambda t: F.replace(t, F.lit(" "), F.lit("/")))
    return table(spark, sf, "documents").select("lang", "doc_id", F.md5(own).alias("branch_md5"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    """Term counts of all documents as a stored table: texts are cut into words once, whatever reads the counts afterwards."""
    return stored(keywords.term_counts(table(spark, sf, "documents"), "doc_id", text.tokens(F.col("text")), LATIN_STOP_WORDS), "counts")


def _weighted(spark: SparkSession, sf: str, counts: DataFrame) -> DataFrame:
    """Weights of counts; the documents are counted when the query is built."""
    return keywords.tf_idf(counts, table(spark, sf, "documents").count())


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weighted(spark, sf, _counts(spark, sf))


@query(f"WITH {_COUNTS} SELECT term, df FROM df")
def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.document_frequency(_counts(spark, sf))


@query(f"WITH {_COUNTS}, {_TOP} SELECT doc_id, rank, term, round(w, 6) AS weight FROM ranked WHERE rank <= 3")
def doc_tfidf_top3(spark: SparkSession, sf: str) -> DataFrame:
    top = keywords.top_terms(_weights(spark, sf), "doc_id", 3)
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), "term", F.round("w", 6).alias("weight"))


@query(f"WITH {_COUNTS}, {_TOP} SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 5 GROUP BY doc_id")
def doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.joined(keywords.top_terms(_weights(spark, sf), "doc_id", 5), "doc_id", ",")


@query(f"WITH {_COUNTS}, {_TOP} SELECT doc_id, max(CASE WHEN rank = 1 THEN term END) AS keyword1, max(CASE WHEN rank = 2 THEN term END) AS keyword2, max(CASE WHEN rank = 3 THEN term END) AS keyword3 FROM ranked WHERE rank <= 3 GROUP BY doc_id")
def keyword_slots(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.slots(keywords.top_terms(_weights(spark, sf), "doc_id", 3), "doc_id")


@query(f"WITH {_COUNTS}, {_TOP} SELECT doc_id, round(avg(w), 6) AS mean_weight FROM ranked WHERE rank <= 3 GROUP BY doc_id")
def doc_tfidf_mean(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.top_terms(_weights(spark, sf), "doc_id", 3).groupBy("doc_id").agg(F.round(F.avg("w"), 6).alias("mean_weight"))


@query(f"WITH {_COUNTS}, norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id) SELECT doc_id, term, tf, round(w / norm, 6) AS w FROM weights JOIN norms USING (doc_id)")
def tfidf_l2(spark: SparkSession, sf: str) -> DataFrame:
    weights = keywords.tf_idf(_counts(spark, sf), table(spark, sf, "documents").count(), "doc_id")
    return keywords.l2_normalised(weights, "doc_id").select("doc_id", "term", "tf", F.round("w", 6).alias("w"))


@query(
    f"""WITH {_COUNTS}, tfs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS r2, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 6) DESC, term) AS r1 FROM weights),
    a AS (SELECT doc_id, list(term) AS ka FROM tfs WHERE r1 <= 5 GROUP BY doc_id), b AS (SELECT doc_id, list(term) AS kb FROM tfs WHERE r2 <= 5 GROUP BY doc_id)
    SELECT doc_id, round(CAST(len(list_intersect(ka, kb)) AS DOUBLE) / len(list_distinct(list_concat(ka, kb))), 6) AS jaccard FROM a JOIN b USING (doc_id)"""
)
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    weights = stored(_weights(spark, sf), "weights")
    sets = lambda w: keywords.top_terms(w, "doc_id", 5).groupBy("doc_id").agg(F.collect_set("term").alias("keywords"))
    by_count = sets(weights.withColumn("w", F.col("tf").cast("double")))
    return keywords.agreement(sets(weights), by_count, "doc_id").select("doc_id", "jaccard")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id AS cand_id, round(list_cosine_similarity(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id) AS rank FROM s)
    SELECT query_id, cand_id, similarity, rank FROM r WHERE rank <= 5"""
)
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    found = keywords.nearest_of_all(queries, vectors.select(F.col("vec_id").alias("cand_id"), F.col("embedding").alias("cv")), 5)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH s AS (SELECT a.conv_id AS query_id, b.turn AS cand_id, round(list_cosine_similarity([length(a.text), a.turn, 1.0], [length(b.text), b.turn, 1.0]), 6) AS similarity
      FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn > 0 AND a.text IS NOT NULL AND b.text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, cand_id) AS rank FROM s)
    SELECT query_id, cand_id, similarity, rank FROM r WHERE rank <= 2"""
)
def nearest_in_group(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("text is not null")
    vector = F.array(F.length("text").cast("double"), F.col("turn").cast("double"), F.lit(1.0))
    queries = turns.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("grp"), vector.alias("qv"))
    candidates = turns.where("turn > 0").select(F.col("turn").alias("cand_id"), F.col("conv_id").alias("grp"), vector.alias("cv"))
    found = keywords.nearest(queries, candidates, 2)
    return found.withColumn("rank", F.col("rank").cast("long"))


# --- classification and sentiment ---


@query("WITH c AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code FROM c) SELECT doc_id, lang, code FROM documents JOIN n USING (lang)")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return classify.encoded(table(spark, sf, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL")
def label_decode(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    codes = classify.codes(docs, "lang")
    coded = docs.join(F.broadcast(codes), "lang").select("doc_id", "code")
    return classify.decoded(coded, codes, "lang").select("doc_id", "lang")


_MODEL = f"""{_COUNTS}, norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id),
    unit AS (SELECT doc_id, term, w / norm AS w FROM weights JOIN norms USING (doc_id)),
    lab AS (SELECT DISTINCT doc_id, quality AS label FROM labels),
    sums AS (SELECT label, term, sum(w) AS sw FROM unit JOIN lab USING (doc_id) GROUP BY ALL),
    classes AS (SELECT label, count(*) AS docs FROM lab WHERE doc_id IN (SELECT doc_id FROM unit) GROUP BY label),
    totals AS (SELECT label, sum(sw) AS total FROM sums GROUP BY label),
    v AS (SELECT count(DISTINCT term) AS v FROM sums), a AS (SELECT sum(docs) AS all_docs FROM classes),
    model AS (SELECT h.label, t.term, ln((coalesce(s.sw, 0) + 1) / (h.total + v.v)) AS loglik, ln(h.docs / a.all_docs) AS prior
      FROM (SELECT DISTINCT term FROM sums) t, (SELECT * FROM classes JOIN totals USING (label)) h, v, a LEFT JOIN sums s ON s.label = h.label AND s.term = t.term)"""


def _model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts, documents = _counts(spark, sf), table(spark, sf, "documents").count()
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).distinct()
    unit = stored(models.labelled_units(counts, keywords.document_frequency(counts), documents, labels, "doc_id"), "unit")
    return unit, classify.fit(unit, labels, "doc_id")


@query(f"WITH {_MODEL} SELECT label, term, round(loglik, 6) AS loglik, round(prior, 6) AS prior FROM model")
def nb_model(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf)[1].select("label", "term", F.round("loglik", 6).alias("loglik"), F.round("prior", 6).alias("prior"))


@query(
    f"""WITH {_MODEL}, scores AS (SELECT doc_id, label, round(sum(w * loglik) + max(prior), 6) AS score FROM unit JOIN model USING (term) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM scores)
    SELECT doc_id, label, score FROM best WHERE r = 1"""
)
def nb_predict(spark: SparkSession, sf: str) -> DataFrame:
    """By a stored model: the first call on these tables fits and saves it, later ones read its latest complete version."""
    docs, words, counts = table(spark, sf, "documents"), text.tokens(F.col("text")), _counts(spark, sf)
    place = (spark.sparkContext.applicationId, sf)
    if place not in _MODELS:
        folder = shared_path(spark, "titles")
        labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).distinct()
        models.train_titles(docs, labels, "doc_id", words, folder, LATIN_STOP_WORDS, counts)
        _MODELS[place] = folder
    return models.predict_titles(docs, "doc_id", words, models.load(spark, _MODELS[place]), LATIN_STOP_WORDS, counts).select("doc_id", "label", "score")


#: Folders of saved models by application and tables.
_MODELS: dict[tuple[str, str], str] = {}

_SENTIMENT = f"""{_COUNTS}, lab AS (SELECT DISTINCT doc_id, quality AS positive FROM labels),
    seen AS (SELECT term, sum(positive) AS pos, count(*) AS n FROM counts JOIN lab USING (doc_id) GROUP BY term),
    totals AS (SELECT sum(positive) AS all_pos, count(*) AS all_n FROM lab WHERE doc_id IN (SELECT doc_id FROM counts)),
    wordscores AS (SELECT term, 1 / (1 + exp(-ln(((pos + 1) / (all_pos + 2)) / ((seen.n - pos + 1) / (all_n - all_pos + 2))))) AS score FROM seen, totals),
    {_TOP}, mean AS (SELECT doc_id, round(avg(score), 6) AS mean FROM (SELECT * FROM ranked WHERE rank <= 5) LEFT JOIN wordscores USING (term) GROUP BY doc_id)"""


def _word_scores(spark: SparkSession, sf: str, counts: DataFrame) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("positive")).distinct()
    return sentiment.word_scores(counts, labels, "doc_id")


def _mean_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    top = keywords.top_terms(_weighted(spark, sf, counts), "doc_id", 5)
    return top.join(_word_scores(spark, sf, counts), "term", "left").groupBy("doc_id").agg(F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {_SENTIMENT} SELECT term, round(score, 6) AS score FROM wordscores")
def sentiment_score(spark: SparkSession, sf: str) -> DataFrame:
    return _word_scores(spark, sf, _counts(spark, sf)).select("term", F.round("score", 6).alias("score"))


@query(f"WITH {_SENTIMENT} SELECT doc_id, mean FROM mean")
def sentiment_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _mean_sentiment(spark, sf)


def _bucket_sql(labels: tuple[str, ...], top: float) -> str:
    a, b, c, d, e, f, g = labels
    return (
        f"CASE WHEN mean IS NULL THEN 'undefined' WHEN mean >= {top} THEN '{a}' WHEN mean >= 0.7 THEN '{b}' WHEN mean > 0.5 THEN '{c}' WHEN mean = 0.5 THEN '{d}' "
        f"WHEN mean >= 0.3 THEN '{e}' WHEN mean > 0.1 THEN '{f}' ELSE '{g}' END"
    )


@query(f"WITH {_SENTIMENT} SELECT doc_id, {_bucket_sql(sentiment.SENTIMENT_LABELS, 0.9)} AS label FROM mean")
def sentiment_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return _mean_sentiment(spark, sf).select("doc_id", sentiment.label(F.col("mean")).alias("label"))


@query(
    f"""WITH {_SENTIMENT} SELECT doc_id, {_bucket_sql(sentiment.SENTIMENT_LABELS_EN, 0.8)} AS label,
    CASE WHEN mean > 0.5 THEN 'quite positive' WHEN mean < 0.5 AND mean > 0.3 THEN 'quite negative' WHEN mean < 0.3 THEN 'strong negative' END AS label_three FROM mean"""
)
def sentiment_bucket_v4(spark: SparkSession, sf: str) -> DataFrame:
    return _mean_sentiment(spark, sf).select("doc_id", sentiment.label_older(F.col("mean")).alias("label"), sentiment.label_three(F.col("mean")).alias("label_three"))


_TITLE_TEXT = f"""t AS (SELECT page_id, coalesce(nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, ''), '') AS title FROM pages)"""


@query(
    f"""WITH {_SENTIMENT}, {_TITLE_TEXT}, odds AS (SELECT term, ln(score / (1 - score)) AS odds FROM wordscores), prior AS (SELECT ln((all_pos + 1.0) / (all_n - all_pos + 1)) AS prior FROM totals),
    w AS (SELECT page_id, unnest(regexp_extract_all(lower(title), '{text.TOKEN}')) AS term FROM t),
    joint AS (SELECT page_id, sum(coalesce(odds, 0)) AS joint FROM w LEFT JOIN odds USING (term) GROUP BY page_id)
    SELECT page_id, round(1 / (1 + exp(-(coalesce(joint, 0) + prior))), 6) AS score FROM t LEFT JOIN joint USING (page_id), prior"""
)
def sentiment_text(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as whole strings: the joint odds of all their words."""
    counts = _counts(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("positive")).distinct()
    provider = sentiment.SentimentProvider(stored(sentiment.log_odds(counts, labels, "doc_id"), "odds"), text.tokens)
    titled = table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))
    return provider.scores(titled, "page_id", "title").select("page_id", F.round("score", 6).alias("score"))


# --- fact checks ---

_CLAIMS = f"""{_COUNTS}, {_TOP}, art AS (SELECT DISTINCT doc_id, term FROM ranked WHERE rank <= 5),
    cl AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{text.TOKEN}')) AS term FROM benchmark)),
    shared AS (SELECT doc_id, item_id, count(*) AS overlap FROM art JOIN cl USING (term) GROUP BY ALL),
    hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, item_id) AS r FROM shared) WHERE r = 1)"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    articles = keywords.top_terms(_weights(spark, sf), "doc_id", 5).select("doc_id", "term")
    claims = table(spark, sf, "benchmark").select("item_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    return factcheck.best_hits(articles, claims, "doc_id", "item_id")


@query(f"WITH {_CLAIMS} SELECT doc_id, item_id, overlap FROM hit")
def factcheck_top1(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf)


_VERDICT_TITLE = "CASE item_id % 5 WHEN 0 THEN '【錯誤】' WHEN 1 THEN '【部份錯誤】' WHEN 2 THEN '【事實釐清】' ELSE '' END"


@query(
    f"""WITH {_CLAIMS}, named AS (SELECT doc_id, item_id, {_VERDICT_TITLE} AS title, CASE WHEN item_id % 7 = 0 THEN 'other.example' ELSE 'tfc-taiwan.example' END AS host FROM hit)
    SELECT d.doc_id, item_id, CASE WHEN contains(host, 'tfc-taiwan') THEN CASE WHEN contains(title, '部份錯誤') THEN '部份錯誤' WHEN contains(title, '錯誤') THEN '錯誤'
      WHEN contains(title, '事實釐清') THEN '事實釐清' ELSE '{NO_VERDICT}' END ELSE '{NO_VERDICT}' END AS verdict FROM documents d LEFT JOIN named USING (doc_id)"""
)
def factcheck_label(spark: SparkSession, sf: str) -> DataFrame:
    title = F.expr(_VERDICT_TITLE)
    host = F.when(F.col("item_id") % 7 == 0, "other.example").otherwise("tfc-taiwan.example")
    hits = _hits(spark, sf).select("doc_id", "item_id", factcheck.guarded(host, title).alias("verdict"))
    return table(spark, sf, "documents").select("doc_id").join(hits, "doc_id", "left").select("doc_id", "item_id", F.coalesce("verdict", F.lit(NO_VERDICT)).alias("verdict"))


# --- feedback ---

_KINDS = {"fake": "click", "biased": "error", "outdated": "view"}


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.report_counters(table(spark, sf, "events"), "user_id", "event_type", _KINDS)


_REPORTS = "reports AS (SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {c}" for c, k in _KINDS.items()) + " FROM events GROUP BY user_id)"


@query(f"WITH {_REPORTS} SELECT * FROM reports")
def report_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf)


@query(f"WITH {_REPORTS} SELECT * FROM reports")
def report_counters_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The counters from three increments, one of which is added twice."""
    counters = Counters(shared_path(spark, "counters"), ["user_id"], dict.fromkeys(_KINDS, "sum"))
    events = table(spark, sf, "events")
    for k in (0, 1, 1, 2):
        counters.add(f"day {k}", feedback.report_counters(events.where(F.col("event_id") % 3 == k), "user_id", "event_type", _KINDS))
    return counters.current(spark).select("user_id", *_KINDS)


@query(f"WITH {_REPORTS} SELECT user_id, CASE WHEN fake + biased + outdated >= {feedback.HIDE_FROM} THEN 2 ELSE 0 END AS state FROM reports")
def report_hide(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("user_id", feedback.visibility(F.col("fake") + F.col("biased") + F.col("outdated")).alias("state"))


_DIMENSIONS = {"page_reli": 1, "cf_poss": 2, "phi_poss": 3, "outdated": 4, "domain_reli": 5}


@query(
    "WITH r AS (SELECT user_id, "
    + ", ".join(f"CAST((event_id * {k}) % 6 AS INTEGER) AS {d}" for d, k in _DIMENSIONS.items())
    + " FROM events), m AS (SELECT user_id, count(*) AS ratings, "
    + ", ".join(f"avg({d}) AS {d}" for d in _DIMENSIONS)
    + " FROM r GROUP BY user_id) SELECT user_id, ratings, "
    + ", ".join(f"round({d}, 6) AS {d}" for d in _DIMENSIONS)
    + f", least(5, greatest(0, CAST(floor(round(({' + '.join(_DIMENSIONS)}) / 5, 6) + 0.5) AS INTEGER))) AS overall FROM m"
)
def rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    ratings = table(spark, sf, "events").select("user_id", *[(F.col("event_id") * k % 6).cast("int").alias(d) for d, k in _DIMENSIONS.items()])
    return feedback.rating_summary(ratings, "user_id", list(_DIMENSIONS))


@query("SELECT user_id, count(DISTINCT event_id) AS clicks, count(DISTINCT event_id) > 0 AS built, count(DISTINCT event_id) % 2 = 1 AS visible FROM events WHERE event_type = 'click' GROUP BY user_id")
def click_toggle(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.toggled(table(spark, sf, "events").where("event_type = 'click'"), "user_id")


@query(
    "WITH l AS (SELECT page_id AS reported_id, url AS reported_url FROM pages), r AS (SELECT user_id AS reported_id, avg((event_id * 1) % 6) AS reli, count(*) AS n FROM events GROUP BY user_id) "
    "SELECT reported_id, reported_url, coalesce(n, 0) AS ratings, round(reli, 6) AS page_reli FROM l LEFT JOIN r USING (reported_id)"
)
def reported_link_ratings(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select(F.col("page_id").alias("reported_id"), F.col("url").alias("reported_url"))
    ratings = table(spark, sf, "events").select(F.col("user_id").alias("reported_id"), (F.col("event_id") % 6).cast("int").alias("page_reli"))
    return feedback.rated_links(links, ratings, "reported_id", ["page_reli"]).select("reported_id", "reported_url", "ratings", "page_reli")


@query("SELECT user_id AS post_id, count(DISTINCT event_id) AS clicks, true AS built, count(DISTINCT event_id) % 2 = 1 AS visible FROM events WHERE event_type = 'click' GROUP BY user_id")
def click_toggle_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The toggles as a stream with state: events are observed twice, the last state of each post is shown."""
    events = posts.stateful_session(spark).readStream.schema("event_id long, user_id long, event_type string").parquet(f"{sf.rstrip('/')}/events.parquet*").where("event_type = 'click'")
    clicks = events.select(F.col("user_id").cast("string").alias("post_id"), "event_id")
    states = posts.latest_states(posts.toggles(clicks.unionByName(clicks)), ["post_id"], "clicks", shared_path(spark, "toggles"), shared_path(spark, "toggles-state"), reader=spark)
    return states.withColumn("post_id", F.col("post_id").cast("long"))


# --- reports ---

_HEAD = "<table><tr>" + "".join(f"<th>{h}</th>" for h in REPORT_HEADINGS) + "</tr>"


def _title_sql() -> str:
    return f"nullif({_stripped_sql(f"regexp_extract(html, '{html.TITLE.replace('(?s)', '')}', 1, 's')")}, '')"


@query(
    f"""WITH {_DOMAINS}, r AS (SELECT domain, page_id, '<tr><td><img src=''' || {_escaped_sql(f"'{ICON_URL}' || host")} || ''' /><a href=''' || {_escaped_sql("url")} || '''>' || coalesce({_escaped_sql(_title_sql())}, '') || '</a></td>'
      || '<td>' || page_id || '</td><td></td><td>undefined</td><td>{NO_VERDICT}</td></tr>' AS row FROM domains)
    SELECT domain, page_id // 100 AS part, md5('{_HEAD}' || string_agg(row, '' ORDER BY page_id) || '</table>') AS html_md5, count(*) AS n FROM r GROUP BY ALL"""
)
def report_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("domain", urls.registered_domain(F.col("url")))
    row = render.report_row(F.col("url"), html.title(F.col("html")), F.col("page_id"), F.lit(None).cast("string"), F.lit("undefined"), F.lit(NO_VERDICT))
    # parts of a hundred page ids: a table never grows with its domain
    rows = pages.select("domain", F.expr("page_id div 100").alias("part"), "page_id", row.alias("row"))
    return render.report_table(rows, ["domain", "part"], "page_id", "row").select("domain", "part", F.md5("html").alias("html_md5"), "n")


@query(
    f"""WITH {_DOMAINS}, r AS (SELECT domain, page_id, '<tr><td><img src=''' || {_escaped_sql(f"'{ICON_URL}' || host")} || ''' /><a href=''' || {_escaped_sql("url")} || '''>' || coalesce({_escaped_sql(_title_sql())}, '') || '</a></td>'
      || '<td>' || page_id || '</td><td></td><td>undefined</td><td>{NO_VERDICT}</td></tr>' AS row, (row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1) // 100 AS part FROM domains)
    SELECT domain, part, md5('{_HEAD}' || string_agg(row, '' ORDER BY page_id) || '</table>') AS html_md5, count(*) AS n FROM r GROUP BY ALL"""
)
def report_html_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The report of each domain by the table function in SQL: parts of a hundred rows, whatever their page ids are."""
    spark.udtf.register("report_parts", render.report_parts())
    pages = table(spark, sf, "pages").withColumn("domain", urls.registered_domain(F.col("url")))
    row = render.report_row(F.col("url"), html.title(F.col("html")), F.col("page_id"), F.lit(None).cast("string"), F.lit("undefined"), F.lit(NO_VERDICT))
    rows = pages.select("domain", "page_id", row.alias("row"))
    found = spark.sql("SELECT domain, part, html, n FROM report_parts(TABLE(SELECT domain, page_id, row FROM {rows}) PARTITION BY (domain) ORDER BY (page_id), 'row', 100)", rows=rows)
    return found.select("domain", "part", F.md5("html").alias("html_md5"), "n")


def _shown_sql(x: str) -> str:
    return f"replace({_escaped_sql(f"coalesce(nullif({x}, ''), 'N/A')")}, chr(10), '<br>')"


@query(
    f"""WITH {_DOMAINS}, t AS (SELECT page_id, url, host, {_title_sql()} AS title FROM domains)
    SELECT page_id, md5('<p>' || {_shown_sql("title")} || '</p><p>標題: ' || {_shown_sql("title")} || '</p><p>描述: N/A</p><p>來源: ' || {_shown_sql("host")} || '</p><p>網址: ' || {_shown_sql("url")} || '</p>') AS panel_md5 FROM t"""
)
def result_panel(spark: SparkSession, sf: str) -> DataFrame:
    titled = table(spark, sf, "pages").select("page_id", "url", html.title(F.col("html")).alias("title"))
    none = F.lit(None).cast("string")
    shown = render.panel(F.col("title"), F.col("title"), none, urls.host(F.col("url")), F.col("url"))
    return titled.select("page_id", F.md5(shown).alias("panel_md5"))


_REPORT_SQL = article.ORACLE.format(domains=_DOMAINS, paragraphs=_PARAGRAPHS, token=text.TOKEN, stop=_STOP, title=_title_sql(), bucket=_bucket_sql(sentiment.SENTIMENT_LABELS, 0.9), none=NO_VERDICT)


@query(_REPORT_SQL)
def article_report(spark: SparkSession, sf: str) -> DataFrame:
    return article.report(table(spark, sf, "pages"), table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "benchmark"))


@query(f"{_REPORT_SQL}WHERE title = (SELECT min(title) FROM own)")
def article_by_title(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the pages of one title, as a request names it; the title is looked up when the query is built."""
    pages = table(spark, sf, "pages")
    wanted = pages.agg(F.coalesce(F.min(html.title(F.col("html"))), F.lit(""))).first()[0]  # an empty title is none, so no page has it
    return article.report(pages, table(spark, sf, "documents"), table(spark, sf, "labels"), table(spark, sf, "benchmark"), title=wanted)


# --- sources, streams, trees ---


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    readers.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    back = readers.headed_csv(spark, path, "doc_id long, lang string, source string, n_chars long, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("SELECT 'item ' || item_id AS title, CASE WHEN item_id % 3 = 0 THEN 'a' END AS label1, 'b \"' || item_id || '\"' AS label2, CAST(item_id AS VARCHAR) AS label3, md5(text) AS text_md5 FROM benchmark")
def train_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "train")
    item = F.col("item_id").cast("string")
    rows = table(spark, sf, "benchmark").select(F.concat(F.lit("item "), item, F.lit("\n"), "text").alias("title"), F.when(F.col("item_id") % 3 == 0, "a").alias("label1"), F.concat(F.lit('b "'), item, F.lit('"')).alias("label2"), item.alias("label3"))
    rows.write.option("header", False).option("escape", '"').csv(path)
    title, rest = F.substring_index("title", "\n", 1), F.expr("substr(title, instr(title, chr(10)) + 1)")
    return readers.train_csv(spark, path).select(title.alias("title"), "label1", "label2", "label3", F.md5(rest).alias("text_md5"))


@query("SELECT DISTINCT trim(url, ' ') AS url FROM pages WHERE trim(url, ' ') <> ''")
def link_list_file(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "list")
    table(spark, sf, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url"), F.lit(""), "url")).alias("value")).write.text(path)
    return readers.link_list(spark, path)


@query("SELECT item_id AS line, len(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM benchmark")
def keyword_log_file(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "log")
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    readers.write_keyword_log(table(spark, sf, "benchmark").select(F.col("item_id").alias("line"), words.alias("keywords")), path)
    return readers.keyword_log(spark, path).select("line", F.size("keywords").cast("long").alias("n"))


@query(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'news_title' || CASE WHEN page_id % 2 = 0 THEN ',news_link' ELSE '' END WHEN page_id % 2 = 0 THEN 'news_link' ELSE '' END AS reason,
      CASE WHEN page_id % 2 <> 0 THEN url END AS news_link FROM pages"""
)
def stored_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl results into the store: accepted ones, and rejected ones with their reason."""
    path = shared_path(spark, "store")
    rows = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, "a title").alias("news_title"), F.md5("html").alias("news_content"), F.when(F.col("page_id") % 2 != 0, F.col("url")).alias("news_link"))
    readers.append_articles(rows, path)
    columns = ["page_id", "reason", "news_link"]
    return readers.accepted_articles(spark, path).withColumn("reason", F.lit("")).select(columns).unionByName(readers.rejected_articles(spark, path).select(columns))


@query(
    """WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'news_title' || CASE WHEN page_id % 2 = 0 THEN ',news_link' ELSE '' END WHEN page_id % 2 = 0 THEN 'news_link' ELSE '' END AS reason FROM pages)
    SELECT page_id, reason, CASE WHEN reason = '' THEN count(*) FILTER (reason = '') OVER () END AS ids, CASE WHEN reason = '' THEN count(*) FILTER (reason = '') OVER () END AS last_id FROM r"""
)
def articles_exactly_once(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a stream of batches of links into the store with a ledger: ids without gaps, rejected rows in quarantine."""
    spark.dataSource.register(PageReplay)
    pages = spark.readStream.format("page_replay").options(path=f"{sf.rstrip('/')}/pages.parquet", linksPerBatch=512, tasksPerBatch=32).load()
    rows = pages.select("page_id", F.when(F.col("page_id") % 5 != 0, "a title").alias("news_title"), F.md5("html").alias("news_content"), F.when(F.col("page_id") % 2 != 0, F.col("url")).alias("news_link"))
    sink = FileSink(shared_path(spark, "ledger"), ["news_title", "news_content", "news_link"])
    posts.run_through(rows, sink, shared_path(spark, "ledger-state"))
    numbers = sink.accepted(spark).agg(F.count_distinct("ID").alias("ids"), F.max("ID").alias("last_id"))  # one row
    good = sink.accepted(spark).select("page_id", F.lit("").alias("reason")).crossJoin(F.broadcast(numbers))
    none = F.lit(None).cast("long")
    return good.unionByName(sink.rejected(spark).select("page_id", "reason", none.alias("ids"), none.alias("last_id")))


@query("SELECT user_id AS post_id, count(DISTINCT event_id) AS clicks, count(DISTINCT event_id) % 2 = 1 AS visible FROM events WHERE event_type = 'click' GROUP BY user_id")
def click_toggle_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """The toggles with state that ends: each post's last state, whether or not it has expired since."""
    events = posts.stateful_session(spark).readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{sf.rstrip('/')}/events.parquet*").where("event_type = 'click'")
    clicks = events.select(F.col("user_id").cast("string").alias("post_id"), "event_id", "ts")
    states = posts.expiring_toggles(clicks.unionByName(clicks))
    found = posts.latest_states(states, ["post_id"], "clicks", shared_path(spark, "expiring"), shared_path(spark, "expiring-state"), mode="append", reader=spark)
    return found.where("kind <> 'late'").select(F.col("post_id").cast("long").alias("post_id"), "clicks", "visible")


@query("SELECT CAST(doc_id AS INTEGER) AS \"Bug_ID\", source AS \"COMMENT\", md5(text) AS image_md5 FROM documents")
def bug_report_store(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "bugs")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("int").alias("Bug_ID"), F.lit("2024-01-01").cast("timestamp").alias("Bug_DATE"), F.col("source").alias("COMMENT"), F.col("text").alias("Bug_IMAGE"))
    readers.append_bug_reports(rows, path)
    return spark.read.parquet(path).select("Bug_ID", "COMMENT", F.md5("Bug_IMAGE").alias("image_md5"))


@query("SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def page_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Pages through the Python data source that stands in for live requests."""
    spark.dataSource.register(PageReplay)
    pages = spark.read.format("page_replay").option("path", f"{sf.rstrip('/')}/pages.parquet").load()
    return pages.select("page_id", "url", F.md5("html").alias("html_md5"))


@query(f"WITH l AS (SELECT page_id, regexp_extract_all(html, '{html.HREF}', 1) AS links FROM pages) SELECT page_id, unnest(range(1, len(links) + 1)) AS pos, unnest(links) AS href FROM l")
def page_links_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """Links by the table function, joined laterally."""
    found = table(spark, sf, "pages").lateralJoin(ExtractLinks(F.col("html").outer()))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string").parquet(f"{sf.rstrip('/')}/events.parquet*")
    span = table(spark, sf, "events").agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0  # a post stays known for as long as the events last
    once = posts.first_seen(events, ["user_id", "event_type"], late=f"{span + 1} days").select("user_id", "event_type")
    return posts.drained(once, shared_path(spark, "stream"), shared_path(spark, "stream-state"))


@query(f"WITH {_DOMAINS}, {_PARAGRAPHS}, c AS (SELECT page_id, string_agg(text, '' ORDER BY pos) AS content FROM paragraphs GROUP BY page_id) SELECT url, domain, md5(content) AS content_md5 FROM domains JOIN c USING (page_id) WHERE domain <> 'example.org'")
def page_dom_extract(spark: SparkSession, sf: str) -> DataFrame:
    columns = "domain string, priority int, title_sel string, body_sel string, stop_mode string, stop_text string"
    rules = spark.createDataFrame([("example.com", 1, "article h1", "article p", "none", None), ("example.net", 1, "h2", "p", "none", None), ("example.net", 2, "h1", "p", "none", None)], columns)
    return dom.extract(table(spark, sf, "pages"), rules, ban_lines(spark)).select("url", "domain", F.md5("content").alias("content_md5"))


_STEP = re.compile(r"(?P<tag>[a-z][a-z0-9]*)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)=\"?(?P<value>[^\"\]]*)\"?\])?$")


def _opened(selector: str) -> tuple[str, str]:
    """Start and end tags of nested elements that a selector finds."""
    start = end = ""
    for step in re.findall(r"(?:\[[^\]]*\]|[^\s>\[])+", selector):
        m = _STEP.match(step if step != "*" else "span")
        named = [f'{name}="{value}"' for name, value in (("id", m["id"]), ("class", m["cls"]), (m["attr"], m["value"])) if value is not None]
        start, end = start + f"<{' '.join([m['tag'] or 'div', *named])}>", f"</{m['tag'] or 'div'}>" + end
    return start, end


#: Ban and break lines as they stand in the made-up articles of the site rules.
_LINES = ("圖像來源，Reuters", "更多風傳媒報導")


@query(
    f"""WITH {_PARAGRAPHS}, own AS (SELECT p.page_id, coalesce({_title_sql()}, '') AS title, coalesce(c.content, '') AS content FROM pages p LEFT JOIN (SELECT page_id, string_agg(text, '' ORDER BY pos) AS content FROM paragraphs GROUP BY page_id) c USING (page_id)),
    r AS (SELECT * FROM (VALUES (0, 'chinatimes.com', 'skip'), (1, 'cna.com.tw', 'skip'), (2, 'ettoday.net', 'break'), (3, 'ltn.com.tw', 'break'), (4, 'pts.org.tw', 'all'), (5, 'newtalk.tw', 'all'),
      (6, 'setn.com', 'all'), (7, 'thenewslens.com', 'skip'), (8, 'udn.com', 'all'), (9, 'udn.com', 'all'), (10, 'yahoo.com', 'both'), (11, 'yahoo.com', 'all'), (12, 'yahoo.com', 'all'), (13, 'rfi.fr', 'skip'),
      (14, 'rti.org.tw', 'all'), (15, 'storm.mg', 'both'), (16, 'bbc.com', 'skip'), (17, 'bbc.com', 'skip'), (18, 'mirrormedia.mg', 'all'), (19, 'cw.com.tw', 'all'), (20, 'epochtimes.com', 'all'),
      (21, 'nytimes.com', 'all'), (22, 'wsj.com', 'all'), (23, 'worldjournal.com', 'break')) v(rule, domain, ends))
    SELECT 'https://news.' || domain || '/' || page_id AS url, domain, rtrim('Title ' || page_id || ' ' || title) AS title, content || 'one ' || page_id || CASE ends WHEN 'all' THEN '圖像來源，Reuters' ELSE '' END
      || CASE WHEN ends <> 'break' THEN 'two & ' || page_id ELSE '' END || CASE WHEN ends IN ('all', 'skip') THEN '更多風傳媒報導three' ELSE '' END AS content
    FROM own JOIN r ON page_id % 24 = rule"""
)
def site_rules_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's title and paragraphs in the markup of one site's rules, taken apart by the rules and the ban and break lines."""
    rows = []
    for k, (domain, _, title_sel, body_sel, _, _) in enumerate(SITE_RULES):
        outer, _, inner = body_sel.rpartition(" ")
        first, _, below = title_sel.partition(" ")
        shared = first if below and outer.startswith(f"{first} ") else ""  # an element around both
        title, body, part = _opened(title_sel.removeprefix(shared)), _opened(outer.removeprefix(shared).rstrip("> ")), _opened(inner)
        rows.append((k, domain, *_opened(shared), *title, *body, *part))
    markup = spark.createDataFrame(rows, "rule int, site string, a0 string, a1 string, t0 string, t1 string, b0 string, b1 string, p0 string, p1 string")
    line = lambda *x: F.concat("p0", *[y if isinstance(y, Column) else F.lit(y) for y in x], "p1")
    key = F.col("page_id").cast("string")
    own = F.array_join(F.transform("paras", lambda p: F.concat("p0", html.escaped(p), "p1")), "")
    parts = [own, line("one ", key), line(_LINES[0]), line("two &amp; ", key), line(_LINES[1]), line("three")]
    page = F.concat(F.lit("<html><body>"), "a0", "t0", F.lit("Title "), key, F.lit(" "), html.escaped(F.coalesce("title", F.lit(""))), "t1", "b0", *parts, "b1", "a1", F.lit("</body></html>"))
    read = table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.paragraphs(F.col("html")).alias("paras"))
    pages = read.join(F.broadcast(markup), F.col("page_id") % len(SITE_RULES) == F.col("rule"))
    made = pages.select(F.concat(F.lit("https://news."), "site", F.lit("/"), key).alias("url"), page.alias("html"))
    return dom.extract(made, site_rules(spark), ban_lines(spark))


@query()
def doc_keywords_embedding(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return keywords.by_embedding(docs, "doc_id", F.col("text"), text.tokens(F.col("text")), hashed_embedding(), 5).select("doc_id", "rank", "term", "similarity")
