"""URL filters: redirect equivalence.

Pages that redirect to each other or name the same canonical link are one resource under
several names. Distributed connected components over those edges make the classes; a page
with a rule of its own takes that rule's verdict, any other page takes its class's: blocked
if a page of the class is blocked by rule and none is allowed by rule, else allowed.

Nodes are urls. A url has an edge to where every site redirects it - https, no www. or m. in
front, no trailing slash, .html, fragment or tracking parameter, arguments in order - and to the
targets of <link rel="canonical"> and of <meta http-equiv="refresh"> in its page's HTML, which have
edges of their own kind in turn.

Defined results: a null url, or one without ://, has empty host and path, fits no rule, has no edge
and stands alone. Relative targets are resolved against the page's url (a <base> is not read); those
of other kinds, as mailto:, are none. Repeated rows and ties of a url get equal answers, and links of
each of its rows count. A null page_id is kept. HTML of any length is one value, read once. An empty
table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import ascii_lower, connected_components, join_by_class, stored

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL, _HREF = r"""(?is)^<link\b[^>]*\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH, _URL = r"""(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (length, allow, rule); null where none does.

    Of one rule string given both ways, allow wins. The list is the caller's, and is compiled
    into the plan, so that judging a page needs no join.
    """
    fits = []
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        on = (host == name) | host.endswith("." + name)
        one = F.struct(F.lit(len(rule)).alias("length"), F.lit(action == "allow").alias("allow"), F.lit(rule).alias("rule"))
        fits.append(F.when(on & path.startswith(slash + rest), one))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")


def redirect_of(url: Column) -> Column:
    """Where every site redirects a url; null where it has no host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_\w+|ref|fbclid|gclid)(?:=|$)")))
    name = F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", name)


def _without_dots(path: Column) -> Column:
    """A path and what follows it, the path's . and .. segments resolved."""
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.array_append(acc, x))
    bare = F.regexp_extract(path, r"(?s)^([^?#]*)", 1)
    return F.concat(F.array_join(F.aggregate(F.split(bare, "/"), none, step), "/"), F.substring(path, F.length(bare) + 1, F.length(path)))


def resolved(base: Column, to: Column) -> Column:
    """A link's target as a whole url; null where it names nothing on the web."""
    start = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.coalesce(F.nullif(F.regexp_replace(path, r"[^/]*$", ""), F.lit("")), F.lit("/"))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(F.lit("https:"), to))
        .when(to.startswith("/"), F.concat(start, _without_dots(to)))
        .when(to.startswith("?"), F.concat(start, path, to))
        .when(to.startswith("#"), base)
        .otherwise(F.concat(start, _without_dots(F.concat(folder, to))))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): urls of pages and the whole urls that their canonical and refresh links name."""
    tag = F.col("tag")
    to = F.when(tag.rlike(_CANONICAL), F.regexp_extract(tag, _HREF, 1)).when(tag.rlike(_REFRESH), F.regexp_extract(tag, _URL, 1))
    tags = pages.where(host_of(F.col("url")) != "").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_TAGS), 0)).alias("tag"))
    found = tags.select("src", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    return found.select("src", resolved(F.col("src"), F.col("to")).alias("dst")).where("dst is not null").distinct()


def named_urls(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url, n, name): every url of a page or a link, the number of its pages, and where sites redirect it, itself where
    nowhere. A url of very many pages is one row from each task before any exchange."""
    of_pages = pages.where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    urls = of_pages.union(links.select("dst", F.lit(0).cast("long")).distinct()).groupBy("url").agg(F.sum("n").alias("n"))
    return urls.withColumn("name", F.coalesce(redirect_of(F.col("url")), F.col("url")))


def name_edges(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): edges between the names of urls, from links, and from names that are urls with another name.

    Urls of one name need no edge: they are one class by it. So only what links name goes into the components.
    """
    name = lambda c: F.coalesce(redirect_of(F.col(c)), F.col(c))
    linked = links.select(name("src").alias("src"), name("dst").alias("dst"))
    again = urls.select("name").distinct().where(redirect_of(F.col("name")) != F.col("name"))
    again = again.join(urls.select(F.col("url").alias("name")), "name", "left_semi").select("name", redirect_of(F.col("name")))
    return linked.union(again).where("src <> dst").distinct()


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component): every page with its verdict."""
    url = F.col("url")
    links = stored(page_links(pages))
    urls = stored(named_urls(pages, links).withColumn("best", best_rule(host_of(url), path_of(url), rules)))
    component = connected_components(name_edges(urls, links)).withColumnsRenamed({"node": "name", "component": "first"})
    urls = urls.join(component, "name", "left").withColumn("component", F.coalesce("first", "name")).drop("first")
    named = F.col("best.allow")
    # a class is named by its least url or redirect; urls without a page say nothing on its verdict
    classes = urls.groupBy("component").agg(F.bool_or(named & (F.col("n") > 0)).alias("ca"), F.bool_or(~named & (F.col("n") > 0)).alias("cb"), F.min(F.least("url", "name")).alias("least"), F.count(F.lit(1)).alias("n"))
    by_class = F.when(F.coalesce("cb", F.lit(False)) & ~F.coalesce("ca", F.lit(False)), "block").otherwise("allow")
    of = join_by_class(urls.where("n > 0").withColumnRenamed("n", "pages"), classes, "component", "url", urls.count())
    of = of.select("url", F.col("best.rule").alias("rule"), F.coalesce(F.when(named, "allow").when(~named, "block"), by_class).alias("verdict"), F.col("least").alias("component"), F.col("pages").alias("n"))
    rows = pages.select("page_id", "url", F.monotonically_increasing_id().alias("place"))
    out = join_by_class(rows, of, "url", "place", rows.count())
    return out.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component")


_SQL_REDIRECT = """CASE WHEN regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:www|m)\\.', '') <> '' THEN
  'https://' || regexp_replace(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:www|m)\\.', '')
  || regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', ''), '\\.html$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^#]*?\\?([^#]*)', 1), '&'),
       lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_\\w+|ref|fbclid|gclid)(?:=|$)'))), '&'), ''), '') END"""


def _sql_dots(x: str) -> str:
    fold = "list_reduce(list_transform(string_split(regexp_extract({x}, '(?s)^([^?#]*)', 1), '/'), lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)"
    return f"(array_to_string({fold.format(x=x)}, '/') || substring({x}, length(regexp_extract({x}, '(?s)^([^?#]*)', 1)) + 1))"


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), '') AS start
  FROM pages
), tags AS (
  SELECT url, start, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''
), tos AS (
  SELECT *, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
       WHEN regexp_matches(tag, '(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&') AS t,
       coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') AS folder
  FROM tags
), links AS (
  SELECT DISTINCT url AS src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN 'https:' || t
       WHEN starts_with(t, '/') THEN start || """ + _sql_dots("t") + """ WHEN starts_with(t, '?') THEN start || path || t WHEN starts_with(t, '#') THEN url ELSE start || """ + _sql_dots("(folder || t)") + """ END AS dst
  FROM tos WHERE t <> ''
), urls AS (
  SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL
), e0 AS (
  SELECT src, dst FROM links WHERE dst IS NOT NULL UNION SELECT url, """ + _SQL_REDIRECT + """ FROM urls
), e AS (
  SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst
), reach(url, other) AS (
  SELECT src, src FROM e UNION SELECT r.url, e.dst FROM reach r JOIN e ON e.src = r.other
), c AS (
  SELECT url, min(other) AS component FROM reach GROUP BY url
), r AS (
  SELECT p.*, coalesce(c.component, p.url) AS component,
         (SELECT max({'length': length(rule), 'allow': action = 'allow', 'rule': rule})
          FROM (VALUES ('allow', 'org', 'org/', '/'), ('block', 'example.org', 'example.org/es/', '/es/'),
                       ('block', 'example.org', 'example.org/en/1', '/en/1'), ('allow', 'com', 'com/fr/', '/fr/'),
                       ('block', 'com', 'com/de/', '/de/')) v(action, name, rule, start)
          WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, v.start)) AS best
  FROM p LEFT JOIN c ON c.url = p.url
), k AS (
  SELECT component, bool_or(NOT best.allow) AS b, bool_or(best.allow) AS a FROM r WHERE component IS NOT NULL GROUP BY component
)
SELECT r.page_id, r.host, r.path, r.best.rule AS rule,
       CASE WHEN r.best.allow THEN 'allow' WHEN NOT r.best.allow THEN 'block'
            WHEN coalesce(k.b, false) AND NOT coalesce(k.a, false) THEN 'block' ELSE 'allow' END AS verdict,
       r.component
FROM r LEFT JOIN k ON k.component = r.component
"""
