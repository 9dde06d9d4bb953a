"""Site rewriting and deployment."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import site as FS
from shelfmark.operators import site as S
from shelfmark.session import work_dir
from shelfmark.sources.archives import read_tree
from shelfmark.sources.trees import write_tree
from workload import adapters as A
from workload.registry import cte, query

_SETTINGS = {"default": {"footer": "<p>foot</p>", "domain": "old.example"}, "prod": {"domain": "docs.example", "unused": "x"}}
_URL = FS.gateway_url("abc123", "us-east-1", "prod")
cte(
    "applied_pages",
    f"""SELECT page_id, path, html,
               replace(replace(replace(html, '{{{{{{settings.footer}}}}}}', '<p>foot</p>'), '{{{{{{settings.domain}}}}}}', 'docs.example'),
                       '{_URL}', 'https://docs.example') AS new_html,
               CAST((length(html) - length(replace(html, '{{{{{{settings.footer}}}}}}', ''))) / 21 AS BIGINT) AS footer,
               CAST((length(html) - length(replace(html, '{{{{{{settings.domain}}}}}}', ''))) / 21 AS BIGINT) AS domain,
               CAST((length(html) - length(replace(html, '{_URL}', ''))) / {len(_URL)} AS BIGINT) AS url
        FROM site_pages""",
)


def _applied(t):
    return S.apply_settings(A.site_pages(t), S.overlay_settings(_SETTINGS, "prod"), _URL)


@query("replace_tokens", "SELECT page_id, new_html, footer, domain, url FROM applied_pages")
def _(t):
    count = lambda key: F.coalesce(F.try_element_at("counts", F.lit(key)), F.lit(0))
    return _applied(t).select(
        "page_id", "new_html", count("footer").alias("footer"), count("domain").alias("domain"), count(S.URL_COUNT).alias("url")
    )


@query("changed_pages", "SELECT page_id, path, new_html AS html FROM applied_pages WHERE html <> new_html")
def _(t):
    return S.changed_pages(_applied(t)).select("page_id", "path", "html")


@query("write_site", "SELECT path, new_html AS html FROM applied_pages WHERE html <> new_html")
def _(t):
    """Changed pages written as files, and the tree read back."""
    root = work_dir(t.spark, "site")
    write_tree(S.changed_pages(_applied(t)), root)
    return read_tree(t.spark, root).select("path", "html")


@query(
    "replacement_totals",
    """SELECT key, CAST(sum(n) AS BIGINT) AS replacements FROM (
         SELECT unnest(['footer', 'domain', 'apiGatewayUrl']) AS key, unnest([footer, domain, url]) AS n FROM applied_pages WHERE html <> new_html)
       WHERE n > 0 GROUP BY key""",
)
def _(t):
    return S.replacement_totals(_applied(t))


cte(
    "linked_pages",
    r"""
    SELECT page_id, path, array_to_string(list_concat([parts[1]], list_transform(links, lambda s: 'href=' ||
      CASE WHEN s.link IS NULL THEN s.part
      ELSE s.part[1] || regexp_replace(
             CASE WHEN s.part[length(s.link) + 2] = s.part[1] AND ends_with(s.named, '.md')
                  THEN substring(s.named, 1, length(s.named) - 3) || '.html' ELSE s.named END,
             '^(.*)\.md#', '\1.html#') || substring(s.part, length(s.link) + 2) END)), '') AS html
    FROM (SELECT *, list_transform(found, lambda f: {'part': f.part, 'link': f.link,
                   'named': regexp_replace(f.link, '^(.*)README\.md', '\1index.html')}) AS links
          FROM (SELECT *, list_transform(parts[2:], lambda p: {'part': p, 'link':
                   CASE WHEN p[1] = chr(34) THEN regexp_extract(substring(p, 2), '^[^"\n]*')
                        WHEN p[1] = chr(39) THEN regexp_extract(substring(p, 2), '^[^''\n]*') END}) AS found
                FROM (SELECT page_id, path, string_split(html, 'href=') AS parts FROM site_pages)))
    """,
)


@query("rewrite_links", "SELECT page_id, html FROM linked_pages")
def _(t):
    return A.site_pages(t).select("page_id", FS.rewrite_links(F.col("html")).alias("html"))


cte(
    "page_trails",
    """SELECT p.page_id, '<nav aria-label="Breadcrumb" class="breadcrumb-nav"><ol><li><a href="/">Home</a></li><li><a href="/docs/">Docs</a></li>'
              || '<li><a href="/docs/d' || (p.page_id % 7) || '/">D' || (p.page_id % 7) || '</a></li><li aria-current="page">'
              || coalesce(nullif(regexp_extract(html, '<title>(.*?)</title>', 1), ''), 'p' || p.page_id) || '</li></ol></nav>' AS trail
       FROM site_pages p""",
)


@query("breadcrumbs", "SELECT page_id, trail FROM page_trails")
def _(t):
    directory = F.element_at(F.split("path", "/"), -2)
    title = FS.html_title(F.col("html"), F.col("path"))
    return A.site_pages(t).select("page_id", FS.breadcrumb(directory, title).alias("trail"))


@query(
    "page_navigation",
    f"""SELECT page_id, CASE WHEN strpos(crumbed, '</body>') > 0
                 THEN substring(crumbed, 1, strpos(crumbed, '</body>') - 1) || '{FS.FOOTER.replace("'", "''").replace(chr(10), "' || chr(10) || '")}'
                      || substring(crumbed, strpos(crumbed, '</body>')) ELSE crumbed END AS html
        FROM (SELECT l.page_id, CASE WHEN body_at > 0 THEN substring(html, 1, body_at + strpos(substring(html, body_at), '>') - 1) || trail
                       || substring(html, body_at + strpos(substring(html, body_at), '>')) ELSE html END AS crumbed
              FROM (SELECT *, strpos(lower(html), '<body') AS body_at FROM linked_pages) l JOIN page_trails USING (page_id))""",
)
def _(t):
    return S.page_navigation(A.site_pages(t)).select("page_id", "html")


@query(
    "markdown_titles",
    r"""SELECT file_ord, CASE WHEN h <> '' THEN h ELSE 'doc_' || (file_ord % 50) END AS title
        FROM (SELECT file_ord, regexp_extract(content, '(?m)^# (.*)$', 1) AS h FROM files_md)""",
)
def _(t):
    return A.files_md(t).select("file_ord", FS.markdown_title(F.col("content"), F.col("path")).alias("title"))


@query(
    "overlay_settings",
    """SELECT c_name AS key, CASE WHEN c_custkey % 3 > 0 THEN 'n' || c_nationkey ELSE c_mktsegment END AS value FROM customer""",
)
def _(t):
    key = F.col("c_custkey") % 3
    defaults = t.customer.where(key < 2).select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    stage = t.customer.where(key > 0).select(F.col("c_name").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("value"))
    return S.overlay_setting_rows(defaults, stage)


@query(
    "overlay_trees",
    """SELECT path, page_id, html FROM (SELECT 'p' || (page_id % 40) AS path, page_id, html, page_id // 40 AS layer FROM pages WHERE page_id < 120)
       QUALIFY row_number() OVER (PARTITION BY path ORDER BY layer DESC) = 1
       UNION ALL SELECT 'q' || page_id, page_id, html FROM pages WHERE page_id >= 120""",
)
def _(t):
    """Three staging areas that share forty paths; all other pages have paths of their own."""
    page = F.col("page_id")
    pages = t.pages.select(
        F.when(page < 120, F.concat(F.lit("p"), page % 40)).otherwise(F.concat(F.lit("q"), page)).alias("path"),
        "page_id",
        "html",
    )
    layer = F.floor(page / 40)
    return S.overlay_trees(pages.where((layer == 0) | (page >= 120)), pages.where(layer == 1), pages.where(layer == 2))


@query(
    "sync_plan",
    """SELECT 'p' || page_id AS path, CASE page_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'add' ELSE 'update' END AS action
       FROM pages WHERE page_id % 4 <> 3""",
)
def _(t):
    page = F.col("page_id")
    path = F.concat(F.lit("p"), page).alias("path")
    build = t.pages.where(page % 4 != 0).select(path, "html")
    deployed = t.pages.where(page % 4 != 1).select(
        path, F.when(page % 4 == 2, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("html")
    )
    return S.sync_plan(build, deployed)
