"""The supplied tables seen as repositories, catalogs, logs, requests, names and sites.

Every adapter exists twice, as a DataFrame and as a CTE, so that both engines start from the
same rows.  All of them keep every row and every text of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import PYTHON_STOP_WORDS as PYTHON_STOP
from shelfmark.functions.text import QUERY_STOP_WORDS as QUERY_STOP
from shelfmark.functions.text import STOP_WORDS as STOP
from shelfmark.session import spread
from workload.registry import Tables, cte

def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_keywords(text: str, minimum: int = 2, stop=STOP, keep: str = "a-z0-9", sep: str = "") -> str:
    """DuckDB expression for the ordered distinct keywords of ``text``."""
    tokens = rf"string_split_regex(regexp_replace(lower({text}), '[^{keep}\s-]', ' ', 'g'), '[{sep}\s]+')"
    kept = f"list_filter({tokens}, lambda w: length(w) >= {minimum} AND NOT list_contains({sql_list(stop)}, w))"
    return sql_ordered_distinct(kept)


def sql_ordered_distinct(items: str) -> str:
    """DuckDB expression for the distinct items of a list in order of first occurrence."""
    numbered = f"SELECT unnest({items}) AS w, generate_subscripts({items}, 1) AS i"
    return f"coalesce((SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM ({numbered}) GROUP BY w)), [])"


def sql_slug(text: str) -> str:
    kept = rf"regexp_replace(lower({text}), '[^a-z0-9\s-]', '', 'g')"
    return rf"regexp_replace(regexp_replace({kept}, '[\s-]+', '-', 'g'), '^-|-$', '', 'g')"


def sql_trim(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


# --- repositories and files ---------------------------------------------------------------------


def files_md(t: Tables) -> DataFrame:
    """Documents as Markdown files: every fifth line becomes a heading; paths repeat across documents."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).otherwise(x)
    )
    return spread(t.documents).select(
        F.concat(F.lit("org"), F.col("doc_id") % 3).alias("owner"),
        F.col("source").alias("repo"),
        (F.col("doc_id") % 3).cast("int").alias("src_ord"),
        F.col("doc_id").alias("file_ord"),
        F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id") % 50, F.lit(".md")).alias("path"),
        F.array_join(lines, "\n").alias("content"),
    )


cte(
    "files_md",
    """
    SELECT 'org' || (doc_id % 3) AS owner, source AS repo, CAST(doc_id % 3 AS INTEGER) AS src_ord,
           doc_id AS file_ord, lang || '/doc_' || (doc_id % 50) || '.md' AS path,
           array_to_string(list_transform(string_split(text, chr(10)),
             lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '# ' || x ELSE x END), chr(10)) AS content
    FROM documents
    """,
)
cte(
    "md_lines",
    r"""
    SELECT file_ord, unnest(string_split(content, chr(10))) AS line,
           generate_subscripts(string_split(content, chr(10)), 1) AS pos
    FROM files_md
    """,
)
cte(
    "md_marked",
    r"""
    SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+[^\n\r]+$') THEN 1 ELSE 0 END)
              OVER (PARTITION BY file_ord ORDER BY pos) AS sec,
           regexp_matches(line, '^#{1,6}\s+[^\n\r]+$') AS is_heading
    FROM md_lines
    """,
)
cte(
    "md_sections",
    rf"""
    SELECT f.owner, f.repo, f.src_ord, f.file_ord, f.path, CAST(m.sec - 1 AS INTEGER) AS sec_ord,
           max(CASE WHEN is_heading THEN length(regexp_extract(line, '^#+')) END) AS level,
           max(CASE WHEN is_heading THEN {sql_trim("regexp_replace(line, '^#+', '')")} END) AS heading,
           {sql_trim("coalesce(string_agg(CASE WHEN NOT is_heading THEN line END, chr(10) ORDER BY pos), '')")} AS body
    FROM md_marked m JOIN files_md f USING (file_ord)
    WHERE m.sec > 0
    GROUP BY ALL
    """,
)
cte("md_slugged", f"SELECT *, {sql_slug('heading')} AS slug FROM md_sections")
cte(
    "md_entries",
    rf"""
    SELECT owner, repo AS repository, src_ord, file_ord, sec_ord,
           owner || '/' || repo || '/' || path || '/' || slug AS content_path,
           sha256(owner || '/' || repo || '/' || path || '/' || slug) AS hash,
           heading AS title, substring(body, 1, 200) AS excerpt, body AS content,
           'documentation' AS type, 'guide' AS sub_type,
           CASE WHEN len(kw) > 0 THEN kw
                ELSE [CASE WHEN trim(replace(slug, '-', ' ')) <> '' THEN trim(replace(slug, '-', ' '))
                           ELSE lower(heading) END] END AS keywords
    FROM (SELECT *, {sql_keywords("heading || chr(10) || body")} AS kw FROM md_slugged WHERE slug <> '')
    """,
)
cte(
    "md_unique",
    """
    SELECT * FROM md_entries
    QUALIFY row_number() OVER (PARTITION BY content_path ORDER BY src_ord, repository, file_ord, sec_ord) = 1
    """,
)
cte(
    "md_postings",
    """
    SELECT keyword, hash,
           CAST(floor((CASE WHEN contains(lower(title), keyword) THEN 10 ELSE 0 END
                     + CASE WHEN contains(lower(content), keyword) THEN 5 ELSE 0 END + 3) * 1.0 + 0.5) AS INTEGER)
             AS relevance_score,
           CAST(1.0 AS DOUBLE) AS type_weight
    FROM (SELECT hash, title, content, unnest(keywords) AS keyword FROM md_unique)
    """,
)


def search_queries(t: Tables) -> DataFrame:
    """Every benchmark text as a query."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


cte(
    "search_queries",
    "SELECT item_id AS query_id, text FROM benchmark",
)
cte(
    "search_terms",
    f"""
    SELECT query_id, unnest(kw) AS keyword, generate_subscripts(kw, 1) - 1 AS term_pos
    FROM (SELECT query_id, {sql_keywords("text", 3, QUERY_STOP)} AS kw FROM search_queries)
    """,
)
cte(
    "search_scored",
    """
    SELECT query_id, hash, CAST(sum(relevance_score) AS BIGINT) AS total_score,
           CAST(min(term_pos) AS INTEGER) AS first_pos
    FROM search_terms JOIN md_postings USING (keyword) GROUP BY query_id, hash
    """,
)
cte(
    "search_candidates",
    """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, first_pos, hash) AS cand
    FROM search_scored QUALIFY cand <= 30
    """,
)

_DIRECTORIES = ["src", ".git/hooks", "node_modules/pkg", "docs", "lib/tests", "build", "src/dist/x", "a/.hidden"]
_NAMES = [
    "README.md", "LICENSE.md", "template-x.yml", "config.yml", "README.MD", "index.js", "app.jsx", "main.py",
    "Template.YAML", ".js", "notes.txt", "Makefile", "license.md",
]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def paths(t: Tables) -> DataFrame:
    """One generated repository path per document."""
    doc = F.col("doc_id")
    return t.documents.select(
        "doc_id", F.concat(_pick(_DIRECTORIES, doc), F.lit("/"), _pick(_NAMES, doc)).alias("path")
    )


cte(
    "paths",
    f"""
    SELECT doc_id, {sql_list(_DIRECTORIES)}[CAST(doc_id % {len(_DIRECTORIES)} AS INTEGER) + 1] || '/' ||
           {sql_list(_NAMES)}[CAST(doc_id % {len(_NAMES)} AS INTEGER) + 1] AS path
    FROM documents
    """,
)

# --- catalog ------------------------------------------------------------------------------------


def objects(t: Tables) -> DataFrame:
    """Parts as catalog objects in three prioritised buckets; names repeat, so the first one wins."""
    key = F.col("p_partkey")
    ext = F.when(key % 7 == 0, ".txt").when(key % 2 == 0, ".yml").otherwise(".yaml")
    namespace = F.regexp_replace(F.lower("p_brand"), "#", "-")
    name = F.regexp_replace("p_name", " ", "-")
    object_key = F.concat(namespace, F.lit("/templates/v2/"), F.lower("p_type"), F.lit("/"), name, ext)
    return t.part.select(
        F.concat(F.lit("b"), key % 3).alias("bucket"),
        object_key.alias("key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key * 60).alias("last_modified"),
        F.col("p_size").cast("bigint").alias("size"),
        key.alias("row_id"),
    )


cte(
    "objects",
    """
    SELECT 'b' || (p_partkey % 3) AS bucket,
           replace(lower(p_brand), '#', '-') || '/templates/v2/' || lower(p_type) || '/' ||
           replace(p_name, ' ', '-') ||
           CASE WHEN p_partkey % 7 = 0 THEN '.txt' WHEN p_partkey % 2 = 0 THEN '.yml' ELSE '.yaml' END AS key,
           1700000000 + p_partkey * 60 AS modified_s, CAST(p_size AS BIGINT) AS size, p_partkey AS row_id
    FROM part
    """,
)
SOURCES = ["b2", "b0", "b1"]


def object_versions(t: Tables) -> DataFrame:
    """Orders as the version history of catalog objects."""
    key = F.col("o_orderkey")
    version = F.concat(
        F.lit("v"), F.col("o_custkey") % 3, F.lit("."), key % 5, F.lit("."), key % 40, F.lit("/"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    return t.orders.select(
        F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("t"), F.col("o_custkey") % 100).alias("name"),
        key.cast("string").alias("version_id"),
        F.when(key % 97 != 0, version).alias("version"),
        # One second per key keeps the order total.
        F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key % 86_400).alias(
            "last_modified"
        ),
        F.col("o_totalprice").cast("bigint").alias("size"),
        key.alias("row_id"),
    )


cte(
    "object_versions",
    """
    SELECT o_orderpriority AS category, 't' || (o_custkey % 100) AS name,
           CAST(o_orderkey AS VARCHAR) AS version_id,
           CASE WHEN o_orderkey % 97 <> 0 THEN 'v' || (o_custkey % 3) || '.' || (o_orderkey % 5) || '.' ||
             (o_orderkey % 40) || '/' || strftime(o_orderdate, '%Y-%m-%d') END AS version,
           CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS modified_s,
           CAST(trunc(o_totalprice) AS BIGINT) AS size, o_orderkey AS row_id
    FROM orders
    """,
)


def installed(t: Tables) -> DataFrame:
    """Customers as installed templates whose version is given in one of three formats."""
    key = F.col("c_custkey")
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    short = F.concat(F.lit("v"), key % 3, F.lit("."), key % 5, F.lit("."), key % 40)
    current = (
        F.when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 3 == 0, F.concat(short, F.lit("/1997-05-28")))
        .when(key % 3 == 1, short)
        .otherwise((key * 7 % 2000).cast("string"))
    )
    return t.customer.select(
        key.alias("row_id"),
        _pick(priorities, key).alias("category"),
        F.concat(F.lit("t"), key % 110).alias("name"),
        current.alias("current_version"),
    )


cte(
    "installed",
    """
    SELECT c_custkey AS row_id,
           ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][CAST(c_custkey % 5 AS INTEGER) + 1] AS category,
           't' || (c_custkey % 110) AS name,
           CASE WHEN c_custkey % 11 = 0 THEN NULL
                WHEN c_custkey % 3 = 0 THEN 'v' || (c_custkey % 3) || '.' || (c_custkey % 5) || '.' || (c_custkey % 40) || '/1997-05-28'
                WHEN c_custkey % 3 = 1 THEN 'v' || (c_custkey % 3) || '.' || (c_custkey % 5) || '.' || (c_custkey % 40)
                ELSE CAST(c_custkey * 7 % 2000 AS VARCHAR) END AS current_version
    FROM customer
    """,
)

# --- requests and logs --------------------------------------------------------------------------


def requests(t: Tables) -> DataFrame:
    """Events as requests of clients, most of them behind a proxy."""
    user = F.col("user_id")
    address = F.concat(F.lit("10.0."), F.floor(user / 256).cast("bigint"), F.lit("."), user % 256)
    forwarded = F.when(user % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit(" "), address, F.lit(" , 172.16.0.1"))
    )
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        forwarded.alias("forwarded_for"),
        F.when(user % 10 != 0, address).alias("source_ip"),
        _pick(["public", "registered", "paid", "private"], user).alias("tier"),
    )


cte(
    "requests",
    """
    SELECT event_id AS request_id, ts, epoch_us(ts) // 1000 AS ms,
           CASE WHEN user_id % 5 <> 0
                THEN ' 10.0.' || (user_id // 256) || '.' || (user_id % 256) || ' , 172.16.0.1' END AS forwarded_for,
           CASE WHEN user_id % 10 <> 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS source_ip,
           ['public', 'registered', 'paid', 'private'][CAST(user_id % 4 AS INTEGER) + 1] AS tier
    FROM events
    """,
)

def _k():
    return F.regexp_extract("props", r"(\d+)", 1).cast("bigint")


def logs(t: Tables) -> DataFrame:
    """Events as log lines: responses, cache lines and free text of several kinds."""
    i = F.col("event_id")
    ms = F.floor(F.col("value") * 10).cast("bigint")
    user = F.col("user_id")
    k = _k()
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    response = s(
        "[RESPONSE] ", _pick(["200", "200", "404", "429"], k), " | ", k * 10, " | application/json | ", ms,
        " | 10.0.0.", user % 256, " | agent | - | - | res/", user % 7, " | q", k % 3, " | /p/", user % 11, " | v=", k % 4,
        " | key", user % 5,
    )
    cache = s("[CACHE] id", i, " | ep", user % 6, " | ", F.when(k % 2 == 0, "hit").otherwise("miss"), " | ", ms)
    texts = [
        s("cache: ", F.when(k % 2 == 0, "HIT").otherwise("miss"), " tool: t", user % 4, ", duration: ", ms),
        s("ERROR error: E", k % 4, ": tool: t", user % 4, ", parameter: p", k % 5, ", validation ",
          _pick(["missing required", "Invalid format", "out of range", "other"], k)),
        s("partial data bucket: b", user % 3, ", user/org: org", k % 3, ", access denied"),
        s("source failed TEMPLATE_NOT_FOUND exception bucket: b", user % 3, ", not found"),
        s("list_templates bucket: b", user % 3, ", namespace: n", k % 4, ", templates found: ", k),
        s("search_documentation query: q", user % 30, ", results: ", k, ", duration: ", ms),
        s("GitHub X-RateLimit-Remaining: ", k, ", X-RateLimit-Limit: 5000, user/org: org", user % 3, ", rate limit"),
        s("namespace warning bucket: b", user % 3, ", namespace: n", k % 4, ", invalid namespace"),
        s("sidecar missing sidecar starter: s", user % 9, ", bucket: b", user % 3),
        s("[WARN] slow ", ms),
        s("[COLDSTART] ", ms),
    ]
    free = texts[0]
    for n, text in enumerate(texts[1:], start=1):
        free = F.when(i % len(texts) == n, text).otherwise(free)
    message = F.when(i % 5 == 0, response).when(i % 5 == 1, cache).otherwise(free)
    return t.events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        s("stream", user % 3).alias("log_stream"),
        message.alias("message"),
        F.col("value").alias("duration"),
    )


cte(
    "logs",
    """
    SELECT event_id AS log_id, ts, 'stream' || (user_id % 3) AS log_stream, value AS duration,
      CASE WHEN event_id % 5 = 0 THEN '[RESPONSE] ' || ['200', '200', '404', '429'][CAST(k % 4 AS INTEGER) + 1] || ' | ' || (k * 10)
             || ' | application/json | ' || ms || ' | 10.0.0.' || (user_id % 256) || ' | agent | - | - | res/' || (user_id % 7)
             || ' | q' || (k % 3) || ' | /p/' || (user_id % 11) || ' | v=' || (k % 4) || ' | key' || (user_id % 5)
           WHEN event_id % 5 = 1 THEN '[CACHE] id' || event_id || ' | ep' || (user_id % 6) || ' | '
             || CASE WHEN k % 2 = 0 THEN 'hit' ELSE 'miss' END || ' | ' || ms
           ELSE CASE event_id % 11
             WHEN 0 THEN 'cache: ' || CASE WHEN k % 2 = 0 THEN 'HIT' ELSE 'miss' END || ' tool: t' || (user_id % 4) || ', duration: ' || ms
             WHEN 1 THEN 'ERROR error: E' || (k % 4) || ': tool: t' || (user_id % 4) || ', parameter: p' || (k % 5) || ', validation '
               || ['missing required', 'Invalid format', 'out of range', 'other'][CAST(k % 4 AS INTEGER) + 1]
             WHEN 2 THEN 'partial data bucket: b' || (user_id % 3) || ', user/org: org' || (k % 3) || ', access denied'
             WHEN 3 THEN 'source failed TEMPLATE_NOT_FOUND exception bucket: b' || (user_id % 3) || ', not found'
             WHEN 4 THEN 'list_templates bucket: b' || (user_id % 3) || ', namespace: n' || (k % 4) || ', templates found: ' || k
             WHEN 5 THEN 'search_documentation query: q' || (user_id % 30) || ', results: ' || k || ', duration: ' || ms
             WHEN 6 THEN 'GitHub X-RateLimit-Remaining: ' || k || ', X-RateLimit-Limit: 5000, user/org: org' || (user_id % 3) || ', rate limit'
             WHEN 7 THEN 'namespace warning bucket: b' || (user_id % 3) || ', namespace: n' || (k % 4) || ', invalid namespace'
             WHEN 8 THEN 'sidecar missing sidecar starter: s' || (user_id % 9) || ', bucket: b' || (user_id % 3)
             WHEN 9 THEN '[WARN] slow ' || ms
             ELSE '[COLDSTART] ' || ms END END AS message
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value * 10) AS BIGINT) AS ms FROM events)
    """,
)


def reports(t: Tables) -> DataFrame:
    """Events as invocation reports."""
    return t.events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 4 == 3, "START").otherwise("REPORT").alias("type"),
        (F.floor(F.col("value") * 100) * 1.0).alias("duration"),
        F.when(F.col("event_id") % 9 == 0, _k() * 10.0).alias("init_duration"),
        F.lit(1024 * 1024 * 1024).cast("bigint").alias("memory_size"),
        ((_k() + 100) * 1024 * 1024).alias("max_memory_used"),
    )


cte(
    "reports",
    """
    SELECT event_id AS log_id, ts, CASE WHEN event_id % 4 = 3 THEN 'START' ELSE 'REPORT' END AS type,
           floor(value * 100) * 1.0::DOUBLE AS duration,
           CASE WHEN event_id % 9 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10.0::DOUBLE END AS init_duration,
           CAST(1073741824 AS BIGINT) AS memory_size,
           (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 100) * 1024 * 1024 AS max_memory_used
    FROM events
    """,
)


def access_log(t: Tables) -> DataFrame:
    """Events as gateway access lines."""
    return t.events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 256).alias("ip"),
        F.concat(F.lit("/mcp/tool_"), F.col("user_id") % 5, F.lit("?x="), F.col("event_id")).alias("path"),
        _pick([200, 200, 404, 429, 500], _k()).alias("status"),
        (_k() * 100).alias("response_length"),
    )


cte(
    "access_log",
    """
    SELECT event_id AS request_id, ts, '10.0.0.' || (user_id % 256) AS ip,
           '/mcp/tool_' || (user_id % 5) || '?x=' || event_id AS path,
           [200, 200, 404, 429, 500][CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS INTEGER) + 1] AS status,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS response_length
    FROM events
    """,
)


def metrics(t: Tables) -> DataFrame:
    """Events as metric samples; the five event types stand for metric names."""
    return t.events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), F.col("value").alias("value")
    )


# --- site ---------------------------------------------------------------------------------------


def site_pages(t: Tables) -> DataFrame:
    """Pages whose links point to Markdown files and that hold settings tokens."""
    html = F.regexp_replace("html", r'href="(/[^"]*)"', r'href="$1.md"')
    html = F.regexp_replace(html, "</title>", "</title>{{{settings.footer}}}{{{settings.domain}}}{{{settings.footer}}}")
    html = F.regexp_replace(
        html, "<article>", "<body><article><a href='x/README.md#top'>https://abc123.execute-api.us-east-1.amazonaws.com/prod</a>"
    )
    return spread(t.pages).select(
        "page_id", F.concat(F.lit("docs/d"), F.col("page_id") % 7, F.lit("/p"), "page_id", F.lit(".html")).alias("path"),
        html.alias("html"),
    )


cte(
    "site_pages",
    r"""
    SELECT page_id, 'docs/d' || (page_id % 7) || '/p' || page_id || '.html' AS path,
           regexp_replace(regexp_replace(regexp_replace(html, 'href="(/[^"]*)"', 'href="\1.md"', 'g'),
             '</title>', '</title>{{{settings.footer}}}{{{settings.domain}}}{{{settings.footer}}}', 'g'),
             '<article>', '<body><article><a href=''x/README.md#top''>https://abc123.execute-api.us-east-1.amazonaws.com/prod</a>', 'g') AS html
    FROM pages
    """,
)
