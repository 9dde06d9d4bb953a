"""Files, sections, entries, postings and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import files as FI
from shelfmark.operators.postings import build_stats, build_totals, postings, stored_unique_entries, unique_entries
from shelfmark.operators.search import query_terms, ranked_search, search_scores, suggestions
from shelfmark.operators.sections import markdown_entries, markdown_sections
from workload import adapters as A
from workload.registry import cte, query


def _entries(t):
    return unique_entries(markdown_entries(A.files_md(t)))


def _index(t):
    """Entries and postings for the queries that need both; the entries are stored once."""
    entries = stored_unique_entries(markdown_entries(A.files_md(t)))
    return entries, postings(entries)


@query(
    "file_filter",
    r"""
    SELECT doc_id, path,
      NOT regexp_matches(path, '(^|/)(\.[^/]*|node_modules|tests|test|build|dist|coverage)/')
      AND list_contains(['md', 'js', 'jsx', 'py', 'yml', 'yaml'], ext)
      AND NOT list_contains(['LICENSE.md', 'CONTRIBUTING.md', 'CONTRIBUTE.md', 'CHANGELOG.md', 'AGENTS.md', 'SECURITY.md'], base)
      AND (NOT list_contains(['yml', 'yaml'], ext) OR regexp_matches(base, '(?i)^template.*\.(yml|yaml)$')) AS indexable
    FROM (SELECT *, lower(regexp_extract(base, '^.+\.([^.]*)$', 1)) AS ext
          FROM (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths))
    """,
)
def _(t):
    return A.paths(t).select("doc_id", "path", FI.is_indexable(F.col("path")).alias("indexable"))


@query(
    "file_routing",
    """
    SELECT doc_id, path, CASE WHEN ends_with(path, '.md') THEN 'markdown'
       WHEN ends_with(path, '.js') OR ends_with(path, '.jsx') THEN 'jsdoc'
       WHEN ends_with(path, '.py') THEN 'python'
       WHEN (ends_with(path, '.yml') OR ends_with(path, '.yaml'))
            AND starts_with(lower(regexp_extract(path, '([^/]*)$', 1)), 'template') THEN 'cfn' END AS kind
    FROM paths
    """,
)
def _(t):
    return A.paths(t).select("doc_id", "path", FI.extractor_kind(F.col("path")).alias("kind"))


@query(
    "markdown_sections",
    "SELECT file_ord, path, sec_ord, CAST(level AS INTEGER) AS level, heading, body FROM md_sections",
)
def _(t):
    return markdown_sections(A.files_md(t)).select("file_ord", "path", "sec_ord", "level", "heading", "body")


@query(
    "markdown_running_sections",
    "SELECT file_ord, CAST(pos - 1 AS INTEGER) AS pos, CAST(sec AS BIGINT) AS section FROM md_marked",
)
def _(t):
    """Section number of every line, counting headings from the top of the file."""
    from shelfmark.operators.readme import section_of_lines

    return section_of_lines(A.files_md(t).select("file_ord", "content"))


@query(
    "markdown_entries",
    """SELECT content_path, hash, title, excerpt, content, type, sub_type, file_ord, sec_ord,
              array_to_string(keywords, ' ') AS keywords FROM md_entries""",
)
def _(t):
    return markdown_entries(A.files_md(t)).select(
        "content_path", "hash", "title", "excerpt", "content", "type", "sub_type", "file_ord", "sec_ord",
        F.array_join("keywords", " ").alias("keywords"),
    )


@query("first_entry_per_hash", "SELECT hash, content_path, file_ord, sec_ord, title FROM md_unique")
def _(t):
    return _entries(t).select("hash", "content_path", "file_ord", "sec_ord", "title")


@query("keyword_postings", "SELECT * FROM md_postings")
def _(t):
    return postings(_entries(t))


@query("query_terms", "SELECT query_id, keyword, CAST(term_pos AS INTEGER) AS term_pos FROM search_terms")
def _(t):
    return query_terms(A.search_queries(t))


@query(
    "terms_join_postings",
    "SELECT query_id, keyword, CAST(term_pos AS INTEGER) AS term_pos, hash, relevance_score "
    "FROM search_terms JOIN md_postings USING (keyword)",
)
def _(t):
    return query_terms(A.search_queries(t)).join(
        postings(_entries(t)).select("keyword", "hash", "relevance_score"), "keyword"
    )


@query("search_scores", "SELECT * FROM search_scored")
def _(t):
    return search_scores(A.search_queries(t), postings(_entries(t)))


@query(
    "top_hits_with_metadata",
    """SELECT query_id, CAST(cand AS INTEGER) AS candidate, hash, total_score, title, content_path
       FROM search_candidates JOIN md_unique USING (hash)""",
)
def _(t):
    from shelfmark.operators.ranking import top_k

    entries, rows = _index(t)
    scores = search_scores(A.search_queries(t), rows)
    order = [F.col("total_score").desc(), F.col("first_pos"), F.col("hash")]
    top = top_k(scores, ["query_id"], order, 30, "candidate")
    return top.join(entries.select("hash", "title", "content_path"), "hash").select(
        "query_id", "candidate", "hash", "total_score", "title", "content_path"
    )


_RANKED = """
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, first_pos, hash) AS INTEGER) AS rank,
           title, excerpt, content_path AS file_path, type, sub_type, total_score AS relevance_score, repository,
           count(*) OVER (PARTITION BY query_id) AS total_results
    FROM {hits} JOIN md_unique USING (hash) {where} QUALIFY rank <= 10
"""
cte("search_ranked", _RANKED.format(hits="search_scored", where=""))


@query("ranked_search", "SELECT * FROM search_ranked")
def _(t):
    entries, rows = _index(t)
    return ranked_search(A.search_queries(t), rows, entries)


def _typed(t):
    """Every third query asks for a type no entry has, every third for one that all have."""
    q = F.col("query_id")
    return A.search_queries(t).withColumn(
        "type", F.when(q % 3 == 0, "code-example").when(q % 3 == 1, "documentation")
    )


@query(
    "ranked_search_by_type",
    _RANKED.format(hits="search_scored", where="WHERE query_id % 3 <> 0"),
)
def _(t):
    entries, rows = _index(t)
    return ranked_search(_typed(t), rows, entries)


@query(
    "ranked_search_cut_first",
    "SELECT query_id, rank, title, file_path, relevance_score, total_results FROM ("
    + _RANKED.format(hits="search_candidates", where="WHERE query_id % 3 <> 0")
    + ")",
)
def _(t):
    """As ``ranked_search_by_type``, with the optional cut at three times the limit ahead of the filters."""
    entries, rows = _index(t)
    found = ranked_search(_typed(t), rows, entries, candidate_factor=3)
    return found.select("query_id", "rank", "title", "file_path", "relevance_score", "total_results")


@query(
    "ranked_search_by_owner",
    """SELECT query_id, title, file_path, relevance_score FROM (""" + _RANKED.format(hits="search_scored", where="WHERE owner = 'org1'") + ")",
)
def _(t):
    entries, rows = _index(t)
    found = ranked_search(A.search_queries(t), rows, entries, owners=["org1"])
    return found.select("query_id", "title", "file_path", "relevance_score")


@query(
    "search_suggestions",
    """
    SELECT q.query_id, CASE WHEN trim(q.text) = '' THEN 'Please provide a search query'
        WHEN NOT EXISTS (SELECT 1 FROM search_terms s WHERE s.query_id = q.query_id) THEN 'Try using more specific keywords'
        WHEN NOT EXISTS (SELECT 1 FROM search_scored s WHERE s.query_id = q.query_id AND q.query_id % 3 <> 0)
        THEN 'Try using fewer or more general keywords|Try filtering by type: documentation, template-pattern, or code-example'
        ELSE '' END AS suggestions
    FROM search_queries q
    """,
)
def _(t):
    entries, rows = _index(t)
    queries = _typed(t)
    found = ranked_search(queries, rows, entries)
    return suggestions(queries, found).select("query_id", F.array_join("suggestions", "|").alias("suggestions"))


@query(
    "build_stats",
    "SELECT owner, repository, count(*) AS entry_count FROM md_entries GROUP BY owner, repository",
)
def _(t):
    return build_stats(markdown_entries(A.files_md(t)))


@query(
    "build_totals",
    "SELECT count(*) AS total_entries, count(DISTINCT (owner, repository)) AS total_repos FROM md_entries",
)
def _(t):
    return build_totals(markdown_entries(A.files_md(t)))


@query(
    "index_consistency",
    """
    SELECT 'bad_hash' AS check_name, count(*) AS violations FROM md_unique WHERE hash <> sha256(content_path)
    UNION ALL SELECT 'duplicate_hash', count(*) FROM (SELECT hash FROM md_unique GROUP BY hash HAVING count(*) > 1)
    UNION ALL SELECT 'excerpt_not_prefix', count(*) FROM md_unique WHERE NOT starts_with(content, excerpt) OR length(excerpt) > 200
    UNION ALL SELECT 'no_keywords', count(*) FROM md_unique WHERE len(keywords) = 0
    UNION ALL SELECT 'posting_without_entry', count(*) FROM md_postings WHERE hash NOT IN (SELECT hash FROM md_unique)
    """,
)
def _(t):
    from shelfmark.plans.index import consistency_checks

    return consistency_checks(*_index(t))
