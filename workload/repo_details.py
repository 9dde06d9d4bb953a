"""Repositories: landed API documents, manifests, READMEs and their metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import packages as P
from shelfmark.operators import readme as R
from shelfmark.operators.starters import stage_values
from shelfmark.plans.repo_metadata import repo_metadata
from shelfmark.sources import repos as RS
from workload import adapters as A
from workload.registry import cte, query


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_K = "c_custkey"

_README = (
    "Intro\n# Title ", "\nshort\nThis is the long description ", ".\n## Features\n- One ",
    "\n* Two\n## Prerequisites\n- Docker\n- pip\n\n",
)
_TABLE = (
    "| | Build/Deploy | Application Stack | Post-Deploy |\n|---|---|---|---|\n| **Languages** | Python | Node.js, Bash | - |\n"
    "| __Frameworks__ | SAM | Express |\n| Other | a | b | c |\nend\n| x | y |\n"
)


def repo_files(t):
    """Files of one repository per customer; which files there are depends on the key."""
    k = F.col(_K)
    package = _say(
        '{"name": "pkg', k, '", "description": "', F.when(k % 4 == 0, "").otherwise("about"), '", "version": "1.', k,
        '.0", "author": "ann", "license": "MIT", "dependencies": {"express": "^4", "@x/cache": "1", "dep', k % 5,
        '": "2"}, "devDependencies": {"jest": "29"}}',
    )
    readme = _say(_README[0], k, _README[1], k, _README[2], k, _README[3], F.when(k % 3 == 1, _TABLE).otherwise(""))
    nested = P.NESTED_SOURCES
    candidates = [
        (k % 2 == 0, "package.json", package),
        (k % 3 == 0, f"{nested}/package.json", F.lit('{"name": "inner", "dependencies": {"koa": "1", "express": "4"}}')),
        (k % 5 == 0, f"{nested}/a/b/package.json", F.lit("{")),
        (k % 4 == 1, "requirements.txt", F.lit("# c\nflask==2.0\n requests>=2\n\nboto3\n")),
        (F.lit(True), "README.md", readme),
        (F.lit(True), "readme.md", F.lit("# Other")),
        (k % 6 == 0, "template.yml", F.lit("a: 1")),
        (k % 7 == 0, ".github/workflows/x.yml", F.lit("a: 1")),
        (k % 5 == 1, "tests/a.js", F.lit("")),
        (k % 8 == 0, "src/lambda/x.js", F.lit("")),
    ]
    files = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(p).alias("path"), text.alias("content"))) for c, p, text in candidates])
    )
    return t.customer.select(_say("org", k % 4).alias("owner"), _say("repo", k).alias("repo"), F.inline(files))


cte("repo_keys", "SELECT c_custkey AS k, 'org' || (c_custkey % 4) AS owner, 'repo' || c_custkey AS repo FROM customer")
cte(
    "repo_packages",
    """SELECT *, CASE WHEN k % 2 = 0 THEN 'pkg' || k ELSE 'inner' END AS name, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 'about' ELSE '' END AS description,
              CASE WHEN k % 2 = 0 THEN '1.' || k || '.0' ELSE '' END AS version, CASE WHEN k % 2 = 0 THEN 'MIT' ELSE '' END AS license,
              CASE WHEN k % 2 = 0 THEN 'express|@x/cache|dep' || (k % 5) || CASE WHEN k % 3 = 0 THEN '|koa' ELSE '' END ELSE 'koa|express' END AS dependencies,
              CASE WHEN k % 2 = 0 THEN 'jest' ELSE '' END AS dev_dependencies, k % 2 = 0 AS has_cache_data
       FROM repo_keys WHERE k % 2 = 0 OR k % 3 = 0""",
)


@query("package_metadata", "SELECT owner, repo, name, description, version, license, dependencies, dev_dependencies, has_cache_data FROM repo_packages")
def _(t):
    return P.package_metadata(repo_files(t), "@x/cache").select(
        "owner", "repo", "name", "description", "version", "license", F.array_join("dependencies", "|").alias("dependencies"),
        F.array_join("dev_dependencies", "|").alias("dev_dependencies"), "has_cache_data",
    )


@query("requirements", "SELECT owner, repo, 'flask|requests|boto3' AS requirements FROM repo_keys WHERE k % 4 = 1")
def _(t):
    return P.requirements(repo_files(t)).select("owner", "repo", F.array_join("requirements", "|").alias("requirements"))


@query(
    "readme_stack_table",
    """SELECT owner, repo, k % 3 = 1 AS has_table, false AS has_features_row, CASE WHEN k % 3 = 1 THEN 'Python|Node.js|Bash' ELSE '' END AS languages,
              CASE WHEN k % 3 = 1 THEN 'SAM|Express' ELSE '' END AS frameworks, '' AS features FROM repo_keys""",
)
def _(t):
    table = R.stack_table(P.root_readmes(repo_files(t)))
    joined = [F.array_join(stage_values(F.col(c)), "|").alias(c) for c in ("languages", "frameworks", "features")]
    return table.select("owner", "repo", "has_table", "has_features_row", *joined)


@query(
    "readme_title_description",
    "SELECT owner, repo, 'Title ' || k AS title, 'This is the long description ' || k || '.' AS description FROM repo_keys",
)
def _(t):
    c = F.col("content")
    return P.root_readmes(repo_files(t)).select(
        "owner", "repo", R.readme_title(c).alias("title"), R.readme_description(c).alias("description")
    )


@query("readme_bullets", "SELECT owner, repo, 'One ' || k || '|Two' AS features, 'Docker|pip' AS prerequisites FROM repo_keys")
def _(t):
    c = F.col("content")
    return P.root_readmes(repo_files(t)).select(
        "owner", "repo", F.array_join(R.readme_bullets(c, "Features"), "|").alias("features"),
        F.array_join(R.readme_bullets(c, "Prerequisites"), "|").alias("prerequisites"),
    )


@query(
    "first_long_lines",
    r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')),
               lambda l: NOT starts_with(l, '#') AND length(l) > 20)[1], '') AS description FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", R.readme_description(F.col("text")).alias("description"))


@query(
    "detect_frameworks",
    """SELECT owner, repo, concat_ws('|', CASE WHEN k % 2 = 0 THEN 'Express' END, CASE WHEN k % 4 = 1 THEN 'Flask' END) AS frameworks
       FROM repo_keys WHERE k % 2 = 0 OR k % 4 = 1""",
)
def _(t):
    files = repo_files(t)
    both = P.root_dependencies(files).join(P.requirements(files), P.REPO, "full")
    found = P.frameworks(
        F.coalesce("root_dependencies", F.array().cast("array<string>")), F.coalesce("requirements_text", F.lit(""))
    )
    return both.select("owner", "repo", F.array_join(found, "|").alias("frameworks"))


cte(
    "repo_features",
    """SELECT *, concat_ws('|', CASE WHEN k % 2 = 0 THEN 'caching' END, CASE WHEN k % 6 = 0 THEN 'CloudFormation template' END,
              CASE WHEN k % 7 = 0 THEN 'GitHub Actions' END, CASE WHEN k % 5 = 1 THEN 'Unit tests' END, CASE WHEN k % 8 = 0 THEN 'AWS Lambda' END) AS features,
              concat_ws('|', CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'Node.js 18.x or later|npm or yarn' END,
                CASE WHEN k % 4 = 1 THEN 'Python 3.9 or later|pip' END, CASE WHEN k % 6 = 0 THEN 'AWS CLI configured|AWS SAM CLI' END) AS inferred,
              concat_ws('|', CASE WHEN k % 2 = 0 OR k % 3 = 0 THEN 'Node.js' END, CASE WHEN k % 4 = 1 THEN 'Python' END) AS langs
       FROM repo_keys""",
)


@query("detect_features", "SELECT owner, repo, features FROM repo_features")
def _(t):
    files = repo_files(t)
    df = P.path_features(files).join(P.root_dependencies(files), P.REPO, "left")
    has = F.array_contains(F.coalesce("root_dependencies", F.array().cast("array<string>")), "@x/cache")
    return df.select("owner", "repo", F.array_join(P.features(has, "caching"), "|").alias("features"))


@query("infer_prerequisites", "SELECT owner, repo, inferred AS prerequisites FROM repo_features")
def _(t):
    files = repo_files(t)
    df = (
        P.path_features(files)
        .join(P.manifests(files).select(*P.REPO).distinct().withColumn("node", F.lit("Node.js")), P.REPO, "left")
        .join(P.requirements(files).select(*P.REPO).withColumn("python", F.lit("Python")), P.REPO, "left")
    )
    languages = F.array_compact(F.array("node", "python"))
    found = P.inferred_prerequisites(languages, F.col("has_template_yml"))
    return df.select("owner", "repo", F.array_join(found, "|").alias("prerequisites"))


# --- landed API documents -----------------------------------------------------------------------


def api_documents(t):
    """One landed repository document per customer, listed by organisation for even and by user for odd keys."""
    k = F.col(_K)
    document = _say(
        '{"id": ', k, ', "name": "', F.when(k % 6 == 0, "SHARED").otherwise(_say("repo", k)), '", "default_branch": ',
        F.when(k % 3 == 0, "null").otherwise('"dev"'), ', "stargazers_count": ', k * 3, ', "language": "Python", "size": ', k,
        ', "updated_at": "2024-01-02T00:00:00Z", "extra": [1]}',
    )
    return t.customer.select(
        k.alias("k"), _say("org", k % 4).alias("owner"), (k % 4).cast("int").alias("src_ord"), (k % 4 != 3).alias("by_org"), document.alias("document")
    )


cte(
    "api_repos",
    """SELECT k, owner, CAST(k % 4 AS INTEGER) AS src_ord, CASE WHEN k % 6 = 0 THEN 'SHARED' ELSE 'repo' || k END AS name,
              CASE WHEN k % 3 = 0 THEN 'main' ELSE 'dev' END AS default_branch, k * 3 AS stars FROM repo_keys""",
)


def api_repos(t):
    rows = RS.parse_documents(api_documents(t), RS.REPO_SCHEMA)
    return RS.list_repos(rows.where("by_org").drop("by_org"), rows.where("k % 4 = 3 OR k % 8 = 0").drop("by_org"))


@query("list_repos", "SELECT k, owner, name, default_branch, stars FROM api_repos")
def _(t):
    """Owners org0 to org2 answer as organisations, so what users of the same name list is ignored; org3 is a user."""
    return api_repos(t).select("k", "owner", "name", "default_branch", F.col("stargazers_count").alias("stars"))


@query(
    "first_repo_per_name",
    """SELECT k, owner, name FROM api_repos QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY src_ord, k) = 1""",
)
def _(t):
    from shelfmark.operators.ranking import first_wins

    # The generated owners repeat a name, so the key decides among them first.
    single = first_wins(api_repos(t), ["owner", F.lower("name")], ["k"])
    return RS.first_repo_per_name(single).select("k", "owner", "name")


def releases(t):
    """Orders as releases of the customers' repositories; some are drafts or prereleases."""
    key = F.col("o_orderkey")
    login = F.struct(_say("u", key % 9).alias("login"), F.lit(None).cast("string").alias("avatar_url"), F.lit(None).cast("string").alias("html_url"))
    return t.orders.select(
        _say("org", F.col("o_custkey") % 4).alias("owner"),
        _say("repo", F.col("o_custkey")).alias("repo"),
        key.alias("id"),
        _say("v", key).alias("tag_name"),
        _say("Release ", key).alias("name"),
        F.lit("notes").alias("body"),
        (key % 5 == 0).alias("draft"),
        (key % 7 == 0).alias("prerelease"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.lit("url").alias("html_url"),
        _say("zip/", key).alias("zipball_url"),
        login.alias("author"),
    )


cte(
    "latest_releases",
    """SELECT 'repo' || o_custkey AS repo, o_orderkey AS id, 'v' || o_orderkey AS tag_name, o_orderdate FROM orders
       WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)


@query(
    "select_archives",
    r"""SELECT TRY_CAST(regexp_extract(a.name, '(\d+)', 1) AS BIGINT) AS k, a.owner, a.name, r.tag_name, coalesce('zip/' || r.id, 'https://api.github.com/repos/' || a.owner || '/' || a.name || '/zipball/' || a.default_branch) AS archive_url
       FROM api_repos a LEFT JOIN latest_releases r ON r.repo = a.name""",
)
def _(t):
    repos = api_repos(t)
    found = RS.select_archives(repos, releases(t))
    key = F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint")
    return found.select(key.alias("k"), "owner", "name", "tag_name", "archive_url")


def _properties(t):
    k = F.col(_K)
    kind = F.element_at(F.array(*[F.lit(x) for x in RS.REPOSITORY_TYPES]), (k % 6 + 1).cast("int"))
    return t.customer.where(k % 5 != 0).select(
        _say("org", k % 4).alias("owner"), _say("repo", k).alias("repo"), F.when(k % 11 == 0, "other").otherwise("kind").alias("property_name"),
        kind.alias("value"),
    )


_TYPE_SQL = f"""SELECT k, owner, name, {A.sql_list(RS.REPOSITORY_TYPES)}[CAST(k % 6 AS INTEGER) + 1] AS repository_type
    FROM api_repos WHERE k % 5 <> 0 AND k % 11 <> 0 AND k % 6 <> 0"""


@query("repos_with_type", _TYPE_SQL)
def _(t):
    return RS.typed_repos(api_repos(t), _properties(t), "kind").select("k", "owner", "name", "repository_type")


@query("repos_of_type", f"SELECT * FROM ({_TYPE_SQL}) WHERE repository_type = 'templates'")
def _(t):
    return RS.typed_repos(api_repos(t), _properties(t), "kind", "templates").select("k", "owner", "name", "repository_type")


@query(
    "repo_details",
    r"""SELECT TRY_CAST(regexp_extract(a.name, '(\d+)', 1) AS BIGINT) AS k, a.name, a.stars, CASE WHEN a.k % 4 = 1 THEN 'Read me ' || a.k END AS readme, r.tag_name, 'u' || (r.id % 9) AS author
       FROM api_repos a LEFT JOIN (SELECT 'repo' || o_custkey AS repo, o_orderkey AS id, 'v' || o_orderkey AS tag_name FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) r ON r.repo = a.name""",
)
def _(t):
    k = F.col(_K)
    encoded = F.base64(F.encode(_say("Read me ", k), "UTF-8"))
    readmes = t.customer.where(k % 4 == 1).select(
        _say("org", k % 4).alias("owner"), _say("repo", k).alias("repo"), F.lit("README.md").alias("path"), encoded.alias("content")
    )
    details = RS.repo_details(api_repos(t), readmes, releases(t))
    return details.select(
        F.regexp_extract("name", r"(\d+)", 1).try_cast("bigint").alias("k"), "name", "stars", "readme",
        F.col("release.tag_name").alias("tag_name"), F.col("release.author").alias("author"),
    )


@query(
    "release_list",
    "SELECT o_orderkey AS id, 'v' || o_orderkey AS tag_name, o_orderkey % 5 = 0 AS draft, 'u' || (o_orderkey % 9) AS author_login FROM orders",
)
def _(t):
    return RS.release_list(releases(t)).select("id", "tag_name", "draft", "author_login")


@query(
    "repo_metadata",
    """SELECT f.owner, f.repo, coalesce(p.name, 'api' || f.k) AS name, 'Title ' || f.k AS display_name,
              CASE WHEN coalesce(p.description, '') <> '' THEN p.description ELSE 'This is the long description ' || f.k || '.' END AS description,
              CASE WHEN f.k % 3 = 1 THEN 'Python|Node.js|Bash' ELSE langs END AS languages, f.features, 't1|t2' AS topics,
              array_to_string(list_filter(string_split(CASE WHEN inferred = '' THEN 'Docker|pip' WHEN f.k % 4 = 1 THEN inferred || '|Docker' ELSE inferred || '|Docker|pip' END, '|'), lambda x: true), '|') AS prerequisites,
              CASE WHEN coalesce(p.license, '') = '' THEN 'BSD' ELSE p.license END AS license, 'plat' AS deployment_platform,
              coalesce(nullif(CASE WHEN r.id IS NOT NULL THEN r.tag_name || ' (' || strftime(r.o_orderdate, '%Y-%m-%d') || ')' END, ''), nullif(p.version, ''), '') AS version
       FROM repo_features f LEFT JOIN repo_packages p ON p.k = f.k LEFT JOIN latest_releases r ON r.repo = f.repo""",
)
def _(t):
    k = F.col(_K)
    owner, repo = _say("org", k % 4).alias("owner"), _say("repo", k).alias("repo")
    topics = F.array(F.lit("t1"), F.lit("t2"), F.lit("t1"))
    api = t.customer.select(
        owner, repo, _say("api", k).alias("name"), F.lit("").alias("description"), F.lit("bob").alias("author"), F.lit("BSD").alias("license"),
        topics.alias("topics"), F.lit("2024").alias("updated_at"),
    )
    types = t.customer.select(owner, repo, F.lit("package").alias("repository_type"))
    published = releases(t).where(~F.col("draft") & ~F.col("prerelease"))
    latest = published.withColumn("tag_name", F.col("tag_name"))
    from shelfmark.operators.ranking import first_wins

    newest = first_wins(latest, ["owner", "repo"], [F.col("published_at").desc(), F.col("id").desc()])
    found = repo_metadata(repo_files(t), api, newest, types, "@x/cache", "caching", "plat")
    join = lambda c: F.array_join(c, "|")
    return found.select(
        "owner", "repo", "name", "display_name", "description", join(stage_values(F.col("languages"))).alias("languages"),
        join(stage_values(F.col("features"))).alias("features"), join("topics").alias("topics"), join("prerequisites").alias("prerequisites"),
        "license", "deployment_platform", "version",
    )
