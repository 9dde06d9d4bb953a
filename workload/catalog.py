"""Catalog listing, lookups, version resolution and starters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import versions as V
from shelfmark.operators import catalog as C
from shelfmark.operators import starters as S
from shelfmark.operators import versions as VE
from shelfmark.operators.ranking import last_wins
from shelfmark.session import work_dir
from shelfmark.sources.landing import land_sources
from workload import adapters as A
from workload.registry import cte, query

MODIFIED = F.unix_timestamp

cte(
    "parsed_objects",
    r"""
    SELECT *, split_part(key, '/', 1) AS namespace, split_part(key, '/', 4) AS category,
           regexp_replace(split_part(key, '/', 5), '\.(yml|yaml)$', '') AS name, regexp_extract(key, '\.([^.]*)$', 1) AS ext,
           's3://' || bucket || '/' || key AS s3_path,
           CASE bucket WHEN 'b2' THEN 0 WHEN 'b0' THEN 1 ELSE 2 END AS src_ord
    FROM objects WHERE ends_with(key, '.yml') OR ends_with(key, '.yaml')
    """,
)
cte(
    "catalog_first",
    """SELECT * FROM parsed_objects
       QUALIFY row_number() OVER (PARTITION BY category, name ORDER BY src_ord, namespace, key, row_id) = 1""",
)


@query("list_objects", "SELECT row_id, bucket, key, namespace, category, name, s3_path, size FROM parsed_objects")
def _(t):
    return C.parse_objects(A.objects(t)).select(
        "row_id", "bucket", "key", "namespace", "category", "name", "s3_path", "size"
    )


@query(
    "discover_namespaces",
    """SELECT bucket, namespace, CAST(row_number() OVER (PARTITION BY bucket ORDER BY namespace) AS INTEGER) AS ns_ord
       FROM (SELECT DISTINCT bucket, split_part(key, '/', 1) AS namespace FROM objects)""",
)
def _(t):
    return C.discover_namespaces(A.objects(t))


def _unique_listing(t):
    """One row per bucket and key, as in an object store; the generated keys may repeat."""
    return last_wins(A.objects(t), ["bucket", "key"], ["row_id"])


cte(
    "unique_objects",
    """SELECT * FROM parsed_objects
       QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY row_id DESC) = 1""",
)


def _catalog_sql(where: str = "", columns: str = "bucket, key, namespace, category, name, s3_path, size") -> str:
    return f"""SELECT {columns} FROM unique_objects {where}
       QUALIFY row_number() OVER (PARTITION BY category, name ORDER BY src_ord, namespace, key) = 1"""


_LISTED = ["bucket", "key", "namespace", "category", "name", "s3_path", "size"]


@query("catalog_first_wins", _catalog_sql())
def _(t):
    return C.list_catalog(_unique_listing(t), A.SOURCES).select(*_LISTED)


@query("catalog_by_category", _catalog_sql("WHERE category = 'economy'"))
def _(t):
    return C.list_catalog(_unique_listing(t), A.SOURCES, category="economy").select(*_LISTED)


@query("catalog_by_namespace", _catalog_sql("WHERE namespace = 'brand-7'"))
def _(t):
    return C.list_catalog(_unique_listing(t), A.SOURCES, namespace="brand-7").select(*_LISTED)


@query("catalog_allowed_sources", _catalog_sql("WHERE bucket IN ('b0')"))
def _(t):
    sources = C.allowed_sources(["other", "b0"], A.SOURCES)
    return C.list_catalog(_unique_listing(t), sources).select(*_LISTED)


@query(
    "template_listing_view",
    f"""SELECT name, 'unknown' AS version, category, namespace, bucket,
               category || ' template: ' || name AS description, s3_path, size
        FROM ({_catalog_sql()})""",
)
def _(t):
    return S.project_templates(C.list_catalog(_unique_listing(t), A.SOURCES))


_CATEGORY_ROWS = ["economy", "small", "medium", "absent"]


def _categories(t):
    """Three categories on offer and one nobody uses."""
    return t.part.select(F.explode(F.array(*[F.lit(c) for c in _CATEGORY_ROWS])).alias("name")).distinct().withColumn(
        "description", F.concat(F.lit("about "), "name")
    )


@query(
    "category_counts",
    f"""SELECT c.name, 'about ' || c.name AS description, count(o.name) AS template_count
        FROM (SELECT unnest({A.sql_list(_CATEGORY_ROWS)}) AS name) c
        LEFT JOIN ({_catalog_sql()}) o ON o.category = c.name GROUP BY c.name""",
)
def _(t):
    return C.category_counts(C.list_catalog(_unique_listing(t), A.SOURCES), _categories(t))


@query(
    "templates_per_category",
    f"SELECT category, count(*) AS templates FROM ({_catalog_sql()}) GROUP BY category",
)
def _(t):
    return C.list_catalog(_unique_listing(t), A.SOURCES).groupBy("category").agg(F.count(F.lit(1)).alias("templates"))


def _wanted_objects(t):
    """One want per customer; some name a namespace, some ask for what does not exist."""
    key = F.col("c_custkey")
    part = t.part.select(
        "p_partkey", F.lower("p_type").alias("category"), F.regexp_replace("p_name", " ", "-").alias("name")
    )
    wants = t.customer.select(
        key.alias("want_id"),
        (key % 200).alias("p_partkey"),
        F.when(key % 3 == 0, F.concat(F.lit("brand-"), key % 25 + 1)).alias("namespace"),
        (key % 13 == 0).alias("bogus"),
    )
    name = F.when(F.col("bogus"), F.concat(F.lit("no-"), "name")).otherwise(F.col("name"))
    return wants.join(part, "p_partkey").select("want_id", "category", name.alias("name"), "namespace")


cte(
    "wanted_objects",
    """
    SELECT c_custkey AS want_id, lower(p_type) AS category,
           CASE WHEN c_custkey % 13 = 0 THEN 'no-' ELSE '' END || replace(p_name, ' ', '-') AS name,
           CASE WHEN c_custkey % 3 = 0 THEN 'brand-' || (c_custkey % 25 + 1) END AS want_ns
    FROM customer JOIN part ON p_partkey = c_custkey % 200
    """,
)
cte(
    "resolved_objects",
    """
    SELECT w.want_id, w.category, w.name, w.want_ns, o.bucket, o.namespace AS found_namespace, o.key, o.size
    FROM wanted_objects w LEFT JOIN unique_objects o
      ON o.category = w.category AND o.name = w.name AND (w.want_ns IS NULL OR o.namespace = w.want_ns)
    QUALIFY row_number() OVER (PARTITION BY want_id ORDER BY src_ord, namespace, CASE ext WHEN 'yml' THEN 0 ELSE 1 END) = 1
    """,
)


@query(
    "point_lookup",
    "SELECT want_id, category, name, bucket, found_namespace, key, size FROM resolved_objects",
)
def _(t):
    return C.resolve_objects(_wanted_objects(t), _unique_listing(t), A.SOURCES).select(
        "want_id", "category", "name", "bucket", "found_namespace", "key", "size"
    )


@query(
    "not_found",
    """SELECT want_id, category, name, 'TEMPLATE_NOT_FOUND' AS code,
              'Template not found: ' || category || '/' || name AS message FROM resolved_objects WHERE key IS NULL""",
)
def _(t):
    return C.not_found(C.resolve_objects(_wanted_objects(t), _unique_listing(t), A.SOURCES))


@query(
    "available_names",
    """SELECT DISTINCT category, name AS available FROM unique_objects
       WHERE category IN (SELECT category FROM resolved_objects WHERE key IS NULL)""",
)
def _(t):
    listing = _unique_listing(t)
    missing = C.not_found(C.resolve_objects(_wanted_objects(t), listing, A.SOURCES))
    return C.available_names(missing, C.list_catalog(listing, A.SOURCES))


def _union(t):
    listing = A.objects(t)
    readers = {b: (lambda b=b: listing.where(F.col("bucket") == b)) for b in ("b0", "b1")}
    readers["b9"] = lambda: t.spark.read.parquet(t.path("no_such_table"))
    return C.union_sources(t.spark, readers)


@query(
    "union_sources",
    "SELECT bucket AS source, row_id, key, true AS partial_data FROM objects WHERE bucket IN ('b0', 'b1')",
)
def _(t):
    rows, _errors, partial = _union(t)
    return rows.select("source", "row_id", "key", F.lit(partial).alias("partial_data"))


@query(
    "source_errors",
    """SELECT bucket AS source, count(*) AS found, false AS failed FROM objects WHERE bucket IN ('b0', 'b1') GROUP BY bucket
       UNION ALL SELECT 'b1', NULL, true UNION ALL SELECT 'b9', NULL, true""",
)
def _(t):
    """Two landed sources, one of which has a damaged file among its files, and one that is not there."""
    root = work_dir(t.spark, "sources")
    listing = A.objects(t).select("bucket", "row_id", "key")
    for bucket in ("b0", "b1"):
        listing.where(F.col("bucket") == bucket).repartition(3).write.parquet(f"{root}/{bucket}")
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/b1/part-damaged.parquet")
    out = path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(b"PAR1 and then nothing that a reader knows")
    out.close()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listing.schema.fields)
    rows, errors, _partial = land_sources(t.spark, {b: f"{root}/{b}" for b in ("b0", "b1", "b9")}, schema)
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("found")).withColumn("failed", F.lit(False))
    failed = errors.select("source", F.lit(None).cast("bigint").alias("found"), F.lit(True).alias("failed"))
    return found.unionByName(failed)


@query(
    "catalog_union_then_first_wins",
    _catalog_sql("WHERE bucket IN ('b0', 'b1')", "bucket, key, category, name"),
)
def _(t):
    listing = _unique_listing(t)
    readers = {b: (lambda b=b: listing.where(F.col("bucket") == b)) for b in ("b0", "b1")}
    readers["b9"] = lambda: t.spark.read.parquet(t.path("no_such_table"))
    rows, _errors, _partial = C.union_sources(t.spark, readers)
    return C.list_catalog(rows, A.SOURCES).select("bucket", "key", "category", "name")


# --- histories ----------------------------------------------------------------------------------

cte(
    "history",
    """SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY modified_s DESC, version_id) AS position
       FROM object_versions""",
)


@query(
    "version_history_errors",
    """SELECT DISTINCT category, name || '-absent' AS name, 'TEMPLATE_NOT_FOUND' AS code, 'Template not found: ' || category || '/' || name || '-absent' AS message
       FROM object_versions""",
)
def _(t):
    """Every template asked for twice, once by a name that is not there."""
    versions = A.object_versions(t)
    absent = versions.select("category", F.concat("name", F.lit("-absent")).alias("name"))
    return VE.history_errors(versions.select("category", "name").unionByName(absent), versions)


@query(
    "version_history",
    """SELECT category, name, version_id, version, modified_s, size, CAST(position AS BIGINT) AS position,
              position = 1 AS is_latest FROM history""",
)
def _(t):
    return VE.version_history(A.object_versions(t)).select(
        "category", "name", "version_id", "version", MODIFIED("last_modified").alias("modified_s"), "size", "position",
        "is_latest",
    )


@query(
    "version_history_of_wanted",
    """SELECT category, name, version_id, CAST(position AS BIGINT) AS position FROM history
       WHERE (category, name) IN (SELECT (category, name) FROM installed)""",
)
def _(t):
    wanted = A.installed(t)
    return VE.version_history(A.object_versions(t), wanted).select("category", "name", "version_id", "position")


@query("current_version", "SELECT category, name, version_id, version, modified_s FROM history WHERE position = 1")
def _(t):
    return VE.current_versions(A.object_versions(t)).select(
        "category", "name", "version_id", "version", MODIFIED("last_modified").alias("modified_s")
    )


@query(
    "filter_version",
    "SELECT row_id, version FROM object_versions WHERE split_part(version, '/', 1) = 'v1.2.7'",
)
def _(t):
    wanted = F.lit("v1.2.7/2000-01-01")
    return A.object_versions(t).where(V.versions_match(F.col("version"), wanted)).select("row_id", "version")


@query("filter_version_id", "SELECT row_id, version FROM object_versions WHERE version_id = '77'")
def _(t):
    return A.object_versions(t).where(F.col("version_id") == "77").select("row_id", "version")


def _version_wants(t):
    key = F.col("row_id")
    pick = F.concat(F.lit("v"), key % 3, F.lit("."), key % 5, F.lit("."), key % 40)
    return A.installed(t).select(
        key.alias("want_id"),
        "category",
        "name",
        F.when(key % 4 < 2, pick).alias("version"),
        F.when(key % 4 > 0, (key * 7 % 2000).cast("string")).alias("version_id"),
    )


cte(
    "version_wants",
    """SELECT row_id AS want_id, category, name,
              CASE WHEN row_id % 4 < 2 THEN 'v' || (row_id % 3) || '.' || (row_id % 5) || '.' || (row_id % 40) END AS want_version,
              CASE WHEN row_id % 4 > 0 THEN CAST(row_id * 7 % 2000 AS VARCHAR) END AS want_id_text
       FROM installed""",
)


@query(
    "match_version_or_id",
    """
    SELECT w.want_id, w.category, w.name, h.version_id, h.version, h.modified_s
    FROM version_wants w LEFT JOIN history h ON h.category = w.category AND h.name = w.name AND
      CASE WHEN want_version IS NOT NULL AND want_id_text IS NOT NULL
           THEN coalesce(split_part(h.version, '/', 1) = want_version, false) OR h.version_id = want_id_text
           WHEN want_version IS NOT NULL THEN h.position = 1 AND split_part(h.version, '/', 1) = want_version
           WHEN want_id_text IS NOT NULL THEN h.version_id = want_id_text
           ELSE h.position = 1 END
    QUALIFY row_number() OVER (PARTITION BY want_id ORDER BY position) = 1
    """,
)
def _(t):
    return VE.match_versions(_version_wants(t), A.object_versions(t)).select(
        "want_id", "category", "name", "version_id", "version", MODIFIED("last_modified").alias("modified_s")
    )


cte(
    "short_resolved",
    """
    SELECT i.row_id, i.category, i.name, i.current_version, coalesce(h.version, i.current_version) AS resolved_version
    FROM installed i LEFT JOIN history h
      ON h.category = i.category AND h.name = i.name AND starts_with(h.version, i.current_version)
    WHERE regexp_matches(i.current_version, '^v[0-9]+\\.[0-9]+\\.[0-9]+$')
    QUALIFY row_number() OVER (PARTITION BY i.row_id ORDER BY h.position) = 1
    """.replace("\\\\", "\\"),
)
cte(
    "id_resolved",
    r"""
    SELECT i.row_id, i.category, i.name, i.current_version, h.version AS resolved_version,
           CASE WHEN h.version_id IS NULL THEN 'VERSION_RESOLUTION_FAILED' END AS error
    FROM installed i LEFT JOIN history h
      ON h.category = i.category AND h.name = i.name AND h.version_id = i.current_version
    WHERE NOT regexp_matches(i.current_version, '^v[0-9]+\.[0-9]+\.[0-9]+(/[0-9]{4}-[0-9]{2}-[0-9]{2})?$')
    """,
)
cte(
    "all_resolved",
    r"""
    SELECT row_id, category, name, current_version, resolved_version, CAST(NULL AS VARCHAR) AS error FROM short_resolved
    UNION ALL SELECT * FROM id_resolved
    UNION ALL SELECT row_id, category, name, current_version, current_version, NULL FROM installed
      WHERE regexp_matches(current_version, '^v[0-9]+\.[0-9]+\.[0-9]+/[0-9]{4}-[0-9]{2}-[0-9]{2}$')
    """,
)


def _complete(t):
    return A.installed(t).where(F.col("current_version").isNotNull())


@query("resolve_short_version", "SELECT * FROM short_resolved")
def _(t):
    short = _complete(t).where(V.version_format(F.col("current_version")) == V.SHORT_VERSION)
    return VE.resolve_short(short, A.object_versions(t))


@query("resolve_version_id", "SELECT * FROM id_resolved")
def _(t):
    ids = _complete(t).where(V.version_format(F.col("current_version")) == V.S3_VERSION_ID)
    return VE.resolve_id(ids, A.object_versions(t))


@query("resolve_any_version", "SELECT * FROM all_resolved")
def _(t):
    return VE.resolve_versions(_complete(t), A.object_versions(t)).drop("version_format")


@query(
    "check_updates",
    """
    SELECT row_id, category, name,
      CASE WHEN error = 'VERSION_RESOLUTION_FAILED' THEN current_version ELSE resolved_version END AS current_version,
      CASE WHEN err IS NULL THEN latest END AS latest_version,
      CASE WHEN err IS NULL THEN resolved_version IS DISTINCT FROM latest ELSE false END AS update_available,
      CASE WHEN err IS NULL THEN split_part(latest, '/', 2) END AS release_date,
      CASE WHEN err IS NULL THEN 'No changelog available' END AS changelog,
      CASE WHEN err IS NULL THEN m_new > m_old END AS breaking_changes,
      CASE WHEN err IS NULL AND m_new > m_old THEN 'docs/templates/v2/' || lower(category) || '/' || name
           || '-README.md#migration-from-v' || m_old || 'x-to-v' || m_new || 'x' END AS migration_guide,
      err AS error
    FROM (SELECT r.*, h.version AS latest, coalesce(r.error, CASE WHEN h.position IS NULL THEN 'TEMPLATE_NOT_FOUND' END) AS err,
                 coalesce(try_cast(regexp_extract(h.version, 'v([0-9]+)[.]', 1) AS INTEGER), 0) AS m_new,
                 coalesce(try_cast(regexp_extract(r.resolved_version, 'v([0-9]+)[.]', 1) AS INTEGER), 0) AS m_old
          FROM all_resolved r LEFT JOIN history h ON h.category = r.category AND h.name = r.name AND h.position = 1)
    UNION ALL
    SELECT row_id, category, name, current_version, NULL, NULL, NULL, NULL, NULL, NULL,
           'category, templateName, and currentVersion are required' FROM installed WHERE current_version IS NULL
    """,
)
def _(t):
    return VE.check_updates(A.installed(t), A.object_versions(t))


@query(
    "diff_versions",
    """
    WITH items AS (SELECT category, name, custkey_major, item, max(size) AS value FROM (
        SELECT category, name, substring(version, 2, 1) AS custkey_major, split_part(split_part(version, '/', 1), '.', 3) AS item, size
        FROM object_versions WHERE version IS NOT NULL) GROUP BY ALL)
    SELECT category, name, item, change, before, after FROM (
      SELECT coalesce(a.category, b.category) AS category, coalesce(a.name, b.name) AS name, coalesce(a.item, b.item) AS item,
             CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' END AS change,
             a.value AS before, b.value AS after
      FROM (SELECT * FROM items WHERE custkey_major = '0') a
      FULL JOIN (SELECT * FROM items WHERE custkey_major = '1') b ON a.category = b.category AND a.name = b.name AND a.item = b.item)
    WHERE change IS NOT NULL
    """.replace("WITH items AS (", "SELECT * FROM (WITH items AS (") + ")",
)
def _(t):
    semver = V.semver_part(F.col("version"))
    items = (
        A.object_versions(t)
        .where(F.col("version").isNotNull())
        .select("category", "name", F.substring("version", 2, 1).alias("side"), F.split(semver, r"\.")[2].alias("item"), "size")
        .groupBy("category", "name", "side", "item")
        .agg(F.max("size").alias("value"))
    )
    before, after = items.where("side = '0'"), items.where("side = '1'")
    return C.changed_items(before, after, ["category", "name"], "item", "value")


@query(
    "last_item_wins",
    """SELECT user_id AS pk, event_type AS sk, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
)
def _(t):
    items = t.events.select(F.col("user_id").alias("pk"), F.col("event_type").alias("sk"), "event_id", "value")
    return last_wins(items, ["pk", "sk"], ["event_id"])


# --- starters -----------------------------------------------------------------------------------


def _zip_key():
    key = F.col("s_suppkey")
    return F.concat(F.lit("n"), F.floor(key / 120).cast("bigint"), F.lit("/app-starters/v2/s"), key % 40)


def _starter_zips(t):
    return t.supplier.select(
        F.concat(F.lit("b"), F.col("s_suppkey") % 3).alias("bucket"),
        F.concat(_zip_key(), F.lit(".zip")).alias("key"),
        (F.col("s_suppkey") * 10).alias("size"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s_suppkey")).alias("last_modified"),
    )


def _sidecars(t):
    """Sidecars of even suppliers; every seventh supplier's sidecar is not JSON."""
    key = F.col("s_suppkey")
    good = F.concat(
        F.lit('{"name": "x", "displayName": "Starter '), key, F.lit('", "description": "'), F.col("n_name"),
        F.lit('", "languages": {"buildDeploy": ["Python"], "applicationStack": ["Node.js", "Python"]}, '
              '"features": {"applicationStack": ["caching", "cloudfront"], "postDeploy": "none"}, '
              '"dev_dependencies": ["jest"], "topics": "no list", '),
        F.when(key % 4 == 0, F.lit('"has_cache_data": true, ')).otherwise(F.lit('"hasCacheData": false, "has_cache_data": true, ')),
        F.lit('"license": "", "github_url": "r'), key, F.lit('", "repositoryType": "", "version": "1.'), key, F.lit('"}'),
    )
    nations = t.nation.select("n_nationkey", "n_name")
    return (
        t.supplier.where((key % 2 == 0) | (key % 7 == 0))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("b"), key % 3).alias("bucket"),
            F.concat(_zip_key(), F.lit(".json")).alias("key"),
            F.when(key % 7 == 0, F.lit("{broken")).otherwise(good).alias("content"),
            key.alias("row_id"),
        )
    )


def _unreadable(t):
    """Sidecars of every eleventh supplier exist but cannot be read."""
    return _sidecars(t).where(F.col("row_id") % 11 == 0).select("bucket", "key")


cte(
    "starters_all",
    """
    SELECT s_suppkey AS k, 'b' || (s_suppkey % 3) AS bucket, 'n' || (s_suppkey // 120) AS namespace, 's' || (s_suppkey % 40) AS name,
           'n' || (s_suppkey // 120) || '/app-starters/v2/s' || (s_suppkey % 40) || '.zip' AS key,
           (s_suppkey % 2 = 0 OR s_suppkey % 7 = 0) AS has_sidecar, (s_suppkey % 2 = 0 AND s_suppkey % 7 <> 0) AS good,
           CASE s_suppkey % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS src_ord, n_name
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
    """,
)
cte(
    "starter_fields",
    """
    SELECT *, CASE WHEN good THEN 'Starter ' || k ELSE '' END AS display_name, CASE WHEN good THEN n_name ELSE '' END AS description,
           CASE WHEN good THEN 'Python|Node.js' ELSE '' END AS languages, CASE WHEN good THEN 'caching|cloudfront' ELSE '' END AS features,
           CASE WHEN good THEN 'jest' ELSE '' END AS dev_dependencies, good AND k % 4 = 0 AS has_cache_data,
           CASE WHEN good THEN 'r' || k ELSE '' END AS repository, 'app-starter' AS repository_type,
           CASE WHEN good THEN '1.' || k ELSE '' END AS version,
           CASE WHEN has_sidecar THEN 'plat' ELSE '' END AS deployment_platform
    FROM starters_all
    """,
)
cte(
    "starters_first",
    """SELECT * FROM starter_fields WHERE NOT (has_sidecar AND k % 11 = 0)
       QUALIFY row_number() OVER (PARTITION BY name ORDER BY src_ord, namespace, key) = 1""",
)


def _flat(df):
    joined = {c: F.array_join(S.stage_values(F.col(c)), "|").alias(c) for c in ("languages", "features")}
    return df.select(
        *[joined.get(c, F.col(c)) for c in df.columns if c not in ("frameworks", "dev_dependencies")],
        F.array_join("dev_dependencies", "|").alias("dev_dependencies"),
    )


_SIDECAR_COLUMNS = (
    "display_name, description, languages, features, dev_dependencies, has_cache_data, repository, repository_type, version"
)


@query(
    "sidecar_metadata",
    f"SELECT bucket, replace(key, '.zip', '.json') AS key, {_SIDECAR_COLUMNS} FROM starter_fields WHERE has_sidecar",
)
def _(t):
    docs = _flat(S.read_sidecars(_sidecars(t).drop("row_id"), "plat"))
    return docs.select("bucket", "key", *_SIDECAR_COLUMNS.split(", "))


_STARTER_COLUMNS = "bucket, namespace, name, key, has_sidecar_metadata, deployment_platform, " + _SIDECAR_COLUMNS


@query(
    "starters_with_sidecars",
    f"SELECT {_STARTER_COLUMNS} FROM (SELECT *, has_sidecar AS has_sidecar_metadata FROM starters_first)",
)
def _(t):
    found = S.list_starters(_starter_zips(t), _sidecars(t), A.SOURCES, _unreadable(t), "plat")
    return _flat(found).select(*_STARTER_COLUMNS.split(", "))


@query(
    "starter_listing_view",
    """SELECT name, description, features, repository AS url, namespace, good AS has_cache_data, good AS has_cdn FROM starters_first""",
)
def _(t):
    found = S.list_starters(_starter_zips(t), _sidecars(t), A.SOURCES, _unreadable(t), "plat")
    return S.project_starters(found, "caching").withColumn("features", F.array_join("features", "|"))


@query(
    "starter_lookup",
    """SELECT c_custkey AS want_id, 's' || (c_custkey % 45) AS name, f.bucket, f.key
       FROM customer LEFT JOIN (SELECT * FROM starter_fields
         QUALIFY row_number() OVER (PARTITION BY name ORDER BY src_ord, namespace, key) = 1) f ON f.name = 's' || (c_custkey % 45)""",
)
def _(t):
    wanted = t.customer.select(F.col("c_custkey").alias("want_id"), F.concat(F.lit("s"), F.col("c_custkey") % 45).alias("name"))
    return S.resolve_starters(wanted, _starter_zips(t), _sidecars(t), A.SOURCES).select("want_id", "name", "bucket", "key")


@query(
    "flatten_stages",
    "SELECT k, languages, features FROM starter_fields WHERE has_sidecar",
)
def _(t):
    docs = S.read_sidecars(_sidecars(t))
    return docs.select(
        F.col("row_id").alias("k"),
        F.array_join(S.stage_values(F.col("languages")), "|").alias("languages"),
        F.array_join(S.stage_values(F.col("features")), "|").alias("features"),
    )


@query(
    "compare_starters",
    """SELECT k, '' AS only_left, CASE WHEN good THEN 'Node.js' ELSE '' END AS only_right,
              CASE WHEN good THEN 'Python' ELSE '' END AS in_both FROM starter_fields WHERE has_sidecar""",
)
def _(t):
    docs = S.read_sidecars(_sidecars(t))
    build = F.col("languages.buildDeploy")
    diff = C.compare_arrays(build, S.stage_values(F.col("languages")))
    return docs.select(F.col("row_id").alias("k"), diff.alias("d")).select(
        "k",
        F.array_join("d.only_left", "|").alias("only_left"),
        F.array_join("d.only_right", "|").alias("only_right"),
        F.array_join("d.both", "|").alias("in_both"),
    )


@query(
    "write_sidecar_documents",
    """SELECT k, '{"name":"s' || (k % 40) || '","displayName":"' || CASE WHEN good THEN 'Starter ' || k ELSE '' END || '","topics":[]}' AS document
       FROM starter_fields WHERE has_sidecar""",
)
def _(t):
    from shelfmark.sources.sidecars import sidecar_documents

    docs = S.read_sidecars(_sidecars(t))
    named = docs.select(
        F.col("row_id").alias("k"),
        F.regexp_extract("key", r"([^/]*)\.json\z", 1).alias("name"),
        F.col("display_name").alias("displayName"),
        "topics",
    )
    return sidecar_documents(named, ["k"])
