"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions import versions as V
from workload import adapters as A
from workload.registry import query


def _docs(t, *columns):
    return t.documents.select("doc_id", *columns)


@query("slugify", f"SELECT doc_id, {A.sql_slug('text')} AS slug FROM documents")
def _(t):
    return _docs(t, T.slugify(F.col("text")).alias("slug"))


@query("keywords", f"SELECT doc_id, array_to_string({A.sql_keywords('text')}, ' ') AS keywords FROM documents")
def _(t):
    return _docs(t, F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(
    "python_keywords",
    f"""SELECT doc_id, array_to_string({A.sql_keywords("replace(text, ' e', '_e')", stop=A.PYTHON_STOP, keep="a-z0-9_", sep="_")}, ' ') AS keywords
        FROM documents""",
)
def _(t):
    joined = F.replace("text", F.lit(" e"), F.lit("_e"))
    return _docs(t, F.array_join(T.python_keywords(joined), " ").alias("keywords"))


@query("query_keywords", f"SELECT doc_id, array_to_string({A.sql_keywords('text', 3, A.QUERY_STOP)}, ' ') AS keywords FROM documents")
def _(t):
    return _docs(t, F.array_join(T.query_keywords(F.col("text")), " ").alias("keywords"))


@query("content_hash", "SELECT doc_id, substring(sha256(lang || '/' || source || '/' || text), 1, 16) AS hash FROM documents")
def _(t):
    return _docs(t, T.content_hash(F.concat_ws("/", "lang", "source", "text")).alias("hash"))


@query("excerpt", "SELECT doc_id, substring(text, 1, 200) AS excerpt FROM documents")
def _(t):
    return _docs(t, T.excerpt(F.col("text")).alias("excerpt"))


@query(
    "relevance",
    """SELECT item_id, turn, conv_id, CAST(floor((CASE WHEN contains(lower(c.text), w) THEN 10 ELSE 0 END + CASE WHEN contains(lower(role), w) THEN 5 ELSE 0 END
              + CASE WHEN list_contains(string_split(lower(c.text), ' '), w) THEN 3 ELSE 0 END) * weight + 0.5) AS INTEGER) AS score
       FROM (SELECT *, ['user', 'the', 'of'][CAST(conv_id % 3 AS INTEGER) + 1] AS w, conv_id % 3 AS item_id,
                    CASE turn % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS weight FROM conversations) c""",
)
def _(t):
    c = t.conversations.withColumns(
        {
            "item_id": F.col("conv_id") % 3,
            "w": F.element_at(F.array(F.lit("user"), F.lit("the"), F.lit("of")), (F.col("conv_id") % 3 + 1).cast("int")),
            "type": F.element_at(
                F.array(F.lit("documentation"), F.lit("template-pattern"), F.lit("other")), (F.col("turn") % 3 + 1).cast("int")
            ),
        }
    )
    has = F.array_contains(F.split(F.lower("text"), " "), F.col("w"))
    score = T.relevance(F.col("w"), F.col("text"), F.col("role"), has, T.type_weight(F.col("type")))
    return c.select("item_id", "turn", "conv_id", score.alias("score"))


@query(
    "csv_list",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')),
              lambda p: p <> ''), '|') AS parts FROM documents""",
)
def _(t):
    return _docs(t, F.array_join(T.csv_list(F.col("text")), "|").alias("parts"))


@query("index_version", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS version FROM events")
def _(t):
    return t.events.select("event_id", V.index_version(F.col("ts")).alias("version"))


@query(
    "human_version",
    """SELECT row_id, CASE WHEN row_id % 3 <> 1 THEN version END AS parsed FROM object_versions""",
)
def _(t):
    """Versions back out of template headers, of which every third is malformed."""
    mark = F.when(F.col("row_id") % 3 == 0, "#Version:  ").when(F.col("row_id") % 3 == 1, "# version: ").otherwise("#  Version: ")
    content = F.concat(F.lit("a: 1\n"), mark, F.coalesce("version", F.lit("none")), F.lit("\nb: 2"))
    return A.object_versions(t).select("row_id", V.human_version(content).alias("parsed"))


@query(
    "version_format",
    r"""SELECT row_id, CASE WHEN regexp_matches(v, '^v\d+\.\d+\.\d+/\d{4}-\d{2}-\d{2}$') THEN 'HUMAN_READABLE_VERSION'
              WHEN regexp_matches(v, '^v\d+\.\d+\.\d+$') THEN 'SHORT_VERSION' ELSE 'S3_VERSION_ID' END AS format
        FROM (SELECT row_id, coalesce(current_version, '') AS v FROM installed)""",
)
def _(t):
    return A.installed(t).select("row_id", V.version_format(F.coalesce("current_version", F.lit(""))).alias("format"))


@query(
    "version_parts",
    """SELECT row_id, split_part(version, '/', 1) AS version, CASE WHEN version IS NOT NULL THEN split_part(version, '/', 2) END AS date,
              coalesce(TRY_CAST(string_split(substring(split_part(version, '/', 1), 2), '.')[1] AS INTEGER), 0) AS major,
              coalesce(TRY_CAST(string_split(split_part(version, '/', 1), '.')[2] AS INTEGER), 0) AS minor,
              coalesce(TRY_CAST(string_split(split_part(version, '/', 1), '.')[3] AS INTEGER), 0) AS patch
       FROM object_versions""",
)
def _(t):
    parts = V.version_parts(F.col("version"))
    return A.object_versions(t).select("row_id", parts.alias("p")).select("row_id", "p.*")


@query(
    "object_key_parts",
    """SELECT row_id, split_part(key, '/', 4) AS category, regexp_replace(split_part(key, '/', 5), '[.](yml|yaml)$', '') AS name,
              's3://' || bucket || '/' || key AS uri FROM objects""",
)
def _(t):
    key = F.col("key")
    return A.objects(t).select(
        "row_id", V.key_category(key).alias("category"), V.key_name(key).alias("name"), V.object_uri(F.col("bucket"), key).alias("uri")
    )


@query("build_key", "SELECT p_partkey, p_brand || '/templates/v2/' || p_type || '/' || p_name || '.yml' AS key FROM part")
def _(t):
    key = V.build_key(F.col("p_brand"), "templates/v2", F.col("p_type"), F.col("p_name"), F.lit(".yml"))
    return t.part.select("p_partkey", key.alias("key"))


@query("byte_size", "SELECT doc_id, CAST(strlen(text) AS INTEGER) AS bytes, strlen(text) > 5000 AS exceeds FROM documents")
def _(t):
    return _docs(t, T.byte_size(F.col("text")).alias("bytes"), T.exceeds(F.col("text"), 5000).alias("exceeds"))


@query(
    "directory_titles",
    "SELECT p_partkey, upper(substring(n, 1, 1)) || substring(n, 2) AS title FROM (SELECT p_partkey, replace(replace(p_name, ' ', '-'), '-', ' ') AS n FROM part)",
)
def _(t):
    from shelfmark.functions.site import directory_title

    return t.part.select("p_partkey", directory_title(F.regexp_replace("p_name", " ", "-")).alias("title"))


@query("camel_split", "SELECT doc_id, regexp_replace(text, '([A-Z])', ' \\1', 'g') AS spaced FROM documents")
def _(t):
    return _docs(t, T.camel_split(F.col("text")).alias("spaced"))


_ERROR_KINDS = ["CLIENT_ERROR", "VALIDATION_ERROR", "NOT_FOUND", "RATE_LIMIT", "SERVER_ERROR", "CACHE_ERROR", "EXTERNAL_SERVICE", "X"]


@query(
    "status_of_category",
    f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 400 WHEN 1 THEN 400 WHEN 2 THEN 404 WHEN 3 THEN 429 ELSE 500 END AS status FROM events""",
)
def _(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in _ERROR_KINDS]), (F.col("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", V.status_of(kind).alias("status"))


@query("decode_base64", "SELECT doc_id, text AS decoded FROM documents")
def _(t):
    """Texts encoded in lines of 76 characters and decoded again."""
    encoded = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\r", "")
    return _docs(t, T.decode_base64(encoded).alias("decoded"))


@query(
    "placeholders",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'STAGE_ID|MISSING' ELSE 'STAGE_ID|_X9' END AS names FROM documents""",
)
def _(t):
    return _docs(t, F.array_join(T.placeholders(_with_placeholders()), "|").alias("names"))


def _with_placeholders():
    tail = F.when(F.col("doc_id") % 4 == 0, "$MISSING$").otherwise("$_X9$")
    clean = F.regexp_replace("text", r"\$", "S")
    return F.concat(F.lit("$STAGE_ID$ "), clean, F.lit(" $STAGE_ID$ "), tail, F.lit(" $lower$"))


@query(
    "fill_placeholders",
    """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'prod ' || replace(text, '$', 'S') || ' prod nine $lower$' END AS filled,
              CASE WHEN doc_id % 4 = 0 THEN 'MISSING' ELSE '' END AS missing FROM documents""",
)
def _(t):
    from shelfmark.operators.site import fill_placeholders

    docs = _docs(t, _with_placeholders().alias("text"))
    filled = fill_placeholders(docs, "text", {"STAGE_ID": "prod", "_X9": "nine"})
    return filled.select("doc_id", "filled", F.array_join("missing", "|").alias("missing"))


@query(
    "release_version",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN ''
              ELSE 'v' || o_custkey || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' END AS version FROM orders""",
)
def _(t):
    key = F.col("o_orderkey")
    tag = F.when(key % 5 != 0, F.concat(F.lit("v"), "o_custkey"))
    published = F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("")
    return t.orders.select("o_orderkey", T.release_version(tag, published).alias("version"))


@query(
    "keyword_union",
    f"""SELECT doc_id, array_to_string({A.sql_ordered_distinct('u')}, ' ') AS keywords
        FROM (SELECT doc_id, list_concat({A.sql_keywords('lang')}, {A.sql_keywords('text')}) AS u FROM documents)""",
)
def _(t):
    union = T.keyword_union(T.keywords(F.col("lang")), T.keywords(F.col("text")))
    return _docs(t, F.array_join(union, " ").alias("keywords"))


@query(
    "allow_list_intersection",
    f"""SELECT doc_id, array_to_string({A.sql_ordered_distinct("list_filter(u, lambda w: list_contains(['the', 'of', 'und', 'les'], w))")}, ' ') AS allowed
       FROM (SELECT doc_id, string_split(lower(text), ' ') AS u FROM documents)""",
)
def _(t):
    allow = T.literal_array(["the", "of", "und", "les"])
    return _docs(t, F.array_join(F.array_intersect(F.split(F.lower("text"), " "), allow), " ").alias("allowed"))
