"""Name and request validation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from shelfmark.functions import naming as N
from shelfmark.operators import names as V
from shelfmark.operators.requests import validate_requests
from workload import adapters as A
from workload.registry import cte, query

# Name from a word {w}, its upper case {u} and a digit {d}, and the expected reading of it:
# name, type given, known prefix, known project | type, pattern, prefix, project, stage, rest, errors
_STAGE = " is invalid. Must start with t, b, s, or p followed by lowercase alphanumeric characters"
_SHAPES = [
    ("{w}-proj{d}-test-Func", "", "", "", "application", "", "{w}", "proj{d}", "test", "Func", ""),
    ("{w}-proj-xyz-Func", "", "", "", "application", "", "{w}", "proj", "xyz", "Func", "StageId 'xyz'" + _STAGE),
    ("{w}-proj", "", "", "", "application", "", "{w}", "proj", "", "",
     "Application resource name must have at least 4 components: Prefix-ProjectId-StageId-ResourceSuffix"),
    ("{u}-myapp-CodePipelineServiceRole", "", "", "", "service-role", "", "{u}", "myapp", "", "CodePipelineServiceRole", ""),
    ("{w}-my-test-app-prod-Fn", "", "", "", "application", "", "{w}", "my", "test", "app-prod-Fn", ""),
    ("{w}-my-xapp-prod-Fn", "", "", "", "application", "", "", "", "", "",
     "Cannot unambiguously parse resource name. Components may contain hyphens. Provide known values (prefix, projectId) for accurate parsing."),
    ("{w}-proj-test-data-123456789012-us-east-1-an", "", "", "", "s3", "pattern1", "{w}", "proj", "test", "data", ""),
    ("{w}-proj-data{d}-123456789012-eu-west-2", "", "", "", "s3", "pattern2", "{w}", "proj", "", "data{d}", ""),
    ("{w}-proj-prod-logs", "s3", "", "", "s3", "pattern3", "{w}", "proj", "prod", "logs", ""),
    ("my-org-big-app-beta-Table{d}", "dynamodb", "my-org", "big-app", "dynamodb", "", "my-org", "big-app", "beta", "Table{d}", ""),
    ("my-org-larger-app-test-Fn{d}", "lambda", "my-org", "", "lambda", "", "my-org", "larger-app", "test", "Fn{d}", ""),
    ("{w}-proj-test-" + "A" * 80, "lambda", "", "", "lambda", "", "{w}", "proj", "test", "A" * 80,
     "Resource name is too long (maximum 64 characters for lambda)"),
    ("{w}-proj-test-data-us-east-1-an", "", "", "", "s3", "pattern1", "{w}", "proj", "test", "data",
     "Pattern 1 (Regional) detected but no valid 12-digit AccountId found before Region"),
    ("{u}_x-a-B", "service-role", "", "", "service-role", "", "{u}_x", "a", "", "B",
     "Service-role Prefix '{u}_x' must be ALL CAPS (uppercase letters and digits only)"),
    ("other-{w}-test-Fn", "lambda", "my-org", "big-app", "lambda", "", "other", "{w}", "test", "Fn",
     "Prefix 'other' does not match expected value 'my-org'|ProjectId '{w}' does not match expected value 'big-app'"),
]
_FIELDS = ["name", "resource_type", "prefix", "project_id", "type", "pattern", "c_prefix", "c_project", "c_stage", "c_rest", "errors"]

_MARK = re.compile(r"\{([wud])\}")


def _sql_text(template: str) -> str:
    """Template to a SQL string; {w}, {u} and {d} stand for columns."""
    return "'" + _MARK.sub(r"' || \1 || '", template.replace("'", "''")) + "'"


def _spark_text(templates: list[str]):
    """The template of each row's shape, with its marks replaced."""
    text = F.element_at(F.array(*[F.lit(x) for x in templates]), (F.col("shape") + 1).cast("int"))
    for mark in "wud":
        text = F.replace(text, F.lit("{" + mark + "}"), F.col(mark).cast("string"))
    return text


def _case(field: str) -> str:
    position = _FIELDS.index(field)
    cases = " ".join(f"WHEN {i} THEN {_sql_text(s[position])}" for i, s in enumerate(_SHAPES))
    return f"CASE shape {cases} END"


cte(
    "name_words",
    f"""SELECT p_partkey AS id, CAST(p_partkey % {len(_SHAPES)} AS INTEGER) AS shape, replace(p_name, ' ', '') AS w,
               upper(replace(p_name, ' ', '')) AS u, p_partkey % 10 AS d FROM part""",
)
cte("expected_names", f"SELECT id, shape, {', '.join(f'{_case(f)} AS {f}' for f in _FIELDS)} FROM name_words")


def names(t):
    """Part names in fifteen shapes of resource names."""
    key = F.col("p_partkey")
    words = t.part.select(
        key.alias("id"),
        (key % len(_SHAPES)).alias("shape"),
        F.replace("p_name", F.lit(" "), F.lit("")).alias("w"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("u"),
        (key % 10).alias("d"),
    )

    def pick(position):
        return F.nullif(_spark_text([shape[position] for shape in _SHAPES]), F.lit(""))

    return words.select("id", *[pick(i).alias(f) for i, f in enumerate(_FIELDS[:4])])


def _verdict(df):
    c = F.col("components")
    blank = lambda x: F.coalesce(x, F.lit(""))
    return df.select(
        "id",
        "name",
        "valid",
        "resource_type",
        blank(F.col("pattern")).alias("pattern"),
        blank(c["prefix"]).alias("prefix"),
        blank(c["project_id"]).alias("project_id"),
        blank(c["stage_id"]).alias("stage_id"),
        blank(F.coalesce(c["resource_suffix"], c["resource_name"])).alias("rest"),
        F.array_join("errors", "|").alias("errors"),
    )


def _expected(where: str) -> str:
    return f"""SELECT id, name, errors = '' AS valid, type AS resource_type, pattern, c_prefix AS prefix, c_project AS project_id,
                      c_stage AS stage_id, c_rest AS rest, errors FROM expected_names {where}"""


@query("validate_names", _expected(""))
def _(t):
    return _verdict(V.validate_names(names(t)))


@query("validate_application_names", _expected("WHERE type IN ('lambda', 'dynamodb')"))
def _(t):
    return _verdict(V.application_names(names(t).where(F.col("resource_type").isin("lambda", "dynamodb"))))


@query("validate_bucket_names", _expected("WHERE type = 's3'").replace("'s3' AS", "type AS"))
def _(t):
    df = names(t)
    kind = F.coalesce("resource_type", N.detect_resource_type(F.col("name")))
    return _verdict(V.bucket_names(df.where(kind == "s3")))


@query("validate_service_role_names", _expected("WHERE type = 'service-role'"))
def _(t):
    df = names(t)
    kind = F.coalesce("resource_type", N.detect_resource_type(F.col("name")))
    return _verdict(V.service_role_names(df.where(kind == "service-role")))


@query(
    "detect_resource_type",
    rf"""SELECT id, name, CASE WHEN shape IN (6, 7, 12) THEN 's3'
              WHEN len(parts) >= 3 AND name <> lower(name) AND regexp_matches(parts[1], '{N.CAPS_PATTERN}') THEN 'service-role'
              WHEN len(parts) >= 4 AND regexp_matches(lower(parts[3]), '^[tbsp][a-z0-9]*$') THEN 'application' END AS detected
       FROM (SELECT *, string_split(name, '-') AS parts FROM expected_names)""",
)
def _(t):
    """Only the shapes with a region from the right are bucket names; all others go by their parts."""
    return names(t).select("id", "name", N.detect_resource_type(F.col("name")).alias("detected"))


@query(
    "region_from_right",
    """SELECT id, name, CASE shape WHEN 6 THEN 'us-east-1' WHEN 7 THEN 'eu-west-2' WHEN 12 THEN 'us-east-1' END AS region
       FROM expected_names""",
)
def _(t):
    return names(t).select("id", "name", N.region_from_right(F.col("name")).alias("region"))


@query(
    "valid_stages",
    r"""SELECT p_partkey AS id, w, regexp_matches(w, '^[tbsp][a-z0-9]*$') AS valid
        FROM (SELECT p_partkey, replace(p_name, ' ', '') AS w FROM part)""",
)
def _(t):
    word = F.replace("p_name", F.lit(" "), F.lit(""))
    return t.part.select(F.col("p_partkey").alias("id"), word.alias("w"), N.is_valid_stage(word).alias("valid"))


@query(
    "pascal_case_warnings",
    """SELECT p_partkey AS id, suffix, array_to_string(list_filter([
         CASE WHEN NOT regexp_matches(suffix, '^[A-Z]') THEN 'ResourceSuffix ''' || suffix || ''' should start with an uppercase letter (PascalCase)' END,
         CASE WHEN regexp_matches(suffix, '[A-Z]{2,}') THEN 'ResourceSuffix ''' || suffix || ''' contains consecutive uppercase letters. Only the first letter of acronyms should be capitalized (e.g., ''Api'' not ''API'', ''Mcp'' not ''MCP'')' END],
         lambda x: x IS NOT NULL), '|') AS warnings
       FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE 'Get' || p_type END AS suffix FROM part)""",
)
def _(t):
    key = F.col("p_partkey")
    suffix = F.when(key % 3 == 0, F.col("p_type")).when(key % 3 == 1, F.lower("p_type")).otherwise(F.concat(F.lit("Get"), "p_type"))
    df = t.part.select(key.alias("id"), suffix.alias("suffix"))
    return df.select("id", "suffix", F.array_join(N.pascal_case_warnings(F.col("suffix")), "|").alias("warnings"))


# --- requests -----------------------------------------------------------------------------------

# Tool, input (w stands for a word of the row) and errors joined by "|".
_REQUESTS = [
    ("list_templates", '{"category": "storage", "namespace": "w"}', ""),
    ("list_templates", '{"category": "w", "s3Buckets": []}',
     "Property 'category' must be one of: storage, network, pipeline, service-role, modules|Property 's3Buckets' must have at least 1 items"),
    ("get_template", '{"version": "v1.2", "other": 1}',
     r"Missing required property: templateName|Unknown property: other|Property 'version' does not match required pattern: "
     r"^v\d+\.\d+\.\d+(\/\d{4}-\d{2}-\d{2})?$"),
    ("get_template", '{"templateName": "w", "version": "v1.2.3/2024-01-15", "versionId": null}',
     "Property 'versionId' must be of type string, got object"),
    ("get_template_chunk", '{"templateName": "w", "category": "modules", "chunkIndex": -1}',
     "Property 'chunkIndex' must be at least 0"),
    ("get_template_chunk", '{"templateName": "w", "category": "modules", "chunkIndex": 1.5}',
     "Property 'chunkIndex' must be of type integer, got number"),
    ("get_template_chunk", '{"templateName": "w", "category": "modules", "chunkIndex": 3.0}', ""),
    ("search_documentation", '{"query": "w", "ghusers": ["a", "", 7]}',
     "Property 'ghusers[1]' must be at least 1 characters long|Property 'ghusers[2]' must be of type string, got number"),
    ("list_starters", '{"s3Buckets": ["ab", "' + "x" * 64 + '", "good"]}',
     "Property 's3Buckets[0]' must be at least 3 characters long|Property 's3Buckets[1]' must be at most 63 characters long"),
    ("validate_naming", '{"resourceName": "", "isShared": "yes"}',
     "Property 'resourceName' must be at least 1 characters long|Property 'isShared' must be of type boolean, got string"),
    ("list_tools", '{"w": true}', "Unknown property: w"),
    ("no_such_tool", '{}', "Unknown tool: no_such_tool"),
    ("list_categories", '["w"]', "Input must be an object"),
    ("check_template_updates", '{}', "Missing required property: templateName|Missing required property: currentVersion"),
]


def tool_requests(t):
    """One request per part, in fourteen shapes."""
    shape = (F.col("p_partkey") % len(_REQUESTS) + 1).cast("int")
    quoted = F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit("")), F.lit('"'))
    tool = F.element_at(F.array(*[F.lit(r[0]) for r in _REQUESTS]), shape)
    document = F.element_at(F.array(*[F.lit(r[1]) for r in _REQUESTS]), shape)
    return t.part.select(
        F.col("p_partkey").alias("id"), tool.alias("tool"), F.replace(document, F.lit('"w"'), quoted).alias("input_json")
    )


def _request_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    tools = " ".join(f"WHEN {i} THEN {quoted(r[0])}" for i, r in enumerate(_REQUESTS))
    errors = " ".join(
        f"WHEN {i} THEN " + (f"'Unknown property: ' || w" if r[2] == "Unknown property: w" else quoted(r[2]))
        for i, r in enumerate(_REQUESTS)
    )
    return f"""SELECT id, tool, errors = '' AS valid, errors FROM (
        SELECT p_partkey AS id, CASE s {tools} END AS tool, CASE s {errors} END AS errors
        FROM (SELECT p_partkey, p_partkey % {len(_REQUESTS)} AS s, replace(p_name, ' ', '') AS w FROM part))"""


@query("validate_requests", _request_sql())
def _(t):
    return validate_requests(tool_requests(t)).select("id", "tool", "valid", F.array_join("errors", "|").alias("errors"))
