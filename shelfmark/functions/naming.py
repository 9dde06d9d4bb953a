"""Parts of resource names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and limits.
STAGE_PATTERN = r"\A[tbsp][a-z0-9]*\z"
REGION_PATTERN = r"[a-z]{2}-[a-z]+-\d+"
ACCOUNT_PATTERN = r"\A\d{12}\z"
BUCKET_PATTERN = r"\A[a-z0-9][a-z0-9.-]*[a-z0-9]\z"
CAPS_PATTERN = r"\A[A-Z][A-Z0-9]*\z"

_REGION_FROM_RIGHT = rf"\A(?:(.*)-)?({REGION_PATTERN})(?:-.*)?\z"


def is_valid_stage(stage: Column) -> Column:
    return F.coalesce(stage.rlike(STAGE_PATTERN), F.lit(False))


def pascal_case_warnings(suffix: Column) -> Column:
    """Array of at most two warnings."""
    quoted = F.concat(F.lit("ResourceSuffix '"), suffix, F.lit("'"))
    return F.array_compact(
        F.array(
            F.when(
                (suffix != "") & ~suffix.rlike(r"\A[A-Z]"),
                F.concat(quoted, F.lit(" should start with an uppercase letter (PascalCase)")),
            ),
            F.when(
                suffix.rlike("[A-Z]{2,}"),
                F.concat(
                    quoted,
                    F.lit(
                        " contains consecutive uppercase letters. Only the first letter of acronyms should be "
                        "capitalized (e.g., 'Api' not 'API', 'Mcp' not 'MCP')"
                    ),
                ),
            ),
        )
    )


def region_from_right(name: Column) -> Column:
    """The last three dash-separated segments that look like a region, or null."""
    return F.nullif(F.regexp_extract(name, _REGION_FROM_RIGHT, 2), F.lit(""))


def before_region(name: Column) -> Column:
    """What precedes that region, without the dash between them."""
    return F.regexp_extract(name, _REGION_FROM_RIGHT, 1)


def detect_resource_type(name: Column) -> Column:
    """s3, service-role, application or null."""
    parts = F.split(name, "-")
    lower = name == F.lower(name)
    with_suffix = name.endswith("-an") & region_from_right(F.regexp_replace(name, r"-an\z", "")).isNotNull()
    plain = name.rlike(BUCKET_PATTERN) & region_from_right(name).isNotNull()
    return (
        F.when(lower & (with_suffix | plain), "s3")
        .when((F.size(parts) >= 3) & ~lower & parts[0].rlike(CAPS_PATTERN), "service-role")
        .when((F.size(parts) >= 4) & is_valid_stage(F.lower(F.get(parts, F.lit(2)))), "application")
    )
