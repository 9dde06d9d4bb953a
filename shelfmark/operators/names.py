"""Batch validation of resource names.

``names`` has ``name`` and optionally ``resource_type, prefix, project_id, stage_id, org_prefix,
is_shared, has_org_prefix, partial``.  The result adds ``valid, errors, suggestions, components,
pattern, resource_type``; a missing component is null.  All steps are native columns, one step per
``withColumns`` so that later steps refer to earlier results instead of repeating them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.naming import (
    ACCOUNT_PATTERN,
    BUCKET_PATTERN,
    CAPS_PATTERN,
    STAGE_PATTERN,
    before_region,
    detect_resource_type,
    is_valid_stage,
    pascal_case_warnings,
    region_from_right,
)

# Limits per service, and the texts of errors and suggestions.
SERVICE_RULES = {
    "dynamodb": (3, 255, r"\A[a-zA-Z0-9_.-]+\z",
                 "DynamoDB table names must be 3-255 characters, alphanumeric with underscore, dot, and hyphen"),
    "lambda": (1, 64, r"\A[a-zA-Z0-9-_]+\z",
               "Lambda function names must be 1-64 characters, alphanumeric with hyphen and underscore"),
    "cloudformation": (1, 128, r"\A[a-zA-Z][a-zA-Z0-9-]*\z",
                       "CloudFormation stack names must be 1-128 characters, start with letter, alphanumeric with hyphen"),
}
BUCKET_LENGTH = (3, 63)
BUCKET_DISALLOWED = ["..", ".-", "-."]
BUCKET_RULE = (
    "S3 bucket names must be 3-63 characters, lowercase alphanumeric with dots and hyphens, cannot start/end with dot "
    "or hyphen, no consecutive dots"
)
AMBIGUOUS = (
    "Cannot unambiguously parse resource name. Components may contain hyphens. Provide known values (prefix, "
    "projectId) for accurate parsing."
)
DISAMBIGUATE = (
    "Use the prefix, projectId, and optionally orgPrefix parameters to disambiguate hyphenated components."
)
STAGE_HINT = "StageId must match pattern: starts with t, b, s, or p (e.g., test, tjoe, beta, prod)"
STAGE_RULE = " is invalid. Must start with t, b, s, or p followed by lowercase alphanumeric characters"
PATTERN_1 = "[OrgPrefix-]Prefix-ProjectId[-StageId][-ResourceName]-AccountId-Region-an"
PATTERN_2 = "[OrgPrefix-]Prefix-ProjectId[-StageId][-ResourceName]-AccountId-Region"
PATTERN_3 = "[OrgPrefix-]Prefix-ProjectId[-StageId][-ResourceName]"
CAPS_HINT = (
    "Prefix must match pattern: starts with uppercase letter, only uppercase letters and digits (e.g., ACME, AWS1)"
)

INPUTS = {
    "resource_type": "string",
    "prefix": "string",
    "project_id": "string",
    "stage_id": "string",
    "org_prefix": "string",
    "is_shared": "boolean",
    "has_org_prefix": "boolean",
    "partial": "boolean",
}
COMPONENTS = ["org_prefix", "prefix", "project_id", "stage_id", "resource_suffix", "resource_name", "account_id", "region"]


def _c(name: str) -> Column:
    return F.col(name)


def _null() -> Column:
    return F.lit(None).cast("string")


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _rest(parts: Column, start: Column | int) -> Column:
    """Segments from a zero-based position on, joined again; null when there are none."""
    start = F.lit(start) if isinstance(start, int) else start
    count = F.size(parts) - start
    return F.when(count > 0, F.array_join(F.slice(parts, start + 1, F.greatest(count, F.lit(0))), "-"))


def _head(parts: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(count, F.lit(0))), "-")


def _first_stage(parts: Column, start: int = 0) -> Column:
    """Zero-based position of the first valid stage from ``start`` on, or -1."""
    marks = F.transform(parts, lambda p, i: (i >= start) & p.rlike(STAGE_PATTERN))
    return (F.array_position(marks, True) - 1).cast("int")


def _after(name: Column, start: Column) -> Column:
    return F.substring(name, F.length(start) + 1, F.length(name))


def _mismatch(component: str, known: str, label: str, hint: str) -> tuple[Column, Column]:
    differs = _given(_c(component)) & _given(_c(known)) & (_c(component) != _c(known))
    return (
        F.when(differs, _say(f"{label} '", _c(component), "' does not match expected value '", _c(known), "'")),
        F.when(differs, _say(f"Use {hint}: ", _c(known))),
    )


def _with_inputs(names: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in names.columns}
    df = names.withColumns(missing) if missing else names
    return df.withColumns({c: F.coalesce(_c(c), F.lit(False)) for c in ("is_shared", "has_org_prefix", "partial")})


def _finish(df: DataFrame, names: DataFrame, errors: Column, suggestions: Column, pattern: Column, kind: Column) -> DataFrame:
    keep = [c for c in names.columns if c not in INPUTS]
    components = F.struct(*[(_c(f"c_{c}") if f"c_{c}" in df.columns else _null()).alias(c) for c in COMPONENTS])
    return (
        df.withColumn("errors", errors)
        .withColumn("suggestions", suggestions)
        .select(
            *keep,
            (F.size("errors") == 0).alias("valid"),
            "errors",
            "suggestions",
            components.alias("components"),
            pattern.alias("pattern"),
            kind.alias("resource_type"),
        )
    )


# --- application resources ----------------------------------------------------------------------


def application_names(names: DataFrame) -> DataFrame:
    """Prefix-ProjectId-StageId-ResourceSuffix, or without stage for shared resources."""
    df = _with_inputs(names)
    name, shared, partial = _c("name"), _c("is_shared"), _c("partial")
    start = F.when(
        _given(_c("prefix")), F.concat_ws("-", "prefix", F.when(_given(_c("project_id")), _c("project_id")), F.lit(""))
    )
    df = df.withColumns(
        {
            "service": F.lower(F.coalesce("resource_type", F.lit("lambda"))),
            "parts": F.split(name, "-"),
            "start": start,
            "needed": F.when(shared, 3).otherwise(4),
        }
    )
    anchored = F.coalesce(name.startswith(_c("start")), F.lit(False))
    enough = F.size("parts") >= _c("needed")
    df = df.withColumns(
        {
            "remainder": F.when(anchored, _after(name, _c("start"))),
            "stage_pos": _first_stage(_c("parts"), 2),
            "stage_ok": is_valid_stage(F.get("parts", F.lit(2))),
        }
    )
    df = df.withColumns(
        {
            # How the name was read.
            "how": F.when(anchored & _given(_c("project_id")), "both_known")
            .when(anchored, "prefix_known")
            .when(~enough, "short")
            .when(shared | _c("stage_ok"), "positional")
            .when((_c("stage_pos") > 0) & (_c("stage_pos") + 1 < F.size("parts")), "ambiguous")
            .otherwise("bad_stage"),
            "rest": F.split("remainder", "-"),
        }
    )
    # Text before and after the first dash; a leading dash does not count.
    dash = F.instr(_c("remainder"), "-") > 1
    df = df.withColumns(
        {
            "first": F.when(dash, F.substring_index("remainder", "-", 1)).otherwise(_c("remainder")),
            "others": F.when(dash, F.nullif(_rest(_c("rest"), 1), F.lit(""))),
            "pos": _first_stage(_c("rest")),
        }
    )
    how, pos, rest, parts = _c("how"), _c("pos"), _c("rest"), _c("parts")
    by_position = how.isin("positional", "bad_stage", "short")
    staged = (pos > 0) | ((pos == 0) & (F.size(rest) >= 2))
    df = df.withColumns(
        {
            "c_prefix": F.when(how.isin("both_known", "prefix_known"), _c("prefix")).when(by_position, parts[0]),
            "c_project_id": F.when(how == "both_known", _c("project_id"))
            .when((how == "prefix_known") & shared, _c("first"))
            .when((how == "prefix_known") & staged, _head(rest, pos))
            .when(how == "prefix_known", _c("remainder"))
            .when(by_position, F.get(parts, F.lit(1))),
            "c_stage_id": F.when(shared, _null())
            .when(how == "both_known", F.nullif(_c("first"), F.lit("")))
            .when((how == "prefix_known") & staged, F.get(rest, pos))
            .when(by_position, F.get(parts, F.lit(2))),
            "c_resource_suffix": F.when((how == "both_known") & shared, F.nullif(_c("remainder"), F.lit("")))
            .when(how == "both_known", _c("others"))
            .when((how == "prefix_known") & shared, _c("others"))
            .when((how == "prefix_known") & staged, _rest(rest, pos + 1))
            .when(how.isin("positional", "bad_stage"), _rest(parts, F.when(shared, 2).otherwise(3))),
        }
    )
    prefix, project, stage, suffix = (_c(f"c_{c}") for c in ("prefix", "project_id", "stage_id", "resource_suffix"))
    alnum = r"(?i)\A[a-z0-9]+\z"
    bad_prefix = _given(prefix) & ~_given(_c("prefix")) & ~prefix.rlike(alnum)
    bad_project = _given(project) & ~_given(_c("prefix")) & ~_given(_c("project_id")) & ~project.rlike(alnum)
    bad_stage = F.when(how == "bad_stage", True).otherwise(_given(stage) & ~is_valid_stage(stage))
    stage_error = F.when(bad_stage, _say("StageId '", stage, f"'{STAGE_RULE}"))
    prefix_error, prefix_hint = _mismatch("c_prefix", "prefix", "Prefix", "prefix")
    project_error, project_hint = _mismatch("c_project_id", "project_id", "ProjectId", "project ID")
    value_error, value_hint = _mismatch("c_stage_id", "stage_id", "StageId", "stage ID")
    only = "Use alphanumeric characters only for "
    cleaned = lambda c: F.regexp_replace(c, "(?i)[^a-z0-9]", "")
    prefix_format = F.when(bad_prefix, "Prefix must contain only alphanumeric characters")
    prefix_clean = F.when(bad_prefix, _say(f"{only}prefix (e.g., ", cleaned(prefix), ")"))

    with_suffix = ~partial & _given(suffix)
    no_suffix = ~partial & ~_given(suffix)
    service_errors, service_hints = [], []
    for service, (low, high, pattern, rule) in SERVICE_RULES.items():
        checked = with_suffix & (_c("service") == service)
        too_long = checked & (F.length(name) > high)
        service_errors += [
            F.when(checked & (F.length(name) < low), f"Resource name is too short (minimum {low} characters for {service})"),
            F.when(too_long, f"Resource name is too long (maximum {high} characters for {service})"),
            F.when(checked & ~name.rlike(pattern), f"Resource name does not match {service} naming rules: {rule}"),
        ]
        service_hints.append(F.when(too_long, f"Shorten resource name to {high} characters or less"))

    shape = F.when(shared, "Prefix-ProjectId-ResourceSuffix").otherwise("Prefix-ProjectId-StageId-ResourceSuffix")
    known = lambda c, default: F.when(_given(_c(c)), _c(c)).otherwise(default)
    expected = _say(
        "Expected format: ", known("prefix", "prefix"), "-", known("project_id", "projectid"),
        F.when(shared, F.lit("")).otherwise(F.concat(F.lit("-"), known("stage_id", "stageid"))), "-ResourceSuffix",
    )
    short_errors = _list(
        F.when(~partial, _say("Application resource name must have at least ", _c("needed").cast("string"), " components: ", shape)),
        prefix_format,
    )
    short_hints = _list(F.when(~partial, expected), prefix_clean)
    errors = _list(
        F.when(how == "bad_stage", stage_error),
        prefix_format,
        prefix_error,
        F.when(bad_project, "ProjectId must contain only alphanumeric characters"),
        project_error,
        F.when(how != "bad_stage", stage_error),
        value_error,
        *service_errors,
        F.when(no_suffix, "ResourceSuffix component is required"),
    )
    hints = F.concat(
        _list(
            F.when((how == "bad_stage") & bad_stage, STAGE_HINT),
            prefix_clean,
            prefix_hint,
            F.when(bad_project, _say(f"{only}project ID (e.g., ", cleaned(project), ")")),
            project_hint,
            F.when((how != "bad_stage") & bad_stage, STAGE_HINT),
            value_hint,
        ),
        F.when(with_suffix, pascal_case_warnings(suffix)).otherwise(F.array().cast("array<string>")),
        _list(
            *service_hints,
            F.when(no_suffix, _say("Add a resource suffix after ", F.when(shared, "ProjectId").otherwise("StageId"),
                                   " (e.g., MyFunction, MyTable)")),
        ),
    )
    return _finish(
        df,
        names,
        F.when(how == "short", short_errors).when(how == "ambiguous", F.array(F.lit(AMBIGUOUS))).otherwise(errors),
        F.when(how == "short", short_hints).when(how == "ambiguous", F.array(F.lit(DISAMBIGUATE))).otherwise(hints),
        _null(),
        _c("service"),
    )


# --- service roles ------------------------------------------------------------------------------


def service_role_names(names: DataFrame) -> DataFrame:
    """PREFIX-ProjectId-ResourceSuffix with an upper-case prefix and no stage."""
    df = _with_inputs(names)
    name, partial = _c("name"), _c("partial")
    has_prefix, has_project = _given(_c("prefix")), _given(_c("project_id"))
    start = F.when(has_prefix, F.concat_ws("-", "prefix", F.when(has_project, _c("project_id")), F.lit("")))
    df = df.withColumns({"parts": F.split(name, "-"), "start": start})
    anchored = F.coalesce(name.startswith(_c("start")), F.lit(False))
    df = df.withColumn(
        "how",
        F.when(anchored & has_project, "both_known")
        .when(anchored, "prefix_known")
        .when(F.size("parts") >= 3, "positional")
        .otherwise("short"),
    ).withColumn("remainder", F.when(anchored, _after(name, _c("start"))))
    how, parts, rest = _c("how"), _c("parts"), F.split("remainder", "-")
    df = df.withColumns(
        {
            "c_prefix": F.when(how.isin("both_known", "prefix_known"), _c("prefix")).otherwise(parts[0]),
            "c_project_id": F.when(how == "both_known", _c("project_id"))
            .when(how == "prefix_known", rest[0])
            .otherwise(F.get(parts, F.lit(1))),
            "c_resource_suffix": F.nullif(
                F.when(how == "both_known", _c("remainder"))
                .when(how == "prefix_known", _rest(rest, 1))
                .when(how == "positional", _rest(parts, 2)),
                F.lit(""),
            ),
        }
    )
    prefix, suffix = _c("c_prefix"), _c("c_resource_suffix")
    bad_prefix = _given(prefix) & ~has_prefix & ~prefix.rlike(CAPS_PATTERN)
    short = how == "short"
    no_suffix = ~short & ~partial & ~_given(suffix)
    prefix_error, prefix_hint = _mismatch("c_prefix", "prefix", "Prefix", "prefix")
    project_error, project_hint = _mismatch("c_project_id", "project_id", "ProjectId", "project ID")
    warn = ~short & ~partial & _given(suffix)
    errors = _list(
        F.when(short & ~partial, "Service-role resource name must have at least 3 components: PREFIX-ProjectId-ResourceSuffix"),
        F.when(bad_prefix, _say("Service-role Prefix '", prefix, "' must be ALL CAPS (uppercase letters and digits only)")),
        F.when(~short, prefix_error),
        F.when(~short, project_error),
        F.when(no_suffix, "ResourceSuffix component is required"),
    )
    hints = F.concat(
        _list(
            F.when(short & ~partial, "Expected format: PREFIX-ProjectId-ResourceSuffix (e.g., ACME-myapp-CodePipelineServiceRole)"),
            F.when(bad_prefix, CAPS_HINT),
            F.when(~short, prefix_hint),
            F.when(~short, project_hint),
        ),
        F.when(warn, pascal_case_warnings(suffix)).otherwise(F.array().cast("array<string>")),
        _list(F.when(no_suffix, "Add a resource suffix after ProjectId (e.g., CodePipelineServiceRole, CloudFormationRole)")),
    )
    return _finish(df, names, errors, hints, _null(), F.lit("service-role"))


# --- buckets ------------------------------------------------------------------------------------


def _strip_known(df: DataFrame, value: str, component: str) -> DataFrame:
    """Take a known value off the left of ``left``, when it stands there."""
    known, left = _c(value), _c("left")
    whole = left == known
    leading = left.startswith(F.concat(known, F.lit("-")))
    hit = _given(known) & F.coalesce(whole | leading, F.lit(False))
    return df.withColumns(
        {
            f"c_{component}": F.when(hit, known),
            "left": F.when(hit & whole, "").when(hit, _after(left, F.concat(known, F.lit("-")))).otherwise(left),
        }
    )


def _prefix_components(df: DataFrame) -> DataFrame:
    """Components of the text in ``left``: known values first, then positions."""
    for value in ("org_prefix", "prefix", "project_id", "stage_id"):
        df = _strip_known(df, value, value)
    shared, left = _c("is_shared"), _c("left")
    all_known = _given(_c("prefix")) & _given(_c("project_id"))
    # Without any anchor the segments are taken one by one, an organisation first where one is announced.
    org_first = _c("has_org_prefix") & _c("c_org_prefix").isNull()
    df = df.withColumns({"segs": F.split(left, "-"), "pos": _first_stage(F.split(left, "-"))})
    segs, pos = _c("segs"), _c("pos")
    df = df.withColumns(
        {
            "mode": F.when(left == "", "nothing")
            .when(all_known, "known")
            .when(_c("c_prefix").isNull() & _c("c_project_id").isNull(), "positions")
            .when(_c("c_project_id").isNull(), "find_stage")
            .when(_c("c_prefix").isNotNull(), "known")
            .otherwise("nothing"),
            "at": F.when(org_first, 1).otherwise(0),
            "stage_first": is_valid_stage(segs[0]) & ~shared,
        }
    )
    mode, at = _c("mode"), _c("at")
    stage_at = at + 2
    positional_stage = is_valid_stage(F.get(segs, stage_at)) & ~shared
    # With every value known but the stage, a leading stage is recognised.
    take_stage = (mode == "known") & _c("stage_first") & ~(all_known & _given(_c("stage_id")))
    found = (mode == "find_stage") & ~shared & (pos >= 0)
    return df.withColumns(
        {
            "c_org_prefix": F.when((mode == "positions") & org_first, segs[0]).otherwise(_c("c_org_prefix")),
            "c_prefix": F.when(mode == "positions", F.get(segs, at)).otherwise(_c("c_prefix")),
            "c_project_id": F.when(mode == "positions", F.get(segs, at + 1))
            .when(found & (pos > 0), _head(segs, pos))
            .when((mode == "find_stage") & ~found, left)
            .otherwise(_c("c_project_id")),
            "c_stage_id": F.when((mode == "positions") & positional_stage, F.get(segs, stage_at))
            .when(found, F.get(segs, pos))
            .when(take_stage, segs[0])
            .otherwise(_c("c_stage_id")),
            "c_resource_name": F.when(
                mode == "positions", _rest(segs, stage_at + F.when(positional_stage, 1).otherwise(0))
            )
            .when(found, _rest(segs, pos + 1))
            .when(take_stage, _rest(segs, 1))
            .when(mode == "known", left),
        }
    )


def bucket_names(names: DataFrame) -> DataFrame:
    """Three bucket patterns: with account, region and ``-an``; with account and region; without both."""
    df = _with_inputs(names)
    name, partial = _c("name"), _c("partial")
    df = df.withColumn("regional", name.endswith("-an"))
    df = df.withColumn("body", F.when(_c("regional"), F.regexp_replace(name, r"-an\z", "")).otherwise(name))
    df = df.withColumns({"c_region": region_from_right(_c("body")), "before": before_region(_c("body"))})
    account = F.element_at(F.split("before", "-"), -1)
    df = df.withColumn("c_account_id", F.when(_c("c_region").isNotNull() & account.rlike(ACCOUNT_PATTERN), account))
    df = df.withColumn(
        "pattern",
        F.when(_c("regional") & _c("c_region").isNotNull(), "pattern1")
        .when(_c("regional"), _null())
        .when(_c("c_account_id").isNotNull(), "pattern2")
        .otherwise("pattern3"),
    )
    pattern = _c("pattern")
    without_account = F.regexp_replace("before", r"(\A|-)\d{12}\z", "")
    df = df.withColumns(
        {
            "left": F.when(pattern.isNull(), "")
            .when(pattern == "pattern3", name)
            .when(_c("c_account_id").isNotNull(), without_account)
            .otherwise(_c("before")),
            # A region without an account belongs to no pattern but the first.
            "c_region": F.when(pattern.isin("pattern1", "pattern2"), _c("c_region")),
        }
    )
    df = _prefix_components(df)
    unread = pattern.isNull()
    df = df.withColumns({f"c_{c}": F.when(~unread, _c(f"c_{c}")) for c in ("org_prefix", "prefix", "project_id", "stage_id")})
    third = pattern == "pattern3"
    df = df.withColumns(
        {
            "c_resource_suffix": F.when(third, _c("c_resource_name")),
            "c_resource_name": F.when(third, _null()).otherwise(_c("c_resource_name")),
        }
    )
    low, high = BUCKET_LENGTH
    length = F.length(name)
    disallowed = [(text, name.contains(text)) for text in BUCKET_DISALLOWED]
    org, prefix, project, stage = (_c(f"c_{c}") for c in ("org_prefix", "prefix", "project_id", "stage_id"))
    no_account = (pattern == "pattern1") & _c("c_account_id").isNull()
    no_region = unread & ~partial
    nothing = F.coalesce(third, F.lit(False)) & ~_given(prefix)
    lower = r"\A[a-z0-9]+\z"
    org_error, org_hint = _mismatch("c_org_prefix", "org_prefix", "Organization prefix", "organization prefix")
    org_missing = _given(_c("org_prefix")) & ~_given(org)
    bad_stage = _given(stage) & ~is_valid_stage(stage)
    prefix_error, prefix_hint = _mismatch("c_prefix", "prefix", "Prefix", "prefix")
    project_error, project_hint = _mismatch("c_project_id", "project_id", "ProjectId", "project ID")
    stage_error, stage_hint = _mismatch("c_stage_id", "stage_id", "StageId", "stage ID")
    errors = _list(
        F.when(length < low, f"S3 bucket name is too short (minimum {low} characters)"),
        F.when(length > high, f"S3 bucket name is too long (maximum {high} characters)"),
        F.when(~name.rlike(BUCKET_PATTERN), f"S3 bucket name does not match S3 naming rules: {BUCKET_RULE}"),
        *[F.when(hit, f"S3 bucket name contains disallowed pattern '{text}'") for text, hit in disallowed],
        F.when(name.rlike(r"\A[.-]"), "S3 bucket name cannot start with dot or hyphen"),
        F.when(name.rlike(r"[.-]\z"), "S3 bucket name cannot end with dot or hyphen"),
        F.when(no_account, "Pattern 1 (Regional) detected but no valid 12-digit AccountId found before Region"),
        F.when(no_region, "S3 bucket name ends with -an but no valid Region pattern found"),
        F.when(nothing & ~partial, "S3 bucket name does not match expected patterns"),
        org_error,
        F.when(org_missing, _say("Expected organization prefix '", _c("org_prefix"), "' not found in bucket name")),
        F.when(_given(prefix) & ~_given(_c("prefix")) & ~prefix.rlike(lower), "Prefix must contain only lowercase alphanumeric characters"),
        prefix_error,
        F.when(_given(project) & ~_given(_c("project_id")) & ~project.rlike(lower),
               "ProjectId must contain only lowercase alphanumeric characters"),
        project_error,
        F.when(bad_stage, _say("StageId '", stage, f"'{STAGE_RULE}")),
        stage_error,
    )
    hints = _list(
        F.when(length > high, f"Shorten bucket name to {high} characters or less"),
        F.when(~name.rlike(BUCKET_PATTERN), "Use lowercase letters, numbers, dots, and hyphens only"),
        *[F.when(hit, f"Remove '{text}' from bucket name") for text, hit in disallowed],
        F.when(no_account, "AccountId must be exactly 12 digits, placed before the Region in Pattern 1"),
        F.when(no_region, f"Pattern 1 (Regional): {PATTERN_1}"),
        *[F.when(nothing & ~partial, f"Pattern {n}: {p}") for n, p in enumerate((PATTERN_1, PATTERN_2, PATTERN_3), start=1)],
        F.when(third & _given(prefix), "Consider using the preferred S3 naming pattern with AccountId-Region suffix"),
        org_hint,
        F.when(org_missing, _say("Use organization prefix: ", _c("org_prefix"))),
        prefix_hint,
        project_hint,
        F.when(bad_stage, STAGE_HINT),
        stage_hint,
    )
    return _finish(df, names, errors, hints, _c("pattern"), F.lit("s3"))


# --- all types ----------------------------------------------------------------------------------


def validate_names(names: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Verdict for every name; the type is detected where it is not given.

    ``defaults`` may give ``prefix, project_id, stage_id`` for names that do not bring their own.
    """
    df = _with_inputs(names)
    for column, value in (defaults or {}).items():
        df = df.withColumn(column, F.when(_given(_c(column)), _c(column)).otherwise(value))
    given = F.lower(F.nullif(_c("resource_type"), F.lit("")))
    df = df.withColumn("resource_type", F.coalesce(given, detect_resource_type(_c("name")), F.lit("application")))
    named = df.where(_given(_c("name")))
    special = ["s3", "service-role"]
    kind = _c("resource_type")
    keep = [c for c in names.columns if c not in INPUTS]
    unnamed = df.where(~_given(_c("name"))).select(
        *keep,
        F.lit(False).alias("valid"),
        F.array(F.lit("Resource name is required and must be a string")).alias("errors"),
        F.array(F.lit("Provide a valid resource name to validate")).alias("suggestions"),
        F.struct(*[_null().alias(c) for c in COMPONENTS]).alias("components"),
        _null().alias("pattern"),
        _null().alias("resource_type"),
    )
    return (
        application_names(named.where(~kind.isin(special)))
        .unionByName(bucket_names(named.where(kind == "s3")))
        .unionByName(service_role_names(named.where(kind == "service-role")))
        .unionByName(unnamed)
    )
