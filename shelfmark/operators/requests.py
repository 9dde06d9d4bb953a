"""Batch validation of tool requests against their input schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.catalog import CATEGORIES

# --- Fixed values: the input schema of every tool ------------------------------------------------

_NAME = {"type": "string", "minLength": 1}
_TEXT = {"type": "string"}
_FLAG = {"type": "boolean"}
_CATEGORY = {"type": "string", "enum": list(CATEGORIES)}
_BUCKETS = {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 3, "maxLength": 63}}
_NAMESPACE = {"type": "string", "pattern": "^[a-z0-9][a-z0-9-]*$", "maxLength": 63}
_VERSION = {"type": "string", "pattern": r"^v\d+\.\d+\.\d+(\/\d{4}-\d{2}-\d{2})?$"}
_DOC_TYPES = ["guide", "tutorial", "reference", "troubleshooting", "template pattern", "code example"]
_WHERE = {"s3Buckets": _BUCKETS, "namespace": _NAMESPACE}

#: tool -> (required properties, properties); no other properties are allowed.
SCHEMAS: dict[str, tuple[list[str], dict[str, dict]]] = {
    "list_templates": ([], {"category": _CATEGORY, **_WHERE}),
    "get_template": (
        ["templateName"],
        {"templateName": _NAME, "category": _CATEGORY, "version": _VERSION, "versionId": _TEXT, **_WHERE},
    ),
    "list_template_versions": (["templateName"], {"templateName": _NAME, "category": _CATEGORY, **_WHERE}),
    "list_categories": ([], {}),
    "list_starters": ([], {**_WHERE}),
    "get_starter_info": (["starterName"], {"starterName": _NAME, **_WHERE}),
    "search_documentation": (
        ["query"],
        {
            "query": _NAME,
            "type": {"type": "string", "enum": _DOC_TYPES},
            "ghusers": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}},
        },
    ),
    "validate_naming": (
        ["resourceName"],
        {
            "resourceName": _NAME,
            "resourceType": _TEXT,
            "isShared": _FLAG,
            "hasOrgPrefix": _FLAG,
            "prefix": _TEXT,
            "projectId": _TEXT,
            "stageId": _TEXT,
            "orgPrefix": _TEXT,
        },
    ),
    "check_template_updates": (
        ["templateName", "currentVersion"],
        {"templateName": _NAME, "currentVersion": _NAME, "category": _CATEGORY, **_WHERE},
    ),
    "list_tools": ([], {}),
    "get_template_chunk": (
        ["templateName", "category", "chunkIndex"],
        {
            "templateName": _NAME,
            "category": _CATEGORY,
            "chunkIndex": {"type": "integer", "minimum": 0},
            "version": _TEXT,
            "versionId": _TEXT,
            "s3Buckets": _BUCKETS,
            "namespace": {"type": "string", "maxLength": 63},
        },
    ),
}

# ---------------------------------------------------------------------------------------------------

#: Field name, key in the schema, type.
_RULE_FIELDS = [
    ("type", "type", "string"),
    ("minimum", "minimum", "double"),
    ("enum", "enum", "array<string>"),
    ("pattern", "pattern", "string"),
    ("min_length", "minLength", "int"),
    ("max_length", "maxLength", "int"),
    ("min_items", "minItems", "int"),
    ("max_items", "maxItems", "int"),
]


def _literal(value, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value).cast(kind)


def _rule(schema: dict) -> Column:
    items = schema.get("items", {})
    fields = [_literal(schema.get(key), kind).alias(name) for name, key, kind in _RULE_FIELDS]
    fields += [
        _literal(items.get("type"), "string").alias("item_type"),
        _literal(items.get("minLength"), "int").alias("item_min"),
        _literal(items.get("maxLength"), "int").alias("item_max"),
    ]
    return F.struct(*fields)


def _rules() -> Column:
    """Literal map from ``tool.property`` to its rule."""
    entries = []
    for tool, (_required, properties) in SCHEMAS.items():
        for name, schema in properties.items():
            entries += [F.lit(f"{tool}.{name}"), _rule(schema)]
    return F.create_map(*entries)


def _required() -> Column:
    entries = []
    for tool, (required, _properties) in SCHEMAS.items():
        entries += [F.lit(tool), F.array(*[F.lit(r) for r in required]).cast("array<string>")]
    return F.create_map(*entries)


def json_type(value: Column) -> Column:
    """Type of a variant as a script would name it; null is an object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT") | (kind == "VOID"), "object")
        .otherwise("number")
    )


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _property_errors(name: Column, value: Column, rule: Column) -> Column:
    """Errors of one property in a fixed order; a wrong type hides the rest."""
    actual = json_type(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    array = F.try_variant_get(value, "$", "array<variant>")
    is_text, is_array = actual == "string", actual == "array"
    integer = (actual == "number") & (number == F.floor(number))
    right_type = F.when(rule["type"] == "integer", integer).otherwise(actual == rule["type"])
    subject = lambda: _say("Property '", name, "'")
    wrong = F.concat(subject(), _say(" must be of type ", rule["type"], ", got ", actual))

    def check(condition: Column, *text_parts: str | Column) -> Column:
        return F.when(condition, F.concat(subject(), _say(*text_parts)))

    def item_errors(item: Column, i: Column) -> Column:
        label = _say("Property '", name, "[", i, "]'")
        kind = json_type(item)
        length = F.length(F.try_variant_get(item, "$", "string"))
        is_string = kind == "string"
        return F.array_compact(
            F.array(
                F.when(kind != rule["item_type"], F.concat(label, _say(" must be of type ", rule["item_type"], ", got ", kind))),
                F.when(is_string & (length < rule["item_min"]),
                       F.concat(label, _say(" must be at least ", rule["item_min"], " characters long"))),
                F.when(is_string & (length > rule["item_max"]),
                       F.concat(label, _say(" must be at most ", rule["item_max"], " characters long"))),
            )
        )

    own = F.array_compact(
        F.array(
            check((actual == "number") & (number < rule["minimum"]), " must be at least ", rule["minimum"].cast("int")),
            check(is_text & ~F.array_contains(rule["enum"], text), " must be one of: ", F.array_join(rule["enum"], ", ")),
            check(is_text & ~F.rlike(text, rule["pattern"]), " does not match required pattern: ", rule["pattern"]),
            check(is_text & (F.length(text) < rule["min_length"]), " must be at least ", rule["min_length"], " characters long"),
            check(is_text & (F.length(text) > rule["max_length"]), " must be at most ", rule["max_length"], " characters long"),
            check(is_array & (F.size(array) < rule["min_items"]), " must have at least ", rule["min_items"], " items"),
            check(is_array & (F.size(array) > rule["max_items"]), " must have at most ", rule["max_items"], " items"),
        )
    )
    none = F.array().cast("array<string>")
    items = F.when(is_array & rule["item_type"].isNotNull(), F.flatten(F.transform(array, item_errors)))
    return (
        F.when(rule.isNull(), none)
        .when(~F.coalesce(right_type, F.lit(False)), F.array(wrong))
        .otherwise(F.concat(own, F.coalesce(items, none)))
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """``tool, input_json`` (and whatever else) to ``valid, errors``; all errors in order.

    The rules are one literal map looked up per property, so the plan does not grow with the tools
    and nothing is joined or shuffled.
    """
    keep = [c for c in requests.columns if c != "input_json"]
    parsed = requests.withColumns(
        {"_input": F.from_json("input_json", "map<string, variant>"), "_rules": _rules(), "_required": _required()[F.col("tool")]}
    )
    names = F.map_keys("_input")
    missing = F.transform(
        F.array_except(F.col("_required"), names), lambda p: _say("Missing required property: ", p)
    )
    rule_of = lambda p: F.try_element_at(F.col("_rules"), F.concat(F.col("tool"), F.lit("."), p))
    unknown = F.transform(F.filter(names, lambda p: rule_of(p).isNull()), lambda p: _say("Unknown property: ", p))
    broken = F.flatten(
        F.transform(names, lambda p: _property_errors(p, F.element_at(F.col("_input"), p), rule_of(p)))
    )
    errors = (
        F.when(~F.col("tool").isin(list(SCHEMAS)), F.array(_say("Unknown tool: ", F.col("tool"))))
        .when(F.col("_input").isNull(), F.array(F.lit("Input must be an object")))
        .otherwise(F.concat(missing, unknown, broken))
    )
    return parsed.withColumn("errors", errors).select(*keep, (F.size("errors") == 0).alias("valid"), "errors")
