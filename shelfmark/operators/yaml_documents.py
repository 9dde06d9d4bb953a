"""YAML templates with intrinsic-function tags, read with the 1.2 core types."""

from __future__ import annotations

import math
import re
from typing import Any

try:
    import yaml
except ImportError:  # templates are then reported as unreadable
    yaml = None

# The accepted tags.
TAGS = [
    "Ref", "Sub", "If", "GetAtt", "Join", "Select", "Split", "FindInMap", "ImportValue", "GetAZs", "Condition", "Equals",
    "And", "Or", "Not", "Base64", "Cidr", "Transform",
]

_CORE_TYPES = [
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$",
     "-+.0123456789"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("merge", r"^(?:<<)$", "<"),
]

#: Words of a quoted scalar and the blanks between them, up to a quote, a backslash, a line end or white space that may precede one.
_QUOTED_RUN = re.compile("[^'\"\\\\\0 \t\r\n\x85\u2028\u2029\ufeff]+(?: +[^'\"\\\\\0 \t\r\n\x85\u2028\u2029\ufeff]+)*")


def _loader(keep_function_names: bool):
    class TemplateLoader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def scan_flow_scalar_non_spaces(self, double, start_mark):
            # A run is taken at once, where the scanner would go on character by character; the rest is its own.
            run = _QUOTED_RUN.match(self.buffer, self.pointer)
            if run is None:
                return super().scan_flow_scalar_non_spaces(double, start_mark)
            for place in ("pointer", "index", "column"):
                setattr(self, place, getattr(self, place) + len(run.group()))
            return [run.group(), *super().scan_flow_scalar_non_spaces(double, start_mark)]

        def construct_mapping(self, node, deep=False):
            keys = [k.value for k, _v in node.value if isinstance(k, yaml.ScalarNode) and k.value != "<<"]
            if len(keys) != len(set(keys)):
                raise yaml.constructor.ConstructorError(None, None, "duplicated mapping key", node.start_mark)
            return super().construct_mapping(node, deep=deep)

    for name, pattern, first in _CORE_TYPES:
        TemplateLoader.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(pattern), list(first))
    TemplateLoader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: _integer(node.value))

    def construct(loader, suffix, node):
        if suffix not in TAGS:
            raise yaml.constructor.ConstructorError(None, None, f"unknown tag !{suffix}", node.start_mark)
        if isinstance(node, yaml.ScalarNode):
            value = loader.construct_scalar(node)
        elif isinstance(node, yaml.SequenceNode):
            value = loader.construct_sequence(node, deep=True)
        else:
            value = loader.construct_mapping(node, deep=True)
        if not keep_function_names:
            return value
        return {suffix if suffix in ("Ref", "Condition") else f"Fn::{suffix}": value}

    TemplateLoader.add_multi_constructor("!", construct)
    return TemplateLoader


def _integer(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    digits = text.lstrip("+-")
    return sign * int(digits, {"0o": 8, "0x": 16}.get(digits[:2], 10))


_LOADERS: dict[bool, Any] = {}


def load_template(text: str, keep_function_names: bool = False) -> Any:
    """The parsed document, or None when it is not valid."""
    if yaml is None:
        raise RuntimeError("reading templates needs PyYAML")
    if keep_function_names not in _LOADERS:
        _LOADERS[keep_function_names] = _loader(keep_function_names)
    try:
        return yaml.load(text, Loader=_LOADERS[keep_function_names])  # noqa: S506 - a safe loader
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def scalar_text(value: Any) -> str:
    """A value as script text: lists joined, whole floats without a point."""
    if isinstance(value, list):
        return ", ".join("" if v is None else scalar_text(v) for v in value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return str(int(value))
    if isinstance(value, dict):
        return "[object Object]"
    return "null" if value is None else str(value)
