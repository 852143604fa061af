"""Options of a run: files under the environment under arguments, merged by key."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones; mappings under one key are merged in turn."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
            out[key] = merged(out[key], value) if both else value
    return out


def literal(text: str) -> Any:
    """A value from its text: true, false, null, a number, JSON, or the text itself."""
    low = text.strip().lower()
    if low in ("none", "null"):
        return None
    try:
        return json.loads(low if low in ("true", "false") else text)
    except ValueError:
        return text


def from_environment(variables: Mapping[str, str], prefix: str) -> dict[str, Any]:
    """PREFIX_A__B=c as {a: {b: c}}."""
    out: dict[str, Any] = {}
    for name, value in variables.items():
        if not name.startswith(prefix):
            continue
        *path, last = name[len(prefix) :].lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = literal(value)
    return out
