"""Layered configuration: files that include others, dotted overrides, dataclasses as schemas."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any, TypeVar

S = TypeVar("S")
INCLUDE = "config"


def names(value: str | Iterable[str] | None) -> list[str]:
    """A list of names; a string is split at commas."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else list(value)
    return [p.strip() for p in parts if p.strip()]


def read_layer(path: str) -> dict[str, Any]:
    """The mapping in a YAML or JSON file. Raises ValueError for anything else, and for YAML where its package isn't installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} needs the yaml package") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def layers(path: str) -> list[dict[str, Any]]:
    """A YAML or JSON file and the files it includes (``config``: a path or a list of paths), weakest first."""
    own = dict(read_layer(path))
    included = own.pop(INCLUDE, None)
    out: list[dict[str, Any]] = []
    for name in names(included):
        out += layers(str(Path(path).parent / name))
    return [*out, own]


def from_dotted(options: Iterable[str]) -> dict[str, Any]:
    """``a.b=1`` options as a nested dictionary; values are JSON where they can be read so, else strings."""
    out: dict[str, Any] = {}
    for option in options:
        key, _, raw = option.partition("=")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def merge(parts: Iterable[dict[str, Any]], replaced: tuple[str, ...] = (), at: str = "") -> dict[str, Any]:
    """Dictionaries on top of each other, the last one strongest; those at ``replaced`` dotted paths aren't merged."""
    out: dict[str, Any] = {}
    for part in parts:
        for key, value in part.items():
            path = f"{at}.{key}".lstrip(".")
            if isinstance(value, dict) and isinstance(out.get(key), dict) and path not in replaced:
                out[key] = merge((out[key], value), replaced, path)
            else:
                out[key] = value
    return out


def parse(schema: type[S], *parts: dict[str, Any]) -> S:
    """An instance of a dataclass from merged layers; unknown keys raise ValueError."""
    values = merge(parts)
    known = {f.name for f in dataclasses.fields(schema)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return schema(**values)
