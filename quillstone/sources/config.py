"""Configuration on the driver: YAML with includes, overlays, environments and paths."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import yaml


def find_path(relative: str, required: bool = True) -> str | None:
    """The file in its folder or, failing that, in the nearest folder above it."""
    folder, name = os.path.split(relative)
    folder = os.path.abspath(folder)
    while True:
        if os.path.exists(path := os.path.join(folder, name)):
            return path
        if (up := os.path.dirname(folder)) == folder:
            break
        folder = up
    if required:
        raise FileNotFoundError(f"no {relative!r} here or in any folder above")
    return None


def _load(path: str) -> Any:
    return yaml.safe_load(Path(path).read_text("utf-8"))


def _include(value: Any) -> Any:
    """Values INCLUDEFILE(name) of mappings replaced by what is in the file; strings in lists stay."""
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, str) and (m := re.match(r"INCLUDEFILE\((.+)\)", v)):
                v = _load(find_path(m[1]))
            value[k] = _include(v)
    elif isinstance(value, list):
        for v in value:
            _include(v)
    return value


def read_yaml(relative: str) -> Any:
    return _include(_load(find_path(relative if relative.endswith(".yaml") else f"{relative}.yaml")))


def read_json(relative: str) -> Any:
    return json.loads(Path(find_path(relative if relative.endswith(".json") else f"{relative}.json")).read_text("utf-8"))


def to_yaml(value: Any) -> str:
    """YAML in which texts of several lines, or of over 70 characters, are blocks."""

    class Dumper(yaml.SafeDumper):
        pass

    def text(dumper: yaml.SafeDumper, s: str):
        return dumper.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s or len(s) > 70 else None)

    Dumper.add_representer(str, text)
    return yaml.dump(value, Dumper=Dumper, sort_keys=False, allow_unicode=True)


def to_json(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x))


def deep_merge(base: dict, over: dict) -> dict:
    """base with the values of over laid on it, mapping by mapping; a falsy value never overrides."""
    for k, v in over.items():
        if v:
            base[k] = deep_merge(base[k], v) if isinstance(base.get(k), dict) and isinstance(v, dict) else v
    return base


def get(value: Any, path: str, default: Any = None, separator: str = "/") -> Any:
    """What stands at a path of keys and numbers, or the default; with a leading '!', a KeyError if there is nothing."""
    strict, path = path.startswith("!"), path.removeprefix("!")
    for part in path.split(separator):
        key: Any = int(part) if re.fullmatch(r"-?\d+", part) else part
        try:
            value = value[key]
        except (KeyError, IndexError, TypeError):
            if strict:
                raise KeyError(f"nothing at {path!r}") from None
            return default
    return value


def get_ignoring_case(value: Any, path: str, default: Any = None, separator: str = "/") -> Any:
    """The same, whatever the case of the keys: the first that fits."""
    for part in path.split(separator):
        if isinstance(value, dict):
            found = [v for k, v in value.items() if str(k).lower() == part.lower()]
            if not found:
                return default
            value = found[0]
        else:
            try:
                value = value[int(part)]
            except (ValueError, IndexError, TypeError):
                return default
    return value


def lower_keys(value: Any) -> Any:
    if isinstance(value, dict):
        return {k.lower() if isinstance(k, str) else k: lower_keys(v) for k, v in value.items()}
    return [lower_keys(v) for v in value] if isinstance(value, list) else value


class Settings:
    """A mapping that is read by paths: s['a.b'], s['a.b', default], s.get('a/b')."""

    def __init__(self, settings: dict):
        self.config = settings

    def g(self, path: str, default: Any = None) -> Any:
        return get(self.config, path, default, ".")

    def get(self, path: str, default: Any = None) -> Any:
        return get(self.config, path, default)

    def __getitem__(self, path: str | tuple[str, Any]) -> Any:
        name, default = path if isinstance(path, tuple) else (path, None)
        found = self.g(name, default)
        return Settings(found) if isinstance(found, dict) else found

    def __iter__(self) -> Iterator[str]:
        return iter(self.config)

    def items(self) -> Iterator[tuple[str, Any]]:
        return ((k, Settings(v) if isinstance(v, dict) else v) for k, v in self.config.items())

    def to_dict(self) -> dict:
        return self.config


def environment(config: dict, variables: dict[str, str] | None = None) -> tuple[str | None, dict | None]:
    """Name and settings of the first environment whose test NAME=value holds; an alias leads to another. None if none does."""
    if "environments" not in config:
        raise ValueError("the configuration has no section 'environments'")
    variables = dict(os.environ) if variables is None else variables
    for name, own in config["environments"].items():
        test = get(own, "test/environment_variable") or ""
        key, equals, value = test.partition("=")
        if equals and variables.get(key) == value:
            alias = own.get("alias")
            return (alias, config["environments"][alias]) if alias else (name, own)
    return None, None


def resolved(config: dict, credentials: dict | None = None, variables: dict[str, str] | None = None) -> tuple[dict, dict | None]:
    """What holds in this environment: credentials laid on the configuration, and its section laid on that for all."""
    config = deep_merge(config, credentials or {})
    name, own = environment(config, variables)
    return deep_merge(dict(get(config, "all") or {}), (config.get(name) or {}) if name else {}), own


def tables_of(config: dict) -> dict[str, dict]:
    """Declared tables by name, wherever the sections 'persistence' and 'tables' wrap them."""
    inner = config.get("persistence") or config
    inner = inner.get("tables") or inner
    if isinstance(inner, list):
        return {t["name"]: t for t in inner}
    return {k: v for k, v in inner.items() if isinstance(v, dict) and "columns" in v}
