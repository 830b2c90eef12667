"""JSON, map and vector scalars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(path: str) -> str:
    """'a/b/0' as a JSON path."""
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else f".{p}" for p in path.split("/"))


def get(json: Column, path: str, default: str | None = None) -> Column:
    """The value at a slash path as text, or the default; a leading '!' makes a missing value an error."""
    strict = path.startswith("!")
    found = F.get_json_object(json, json_path(path.removeprefix("!")))
    if strict:
        return F.coalesce(found, F.raise_error(F.lit(f"no value at {path[1:]}")))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def lower_keys(column: Column) -> Column:
    """A map with its keys in lower case; of keys that become equal the first stays."""
    entries = F.map_entries(column)
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(low, lambda e, i: F.array_position(F.transform(low, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def get_ignoring_case(json: Column, path: str, default: str | None = None) -> Column:
    """get() on flat objects, whatever the case of the keys."""
    found = json
    for part in path.split("/"):
        if re.fullmatch(r"\d+", part):
            found = F.get_json_object(found, f"$[{part}]")
        else:
            found = lower_keys(F.from_json(found, "map<string,string>")).getItem(part.lower())
    return F.coalesce(found, F.lit(default)) if default is not None else found


def json_date(value: Column) -> Column:
    """TIMESTAMP of /Date(n)/, n being milliseconds from twelve characters on; null for all else."""
    s = F.regexp_extract(value, r"^/Date\((-?\d{1,17})\)/", 1)
    n = s.try_cast("bigint")
    return F.when(F.length(s) >= 12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)
