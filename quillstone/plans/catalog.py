"""Config-declared tables: types, schema differences, migrations, inserts and upserts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_STRINGS = ("title", "rich_text", "email", "phone_number", "url", "select", "multi_select", "relation", "unique_id", "place", "text", "enum")
TYPES: dict[str, T.DataType] = dict.fromkeys(_STRINGS, T.StringType()) | {
    "number": T.DoubleType(), "real": T.DoubleType(), "checkbox": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "integer": T.LongType(), "blob": T.BinaryType(),
}


def spark_type(declared: str) -> T.DataType:
    """Of a declared type; anything unknown is refused."""
    try:
        return TYPES[declared.lower()]
    except KeyError:
        raise ValueError(f"unknown column type {declared!r}") from None


def struct(table: dict[str, Any]) -> T.StructType:
    """The schema of a declared table; what Spark has no place for goes into the fields' metadata.

    A table without key and without a column named id gets a text column id as its key.
    """
    columns = list(table["columns"])
    if not any(c.get("is_primary_key") or c["name"].lower() == "id" for c in columns):
        columns = [{"name": "id", "type": "text", "is_primary_key": True}, *columns]
    fields = []
    for c in columns:
        needed = bool(c.get("notnull")) or c["type"].lower() == "title"
        kept = {k: v for k, v in c.items() if k in ("is_primary_key", "autoincrement", "unique", "default", "update", "description")}
        fields.append(T.StructField(c["name"], spark_type(c["type"]), not needed, kept))
    return T.StructType(fields)


def ddl(name: str, table: dict[str, Any]) -> str:
    """CREATE TABLE of a declared table."""

    def column(f: T.StructField) -> str:
        note = f.metadata.get("description", "").replace("'", "''")
        return f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" + (f" COMMENT '{note}'" if note else "")

    return f"CREATE TABLE {name} ({', '.join(column(f) for f in struct(table).fields)}) USING parquet"


def differences(tables: dict[str, dict], actual: dict[str, T.StructType]) -> list[tuple[str, str, str]]:
    """(table, column, action) where declaration and catalog differ: create, add or alter; nothing is ever dropped."""
    out = []
    for name, table in tables.items():
        if name not in actual:
            out.append((name, "", "create"))
            continue
        have = {f.name: f.dataType for f in actual[name].fields}
        for f in struct(table).fields:
            if f.name not in have:
                out.append((name, f.name, "add"))
            elif have[f.name] != f.dataType:
                out.append((name, f.name, "alter"))
    return out


def statements(tables: dict[str, dict], actual: dict[str, T.StructType]) -> list[str]:
    """SQL that brings a catalog to the declaration."""
    out = []
    for name, column, action in differences(tables, actual):
        if action == "create":
            out.append(ddl(name, tables[name]))
            continue
        kind = struct(tables[name])[column].dataType.simpleString().upper()
        out.append(f"ALTER TABLE {name} ADD COLUMNS (`{column}` {kind})" if action == "add" else f"ALTER TABLE {name} ALTER COLUMN `{column}` TYPE {kind}")
    return out


def actual_schemas(spark: SparkSession, names: list[str]) -> dict[str, T.StructType]:
    return {n: spark.table(n).schema for n in names if spark.catalog.tableExists(n)}


def migrations(existing: dict[str, str], name: str, tables: dict[str, dict], actual: dict[str, T.StructType]) -> dict[str, str]:
    """Files to write: the whole schema as number 0000, and the difference as the next number if it is new.

    existing: name to text of the files there are. Texts count as equal whatever their case and white space.
    """
    flat = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    out = {f"{name}-0000.sql": ";\n".join(ddl(n, t) for n, t in tables.items()) + ";\n"}
    diff = ";\n".join(statements(tables, actual))
    numbers = {int(m[1]): text for f, text in existing.items() if (m := re.fullmatch(rf"{re.escape(name)}-(\d{{4}})\.sql", f))}
    last = max(numbers, default=0)
    if diff and flat(diff + ";") != flat(numbers.get(last, "")):
        out[f"{name}-{last + 1:04d}.sql"] = diff + ";\n"
    return out


def _value(default: str) -> Column:
    return F.current_timestamp() if default.upper() == "CURRENT_TIMESTAMP" else F.expr(default)


def upsert(target: DataFrame, data: DataFrame, table: dict[str, Any]) -> DataFrame:
    """The target after an upsert of rows, matched on all unique columns together.

    A match takes the given columns, but for ids, generated and unique ones, and those declared update: false: these fall
    back to their default if they have one, else stay. UpdatedAt becomes now. Other rows are added, with
    defaults for what isn't given. Of several rows for one key the last given wins: by order column _seq if there is one,
    else the greatest row. A key with a null matches nothing.
    """
    columns = {c["name"]: c for c in table["columns"]}
    keys = [n for n, c in columns.items() if c.get("unique")]
    if not keys:
        raise ValueError("an upsert needs a unique column")
    given = [c for c in data.columns if c in columns and not columns[c].get("autoincrement")]
    order = F.col("_seq") if "_seq" in data.columns else F.struct(*given)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(order.desc())
    rows = data.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == 1) | ~whole).select(*[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_given"))
    old = target.withColumn("_there", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_new_{k}"))
    both = old.join(rows, on, "full_outer")
    matched, added = F.col("_there").isNotNull() & F.col("_given").isNotNull(), F.col("_there").isNull()

    def result(f: T.StructField) -> Column:
        c, new = columns.get(f.name, {}), F.col(f"_new_{f.name}") if f.name in given else None
        kept, default = F.col(f.name), _value(str(c["default"])) if c.get("default") else None
        fresh = new if new is not None else (default if default is not None else F.lit(None))
        if f.name == "UpdatedAt":
            update = F.current_timestamp()
        elif f.name.lower() == "id" or c.get("autoincrement") or c.get("unique"):
            update = kept
        elif c.get("update", True):
            update = new if new is not None else kept
        else:
            update = default if default is not None else kept
        return F.when(matched, update).when(added, fresh).otherwise(kept).cast(f.dataType).alias(f.name)

    return both.select(*[result(f) for f in target.schema.fields])


def insert(target: DataFrame, data: DataFrame, table: dict[str, Any]) -> DataFrame:
    """The rows to append: generated columns left out, refused if a unique value is there already or comes twice.

    Each unique column is a constraint of its own here, as in a database; upsert() takes all of them together, as its key.
    """
    columns = {c["name"]: c for c in table["columns"]}
    rows = data.select(*[c for c in data.columns if not columns.get(c, {}).get("autoincrement")])
    for name, c in columns.items():
        if c.get("unique") and name in rows.columns:
            own = rows.where(F.col(name).isNotNull()).select(name)
            twice = own.groupBy(name).count().where("count > 1").select(name)
            if not own.join(target.select(name), name, "left_semi").union(twice).isEmpty():
                raise ValueError(f"a value of the unique column {name!r} exists already")
    return rows
