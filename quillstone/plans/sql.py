"""SQL over registered tables: guarded execution, previews and reports."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CATALYST = "org.apache.spark.sql.catalyst"
_WRITES = (f"{_CATALYST}.plans.logical.Command", f"{_CATALYST}.plans.logical.ParsedStatement")
#: Groups of built-in functions that compute values from their arguments and nothing else.
_GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "date_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs",
    "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "table_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
)
_ALSO = frozenset({"typeof", "uuid", "version", "monotonically_increasing_id", "equal_null", "aes_decrypt", "aes_encrypt", "try_aes_decrypt", "bitmap_bucket_number", "assert_true", "raise_error"})
#: Nodes and expressions that run code or name relations at run time, by parts of their class names.
_RUNS = ("ExecuteImmediate", "Reflection", "Reflect", "UDF", "UDAF", "UDTF", "UserDefined", "ApplyFunction", "Script", "Compound", "UnresolvedIdentifier", "NameParameterizedQuery", "MapPartitions", "FlatMapGroups")


class Refused(ValueError):
    """A statement that does more than read registered tables."""


def functions(spark: SparkSession) -> frozenset[str]:
    """Names of the built-in functions that statements may call."""
    registry = getattr(spark._jvm, "org.apache.spark.sql.catalyst.analysis.FunctionRegistry$").__getattr__("MODULE$")
    tables = getattr(spark._jvm, "org.apache.spark.sql.catalyst.analysis.TableFunctionRegistry$").__getattr__("MODULE$")
    out = set(_ALSO)
    for known in (registry, tables):
        found = known.builtin().listFunction()
        for k in range(found.size()):
            info = known.builtin().lookupFunction(found.apply(k)).get()
            if info.getGroup() in _GROUPS or not info.getGroup() and known is tables and info.getName() == "range":
                out.add(found.apply(k).funcName().lower())
    return frozenset(out - {"reflect", "java_method", "try_reflect"})


_known: dict[int, frozenset[str]] = {}


def _allowed(spark: SparkSession) -> frozenset[str]:
    key = id(spark._jvm)
    if key not in _known:
        _known[key] = functions(spark)
    return _known[key]


def _seq(s: Any) -> Iterator[Any]:
    for k in range(s.size()):
        yield s.apply(k)


def _nodes(spark: SparkSession, plan: Any) -> Iterator[tuple[Any, bool]]:
    """(node, whether it is a plan) of a plan at any depth: children, named subqueries, expressions and the plans within them.

    What is below a registered view is the affair of who registered it.
    """
    within = spark._jvm.java.lang.Class.forName(f"{_CATALYST}.expressions.PlanExpression")
    todo = [(plan, True)]
    while todo:
        node, is_plan = todo.pop()
        yield node, is_plan
        kind = node.getClass().getSimpleName()
        if is_plan and kind == "View":
            continue
        todo += [(c, is_plan) for c in _seq(node.children())]
        if kind == "UnresolvedWith":
            todo += [(c, True) for c in _seq(node.innerChildren())]
        if is_plan:
            todo += [(e, False) for e in _seq(node.expressions())]
        elif within.isInstance(node):
            todo.append((node.plan(), True))


def check(spark: SparkSession, text: str, names: Iterable[str] | None = None, args: Any = None) -> None:
    """Raises Refused unless a statement only reads registered tables by functions that compute and nothing else.

    names: the tables it may read; None stands for every temporary view and every table of the catalog. Looked at are
    the parsed plan, before anything is resolved, and the analysed one, both at any depth. Refused are commands,
    writes, files named as relations, functions of programs (reflect, java_method, registered ones), scripts and names made at run time.
    """
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(k) for k in _WRITES]
    allowed, registered = _allowed(spark), None if names is None else {n.lower() for n in names}

    def refuse_runs(node: Any) -> None:
        name = node.getClass().getName()
        if any(k.isInstance(node) for k in kinds) or "InsertInto" in name or any(r in name.rsplit(".", 1)[-1] for r in _RUNS):
            raise Refused(f"only statements that read are allowed, not {node.getClass().getSimpleName()}")

    relations, own = [], set()
    for node, is_plan in _nodes(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
        refuse_runs(node)
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relations.append(list(_seq(node.multipartIdentifier())))
        elif kind == "UnresolvedWith":
            own |= {c._1().lower() for c in _seq(node.cteRelations())}
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            parts = list(_seq(node.name().nameParts() if kind == "UnresolvedGenerator" else node.nameParts() if kind == "UnresolvedFunction" else node.name()))
            if len(parts) != 1 or parts[0].lower() not in allowed:
                raise Refused(f"the function {'.'.join(parts)} is not allowed")
    for parts in relations:
        name = ".".join(parts)
        if len(parts) == 1 and name.lower() in own:
            continue
        if name.lower() not in registered if registered is not None else not spark.catalog.tableExists(".".join(f"`{p}`" for p in parts)):
            raise Refused(f"{name} is no registered table")
    plan = spark.sql(text, args=args)._jdf.queryExecution().analyzed()
    for node, is_plan in _nodes(spark, plan):
        refuse_runs(node)
        if is_plan and node.getClass().getSimpleName() == "LogicalRelation" and node.catalogTable().isEmpty():
            raise Refused("files can't be read by their names")


def is_query(spark: SparkSession, text: str) -> bool:
    """Whether a statement passes the check; one that can't be parsed or resolved is an error."""
    try:
        check(spark, text)
    except Refused:
        return False
    return True


def query(spark: SparkSession, text: str, args: dict[str, Any] | list | None = None, *, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of one reading statement with bound parameters; anything else is refused. With tables, these are all it may read."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    check(spark, text, tables, args)
    return spark.sql(text, args=args)


def statements(text: str) -> list[str]:
    """Statements that end with a semicolon at the end of a line."""
    return [s.strip() for s in re.split(r";[ \t]*(?:\n|$)", text) if s.strip()]


def execute(spark: SparkSession, text: str, args: dict[str, Any] | list | None = None) -> int:
    """Runs statements one after the other, each with the same parameters; how many there were."""
    found = statements(text)
    for s in found:
        spark.sql(s, args=args)
    return len(found)


def preview(df: DataFrame, rows: int = 9) -> DataFrame:
    """The head of a result: a header and nine rows make ten lines."""
    return df.limit(rows)


def numbers_to_double(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of numbers of any kind as double, but for those to keep."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "decimal")
    return df.select(*[F.col(c).cast("double").alias(c) if c not in keep and kind.startswith(numeric) else F.col(c) for c, kind in df.dtypes])


def columns_of(df: DataFrame) -> list[dict[str, Any]]:
    """Name, type and whether null is allowed, of each column in order."""
    return [{"cid": k, "name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for k, f in enumerate(df.schema.fields)]


def markdown(df: DataFrame, rows: int = 9) -> str:
    """The preview as a markdown table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "|".join(" --- " for _ in df.columns) + "|"
    body = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in preview(df, rows).collect()]
    return "\n".join([head, *body])
