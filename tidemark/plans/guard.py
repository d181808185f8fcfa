"""Guarded SQL on Catalyst's own plans: the only module that touches the session's JVM parser and analyzer.

A statement is parsed once, by the parser that will run it; what is walked is that tree, as JSON, subqueries and common table expressions
included. Everything is allow-listed: plan nodes, functions, relation names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import Refused

MAX_TEXT = 20_000
#: Plan nodes and parts of a single read-only statement, as the parser names them.
NODES = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition",
    "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Generate", "Sample",
}
PARTS = {"UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedFunction", "UnresolvedOrdinal", "UnresolvedExtractValue", "UnresolvedGenerator", "UnresolvedWindowExpression", "MultiAlias", "UnresolvedSubqueryPlan"}
COMBINE_NODES = NODES - {"LateralJoin", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "Generate", "Sample"}
#: Functions of combine: counts, aggregates, windows, scalars.
COUNTS = {"count", "count_if", "approx_count_distinct"}
AGGREGATES = {"sum", "avg", "mean", "min", "max", "median", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "any_value"}
WINDOWS = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
SCALARS = {
    "abs", "round", "floor", "ceil", "ceiling", "sign", "signum", "sqrt", "pow", "power", "ln", "log", "log10", "exp", "coalesce", "nullif", "if", "upper", "lower", "length", "len", "substring", "substr", "trim", "btrim", "ltrim", "rtrim", "concat", "replace", "startswith", "left", "right", "contains",
    "greatest", "least", "date_trunc", "extract", "date_part", "datediff", "date_diff", "date_add", "dateadd", "date_sub", "date_format", "to_date", "to_timestamp", "year", "month", "day", "quarter", "current_date", "in", "like", "not", "and", "or", "between",
}
COMBINE = COUNTS | AGGREGATES | WINDOWS | SCALARS
#: Free SQL on a source may also use these; what reads files, calls classes, or tells about the session is simply not here.
SOURCE = COMBINE | {
    "percentile", "percentile_cont", "percentile_disc", "percentile_approx", "array", "explode", "sequence", "range", "regexp_replace", "regexp_extract", "regexp_like", "rlike", "regexp", "regexp_count", "split", "lpad", "rpad", "initcap", "reverse", "repeat", "position", "locate", "instr", "concat_ws", "unix_timestamp",
    "unix_seconds", "from_unixtime", "now", "current_timestamp", "last_day", "add_months", "months_between", "weekday", "dayofweek", "dayofmonth", "dayofyear", "weekofyear", "hour", "minute", "second", "make_date", "trunc", "grouping", "grouping_id", "rollup", "cube", "first", "last", "corr", "covar_pop", "covar_samp",
    "bool_and", "bool_or", "every", "some", "max_by", "min_by", "mod", "pmod", "div", "cbrt", "sin", "cos", "tan", "radians", "degrees", "pi", "char_length", "ilike", "ifnull", "nvl", "isnull", "isnotnull", "isnan", "size", "array_contains", "get_json_object", "json_array_length", "format_string", "format_number", "ascii", "chr", "md5", "sha2", "timestampdiff", "timestampadd",
}


def parse(spark: SparkSession, text: object) -> list:
    """The parsed plan as JSON; text that isn't one statement is refused."""
    if not isinstance(text, str) or not text.strip() or len(text) > MAX_TEXT or "\0" in text:
        raise Refused("invalid_sql", f"SQL is a text of 1..{MAX_TEXT} characters")
    try:
        return json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().removesuffix(";")).toJSON())
    except Exception as e:  # noqa: BLE001  the parser's own errors come over the gateway
        raise Refused("invalid_sql", str(e).strip().splitlines()[0][:300]) from None


def nodes(value: object) -> Iterator[dict]:
    """Every plan or expression node, however deep in fields of other nodes: subqueries, common table expressions, lateral sides."""
    if isinstance(value, dict):
        if "class" in value:
            yield value
        for v in value.values():
            yield from nodes(v)
    elif isinstance(value, list):
        for v in value:
            yield from nodes(v)


def parts_of(value: object) -> list[str]:
    """A multi-part name. A part that itself holds a comma reads as two, which only ever refuses more."""
    return [x.strip() for x in str(value).removeprefix("[").removesuffix("]").split(",")]


def check(spark: SparkSession, text: object, tables: set[str], functions: set[str] = SOURCE, allowed: set[str] = NODES, recursive: bool = True) -> str:
    """The statement without its semicolon, if every node, function and relation of it is allowed."""
    found = [*nodes(parse(spark, text))]
    known = {t.lower() for t in tables}
    for n in found:
        if n["class"].endswith(".UnresolvedWith"):
            known |= {str(c["_1"]).lower() for c in n["cteRelations"]}
            if n.get("allowRecursion") and not recursive:
                raise Refused("sql_not_allowed", "recursive queries are not allowed here")
    for n in found:
        package, _, kind = n["class"].removesuffix("$").rpartition(".")
        if not package.endswith(".catalyst.expressions") and ".catalyst.expressions." not in package and kind not in allowed | PARTS:
            raise Refused("sql_not_allowed", f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            name = parts_of(n["multipartIdentifier"])
            if len(name) != 1:
                raise Refused("sql_not_allowed", "tables are plain names; files, catalogs and schemas are not")
            if name[0].lower() not in known:
                raise Refused("invalid_sql", f"unknown table {name[0][:60]!r}; there are {sorted(tables)[:20]}")
        elif kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
            name = ".".join(parts_of(n.get("nameParts", n.get("name")))).lower()
            if name not in functions:
                raise Refused("sql_not_allowed", f"function {name[:60]!r} is not allowed")
    return text.strip().removesuffix(";")


def relations(spark: SparkSession, text: str, tables: set[str]) -> set[str]:
    """Which of the tables a checked statement names, wherever in it."""
    named = {parts_of(n["multipartIdentifier"])[0].lower() for n in nodes(parse(spark, text)) if n["class"].endswith(".UnresolvedRelation")}
    return {t for t in tables if t.lower() in named}


def tree(flat: list) -> dict:
    """The nested form of a tree that toJSON lists in pre-order."""
    rest = iter(flat)

    def one() -> dict:
        node = dict(next(rest))
        node["children"] = [one() for _ in range(node["num-children"])]
        node["kind"] = node["class"].removesuffix("$").rpartition(".")[2]
        return node

    return one()


def analyzed(df: DataFrame) -> dict:
    """The analyzed plan as a tree of JSON nodes."""
    return tree(json.loads(df._jdf.queryExecution().analyzed().toJSON()))


def session_view(session: SparkSession, alias: str, df: DataFrame) -> None:
    """Make a frame of another session visible in this one under a name; the plan is shared, nothing is computed."""
    datasets = getattr(session.sparkContext._jvm.org.apache.spark.sql.classic, "Dataset$")
    getattr(datasets, "MODULE$").ofRows(session._jsparkSession, df._jdf.queryExecution().logical()).createOrReplaceTempView(alias)
