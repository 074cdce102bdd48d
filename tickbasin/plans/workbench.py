"""SQL workbench: read-only queries over the registered views, with a row limit.

The statement is parsed, not searched for words, and everything in its plan must
be on a list: the kinds of nodes and of expressions, the tables (temporary views
and the query's own named parts, no paths) and the functions, in named windows
too.  What no list names does not run.  The analysed plan is looked at as well,
outside the views themselves: it may hold no relation but theirs, and nothing
that calls methods by name or runs user code.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import BadRequest

MOST_ROWS = 10_000
TIMEOUT_S = 30

# Parsed plan nodes of a query.
NODES = frozenset(
    "Project Filter UnresolvedHaving Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith "
    "OneRowRelation UnresolvedInlineTable LocalRelation Generate WithWindowDefinition Window Pivot Unpivot Expand Sample".split()
)
# Parsed expressions of a query.
EXPRESSIONS = frozenset(
    "Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast CreateNamedStruct CurrentRow Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual ILike In InSubquery IntegralDivide "
    "IsNotNull IsNull IsTrue IsFalse IsNotUnknown IsUnknown LambdaFunction LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Multiply MultiAlias Not NotLikeAll NotLikeAny Or RLike Remainder ScalarSubquery SortOrder "
    "SpecifiedWindowFrame Subtract UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable "
    "UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition WindowSpecReference TryEval FunctionTableSubqueryArgumentExpression BaseGroupingSets Cube Rollup GroupingSets".split()
)
# Nodes of an analysed plan below which a view begins, and those that read nothing.
VIEW_NODES, LEAVES = frozenset({"View"}), frozenset("OneRowRelation LocalRelation CTERelationRef".split())
# Functions that a query may call.
FUNCTIONS = frozenset(
    "abs array between array_contains array_distinct array_join array_max array_min array_sort avg bigint boolean cast ceil ceiling coalesce collect_list collect_set concat concat_ws contains corr count count_if cume_dist current_date date "
    "date_add date_diff date_format date_sub date_trunc datediff day dayofweek decimal dense_rank div double element_at endswith exists exp explode explode_outer filter first first_value flatten float floor format_number format_string "
    "from_json from_unixtime get get_json_object greatest hour if ifnull initcap inline instr int isnotnull isnull json_tuple lag last last_value lead least left length ln locate log log10 log2 lower lpad ltrim make_date max max_by mean "
    "median min min_by minute mod month named_struct nanvl now ntile nullif nvl nvl2 percent_rank percentile percentile_approx pmod posexplode posexplode_outer pow power quarter rank regexp_extract regexp_like regexp_replace repeat "
    "replace reverse right round row_number rpad rtrim second sequence sign signum size slice smallint sort_array split sqrt startswith stddev stddev_pop stddev_samp string struct substr substring sum timestamp timestamp_micros "
    "timestamp_millis tinyint to_date to_json to_timestamp transform trim trunc unix_micros unix_millis unix_seconds unix_timestamp upper var_pop var_samp variance weekday when window year".split()
)


def guarded(spark: SparkSession, sql: str, enabled: bool = True) -> DataFrame:
    """The query's DataFrame; anything but a query of the views and the listed functions raises BadRequest."""
    if not enabled:
        raise BadRequest("the workbench is off")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise BadRequest(f"not a query: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
    refused = _refused(plan, {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary})
    if refused:
        raise BadRequest(refused)
    try:
        df = spark.sql(sql)
    except AnalysisException as e:
        raise BadRequest(str(e).splitlines()[0]) from e
    refused = _reaches(df._jdf.queryExecution().analyzed())
    if refused:
        raise BadRequest(refused)
    return df


def _items(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.length()))


def _values(mapping) -> list:
    found = mapping.valuesIterator()
    out = []
    while found.hasNext():
        out.append(found.next())
    return out


def _reaches(plan) -> str | None:
    """Why the analysed plan may not run, or None; what the views hold is not looked at."""
    plans = [plan]
    while plans:
        node = plans.pop()
        kind = _kind(node)
        if kind in VIEW_NODES:
            continue
        below = [*_items(node.children()), *(_items(node.innerChildren()) if kind == "WithCTE" else ())]
        if not below and kind not in LEAVES:
            return f"the query may only read the views, not {kind}"
        plans += below
        todo = list(_items(node.expressions()))
        while todo:
            part = todo.pop()
            kind = _kind(part)
            if "Reflect" in kind or "UDF" in kind:
                return f"the expression {kind} is not allowed"
            if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(part.plan())
            todo += _items(part.children())
    return None


def _kind(node) -> str:
    return node.getClass().getName().rpartition(".")[2].rpartition("$")[2] or node.getClass().getName().rpartition(".")[2].rstrip("$")


def _refused(plan, views: set[str]) -> str | None:
    """Why the parsed plan may not run, or None.

    A part that the query names itself is read wherever the name stands in the
    query; it can only hide a view, not reach anything else.
    """
    names, plans, tables = set(views), [plan], []
    while plans:
        node = plans.pop()
        kind = _kind(node)
        if kind not in NODES:
            return f"only queries are allowed, not {kind}"
        if kind == "UnresolvedRelation":
            tables.append([str(p).lower() for p in _items(node.multipartIdentifier())])
        if kind == "UnresolvedWith":
            for part in _items(node.cteRelations()):
                names.add(str(part._1()).lower())
                plans.append(part._2())
        plans += _items(node.children())
        todo = list(_items(node.expressions()))
        if kind == "WithWindowDefinition":
            todo += _values(node.windowDefinitions())
        while todo:
            part = todo.pop()
            kind = _kind(part)
            if kind not in EXPRESSIONS:
                return f"the expression {kind} is not allowed"
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                called = [str(p).lower() for p in _items(part.nameParts() if kind == "UnresolvedFunction" else part.name().nameParts())]
                if len(called) != 1 or called[0] not in FUNCTIONS:
                    return f"the function {'.'.join(called)} is not allowed"
            if kind == "InSubquery":
                plans.append(part.query().plan())
            elif kind in ("ScalarSubquery", "Exists", "ListQuery", "FunctionTableSubqueryArgumentExpression"):
                plans.append(part.plan())
            todo += _items(part.children())
    for table in tables:
        if len(table) != 1 or table[0] not in names:
            return f"the table {'.'.join(table)} is not one of the views"
    return None


def run(spark: SparkSession, sql: str, most: int = MOST_ROWS, timeout_s: float = TIMEOUT_S, enabled: bool = True) -> dict:
    """Rows, columns, whether rows were cut, and the time taken.

    A job that runs beyond the timeout is cancelled.
    """
    import threading
    import uuid

    df = guarded(spark, sql, enabled)
    began, tag = time.monotonic(), f"workbench-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(timeout_s, spark.interruptTag, [tag])
    timer.start()
    try:
        rows = df.limit(most + 1).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return {
        "columns": [{"name": f.name, "data_type": f.dataType.simpleString()} for f in df.schema.fields], "rows": [list(r) for r in rows[:most]], "row_count": min(len(rows), most), "truncated": len(rows) > most,
        "execution_time_ms": int((time.monotonic() - began) * 1000),
    }
