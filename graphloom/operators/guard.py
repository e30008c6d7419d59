"""Read-only queries over the graph's views, and result caps."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS, MAX_BYTES = 200, 65_536
#: What a query may be made of, by the names of the parser's and the analyzer's plan nodes.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedHaving UnresolvedWith UnresolvedInlineTable UnresolvedSubqueryColumnAliases"
    " WithWindowDefinition Window OneRowRelation LocalRelation WithCTE CTERelationDef CTERelationRef LateralJoin Generate Pivot UnresolvedPivot Unpivot Expand AggregateWithGroupingSets View Range".split()
)
#: Functions that a query may call; all are pure and see only their arguments.
FUNCTIONS = frozenset(
    "abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_position array_sort avg bigint bool_and bool_or boolean bround cardinality cast ceil ceiling char_length"
    " coalesce collect_list collect_set concat concat_ws contains corr cos count count_if cume_dist date date_add date_diff date_sub date_trunc datediff day dense_rank double element_at endswith every exists exp explode filter first first_value"
    " floor from_json get get_json_object greatest hour if ifnull in initcap inline instr int isnan isnotnull isnull lag last last_value lcase lead least left len length levenshtein like ln locate log log10 log2 lower lpad ltrim map map_keys"
    " map_values max max_by md5 mean median min min_by minute mod month named_struct nth_value ntile nullif nvl nvl2 over percent_rank percentile percentile_approx posexplode position pow power quarter rank regexp_count regexp_extract regexp_like"
    " regexp_replace replace reverse right rlike round row_number rpad rtrim second sequence sha1 sha2 sign size slice some sort_array split split_part sqrt startswith std stddev string struct substr substring sum to_date to_json to_timestamp"
    " transform trim try_add try_cast try_divide ucase unix_timestamp upper values var_pop var_samp variance weekday when xxhash64 year zip_with".split()
)
#: Words before a bracket that are no function.
_SYNTAX = frozenset("and or not in as on by using from where having union all except intersect select with values over partition order exists any some case when then else between like join lateral view filter within group sets cube rollup rows range is distinct limit offset tablesample pivot unpivot for struct array map decimal char varchar".split())


class NotReadOnly(ValueError):
    pass


def stripped(query: str) -> str:
    """The query without comments and literals; quoted names become `q`."""
    query = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"", " ", query, flags=re.S)
    return re.sub(r"`(?:[^`]|``)*`", "`q`", query)


def _nodes(plan) -> Iterator:
    """The plan's nodes and those of its subqueries, as the session's JVM has them; what is behind a view isn't looked at."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if node.nodeName() != "View":
            for found in (node.children(), node.innerChildren() if node.nodeName() == "UnresolvedWith" else None, node.subqueries()):
                todo += [found.apply(i) for i in range(found.size())] if found is not None else []


def assert_read_only(query: str, spark: SparkSession | None = None, views: Iterable[str] | None = None) -> None:
    """One SELECT over temporary views, with functions of the list: told by the text's calls and by the parsed and analysed plans.

    views: the names that may be read; the session's temporary views, if None.  Without a session only the text is told.
    """
    bare = stripped(query).strip()
    if ";" in bare:
        raise NotReadOnly("one statement without ';' is allowed")
    if not re.match(r"(?i)\(*\s*(select|with|values)\b", bare):
        raise NotReadOnly("only queries are allowed")
    if "`q`(" in re.sub(r"\s", "", bare):
        raise NotReadOnly("functions are called by plain names")
    called = {name.lower() for name in re.findall(r"([A-Za-z_][\w.]*)\s*\(", bare)}
    aliases = {name.lower() for name in re.findall(r"(?i)(?:\bwith|,)\s*([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?as\s*\(", bare)}
    if bad := sorted(called - FUNCTIONS - _SYNTAX - aliases):
        raise NotReadOnly(f"not among the functions allowed: {', '.join(bad)}")
    if spark is None:
        return
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise NotReadOnly("not a query") from e
    for node in _nodes(parsed):
        if (name := node.nodeName().lstrip("'")) not in NODES:
            raise NotReadOnly(f"not read-only: {name}")
        if name == "UnresolvedRelation" and node.multipartIdentifier().size() != 1:
            raise NotReadOnly("only registered views can be read")
    known = {v.lower() for v in views} if views is not None else {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    for node in _nodes(spark.sql(query)._jdf.queryExecution().analyzed()):
        name = node.nodeName()
        if name not in NODES:
            raise NotReadOnly(f"only registered views can be read, not {name}")
        if name == "View" and not (node.isTempView() and node.desc().identifier().table().lower() in known):
            raise NotReadOnly(f"not a registered view: {node.desc().identifier().table()}")


def run_read_only(spark: SparkSession, query: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, args: dict | None = None, views: Iterable[str] | None = None) -> DataFrame:
    """The query's first rows, in its own order, that fit both caps."""
    text = re.sub(r":(\w+)", lambda m: "NULL" if args and m[1] in args else m[0], query)
    assert_read_only(text, spark, views)
    top = spark.sql(query, args=args or {}).limit(max_rows)
    return _fitting(top.withColumn("_at", F.monotonically_increasing_id()), ["_at"], top.columns, max_bytes).drop("_at")


def _fitting(rows: DataFrame, order: list[str], names: list[str], max_bytes: int) -> DataFrame:
    """rows, which are few, up to max_bytes of JSON, but the first in any case."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sized = rows.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*names))))
    ranked = sized.withColumn("_sum", F.sum("_bytes").over(w)).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return ranked.where((F.col("_n") == 1) | (F.col("_sum") <= max_bytes)).drop("_bytes", "_sum", "_n")


def capped(rows: DataFrame, *order: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The first rows in this order that fit: at most max_rows, and JSON of max_bytes, but the first row in any case.

    The top max_rows are taken before they are summed up in one place, so that place is small whatever the input.
    """
    return _fitting(rows.orderBy(*order).limit(max_rows), list(order), rows.columns, max_bytes)
