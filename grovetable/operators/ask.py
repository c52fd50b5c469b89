"""Questions in SQL over one table, and nothing else.

The text is parsed, not run, and the tree is held against lists of what is allowed: relations are ``df`` and the
query's own WITH names, plan nodes are those of a SELECT, and functions are named ones of plain computation. Files,
catalogue tables, table functions, Java calls and session settings are thus out, whatever way they are written.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame

#: Nodes of a parsed SELECT.
PLANS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedHaving OneRowRelation$ UnresolvedInlineTable Join Union Except Intersect WithWindowDefinition Pivot Unpivot UnresolvedOrdinal".split()
)
#: Functions of plain computation.
FUNCTIONS = frozenset(
    """abs acos any any_value approx_count_distinct array array_contains array_distinct array_join array_max array_min array_position array_sort ascii asin atan avg between bool_and bool_or bround btrim case cast cbrt ceil ceiling char_length
    coalesce collect_list collect_set concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank degrees div
    double element_at endswith every exp extract first first_value float floor format_number greatest hour histogram_numeric if ifnull initcap instr int bigint isnan isnotnull isnull kurtosis lag last last_value last_day lcase lead least left len length levenshtein like
    ln locate log log10 log2 lower lpad ltrim make_date max max_by mean median min min_by minute mod mode month months_between named_struct nanvl negative next_day now nth_value ntile nullif nvl nvl2 octet_length percent_rank percentile percentile_approx percentile_cont percentile_disc pmod position positive pow power
    quarter radians rank regexp_count regexp_extract regexp_like regexp_replace regr_slope replace reverse right rlike round row_number rpad rtrim second sign signum sin size skewness some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum tan
    timestamp to_date to_timestamp translate trim trunc try_add try_avg try_cast try_divide try_element_at try_multiply try_subtract try_sum try_to_date typeof ucase unix_date upper var_pop var_samp variance weekday weekofyear when width_bucket year
    % & * + - / < <= <=> = == > >= ^ | ~ ! and or not in""".split()
)
#: Expressions that reach beyond a row's values whatever the function: refused by class.
REFUSED = ("ScalaUDF", "PythonUDF", "CallMethodViaReflection", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedGenerator", "NamedParameter", "PosParameter", "UnresolvedIdentifier", "CurrentUser", "SessionUser", "InputFileName", "ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "VariableReference")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _names(parts) -> str:
    return ".".join(str(x) for x in _items(parts)).lower()


def _check_expression(e, known: set[str]) -> None:
    kind = e.getClass().getSimpleName()
    if kind in REFUSED:
        raise ValueError(f"not allowed: {kind}")
    if kind == "UnresolvedFunction":
        name = _names(e.nameParts())
        if name not in FUNCTIONS:
            raise ValueError(f"function not allowed: {name}")
    if "SubqueryExpression" in [c.getSimpleName() for c in _parents(e)]:
        _check_plan(e.plan(), known)
    for child in _items(e.children()):
        _check_expression(child, known)


def _parents(node) -> list:
    out, kind = [], node.getClass()
    while kind is not None:
        out.append(kind)
        kind = kind.getSuperclass()
    return out


def _check_plan(plan, known: set[str]) -> None:
    kind = plan.getClass().getSimpleName()
    if kind not in PLANS:
        raise ValueError(f"only a SELECT over df is allowed, not {kind}")
    if kind == "UnresolvedRelation":
        if plan.isStreaming() or _names(plan.multipartIdentifier()) not in known:
            raise ValueError(f"only df can be read, not {_names(plan.multipartIdentifier())}")
    if kind == "UnresolvedWith":
        if plan.allowRecursion():
            raise ValueError("a recursive WITH is not allowed")
        names = set(known)
        for relation in _items(plan.cteRelations()):
            _check_plan(relation._2(), names)
            names.add(str(relation._1()).lower())
        known = names
    for e in _items(plan.expressions()):
        _check_expression(e, known)
    for child in _items(plan.children()):
        _check_plan(child, known)


def check_sql(spark, sql: str) -> None:
    """Raise ValueError unless ``sql`` is one SELECT over ``df`` of allowed parts."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError("not a SELECT that can be read") from e
    _check_plan(plan, {"df"})


def _check_analyzed(plan) -> None:
    """Names without parentheses can turn out to be session values or variables when they are resolved. What ``df`` itself is made of, below its view, is not looked at."""
    if plan.getClass().getSimpleName() == "View":
        return
    for e in _items(plan.expressions()):
        _check_resolved(e)
    for child in _items(plan.children()):
        _check_analyzed(child)


def _check_resolved(e) -> None:
    kind = e.getClass().getSimpleName()
    if kind in REFUSED:
        raise ValueError(f"not allowed: {kind}")
    if "SubqueryExpression" in [c.getSimpleName() for c in _parents(e)]:
        _check_analyzed(e.plan())
    for child in _items(e.children()):
        _check_resolved(child)


def ask_sql(df: DataFrame, sql: str, rows: int = 20) -> DataFrame:
    """The answer to one SELECT over the table ``df``, at most ``rows`` rows. Anything else is refused with ValueError.

    The session is left as it was: the table is known under a name of its own while the query is read, and no view called df is made.
    """
    spark = df.sparkSession
    check_sql(spark, sql)
    name = f"asked_{uuid.uuid4().hex}"
    word, rest = sql.strip().split(None, 1) if sql.strip().lower().startswith("with") and not sql.strip()[4:5].isalnum() else ("", sql)
    df.createTempView(name)
    try:
        answer = spark.sql(f"WITH df AS (SELECT * FROM {name}){', ' if word else ' '}{rest}")
        _check_analyzed(answer._jdf.queryExecution().analyzed())
        return answer.limit(rows)
    finally:
        spark.catalog.dropTempView(name)


def ask_rows(df: DataFrame, sql: str, rows: int = 20, seconds: float = 10.0) -> list:
    """The rows of ``ask_sql``, or TimeoutError after ``seconds``, when its jobs are cancelled."""
    spark, tag, late = df.sparkSession, f"ask-{uuid.uuid4().hex}", threading.Event()
    answer = ask_sql(df, sql, rows)

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        return answer.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
