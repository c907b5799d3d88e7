"""Read-only SQL, decided twice before anything runs: by the parsed text, and by the plan that analysis makes of it."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from typing import Any

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

#: Logical plans of queries as the parser makes them. Commands are none of them; they run as soon as spark.sql() sees
#: them, so the text is parsed first.
QUERY_PLANS = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Limit Offset Union Distinct Deduplicate Intersect Except Window "
    "WithWindowDefinition Generate SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedHaving UnresolvedWith WithCTE "
    "CTERelationDef CTERelationRef UnresolvedWithCTERelations UnionLoop UnresolvedTableValuedFunction UnresolvedInlineTable LocalRelation "
    "OneRowRelation Range Pivot UnresolvedPivot Unpivot UnresolvedUnpivot Expand Sample ResolvedHint UnresolvedHint NameParameterizedQuery PosParameterizedQuery".split()
)
#: Logical plans of queries after analysis. Files, tables and lists of rows from outside are none of them; they stand below the graph's own views.
ANALYSED_PLANS = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Union Distinct Deduplicate Intersect Except Window Generate "
    "SubqueryAlias WithCTE CTERelationDef CTERelationRef UnionLoop UnionLoopRef LocalRelation OneRowRelation Range Pivot Unpivot Expand Sample ResolvedHint".split()
)
#: Built-in functions that run code of the caller's choice, show where data lies, or end the query.
UNSAFE = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length raise_error assert_true".split())
#: Functions that may stand for a table.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer json_tuple stack variant_explode variant_explode_outer".split())
#: Expressions of UNSAFE, and of functions that the session has registered.
UNSAFE_EXPRESSIONS = frozenset("CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength RaiseError AssertTrue PythonUDTF UnresolvedPolymorphicPythonUDTF".split())
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


class NotReadOnly(ValueError):
    """The text is not a query."""


def _parts(found: Any) -> list[Any]:
    """A Scala sequence as a list."""
    return [found.apply(i) for i in range(found.length())]


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _known(spark: SparkSession, name: list[str], table: bool) -> bool:
    """Whether a name is that of a safe built-in function, as this session would resolve it."""
    if len(name) != 1 or name[0].lower() in UNSAFE or table and name[0].lower() not in TABLE_FUNCTIONS:
        return False
    state, jvm = spark._jsparkSession.sessionState(), spark._jvm
    key = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name[0].lower())
    registry = state.tableFunctionRegistry() if table else state.functionRegistry()
    if not table and not registry.functionExists(key):  # explode and its like, in a list of columns
        registry = state.tableFunctionRegistry()
    if not registry.functionExists(key):
        return False
    info = registry.lookupFunction(key)
    return info.isDefined() and info.get().getSource() == "built-in"


def _expressions(spark: SparkSession, plan: Any) -> Iterator[Any]:
    """All expressions of a plan's node. Of one that stands for another, what it was called with, not what stands in."""
    gateway, todo = spark._sc._gateway, _parts(plan.expressions())
    while todo:
        e = todo.pop()
        yield e
        stands_in = is_instance_of(gateway, e, f"{_EXPRESSIONS}InheritAnalysisRules")
        todo += _parts(e.parameters()) if stands_in else _parts(e.children())


def _subplan(spark: SparkSession, e: Any) -> list[Any]:
    return [e.plan()] if is_instance_of(spark._sc._gateway, e, f"{_EXPRESSIONS}SubqueryExpression") else []


def check(spark: SparkSession, text: str, views: Collection[str] = ()) -> None:
    """Raise NotReadOnly unless every node of the parsed plan is one of a query, every relation one of `views` or of
    the query's own names, and every function a built-in one that runs no code of the caller's. A name that is computed,
    as IDENTIFIER() does, is none."""
    allowed = {v.lower() for v in views}
    plans, used, functions = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)], [], []
    while plans:
        plan = plans.pop()
        kind = _kind(plan)
        if kind not in QUERY_PLANS:
            raise NotReadOnly(f"{kind} is not allowed in a read-only query")
        if kind == "UnresolvedRelation":
            used.append(_parts(plan.multipartIdentifier()))
        elif kind == "UnresolvedTableValuedFunction":
            functions.append((_parts(plan.name()), True))
        elif kind == "UnresolvedWith":
            for named in _parts(plan.cteRelations()):
                allowed.add(named._1().lower())
                plans.append(named._2())
        plans += [p for found in (plan.children(), plan.innerChildren()) for p in _parts(found)]
        for e in _expressions(spark, plan):
            kind = _kind(e)
            if "UnresolvedIdentifier" in kind:
                raise NotReadOnly("IDENTIFIER() is not allowed in a read-only query")
            if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
                functions.append((_parts(e.nameParts()) if kind == "UnresolvedFunction" else [e.name().funcName()], False))
            plans += _subplan(spark, e)
    for name in used:
        if len(name) != 1 or name[0].lower() not in allowed:
            raise NotReadOnly(f"{'.'.join(name)} is not a table of the graph")
    for name, table in functions:
        if not _known(spark, name, table):
            raise NotReadOnly(f"{'.'.join(name)} is not an allowed function")


def check_analysed(spark: SparkSession, df: DataFrame, views: Collection[str] = ()) -> None:
    """Raise NotReadOnly unless the analysed plan of a query, down to the graph's own views, is made of the nodes of
    queries and of Spark's own expressions. Names no longer count here, only what they were found to be."""
    allowed = {v.lower() for v in views}
    plans = [df._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        kind = _kind(plan)
        if kind == "View":
            name = plan.desc().identifier()
            if name.database().isDefined() or name.table().lower() not in allowed or not plan.isTempView():
                raise NotReadOnly(f"{name.unquotedString()} is not a table of the graph")
            continue
        if kind not in ANALYSED_PLANS:
            raise NotReadOnly(f"{kind} is not allowed in a read-only query")
        plans += [p for found in (plan.children(), plan.innerChildren()) for p in _parts(found)]
        for e in _expressions(spark, plan):
            own = is_instance_of(spark._sc._gateway, e, f"{_EXPRESSIONS}UserDefinedExpression")
            if own or _kind(e) in UNSAFE_EXPRESSIONS or not e.getClass().getName().startswith(_EXPRESSIONS):
                raise NotReadOnly(f"{_kind(e)} is not allowed in a read-only query")
            plans += _subplan(spark, e)


def read_only(spark: SparkSession, text: str, args: dict[str, Any] | list[Any] | None = None, views: Collection[str] = ()) -> DataFrame:
    """Run a query over `views` with bound parameters; anything else is refused. spark.sql() analyses a query and runs
    nothing of it."""
    check(spark, text, views)
    found = spark.sql(text, args=args or None)
    check_analysed(spark, found, views)
    return found
