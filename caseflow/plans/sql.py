"""Guarded read-only ad-hoc SQL over the fact views (Q16).

A query runs in a session of its own that knows the given views and nothing else of the
caller's: no temporary views, functions or variables. Spark's parser and analyser decide
what may pass, by lists of what is allowed:

* the parsed text may consist of the plan nodes of queries only (``NODES``) and of
  built-in functions by their plain names, so commands, ``IDENTIFIER(...)``,
  ``EXECUTE IMMEDIATE`` and scripts end before anything is resolved;
* in the analysed plan every leaf must lie within one of the given views or hold values
  that the query itself states.

Words in the text play no part, so ``REPLACE()`` and literals with semicolons are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Nodes of queries, before and after analysis.
NODES = frozenset({
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate",
    "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot",
    "Project", "RebalancePartitions", "Repartition", "RepartitionByExpression", "ResolvedInlineTable", "Sample", "Sort",
    "SubqueryAlias", "Union", "Unpivot", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "View", "Window", "WithCTE",
    "WithWindowDefinition"})
#: Leaves that hold values of the query's own.
VALUES = frozenset({"CTERelationRef", "LocalRelation", "OneRowRelation", "ResolvedInlineTable"})
#: Built-in functions that call into the JVM, read files, or tell about the session and its machine.
REFUSED_FUNCTIONS = frozenset({
    "assert_true", "current_catalog", "current_database", "current_schema", "current_user", "from_avro", "from_protobuf",
    "input_file_block_length", "input_file_block_start", "input_file_name", "java_method", "raise_error", "reflect",
    "session_user", "to_avro", "to_protobuf", "try_reflect", "user", "version"})
#: Table functions that only unfold values of the query itself.
TABLE_FUNCTIONS = frozenset({"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"})
#: Expressions that name what they call only when the query is analysed, or that run other code.
REFUSED_EXPRESSIONS = frozenset({"CallMethodViaReflection", "ExpressionWithUnresolvedIdentifier", "FunctionTableSubqueryArgumentExpression",
                                 "NamedParameter", "PosParameter", "PythonUDAF", "PythonUDF", "ScalaAggregator", "ScalaUDAF", "ScalaUDF",
                                 "TryReflect", "VariableReference"})
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"


class QueryRejected(ValueError):
    """The SQL text or the relations it reads are not allowed."""


def _items(seq: JavaObject) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Guard:
    """Walks a plan and raises where it meets what is not allowed."""

    def __init__(self, spark: SparkSession, views: frozenset[str]):
        jvm = spark._jvm
        self.views = views
        self.subquery = jvm.java.lang.Class.forName(f"{_EXPRESSIONS}.SubqueryExpression")
        found = jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
        self.functions = {f.funcName().lower() for f in _items(found)} - REFUSED_FUNCTIONS

    def plan(self, node: JavaObject, analysed: bool) -> None:
        kind = _kind(node)
        if kind not in NODES:
            raise QueryRejected(f"only queries over the views may run, not {kind}")
        if kind == "View":
            named = node.desc().identifier()
            if not node.isTempView() or named.database().isDefined() or named.table().lower() not in self.views:
                raise QueryRejected(f"{named} is not one of the views {', '.join(sorted(self.views))}")
            return          # what a given view reads is its owner's choice
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_items(node.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise QueryRejected(f"the table function {name} may not be used")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                self.plan(pair._2(), analysed)
        children = list(_items(node.children()))
        if analysed and not children and kind not in VALUES:
            raise QueryRejected(f"{kind} is not one of the views {', '.join(sorted(self.views))}")
        for child in children:
            self.plan(child, analysed)
        for expression in _items(node.expressions()):
            self.expression(expression, analysed)

    def expression(self, node: JavaObject, analysed: bool) -> None:
        kind = _kind(node)
        if kind in REFUSED_EXPRESSIONS:
            raise QueryRejected(f"{kind} may not be used")
        if kind == "UnresolvedFunction":
            name = ".".join(_items(node.nameParts())).lower()
            if name not in self.functions:
                raise QueryRejected(f"the function {name} may not be used")
        if self.subquery.isInstance(node):
            self.plan(node.plan(), analysed)
        for child in _items(node.children()):
            self.expression(child, analysed)


def _own_session(spark: SparkSession, views: Mapping[str, DataFrame]) -> SparkSession:
    """A session with the caller's settings that knows ``views`` only."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    dataset = spark._jvm.org.apache.spark.sql.classic.Dataset
    for name, df in views.items():
        dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()).createOrReplaceTempView(name)
    return own


def query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Q16: run ``sql`` over ``views`` only; returns a lazy DataFrame or raises ``QueryRejected``.

    The caller's session keeps no trace of it; the result belongs to that session.
    """
    if not sql or not sql.strip():
        raise QueryRejected("there is no query")
    own = _own_session(spark, views)
    guard = _Guard(spark, frozenset(name.lower() for name in views))
    state = own._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(sql)
    except Exception as exc:
        raise QueryRejected(f"not a query Spark can parse: {exc}") from exc
    guard.plan(parsed, analysed=False)
    try:
        analysed = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, parsed).queryExecution().analyzed()
    except Exception as exc:
        raise QueryRejected(f"the query does not fit the views: {exc}") from exc
    guard.plan(analysed, analysed=True)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, analysed), spark)
