"""Tables of a session: folders of Parquet, JDBC, views; execution of SQL text; sinks."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.compile import name
from ..plans.catalog import Catalog, from_schema
from ..plans.ir import PlanError

#: The driver's tables and their foreign keys.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
RELATIONS = {
    "nation": {"region": {"target": "region", "left": "n_regionkey", "right": "r_regionkey"}},
    "customer": {"nation": {"target": "nation", "left": "c_nationkey", "right": "n_nationkey"}, "orders": {"target": "orders", "left": "c_custkey", "right": "o_custkey", "aliases": ["order"]}},
    "supplier": {"nation": {"target": "nation", "left": "s_nationkey", "right": "n_nationkey"}},
    "orders": {"customer": {"target": "customer", "left": "o_custkey", "right": "c_custkey"}, "lineitem": {"target": "lineitem", "left": "o_orderkey", "right": "l_orderkey", "aliases": ["items", "line items"]}},
    "lineitem": {"orders": {"target": "orders", "left": "l_orderkey", "right": "o_orderkey"}, "part": {"target": "part", "left": "l_partkey", "right": "p_partkey"}, "supplier": {"target": "supplier", "left": "l_suppkey", "right": "s_suppkey"}},
}
ALIASES = {
    "entities": {"customers": "customer", "clients": "customer", "suppliers": "supplier", "parts": "part", "nations": "nation", "regions": "region", "order": "orders", "line items": "lineitem", "items": "lineitem", "event": "events"},
    "fields": {
        "status": "o_orderstatus", "total": "o_totalprice", "total price": "o_totalprice", "priority": "o_orderpriority", "order date": "o_orderdate",
        "segment": "c_mktsegment", "market segment": "c_mktsegment", "balance": "c_acctbal", "quantity": "l_quantity", "discount": "l_discount", "return flag": "l_returnflag",
        "size": "p_size", "brand": "p_brand", "retail price": "p_retailprice", "type": "event_type", "event type": "event_type", "user": "user_id",
    },
}


def parquet(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The named Parquet tables of a folder."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def catalog(tables: Mapping[str, DataFrame], mapping: Mapping[str, Any] | None = None) -> Catalog:
    """A catalog of the driver's tables, with their relations and aliases."""
    relations = {e: r for e, r in RELATIONS.items() if e in tables}
    return from_schema({"relations": relations, "mapping": ALIASES, "entities": list(tables)}, mapping, tables)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in `parts` parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def introspect(spark: SparkSession) -> dict[str, list[str]]:
    """Columns of every table and view of the current database."""
    return {t.name: [c.name for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables()}


#: Plan nodes of reading statements, as the parser names them; whatever else it makes (commands, writes, scripts) is refused.
READING = frozenset(
    "Aggregate CTERelationDef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot PipeOperator Project Repartition RepartitionByExpression Sample Sort Subquery SubqueryAlias Tail "
    "Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith Window WithWindowDefinition".split()
)
#: Functions that reach outside the data.
REFUSED = frozenset("reflect try_reflect java_method".split())


def read_only(spark: SparkSession, sql: str) -> str:
    """The text if Spark's parser makes one query of it that reads tables by plain names and calls no code; else an error."""
    text = sql.strip().rstrip(";").strip()
    jvm, bad = spark._jvm, PlanError("only one reading statement is run")
    try:
        root = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise PlanError(f"not a query: {str(e).strip().splitlines()[0] if str(e).strip() else 'parse error'}") from e
    inside = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def each(seq: Any) -> list[Any]:
        return [seq.apply(i) for i in range(seq.length())]

    plans, expressions = [root], []
    while plans or expressions:
        if plans:
            node = plans.pop()
            kind = node.getClass().getSimpleName()
            if kind not in READING:
                raise bad
            if kind == "UnresolvedRelation" and node.multipartIdentifier().length() != 1:
                raise PlanError("tables are read by plain names, not by paths or from other databases")
            if kind == "UnresolvedTableValuedFunction" and node.name().apply(0).lower() not in ("range", "explode", "posexplode", "inline", "stack"):
                raise bad
            plans += each(node.children())
            plans += [p for p in each(node.innerChildren()) if hasattr(p, "innerChildren") and kind == "UnresolvedWith"]
            expressions += each(node.expressions())
        else:
            e = expressions.pop()
            if inside.isInstance(e):
                plans.append(e.plan())
            if e.getClass().getSimpleName() == "UnresolvedFunction" and e.nameParts().last().lower() in REFUSED:
                raise PlanError("functions that call code are not run")
            expressions += each(e.children())
    return text


class Executor:
    """Runs SQL text over a session's views and gives rows as dictionaries, at most `row_limit` of them.

    The limit is put on the plan, so a column or a comment named like it changes nothing. It is also a callable back end
    and a context manager that drops the views it made.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, row_limit: int | None = 10_000):
        self.spark, self.row_limit = spark, row_limit
        self.made: list[str] = []
        for n, df in (tables or {}).items():
            self.load(n, df)

    def load(self, table: str, rows: DataFrame | list[Mapping[str, Any]], mode: str = "replace") -> None:
        """Make rows a view; `append` adds them to the view's, `fail` refuses an existing one."""
        from .jsondata import _frame

        df = rows if isinstance(rows, DataFrame) else _frame(self.spark, [dict(r) for r in rows], False)
        there = self.spark.catalog.tableExists(name(table))
        if there and mode == "fail":
            raise PlanError(f"table {table!r} exists")
        if there and mode == "append":
            df = self.spark.table(name(table)).unionByName(df, allowMissingColumns=True)
        df.createOrReplaceTempView(name(table))
        self.made.append(table)

    def frame(self, sql: str) -> DataFrame:
        df = self.spark.sql(read_only(self.spark, sql))
        return df if self.row_limit is None else df.limit(self.row_limit)

    def execute(self, sql: str) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.frame(sql).collect()]

    async def aexecute(self, sql: str) -> list[dict[str, Any]]:
        return await asyncio.to_thread(self.execute, sql)

    def __call__(self, sql: str, example: Any = None) -> list[dict[str, Any]]:
        return self.execute(sql)

    def __enter__(self) -> Executor:
        return self

    def __exit__(self, *_: object) -> None:
        self.dispose()

    def dispose(self) -> None:
        for table in self.made:
            self.spark.catalog.dropTempView(table)
        self.made = []


def executor_from_rows(spark: SparkSession, rows_by_table: Mapping[str, list[Mapping[str, Any]]], row_limit: int | None = 10_000) -> Executor:
    """An executor over in-line rows."""
    out = Executor(spark, row_limit=row_limit)
    for table, rows in rows_by_table.items():
        out.load(table, rows)
    return out


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write a result as Parquet, ORC, JSON or CSV, partitioned by columns if given."""
    if kind not in ("parquet", "orc", "json", "csv"):
        raise PlanError(f"unknown format {kind!r}")
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


Backend = Callable[[str, Any], list[dict[str, Any]]]
