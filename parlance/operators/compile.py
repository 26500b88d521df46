"""Compile a plan to a DataFrame. Catalyst does the rest: pushdown, pruning, join choice, top-k."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ir import COMPARISONS, Aggregate, ColumnRef, Group, Having, Join, Nested, PlanError, Predicate, Query

#: Semantics of predicates: three-valued and typed; a JSON walk's text rules; SQLite's TEXT columns.
COMPAT = ("sql", "json", "sqlite_text")
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
Tables = Mapping[str, DataFrame] | Callable[[str], DataFrame]


def name(column: str) -> str:
    """A column name quoted, so that dots, spaces and signs in it are part of the name."""
    return "`" + column.replace("`", "``") + "`"


class Scope:
    """One table under an alias, with its columns found in any letter case."""

    def __init__(self, df: DataFrame, alias: str):
        self.df, self.alias = df.alias(alias), alias
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.lower = {c.lower(): c for c in self.types}

    def find(self, column: str) -> str:
        found = column if column in self.types else self.lower.get(column.lower())
        if found is None:
            raise PlanError(f"no column {column!r} in {self.alias!r}")
        return found

    def col(self, column: str) -> Column:
        return F.col(f"{name(self.alias)}.{name(self.find(column))}")

    def type(self, column: str) -> T.DataType:
        return self.types[self.find(column)]


def literal(value: Any, kind: T.DataType) -> Column:
    """A literal in the type of the column it meets; text that does not fit becomes null, so nothing matches it."""
    if isinstance(kind, _TIMES):
        if isinstance(value, str):
            text = F.lit(value if len(value) != 4 else f"{value}-01-01")
            return F.try_to_timestamp(text).cast(kind)
        return F.lit(value).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(_text(value))
    if isinstance(value, str):
        return F.lit(value).try_cast(kind) if not isinstance(kind, T.NumericType) else F.lit(value).try_cast("double")
    return F.lit(value)


def _text(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, date | datetime):
        return value.isoformat()
    return str(value)


def predicate(p: Predicate, scope: Scope, compat: str = "sql") -> Column:
    column = scope.col(p.key)
    if isinstance(p.value, ColumnRef):
        other = scope.col(p.value.name)
        return _compare(column, p.op, other)
    if compat == "json":
        return _json_predicate(p, column)
    kind = scope.type(p.key)
    if compat == "sqlite_text":
        column, kind = column.cast("string"), T.StringType()
    if p.op == "is_null" or p.value is None and p.op == "eq":
        return column.isNull()
    if p.value is None and p.op == "ne":
        return column.isNotNull()
    if p.op in ("in", "nin"):
        values = list(p.value) if isinstance(p.value, list | tuple | set) else [p.value]
        inside = column.isin([literal(v, kind) for v in values])
        return ~inside if p.op == "nin" else inside
    if p.op == "range":
        low, high = p.value
        return column.between(literal(low, kind), literal(high, kind))
    return _compare(column, p.op, literal(p.value, kind))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"eq": lambda: a == b, "ne": lambda: a != b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b}[op]()


def _json_predicate(p: Predicate, column: Column) -> Column:
    """Text equality where null reads "null"; comparisons of numbers only, anything else is false."""
    text = F.coalesce(column.cast("string"), F.lit("null"))
    if p.op == "is_null":
        return text == "null"
    if p.op in ("in", "nin"):
        values = list(p.value) if isinstance(p.value, list | tuple | set) else [p.value]
        inside = text.isin([_text(v) for v in values])
        return ~inside if p.op == "nin" else inside
    if p.op in ("eq", "ne"):
        return _compare(text, p.op, F.lit(_text(p.value)))
    number = column.cast("string").try_cast("double")
    if p.op == "range":
        low, high = p.value
        return F.coalesce(number.between(float(low), float(high)), F.lit(False))
    return F.coalesce(_compare(number, p.op, F.lit(_text(p.value)).try_cast("double")), F.lit(False))


def condition(item: Any, scope: Scope, compat: str = "sql") -> Column:
    """A predicate, a group, or a tuple of them AND-ed."""
    if isinstance(item, Predicate):
        return predicate(item, scope, compat)
    if isinstance(item, Group):
        parts = [condition(i, scope, compat) for i in item.items]
        if item.op == "not":
            # Over several nodes: SQL negates their conjunction; the JSON walk wants each of them false.
            return ~_fold(parts, "or" if compat == "json" else "and")
        return _fold(parts, item.op)
    return _fold([condition(i, scope, compat) for i in item], "and")


def _fold(parts: list[Column], op: str) -> Column:
    if not parts:
        return F.lit(True)
    out = parts[0]
    for part in parts[1:]:
        out = out | part if op == "or" else out & part
    return out


def aggregate(function: str, field: str, scope: Scope, compat: str = "sql", joined: Mapping[str, Scope] | None = None) -> Column:
    """COUNT takes `*` or `DISTINCT c`; the field may be two columns with an operator between spaces, or `relation.column`
    of a joined relation, whose nulls (rows without a match) do not count."""
    fn = function.upper()
    relation, _, own = field.partition(".")
    if own and joined and relation in joined and field.lower() not in scope.lower:
        scope, field = joined[relation], own
    if field == "*":
        if fn != "COUNT":
            raise PlanError(f"{fn}(*) has no meaning")
        return F.count("*")
    if field.upper().startswith("DISTINCT "):
        column = scope.col(field[9:].strip())
        if fn == "COUNT":
            return F.count_distinct(column)
        if fn == "SUM":
            return F.sum_distinct(column)
        if fn == "AVG":
            return F.try_divide(F.sum_distinct(column), F.count_distinct(column))
        return {"MIN": F.min, "MAX": F.max}[fn](column)
    value = _operand(field, scope)
    if compat == "json" and fn != "COUNT":
        value = value.cast("string").try_cast("double")
    if compat == "sqlite_text" and fn in ("MIN", "MAX"):
        value = value.cast("string")
    return {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[fn](value)


def _operand(field: str, scope: Scope) -> Column:
    try:
        return scope.col(field)
    except PlanError:
        pass
    for sign in (" + ", " - ", " * ", " / "):
        if sign in field:
            left, right = field.split(sign, 1)
            a, b = scope.col(left.strip()), _operand(right.strip(), scope)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[sign.strip()]
    raise PlanError(f"no column {field!r} in {scope.alias!r}")


def join(df: DataFrame, base: Scope, right: Scope, j: Join) -> DataFrame:
    return df.join(right.df, base.col(j.left) == right.col(j.right), j.kind.lower())


def ordered(column: Column, direction: str | None) -> Column:
    return column.desc_nulls_last() if (direction or "ASC").upper() == "DESC" else column.asc_nulls_last()


def children(parent: DataFrame, parent_scope: Scope, n: Nested, tables: Tables, compat: str) -> tuple[DataFrame, Column]:
    """`parent` with an array column for the relation: one aggregate over the children and one join, per level.

    The children of one parent are one value of one row, so a task holds all of them: a limit bounds them before they are
    collected.
    """
    child = _table(tables, n.target)
    scope = Scope(child, n.target)
    df = scope.df
    for p in n.filters:
        df = df.where(predicate(p, scope, compat))
    if n.limit is not None:
        from pyspark.sql import Window

        order = [ordered(scope.col(n.order_by), n.order_dir)] if n.order_by else []
        order += [scope.col(c).asc_nulls_last() for c, t in scope.types.items() if c != n.order_by and not isinstance(t, T.MapType)]
        df = df.withColumn("__n", F.row_number().over(Window.partitionBy(scope.col(n.right)).orderBy(*order))).where(F.col("__n") <= n.limit)
    inner = {}
    for c in n.children:
        df, inner[c.relation] = children(df, scope, c, tables, compat)
    wanted = list(dict.fromkeys(scope.find(f) for f in n.fields or list(scope.types)))
    packed = F.struct(*[scope.col(f).alias(f) for f in wanted], *[c.alias(r) for r, c in inner.items()])
    key, column = f"__key_{n.relation}", f"__rows_{n.relation}"
    rows = df.where(scope.col(n.right).isNotNull()).groupBy(scope.col(n.right).alias(key))
    if n.order_by:
        # Nulls come last in both directions; equal places are told apart by the row itself, so the order is always the same.
        place = F.struct(scope.col(n.order_by).isNull().alias("none"), scope.col(n.order_by).alias("by"), packed.alias("row"))
        down = (n.order_dir or "ASC").upper() == "DESC"

        def before(a: Column, b: Column) -> Column:
            by = F.when(a["by"] < b["by"], 1 if down else -1).when(a["by"] > b["by"], -1 if down else 1)
            return F.when(a["none"] != b["none"], F.when(a["none"], 1).otherwise(-1)).otherwise(F.coalesce(by, F.lit(0)))

        # The plain sort by the whole row comes first, and the sort by place keeps it among equals.
        rows = rows.agg(F.transform(F.array_sort(F.array_sort(F.collect_list(place)), before), lambda r: r["row"]).alias(column))
    else:
        rows = rows.agg(F.array_sort(F.collect_list(packed)).alias(column))
    joined = parent.join(rows, parent_scope.col(n.left) == F.col(name(key)), "left").drop(key)
    return joined, F.coalesce(F.col(name(column)), F.array().cast(rows.schema[column].dataType))


def _table(tables: Tables, entity: str) -> DataFrame:
    if callable(tables):
        return tables(entity)
    if entity in tables:
        return tables[entity]
    for key, df in tables.items():
        if key.lower() == entity.lower():
            return df
    raise PlanError(f"no table {entity!r}")


def compile_query(q: Query, tables: Tables, compat: str = "sql") -> DataFrame:
    """The DataFrame of a plan. Output columns: base fields, join fields (`target_field`), aggregates, nested arrays.

    With aggregates or HAVING the group keys are all projected fields. Ordering by a column that grouping or DISTINCT
    has removed is refused, unless a group key or an aggregate has that name.
    """
    if compat not in COMPAT:
        raise PlanError(f"compat is none of {COMPAT}")
    base = Scope(_table(tables, q.entity), q.entity)
    df, scopes = base.df, {}
    taken = {q.entity}
    for j in q.joins:
        alias = j.relation if j.relation not in taken else f"{j.relation}_{len(taken)}"
        taken.add(alias)
        scopes[id(j)] = Scope(_table(tables, j.target), alias)
        df = join(df, base, scopes[id(j)], j)
    for item in (*q.filters, *q.groups):
        df = df.where(condition(item, base, compat))
    for j in q.joins:
        for p in j.filters:
            df = df.where(predicate(p, scopes[id(j)], compat))
    for s in q.subqueries:
        df = _subquery(df, base, s, tables, compat)
    nested = []
    for n in q.nested:
        df, array = children(df, base, n, tables, compat)
        nested.append(array.alias(n.relation))
    keys = [(base.col(f), base.find(f)) for f in dict.fromkeys(q.fields)]
    for j in q.joins:
        keys += [(scopes[id(j)].col(f), f"{j.target}_{f}") for f in j.fields]
    if q.grouped:
        return _page(_grouped(df, base, q, keys, compat, {j.relation: scopes[id(j)] for j in q.joins}), q, None)
    columns = [c.alias(a) for c, a in keys] or [F.col(f"{name(q.entity)}.*")]
    if q.distinct:
        out = df.select(*columns, *nested).distinct()
        return _page(out, q, _by_name(out, q))
    if q.order_by and q.order_dir and q.limit is not None and not nested:
        # Sorting before projecting keeps the base column at hand, and Spark plans both as one top-k.
        return _page(df, q, base.col(q.order_by)).select(*columns)
    if q.order_by and q.order_dir:
        df = df.orderBy(ordered(base.col(q.order_by), q.order_dir))
    return _page(df.select(*columns, *nested), q.with_(order_by=None), None)


def _subquery(df: DataFrame, base: Scope, s: Any, tables: Tables, compat: str) -> DataFrame:
    inner = Scope(_table(tables, s.target), s.target)
    rows = inner.df
    for p in s.filters:
        rows = rows.where(predicate(p, inner, compat))
    rows = rows.select(inner.col(s.target_field).alias("__in"))
    column = base.col(s.key)
    if not s.negated:
        return df.join(rows, column == F.col("__in"), "left_semi")
    # NOT IN: a null inside makes it empty, and a null outside never passes unless the inside is empty. The nulls are
    # counted apart, so that the rest stays an equi-join.
    state = rows.agg(F.count("*").alias("__all"), F.count("__in").alias("__known"))
    kept = df.join(rows.where("__in IS NOT NULL"), column == F.col("__in"), "left_anti")
    kept = kept.join(F.broadcast(state))  # one row
    ok = (F.col("__all") == 0) | ((F.col("__all") == F.col("__known")) & column.isNotNull())
    return kept.where(ok).drop("__all", "__known")


def _grouped(df: DataFrame, base: Scope, q: Query, keys: list[tuple[Column, str]], compat: str, joined: Mapping[str, Scope]) -> DataFrame:
    aggs = [aggregate(a.function, a.field, base, compat, joined).alias(a.name) for a in q.aggregates]
    hidden = [aggregate(h.function, h.field, base, compat, joined).alias(f"__having_{i}") for i, h in enumerate(q.having)]
    out = df.groupBy(*[c.alias(a) for c, a in keys]).agg(*(aggs + hidden or [F.count("*").alias("__n")]))
    for i, h in enumerate(q.having):
        out = out.where(_compare(F.col(f"__having_{i}"), COMPARISONS.get(h.op, "eq"), F.lit(h.value)))
    out = out.drop(*[f"__having_{i}" for i in range(len(q.having))], "__n")
    if q.order_by and q.order_dir and keys:
        return out.orderBy(ordered(_by_name(out, q), q.order_dir))
    return out


def _by_name(df: DataFrame, q: Query) -> Column | None:
    if not (q.order_by and q.order_dir):
        return None
    for c in df.columns:
        if c.lower() == q.order_by.lower():
            return F.col(name(c))
    raise PlanError(f"cannot order by {q.order_by!r}: it is not in the result")


def _page(df: DataFrame, q: Query, order: Column | None) -> DataFrame:
    if order is not None and q.order_dir:
        df = df.orderBy(ordered(order, q.order_dir))
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


__all__ = ["COMPAT", "Aggregate", "Having", "Scope", "compile_query", "condition", "literal", "name", "predicate"]
