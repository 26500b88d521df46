"""Text of a plan: Spark SQL that returns the compiled DataFrame's rows, and GraphQL."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from .ir import COMPARISONS, SUFFIXES, ColumnRef, Group, Having, Nested, PlanError, Predicate, Query, encode_filters

_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def quote(identifier: str) -> str:
    return "`" + identifier.replace("`", "``") + "`"


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def render_sql(q: Query) -> str:
    """One SELECT in Spark's dialect. Nested selections have no flat form and are refused."""
    if q.nested:
        raise PlanError("nested selections render as GraphQL, not SQL")
    base, columns, keys = quote(q.entity), [], []
    for f in dict.fromkeys(q.fields):
        columns.append(f"{base}.{quote(f)}")
        keys.append(columns[-1])
    joins, where, taken = [], [], {q.entity}
    aliases = []
    for j in q.joins:
        alias = j.relation if j.relation not in taken else f"{j.relation}_{len(taken)}"
        taken.add(alias)
        aliases.append(alias)
        right = quote(alias)
        joins.append(f"{j.kind.upper()} JOIN {quote(j.target)} AS {right} ON {base}.{quote(j.left)} = {right}.{quote(j.right)}")
        for f in j.fields:
            keys.append(f"{right}.{quote(f)}")
            columns.append(f"{keys[-1]} AS {quote(f'{j.target}_{f}')}")
    where += [_predicate(p, base) for p in q.filters]
    where += [_condition(g, base) for g in q.groups]
    for j, alias in zip(q.joins, aliases, strict=True):
        where += [_predicate(p, quote(alias)) for p in j.filters]
    for s in q.subqueries:
        inner = "".join(f" {'AND' if i else 'WHERE'} {_predicate(p, quote(s.target))}" for i, p in enumerate(s.filters))
        where.append(f"{base}.{quote(s.key)} {'NOT ' * s.negated}IN (SELECT {quote(s.target)}.{quote(s.target_field)} FROM {quote(s.target)}{inner})")
    joined = {j.relation: quote(alias) for j, alias in zip(q.joins, aliases, strict=True)}
    columns += [f"{_aggregate(a.function, a.field, base, joined)} AS {quote(a.name)}" for a in q.aggregates]
    if q.grouped and not columns:
        columns = ["count(*) AS `count`"]
    parts = [f"SELECT {'DISTINCT ' * (q.distinct and not q.grouped)}{', '.join(columns) or base + '.*'}", f"FROM {quote(q.entity)} AS {base}", *joins]
    if where:
        parts.append("WHERE " + " AND ".join(where))
    if q.grouped and keys:
        parts.append("GROUP BY " + ", ".join(dict.fromkeys(keys)))
    if q.having:
        parts.append("HAVING " + " AND ".join(f"{_aggregate(h.function, h.field, base, joined)} {_SIGNS[COMPARISONS.get(h.op, 'eq')]} {sql_literal(h.value)}" for h in q.having))
    if q.order_by and q.order_dir and not (q.grouped and not keys):
        by = quote(q.order_by) if q.grouped or q.distinct else f"{base}.{quote(q.order_by)}"
        parts.append(f"ORDER BY {by} {q.order_dir.upper()} NULLS LAST")
    if q.limit is not None:
        parts.append(f"LIMIT {q.limit}")
    if q.offset:
        parts.append(f"OFFSET {q.offset}")
    return " ".join(parts)


def _aggregate(function: str, field: str, base: str, joined: dict[str, str]) -> str:
    fn = function.upper()
    relation, _, own = field.partition(".")
    if own and relation in joined:
        base, field = joined[relation], own
    if field == "*":
        return f"{fn}(*)"
    if field.upper().startswith("DISTINCT "):
        return f"{fn}(DISTINCT {base}.{quote(field[9:].strip())})"
    for sign in (" + ", " - ", " * ", " / "):
        if sign in field:
            return f"{fn}({sign.join(f'{base}.{quote(part.strip())}' for part in field.split(sign))})"
    return f"{fn}({base}.{quote(field)})"


def _predicate(p: Predicate, scope: str) -> str:
    column = f"{scope}.{quote(p.key)}"
    if isinstance(p.value, ColumnRef):
        return f"{column} {_SIGNS[p.op]} {scope}.{quote(p.value.name)}"
    if p.op == "is_null" or (p.value is None and p.op == "eq"):
        return f"{column} IS NULL"
    if p.value is None and p.op == "ne":
        return f"{column} IS NOT NULL"
    if p.op in ("in", "nin"):
        values = p.value if isinstance(p.value, list | tuple | set) else [p.value]
        return f"{column} {'NOT ' * (p.op == 'nin')}IN ({', '.join(map(sql_literal, values))})"
    if p.op == "range":
        return f"{column} BETWEEN {sql_literal(p.value[0])} AND {sql_literal(p.value[1])}"
    return f"{column} {_SIGNS[p.op]} {sql_literal(p.value)}"


def _condition(item: Any, scope: str) -> str:
    if isinstance(item, Predicate):
        return _predicate(item, scope)
    if isinstance(item, Group):
        parts = [_condition(i, scope) for i in item.items]
        if item.op == "not":
            return f"NOT ({' AND '.join(parts)})"
        return "(" + f" {item.op.upper()} ".join(parts) + ")"
    return "(" + " AND ".join(_condition(i, scope) for i in item) + ")"


#: The order of well-known arguments; others follow by name.
ARGUMENT_ORDER = ("limit", "first", "offset", "after", "status", "orderBy", "orderDirection", "and", "or", "not", "distinct", "having")


def graphql_value(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {graphql_value(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(graphql_value(v) for v in value) + "]"
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def arguments(values: dict[str, Any]) -> str:
    rank = {k: i for i, k in enumerate(ARGUMENT_ORDER)}
    items = sorted(values.items(), key=lambda kv: (rank.get(kv[0], len(rank)), kv[0]))
    return f"({', '.join(f'{k}: {graphql_value(v)}' for k, v in items)})" if items else ""


def having_argument(having: tuple[Having, ...]) -> dict[str, Any]:
    """`{count: {_gt: n}}`, or `{sum: {field: {_gte: n}}}`."""
    names = {"eq": "_eq", "ne": "_neq", "gt": "_gt", "gte": "_gte", "lt": "_lt", "lte": "_lte"}
    out: dict[str, Any] = {}
    for h in having:
        test = {names[COMPARISONS.get(h.op, "eq")]: h.value}
        if h.field == "*":
            out.setdefault(h.function.lower(), {}).update(test)
        else:
            out.setdefault(h.function.lower(), {}).setdefault(h.field, {}).update(test)
    return out


def render_graphql(q: Query) -> str:
    """One selection set. Paging and ordering become arguments; an empty selection asks for `id`."""
    values = encode_filters(q.filters, q.groups)
    if q.limit is not None:
        values["limit"] = q.limit
    if q.offset:
        values["offset"] = q.offset
    if q.order_by and q.order_dir:
        values |= {"orderBy": q.order_by, "orderDirection": q.order_dir}
    if q.distinct:
        values["distinct"] = True
    if q.having:
        values["having"] = having_argument(q.having)
    lines = list(q.fields)
    lines += ["count" if a.function.upper() == "COUNT" else f'{a.function.lower()}(field: "{a.field}")' for a in q.aggregates]
    body = [f"  {q.entity}{arguments(values)} {{", *(f"    {line}" for line in lines)]
    for n in q.nested:
        body += _nested(n, 4)
    if len(body) == 1:
        body.append("    id")
    return "\n".join(["{", *body, "  }", "}"])


def _nested(n: Nested, indent: int) -> list[str]:
    pad = " " * indent
    values = encode_filters(n.filters) | ({"limit": n.limit} if n.limit is not None else {})
    lines = [f"{pad}{n.relation}{arguments(values)} {{", *(f"{pad}  {f}" for f in n.fields or ("id",))]
    for c in n.children:
        lines += _nested(c, indent + 2)
    return [*lines, f"{pad}}}"]


__all__ = ["SUFFIXES", "render_graphql", "render_sql"]
