"""The relational representation that planners write and the compiler and renderers read."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

#: Operator tokens, and the suffixes that stand for them in filter dictionaries.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "is_null", "range")
SUFFIXES = {"_gte": "gte", "_lte": "lte", "_gt": "gt", "_lt": "lt", "_nin": "nin", "_ne": "ne", "_in": "in"}
JOIN_KINDS = ("LEFT", "INNER", "RIGHT")
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
COMPARISONS = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "!=": "ne"}


class PlanError(ValueError):
    """A request that cannot be planned or compiled; `issues` lists why."""

    def __init__(self, message: str, issues: list[str] | None = None):
        super().__init__(message)
        self.issues = list(issues or [message])


@dataclass(frozen=True)
class ColumnRef:
    """Another column of the same table, as the value of a predicate."""

    name: str


@dataclass(frozen=True)
class Predicate:
    key: str
    value: Any = None
    op: str = "eq"

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise PlanError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class Group:
    """AND, OR or NOT over predicates and groups; each item may itself be a tuple, whose members are AND-ed."""

    op: str
    items: tuple[Any, ...]

    def __post_init__(self) -> None:
        if self.op not in ("and", "or", "not"):
            raise PlanError(f"unknown group {self.op!r}")


@dataclass(frozen=True)
class Join:
    relation: str
    target: str
    left: str
    right: str
    fields: tuple[str, ...] = ()
    filters: tuple[Predicate, ...] = ()
    kind: str = "LEFT"

    def __post_init__(self) -> None:
        if self.kind.upper() not in JOIN_KINDS:
            raise PlanError(f"join kind {self.kind!r} is none of {JOIN_KINDS}")


@dataclass(frozen=True)
class Nested:
    """Children of each row as an array of structs. `left` is the parent's column, `right` the child's."""

    relation: str
    target: str
    left: str
    right: str
    fields: tuple[str, ...] = ()
    filters: tuple[Predicate, ...] = ()
    children: tuple[Nested, ...] = ()
    order_by: str | None = None
    order_dir: str = "ASC"
    limit: int | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str = "*"
    alias: str = ""

    def __post_init__(self) -> None:
        if self.function.upper() not in FUNCTIONS:
            raise PlanError(f"unknown aggregate {self.function!r}")

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        fn = self.function.lower()
        return fn if self.field == "*" else f"{fn}_{self.field.removeprefix('DISTINCT ').strip()}".replace(" ", "_")


@dataclass(frozen=True)
class Having:
    function: str
    field: str = "*"
    op: str = ">"
    value: Any = 0


@dataclass(frozen=True)
class Subquery:
    """`key` (NOT) IN (SELECT `target_field` FROM `target` WHERE `filters`)."""

    key: str
    target: str
    target_field: str
    filters: tuple[Predicate, ...] = ()
    negated: bool = True


@dataclass(frozen=True)
class Query:
    entity: str
    fields: tuple[str, ...] = ()
    filters: tuple[Predicate, ...] = ()
    groups: tuple[Group, ...] = ()
    joins: tuple[Join, ...] = ()
    nested: tuple[Nested, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    having: tuple[Having, ...] = ()
    subqueries: tuple[Subquery, ...] = ()
    order_by: str | None = None
    order_dir: str | None = None
    limit: int | None = None
    offset: int | None = None
    distinct: bool = False
    target: str = "sql"
    source_text: str = ""
    notes: tuple[str, ...] = field(default=(), compare=False)

    @property
    def grouped(self) -> bool:
        return bool(self.aggregates or self.having)

    def with_(self, **changes: Any) -> Query:
        return replace(self, **changes)


def decode_filters(filters: dict[str, Any], exact: frozenset[str] | set[str] = frozenset()) -> tuple[tuple[Predicate, ...], tuple[Group, ...]]:
    """Predicates and groups of a filter dictionary: `price_gte` means >=, `and`/`or`/`not` hold lists of dictionaries.

    Keys in `exact` are columns whatever their ending; None means IS NULL, and such a key is taken as it stands; a
    dictionary `{"$col": name}` means the other column.
    """
    flat, groups = [], []
    for key, value in filters.items():
        if key in ("and", "or", "not") and key not in exact:
            nodes = value if isinstance(value, list) else [value]
            groups.append(Group(key, tuple(_node(n, exact) for n in nodes)))
        else:
            flat.append(decode_predicate(key, value, exact))
    return tuple(flat), tuple(groups)


def decode_predicate(key: str, value: Any, exact: frozenset[str] | set[str] = frozenset()) -> Predicate:
    if isinstance(value, dict) and "$col" in value:
        value = ColumnRef(str(value["$col"]))
    if value is None:
        return Predicate(key, None, "is_null")
    if key not in exact:
        for suffix, op in SUFFIXES.items():
            if key.endswith(suffix) and len(key) > len(suffix):
                return Predicate(key[: -len(suffix)], value, op)
    return Predicate(key, value, "in" if isinstance(value, list | tuple | set) else "eq")


def _node(node: Any, exact: frozenset[str] | set[str]) -> Any:
    if not isinstance(node, dict):
        return node
    flat, groups = decode_filters(node, exact)
    items = (*flat, *groups)
    return items[0] if len(items) == 1 else items


def encode_filters(filters: tuple[Predicate, ...], groups: tuple[Group, ...] = ()) -> dict[str, Any]:
    """The filter dictionary that `decode_filters` reads."""
    back = {op: suffix for suffix, op in SUFFIXES.items()}
    out: dict[str, Any] = {}
    for p in filters:
        if p.op == "range":
            out[f"{p.key}_gte"], out[f"{p.key}_lte"] = p.value
        else:
            value = {"$col": p.value.name} if isinstance(p.value, ColumnRef) else p.value
            out[p.key + back.get(p.op, "") if p.op != "in" or not isinstance(value, list) else p.key + "_in"] = None if p.op == "is_null" else value
    for g in groups:
        out.setdefault(g.op, []).extend(_dict(i) for i in g.items)
    return out


def _dict(item: Any) -> dict[str, Any]:
    items = item if isinstance(item, tuple) else (item,)
    return encode_filters(tuple(i for i in items if isinstance(i, Predicate)), tuple(i for i in items if isinstance(i, Group)))


def to_dict(query: Query) -> dict[str, Any]:
    """A plain dictionary with the whole plan, for metadata and JSON."""

    def plain(x: Any) -> Any:
        if isinstance(x, ColumnRef):
            return {"$col": x.name}
        if hasattr(x, "__dataclass_fields__"):
            return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        if isinstance(x, tuple | list):
            return [plain(i) for i in x]
        return x

    out = plain(query)
    out["filters"] = encode_filters(query.filters, query.groups)
    out.pop("groups")
    for own, node in zip(out["joins"], query.joins, strict=True):
        own["filters"] = encode_filters(node.filters)
    for own, node in zip(out["subqueries"], query.subqueries, strict=True):
        own["filters"] = encode_filters(node.filters)
    return out


def from_dict(plan: dict[str, Any]) -> Query:
    """The query that `to_dict` wrote; unknown keys are ignored."""
    flat, groups = decode_filters(plan.get("filters") or {}, set(plan.get("exact_filter_keys") or ()))

    def some(kind: type, item: dict[str, Any]) -> Any:
        names = {f.name for f in fields(kind)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in item.items() if k in names}
        if "filters" in kept:
            own = item["filters"]
            kept["filters"] = decode_filters(own)[0] if isinstance(own, dict) else tuple(Predicate(**p) for p in own)
        if kind is Nested and "children" in kept:
            kept["children"] = tuple(some(Nested, c) for c in item["children"])
        return kind(**kept)

    kinds = {"joins": Join, "nested": Nested, "aggregates": Aggregate, "having": Having, "subqueries": Subquery}
    simple = {k: plan[k] for k in ("entity", "order_by", "order_dir", "limit", "offset", "distinct", "target", "source_text") if plan.get(k) is not None}
    lists = {k: tuple(some(kind, i) for i in plan.get(k) or ()) for k, kind in kinds.items()}
    return Query(**simple, fields=tuple(plan.get("fields") or ()), filters=flat, groups=groups, notes=tuple(plan.get("notes") or ()), **lists)
