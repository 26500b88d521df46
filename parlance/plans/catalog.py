"""What the planner knows of the data: entities, fields, relations, aliases, values, from declarations or from schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ir import PlanError

#: Keys of a declaration under which filterable names are looked for, and paging arguments.
ARGUMENT_HINTS = ("filters", "filterable_fields", "query_args", "params", "parameters", "where")
PAGING = ("limit", "offset", "first", "after", "orderBy", "orderDirection")


@dataclass(frozen=True)
class Relation:
    """A foreign key edge from one entity. `left` and `right` are the columns that meet; by convention if not given."""

    name: str
    target: str
    left: str = ""
    right: str = ""
    fields: tuple[str, ...] = ()
    args: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()


@dataclass
class Catalog:
    entities: list[str] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)
    types: dict[str, T.StructType] = field(default_factory=dict)
    args: dict[str, list[str]] = field(default_factory=dict)
    relations: dict[str, dict[str, Relation]] = field(default_factory=dict)
    entity_aliases: dict[str, str] = field(default_factory=dict)
    field_aliases: dict[str, str] = field(default_factory=dict)
    filter_aliases: dict[str, str] = field(default_factory=dict)
    value_aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    enums: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    common_fields: list[str] = field(default_factory=list)
    default_entity: str | None = None
    default_fields: dict[str, list[str]] = field(default_factory=dict)
    intents: list[dict[str, Any]] = field(default_factory=list)

    def columns(self, entity: str) -> list[str]:
        """Fields of an entity; common fields only if no entity has its own."""
        if self.fields:
            return self.fields.get(entity, [])
        return self.common_fields

    def find(self, entity: str, column: str) -> str | None:
        """A real column by name or alias, in any letter case."""
        columns = self.columns(entity)
        if column in columns:
            return column
        lowered = {c.lower(): c for c in columns}
        wanted = column.lower()
        if wanted in lowered:
            return lowered[wanted]
        aliased = self.field_aliases.get(wanted) or self.filter_aliases.get(wanted)
        if aliased and aliased.lower() in lowered:
            return lowered[aliased.lower()]
        for part in self._aliases_of(wanted):
            if part.lower() in lowered:
                return lowered[part.lower()]
        return None

    def _aliases_of(self, wanted: str) -> list[str]:
        return [canonical for alias, canonical in self.scoped.items() if alias == wanted]

    @property
    def scoped(self) -> dict[str, str]:
        return {alias.split(".", 1)[1]: canonical for alias, canonical in self.field_aliases.items() if "." in alias}

    def aliases(self, entity: str) -> dict[str, str]:
        """alias -> column for the columns of an entity; an alias may be scoped as `entity.alias`."""
        columns = {c.lower(): c for c in self.columns(entity)}
        out: dict[str, str] = {}
        for alias, canonical in {**self.field_aliases, **self.filter_aliases}.items():
            scope, _, bare = alias.rpartition(".")
            if scope and scope.lower() != entity.lower():
                continue
            if canonical.lower() in columns:
                out[bare.lower()] = columns[canonical.lower()]
        return out

    def type(self, entity: str, column: str) -> T.DataType | None:
        schema = self.types.get(entity)
        return next((f.dataType for f in schema.fields if f.name == column), None) if schema else None

    def relation(self, entity: str, name: str) -> Relation | None:
        own = self.relations.get(entity, {})
        return own.get(name) or next((r for r in own.values() if r.target == name or name in r.aliases), None)


def _pairs(value: Any) -> dict[str, str]:
    """Aliases given as alias -> name or as name -> [aliases]."""
    out: dict[str, str] = {}
    for k, v in (value or {}).items() if isinstance(value, Mapping) else ():
        if isinstance(v, list | tuple):
            out |= {str(a).lower(): str(k) for a in v}
        else:
            out[str(k).lower()] = str(v)
    return out


def _names(value: Any) -> tuple[list[str], dict[str, str]]:
    """Names and aliases of a list of names or of {name, aliases}, or of an alias map."""
    if isinstance(value, Mapping):
        pairs = _pairs(value)
        return list(dict.fromkeys(pairs.values())), pairs
    names, pairs = [], {}
    for item in value or ():
        if isinstance(item, Mapping):
            names.append(str(item["name"]))
            pairs |= {str(a).lower(): names[-1] for a in item.get("aliases") or ()}
        elif str(item).strip():
            names.append(str(item))
    return list(dict.fromkeys(names)), pairs


def singular(word: str) -> str:
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("ses", "xes", "zes", "ches", "shes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def plural(word: str) -> str:
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "z", "ch", "sh")) else "s")


def split_on(text: str, entity: str, target: str) -> tuple[str, str]:
    """Columns of `a.x = b.y`, which may be given in either order; names may be quoted and hold dots or spaces."""
    m = re.fullmatch(r"\s*(.+?)\s*=\s*(.+?)\s*", text)
    if not m:
        raise PlanError(f"cannot read join condition {text!r}")
    sides = []
    for side in m.groups():
        table, dot, column = side.partition(".")
        sides.append((table.strip('`" ') if dot else "", (column if dot else table).strip('`" ')))
    (a, x), (b, y) = sides
    return (y, x) if a.lower() == target.lower() and b.lower() == entity.lower() and a.lower() != b.lower() else (x, y)


def _relations(entity: str, value: Any) -> dict[str, Relation]:
    items = value.items() if isinstance(value, Mapping) else ((str(i.get("name") or i.get("target")), i) for i in value or ())
    out: dict[str, Relation] = {}
    for key, item in items:
        spec = item if isinstance(item, Mapping) else {"target": item}
        target = str(spec.get("target") or key)
        left, right = split_on(str(spec["on"]), entity, target) if spec.get("on") else (str(spec.get("left", "")), str(spec.get("right", "")))
        own = key if key not in out else f"{key}_{left or len(out)}"
        out[own] = Relation(own, target, left, right, tuple(map(str, spec.get("fields") or ())), tuple(map(str, spec.get("args") or ())), tuple(map(str, spec.get("aliases") or ())))
    return out


def from_schema(schema: Mapping[str, Any] | None = None, mapping: Mapping[str, Any] | None = None, tables: Mapping[str, DataFrame] | None = None) -> Catalog:
    """A catalog from tables, a declaration and alias mappings, each laid over the one before.

    A declaration without any known key is taken as a sample payload, from which entities and fields are inferred.
    """
    out = Catalog()
    for entity, df in (tables or {}).items():
        add_table(out, entity, df.schema)
    schema = dict(schema or {})
    known = {"entities", "fields", "args", "relations", "introspection", "default_entity", "default_fields", "default_fields_by_entity", "keyword_intents", "mapping", "mappings", "types", *ARGUMENT_HINTS}
    if schema and not known & set(schema):
        schema = infer(schema)
    names, pairs = _names(schema.get("entities"))
    out.entities += [e for e in names if e not in out.entities]
    out.entity_aliases |= pairs
    declared = schema.get("fields")
    if isinstance(declared, Mapping) and declared and all(isinstance(v, list | tuple) for v in declared.values()) and (not out.entities or any(k in out.entities for k in declared)):
        for entity, own in declared.items():
            columns, pairs = _names(own)
            out.fields[str(entity)] = columns
            out.field_aliases |= {f"{entity}.{a}": c for a, c in pairs.items()}
            if entity not in out.entities:
                out.entities.append(str(entity))
    elif declared:
        out.common_fields, pairs = _names(declared)
        out.field_aliases |= pairs
    for entity, args in (schema.get("args") or {}).items():
        out.args[entity] = list(map(str, args))
    for entity, value in (schema.get("relations") or {}).items():
        out.relations.setdefault(entity, {}).update(_relations(entity, value))
    _introspect(out, schema.get("introspection") or {})
    if schema.get("default_entity"):
        out.default_entity = str(schema["default_entity"])
    for entity, own in (schema.get("default_fields_by_entity") or {}).items():
        out.default_fields[entity] = list(map(str, own))
    if schema.get("default_fields"):
        out.default_fields[""] = list(map(str, schema["default_fields"]))
    out.intents = [i for i in schema.get("keyword_intents") or () if isinstance(i, Mapping)]
    for layer in (schema.get("mapping"), schema.get("mappings"), mapping):
        _overlay(out, layer)
    for entity in out.entities:
        found = [str(a) for hint in ARGUMENT_HINTS for a in _hinted(schema.get(hint), entity)]
        own = out.args.get(entity) or found or list(out.columns(entity))
        out.args[entity] = list(dict.fromkeys([*own, *found, *PAGING]))
    return out


def _hinted(value: Any, entity: str) -> list[str]:
    if isinstance(value, Mapping):
        value = value.get(entity) or ()
    return list(value) if isinstance(value, list | tuple) else []


def _overlay(out: Catalog, layer: Any) -> None:
    if not isinstance(layer, Mapping):
        return
    for keys, target in ((("entities", "entity_aliases"), out.entity_aliases), (("fields", "field_aliases"), out.field_aliases), (("filters", "filter_aliases"), out.filter_aliases)):
        for key in keys:
            target |= _pairs(layer.get(key))
    for column, values in (layer.get("filter_values") or {}).items():
        out.value_aliases.setdefault(str(column), {}).update({str(k).lower(): str(v) for k, v in values.items()})


def _introspect(out: Catalog, found: Mapping[str, Any]) -> None:
    """Arguments, fields, enums and targets of a GraphQL introspection result; `[T!]!` is read as T."""
    bare = lambda t: re.sub(r"[\[\]!\s]", "", str(t))
    types = found.get("types") or {}
    enums = {name: list(map(str, t.get("enumValues") or t.get("enum") or ())) for name, t in types.items() if isinstance(t, Mapping)}
    for entity, spec in (found.get("query") or {}).items():
        if entity not in out.entities:
            out.entities.append(entity)
        spec = spec if isinstance(spec, Mapping) else {"type": spec}
        args = spec.get("args") or {}
        args = args if isinstance(args, Mapping) else dict.fromkeys(args, "")
        out.args[entity] = list(args)
        for arg, kind in args.items():
            kind = bare(kind.get("type", "") if isinstance(kind, Mapping) else kind)
            if enums.get(kind):
                out.enums.setdefault(entity, {})[arg] = enums[kind]
        own = types.get(bare(spec.get("type", "")))
        for f, kind in ((own or {}).get("fields") or {}).items() if isinstance(own, Mapping) else ():
            kind = bare(kind.get("type", "") if isinstance(kind, Mapping) else kind)
            target = next((e for e, s in found["query"].items() if isinstance(s, Mapping) and bare(s.get("type", "")) == kind), None)
            if target:
                out.relations.setdefault(entity, {}).setdefault(f, Relation(f, target))
            else:
                out.fields.setdefault(entity, [])
                if f not in out.fields[entity]:
                    out.fields[entity].append(f)


def add_table(out: Catalog, entity: str, schema: T.StructType) -> None:
    """An entity of a table's schema: structs give dotted-away leaves, arrays of structs give child relations."""
    if entity not in out.entities:
        out.entities.append(entity)
    out.types[entity] = schema
    leaves: list[str] = []

    def walk(s: T.StructType, depth: int) -> None:
        for f in s.fields:
            if isinstance(f.dataType, T.StructType) and depth < 4:
                walk(f.dataType, depth + 1)
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                add_table(out, f.name, f.dataType.elementType)
                out.relations.setdefault(entity, {})[f.name] = Relation(f.name, f.name)
            elif f.name not in leaves:
                leaves.append(f.name)

    walk(schema, 0)
    out.fields[entity] = leaves


def infer(payload: Mapping[str, Any]) -> dict[str, Any]:
    """A declaration inferred from a JSON payload: every dictionary or list of dictionaries under a key is an entity.

    All rows of a list are looked at; names are sorted, so the result does not depend on the order of keys.
    """
    fields: dict[str, set[str]] = {}

    def walk(key: str, node: Any) -> None:
        rows = [r for r in node if isinstance(r, Mapping)] if isinstance(node, list) else [node] if isinstance(node, Mapping) else []
        for row in rows:
            for k, v in row.items():
                nested = isinstance(v, Mapping) or (isinstance(v, list) and any(isinstance(i, Mapping) for i in v))
                if nested:
                    walk(str(k), v)
                if key and not isinstance(v, list | Mapping):
                    fields.setdefault(key, set()).add(str(k))
                elif key and isinstance(v, Mapping):
                    fields.setdefault(key, set()).update(str(f) for f, w in v.items() if not isinstance(w, list | Mapping))
        if key and rows:
            fields.setdefault(key, set())

    walk("", payload)
    entities = sorted(fields)
    columns = {e: sorted(fields[e]) for e in entities}
    out: dict[str, Any] = {"entities": entities, "fields": columns}
    if entities:
        out["default_entity"] = "accounts" if "accounts" in entities else entities[0]
        out["default_fields_by_entity"] = {e: c[:5] for e, c in columns.items() if c}
    return out


def join_columns(catalog: Catalog, entity: str, r: Relation) -> tuple[str, str]:
    """Columns of a relation: declared ones, or `target.entityId = entity.id`, or the reverse if only that exists."""
    if r.left and r.right:
        return r.left, r.right
    child = f"{singular(entity)}Id"
    if catalog.find(r.target, child) or not catalog.find(entity, f"{singular(r.target)}Id"):
        return "id", catalog.find(r.target, child) or child
    return catalog.find(entity, f"{singular(r.target)}Id") or "id", "id"
