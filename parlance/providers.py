"""Language-model providers: a protocol, an offline echo, an HTTP client; reading of what they write."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any, Protocol

from .plans.catalog import Catalog, join_columns
from .plans.ir import FUNCTIONS, Aggregate, Having, Join, PlanError, Query, decode_filters
from .plans.planner import validate

#: How much of a catalog an intent prompt shows.
MOST_ENTITIES, MOST_FIELDS, MOST_ALIASES = 50, 100, 100


class Provider(Protocol):
    def complete(self, system: str, prompt: str, schema: dict[str, Any] | None = None) -> str: ...


class Echo:
    """The offline provider: it gives the prompt back, so callers fall back to the rules."""

    def complete(self, system: str, prompt: str, schema: dict[str, Any] | None = None) -> str:
        return prompt


@dataclass
class Scripted:
    """Gives prepared answers in turn; for tests."""

    answers: list[str]
    prompts: list[str] = field(default_factory=list)

    def complete(self, system: str, prompt: str, schema: dict[str, Any] | None = None) -> str:
        self.prompts.append(prompt)
        return self.answers.pop(0)


@dataclass
class HttpChat:
    """A chat-completions endpoint. 429 and network errors are retried, after Retry-After or a linear wait."""

    url: str
    key: str
    model: str
    timeout: float = 30.0
    retries: int = 2
    wait: float = 1.0

    def complete(self, system: str, prompt: str, schema: dict[str, Any] | None = None) -> str:
        body: dict[str, Any] = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "intent", "schema": schema}}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return str(json.load(reply)["choices"][0]["message"]["content"])
            except urllib.error.HTTPError as e:
                if e.code != 429 or attempt == self.retries:
                    raise RuntimeError(f"provider answered {e.code}") from e
                pause = e.headers.get("Retry-After") or ""
                time.sleep(float(pause) if re.fullmatch(r"\d+(\.\d+)?", pause) else self.wait * (attempt + 1))
            except urllib.error.URLError as e:
                if attempt == self.retries:
                    raise RuntimeError(f"provider cannot be reached: {e.reason}") from e
                time.sleep(self.wait * (attempt + 1))
        raise RuntimeError("provider gave no answer")


INTENT_SCHEMA: dict[str, Any] = {
    "type": "object",
    "required": ["entity"],
    "properties": {
        "entity": {"type": "string"},
        "fields": {"type": "array", "items": {"type": "string"}},
        "filters": {"type": "object"},
        "joins": {"type": "array", "items": {"type": "object", "properties": {"relation": {"type": "string"}, "fields": {"type": "array", "items": {"type": "string"}}, "filters": {"type": "object"}}}},
        "aggregations": {"type": "array", "items": {"type": "object", "properties": {"function": {"enum": list(FUNCTIONS)}, "field": {"type": "string"}, "alias": {"type": "string"}}}},
        "having": {"type": "array", "items": {"type": "object"}},
        "order_by": {"type": ["string", "null"]},
        "order_dir": {"enum": ["ASC", "DESC", None]},
        "limit": {"type": ["integer", "null"]},
        "offset": {"type": ["integer", "null"]},
        "distinct": {"type": "boolean"},
    },
}


def describe(catalog: Catalog) -> str:
    """The catalog as prompt text, within the caps."""
    lines = []
    for e in catalog.entities[:MOST_ENTITIES]:
        lines.append(f"{e}({', '.join(catalog.columns(e)[:MOST_FIELDS])})")
        lines += [f"  {e} -> {r.target} as {n}" for n, r in catalog.relations.get(e, {}).items()]
    lines += [f"alias {a} = {c}" for a, c in list({**catalog.entity_aliases, **catalog.field_aliases}.items())[:MOST_ALIASES]]
    return "\n".join(lines)


def first_json(text: str) -> dict[str, Any]:
    """The first JSON object in a text, fenced or bare."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text[m.start() :])
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise PlanError("the provider's answer holds no JSON object")


def read_query(provider: Provider, text: str, target: str, catalog: Catalog) -> str:
    """The query text that a provider writes; an echo of the prompt is no answer."""
    prompt = f"Write one {'GraphQL query' if target == 'graphql' else 'Spark SQL SELECT'} for: {text}\n{describe(catalog)}"
    answer = provider.complete("You translate questions into queries.", prompt)
    fenced = re.search(r"```(?:\w+)?\s*(.*?)```", answer, re.S)
    body = (fenced[1] if fenced else answer).strip()
    if body == prompt.strip():
        raise PlanError("the provider gave no query")
    m = re.search(r"\{.*\}" if target == "graphql" else r"(?is)\b(?:select|with)\b.*", body, re.S)
    if not m:
        raise PlanError("the provider gave no query")
    return m[0].strip().rstrip(";")


def plan_from_intent(provider: Provider, text: str, target: str, catalog: Catalog, notes: list[str]) -> Query:
    """A plan from the intent that a provider writes as JSON: expanded, checked against the catalog."""
    found = first_json(provider.complete("You describe questions as JSON intents.", f"{text}\n{describe(catalog)}", INTENT_SCHEMA))
    if found.get("entity") is None:
        raise PlanError("the intent names no entity")
    entity = str(found["entity"])
    entity = catalog.entity_aliases.get(entity.lower(), entity)
    filters, groups = decode_filters(_expanded(found.get("filters") or {}), set(catalog.columns(entity)))
    joins = []
    for j in found.get("joins") or ():
        relation = catalog.relation(entity, str(j.get("relation")))
        if relation is None:
            notes.append(f"relation {j.get('relation')!r} is unknown")
            continue
        own, _ = decode_filters(_expanded(j.get("filters") or {}), set(catalog.columns(relation.target)))
        joins.append(Join(relation.name, relation.target, *join_columns(catalog, entity, relation), tuple(j.get("fields") or ()), own))
    aggregates = tuple(Aggregate(str(a["function"]).upper(), str(a.get("field") or "*"), str(a.get("alias") or "")) for a in found.get("aggregations") or ())
    having = tuple(Having(str(h.get("function", "COUNT")).upper(), str(h.get("field", "*")), str(h.get("operator", ">")), h.get("value", 0)) for h in found.get("having") or ())
    q = Query(entity, tuple(map(str, found.get("fields") or ())), filters, groups, tuple(joins), (), aggregates, having, (), found.get("order_by"), found.get("order_dir"), found.get("limit"), found.get("offset"), bool(found.get("distinct")), target, text)
    return validate(q, catalog, notes)


def _expanded(filters: dict[str, Any]) -> dict[str, Any]:
    """`{price: {gte: 5}}` as `price_gte: 5`; other values as they stand."""
    out: dict[str, Any] = {}
    for k, v in filters.items():
        if isinstance(v, dict) and "$col" not in v:
            out |= {f"{k}_{op.lstrip('_$')}" if op.lstrip("_$") != "eq" else k: w for op, w in v.items()}
        else:
            out[k] = v
    return out
