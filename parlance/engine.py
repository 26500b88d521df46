"""The front door: a question and a catalog in, a plan, its texts and a lazy DataFrame out."""

from __future__ import annotations

import asyncio
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .operators.compile import compile_query
from .plans.catalog import Catalog, from_schema
from .plans.ir import PlanError, Query, to_dict
from .plans.planner import Planner
from .plans.render import render_graphql, render_sql
from .providers import Provider, plan_from_intent, read_query


@dataclass
class Result:
    """A question's outcome. `frame` is lazy: Spark runs when it is used. Text that a provider wrote is run by the guarded
    executor, with its cap on rows."""

    text: str
    target: str
    query: str
    plan: Query | None
    confidence: float
    notes: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] | None = None

    @property
    def frame(self) -> DataFrame:
        if self.tables is None:
            raise PlanError("no tables were given")
        if self.plan is None:
            from .sources.tables import Executor

            spark = next(iter(self.tables.values())).sparkSession
            return Executor(spark, self.tables).frame(self.query)
        return compile_query(self.plan, self.tables)


class Engine:
    """Answers questions over tables and declared schemas.

    `mode` is deterministic, function_calling (a provider writes an intent, which is checked and compiled) or llm (a
    provider writes the query text). Whatever fails in the provider modes falls back to the rules, with a note.
    """

    def __init__(self, tables: Mapping[str, DataFrame] | None = None, catalog: Catalog | None = None, provider: Provider | None = None):
        self.tables, self.catalog, self.provider = tables, catalog, provider

    def generate(self, text: str, target: str = "sql", schema: Mapping[str, Any] | None = None, mapping: Mapping[str, Any] | None = None, mode: str = "deterministic", strict: bool = False) -> Result:
        catalog = self.catalog if self.catalog is not None and not schema and not mapping else from_schema(schema, mapping, self.tables)
        notes: list[str] = []
        if mode != "deterministic" and self.provider is not None:
            try:
                if mode == "function_calling":
                    q = plan_from_intent(self.provider, text, target, catalog, notes)
                    return self._result(text, target, q, 0.8, notes, mode)
                return Result(text, target, read_query(self.provider, text, target, catalog), None, 0.8, [], {"mode": mode}, self.tables)
            except (PlanError, RuntimeError, TypeError, ValueError, KeyError) as e:
                notes.append(f"llm_error: {e}")
        plan = Planner(catalog, target, strict).plan(text)
        return self._result(text, target, plan.query, plan.confidence, [*notes, *plan.notes], "deterministic")

    def _result(self, text: str, target: str, q: Query, confidence: float, notes: list[str], mode: str) -> Result:
        rendered = render_graphql(q) if target == "graphql" else render_sql(q)
        return Result(text, target, rendered, q, confidence, notes, to_dict(q) | {"mode": mode}, self.tables)

    def frame(self, text: str, **options: Any) -> DataFrame:
        return self.generate(text, **options).frame

    async def agenerate(self, text: str, **options: Any) -> Result:
        return await asyncio.to_thread(self.generate, text, **options)

    async def agenerate_many(self, texts: Iterable[str], concurrency: int = 5, **options: Any) -> list[Result]:
        """Results in the order of the questions, at most `concurrency` at a time."""
        gate = asyncio.Semaphore(concurrency)

        async def one(text: str) -> Result:
            async with gate:
                return await self.agenerate(text, **options)

        return list(await asyncio.gather(*map(one, texts)))
