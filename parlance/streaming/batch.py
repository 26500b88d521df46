"""Planning of many questions at once: a table of questions in, a table of plans out, partition by partition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from ..plans.ir import PlanError
from ..plans.planner import Planner
from ..plans.render import render_graphql, render_sql

#: Questions whose plans a task keeps at hand.
REMEMBERED = 20_000
SCHEMA = "req_id long, entity string, query string, confidence double, n_notes int, error string"


def plan_all(questions: DataFrame, catalog: Catalog, target: str = "sql") -> DataFrame:
    """Plans of a table (req_id, text), batch or streaming; a question that cannot be planned gives its error. Null texts
    are planned as empty ones. Rows are dealt evenly over the cores, and a task plans equal texts once while it remembers
    them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planner = Planner(catalog, target)

        @lru_cache(REMEMBERED)
        def planned(text: str) -> tuple:
            try:
                p = planner.plan(text)
                return p.query.entity, render_graphql(p.query) if target == "graphql" else render_sql(p.query), p.confidence, len(p.notes), None
            except PlanError as e:
                return None, None, 0.0, 0, str(e)

        for pdf in frames:
            rows = [(req, *planned(text or "")) for req, text in zip(pdf["req_id"], pdf["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["req_id", "entity", "query", "confidence", "n_notes", "error"])

    asked = questions.select(F.col("req_id").cast("long"), F.col("text").cast("string"))
    if not questions.isStreaming:
        asked = asked.repartition(questions.sparkSession.sparkContext.defaultParallelism)
    return asked.mapInPandas(run, SCHEMA)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of `conversations` as a question over the driver's tables."""
    from ..sources import tables

    found = tables.parquet(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.xxhash64("conv_id", "turn").alias("req_id"), "text")
    return plan_all(asked, tables.catalog(found))
