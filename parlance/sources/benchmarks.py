"""Public text-to-SQL benchmark folders as examples, and runs over them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..evaluate import Example, Row, evaluate, frame, report, summary
from ..plans.ir import PlanError

#: Column kinds of a tables file.
KINDS = {"text": "string", "number": "double", "time": "string", "boolean": "boolean", "others": "string"}


def read_json(spark: SparkSession, path: str) -> Any:
    """A whole JSON file by Spark's reader, so that any store will do."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def _first(spark: SparkSession, paths: Iterable[str]) -> Any:
    tried = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return read_json(spark, path)
        tried.append(path)
    raise PlanError(f"none of {tried} exists")


def catalog_of(entry: dict[str, Any]) -> dict[str, Any]:
    """A declaration of one database of a tables file: entities, fields, aliases from plain names, and every foreign key
    as a relation from both of its ends."""
    names = list(entry.get("table_names_original") or entry.get("table_names") or ())
    plain = list(entry.get("table_names") or names)
    columns = entry.get("column_names_original") or entry.get("column_names") or []
    shown = entry.get("column_names") or columns
    kinds = entry.get("column_types") or []
    fields: dict[str, list[str]] = {n: [] for n in names}
    types: dict[str, dict[str, str]] = {n: {} for n in names}
    aliases: dict[str, str] = {}
    for i, (t, column) in enumerate(columns):
        if t < 0:
            continue
        fields[names[t]].append(column)
        types[names[t]][column] = KINDS.get(kinds[i] if i < len(kinds) else "text", "string")
        if i < len(shown) and shown[i][1].lower() != column.lower():
            aliases.setdefault(f"{names[t]}.{shown[i][1].lower()}", column)
    relations: dict[str, dict[str, Any]] = {}
    for a, b in entry.get("foreign_keys") or ():
        (ta, ca), (tb, cb) = columns[a], columns[b]
        for (t, c), (u, d) in (((names[ta], ca), (names[tb], cb)), ((names[tb], cb), (names[ta], ca))):
            own = relations.setdefault(t, {})
            own[u if u not in own else f"{u}_{c}"] = {"target": u, "left": c, "right": d, "aliases": [u.replace("_", " ")]}
    entities = {p.lower(): n for n, p in zip(names, plain, strict=False) if p.lower() != n.lower()}
    return {"entities": names, "fields": fields, "types": types, "relations": relations, "mapping": {"entities": entities, "fields": aliases}}


def _examples(rows: list[dict[str, Any]], schemas: dict[str, dict[str, Any]], query_keys: tuple[str, ...], limit: int | None, databases: set[str] | None) -> list[Example]:
    out = []
    for r in rows:
        if limit is not None and len(out) >= limit:
            break
        if databases and r.get("db_id") not in databases:
            continue
        query = next((r[k] for k in query_keys if r.get(k)), None)
        if not query or not r.get("question"):
            raise PlanError(f"an example of {r.get('db_id')!r} has no question or query")
        context = {"evidence": r["evidence"]} if r.get("evidence") else {}
        out.append(Example(r["question"], query, "sql", schemas.get(r.get("db_id", "")), None, context, {"db_id": r.get("db_id", ""), "difficulty": r.get("difficulty", "unknown")}))
    return out


def spider(spark: SparkSession, root: str, split: str = "dev", limit: int | None = None, databases: set[str] | None = None) -> list[Example]:
    """Examples of a folder with tables.json and <split>.json."""
    schemas = {t["db_id"]: catalog_of(t) for t in read_json(spark, f"{root}/tables.json")}
    return _examples(_first(spark, [f"{root}/{split}.json", f"{root}/{split}_spider.json"]), schemas, ("query", "SQL"), limit, databases)


def bird(spark: SparkSession, root: str, split: str = "dev", limit: int | None = None, databases: set[str] | None = None) -> list[Example]:
    """Examples of a folder with <split>.json and <split>_tables.json; evidence goes into the context."""
    rows = _first(spark, [f"{root}/{split}.json", f"{root}/{split}/{split}.json"])
    tables = _first(spark, [f"{root}/{split}_tables.json", f"{root}/{split}/{split}_tables.json", f"{root}/tables.json"])
    return _examples(rows, {t["db_id"]: catalog_of(t) for t in tables}, ("SQL", "query"), limit, databases)


def run(spark: SparkSession, engine: Any, examples: list[Example], backend: Any = None, mode: str = "execution", ordered: bool = False) -> tuple[list[Row], DataFrame, str]:
    """(rows, accuracies by difficulty, text) of a benchmark."""
    rows = evaluate(engine, examples, backend, mode, ordered)
    by = report(frame(spark, rows)) if rows else spark.createDataFrame([], "difficulty string, n long, structural double, execution double")
    return rows, by.orderBy(F.col("difficulty")), summary(rows)
