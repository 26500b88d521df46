"""Command line: plan a question, run it, make mappings and variants, run a benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from . import mapping as mappings
from . import synth
from .engine import Engine
from .evaluate import same_rows
from .plans.catalog import from_schema, infer
from .plans.ir import PlanError
from .providers import Echo, HttpChat, Provider
from .rewrite import rewrite


def session() -> Any:
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("parlance").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parlance", description=__doc__)
    p.add_argument("text", nargs="?", help="the question")
    p.add_argument("--target", choices=("sql", "graphql"), default="sql")
    p.add_argument("--mode", choices=("deterministic", "function_calling", "llm"), default="deterministic")
    for name in ("schema", "mapping", "payload"):
        p.add_argument(f"--{name}", help="inline JSON")
        p.add_argument(f"--{name}-file", help="JSON file; inline JSON is laid over it")
    p.add_argument("--tables", help="folder of Parquet tables to run the plan on")
    p.add_argument("--table-names", nargs="*", default=[])
    p.add_argument("--root-key")
    p.add_argument("--expected-query", help="compare the rows with those of this query")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--rewrite", action="store_true")
    p.add_argument("--variants", type=int, default=0)
    p.add_argument("--write-mapping", metavar="FILE")
    p.add_argument("--benchmark", choices=("spider", "bird"))
    p.add_argument("--benchmark-root")
    p.add_argument("--benchmark-mode", choices=("exact", "structural", "execution"), default="structural", help="execution runs both queries over --tables")
    p.add_argument("--benchmark-db", nargs="*", default=[], help="only these databases")
    p.add_argument("--expected-file", help="JSON list of rows to compare the rows with")
    p.add_argument("--provider", choices=("echo", "http"), default="echo", help="who answers in the provider modes")
    p.add_argument("--provider-url")
    p.add_argument("--provider-key-variable", default="", metavar="NAME", help="environment variable that holds the key")
    p.add_argument("--provider-model", default="")
    p.add_argument("--provider-timeout", type=float, default=30.0)
    p.add_argument("--provider-retries", type=int, default=2)
    p.add_argument("--limit", type=int)
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def provider(a: argparse.Namespace) -> Provider:
    """The provider that the options name; the echo makes the provider modes fall back to the rules, with a note."""
    if a.provider == "echo":
        return Echo()
    if not a.provider_url or not a.provider_model:
        raise PlanError("an HTTP provider needs --provider-url and --provider-model")
    return HttpChat(a.provider_url, os.environ.get(a.provider_key_variable, ""), a.provider_model, a.provider_timeout, a.provider_retries)


def load(inline: str | None, path: str | None) -> dict[str, Any]:
    """A JSON object from a file with the inline one laid over it."""
    out: dict[str, Any] = {}
    for text in (open(path, encoding="utf-8").read() if path else None, inline):
        if text:
            found = json.loads(text)
            if not isinstance(found, dict):
                raise PlanError("a JSON object is needed")
            out |= found
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        print(json.dumps(run(a), indent=2, default=str))
    except PlanError as e:
        print(json.dumps({"error": str(e), "issues": e.issues}), file=sys.stderr)
        return 2
    return 0


def run(a: argparse.Namespace) -> dict[str, Any]:
    schema, mapping, payload = load(a.schema, a.schema_file), load(a.mapping, a.mapping_file), load(a.payload, a.payload_file)
    if a.benchmark:
        from .sources import benchmarks

        spark = session()
        examples = getattr(benchmarks, a.benchmark)(spark, a.benchmark_root, limit=a.limit, databases=set(a.benchmark_db) or None)
        for e in examples:
            e.context.setdefault("mode", a.mode)
        backend = None
        if a.benchmark_mode == "execution":
            from .sources.tables import TABLES, Executor, parquet

            if not a.tables:
                raise PlanError("execution needs --tables")
            backend = Executor(spark, parquet(spark, a.tables, tuple(a.table_names) or TABLES))
        rows, _, text = benchmarks.run(spark, Engine(provider=provider(a)), examples, backend, a.benchmark_mode)
        out = {"examples": len(rows), "report": text.splitlines()}
        return out | ({"rows": [vars(r) for r in rows]} if a.verbose else {})
    if payload and not schema:
        schema = infer(payload.get(a.root_key, payload) if a.root_key else payload)
    tables = None
    if a.tables:
        from .sources.tables import TABLES, parquet

        tables = parquet(session(), a.tables, tuple(a.table_names) or TABLES)
    catalog = from_schema(schema, mapping, tables)
    out: dict[str, Any] = {}
    if a.write_mapping:
        os.makedirs(os.path.dirname(os.path.abspath(a.write_mapping)), exist_ok=True)
        with open(a.write_mapping, "w", encoding="utf-8") as f:
            json.dump(mappings.generate(catalog, tables), f, indent=2)
        out["mapping_file"] = a.write_mapping
    if not a.text:
        return out
    text = rewrite(a.text).text if a.rewrite else a.text
    result = Engine(tables, catalog, provider(a)).generate(text, a.target, mode=a.mode, strict=a.strict)
    out |= {"text": text, "target": a.target, "query": result.query, "confidence": result.confidence, "notes": result.notes}
    if a.verbose:
        out["plan"] = result.metadata
    if a.variants:
        out["variants"] = [{"text": t, "rank": round(r, 4)} for t, r in synth.variants(text, a.variants, ("generic", synth.domain(text, catalog), "frame"))]
    if tables is not None and result.plan is not None:
        out["rows"] = [r.asDict(recursive=True) for r in result.frame.limit(a.rows).collect()]
    elif payload and result.plan is not None:
        from .sources import jsondata

        spark = session()
        if a.target == "sql":
            out["rows"], out["error"] = jsondata.sql(spark, result.query, payload, a.root_key)
        else:
            out["rows"], out["note"] = jsondata.run(spark, result.plan, payload, a.root_key)
        if a.expected_file:
            with open(a.expected_file, encoding="utf-8") as f:
                out["match"] = same_rows(out["rows"], json.load(f))
        elif a.expected_query:
            expected, error = jsondata.sql(spark, a.expected_query, payload, a.root_key)
            out["match"] = error is None and same_rows(out["rows"], expected)
    return out


if __name__ == "__main__":
    sys.exit(main())
