"""Registered queries of the planner's phrases, the sources, JSON payloads, and the tools, over whole tables.

Payloads and in-line rows are built from `region` and `nation`, which hold a world's few countries at any scale factor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate, mapping, synth
from .engine import Engine
from .evaluate import Example
from .functions.text import novelty
from .plans.catalog import from_schema
from .plans.ir import Aggregate, Predicate, Query
from .sources import benchmarks, jsondata, tables
from .streaming import batch, live

Run = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(text: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = lambda found: found) -> Run:
    """A question over the driver's tables, some of which may be changed first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = change(tables.parquet(spark, sf_dir))
        return Engine(found, tables.catalog(found)).frame(text)

    return run


def pending(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only pending orders, so that most customers have none or few."""
    return found | {"orders": found["orders"].where("o_orderstatus = 'P'")}


def over(schema: Mapping[str, Any], text: str, make: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]], intents: Mapping[str, Any] | None = None) -> Run:
    """A question over tables made from the driver's, under a declared schema."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = make(lambda name: read(spark, sf_dir, name))
        return Engine(found, from_schema({**schema, **(intents or {})}, None, found)).frame(text)

    return run


def planned(column: str, table: str, question: str, target: str = "sql") -> Run:
    """Plans of one question for each value of a column, in bulk."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = read(spark, sf_dir, table).select(F.col(column).cast("string").alias("v")).distinct()
        questions = values.select(F.xxhash64("v").alias("req_id"), F.format_string(question, "v").alias("text"))
        found = tables.parquet(spark, sf_dir)
        return batch.plan_all(questions, tables.catalog(found), target).select("entity", "query", "n_notes")

    return run


def world(spark: SparkSession, sf_dir: str) -> dict[str, Any]:
    """A payload of regions with their nations."""
    rows = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).orderBy("n_nationkey").collect()
    regions: dict[int, dict[str, Any]] = {}
    for r in rows:
        own = regions.setdefault(r["r_regionkey"], {"r_name": r["r_name"], "detail": {"r_regionkey": r["r_regionkey"]}, "nations": []})
        own["nations"].append({"n_nationkey": r["n_nationkey"], "n_name": r["n_name"], "place": {"n_regionkey": r["n_regionkey"]}})
    return {"world": {"regions": [regions[k] for k in sorted(regions)]}}


def json_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsondata.tables(spark, world(spark, sf_dir))["nations"].select("n_nationkey", "n_name", "n_regionkey")


def json_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [jsondata.flatten(r) for r in world(spark, sf_dir)["world"]["regions"]]
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"]) for r in rows], "r_regionkey int, r_name string")


def json_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, error = jsondata.sql(spark, "SELECT n_regionkey, count(*) AS n FROM nations GROUP BY n_regionkey", world(spark, sf_dir))
    if error:
        raise RuntimeError(error)
    return spark.createDataFrame([(int(r["n_regionkey"]), r["n"]) for r in rows], "n_regionkey long, n long")


def json_run(q: Query, schema: str) -> Run:
    """A plan on the payload, under the JSON walk's rules."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = jsondata.run(spark, q, world(spark, sf_dir))
        names = [c.split()[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return run


def in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [r.asDict() for r in read(spark, sf_dir, "nation").collect()]
    executor = tables.executor_from_rows(spark, {"countries": rows})
    return executor.frame("SELECT n_name, n_regionkey * 10 AS tens FROM countries WHERE n_regionkey IN (SELECT max(n_regionkey) FROM countries)")


def callable_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executor as the back end of an evaluation: its rows come back as dictionaries, within its cap."""
    backend = tables.Executor(spark, {"nation": read(spark, sf_dir, "nation")}, 10)
    rows = backend("SELECT n_nationkey FROM nation ORDER BY n_nationkey")
    return spark.createDataFrame([(r["n_nationkey"],) for r in rows], "n_nationkey int")


def sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written as partitioned Parquet and read back."""
    path = f"{live.shared_dir(spark).rstrip('/')}/sinks/orders-{uuid.uuid4().hex}"
    tables.save(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, by=["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view loaded with one table's rows and then with another's."""
    executor = tables.Executor(spark, {"people": read(spark, sf_dir, "customer").selectExpr("c_name AS who", "c_nationkey AS nation")}, None)
    executor.load("people", read(spark, sf_dir, "supplier").selectExpr("s_name AS who", "s_nationkey AS nation"), "append")
    return executor.frame("SELECT nation, count(*) AS n FROM people GROUP BY nation")


def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Executor(spark, {"orders": read(spark, sf_dir, "orders")}, 100).frame("SELECT o_orderkey AS credit_limit FROM orders").agg(F.count("*").alias("n"))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of `conversations` as an example of a dataset, some of them broken."""
    turns = read(spark, sf_dir, "conversations")
    rows = turns.selectExpr("CASE WHEN turn % 7 = 3 THEN '  ' ELSE text END AS text", "CASE WHEN turn % 5 = 2 THEN '' ELSE role END AS expected_query", "CASE WHEN conv_id % 3 = 0 THEN 'sql' WHEN conv_id % 3 = 1 THEN role END AS target")
    return evaluate.validate(rows).groupBy("state").agg(F.count("*").alias("n"))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of all orders, taken as evaluation rows of which some were not run."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS difficulty", "o_totalprice > 150000 AS structural", "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS execution")
    return evaluate.report(rows)


def benchmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark of questions about each status and each segment, run against the tables."""
    found = tables.parquet(spark, sf_dir)
    examples = []
    for table, column, word in (("orders", "o_orderstatus", "status"), ("customer", "c_mktsegment", "market segment")):
        for r in found[table].select(column).distinct().orderBy(column).collect():
            examples.append(Example(f"how many {table} with {word} {r[0]}", f"SELECT COUNT(*) AS count FROM {table} WHERE {column} = '{r[0]}'", "sql", metadata={"difficulty": word}))
    return benchmarks.run(spark, Engine(found, tables.catalog(found)), examples, tables.Executor(spark, found))[1]


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string column of every table."""
    out = None
    for name in tables.TABLES:
        one = mapping.profile(read(spark, sf_dir, name))
        out = one if out is None else out.unionByName(one)
    return out


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every turn of `conversations`."""
    return synth.spread(read(spark, sf_dir, "conversations").select(F.xxhash64("conv_id", "turn").alias("req_id"), "text"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each part's name as a variant of its type: confidence and novelty by their weights."""
    new = novelty(F.col("p_name"), F.col("p_type"))
    sure = F.col("p_size") / F.lit(100.0)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), synth.CONFIDENCE_WEIGHT * sure + synth.NOVELTY_WEIGHT * new))
    return read(spark, sf_dir, "part").select("p_partkey", F.round(value, 9).alias("rank"))


_STRINGS = {"region": "r_name", "nation": "n_name", "customer": "c_name c_mktsegment", "supplier": "s_name", "part": "p_name p_brand p_type", "orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "events": "event_type props"}
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda x: x <> ''))"
#: Two invented tables whose columns follow the convention `<table>Id` and `id`.
_SHOPS = {"entities": ["visits", "visitors"], "relations": {"visits": {"visitors": {"target": "visitors", "aliases": ["visitor"]}}}}
_ON = {"entities": ["orders", "customer"], "relations": {"orders": {"customer": {"target": "customer", "on": "orders.o_custkey = customer.c_custkey", "aliases": ["buyer"]}}}}
_RULE = {"keyword_intents": [{"keywords": ["urgent"], "entity": "orders", "fields": ["o_orderkey"], "filters": {"o_orderpriority": "1-URGENT"}}, {"keywords": ["dearest", "order"], "entity": "orders", "aggregate": {"function": "max", "field": "o_totalprice"}}]}
_ORDERS = {"entities": ["orders"]}


def _visits(read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    return {"visits": read("orders").selectExpr("o_orderkey AS id", "o_custkey AS visitorId", "o_orderstatus AS state"), "visitors": read("customer").selectExpr("c_custkey AS id", "c_name AS fullName", "c_mktsegment AS kind")}


_ORDER_SQL = "SELECT o_orderkey FROM orders WHERE "
QUERIES: dict[str, tuple[Run, str | None]] = {
    "nl_month": (asked("how many orders in January 1995"), """SELECT COUNT(*) AS "count" FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'"""),
    "nl_year": (asked("how many orders placed in 1995"), """SELECT COUNT(*) AS "count" FROM orders WHERE year(o_orderdate) = 1995"""),
    "nl_after_year": (asked("show o_orderkey of orders after 1995"), _ORDER_SQL + "year(o_orderdate) > 1995"),
    "nl_since_month": (asked("show o_orderkey of orders since 1997-06"), _ORDER_SQL + "o_orderdate >= TIMESTAMP '1997-06-01'"),
    "nl_before_date": (asked("show o_orderkey of orders before 1993-02-03"), _ORDER_SQL + "o_orderdate < TIMESTAMP '1993-02-03'"),
    "nl_years_between": (asked("how many orders per status between 1993 and 1994"), """SELECT o_orderstatus, COUNT(*) AS "count" FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1994 GROUP BY 1"""),
    "nl_without": (asked("show c_name of customers with no orders", pending), "SELECT c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "nl_having_few": (asked("which customers have fewer than 2 orders", pending), "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey GROUP BY 1 HAVING COUNT(o_custkey) < 2"),
    "nl_having_exactly": (asked("which customers have exactly 1 orders", pending), "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING COUNT(*) = 1"),
    "nl_negation": (asked("show o_orderkey of orders where status is not F"), _ORDER_SQL + "o_orderstatus <> 'F'"),
    "nl_amount": (asked("show l_orderkey and l_linenumber of line items with more than 45 quantity"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45"),
    "nl_order": (asked("show o_orderkey of orders with the highest o_orderkey"), "SELECT MAX(o_orderkey) AS o_orderkey FROM orders"),
    "nl_offset": (asked("show o_orderkey of orders sorted by o_orderkey asc limit 5 offset 10"), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5 OFFSET 10"),
    "nl_sum": (asked("sum of l_linenumber of line items per return flag"), "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1"),
    "nl_join_filter": (asked("show o_orderkey of orders whose customer market segment is BUILDING"), "SELECT o_orderkey, c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "nl_null": (asked("show o_orderkey of orders where o_orderpriority is null", lambda t: t | {"orders": t["orders"].selectExpr("o_orderkey", "nullif(o_orderpriority, '5-LOW') AS o_orderpriority")}), _ORDER_SQL + "o_orderpriority = '5-LOW'"),
    "nl_owned": (over({"entities": ["timber"]}, "how many asia do i own", lambda read: {"timber": read("region").selectExpr("r_name AS code", "r_regionkey AS quantity")}), "SELECT r_regionkey AS quantity FROM region WHERE r_name = 'ASIA'"),
    "nl_keyword_rule": (over(_ORDERS, "everything urgent", lambda read: {"orders": read("orders")}, _RULE), _ORDER_SQL + "o_orderpriority = '1-URGENT'"),
    "nl_keyword_aggregate": (over(_ORDERS, "the dearest order", lambda read: {"orders": read("orders")}, _RULE), "SELECT MAX(o_totalprice) AS max_o_totalprice FROM orders"),
    "join_declared_on": (over(_ON, "show o_orderkey of orders with buyer c_name", lambda read: {"orders": read("orders"), "customer": read("customer")}), "SELECT o_orderkey, c_name AS customer_c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "join_by_convention": (over(_SHOPS, "show state of visits with visitor kind", _visits), "SELECT o_orderstatus AS state, c_mktsegment AS visitors_kind FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "bulk_sql_text": (
        planned("o_custkey", "orders", "show o_orderkey of orders where o_custkey = %s"),
        "SELECT DISTINCT 'orders' AS entity, 'SELECT `orders`.`o_orderkey` FROM `orders` AS `orders` WHERE `orders`.`o_custkey` = ' || o_custkey AS query, 0 AS n_notes FROM orders",
    ),
    "bulk_graphql_text": (
        planned("o_custkey", "orders", "show o_orderkey of orders where o_custkey = %s", "graphql"),
        "SELECT DISTINCT 'orders' AS entity, '{' || chr(10) || '  orders(o_custkey: ' || o_custkey || ') {' || chr(10) || '    o_orderkey' || chr(10) || '  }' || chr(10) || '}' AS query, 0 AS n_notes FROM orders",
    ),
    "bulk_notes": (planned("p_size", "part", "how many regions weigh %s"), "SELECT 'region' AS entity, 'SELECT COUNT(*) AS `count` FROM `region` AS `region`' AS query, 1 AS n_notes FROM (SELECT DISTINCT p_size FROM part)"),
    "json_tables": (json_table, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "json_flatten": (json_flat, "SELECT r_regionkey, r_name FROM region"),
    "json_sql": (json_sql, "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1"),
    "json_plan": (json_run(Query("nations", ("n_name",), (Predicate("n_regionkey", 2, "gte"),)), "n_name string"), "SELECT n_name FROM nation WHERE n_regionkey >= 2"),
    "json_slice": (json_run(Query("regions", ("r_name",), limit=2, offset=1), "r_name string"), "SELECT r_name FROM region ORDER BY r_regionkey LIMIT 2 OFFSET 1"),
    "json_limit_before_agg": (
        json_run(Query("region", ("r_regionkey",), aggregates=(Aggregate("COUNT"), Aggregate("SUM", "r_regionkey"), Aggregate("MAX", "r_regionkey")), limit=3), "count long, sum_r_regionkey double, max_r_regionkey double"),
        'SELECT COUNT(*) AS "count", CAST(SUM(r_regionkey) AS DOUBLE) AS sum_r_regionkey, CAST(MAX(r_regionkey) AS DOUBLE) AS max_r_regionkey FROM (SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 3)',
    ),
    "rows_in_memory": (in_memory, "SELECT n_name, n_regionkey * 10 AS tens FROM nation WHERE n_regionkey = (SELECT MAX(n_regionkey) FROM nation)"),
    "backend_rows": (callable_backend, "SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 10"),
    "load_append": (appended, "SELECT nation, COUNT(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1"),
    "sink_parquet": (sink, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "row_cap": (row_cap, "SELECT LEAST(100, COUNT(*)) AS n FROM orders"),
    "map_profile": (profiled, " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS field, lower({c}) AS alias, {c} AS value FROM {t} WHERE {c} IS NOT NULL AND (SELECT COUNT(DISTINCT {c}) FROM {t}) <= 200" for t, cs in _STRINGS.items() for c in cs.split())),
    "dataset_validate": (
        validated,
        "SELECT CASE WHEN turn % 7 = 3 OR trim(coalesce(text, '')) = '' THEN 'empty text' WHEN turn % 5 = 2 OR trim(coalesce(role, '')) = '' THEN 'empty query' WHEN conv_id % 3 = 1 AND role NOT IN ('sql', 'graphql') THEN 'unknown target' ELSE 'ok' END AS state, COUNT(*) AS n FROM conversations GROUP BY 1",
    ),
    "eval_report": (reported, "SELECT o_orderpriority AS difficulty, COUNT(*) AS n, AVG(CASE WHEN o_totalprice > 150000 THEN 1.0::DOUBLE ELSE 0 END) AS structural, AVG(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS execution FROM orders GROUP BY 1"),
    "bench_report": (benchmarked, "SELECT 'status' AS difficulty, COUNT(DISTINCT o_orderstatus) AS n, 1.0::DOUBLE AS structural, 1.0::DOUBLE AS execution FROM orders UNION ALL SELECT 'market segment', COUNT(DISTINCT c_mktsegment), 1.0::DOUBLE, 1.0::DOUBLE FROM customer"),
    "synth_examples": (examples, None),
    "synth_rank": (
        ranked,
        f"WITH w AS (SELECT p_partkey, p_size, {_WORDS.format('p_name')} AS a, {_WORDS.format('p_type')} AS b FROM part) SELECT p_partkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.6::DOUBLE * (p_size / 100.0::DOUBLE) + 0.4::DOUBLE * CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END)), 9) AS rank FROM w",
    ),
}
