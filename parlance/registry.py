"""Registered queries over the driver's tables, each with the DuckDB SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_tools
from .engine import Engine
from .functions.text import novelty
from .operators.compile import compile_query
from .plans.ir import Aggregate, ColumnRef, Group, Having, Join, Nested, Predicate, Query, Subquery
from .plans.render import render_sql
from .sources import jsondata, tables
from .streaming import batch, live

Run = Callable[[SparkSession, str], DataFrame]
P, A, H = Predicate, Aggregate, Having
ORDERS_CUSTOMER = Join("customer", "customer", "o_custkey", "c_custkey", ("c_name", "c_mktsegment"))


def _open(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda entity: spark.read.parquet(f"{sf_dir}/{entity}.parquet")


def plan(q: Query, compat: str = "sql") -> Run:
    return lambda spark, sf_dir: compile_query(q, _open(spark, sf_dir), compat)


def rendered(q: Query) -> Run:
    """The plan as Spark SQL text, run over views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for entity in dict.fromkeys([q.entity, *(j.target for j in q.joins), *(s.target for s in q.subqueries)]):
            _open(spark, sf_dir)(entity).createOrReplaceTempView(entity)
        return spark.sql(render_sql(q))

    return run


def asked(text: str, names: tuple[str, ...] = tables.TABLES) -> Run:
    """A question in plain English, planned over the tables' own schemas."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tables.parquet(spark, sf_dir, names)
        return Engine(found, tables.catalog(found)).frame(text)

    return run


def q(entity: str, fields: str = "", *filters: Predicate, **more) -> Query:
    return Query(entity, tuple(fields.split()), tuple(filters), **more)


def _exploded(query: Query, path: str, columns: str) -> Run:
    """A nested plan with one row for each child, to compare with a flat join."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan(query)(spark, sf_dir)
        for part in path.split("."):
            df = df.select(*[c for c in df.columns if c != part], F.explode(part).alias("__c")).select("*", "__c.*").drop("__c")
        return df.select(*columns.split())

    return run


def _json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsondata.column(_open(spark, sf_dir)("events").select("event_id", "props"), "props", {"k": ("$.k", "bigint")}).select("event_id", "k")


def _outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a null quantity where there is no line: the nulls that the tables lack."""
    o, li = _open(spark, sf_dir)("orders"), _open(spark, sf_dir)("lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left").select("o_orderkey", "l_quantity", "l_returnflag")


def _json_compat(query: Query) -> Run:
    return lambda spark, sf_dir: compile_query(query, {"lines": _outer(spark, sf_dir)}, "json")


QUERIES: dict[str, tuple[Run, str | None]] = {
    "project_cols": (plan(q("orders", "o_orderkey o_totalprice")), "SELECT o_orderkey, o_totalprice FROM orders"),
    "select_all": (plan(q("nation")), "SELECT * FROM nation"),
    "distinct_segment": (plan(q("customer", "c_mktsegment", distinct=True)), "SELECT DISTINCT c_mktsegment FROM customer"),
    "filter_eq": (plan(q("orders", "o_orderkey", P("o_orderstatus", "F"))), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "filter_ne": (plan(q("orders", "o_orderkey", P("o_orderstatus", "F", "ne"))), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_gt": (plan(q("lineitem", "l_orderkey l_quantity", P("l_quantity", 40, "gt"))), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40"),
    "filter_gte": (plan(q("lineitem", "l_orderkey l_quantity", P("l_quantity", 40, "gte"))), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 40"),
    "filter_lt": (plan(q("lineitem", "l_orderkey l_quantity", P("l_quantity", 5, "lt"))), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 5"),
    "filter_lte": (plan(q("lineitem", "l_orderkey l_quantity", P("l_quantity", 5, "lte"))), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity <= 5"),
    "filter_in": (plan(q("events", "event_id", P("event_type", ["click", "view"], "in"))), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')"),
    "filter_nin": (plan(q("events", "event_id", P("event_type", ["click", "view"], "nin"))), "SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')"),
    "filter_is_null": (lambda s, d: compile_query(q("lines", "o_orderkey", P("l_quantity", None, "is_null")), {"lines": _outer(s, d)}), "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity IS NULL"),
    "filter_between_num": (plan(q("orders", "o_orderkey", P("o_totalprice", (1000, 50000), "range"))), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "filter_between_date": (plan(q("orders", "o_orderkey", P("o_orderdate", ("1995-01-01", "1996-06-30"), "range"))), "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'"),
    "filter_date_range": (plan(q("lineitem", "l_orderkey l_linenumber", P("l_shipdate", "1995-01-01", "gte"), P("l_shipdate", "1995-12-31", "lte"))), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1995-12-31'"),
    "filter_col_eq_col": (plan(q("lineitem", "l_orderkey l_suppkey", P("l_linenumber", ColumnRef("l_suppkey")))), "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = l_suppkey"),
    "group_and": (plan(q("orders", "o_orderkey", groups=(Group("and", (P("o_orderstatus", "O"), P("o_totalprice", 100000, "gt"))),))), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000"),
    "group_or": (plan(q("orders", "o_orderkey", groups=(Group("or", (P("o_orderstatus", "P"), P("o_totalprice", 400000, "gt"))),))), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000"),
    "group_not": (plan(q("orders", "o_orderkey", groups=(Group("not", (P("o_orderstatus", "O"), P("o_totalprice", 100000, "gt"))),))), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice > 100000)"),
    "group_nested": (plan(q("orders", "o_orderkey", groups=(Group("or", (Group("and", (P("o_orderstatus", "F"), P("o_totalprice", 200000, "gt"))), (P("o_orderstatus", "P"), Group("not", (P("o_totalprice", 100000, "lt"),)))),),))), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'P' AND NOT (o_totalprice < 100000))"),
    "sub_in": (plan(q("customer", "c_custkey", subqueries=(Subquery("c_custkey", "orders", "o_custkey", (P("o_orderstatus", "P"),), False),))), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "sub_not_in": (plan(q("customer", "c_custkey", subqueries=(Subquery("c_custkey", "orders", "o_custkey", (P("o_orderstatus", "F"),)),))), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "sub_not_in_null": (lambda s, d: compile_query(q("orders", "o_orderkey", subqueries=(Subquery("o_totalprice", "lines", "l_quantity"),)), {"orders": _open(s, d)("orders"), "lines": _outer(s, d)}), "SELECT o_orderkey FROM orders WHERE o_totalprice NOT IN (SELECT l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"),
    "join_left": (plan(q("orders", "o_orderkey", joins=(ORDERS_CUSTOMER,))), "SELECT o_orderkey, c_name AS customer_c_name, c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "join_inner": (plan(q("customer", "c_custkey", joins=(Join("orders", "orders", "c_custkey", "o_custkey", ("o_orderkey",), (), "INNER"),))), "SELECT c_custkey, o_orderkey AS orders_o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    "join_right": (plan(q("lineitem", "l_linenumber", joins=(Join("orders", "orders", "l_orderkey", "o_orderkey", ("o_orderkey",), (), "RIGHT"),))), "SELECT l_linenumber, o_orderkey AS orders_o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey"),
    "join_left_filtered": (plan(q("orders", "o_orderkey", joins=(Join("customer", "customer", "o_custkey", "c_custkey", ("c_name",), (P("c_mktsegment", "BUILDING"),)),))), "SELECT o_orderkey, c_name AS customer_c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "join_star_multi": (
        plan(q("lineitem", "l_orderkey l_linenumber", P("l_quantity", 45, "gt"), joins=(Join("orders", "orders", "l_orderkey", "o_orderkey", ("o_orderstatus",)), Join("part", "part", "l_partkey", "p_partkey", ("p_brand",)), Join("supplier", "supplier", "l_suppkey", "s_suppkey", ("s_name",))))),
        "SELECT l_orderkey, l_linenumber, o_orderstatus AS orders_o_orderstatus, p_brand AS part_p_brand, s_name AS supplier_s_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45",
    ),
    "join_same_target_twice": (
        plan(q("lineitem", "l_orderkey", P("l_quantity", 49, "gt"), joins=(Join("orders", "orders", "l_orderkey", "o_orderkey", ("o_orderstatus",)), Join("first_order", "orders", "l_linenumber", "o_orderkey", ("o_totalprice",))))),
        "SELECT l_orderkey, a.o_orderstatus AS orders_o_orderstatus, b.o_totalprice AS orders_o_totalprice FROM lineitem LEFT JOIN orders a ON l_orderkey = a.o_orderkey LEFT JOIN orders b ON l_linenumber = b.o_orderkey WHERE l_quantity > 49",
    ),
    "agg_count": (plan(q("orders", aggregates=(A("COUNT", "*", "count"),))), 'SELECT COUNT(*) AS "count" FROM orders'),
    "agg_sum": (plan(q("lineitem", aggregates=(A("SUM", "l_linenumber"),))), "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem"),
    "agg_avg": (plan(q("lineitem", aggregates=(A("AVG", "l_linenumber"),))), "SELECT AVG(l_linenumber) AS avg_l_linenumber FROM lineitem"),
    "agg_min": (plan(q("orders", aggregates=(A("MIN", "o_totalprice"), A("MIN", "o_orderdate")))), "SELECT MIN(o_totalprice) AS min_o_totalprice, MIN(o_orderdate) AS min_o_orderdate FROM orders"),
    "agg_max": (plan(q("orders", aggregates=(A("MAX", "o_totalprice"),))), "SELECT MAX(o_totalprice) AS max_o_totalprice FROM orders"),
    "agg_count_distinct": (plan(q("orders", aggregates=(A("COUNT", "DISTINCT o_custkey", "customers"),))), "SELECT COUNT(DISTINCT o_custkey) AS customers FROM orders"),
    "agg_expr": (plan(q("lineitem", aggregates=(A("SUM", "l_linenumber + l_orderkey", "s"), A("MAX", "l_orderkey - l_linenumber", "m")))), "SELECT CAST(SUM(l_linenumber + l_orderkey) AS BIGINT) AS s, MAX(l_orderkey - l_linenumber) AS m FROM lineitem"),
    "agg_dual_extrema": (plan(q("part", aggregates=(A("MAX", "p_size"), A("MIN", "p_size")))), "SELECT MAX(p_size) AS max_p_size, MIN(p_size) AS min_p_size FROM part"),
    "group_by_one": (plan(q("orders", "o_orderstatus", aggregates=(A("COUNT", "*", "count"),))), 'SELECT o_orderstatus, COUNT(*) AS "count" FROM orders GROUP BY 1'),
    "group_by_two": (plan(q("lineitem", "l_returnflag l_linestatus", aggregates=(A("COUNT", "*", "count"), A("MAX", "l_quantity")))), 'SELECT l_returnflag, l_linestatus, COUNT(*) AS "count", MAX(l_quantity) AS max_l_quantity FROM lineitem GROUP BY 1, 2'),
    "group_by_join_col": (plan(q("customer", "", aggregates=(A("COUNT", "*", "count"),), joins=(Join("nation", "nation", "c_nationkey", "n_nationkey", ("n_name",)),))), 'SELECT n_name AS nation_n_name, COUNT(*) AS "count" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1'),
    "having_count": (plan(q("orders", "o_custkey", having=(H("COUNT", "*", ">", 10),))), "SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) > 10"),
    "having_sum": (plan(q("lineitem", "l_suppkey", aggregates=(A("SUM", "l_linenumber"),), having=(H("SUM", "l_linenumber", ">=", 2000),))), "SELECT l_suppkey, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem GROUP BY 1 HAVING SUM(l_linenumber) >= 2000"),
    "having_multi": (plan(q("orders", "o_custkey", aggregates=(A("COUNT", "*", "n"),), having=(H("COUNT", "*", ">=", 5), H("MAX", "o_totalprice", "<", 400000)))), "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) >= 5 AND MAX(o_totalprice) < 400000"),
    "order_limit": (plan(q("orders", "o_orderkey o_totalprice", order_by="o_orderkey", order_dir="DESC", limit=25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC NULLS LAST LIMIT 25"),
    "order_asc": (plan(q("nation", "n_name", order_by="n_nationkey", order_dir="ASC")), "SELECT n_name FROM nation ORDER BY n_nationkey NULLS LAST"),
    "limit_offset": (plan(q("orders", "o_orderkey", order_by="o_orderkey", order_dir="ASC", limit=10, offset=20)), "SELECT o_orderkey FROM orders ORDER BY o_orderkey NULLS LAST LIMIT 10 OFFSET 20"),
    "topk": (plan(q("customer", "c_name", order_by="c_custkey", order_dir="DESC", limit=5)), "SELECT c_name FROM customer ORDER BY c_custkey DESC NULLS LAST LIMIT 5"),
    "group_order_limit": (plan(q("orders", "o_custkey", aggregates=(A("COUNT", "*", "n"),), order_by="o_custkey", order_dir="DESC", limit=7)), "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC NULLS LAST LIMIT 7"),
    "direct_sql": (lambda s, d: tables.Executor(s, {"orders": _open(s, d)("orders")}, None).frame("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"), "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1"),
    "nested_one_hop": (
        _exploded(q("customer", "c_custkey", nested=(Nested("orders", "orders", "c_custkey", "o_custkey", ("o_orderkey", "o_orderstatus")),)), "orders", "c_custkey o_orderkey o_orderstatus"),
        "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey",
    ),
    "nested_two_hop": (
        _exploded(q("customer", "c_custkey", nested=(Nested("orders", "orders", "c_custkey", "o_custkey", ("o_orderkey",), (P("o_orderstatus", "F"),), (Nested("lines", "lineitem", "o_orderkey", "l_orderkey", ("l_linenumber", "l_quantity")),)),)), "orders.lines", "c_custkey o_orderkey l_linenumber l_quantity"),
        "SELECT c_custkey, o_orderkey, l_linenumber, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
    ),
    "nested_childless": (
        lambda s, d: plan(q("orders", "o_orderkey", nested=(Nested("lines", "lineitem", "o_orderkey", "l_orderkey", ("l_linenumber",)),)))(s, d).select("o_orderkey", F.size("lines").cast("long").alias("n")),
        "SELECT o_orderkey, COUNT(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "nested_limit": (
        _exploded(q("customer", "c_custkey", nested=(Nested("orders", "orders", "c_custkey", "o_custkey", ("o_orderkey",), (), (), "o_orderkey", "DESC", 2),)), "orders", "c_custkey o_orderkey"),
        "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS n FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n <= 2",
    ),
    "json_props": (_json_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_entity_rows": (
        lambda s, d: jsondata.entity_rows(_open(s, d)("orders").select("o_orderkey", F.to_json(F.struct(F.array(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))).alias("items"))).alias("j")), "j", "$.items", {"status": "string", "cust": "bigint"}),
        "SELECT o_orderkey, o_orderstatus AS status, o_custkey AS cust FROM orders",
    ),
    "json_compat_not": (_json_compat(q("lines", "o_orderkey", groups=(Group("not", (P("l_returnflag", "R"), P("l_quantity", 40, "gt"))),))), "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE NOT (coalesce(l_returnflag = 'R', false) OR coalesce(l_quantity > 40, false))"),
    "json_compat_ne_null": (_json_compat(q("lines", "o_orderkey", P("l_returnflag", "R", "ne"))), "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE coalesce(l_returnflag, 'null') <> 'R'"),
    "json_compat_nin_null": (_json_compat(q("lines", "o_orderkey", P("l_returnflag", ["R", "A"], "nin"))), "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE coalesce(l_returnflag, 'null') NOT IN ('R', 'A')"),
    "sqlite_text_gt": (plan(q("part", "p_partkey", P("p_size", 5, "gt")), "sqlite_text"), "SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) > '5'"),
    "sqlite_text_max": (plan(q("part", aggregates=(A("MAX", "p_size"),)), "sqlite_text"), "SELECT MAX(CAST(p_size AS VARCHAR)) AS max_p_size FROM part"),
    "sql_rendered": (
        rendered(q("orders", "o_orderstatus", P("o_totalprice", 1000, "gt"), aggregates=(A("COUNT", "*", "n"),), joins=(Join("customer", "customer", "o_custkey", "c_custkey", ("c_mktsegment",), (P("c_acctbal", 0, "gte"),)),), having=(H("COUNT", "*", ">", 5),))),
        "SELECT o_orderstatus, c_mktsegment AS customer_c_mktsegment, COUNT(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 AND c_acctbal >= 0 GROUP BY 1, 2 HAVING COUNT(*) > 5",
    ),
    "nl_count_per_status": (asked("how many orders per status"), 'SELECT o_orderstatus, COUNT(*) AS "count" FROM orders GROUP BY 1'),
    "nl_filter_value": (asked("show order key and total price of orders where total price > 300000"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000"),
    "nl_average_per_segment": (asked("average balance of customers for each market segment"), "SELECT c_mktsegment, AVG(c_acctbal) AS avg_c_acctbal FROM customer GROUP BY 1"),
    "nl_between_dates": (asked("list orders o_orderkey with o_orderdate between 1995-01-01 and 1995-12-31"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'"),
    "nl_in_list": (asked("show event id of events with event_type in click, view"), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')"),
    "nl_boolean_group": (asked("show o_orderkey of orders where (status = F and total > 200000) or status = P"), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR o_orderstatus = 'P'"),
    "nl_top_k": (asked("show o_orderkey of orders sorted by o_orderkey desc limit 5"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    "nl_max_min": (asked("what is the maximum and minimum size of parts"), "SELECT MAX(p_size) AS max_p_size, MIN(p_size) AS min_p_size FROM part"),
    "nl_join_group": (asked("how many customers per nation"), 'SELECT n_name AS nation_n_name, COUNT(*) AS "count" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1'),
    "nl_distinct": (asked("list distinct market segment of customers"), "SELECT DISTINCT c_mktsegment FROM customer"),
    "nl_count_distinct": (asked("count distinct brand of parts"), "SELECT COUNT(DISTINCT p_brand) AS count_p_brand FROM part"),
    "nl_having": (asked("which customers have more than 12 orders"), "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING COUNT(*) > 12"),
    "nl_batch": (batch.conversations, None),
    "synth_novelty": (
        lambda s, d: _open(s, d)("part").select("p_partkey", F.round(novelty(F.col("p_name"), F.col("p_type")), 9).alias("novelty")),
        """WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9_]+'), lambda x: x <> '')) AS b FROM part),
        s AS (SELECT p_partkey, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM w)
        SELECT p_partkey, round(CASE WHEN u = 0 THEN 0.0::DOUBLE ELSE 1 - i::DOUBLE / u END, 9) AS novelty FROM s""",
    ),
    "stream_windows": (live.windows_demo, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"),
}


QUERIES |= registry_tools.QUERIES


def queries() -> dict[str, Run]:
    return {key: run for key, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, (_, sql) in QUERIES.items() if sql}
