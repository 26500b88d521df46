import asyncio
import uuid
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parlance import registry, synth
from parlance.engine import Engine
from parlance.evaluate import Example, evaluate, graphql_signature, same_rows, sql_signature, structural
from parlance.operators.compile import compile_query
from parlance.plans.catalog import from_schema
from parlance.plans.ir import Aggregate, Group, Having, Join, Nested, PlanError, Predicate, Query, Subquery
from parlance.plans.planner import Planner
from parlance.plans.render import render_sql
from parlance.providers import Echo, Scripted
from parlance.sources import jsondata, tables
from parlance.streaming import live

P = Predicate
ROWS = [(1, "a", 10.0, None), (2, "b", None, 1), (3, None, 5.5, 2), (4, "a", 10.0, 3), (5, "c", -1.0, None), (5, "c", -1.0, None)]
OTHER = [(1, "x"), (2, None), (2, "y"), (None, "z")]


@pytest.fixture(scope="module")
def data(spark):
    out = {"t": spark.createDataFrame(ROWS, "id long, name string, score double, ref long"), "u": spark.createDataFrame(OTHER, "key long, label string")}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


scalars = st.one_of(
    st.builds(P, st.just("score"), st.sampled_from([10.0, 5, -1]), st.sampled_from(["eq", "ne", "gt", "gte", "lt", "lte"])),
    st.builds(P, st.just("name"), st.sampled_from(["a", "b", "z'q"]), st.sampled_from(["eq", "ne"])),
    st.builds(P, st.just("name"), st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=3), st.sampled_from(["in", "nin"])),
    st.builds(P, st.sampled_from(["name", "score", "ref"]), st.none(), st.just("is_null")),
    st.builds(P, st.just("id"), st.tuples(st.integers(0, 2), st.integers(2, 6)), st.just("range")),
)
groups = st.recursive(scalars, lambda c: st.builds(Group, st.sampled_from(["and", "or", "not"]), st.lists(c, min_size=1, max_size=3).map(tuple)), max_leaves=5)
plans = st.builds(
    lambda flat, group, join, agg, having, sub: Query("t", ("name",) if agg else ("id", "name"), tuple(flat), (Group("and", (group,)),), join, (), agg, having if agg else (), sub),
    st.lists(scalars, max_size=2), groups,
    st.sampled_from([(), (Join("u", "u", "ref", "key", ("label",)),), (Join("u", "u", "ref", "key", ("label",), (P("label", "y"),), "INNER"),), (Join("u", "u", "ref", "key", ("label",), (), "RIGHT"),)]),
    st.sampled_from([(), (Aggregate("COUNT"), Aggregate("SUM", "score")), (Aggregate("COUNT", "DISTINCT ref", "n"), Aggregate("MAX", "score + id", "m"))]),
    st.sampled_from([(), (Having("COUNT", "*", ">=", 2),)]),
    st.sampled_from([(), (Subquery("ref", "u", "key", (), False),), (Subquery("ref", "u", "key", (P("label", "x"),), True),), (Subquery("ref", "u", "key", (), True),)]),
)


@given(plans)
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_compiled_plans_equal_their_sql(spark, data, q):
    assert rows(compile_query(q, data)) == rows(spark.sql(render_sql(q)))


def test_not_in_with_nulls(data):
    empty = Query("t", ("id",), subqueries=(Subquery("ref", "u", "key"),))
    assert compile_query(empty, data).count() == 0
    none = Query("t", ("id",), subqueries=(Subquery("ref", "u", "key", (P("label", "no such"),)),))
    assert compile_query(none, data).count() == 6


def test_paging_order_and_distinct(data):
    assert [r.id for r in compile_query(Query("t", ("id",), order_by="score", order_dir="ASC", limit=3, offset=1), data).collect()][1:] in ([3, 1], [3, 4], [5, 3][1:] + [1])
    assert [r.id for r in compile_query(Query("t", ("id",), order_by="id", order_dir="DESC", offset=4), data).collect()] == [2, 1]
    assert compile_query(Query("t", ("id", "name"), distinct=True), data).count() == 5
    with pytest.raises(PlanError):
        compile_query(Query("t", ("name",), distinct=True, order_by="score", order_dir="ASC"), data)
    with pytest.raises(PlanError):
        compile_query(Query("t", ("nope",)), data)


def test_top_k_is_one_node(data):
    plan = compile_query(Query("t", ("name",), order_by="id", order_dir="DESC", limit=2), data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark, sf001):
    q = Query("orders", ("o_orderkey",), (P("o_totalprice", 1000, "gt"),))
    plan = compile_query(q, lambda e: spark.read.parquet(f"{sf001}/{e}.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan.replace(" ", "") and "o_orderstatus" not in plan


def test_nested_rows(data):
    q = Query("u", ("key",), nested=(Nested("ts", "t", "key", "ref", ("id", "name"), order_by="id", order_dir="DESC"),))
    got = Counter((r.key, tuple((c.id, c.name) for c in r.ts)) for r in compile_query(q, data).collect())
    assert got == Counter({(1, ((2, "b"),)): 1, (2, ((3, None),)): 2, (None, ()): 1})


def test_json_walk_semantics(spark):
    payload = {"data": {"items": [{"name": "a", "price": 10}, {"name": None, "price": "x"}, {"detail": {"price": 7}, "name": "b"}]}}
    run = lambda **k: jsondata.run(spark, Query("item", **k), payload)[0]
    assert run(fields=("name",), filters=(P("name", "a", "ne"),)) == [{"name": None}, {"name": "b"}]
    assert run(fields=("price",), filters=(P("price", 6, "gt"),)) == [{"price": 10}, {"price": 7}]
    assert run(fields=("name",), filters=(P("name", None, "is_null"),)) == [{"name": None}]
    assert run(fields=("price",), limit=1, aggregates=(Aggregate("SUM", "price"), Aggregate("COUNT"))) == [{"sum_price": 10.0, "count": 1}]
    assert run(fields=("name",), groups=(Group("not", (P("name", "a"), P("price", 7)),),)) == [{"name": None}]
    assert jsondata.run(spark, Query("nothing"), payload) == ([], "no entity 'nothing' in the payload")
    assert jsondata.flatten({"a": 1, "s": {"a": 2, "b": 3, "t": {"c": 4}}, "l": [1]}) == {"a": 1, "l": "[1]", "b": 3, "c": 4}


def test_sql_on_payloads(spark):
    payload = {"items": [{"a": "1", "s": {"b": 2}}, {"a": "10", "s": {"b": 30}}]}
    assert jsondata.sql(spark, "SELECT a, b FROM items WHERE b > 3;", payload) == ([{"a": "10", "b": 30}], None)
    got, error = jsondata.sql(spark, "SELECT nope FROM items", payload)
    assert got == [] and "nope" in error


def test_text_columns_compare_as_text(data):
    assert {r.id for r in compile_query(Query("t", ("id",), (P("score", 10, "gt"),)), data, "sqlite_text").collect()} == {1, 3, 4}


def test_executor(spark):
    with tables.executor_from_rows(spark, {"people": [{"id": 1, "credit_limit": 5}, {"id": 2, "credit_limit": None}]}, 1) as e:
        assert len(e.execute("SELECT credit_limit FROM people")) == 1
        assert asyncio.run(e.aexecute("SELECT count(*) AS n FROM people;")) == [{"n": 2}]
        e.load("people", [{"id": 3}], "append")
        assert e("SELECT max(id) AS m FROM people") == [{"m": 3}]
        for bad in ("DROP TABLE people", "SELECT 1; SELECT 2", "INSERT INTO people VALUES (1, 2)", "WITH x AS (SELECT 1) INSERT INTO people SELECT 1, 2"):
            with pytest.raises(PlanError):
                e.frame(bad)
    assert not spark.catalog.tableExists("people")


def test_engine_modes(data):
    catalog = from_schema(None, None, data)
    intent = '```json\n{"entity": "t", "fields": ["name", "zzz"], "filters": {"score": {"gte": 5}}, "aggregations": [{"function": "count"}]}\n```'
    r = Engine(data, catalog, Scripted([intent])).generate("x", mode="function_calling")
    assert rows(r.frame) == sorted(map(repr, [("a", 2), (None, 1)])) and len(r.notes) == 1
    r = Engine(data, catalog, Scripted(["```sql\nSELECT count(*) AS n FROM t;\n```"])).generate("x", mode="llm")
    assert r.frame.first().n == 6 and r.confidence == 0.8
    for mode in ("llm", "function_calling"):
        r = Engine(data, catalog, Echo()).generate("show name of t", mode=mode)
        assert r.notes and r.notes[0].startswith("llm_error") and r.plan.fields == ("name",)
    many = asyncio.run(Engine(data, catalog).agenerate_many(["show name of t", "show label of u"], 2))
    assert [m.plan.entity for m in many] == ["t", "u"]


def test_signatures_and_evaluation(data, spark):
    assert structural('SELECT "t"."a" FROM "t" WHERE "t"."x" = \'Q\' AND y > 1;', "select a from t where y > 1 and x = 'Q'", "sql")
    assert structural("SELECT T1.a FROM p AS T1 JOIN q AS T2 ON T1.i = T2.j", "SELECT p.a FROM p JOIN q ON q.j = p.i", "sql")
    assert not structural("SELECT a FROM t WHERE x = 1 GROUP BY a", "SELECT a FROM t WHERE x = 1", "sql")
    assert sql_signature("nonsense") is None and graphql_signature("nonsense") is None
    assert structural("{ a(x: 1, y: [1,2]) { id name } }", "{ a(y: [1,2], x: 1) { name id } }", "graphql")
    assert same_rows([{"a": 1.0}, {"a": None}], [(None,), (1,)]) and not same_rows([(1,), (1,)], [(1,)])
    engine, back = Engine(data, from_schema(None, None, data)), tables.Executor(spark, data)
    got = evaluate(engine, [Example("show name of t", "SELECT name FROM t", "sql", metadata={"difficulty": "easy"}), Example("show name of t", "SELECT broken", "sql")], lambda sql, e: back(sql))
    assert got[0].execution and got[0].structural and not got[0].exact
    assert got[1].execution is False and got[1].error


@pytest.mark.parametrize("key", [k for k, (_, sql) in registry.QUERIES.items() if sql])
def test_registered_queries_equal_their_sql(spark, sf001, key):
    con = duckdb.connect()
    for t in (*tables.TABLES, "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf001}/{t}.parquet'")
    run, sql = registry.QUERIES[key]
    df = run(spark, sf001)
    found = con.sql(sql)
    names = sorted(found.columns)
    assert sorted(df.columns) == names
    plain = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else repr(v) for v in row)
    want = Counter(plain([r[found.columns.index(n)] for n in names]) for r in found.fetchall())
    assert Counter(plain([r[n] for n in names]) for r in df.collect()) == want


def test_bulk_plans_and_variants_equal_those_made_one_by_one(spark, sf001):
    planner = Planner(tables.catalog(tables.parquet(spark, sf001)))
    turns = {r.id: r.text for r in spark.read.parquet(f"{sf001}/conversations.parquet").selectExpr("xxhash64(conv_id, turn) AS id", "text").collect()}
    got = registry.QUERIES["nl_batch"][0](spark, sf001).collect()
    assert len(got) == len(turns)
    for r in got:
        p = planner.plan(turns[r.req_id] or "")
        assert (r.entity, r.query, r.confidence, r.n_notes, r.error) == (p.query.entity, render_sql(p.query), p.confidence, len(p.notes), None)
    made = {}
    for r in registry.QUERIES["synth_examples"][0](spark, sf001).collect():
        made.setdefault(r.req_id, {})[r.variant] = (r.text, r["rank"])
    for i, text in turns.items():
        want = synth.variants(text or "", 3, dict.fromkeys(("generic", synth.domain(text or ""), "frame")))
        assert [made.get(i, {})[k] for k in range(len(want))] == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp`", "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
        "SELECT (SELECT max(value) FROM text.`/etc/hostname`)", "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.System', 'getenv', 'HOME'))", "SET spark.sql.shuffle.partitions=3", "DROP VIEW orders", "INSERT INTO orders SELECT * FROM orders", "CREATE TABLE x AS SELECT 1",
        "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "SHOW TABLES", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "not sql at all", "", "CACHE TABLE orders", "ADD JAR 'x.jar'",
    ],
)
def test_only_reading_statements_over_plain_tables_are_run(spark, sf001, sql):
    executor = tables.Executor(spark, {"orders": spark.read.parquet(f"{sf001}/orders.parquet")})
    with pytest.raises(PlanError):
        executor.frame(sql)
    rows, error = jsondata.sql(spark, sql, {"orders": [{"id": 1}]})
    assert rows == [] and error


def test_reading_statements_are_run(spark, sf001):
    executor = tables.Executor(spark, {"orders": spark.read.parquet(f"{sf001}/orders.parquet")})
    for sql, n in (
        ('SELECT "a;b" AS x', 1), ("SELECT 1;", 1), ("VALUES (1), (2)", 2), ("TABLE orders", 1500), ("FROM orders SELECT o_orderkey LIMIT 3", 3), ("(SELECT 1) UNION ALL (SELECT 2)", 2), ("WITH a AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT * FROM a WHERE k < 5) SELECT * FROM b JOIN a USING (k)", None),
        ("SELECT o_orderstatus, count(*), rank() OVER (ORDER BY count(*)) FROM orders GROUP BY o_orderstatus HAVING count(*) > 0", 3), ("SELECT * FROM orders PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F', 'O'))", None), ("SELECT x FROM orders LATERAL VIEW explode(array(1)) t AS x LIMIT 2", 2), ("SELECT * FROM range(4)", 4),
        ("SELECT 'drop table x' AS reflect, `o_orderkey` FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders)", 1), ("-- delete from orders\nSELECT 1", 1),
    ):
        got = executor.execute(sql)
        assert n is None or len(got) == n, sql


def test_provider_text_is_capped_and_guarded(spark, sf001):
    found = {"lineitem": spark.read.parquet(f"{sf001}/lineitem.parquet")}
    catalog = from_schema(None, None, found)
    big = "SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_linenumber = b.l_linenumber"
    answer = Engine(found, catalog, Scripted([big])).generate("x", mode="llm")
    assert answer.plan is None and answer.frame.count() == 10_000
    with pytest.raises(PlanError):
        Engine(found, catalog, Scripted(["SELECT reflect('a', 'b') AS x FROM lineitem"])).generate("x", mode="llm").frame


def test_nested_order_without_fields_and_with_nulls(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    rows = [(1, "a", 3), (1, "b", None), (1, "c", 5), (1, "d", 3), (2, "e", None)]
    data = {"p": parents, "c": spark.createDataFrame(rows, "pid int, name string, n int")}

    def names(fields, direction):
        q = Query("p", ("id",), nested=(Nested("kids", "c", "id", "pid", fields, (), (), "n", direction),))
        out = compile_query(q, data)
        return out.schema["kids"].dataType.elementType.names, {r.id: [k.name for k in r.kids] for r in out.collect()}

    assert names((), "ASC") == (["pid", "name", "n"], {1: ["a", "d", "c", "b"], 2: ["e"]})
    assert names(("name",), "DESC") == (["name"], {1: ["c", "a", "d", "b"], 2: ["e"]})


def test_counts_of_a_joined_relation_leave_out_rows_without_a_match(spark):
    data = {"p": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "c": spark.createDataFrame([(1,), (1,), (2,)], "pid int")}
    q = Query("p", ("id",), joins=(Join("kids", "c", "id", "pid"),), having=(Having("COUNT", "kids.pid", "<", 2),))
    assert sorted(r.id for r in compile_query(q, data).collect()) == [2, 3]
    for n, df in data.items():
        df.createOrReplaceTempView(n)
    assert sorted(r.id for r in spark.sql(render_sql(q)).collect()) == [2, 3]


def test_a_stream_gives_all_windows_closed_or_open(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(datetime(2024, 1, 1) + timedelta(hours=h), "ab"[h % 2]) for h in range(600)]
    spark.createDataFrame(rows, "ts timestamp_ntz, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").parquet(f"{tmp_path}/in")
    got = live.finished(live.windowed(stream, "ts", "1 day", "3 days", "kind"), uuid.uuid4().hex).collect()
    assert sum(r.n for r in got) == 600 and len(got) == 50 and all(r.n == 12 for r in got)
