import json

import pytest

from parlance import cli, mapping, rewrite, synth
from parlance.evaluate import Example, read_dataset, summary
from parlance.engine import Engine
from parlance.plans.catalog import from_schema
from parlance.plans.ir import PlanError
from parlance.providers import Scripted, first_json
from parlance.sources import benchmarks
from parlance.streaming import batch


def test_rewriting_is_guarded():
    assert rewrite.rewrite("how many qqq i own").text == "how many qqq do i own"
    for answer, why in (("SELECT 1", "query text"), ("show orders over 6", "numbers differ"), ("count orders over 5", "intent differs"), ("", "empty")):
        got = rewrite.rewrite("show orders over 5", Scripted([answer]))
        assert got.text == "show orders over 5" and got.reason == why
    assert rewrite.rewrite("show orders over 5", Scripted(["list orders over 5"])).text == "list orders over 5"


def test_variants_and_domains():
    assert synth.domain("show my holdings") == "portfolio" and synth.domain("abc") == "generic"
    made = synth.variants("show top 5 orders", 4)
    assert len(made) == 4 and made == sorted(made, key=lambda x: -x[1])
    assert not synth.variants("show top 5 orders", 4, lexicon={"unrelated"})
    assert [e.text for e in synth.augment([Example("show orders", "q")], 1)][0] == "show orders"


def test_mapping_profile_and_provenance(spark):
    df = spark.createDataFrame([("Alpha", "k1", 1), ("alpha", "k2", 2), (None, "k3", 3)], "kind string, code string, n int")
    got = {(r.field, r.alias, r.value) for r in mapping.profile(df, 2).collect()}
    assert got == {("kind", "alpha", "Alpha"), ("kind", "alpha", "alpha")}
    made = mapping.generate(from_schema({"entities": ["order_line_items"], "fields": {"order_line_items": ["unitPrice"]}}), overrides={"fields": {"cost": "unitPrice"}})
    assert made["fields"]["unit price"] == "unitPrice" and made["entities"]["oli"] == "order_line_items"
    assert made["provenance"]["fields.cost"] == "override"


def test_datasets(spark, tmp_path):
    good = {"text": "a", "expected_query": "q", "target": "sql"}
    (tmp_path / "d.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good))
    (tmp_path / "d.json").write_text(json.dumps([good], indent=1))
    assert len(read_dataset(spark, f"{tmp_path}/d.jsonl")) == 2 and len(read_dataset(spark, f"{tmp_path}/d.json")) == 1
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}')
    for path in ("bad.jsonl", "d.txt"):
        with pytest.raises(PlanError):
            read_dataset(spark, f"{tmp_path}/{path}")


def test_benchmark_folders(spark, tmp_path):
    tables = [{"db_id": "garden", "table_names_original": ["beds", "plantings"], "table_names": ["beds", "plantings of beds"], "column_names_original": [[-1, "*"], [0, "bed_no"], [0, "soil"], [1, "planting_no"], [1, "bed"], [1, "moved_to"]], "column_names": [[-1, "*"], [0, "bed number"], [0, "soil"], [1, "planting number"], [1, "bed"], [1, "moved to"]], "column_types": ["text", "number", "text", "number", "number", "number"], "foreign_keys": [[4, 1], [5, 1]]}]
    dev = [{"db_id": "garden", "question": "How many beds are there?", "query": "SELECT count(*) FROM beds", "difficulty": "easy"}, {"db_id": "other", "question": "x", "query": "q"}]
    (tmp_path / "tables.json").write_text(json.dumps(tables))
    (tmp_path / "dev.json").write_text(json.dumps(dev))
    (tmp_path / "dev_tables.json").write_text(json.dumps(tables))
    got = benchmarks.spider(spark, str(tmp_path), databases={"garden"})
    assert len(got) == 1 and set(got[0].schema["relations"]["plantings"]) == {"beds", "beds_moved_to"}
    rows, by, text = benchmarks.run(spark, Engine(), got, mode="structural")
    assert rows[0].structural and "difficulty easy" in text and by.first().n == 1
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "garden", "question": "q?", "SQL": "SELECT 1", "evidence": "hint"}]))
    assert benchmarks.bird(spark, str(tmp_path))[0].context == {"evidence": "hint"}
    with pytest.raises(PlanError):
        benchmarks.spider(spark, str(tmp_path), split="test")
    assert summary(rows)


def test_command_line(capsys, tmp_path):
    schema = '{"entities": ["orders"], "fields": {"orders": ["id", "total"]}}'
    out = tmp_path / "deep" / "map.json"
    assert cli.main(["show id of orders where total > 5", "--schema", schema, "-v", "--variants", "2", "--write-mapping", str(out)]) == 0
    got = json.loads(capsys.readouterr().out)
    assert "`orders`.`total` > 5" in got["query"] and got["plan"]["entity"] == "orders" and len(got["variants"]) == 2 and out.exists()
    assert cli.main(["x", "--schema", "[1]"]) == 2


def test_command_line_on_a_payload(spark, capsys):
    payload = '{"orders": [{"id": 1, "total": 9}, {"id": 2, "total": 3}]}'
    assert cli.main(["show id of orders where total > 5", "--payload", payload, "--expected-query", "SELECT id FROM orders WHERE total > 5"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["rows"] == [{"id": 1}] and got["match"]


def test_command_line_providers(capsys, monkeypatch):
    schema = '{"entities": ["beds"], "fields": {"beds": ["bed_no", "soil"]}}'
    assert cli.main(["show soil of beds", "--schema", schema, "--mode", "llm"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert any("llm_error" in n for n in got["notes"]) and "`beds`.`soil`" in got["query"]
    assert cli.main(["show soil of beds", "--schema", schema, "--mode", "llm", "--provider", "http"]) == 2
    monkeypatch.setattr(cli, "provider", lambda a: Scripted(["SELECT soil FROM beds WHERE bed_no = 3"]))
    capsys.readouterr()
    assert cli.main(["soil of the third bed", "--schema", schema, "--mode", "llm"]) == 0
    assert json.loads(capsys.readouterr().out)["query"] == "SELECT soil FROM beds WHERE bed_no = 3"


def test_benchmark_from_the_command_line_runs_its_queries(spark, tmp_path, capsys):
    (tmp_path / "tables.json").write_text(json.dumps([{"db_id": "garden", "table_names_original": ["beds"], "table_names": ["beds"], "column_names_original": [[-1, "*"], [0, "bed_no"], [0, "soil"]], "column_names": [[-1, "*"], [0, "bed number"], [0, "soil"]], "column_types": ["text", "number", "text"], "foreign_keys": []}]))
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "garden", "question": "How many beds are there?", "query": "SELECT count(*) FROM beds"}, {"db_id": "other", "question": "x", "query": "SELECT 1"}]))
    spark.createDataFrame([(1, "clay"), (2, "sand")], "bed_no int, soil string").write.parquet(f"{tmp_path}/beds.parquet")
    assert cli.main(["--benchmark", "spider", "--benchmark-root", str(tmp_path), "--benchmark-db", "garden", "--benchmark-mode", "execution", "--tables", str(tmp_path), "--table-names", "beds"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["examples"] == 1 and "execution=100.0%" in got["report"][0]


def test_bulk_planning_survives_nulls(spark):
    asked = spark.createDataFrame([(1, "show id of orders"), (2, None), (3, "")], "req_id long, text string")
    got = {r.req_id: r for r in batch.plan_all(asked, from_schema({"entities": ["orders"], "fields": {"orders": ["id"]}})).collect()}
    assert got[1].entity == "orders" and len(got) == 3


def test_json_extraction():
    assert first_json('text {bad} ```{"a": {"b": "}"}}``` more') == {"a": {"b": "}"}}
    with pytest.raises(PlanError):
        first_json("none")
