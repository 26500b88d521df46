import pytest
from pyspark.sql import types as T

from parlance.plans import ir
from parlance.plans.catalog import from_schema, infer, split_on
from parlance.plans.ir import Aggregate, ColumnRef, Group, Having, Join, Nested, PlanError, Predicate, Query
from parlance.plans.planner import Planner
from parlance.plans.render import render_graphql, render_sql

LIBRARY = {
    "entities": ["readers", "loans"],
    "fields": {"readers": ["id", "card", "status", "fee"], "loans": ["id", "status", "fee", "lentAt", "returned_ne"]},
    "relations": {"readers": {"loans": {"target": "loans", "args": ["status"], "aliases": ["loan"], "fields": ["id", "fee"]}}},
}
NAMES = {"entities": {"borrower": "readers"}, "fields": {"ticket": "card"}, "filters": {"state": "status"}, "filter_values": {"status": {"valid": "active"}}}


def planner(target="sql", **options):
    return Planner(from_schema(LIBRARY, NAMES), target, **options)


def test_filter_dictionaries_round_trip():
    flat, groups = ir.decode_filters({"price_gte": 5, "name": None, "a_in": [1, 2], "returned_ne": True, "x": {"$col": "y"}, "or": [{"a": 1, "b_lt": 2}, {"c_ne": 3}]}, {"returned_ne"})
    assert flat == (Predicate("price", 5, "gte"), Predicate("name", None, "is_null"), Predicate("a", [1, 2], "in"), Predicate("returned_ne", True), Predicate("x", ColumnRef("y")))
    assert groups == (Group("or", ((Predicate("a", 1), Predicate("b", 2, "lt")), Predicate("c", 3, "ne"))),)
    assert ir.decode_filters(ir.encode_filters(flat, groups), {"returned_ne"}) == (flat, groups)


def test_plans_survive_a_dictionary():
    q = Query("loans", ("id",), (Predicate("fee", 5, "gt"),), (), (Join("c", "readers", "cid", "id", ("card",), (Predicate("status", "a"),), "INNER"),), (), (Aggregate("SUM", "fee"),), (Having("COUNT", "*", ">", 2),), (), None, None, 5, 1, False, "sql", "text")
    assert ir.from_dict(ir.to_dict(q)) == q


def test_unknown_parts_are_refused():
    for make in (lambda: Predicate("a", 1, "like"), lambda: Join("a", "b", "c", "d", kind="CROSS"), lambda: Aggregate("MEDIAN", "a"), lambda: Group("xor", ())):
        with pytest.raises(PlanError):
            make()


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("show borrower ticket with state valid", "SELECT `readers`.`card` FROM `readers` AS `readers` WHERE `readers`.`status` = 'active'"),
        ("how many loans per status", "SELECT `loans`.`status`, COUNT(*) AS `count` FROM `loans` AS `loans` GROUP BY `loans`.`status`"),
        ("sum of fee of loans for each status", "SELECT `loans`.`status`, SUM(`loans`.`fee`) AS `sum_fee` FROM"),
        ("readers with highest fee first 5 offset 10", "ORDER BY `readers`.`fee` DESC NULLS LAST LIMIT 5 OFFSET 10"),
        ("loans with fee between 10 and 20", "WHERE `loans`.`fee` >= 10 AND `loans`.`fee` <= 20"),
        ("loans status in active, pending", "WHERE `loans`.`status` IN ('active', 'pending')"),
        ("loans where lentat >= 2021-05-06", "WHERE `loans`.`lentAt` >= '2021-05-06'"),
        ("latest loans", "ORDER BY `loans`.`lentAt` DESC NULLS LAST"),
        ("most recent loans", "DESC NULLS LAST LIMIT 1"),
        ("loans where status is not closed", "WHERE `loans`.`status` <> 'closed'"),
        ("loans where status is null", "WHERE `loans`.`status` IS NULL"),
        ("maximum and minimum fee of loans", "SELECT MAX(`loans`.`fee`) AS `max_fee`, MIN(`loans`.`fee`) AS `min_fee`"),
        ("which readers have more than 3 loans", "HAVING COUNT(`loans`.`readerId`) > 3"),
        ("readers with loan status paid", "LEFT JOIN `loans` AS `loans` ON `readers`.`id` = `loans`.`readerId` WHERE `loans`.`status` = 'paid'"),
        ("show id of loans where (status = a and fee > 5) or not (fee < 2)", "WHERE ((`loans`.`status` = 'a' AND `loans`.`fee` > 5) OR NOT (`loans`.`fee` < 2))"),
    ],
)
def test_questions(text, sql):
    assert sql in render_sql(planner().plan(text).query)


def test_grouped_conditions_keep_their_flat_parts_unless_strict():
    text = "show id of loans where fee > 5 and status = a or fee < 2"
    loose, strict = planner().plan(text).query, planner(strict_boolean=True).plan(text).query
    assert loose.groups == strict.groups and not strict.filters


def test_confidence_and_strictness():
    sure, unsure = planner().plan("show card of readers with status active"), planner().plan("zzz")
    assert 0.15 <= unsure.confidence < sure.confidence <= 0.97
    notes = []
    from parlance.plans.planner import validate

    q = validate(Query("loans", ("id", "nope"), (Predicate("bad", 1), Predicate("fee", 9, "gt"), Predicate("fee", 2, "lt"))), from_schema(LIBRARY), notes)
    assert q.fields == ("id",) and [p.key for p in q.filters] == ["fee", "fee"]
    assert len(notes) == 3 and any("contradict" in n for n in notes)


def test_graphql_text_and_nested_selection():
    q = planner("graphql").plan("show card of readers with their loans").query
    assert q.nested[0].relation == "loans"
    made = Query("readers", ("card",), (Predicate("status", 'a"b'), Predicate("fee", 5, "gte")), (Group("or", (Predicate("a", 1), Predicate("b", True))),), (), (Nested("loans", "loans", "id", "readerId", ("id",), (Predicate("status", "x"),), (Nested("lines", "lines", "id", "oid"),)),), (Aggregate("COUNT"), Aggregate("SUM", "fee")), (Having("COUNT", "*", ">", 2), Having("SUM", "fee", ">=", 3)), (), "fee", "DESC", 3, 1, True, "graphql")
    text = render_graphql(made)
    assert text.splitlines()[1].strip() == 'readers(limit: 3, offset: 1, status: "a\\"b", orderBy: "fee", orderDirection: "DESC", or: [{a: 1}, {b: true}], distinct: true, having: {count: {_gt: 2}, sum: {fee: {_gte: 3}}}, fee_gte: 5) {'
    assert '    loans(status: "x") {' in text and "      lines {" in text and '    sum(field: "fee")' in text
    with pytest.raises(PlanError):
        render_sql(made)


def test_owned_assets():
    p = Planner(from_schema({"entities": ["timber"], "fields": {"timber": ["code", "quantity"]}}))
    q = p.plan("how many oak do i own").query
    assert q.fields == ("quantity",) and q.filters == (Predicate("code", "OAK"),)


def test_inference_from_payloads():
    got = infer({"farms": [{"id": 1}, {"name": "x", "timber": [{"symbol": "a"}]}], "overview": {"fee": {"acres": 1}}, "empty": []})
    assert got["entities"] == ["farms", "fee", "overview", "timber"]
    assert got["fields"]["farms"] == ["id", "name"] and got["fields"]["overview"] == ["acres"]
    assert from_schema({"farms": [{"id": 1}]}).default_entity == "farms"


def test_join_conditions():
    assert split_on("a.x = b.y", "a", "b") == ("x", "y")
    assert split_on("b.y = a.x", "a", "b") == ("x", "y")
    assert split_on('a."Percent (%) x.y" = b.z', "a", "b") == ("Percent (%) x.y", "z")
    with pytest.raises(PlanError):
        split_on("a.x < b.y", "a", "b")


def test_introspection_enums():
    c = from_schema({"introspection": {"query": {"loans": {"type": "[Field!]!", "args": {"status": "FieldState", "limit": "Int"}}}, "types": {"Field": {"fields": {"id": "ID!", "status": "FieldState"}}, "FieldState": {"enumValues": ["GROWING", "FALLOW"]}}}})
    assert c.fields["loans"] == ["id", "status"]
    q = Planner(c).plan("show id of loans with status growing").query
    assert q.filters == (Predicate("status", "GROWING"),)


def test_configured_rules():
    rules = [{"keywords": ["carcinogenic"], "entity": "molecule", "filters": {"label": "+"}}, {"keywords": ["best", "finish"], "entity": "player", "aggregate": {"function": "min", "field": "finish"}}, {"keywords": ["draw"], "entity": "match", "filters": {"home": {"$col": "away"}}}]
    c = from_schema({"entities": ["molecule", "player", "match"], "fields": {"molecule": ["id", "label"], "player": ["id", "finish"], "match": ["id", "home", "away"]}, "keyword_intents": rules})
    plan = lambda t: render_sql(Planner(c).plan(t).query)
    assert plan("how many carcinogenic ones are there").endswith("WHERE `molecule`.`label` = '+'")
    assert plan("best finish ever") == "SELECT MIN(`player`.`finish`) AS `min_finish` FROM `player` AS `player`"
    assert "`match`.`home` = `match`.`away`" in plan("how many games ended in a draw")


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("What are the names of the singers from the USA?", "SELECT `singer`.`Name` FROM `singer` AS `singer` WHERE `singer`.`Country` = 'USA'"),
        ("What is the average weight of singers born after 1990?", "SELECT AVG(`singer`.`Weight`) AS `avg_Weight` FROM `singer` AS `singer` WHERE `singer`.`Birth_Year` > 1990"),
        ("show name of singers taller than 1.75", "WHERE `singer`.`Height` > 1.75"),
        ("show name of singer 3", "WHERE `singer`.`Singer_ID` = 3"),
        ("How many male singers are there?", "COUNT(*) AS `count` FROM `singer` AS `singer` WHERE `singer`.`Is_male` = 1"),
        ("names of active singers", "WHERE `singer`.`Status` = 'Active'"),
        ("Show the name of the youngest singer", "ORDER BY `singer`.`Age` ASC NULLS LAST LIMIT 1"),
        ("how many singers have more than 5 awards", "WHERE `singer`.`Awards` > 5"),
        ("names of singers whose concert theme is Jazz", "LEFT JOIN `concert` AS `concert` ON `singer`.`Singer_ID` = `concert`.`Singer_ID` WHERE `concert`.`Theme` = 'Jazz'"),
    ],
)
def test_words_that_name_no_column(text, sql):
    fields = {"singer": ["Singer_ID", "Name", "Country", "Age", "Weight", "Height", "Birth_Year", "Is_male", "Status", "Awards"], "concert": ["Concert_ID", "Singer_ID", "Theme"]}
    c = from_schema({"entities": ["singer", "concert"], "fields": fields, "relations": {"singer": {"concert": {"target": "concert", "left": "Singer_ID", "right": "Singer_ID"}}}})
    assert sql in render_sql(Planner(c).plan(text).query), render_sql(Planner(c).plan(text).query)


TIMED = {"entities": ["voyages", "ships"], "fields": {"voyages": ["id", "ship_id", "sailed_on", "tons"], "ships": ["id", "name"]}, "relations": {"ships": {"voyages": {"target": "voyages", "left": "id", "right": "ship_id", "aliases": ["voyage"]}}}}


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("how many voyages in January 1995", "`voyages`.`sailed_on` >= '1995-01-01' AND `voyages`.`sailed_on` < '1995-02-01'"),
        ("how many voyages in December 1995", "`voyages`.`sailed_on` >= '1995-12-01' AND `voyages`.`sailed_on` < '1996-01-01'"),
        ("how many voyages in 1995", "`voyages`.`sailed_on` >= '1995-01-01' AND `voyages`.`sailed_on` < '1996-01-01'"),
        ("voyages after 1995", "WHERE `voyages`.`sailed_on` >= '1996-01-01'"),
        ("voyages since 1995", "WHERE `voyages`.`sailed_on` >= '1995-01-01'"),
        ("voyages before 1995-03", "WHERE `voyages`.`sailed_on` < '1995-03-01'"),
        ("voyages after 1995-12", "WHERE `voyages`.`sailed_on` >= '1996-01-01'"),
        ("voyages after 1995-03-04", "WHERE `voyages`.`sailed_on` > '1995-03-04'"),
        ("voyages between 1993 and 1995", "`voyages`.`sailed_on` >= '1993-01-01' AND `voyages`.`sailed_on` < '1996-01-01'"),
        ("name of ships with no voyages", "WHERE `ships`.`id` NOT IN (SELECT `voyages`.`ship_id` FROM `voyages` WHERE `voyages`.`ship_id` IS NOT NULL)"),
        ("name of ships with fewer than 2 voyages", "HAVING COUNT(`voyages`.`ship_id`) < 2"),
    ],
)
def test_time_and_absence(text, where):
    c = from_schema(TIMED)
    c.types["voyages"] = T.StructType().add("id", "long").add("ship_id", "long").add("sailed_on", "date").add("tons", "double")
    q = Planner(c).plan(text)
    assert where in render_sql(q.query), render_sql(q.query)
    assert not q.notes and "JOIN" not in render_sql(q.query) or "fewer" in text


def test_a_condition_that_nothing_took_leaves_a_note():
    c = from_schema(TIMED)
    assert Planner(c).plan("how many ships in 1995 and 77").notes
    with pytest.raises(PlanError):
        Planner(c, strict=True).plan("how many ships weigh 77")
    assert not Planner(c).plan("show name of ships limit 5 offset 10").notes
