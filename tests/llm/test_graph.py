import random

import corpus_pipeline
from parlance.llm import common, graph


def plans(monkeypatch):
    """The number of exchanges in the plan of each table that is cut from now on."""
    found, real = [], common.cut

    def cut(df, name="cut"):
        found.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return real(df, name)

    for module in ("common", "graph", "minhash", "nearcopies", "simhash"):
        monkeypatch.setattr(f"parlance.llm.{module}.cut", cut)
    monkeypatch.setattr(corpus_pipeline, "cut", cut)
    return found


def test_rounds_are_right_in_small_plans(spark, monkeypatch):
    found = plans(monkeypatch)
    rng = random.Random(3)
    edges = [(5000, i) for i in range(5001, 5700)] + [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 900), rng.randrange(100, 900)) for _ in range(300)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        low, high = sorted((find(u), find(v)))
        root[high] = low
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}
    assert len(found) > 4 and max(found) <= 10


def test_the_near_dedup_stage_has_small_plans(spark, monkeypatch):
    found = plans(monkeypatch)
    hub = " ".join(f"w{k}" for k in range(300))
    rows = [(i, f"{hub} v{i}") for i in range(250)] + [(1000 + i, hub) for i in range(250)] + [(2000 + i, f"n{i} " * 9 + "end") for i in range(20)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == {0, *range(2000, 2020)}
    assert max(found) <= 10
