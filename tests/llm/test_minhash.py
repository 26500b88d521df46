import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from parlance.llm import common, minhash
from parlance.llm.graph import components


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, least=Fraction(4, 5)):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= least * all_:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def planted():
    rng = random.Random(3)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 400]))]
        rows.append((len(rows), " ".join(words)))
        for k in range(3):
            copy = list(words)
            for _ in range(max(1, len(words) * (k + 1) // 100)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (None, rows[0][1]), (500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "one three"), (0, rows[0][1])]


def test_components_are_those_of_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_copies(df).collect()), key=str)
    assert got == brute(rows)
    assert minhash.near_copies(df.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rows = planted()[:160]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS sum")
    each = common.cut(minhash.signatures(docs, 5))
    distinct = each.selectExpr("fp", "sum", "n").dropDuplicates(["fp"])

    a, b = (sorted(map(tuple, components(minhash.links(docs, each, distinct, 0.8, 5, tile=t)).collect())) for t in (1024, 2))
    assert a and a == b


def test_local_roots_count_the_bound_in():
    a = np.arange(5, dtype=np.int64)
    assert minhash.local_roots([a, a[:4], a[:3]], Fraction(4, 5)).tolist() == [0, 0, 2]


def test_the_stage_drops_ordinary_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:50], "other", *words[51:120], "another", *words[121:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:100] + near[:100]))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {1, 3}
