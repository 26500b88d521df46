import hashlib
import math
from collections import Counter

import duckdb

from parlance.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def count(doc_id, rate, seed=42, text=""):
    text = f"{seed}|{'' if doc_id is None else doc_id}|{hashlib.md5(text.encode()).hexdigest()}"
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13
    n, p = 0, math.exp(-rate)
    total = p
    while u >= total and n < 2000:
        n += 1
        p *= rate / n
        total += p
    return n


def docs(n=400):
    return [(i, "w" * (10 + i % 7), "en", "hot" if i % 3 else f"s{i % 5}", 5) for i in range(n)]


def test_counts_are_the_inverted_poisson(spark):
    rows = [*docs(), (None, None, None, None, None), (7, "repeated", "en", "s1", 1), (7, "repeated", "en", "s1", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    size = Counter()
    for r in rows:
        size[r[3]] += max(1, len(r[1] or ""))
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: min(500.0, weight[s] * sum(size.values()) / (sum(weight.values()) * size[s])) for s in size}
    want = Counter()
    for r in rows:
        want[(r[0], r[1], r[3])] += count(r[0], rate[r[3]], text=r[1] or "")
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(df).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_target_weights_are_met(spark):
    df = spark.createDataFrame(docs(6000), SCHEMA)
    got = Counter()
    for r in mixing.mix(df, {"hot": 0.25, "s0": 0.75}, total=2.0).collect():
        got[r.source] += len(r.text)
    assert set(got) == {"hot", "s0"}
    assert abs(got["hot"] / sum(got.values()) - 0.25) < 0.04


def test_oracle_and_shuffle(spark, sf001):
    path = f"{sf001}/documents.parquet"
    got = mixing.mix(spark.read.parquet(path)).drop("rate")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = con.execute(mixing.oracle()).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    keys = [r.shuffle_key for r in got.collect()]
    assert keys != sorted(keys) or len(keys) < 3


def test_names_that_clash_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "s", 3, "k")], "doc_id long, text string, source string, copy int, rate string")
    out = mixing.mix(df, total=5.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "rate", "_copy", "_rate", "shuffle_key"]
    assert out.count() == count(1, 5.0, text="a")
    assert mixing.mix(df.limit(0)).count() == 0


def high(doc_id, rate, seed=42):
    """As `count`, in equal shares of at most 500."""
    k, own = math.ceil(rate / 500), f"{doc_id}|{hashlib.md5(b'x').hexdigest()}"
    us = [int(hashlib.md5(t.encode()).hexdigest()[:13], 16) / 16**13 for t in [f"{seed}|{own}", *(f"{seed}/part|{i}|{own}" for i in range(1, k))]]
    n = 0
    for u in us:
        m, p = 0, math.exp(-rate / k)
        total = p
        while u >= total and m < 2000:
            m += 1
            p *= rate / k / m
            total += p
        n += m
    return n


def test_small_sources_of_large_corpora_meet_their_weight(spark):
    rows = [(i, "w" * 1000, "en", "big", 5) for i in range(10)] + [(10 + i, "x", "en", "tiny", 5) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.doc_id for r in mixing.mix(df, {"tiny": 0.5, "big": 0.5}).collect())
    rate = 0.5 * 10_004 / 4
    assert rate > 500 and {i: got[10 + i] for i in range(4)} == {i: high(10 + i, rate) for i in range(4)}
    assert abs(sum(got[10 + i] for i in range(4)) / 5002 - 1) < 0.05


def test_rows_without_an_id_and_repeated_rows_are_dealt_apart(spark):
    rows = [(None, f"text {i}", "en", "s", 5) for i in range(60)] + [(7, "same", "en", "s", 4)] * 300
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), total=4.0)
    drawn = Counter(r.text for r in got.where("doc_id IS NULL").collect())
    assert drawn == Counter({f"text {i}": n for i in range(60) if (n := count(None, 4.0, text=f"text {i}"))}) and len(set(drawn.values())) > 2
    keys = got.where("doc_id IS NULL").select("shuffle_key").distinct().count()
    assert keys == sum(drawn.values())
    parts = Counter(r[0] for r in got.where("doc_id = 7").selectExpr("spark_partition_id()").collect())
    assert len(parts) == 4 and max(parts.values()) < 0.5 * sum(parts.values())
