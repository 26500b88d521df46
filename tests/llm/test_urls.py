import duckdb
import pytest

from parlance.llm import urls

URLS = [
    "https://a.example.com/en/7817?q", "http://EXAMPLE.COM/en/81#x", "https://example.com/en", "ftp://x.net/de/5", "http://example.net/de/8", "http://www.example.net/de/81/x", "http://notexample.net/de/8",
    "x.org/es/1", "http://x.org/es/1", "http://org/es/", "http://casino-poker.example/free-slots/bonus", "https://university.example/research/papers", None, "", "://", "a://b://c/en/", "http://com/en/", "http://ÜBER.com/en/é",
    "http://x.com?u=/en/", "http://x.com#/en/", "http://x.com\n/en/7", "HTTP://A.ORG/ES/", "http://" + "a" * 30_000 + ".com/en/", "http://x.example/🙂🙂🙂", "http://y.org/es/?",
]


def brute(url):
    host, path = urls.host_path(url)
    fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    weights, bias = urls.model()
    score = bias + sum(weights[j] for j in urls.buckets_of(host + path, len(weights)))
    return host, path, best and best[1] + best[2], score, best[0] if best else "block" if score > 0 else "allow"


def test_judge_against_brute_force_and_oracle(spark, tmp_path):
    rows = [(i, u, "h", "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", None), (3, URLS[3], "h", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(map(tuple, urls.judge(df).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u, *_ in rows), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(urls.oracle()).fetchall(), key=str) == got
    assert urls.judge(df.limit(0)).count() == 0


def test_held_out_accuracy():
    rows = [(u, 1) for u in urls.BLOCKED] + [(u, 0) for u in urls.ALLOWED]
    right = 0
    for fold in range(4):
        weights, bias = urls.train([r for i, r in enumerate(rows) if i % 4 != fold])
        for u, label in rows[fold::4]:
            right += (bias + sum(weights[j] for j in urls.buckets_of("".join(urls.host_path(u)), len(weights))) > 0) == bool(label)
    assert right / len(rows) >= 0.85


def test_too_many_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    with pytest.raises(ValueError):
        urls.judge(df, tuple(("block", f"h{i}.com", "/") for i in range(urls.MAX_RULES + 1)))
