import random
from collections import Counter

import numpy as np

from parlance.llm import quality


def brute(text):
    words = (text or "").encode().split()
    n = len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    seen = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(i, i + 8))
    lines, dup, earlier = (text or "").split("\n"), 0, set()
    for line in lines:
        if line.encode().split():
            dup += line in earlier
            earlier.add(line)
    return (n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé#漢") for _ in range(rng.randint(1, 4)))
    out = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x\nx\n\n\nx \nx", "\x0bq\x0cr\xa0s\u2003t\x1cu", "k " * 9, "long " * 20_000]
    return out + ["\n".join(" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))) for _ in range(60)]


def test_statistics_against_brute_force():
    for text in texts():
        assert quality.statistics(text.encode() if text is not None else None)[0] == brute(text), repr(text)[:80]


def test_judge_rows_columns_and_base_rule(spark):
    rows = [(i, t, 5, "k") for i, t in enumerate(texts())] + [(None, "a b", None, None), (3, "a", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = quality.judge(df, None).collect()
    want = []
    for d, t, *_ in rows:
        c = brute(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((d, *c, failed, not failed))
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)
    wide = quality.judge(df, None, keep_columns=True)
    assert wide.columns == ["doc_id", "text", "n_words", "kept", "_n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_kept", "score"]
    assert quality.judge(df.limit(0), None).count() == 0


def test_trees_learn_and_obey_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.train(x[:2000], y[:2000], (-1, 1, 0), n_trees=30)
    assert ((model.score(x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.9
    for f, sign in ((0, -1), (1, 1)):
        grid = np.repeat(rng.random((50, 3)), 60, 0)
        grid[:, f] = np.tile(np.linspace(0, 1, 60), 50)
        steps = np.diff(model.score(grid).reshape(50, 60), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_held_out_accuracy_and_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = quality.fit(docs, labels, max_labels=250)
    seen = {r.doc_id for r in labels.selectExpr("doc_id").orderBy(quality.F.xxhash64("doc_id"), "doc_id").limit(250).collect()}
    rows = [r for r in quality.judge(docs, fitted).join(labels, "doc_id").collect() if r.doc_id not in seen and not r.base_failed]
    assert len(rows) > 80
    assert np.mean([r.kept == bool(r.quality) for r in rows]) >= 0.95


def test_fit_without_two_classes(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert quality.fit(docs, labels.limit(0)) is None


def test_scores_equal_a_recursive_walk():
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(600, len(quality.FEATURES)))
    y = (x[:, 0] + rng.normal(0, 0.3, 600) > 0.5).astype(float)
    trees = quality.train(x, y, tuple(quality.FEATURES.values()), n_trees=12)

    def walk(node, row):
        if trees.left[node] == node:
            return trees.value[node]
        return walk(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node], row)

    want = [trees.bias + sum(walk(root, row) for root in trees.roots) for row in x[:80]]
    assert np.allclose(trees.score(x[:80]), want)


def test_few_labels_of_both_classes_give_trees(spark):
    good = "The quiet river runs past the old mill and turns slow wheels while farmers talk about harvest and bread until evening comes."
    rows = [(i, f"{good} {i}" if i % 2 else "$$$ ### " * 15 + str(i)) for i in range(39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(39)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model is not None
    kept = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(39))
    assert quality.fit(docs, labels.where("quality = 1")) is None
