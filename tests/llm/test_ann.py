import numpy as np

from parlance.llm import ann


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            scores = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(12, 32)), 150, 0) + 0.15 * rng.normal(size=(1800, 32))
    ids = np.arange(1800)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = found(ann.search(df, share=0.05, block=700, query_block=30)), brute(ids, x, 20, 20)
    assert set(got) == set(want)
    share = np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 20 for i in want])
    assert share >= 0.9
    for i in want:
        truth = (x * x[i]).sum(1)
        assert all(abs(s - truth[j]) < 1e-12 for j, s in got[i])


def test_small_tables_are_exact_with_ties_nulls_and_strays(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(1, 90)]
    good = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in good] + [(0, [1.0, 1.0, 0.0, 0.0]), (-20, [1.0, 0.0, 0.0, 1.0])]
    bad = [(1000, None), (1020, [0.0] * 4), (1040, [None, 1.0, 1.0, 1.0]), (1060, [float("nan"), 1.0, 1.0, 1.0]), (1080, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0] * 4)]
    rows = [*good, *bad, (2000, [1.0, 2.0]), (2001, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, dim int, b string")
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    want = brute(ids, x, 20, 20) | {2000: [(2001, 11.0)]}
    assert found(ann.search(df)) == want


def test_one_very_common_vector(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(300 + i, [0.5, 0.5, i / 50]) for i in range(50)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4))
    assert got[0] == [(i, 1.0) for i in range(1, 5)] and got[40] == [(i, 1.0) for i in range(4)]


def test_recall_where_a_fiftieth_is_reranked(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 24)), 100, 0) + 0.4 * rng.normal(size=(3000, 24))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = found(ann.search(df, k=10, share=0.02, sample=1000)), brute(ids, x, 20, 10)
    assert np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want]) >= 0.9


def test_many_vector_lengths_lose_no_row(spark):
    rows = [(20 * n + j, [float(j + 1)] + [0.0] * (n - 1)) for n in range(1, 1011) for j in range(2)]
    rows += [(100_000 + i, [1.0 + i, 1.0]) for i in range(130)] + [(200_000 + i, [1.0 + i, 1.0, 2.0]) for i in range(130)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {20 * n for n in range(1, 1011)} <= set(got)
    assert all(got[20 * n] == [(20 * n + 1, 2.0)] for n in range(5, 1011))
    assert got[100_020][0] == (100_129, 130.0 * 21 + 1)


def test_every_row_is_a_candidate_also_where_ids_repeat(spark):
    rows = [(20, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0])]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == sorted([(20, 1, 1, 3.0), (20, 2, 1, 3.0), (20, 3, 20, 2.0), (20, 1, 1, 6.0), (20, 2, 1, 6.0), (20, 3, 20, 2.0)])


def test_a_dense_cell_is_told_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=16) + 0.02 * rng.normal(size=(1500, 16))])
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = found(ann.search(df, k=10, share=0.02)), brute(ids, x, 20, 10)
    assert np.mean([len({a for a, _ in got[i]} & {a for a, _ in want[i]}) / 10 for i in want]) >= 0.9


def test_codes_are_packed_two_to_a_byte():
    codes = np.random.default_rng(0).integers(0, 16, (9, 7)).astype(np.uint8)
    held = ann.packed(codes)
    assert held.shape == (9, 4) and (ann.unpacked(held, 7) == codes).all()


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert ann.search(df).collect() == [] and ann.search(df.limit(0)).collect() == []


def test_parallel_error_is_smaller_than_with_the_plain_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(share):
        q = ann.fit(x, 8, 2, share)
        at, codes = q.encode(x)
        made = q.centres[at] + q.scale[at, None] * q.books[np.arange(8), codes].reshape(len(x), -1)
        return float((((x - made) * x).sum(1) ** 2).mean())

    assert parallel(0.6) < parallel(0.0)
