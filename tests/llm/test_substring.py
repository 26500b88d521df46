import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import substring
from parlance.llm.textvec import Words


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=str)


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=24), min_size=1, max_size=8), st.integers(1, 6), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_matching_statistics_against_brute_force(texts, window, least):
    lengths = np.array([len(t) for t in texts])
    ids = np.array([i for t in texts for i in t])
    weights = np.arange(1, len(texts) + 1)
    index = substring.FMIndex(ids, lengths, weights, window)
    seen = Counter()
    for t, w in zip(texts, weights.tolist(), strict=True):
        for n in range(1, window + 1):
            for i in range(len(t) - n + 1):
                seen[tuple(t[i : i + n])] += w
    asked = [*texts, [9, 1, 2, 9, 1], [2, 2, 1, 3]]  # also texts that the index does not hold
    sizes = np.array([len(t) for t in asked])
    depth, met = index.statistics(np.array([i for t in asked for i in t]), np.cumsum(sizes) - sizes, sizes, least)
    at = 0
    for t in asked:
        for i in range(len(t)):
            longest = max((n for n in range(1, min(window, len(t) - i) + 1) if seen[tuple(t[i : i + n])] >= least), default=0)
            assert depth[at] == longest
            assert not longest or met[at] == seen[tuple(t[i : i + longest])]
            at += 1


@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000))
@settings(max_examples=40, deadline=None)
def test_wavelet_tree_counts(symbols):
    tree = substring.WaveletTree(np.array(symbols), 42)
    at = np.arange(0, len(symbols) + 1, max(1, len(symbols) // 7))
    for symbol in (0, 1, symbols[0], 41):
        assert tree.rank(np.full(len(at), symbol), at).tolist() == [symbols[:n].count(symbol) for n in at.tolist()]


def test_a_tree_of_many_symbols_is_small():
    rng = np.random.default_rng(0)
    symbols = np.minimum(rng.zipf(1.2, 300_000), 30_000)
    tree = substring.WaveletTree(symbols, 30_001)
    share = np.bincount(symbols) / len(symbols)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert 64 * len(tree.bits) <= (entropy + 1) * len(symbols) + 64
    assert tree.near.nbytes + tree.far.nbytes <= 0.26 * tree.bits.nbytes + 64


def test_blocks_of_an_index_agree_with_one():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(6, 20))).encode() for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    counts = np.ones(len(texts), np.int64)
    assert substring.repeated(texts, counts, 6) == substring.repeated(texts, counts, 6, most=40)


def test_word_hashes_do_not_depend_on_the_place():
    a, b = Words([b"x  the cat\tsat", None, b"", b"the cat sat"]), Words([b"cat"])
    assert len(a) == 7 and a.hash[1] == a.hash[4] and a.hash[2] == b.hash[0]
    assert a.runs(np.array([1]), np.array([4]))[0] == a.runs(np.array([4]), np.array([7]))[0]
    assert a.first.tolist() == [0, 4, 4, 4, 7]


def test_documents_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 90)))) for i in range(30)]
    rows += [(100 + i, " ".join(word() for _ in range(i)) + "\n" + passage + "\t" + word()) for i in range(12)]
    rows += [(200, "same " * 200), (201, ("one two three four five " * 30)), (202, None), (203, ""), (204, "a b"), (205, rows[0][1]), (205, rows[0][1]), (205, rows[1][1]), (None, passage), (None, "tiny")]
    rows += [(300, passage[: len(passage) // 2]), (301, " ".join(passage.split()[10:50])), (302, "été " * 50)]
    table = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, sum long, n_words string")
    for window, hot_runs in ((35, 1000), (12, 1000), (35, 2), (12, 1)):
        got = substring.dedup(table, window=window, hot_runs=hot_runs).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def morse(n):
    """A word of 2**n letters and its complement: polynomial hashes modulo 2**64 cannot tell long ones apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_share_a_polynomial_hash_are_told_apart(spark):
    a, b = morse(11)
    hashes = Words([a.encode(), b.encode()]).hash
    assert hashes[0] == hashes[1]
    rest = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*rest[:20], a, *rest[20:]])), (2, " ".join([*rest[:20], b, *rest[20:]])), (3, " ".join([*rest[:20], b, *rest[20:]]) + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_runs in (1000, 0):
        got = substring.dedup(table, hot_runs=hot_runs).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 35)
        assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 41, 3: 41}


def test_windows_that_share_their_ends(spark):
    rows = [(i, " ".join(["go"] * 12 + [f"m{i}"] * 11 + ["end"] * 12)) for i in range(40)] + [(100, " ".join(["go"] * 12 + ["m7"] * 11 + ["end"] * 12) + " more")]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_runs=3).collect()
    assert {r.doc_id for r in got if r.n_removed} == {7, 100}


def test_a_bitmap_knows_its_hashes_and_few_others(spark):
    rng = np.random.default_rng(1)
    # Like minimizers: the highest bits are mostly zero.
    own, other = (np.minimum.reduce(rng.integers(0, 1 << 63, (20, 20_000), np.uint64) * np.uint64(2)).view(np.int64) for _ in range(2))
    bits = substring.Bits(spark.createDataFrame([(int(h),) for h in own], "h long"), len(own))
    assert bits.sharp and bits.have(own).all() and bits.have(other).mean() < 0.03


def test_empty_table(spark):
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
