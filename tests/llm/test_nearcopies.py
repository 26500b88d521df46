import random
from fractions import Fraction

import numpy as np
import xxhash

import corpus_pipeline
from parlance.llm import nearcopies
from parlance.llm.graph import components


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))} if words else set()


def fingerprint(hashes):
    out = []
    for w in range(nearcopies.WORDS):
        mixed = []
        for x in hashes:
            if w:
                x = (x + w * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
            mixed.append(x)
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed)))
    return out


def planted():
    rng = random.Random(5)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200, 700]))]
        rows.append((len(rows), " ".join(words)))
        for k in range(3):
            copy = list(words)
            for _ in range(max(1, len(words) * (k + 1) // 100)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (None, rows[0][1]), (500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "one three"), (0, rows[0][1])]


def brute(rows, least=Fraction(4, 5)):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, ids.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprints_equal_a_plain_twin():
    texts = [None, "one", *(t for _, t in planted()[:12]), " ".join(f"v{i}" for i in range(900))]
    sets = [np.array(sorted(shingles(t)), np.uint64) for t in texts]
    assert nearcopies.wide(sets).tolist() == [fingerprint(s.tolist()) for s in sets]


def test_components_are_those_of_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in nearcopies.near_copies(df).collect()), key=str)
    assert got == brute(rows)
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def test_sets_that_share_a_first_word_are_compared(spark):
    words = [f"w{i}" for i in range(3000)]
    near = [*words[:-1], "last"]
    a, b = (np.array(sorted(shingles(" ".join(w))), np.uint64) for w in (words, near))
    assert nearcopies.wide([a])[0, 0] == nearcopies.wide([b])[0, 0] and a.tolist() != b.tolist()
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert {r.component_id for r in nearcopies.near_copies(df).collect()} == {1}


def test_links_reach_only_within_both_radii_and_tiles_lose_none(spark):
    sets = [np.array(sorted(shingles(t)), np.uint64) for _, t in planted()[:120]]
    bits = np.unique(nearcopies.wide(sets), axis=0)
    table = spark.createDataFrame([(bytearray(b.tobytes()),) for b in bits], "bits binary")
    far = np.bitwise_count(bits[:, None] ^ bits[None])
    near = (far[:, :, : nearcopies.PLANED].sum(axis=2) <= nearcopies.FIRST) & (far[:, :, : nearcopies.COMPARED].sum(axis=2) <= nearcopies.WHOLE)
    for k in range(len(near)):
        near |= near[:, k : k + 1] & near[k : k + 1]
    first = bits[:, 0].copy().view(np.int64).tolist()
    edges = nearcopies.proposals(table).collect()
    assert edges and all(near[first.index(r.u), first.index(r.v)] for r in edges)
    a, b = (sorted(map(tuple, components(nearcopies.proposals(table, **o)).collect())) for o in ({}, {"tile": 2, "block": 1}))
    assert a == b


def test_bands_are_as_many_as_the_bound_asks_for():
    for width in (4, 8, 13):
        n = len(nearcopies.bands(width))
        assert nearcopies.missed(width, n) <= nearcopies.MISS < nearcopies.missed(width, n - 1)


def test_the_stage_goes_by_simhash(spark, monkeypatch):
    asked = []
    real = nearcopies.proposals
    monkeypatch.setattr(nearcopies, "proposals", lambda sets: asked.append(sets) or real(sets).limit(0))
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, 200))) for i in range(3)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, df, "").count() == 3 and asked
