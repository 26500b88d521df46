import random

import numpy as np
import xxhash

from parlance.llm import simhash
from parlance.llm.graph import components


def fingerprint(text, size=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def test_within_equals_popcounts():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(2))]))
    for radius in (0, 1, 3, 6):
        bits = np.unpackbits(simhash.within(fps, fps, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)].astype(bool)
        assert (bits == (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)).all()


def test_texts_against_brute_force(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base * 2)]
    rows += [(100 + i, t + " tail") for i, t in enumerate(base)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "two words"), (None, base[0]), (None, "alone here now"), (206, "É é"), (206, "É é"), (207, "x y z"), (208, "long " * 5000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(table).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute(rows)


def planted(n, seed=5):
    """Chains of fingerprints a few bits apart."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


def roots(fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_all_block_choices_and_tiles_give_the_same_components(spark):
    fps = planted(120)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = roots(fps, 3)
    for options in ({"n_blocks": 4}, {"n_blocks": 5}, {"n_blocks": 8}, {"tile": 8, "block": 16}, {"tile": 1}):
        groups = {}
        for r in components(simhash.links(table, 3, **options)).collect():
            groups.setdefault(r.root % (1 << 64), {r.root % (1 << 64)}).add(r.node % (1 << 64))
        assert {frozenset(g) for g in groups.values()} == want, options


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(500, 500), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{j: 100 for j in range(101, 160)}}
