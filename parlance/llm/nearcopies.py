"""Near copies by SimHash: fingerprints of shingle sets meet in bands of bits, exact set comparison confirms.

At a Jaccard similarity of 0.8 a bit of two texts' fingerprints differs with probability 0.1611 at most (0.1875 where a set
of four shingles lies in one of five), so near copies are some 40 of 256 bits apart, where unlike texts are 128 apart.
No choice of whole blocks of 64 bits, as `simhash.links` has them, covers such a radius. So fingerprints have 512 bits; texts
that agree on all bits of one of several bands, each some of these bits, meet in a bucket; there the bit planes and carry-save
counters of `simhash` find those within FIRST bits of 128 and WHOLE of 256. Texts so linked form groups, and inside a group
every pair is compared by its whole sets, so no link is false. The bands are as many as it takes for a pair at exactly 0.8 to be
left unproposed with a probability under MISS; the two radii add less than a tenth of it (for four shingles of five: 3 in
ten thousand in all, since so few shingles tell little).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, slices, utf8
from .graph import components
from .minhash import confirmed, set_hash, shingle_set
from .simhash import BITS, SEED, local_roots, met, named

#: Words of a fingerprint: all are drawn on for bands, the first four are compared, the first two of these by bit planes.
WORDS, COMPARED, PLANED = 8, 4, 2
FIRST, WHOLE = 44, 72
#: Largest probability that a bit differs at Jaccard 0.8, and how often such a pair may be missed.
DIFFERS, MISS = 0.1611, 5e-6


def missed(width: int, count: int, differs: float = DIFFERS) -> float:
    """Probability that two fingerprints agree on no whole band of `count`, each of `width` bits drawn from all."""
    n = BITS * WORDS
    d = np.arange(n + 1)
    chance = np.exp([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(differs) + (n - k) * log(1 - differs) for k in d])
    agree = np.prod([np.clip((n - d - i) / (n - i), 0, 1) for i in range(width)], axis=0)
    return float((chance * (1 - agree) ** count).sum())


def bands(width: int) -> np.ndarray:
    """The bits of each band; as many bands as MISS asks for."""
    count = 1
    while missed(width, count) > MISS:
        count += 1
    rng = np.random.default_rng(SEED)
    return np.array([rng.choice(BITS * WORDS, width, replace=False) for _ in range(count)])


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (sets by WORDS words) of sets of hashes: bits set in over half of a set's hashes, mixed anew for each word
    but the first; zero for an empty set. Bits are counted in bytes, eight to a word, over at most 255 hashes at a time.
    """
    out = np.zeros((len(sets), WORDS), np.uint64)
    full = [d for d, s in enumerate(sets) if len(s)]
    if not full:
        return out
    sizes = np.array([len(sets[d]) for d in full])
    parts = -(-sizes // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    base = np.concatenate([sets[d] for d in full])
    lanes = np.uint64(0x0101010101010101)
    for w in range(WORDS):
        x = base
        if w:
            x = x + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        word = np.zeros((len(full), 8), np.uint8)
        for b in range(8):
            counts = np.add.reduceat((x >> np.uint64(b)) & lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
            word |= (2 * np.add.reduceat(counts.astype(np.int64), first, axis=0) > sizes[:, None]).astype(np.uint8) << b
        out[full, w] = word.view("<u8").reshape(-1)
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, sum, fp (hash of the shingle set), n (its size), bits (its fingerprint) and node (the first word), of a table (doc_id, sum, text)."""
    schema = docs.select("doc_id", "sum").schema.add("fp", "long").add("n", "long").add("node", "long").add("bits", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = [shingle_set(t, size) for t in utf8(batch.column("text"))]
            words = wide(sets)
            counts = (pa.array([f(s) for s in sets], pa.int64()) for f in (set_hash, len))
            bits = pa.array([row.tobytes() for row in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), *counts, pa.array(words[:, 0].copy().view(np.int64)), bits], schema.names)

    return docs.mapInArrow(run, schema)


def proposals(distinct: DataFrame, bucket: int = 2048, tile: int = 4096, block: int = 2048) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (bits) that agree on a band and are within FIRST and WHOLE bits, by their
    first words. Bands are so wide that unlike texts fill a bucket with about `bucket` rows at most.
    """
    n, width = distinct.count(), 4
    while n >> width > bucket:
        width += 1
    chosen = bands(width)
    place = 1 << np.arange(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                whole = batch.column("bits").slice(at, 2000).to_pylist()
                flat = np.unpackbits(np.frombuffer(b"".join(whole), np.uint8).reshape(len(whole), -1), axis=1, bitorder="little")
                keys = np.stack([flat[:, band] @ place for band in chosen], 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1) * len(chosen), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([b[: 8 * COMPARED] for b in whole], pa.binary()), lists], ["fp", "keys"])

    def roots(fps: np.ndarray) -> np.ndarray:
        return local_roots(np.ascontiguousarray(fps[:, :PLANED]), FIRST, fps, WHOLE)

    rows = distinct.select("bits").mapInArrow(run, "fp binary, keys array<int>").select("fp", F.posexplode("keys").alias("choice", "key"))
    # At most one bucket for each `tile` rows is large.
    large = rows.groupBy("choice", "key").count().where(F.col("count") > tile).select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    return met(rows, F.broadcast(large), roots, block)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Component of every document: doc_id, component_id, sum (hash of the text) and root (the component's own number).

    component_id is the smallest doc_id reachable by pairs whose sets of lower-cased word shingles have a Jaccard similarity
    of `least` (0.8 or more) or more; a text of fewer words than a shingle is one shingle. Null, empty and word-less texts are
    equal sets. A row with a null id has its group's component_id (null if the group has no id). Repeated rows stay. An empty
    table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("sum"))
    each = cut(signatures(source, shingle), "signatures")
    distinct = each.groupBy("fp", "node", "bits").agg(F.min("doc_id").alias("least"), F.min("sum").alias("sum"), F.min("n").alias("n"), F.count("*").alias("copies"))
    distinct = cut(distinct, "distinct")
    sets = distinct.where("n > 0")
    linked = components(proposals(sets.select("bits")))
    # Unlike sets with one first word are one node, linked or not.
    rooted = cut(sets.join(linked, "node", "left").select("sum", F.coalesce("root", "node").alias("root"), "n"), "rooted")
    several = rooted.groupBy("root").agg(F.count("*").alias("members")).where("members > 1")
    found = components(confirmed(source, join_hot(rooted, several, ["root"], "members", rooted.count()), least, shingle))
    return named(each.select("doc_id", "sum", "fp"), distinct.select("fp", "least", "copies"), found).select("doc_id", "component_id", "sum", "root")
