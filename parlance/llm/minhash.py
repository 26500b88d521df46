"""Near copies by the Jaccard similarity of word shingles: MinHash bands propose groups, exact set comparison decides.

A text is the set of its shingle hashes. Texts that agree on all hashes of one of BANDS bands meet in a bucket; buckets that
share a text form one group, and inside a group every pair is compared by its whole sets. So no link is false, and a pair
at similarity 0.8 is not proposed with probability (1 - 0.8**ROWS)**BANDS, which is 5 in a million. Large groups are cut into
tiles that cover every pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import cut, join_hot, slices, utf8
from .graph import components
from .simhash import SEED, named, shingle_hashes

BANDS, ROWS = 40, 6
#: Keys of texts that are broadcast at most.
MOST_KEYS = 500_000
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray) -> list[int]:
    """A key for each band of the MinHash values of a set of hashes."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, sum, fp (hash of the shingle set), n (its size) and bands, of a table (doc_id, sum, text)."""
    schema = docs.select("doc_id", "sum").schema.add("fp", "long").add("n", "long").add("bands", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            sets = [shingle_set(t, size) for t in utf8(batch.column("text"))]
            keys = np.array([bands(s) for s in sets if len(s)], np.uint64).reshape(-1)
            offsets = BANDS * np.cumsum([0, *[len(s) > 0 for s in sets]])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sum"), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], schema.names)

    return docs.mapInArrow(run, schema)


def local_roots(sets: list[np.ndarray], least: Fraction) -> np.ndarray:
    """For each set the position of the first one that it reaches by pairs of Jaccard similarity `least` or more."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)
    root, seen = np.arange(n), np.zeros(n, bool)
    open_flat, open_owner, held = flat, owner, n
    mark = np.zeros(len(words), bool)
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        new = [i]
        while new and not seen.all():
            x = new.pop()
            if 2 * (n - np.count_nonzero(seen)) < held:
                left = ~seen[open_owner]
                open_flat, open_owner, held = open_flat[left], open_owner[left], n - np.count_nonzero(seen)
            own = flat[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            both = np.bincount(open_owner[mark[open_flat]], minlength=n)
            mark[own] = False
            found = np.flatnonzero(~seen & (both * least.denominator >= least.numerator * (sizes + sizes[x] - both)))
            seen[found] = True
            root[found] = i
            new.extend(found.tolist())
    return root


def links(docs: DataFrame, each: DataFrame, distinct: DataFrame, least: float, size: int, tile: int = 1024, tile_shingles: int = 1_000_000) -> DataFrame:
    """Edges (u, v) that connect exactly the proposed sets whose similarity is `least` or more."""
    keys = each.select("fp", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").select("key", "v")
    found = components(keys.join(shared, "key").select(F.col("fp").alias("u"), "v"))
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp"), "root")
    return confirmed(docs, found.join(distinct, "fp").select("sum", "root", "n"), least, size, tile, tile_shingles)


def confirmed(docs: DataFrame, groups: DataFrame, least: float, size: int, tile: int = 1024, tile_shingles: int = 1_000_000) -> DataFrame:
    """Edges (u, v) that connect exactly the sets of one proposed group whose similarity is `least` or more.

    `groups` has a row for each set: sum (a text that has it), root (its group) and n (its size). Texts of proposed sets alone
    are read again, one for each set; no set is stored or moved.
    """
    groups = cut(groups, "groups")
    parts = groups.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / tile_shingles)).cast("int").alias("parts"), F.count("*").alias("members"))
    rows = join_hot(groups, parts, ["root"], "members", groups.count()).withColumn("own", F.pmod(F.xxhash64("sum"), "parts").cast("int"))
    rows = rows.select("sum", "root", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("sum", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    wanted = groups.select("sum").distinct()
    if wanted.count() <= MOST_KEYS:
        wanted = F.broadcast(wanted)
    # Copies of a text fall together before they are moved.
    texts = docs.join(wanted, "sum", "left_semi").groupBy("sum").agg(F.first("text").alias("text"))
    dealt = texts.join(rows, "sum").select("root", "i", "j", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    share = Fraction(str(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(held: list[np.ndarray]) -> pa.RecordBatch:
            root = local_roots(held, share)
            at = np.flatnonzero(root != np.arange(len(held)))
            fps = np.array([set_hash(s) for s in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[root[at]])], ["u", "v"])

        held: list[np.ndarray] = []
        last = None
        for batch in slices(batches, "text"):
            root, i, j = (batch.column(c).to_pylist() for c in ("root", "i", "j"))
            for at, text in enumerate(utf8(batch.column("text"))):
                me = (root[at], i[at], j[at])
                if me != last and held:
                    yield compare(held)
                    held = []
                held.append(shingle_set(text, size))
                last = me
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Component of every document: doc_id, component_id, sum (hash of the text) and root (the component's own number).

    component_id is the smallest doc_id reachable by pairs whose sets of lower-cased word shingles have a Jaccard similarity
    of `least` or more; a text of fewer words than a shingle is one shingle. Null, empty and word-less texts are equal sets.
    A row with a null id has its group's component_id (null if the group has no id). Repeated rows stay. An empty table
    gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", F.xxhash64("text").alias("sum"))
    each = cut(signatures(source, shingle), "signatures")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sum").alias("sum"), F.min("n").alias("n"), F.count("*").alias("copies")), "distinct")
    found = components(links(source, each, distinct, least, shingle))
    return named(each.select("doc_id", "sum", "fp"), distinct.select("fp", "least", "copies"), found).select("doc_id", "component_id", "sum", "root")
