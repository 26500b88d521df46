"""SimHash near-duplicates: fingerprints of word shingles, linked by bit-sliced comparison.

Two fingerprints within `radius` bits agree on all of some n - radius of n blocks of bits, so distinct fingerprints meet in
buckets, one for each choice of blocks; n is 4 for radius 3 and grows with their number, so that buckets stay small. All
choices are covered, so no link is lost. Inside a block of bucket rows, bit planes are stored vertically (bit b of 64
fingerprints is one word), distances to many fingerprints advance together in carry-save counters, and a query's word of 64
fingerprints is abandoned once all its distances exceed the radius. Buckets above `tile` rows are cut into tiles that cover every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, slices, utf8
from .graph import components

BITS, SEED = 64, 42


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """XXH64 of each shingle of `size` words, repeats included; of the whole sequence if it has fewer; none without words."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: bits set in over half of its hashes; zero for an empty list."""
    out = np.zeros(len(hashes), np.uint64)
    place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for d, own in enumerate(hashes):
        if own:
            h = np.array(own, "<u8")
            counts = np.zeros(BITS, np.int64)
            for at in range(0, len(h), 65_536):
                bits = np.unpackbits(h[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            out[d] = place[2 * counts > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = source.select("doc_id").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            found = majority([shingle_hashes(t, shingle) for t in utf8(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], schema.names)

    return source.mapInArrow(run, schema)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b packs bit b of all fingerprints (of one or more words) into words, 64 to a word, filled up with zeros."""
    fps = fps.reshape(len(fps), -1)
    n = -len(fps) % 64
    bits = np.unpackbits(np.concatenate([fps, np.zeros((n, fps.shape[1]), np.uint64)]).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray, carry: np.ndarray, half: np.ndarray) -> None:
    """Carry-save adder of three bits, 64 times a word: the sum goes into `a`; `b` and `half` are overwritten."""
    np.bitwise_xor(a, b, out=half)
    np.bitwise_and(a, b, out=carry)
    np.bitwise_and(half, c, out=b)
    np.bitwise_or(carry, b, out=carry)
    np.bitwise_xor(half, c, out=a)


def within(fps: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (queries by words over fps): set where the distance is at most `radius`.

    Eight planes at a time go through carry-save adders into counters that start at 2**k - 1 - radius, so a carry out of
    their k bits means that the radius is exceeded. A query's word of 64 fingerprints is abandoned once all of them exceed it.
    """
    plane = planes(fps)
    bits, words = plane.shape
    k = max(3, radius.bit_length())
    start = (1 << k) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.unpackbits(np.ascontiguousarray(queries.reshape(len(queries), -1)).view(np.uint8), axis=1, bitorder="little")
    flips = np.where(own.T.astype(bool), ones, np.uint64(0))
    counter = [np.full((len(queries), words), ones if start >> i & 1 else 0, np.uint64) for i in range(k)]
    over = np.zeros((len(queries), words), np.uint64)
    tail = len(fps) % 64
    if tail:
        over[:, -1] = ones << np.uint64(tail)
    out = np.zeros(over.size, np.uint64)
    cells = query = word = None

    def load(b: int, into: np.ndarray) -> None:
        if cells is None:
            np.bitwise_xor(plane[b][None, :], flips[b][:, None], out=into)
        else:
            np.bitwise_xor(plane[b][word], flips[b][query], out=into)

    free = [np.empty_like(over) for _ in range(7)]
    for at in range(0, bits, 8):
        x, y, half, carry, other, *fours = free
        for b, four in zip((at, at + 4), fours, strict=True):
            for pair, two in ((b, carry), (b + 2, other)):
                load(pair, x)
                load(pair + 1, y)
                _add(counter[0], x, y, two, half)
            _add(counter[1], carry, other, four, half)
        _add(counter[2], *fours, carry, half)
        for c in counter[3:]:
            np.bitwise_and(c, carry, out=half)
            np.bitwise_xor(c, carry, out=c)
            carry, half = half, carry
        np.bitwise_or(over, carry, out=over)
        if radius < at + 8 < bits:
            left = over != ones
            n = np.count_nonzero(left)
            if not n:
                break
            if 2 * n < left.size:
                cells = np.flatnonzero(left) if cells is None else cells[left]
                query, word = np.divmod(cells, words)
                over, counter = over[left], [c[left] for c in counter]
                free = [np.empty_like(over) for _ in range(7)]
    out[slice(None) if cells is None else cells] = ~over.reshape(-1)
    return out.reshape(len(queries), words)


def _nearer(found: np.ndarray, whole: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """The bit matrix `found` without the pairs whose whole fingerprints are more than `radius` bits apart."""
    query, word = np.nonzero(found)
    bits = np.unpackbits(found[query, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for at in range(0, len(bits), 65_536):
        row, lane = np.nonzero(bits[at : at + 65_536])
        row += at
        far = np.bitwise_count(queries[query[row]] ^ whole[64 * word[row] + lane]).sum(axis=1) > radius
        bits[row[far], lane[far]] = 0
    found[query, word] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return found


def local_roots(fps: np.ndarray, radius: int, whole: np.ndarray | None = None, whole_radius: int = 0) -> np.ndarray:
    """For each of the distinct fingerprints the position of the first one that it reaches by links among them.

    Where `fps` are only the first words of fingerprints, `whole` has all words, which must be within `whole_radius` too.
    """
    n = len(fps)
    parts = []
    for at in range(0, n, 512):
        found = within(fps, fps[at : at + 512], radius)
        parts.append(found if whole is None else _nearer(found, whole, whole[at : at + 512], whole_radius))
    links = np.concatenate(parts)
    root = np.arange(n)
    single = np.bitwise_count(links).sum(axis=1) <= 1
    seen = single.copy()
    for i in np.flatnonzero(~single):
        if seen[i]:
            continue
        reached = np.zeros(links.shape[1], np.uint64)
        new = np.array([i])
        while len(new):
            seen[new] = True
            root[new] = i
            found = np.bitwise_or.reduce(links[new], axis=0)
            fresh = found & ~reached
            reached |= found
            new = np.flatnonzero(np.unpackbits(fresh.view(np.uint8), bitorder="little")[:n])
            new = new[~seen[new]]
    return root


def _choices(n_blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """The (shift, mask) of each block, for every choice of n_blocks - radius blocks."""
    edges = [BITS * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(blocks, n_blocks - radius)]


def links(distinct: DataFrame, radius: int = 3, tile: int = 8192, block: int = 1024, n_blocks: int | None = None) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within `radius` bits, over a table of distinct ones (fp).

    Each bucket gives a star for each of its local components, so edges are fewer than bucket rows, however many pairs
    are linked.
    """
    if n_blocks is None:
        n, n_blocks = distinct.count(), radius + 1
        while n_blocks < 2 * radius + 2 and n >> (BITS * (n_blocks - radius) // n_blocks) > 500:
            n_blocks += 1
    keys = []
    for c, chosen in enumerate(_choices(n_blocks, radius)):
        key, width = F.lit(0).cast("long"), 0
        for shift, mask in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)), width))
            width += mask.bit_length()
        keys.append(F.struct(F.lit(c).alias("choice"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.key")
    large = rows.groupBy("choice", "key").count().where(F.col("count") > tile).select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    return met(rows, large, lambda fps: local_roots(fps, radius), block)


def met(rows: DataFrame, large: DataFrame, roots: Callable[[np.ndarray], np.ndarray], block: int) -> DataFrame:
    """Edges (u, v) from each fingerprint to the one that `roots` gives it among the distinct ones of whole buckets.

    Rows are (fp, choice, key); buckets in `large` (choice, key, parts) are cut into tiles that cover every pair. Where `fp` is
    binary, of some words each, edges name fingerprints by their first words.
    """
    binary = rows.schema["fp"].dataType.simpleString() == "binary"
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.join(large, ["choice", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    rows = rows.select("fp", "choice", "key", "own", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("other")).select("fp", "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = rows.repartition("choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(parts: list[np.ndarray]) -> pa.RecordBatch:
            fps = np.unique(np.concatenate(parts), axis=0)
            root = roots(fps)
            at = np.flatnonzero(root != np.arange(len(fps)))
            first = (fps[:, 0] if binary else fps).copy().view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(first[at]), pa.array(first[root[at]])], ["u", "v"])

        held: list[np.ndarray] = []
        last, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp")
            fp = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1) if binary else fp.to_numpy().view(np.uint64)
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "key", "i", "j")], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                me = tuple(group[a])
                # Whole buckets share a block: a link between two buckets' rows is a true link as well.
                if me != last and size + (b - a) > block and size:
                    yield compare(held)
                    held, size = [], 0
                held.append(fp[a:b])
                size += b - a
                last = me
        if size:
            yield compare(held)

    return dealt.select("fp", "choice", "key", "i", "j").mapInArrow(run, "u long, v long")


def named(each: DataFrame, distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """`each` with root and component_id: the component's own fp, and its least id, by the links (node, root) between fps.

    `distinct` has a row for each fp with its least id and its number of copies; an fp of many copies is met by broadcast.
    """
    members = cut(linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()), "members")
    inside = members.join(distinct.select("fp", "least"), members["node"] == distinct["fp"])
    names = inside.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    known = join_hot(members, names, ["root"], "size", members.count()).select(F.col("node").alias("fp"), "root", "component_id", F.lit(True).alias("known"))
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("least"))
    labels = distinct.join(known, "fp", "left").select("fp", "copies", F.coalesce("root", "fp").alias("root"), own.alias("component_id"))
    return join_hot(each, labels, ["fp"], "copies", distinct.agg(F.sum("copies")).first()[0] or 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Fingerprint and component of every document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links between fingerprints at most `radius` bits apart. Null, empty
    and word-less texts have fingerprint zero, linked like any other. A row with a null id has its group's component_id
    (null if the group has no id). Repeated rows stay. An empty table gives no rows; other columns are not read.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    linked = components(links(distinct.select("fp"), radius))
    return named(each, distinct, linked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
