"""Maximum inner product search: anisotropic product quantisation, four-bit table scans, exact reranking.

The quantiser is fitted on a bounded sample of rows: coarse centres, then a product codebook of 16 codewords for each short
subspace of the residual. Its loss is score-aware: the part of the residual parallel to the vector weighs more than the
rest, since it is what changes large inner products; codewords are fitted and assigned under that loss. Every row is
indexed once, with two codes to a byte, in the cell of its coarse centre. A query visits only cells that can hold a better
row than the k-th best of the sample, by a bound that loses none. Queries and rows meet in blocks: a block scans its codes
by lookup tables of 16 entries, reranks a small share by the exact product in double precision, and gives each query its
best few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CODES = 16


@dataclass
class Quantiser:
    """Coarse centres (c, d), a codebook (subspaces, 16, width), the weight of the parallel error, and the length of a usual
    residual of each centre, by which residuals are divided: a dense cell is told apart as finely as a wide one."""

    centres: np.ndarray
    books: np.ndarray
    eta: float
    scale: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors as (n, subspaces, width), filled up with zeros."""
        n, d = x.shape
        wide = np.zeros((n, self.books.shape[0] * self.width))
        wide[:, :d] = x
        return wide.reshape(n, -1, self.width)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The coarse centre of each vector."""
        return nearest(x, self.centres)

    def residual(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.split((x - self.centres[at]) / self.scale[at, None])

    def encode(self, x: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """(centres, codes): coordinate descent on the score-aware loss, from the plain nearest codewords."""
        at = self.assign(x)
        rest = self.residual(x, at)
        unit = self.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        gap = rest[:, :, None, :] - self.books[None]
        square, along = (gap**2).sum(-1), np.einsum("nmkw,nmw->nmk", gap, unit)
        codes = square.argmin(-1)
        own = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0]
        total = own.sum(1)
        for _ in range(rounds):
            for m in range(codes.shape[1]):
                other = total - own[:, m]
                loss = square[:, m] + (self.eta - 1) * (other[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(-1)
                own[:, m] = np.take_along_axis(along[:, m], codes[:, m, None], 1)[:, 0]
                total = other + own[:, m]
        return at, codes.astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[i : i + 8192] @ centres.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, c, len(centres)) for c in x.T], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(x: np.ndarray, centres: int = 64, width: int = 2, share: float = 0.2, rounds: int = 6, seed: int = 7) -> Quantiser:
    """Fit on sample vectors. `share` is the score threshold T relative to the norm; the parallel error weighs
    eta = (d - 1) T^2 / (1 - T^2) times the orthogonal one, and at least as much."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    eta = max(1.0, (d - 1) * share**2 / (1 - share**2))
    mids = _means(x, centres, 10, rng)
    parts = -(-d // width)
    at = nearest(x, mids)
    square = np.bincount(at, ((x - mids[at]) ** 2).sum(1), len(mids)) / np.maximum(1, np.bincount(at, minlength=len(mids)))
    q = Quantiser(mids, np.zeros((parts, CODES, width)), eta, np.where(square > 0, np.sqrt(square), 1.0))
    rest = q.residual(x, at)
    q.books = np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in (_means(rest[:, m], CODES, 8, rng) for m in range(parts))])
    unit = q.split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    for _ in range(rounds):
        _, codes = q.encode(x, 1)
        gap = rest - q.books[np.arange(parts), codes]
        along = np.einsum("nmw,nmw->nm", gap, unit)
        total = along.sum(1)
        for m in range(parts):
            other = total - along[:, m]
            for k in range(CODES):
                on = codes[:, m] == k
                if on.any():
                    u = unit[on, m]
                    left = on.sum() * np.eye(width) + (eta - 1) * u.T @ u
                    right = rest[on, m].sum(0) + (eta - 1) * (u * ((u * rest[on, m]).sum(1) + other[on])[:, None]).sum(0)
                    q.books[m, k] = np.linalg.solve(left + 1e-9 * np.eye(width), right)
    return q


def scan(q: Quantiser, queries: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products (queries by rows) from tables of 16 entries for each subspace."""
    tables = np.einsum("qmw,mkw->mkq", q.split(queries), q.books).astype(np.float32)
    out = np.zeros((len(at), len(queries)), np.float32)
    for m in range(codes.shape[1]):
        out += tables[m][codes[:, m]]
    out *= q.scale.astype(np.float32)[at, None]
    return (out + (queries @ q.centres.T).T[at]).T


def top(queries: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, q: Quantiser, at: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position in x, score) of each query's best k rows but its own, after exact reranking of the `rerank` best by
    the scan. Ties go to the first: rows come in order of their id. Equal vectors are scanned and reranked as one, and
    its first k + 1 rows take part in the result, so a very common vector crowds nothing out."""
    _, first, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    by_first = np.argsort(first)
    first, group = first[by_first], np.argsort(by_first)[group]
    members = np.argsort(group, kind="stable")
    size = np.bincount(group)
    start = np.cumsum(size) - size
    size = np.minimum(size, k + 1)
    x, at, codes = x[first], at[first], codes[first]
    rerank = min(rerank, len(x))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 64):
        for i, row in enumerate(scan(q, queries[a : a + 64], at, codes)):
            if len(row) > rerank:
                least = np.partition(row, len(row) - rerank)[len(row) - rerank]
                above = np.flatnonzero(row > least)
                near = np.sort(np.concatenate([above, np.flatnonzero(row == least)[: rerank - len(above) + 1]]))
            else:
                near = np.arange(len(row))
            exact = (x[near] * queries[a + i]).sum(1)
            order = np.argsort(-exact, kind="stable")[: k + 1]
            near, exact = near[order], exact[order]
            n = size[near]
            place = members[np.repeat(start[near], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            score = np.repeat(exact, n)
            other = rows[place] != own[a + i]
            place, score = place[other], score[other]
            order = np.lexsort((place, -score))[:k]
            found.append((np.full(len(order), a + i), place[order], score[order]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part: no null id, vector or component, all finite, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda e: e != 0))


def packed(codes: np.ndarray) -> np.ndarray:
    """Codes of four bits, two to a byte."""
    wide = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return wide[:, ::2] | wide[:, 1::2] << 4


def unpacked(held: np.ndarray, subspaces: int) -> np.ndarray:
    return np.stack([held & 15, held >> 4], 2).reshape(len(held), -1)[:, :subspaces]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, sample: int = 10_000, share: float = 0.02, block: int = 16_384, query_block: int = 32_768) -> DataFrame:
    """The k rows with the largest inner product for each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    The quantiser sees at most `sample` rows, chosen by a hash of the row; every row is indexed. Of a block's rows the scan
    picks `share`, or 5 k if more, for exact reranking. Vectors that are null, zero, or hold null or non-finite components
    take no part; vectors of different lengths are of different spaces, and are searched among their like. Every other row is
    a candidate, also one that repeats the query's id or vector; rows of a query's id are queries of their own, whose
    results follow each other under that id. No rows, no result.
    """
    rows = cut(usable(vectors, id_col, vector_col).withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = cut(rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).where("queries > 0"), "sizes")
    few = F.col("n") <= 5 * k
    found = _few(rows.join(sizes.where(few).select("dim"), "dim", "left_semi"), is_query, k)
    sizes = sizes.where(~few).toArrow().to_pydict()
    for dim, n, queries in sorted(zip(sizes["dim"], sizes["n"], sizes["queries"], strict=True)):
        one = _space(rows.where(F.col("dim") == dim).select("row", "vec_id", "vec"), dim, n, queries, is_query, k, sample, share, block, query_block)
        found = found.unionByName(one)
    # A rank limit: each task keeps its k best of a query before the shuffle, and no query is held as one list.
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def _result(left: pd.DataFrame, right: pd.DataFrame, where: np.ndarray, at: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_row": right["row"].to_numpy()[where], "query_id": right["vec_id"].to_numpy()[where], "row": left["row"].to_numpy()[at], "vec_id": left["vec_id"].to_numpy()[at], "score": score})


def _few(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """All spaces of at most 5 k rows, in one job: the scan would pick all their rows for reranking."""

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        x, asked = np.stack(group["vec"].to_numpy()), group[group["ask"]]
        q = Quantiser(np.zeros((1, x.shape[1])), np.zeros((x.shape[1], CODES, 1)), 1.0, np.ones(1))
        none = np.zeros(len(x), np.int64)
        return _result(group, asked, *top(np.stack(asked["vec"].to_numpy()), asked["row"].to_numpy(), x, group["row"].to_numpy(), q, none, np.zeros(x.shape, np.uint8), k, len(x)))

    return rows.withColumn("ask", is_query).groupBy("dim").applyInPandas(meet, _FOUND)


def _space(rows: DataFrame, dim: int, n: int, n_queries: int, is_query: Column, k: int, sample: int, share: float, block: int, query_block: int) -> DataFrame:
    """The search in one space: fit, index (written once), prune cells by their score bound, scan, rerank."""
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    x = _matrix(chosen, dim)
    floor_rows = x[:4096]
    q = fit(x, centres=max(1, min(64, len(x) // 40)))
    schema = "row long, vec_id long, vec array<double>, cell int, reach double, codes binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("vec"), dim)
            at, codes = q.encode(v) if len(v) else (np.zeros(0, np.int64), np.zeros((0, q.books.shape[0]), np.uint8))
            reach = np.linalg.norm(v - q.centres[at], axis=1)
            held = pa.array([c.tobytes() for c in packed(codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "vec")), pa.array(at.astype(np.int32)), pa.array(reach), held], ["row", "vec_id", "vec", "cell", "reach", "codes"])

    index = cut(rows.mapInArrow(encode, schema), "index")
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).orderBy("cell").toArrow().to_pydict()
    # Cells go into blocks of at most `block` rows; a larger cell is dealt over blocks of its own.
    first, parts, bounds, fill = {}, {}, [], block
    for cell, size, reach in zip(cells["cell"], cells["n"], cells["reach"], strict=True):
        parts[cell] = -(-size // block)
        if fill + size > block:
            bounds += [[] for _ in range(parts[cell])]
            fill = 0
        first[cell] = len(bounds) - parts[cell]
        fill += size
        for b in range(first[cell], first[cell] + parts[cell]):
            bounds[b].append((cell, reach))
    deal = np.zeros((len(q.centres), 2), np.int64)
    for cell in parts:
        deal[cell] = first[cell], parts[cell]
    starts, counts = (F.array(*[F.lit(int(v)) for v in c]) for c in deal.T)
    held = index.withColumn("b", (F.element_at(starts, F.col("cell") + 1) + F.pmod(F.xxhash64("row"), F.element_at(counts, F.col("cell") + 1))).cast("int"))
    query_blocks = -(-n_queries // query_block)
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes to the blocks with a cell that can hold a better row than the k-th of the sample: no row of a cell has
        a larger product than its centre's plus the query's length times the cell's reach, so none is lost."""
        for batch in batches:
            y = _matrix(batch.column("vec"), dim)
            for a in range(0, len(y), 1024):
                part = y[a : a + 1024]
                to_sample = part @ floor_rows.T
                # The query itself may be in the sample: one more row is asked for.
                floor = np.partition(to_sample, -(k + 1), axis=1)[:, -(k + 1)] if len(floor_rows) > k else np.full(len(part), -np.inf)
                centre, length = part @ q.centres.T, np.linalg.norm(part, axis=1)
                reached = np.stack([np.max([centre[:, c] + length * r for c, r in own], axis=0) for own in bounds], 1)
                who, b = np.nonzero(reached >= floor[:, None] - 1e-9 * (1 + np.abs(floor[:, None])))
                at = pa.array(a + who)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("row", "vec_id", "vec")), pa.array(b.astype(np.int32))], ["row", "vec_id", "vec", "b"])

    asked = rows.where(is_query).mapInArrow(ask, "row long, vec_id long, vec array<double>, b int").withColumn("qb", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(query_blocks)).cast("int"))
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "row", "vec_id")} | {"score": np.zeros(0)})
        left = left.sort_values(["vec_id", "row"])
        v, y = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        codes = unpacked(np.frombuffer(b"".join(left["codes"]), np.uint8).reshape(len(left), -1), q.books.shape[0])
        own, ids = right["row"].to_numpy(), left["row"].to_numpy()
        return _result(left, right, *top(y, own, v, ids, q, left["cell"].to_numpy(), codes, k, max(5 * k, int(share * len(left)))))

    return held.groupBy("qb", "b").cogroup(asked.groupBy("qb", "b")).applyInPandas(meet, _FOUND)
