"""Exact substring deduplication on words: compressed FM-index shards over wavelet trees, searched backwards.

A window is `window` consecutive words. Each window is dealt to a shard by its minimizer (the least hash among its
k-grams), so equal windows always meet, wherever they stand; to stream every document through every shard would be quadratic,
so a document is streamed as its runs of windows with one minimizer, each to the one shard that can match it. Runs whose
minimizer is met once in the whole corpus cannot repeat and are not shipped; equal runs, told by a cryptographic hash of their
words, are shipped once with their number. A shard concatenates its runs' words and builds an index: a BWT in a wavelet tree
of Huffman shape with rank counters of a quarter of its bits, and beside it, while the shard is searched, the common prefixes
of neighbouring suffixes. Its runs are streamed backwards, all at once, and carry the length of their match from word to word: matching
statistics, with a match shortened at its far end by the common prefixes where it cannot grow. Words where the longest match
met twice or more reaches the threshold are reported as intervals. A minimizer with more than `hot_runs` different runs is
dealt once more, window by window, by the hash of the whole window, after equal windows are counted together. A shard too
large for one index is cut into blocks, and its runs stream through the index of each, so memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, join_sized, slices, utf8
from .textvec import Words

#: Words in a minimizer's k-gram, windows in a run at most, and words in one index at most.
GRAM, RUN, INDEX_WORDS = 9, 30, 600_000
#: A bitmap has sixteen bits for each key up to 2**MOST_BITS bits (32 MB); beyond, it lets more keys pass, and joins decide.
MOST_BITS = 28
MOST_KEYS = 500_000


class WaveletTree:
    """Rank of any symbol in a sequence: the bits of its Huffman codes by node, level after level, in one bit vector.

    Ranks are counted by 16 bits for each 64 bits, from 32 bits for each 65,536.
    """

    def __init__(self, sequence: np.ndarray, size: int):
        counts = np.bincount(sequence, minlength=size)
        self.count = counts
        present = np.flatnonzero(counts)
        by_count = present[np.argsort(counts[present], kind="stable")]
        # Two queues: leaves by count, and inner nodes, which are made in order of theirs.
        weight, n = counts[by_count].tolist(), len(by_count)
        pairs: list[tuple[int, int]] = []
        leaf, inner = 0, n
        for made in range(n, 2 * n - 1):
            two = []
            for _ in range(2):
                if leaf < n and (inner >= made or weight[leaf] <= weight[inner]):
                    two.append(leaf)
                    leaf += 1
                else:
                    two.append(inner)
                    inner += 1
            pairs.append((two[0], two[1]))
            weight.append(weight[two[0]] + weight[two[1]])
        # Inner nodes from the root down, level by level, and in each level in order of their parents.
        self.code, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.child = np.full((2, max(1, n - 1)), -1, np.int64)
        below, sizes = np.array(pairs, np.int64).reshape(-1, 2), np.array(weight, np.int64)
        level, code = (np.array([2 * n - 2]) if n > 1 else np.zeros(0, np.int64)), np.zeros(1, np.int64)
        starts, depth, number = [], 0, 0
        while len(level):
            starts.append(sizes[level])
            subs, codes = below[level - n], np.stack([code, code | 1 << depth], 1)
            leaf = subs < n
            self.code[by_count[subs[leaf]]], self.length[by_count[subs[leaf]]] = codes[leaf], depth + 1
            place = np.full(subs.shape, -1)
            place[~leaf] = number + len(level) + np.arange(np.count_nonzero(~leaf))
            self.child[:, number : number + len(level)] = place.T
            number += len(level)
            level, code, depth = subs[~leaf], codes[~leaf], depth + 1
        starts = np.concatenate([[0], np.cumsum(np.concatenate(starts))]) if starts else np.zeros(1, np.int64)
        total = int(starts[-1])
        self.start = starts
        bits = np.zeros(total, bool)
        symbols, node = sequence, np.zeros(len(sequence) if n > 1 else 0, np.int64)
        depth = 0
        while len(node):
            at = np.arange(len(node)) + int(self.start[node[0]])
            b = (self.code[symbols] >> depth & 1).astype(bool)
            bits[at] = b
            ones = np.cumsum(b) - b
            within = ones - ones[self.start[node] - self.start[node[0]]]
            place = np.where(b, within, at - self.start[node] - within)
            node = self.child[b.astype(np.int64), node]
            on = node >= 0
            symbols, node, place = symbols[on], node[on], place[on]
            if not len(node):
                break
            to = self.start[node] + place
            to -= int(to.min())
            moved_s, moved_n = np.empty_like(symbols), np.empty_like(node)
            moved_s[to], moved_n[to] = symbols, node
            symbols, node, depth = moved_s, moved_n, depth + 1
        self.bits = np.packbits(np.concatenate([bits, np.zeros(-total % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        below_cell = np.cumsum(np.bitwise_count(self.bits).astype(np.int64))
        below_cell = np.concatenate([[0], below_cell])[: len(self.bits)]
        self.far = below_cell[::1024].astype(np.uint32)
        self.near = (below_cell - np.repeat(below_cell[::1024], 1024)[: len(below_cell)]).astype(np.uint16)
        self.ones = self._ones(self.start)

    def _ones(self, at: np.ndarray) -> np.ndarray:
        cell = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.far[cell >> 10].astype(np.int64) + self.near[cell] + np.bitwise_count(self.bits[cell] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place; 0 for one that is not in the sequence."""
        out = np.where(self.count[symbol] > 0, at, 0)
        live = np.flatnonzero((self.length[symbol] > 0) & (out > 0))
        code, node = self.code[symbol[live]], np.zeros(len(live), np.int64)
        while len(live):
            here = out[live]
            ones = self._ones(self.start[node] + here) - self.ones[node]
            bit = code & 1
            out[live] = np.where(bit == 1, ones, here - ones)
            node = self.child[bit, node]
            on = node >= 0
            live, code, node = live[on], code[on] >> 1, node[on]
        return out


class FMIndex:
    """Occurrences of word sequences in a list of texts; texts are sequences of ids from 1, each with a weight."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int):
        n_texts, n = len(lengths), len(ids) + len(lengths)
        at = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        word = np.ones(n, bool)
        word[at] = False
        text[word] = ids
        rank = text + n_texts - 1
        rank[at] = np.arange(n_texts)
        order, k = np.argsort(rank, kind="stable"), 1
        while True:
            second = np.zeros(n, np.int64)
            second[: max(0, n - k)] = rank[k:] + 1
            key = rank * (n + n_texts + int(ids.max(initial=0)) + 2) + second
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank, k = new, 2 * k
            if not n or rank[order[-1]] == n - 1:
                break
        del second, key, ranked, new, rank
        self.n, self.window = n, window
        # Weights above one are rare: a bit for each place that has one, and sums over those alone.
        more = np.repeat(weights - 1, lengths + 1)[order]
        self.heavy = np.concatenate([[0], np.cumsum(more > 0)]).astype(np.uint32)
        self.extra = np.concatenate([[0], np.cumsum(more[more > 0])])
        size = int(ids.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletTree(text[order - 1], size)
        # Words that neighbouring suffixes share, up to a window; 0 at both ends.
        self.shared = np.zeros(n + 1, np.uint8)
        a, b, where = order[:-1], order[1:], np.arange(1, n)
        for t in range(window):
            same = (text[a] == text[b]) & (text[a] > 0)
            a, b, where = a[same], b[same], where[same]
            if not len(where):
                break
            self.shared[where] = t + 1
            inside = (a + 1 < n) & (b + 1 < n)
            a, b, where = a[inside] + 1, b[inside] + 1, where[inside]
        # For each place the nearest one before and after it whose neighbours share fewer words.
        self.before, self.after = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        places = np.arange(n + 1, dtype=np.int32)
        for depth in np.unique(self.shared)[1:].tolist():
            here = np.flatnonzero(self.shared == depth)
            less = self.shared < depth
            self.before[here] = np.maximum.accumulate(np.where(less, places, 0))[here]
            self.after[here] = np.minimum.accumulate(np.where(less, places, n)[::-1])[::-1][here]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high - low + self.extra[self.heavy[high]] - self.extra[self.heavy[low]]

    def _shorten(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that share `depth` words with those of each interval, where no bound of it shares more."""
        return np.where(self.shared[low] >= depth, self.before[low], low), np.where(self.shared[high] >= depth, self.after[high], high)

    def statistics(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, wanted: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: at each word of each text the length of the longest sequence from there on, within the text
        and up to a window, that is met at least `least` times, and how often it is met. Texts are read backwards; one is left,
        with zeros for the rest, once no sequence of `wanted` words can fit before the end of its match."""
        out, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        low, high, depth = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        on = np.arange(len(starts))
        for back in range(int(lengths.max(initial=0))):
            on = on[lengths[on] > back]
            place = starts[on] + lengths[on] - 1 - back
            symbol = ids[place]
            known = symbol < len(self.tree.count)
            lost = on[~known]
            low[lost], high[lost], depth[lost] = 0, self.n, 0
            todo, symbol = on[known], symbol[known]
            full = todo[depth[todo] == self.window]
            if len(full):
                depth[full] -= 1
                low[full], high[full] = self._shorten(low[full], high[full], depth[full])
            while len(todo):
                both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[todo], high[todo]])).reshape(2, -1) + self.first[symbol]
                found = self.weight(both[0], both[1]) >= least
                grown = todo[found]
                low[grown], high[grown] = both[0][found], both[1][found]
                depth[grown] += 1
                todo, symbol = todo[~found], symbol[~found]
                some = depth[todo] > 0
                todo, symbol = todo[some], symbol[some]
                if len(todo):
                    depth[todo] = np.maximum(self.shared[low[todo]], self.shared[high[todo]])
                    low[todo], high[todo] = self._shorten(low[todo], high[todo], depth[todo])
            out[place] = depth[on]
            met[place] = self.weight(low[on], high[on])
            on = on[lengths[on] - 1 - back + depth[on] >= wanted]
        return out, met


def repeated(texts: list[bytes], counts: np.ndarray, window: int, most: int = INDEX_WORDS) -> list[int]:
    """For each run of words a mask of those of its windows that occur twice or more in all runs, counts included."""
    split = pa.compute.split_pattern(pa.array(texts, pa.binary()), b" ")
    starts = split.offsets.to_numpy().astype(np.int64)
    starts, lengths = starts[:-1], np.diff(starts)
    ids = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    del split
    blocks = np.searchsorted(np.cumsum(lengths), np.arange(most, int(lengths.sum()) + most, most), "left") + 1
    bounds = np.unique(np.concatenate([[0], np.minimum(blocks, len(lengths))]))
    least = 2 if len(bounds) == 2 else 1  # of several blocks, each adds its own occurrences
    total = np.zeros(len(ids), np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        index = FMIndex(ids[starts[a] : starts[b - 1] + lengths[b - 1]], lengths[a:b], counts[a:b], window)
        depth, met = index.statistics(ids, starts, lengths, least, window)
        total += np.where(depth >= window, met, 0)
    run = np.repeat(np.arange(len(texts)), lengths)
    masks = np.zeros(len(texts), np.int64)
    hit = np.flatnonzero(total >= 2)
    np.bitwise_or.at(masks, run[hit], np.int64(1) << (hit - starts[run[hit]]))
    return masks.tolist()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def runs_of(words: Words, window: int, gram: int = GRAM, count: bool = False) -> dict[str, np.ndarray]:
    """Runs of consecutive windows with one minimizer: its hash, text, first word in all texts and in its own, windows.

    With `count` instead of the content how often the minimizer stands in the run: twice in a text that repeats itself.
    """
    n, gram = len(words), min(gram, window)
    none = {k: np.zeros(0, np.int64) for k in ("mini", "text", "at", "start", "windows", "times")}
    if n < window:
        return none
    at = np.arange(n - gram + 1)
    grams = words.runs(at, at + gram)
    least = _sliding_min(grams, window - gram + 1)
    valid = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])
    if not len(valid):
        return none
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (least[valid[1:]] != least[valid[:-1]])
    first = np.flatnonzero(new)
    since = np.arange(len(valid)) - np.repeat(first, np.diff(np.append(first, len(valid))))
    new |= since % RUN == 0
    first = np.flatnonzero(new)
    start, windows = valid[first], np.diff(np.append(first, len(valid)))
    if count:
        span = windows + window - gram
        begin = np.cumsum(span) - span
        place = np.arange(int(span.sum())) - np.repeat(begin - start, span)
        times = np.add.reduceat((grams[place] == np.repeat(least[start], span)).astype(np.int64), begin)
        return {"mini": least[start].view(np.int64), "times": times}
    text = words.text[start]
    return {"mini": least[start].view(np.int64), "text": text, "at": start, "start": start - words.first[text], "windows": windows}


def keys(content: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Two longs of a cryptographic hash of each sequence of words: no two sequences that could be written share them."""
    both = np.frombuffer(b"".join([blake2b(c, digest_size=16).digest() for c in content]), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


class Bits:
    """A bitmap over hashes, sixteen bits and two places for each of `n` of them within MOST_BITS: a hash with a clear place
    is not there, and one that is not there has both set in about one case of seventy.

    The places are the two lowest runs of MOST_BITS bits, since the highest bits of minimizers are mostly zero.
    """

    def __init__(self, hashes: DataFrame, n: int):
        bits = min(MOST_BITS, max(12, (16 * n).bit_length()))
        self.mask = (1 << bits) - 1
        self.sharp = 16 * n <= 1 << bits
        places = hashes.toDF("h").select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(self.mask)), F.shiftrightunsigned("h", MOST_BITS).bitwiseAND(F.lit(self.mask)))).alias("place"))
        cells = places.groupBy(F.expr("shiftright(place, 6)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 AS INT)))").alias("bits"))
        rows = cells.toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.words = hashes.sparkSession.sparkContext.broadcast(words)

    def have(self, hashes: np.ndarray) -> np.ndarray:
        words, h = self.words.value, hashes.view(np.uint64)
        out = np.ones(len(h), bool)
        for place in (h & np.uint64(self.mask), h >> np.uint64(MOST_BITS) & np.uint64(self.mask)):
            out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def _parted(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose h is among the keys, the other rows) by broadcasts of at most MOST_KEYS numbers; beyond that (all rows,
    None), and the join that follows decides."""
    if keys.count() > MOST_KEYS:
        return docs, None
    side = F.broadcast(keys.select("h").distinct())
    return docs.join(side, "h", "left_semi"), docs.join(side, "h", "left_anti")


def repeats(docs: DataFrame, window: int = 35, hot_runs: int = 1_000) -> DataFrame:
    """Spans of repeated windows: (h, doc_id, sum, spans) with spans a list of (start word, mask), for a table
    (h, doc_id, sum, text).

    `sum` is a hash of the text and `h` one of both, so rows that share an id are told apart unless they are alike, when they
    share spans.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def minis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            r = runs_of(Words(utf8(batch.column("text"))), window, count=True)
            found, at = np.unique(r["mini"], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, r["times"], len(found)).astype(np.int64))], ["mini", "n"])

    twice = cut(docs.select("text").mapInArrow(minis, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1").select("mini"), "minimizers")
    known = Bits(twice, twice.count())

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            words = Words(utf8(batch.column("text")))
            r = runs_of(words, window)
            on = known.have(r["mini"])
            r = {k: v[on] for k, v in r.items()}
            content = [words.bytes_of(a, b) for a, b in zip(r["at"].tolist(), (r["at"] + r["windows"] + window - 1).tolist(), strict=True)]
            text = pa.array(r["text"])
            own = [batch.column(c).take(text) for c in ("h", "doc_id", "sum")]
            yield pa.RecordBatch.from_arrays([pa.array(r["mini"]), *keys(content), *own, pa.array(r["start"].astype(np.int32)), pa.array(r["windows"].astype(np.int32))], ["mini", "k1", "k2", "h", "doc_id", "sum", "start", "windows"])

    found = docs.mapInArrow(shipped, f"mini long, k1 long, k2 long, h long, doc_id {id_type}, sum long, start int, windows int")
    found = cut(found if known.sharp else found.join(twice, "mini", "left_semi"), "runs")
    distinct = found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("h", "doc_id", "sum", "start", "windows", "mini")).alias("r")).select("k1", "k2", "n", "r.*")
    distinct = cut(distinct, "distinct")
    # A minimizer with very many different runs, as where a common passage begins and ends, would make one huge shard.
    hot = distinct.groupBy("mini").count().where(F.col("count") > hot_runs).select("mini", F.lit(True).alias("hot"))
    distinct = join_sized(distinct, hot, ["mini"]).withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = cut(distinct.groupBy("h", "doc_id", "sum").agg(F.collect_list(F.struct("mini", "k1", "k2", "n", "start", "windows", "hot")).alias("wanted")), "wanted")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            own = batch.column("wanted")
            text = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(own).to_numpy(zero_copy_only=False))
            rows = own.flatten()
            warm = rows.field("hot").to_numpy(zero_copy_only=False)
            words = Words(utf8(batch.column("text")), hashes=False)
            start = words.first[text] + rows.field("start").to_numpy()
            windows = rows.field("windows").to_numpy().astype(np.int64)
            cold, hot = np.flatnonzero(~warm), np.flatnonzero(warm)
            yield parts(rows, cold, words, start[cold], start[cold] + windows[cold] + window - 1, np.zeros(len(cold), np.int64), False)
            which = np.repeat(hot, windows[hot])
            place = np.arange(len(which)) - np.repeat(np.cumsum(windows[hot]) - windows[hot], windows[hot])
            yield parts(rows, which, words, start[which] + place, start[which] + place + window, place, True)

    def parts(rows: pa.Array, which: np.ndarray, words: Words, start: np.ndarray, end: np.ndarray, place: np.ndarray, part: bool) -> pa.RecordBatch:
        """Words start..end-1 of each chosen run; windows of hot runs get keys of their own, which also deal them."""
        content = [words.bytes_of(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        chosen = rows.take(pa.array(which))
        mini, k1, k2 = (chosen.field(k) for k in ("mini", "k1", "k2"))
        w1, w2 = keys(content) if part else (k1, k2)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), part)), w1 if part else mini, w1, w2, k1, k2, pa.array(place.astype(np.int32)), chosen.field("n"), pa.array(content, pa.binary())], ["part", "shard", "w1", "w2", "k1", "k2", "place", "n", "content"])

    # Only documents that hold a run's words are moved, and of rows alike in id and text one.
    holders, _ = _parted(docs, wanted)
    if not docs.groupBy("h").count().where("count > 1").isEmpty():
        holders = holders.groupBy("h", "doc_id", "sum").agg(F.first("text").alias("text"))
    same = (holders["h"] == wanted["h"]) & (holders["doc_id"].eqNullSafe(wanted["doc_id"])) & (holders["sum"] == wanted["sum"])
    content = holders.join(wanted, same).select(holders["text"], "wanted").mapInArrow(fetched, "part boolean, shard long, w1 long, w2 long, k1 long, k2 long, place int, n long, content binary")
    content = cut(content, "content")
    windows = content.where("part")
    cold = content.where("NOT part").select("part", "shard", "w1", "w2", "n", F.lit(1).cast("long").alias("rows"), "content")
    warm = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.first("content").alias("content")).select(F.lit(True).alias("part"), F.col("w1").alias("shard"), "w1", "w2", "n", "rows", "content")
    dealt = cold.unionByName(warm).repartition("part", "shard").sortWithinPartitions("part", "shard")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(rows: list[tuple]) -> pa.RecordBatch:
            masks = repeated([r[6] for r in rows], np.array([r[4] for r in rows], np.int64), window)
            kept = [(r[0], r[2], r[3], r[4], r[5], m) for r, m in zip(rows, masks, strict=True) if m]
            cols = list(zip(*kept, strict=True)) if kept else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["part", "w1", "w2", "n", "rows", "mask"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size > INDEX_WORDS // 2 and row[:2] != held[-1][:2]:
                    yield search(held)
                    held, size = [], 0
                held.append(row)
                size += row[6].count(b" ") + 1
        if held:
            yield search(held)

    hits = cut(dealt.mapInArrow(searched, "part boolean, w1 long, w2 long, n long, rows long, mask long"), "masks")
    of_runs = hits.where("NOT part").select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), "n", "mask")
    of_windows = join_hot(windows.select("w1", "w2", "k1", "k2", "place", "n"), hits.where("part").select("w1", "w2", "rows"), ["w1", "w2"], "rows", windows.count())
    of_windows = of_windows.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    spans = join_hot(found, of_runs.unionByName(of_windows), ["k1", "k2"], "n", found.count())
    return cut(spans.select("h", "doc_id", "sum", "start", "mask").distinct().groupBy("h", "doc_id", "sum").agg(F.collect_list(F.struct("start", "mask")).alias("spans")), "spans")


def covered(n_words: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words of a text its repeated windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for start, mask in spans:
        while mask:
            low = (mask & -mask).bit_length() - 1
            change[start + low] += 1
            change[start + low + window] -= 1
            mask &= mask - 1
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, hot_runs: int = 1_000) -> DataFrame:
    """Remove from every document the words covered by windows that also start elsewhere: doc_id, n_words, n_removed, kept
    (the other words joined by one space) and removed, a list of (start, end) word ranges.

    Null, empty and short texts lose nothing; null ids pass through; a repeated row is a repetition of each of its windows;
    an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select("doc_id", F.xxhash64("text").alias("sum"), "text").select(F.xxhash64("doc_id", "sum").alias("h"), "doc_id", "sum", "text")
    found = repeats(source, window, hot_runs)
    # Documents without a repeated window are not moved.
    mine, rest = _parted(source, found)
    same = (mine["h"] == found["h"]) & (mine["doc_id"].eqNullSafe(found["doc_id"])) & (mine["sum"] == found["sum"])
    joined = mine.join(found, same, "left").select(mine["doc_id"], "text", "spans")
    if rest is not None:
        joined = joined.unionByName(rest.select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans")))
    ids = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, n_words long, n_removed long, kept string, removed array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                if spans:
                    gone = covered(len(words), [(s["start"], s["mask"]) for s in spans], window)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    rows.append((len(words), len(words) - len(kept), b" ".join(kept), [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]))
                else:
                    rows.append((len(words), 0, b" ".join(words), []))
            cols = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], span)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return joined.mapInArrow(run, schema)
