"""Best-fit packing of token sequences by minimum bin slack over a histogram of lengths.

Only a table of lengths (at most `capacity` rows, whatever the corpus) reaches the driver. There, bin after bin, a
bitset dynamic programme over the available lengths finds the fullest combination, which is removed; a combination is
taken as often as the counts allow at once. Pieces find their bins by their rank among the pieces of equal length.
Ranks come from counts per (bucket, length), so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within `capacity`.

    reach[i] has bit s set if the first i lengths, from the longest, can sum to s; lengths are added until `capacity` itself
    is reached or none is left. The walk back takes as few of the last, shortest lengths as it can, so of equally full
    combinations one with long lengths is taken and short ones remain to fill later bins.
    """
    lengths = sorted((length for length, n in counts.items() if n and length <= capacity), reverse=True)
    full = (1 << (capacity + 1)) - 1
    reach = [1]
    for length in lengths:
        bits, left, step = reach[-1], min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (take * length)) & full
            left -= take
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    total = reach[-1].bit_length() - 1
    out = {}
    for i in range(len(reach) - 2, -1, -1):
        if not total:
            break
        k = 0
        while not (reach[i] >> (total - k * lengths[i])) & 1:
            k += 1
        if k:
            out[lengths[i]] = k
            total -= k * lengths[i]
    return out


def seeded(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of those that hold the longest available length."""
    top = max(length for length, n in counts.items() if n)
    out = fullest(counts | {top: counts[top] - 1}, capacity - top)
    out[top] = out.get(top, 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of bins with it), until no length is left: always the fullest combination, or always the fullest
    that holds the longest length, which may leave fewer long lengths for the end; whichever needs fewer bins."""

    def filled(choose: Callable[[dict[int, int], int], dict[int, int]]) -> list[tuple[dict[int, int], int]]:
        counts = {length: n for length, n in histogram.items() if n}
        out = []
        while counts:
            combination = choose(counts, capacity)
            times = min(counts[length] // k for length, k in combination.items())
            out.append((combination, times))
            for length, k in combination.items():
                counts[length] -= k * times
                if not counts[length]:
                    del counts[length]
        return out

    return min((filled(fullest), filled(seeded)), key=lambda bins: sum(times for _, times in bins))


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[list[int], list[int], list[int], list[int]]]:
    """Per length: first rank of each run of slots, slots per bin, first bin, offset of the first slot in the bin."""
    out: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
    ranks: dict[int, int] = {}
    bins = 0
    for combination, times in patterns:
        offset = 0
        for length in sorted(combination, reverse=True):
            k = combination[length]
            run = out.setdefault(length, ([], [], [], []))
            for column, value in zip(run, (ranks.get(length, 0), k, bins, offset), strict=True):
                column.append(value)
            ranks[length] = ranks.get(length, 0) + k * times
            offset += k * length
        bins += times
    return out


_ALONE = re.compile(r"\S+(?:\n\S+)*").fullmatch
_TAILED = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


_WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


#: Classes of bytes: white space, letters, digits, the lead byte of U+00C0 to U+00FF, what follows it, and bytes that tell no
#: class by themselves; all else is a sign.
SPACE, LETTER, DIGIT, SIGN, LEAD, FOLLOW, OTHER = range(7)
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[0x80:0xC0] = FOLLOW
_CLASS[0xC0:] = OTHER
_CLASS[0xC3] = LEAD
_TIMES, _DIVIDED = 0x97, 0xB7  # the two signs among them


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large string column, and where its texts begin and end in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a letter or sign from U+00C0 to U+00FF have the character's."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(kind == LEAD)
    if len(lead):
        second = raw[lead + 1]
        own = np.where((second == _TIMES) | (second == _DIVIDED), SIGN, LETTER).astype(np.uint8)
        kind[lead], kind[lead + 1] = own, own
    return kind


def plainly(column: pa.Array) -> np.ndarray:
    """Whether a text's bytes tell its pre-tokens: ASCII and U+00C0 to U+00FF alone."""
    raw, offsets = _bytes(column)
    bad = np.flatnonzero(_classes(raw) > SIGN)
    return np.diff(np.searchsorted(bad, offsets)) == 0 if len(bad) else np.ones(len(column), bool)


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts begin, as the byte-level pattern has them: a contraction after an apostrophe that
    begins a pre-token; runs of letters, of digits, and of signs, each with one space before it; of a run of white space before
    something else, all but its last character, and that one unless it is a space; white space at the end of a text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes(raw)
    begin = np.zeros(n + 1, bool)
    begin[offsets[:-1]] = True
    space = kind == SPACE
    after = np.zeros(n, bool)  # white space before, in the same text
    after[1:] = space[:-1]
    after &= ~begin[:n]
    start = begin[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A space goes with what follows it.
    joined = np.flatnonzero(after & ~space)
    start[joined] = raw[joined - 1] != 32
    start[joined - 1] = True
    quote = np.flatnonzero(raw[:-1] == 39)
    if len(quote):
        quote = quote[start[quote] & ~begin[quote + 1]]
        one = raw[quote + 1]
        two = raw[np.minimum(quote + 2, n - 1)]
        inside = (quote + 2 < n) & ~begin[np.minimum(quote + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        for at in (quote[short] + 2, quote[long] + 3):
            start[at[at < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Token ids of texts by a `tokenizers` file, with a bounded memo of the pieces of texts.

    A byte-level pre-tokenizer always breaks before a single space or line end between two visible characters, after that
    line end, and between letters and punctuation (but apostrophes). So a text is put together from space-free chunks,
    chunks from lines, lines from letters and a tail, and the library encodes each distinct part once. A chunk that is
    empty or holds other white space has no ids of its own: its text is encoded as a whole, as are texts with special tokens.
    """

    def __init__(self, path: str, memo: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), memo
        # Words alone are one pre-token each, and each is asked for once: no pattern and no cache are needed for them.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        model = self.words.model
        model._resize_cache(0)
        self.words.model = model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of parts at a text's or line's start, and of parts after a space.
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.line_end = self._ids(["\n"])[0]
        #: Ids of whole pre-tokens, with the space before them: those met of late, and those met before; what is met again stays.
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str], words: bool = False) -> list[bytes]:
        tokenizer = self.words if words else self.tokenizer
        found = (e.ids for at in range(0, len(texts), 20_000) for e in tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False))
        return [array("I", ids).tobytes() for ids in found]

    def _trim(self, memo: dict[str, bytes | None], wanted: set[str]) -> None:
        """Make room; short parts come again soonest."""
        if len(memo) + len(wanted) > self.most:
            for part in [p for p in memo if len(p) > 7 and p not in wanted]:
                del memo[part]
            if len(memo) > self.most // 2:
                for part in [p for p in memo if p not in wanted]:
                    del memo[part]

    def _fill(self, first: set[str], later: set[str]) -> None:
        self._trim(self.first, first)
        self._trim(self.later, later)
        lines: list[tuple[dict, str, list[str]]] = []
        tails: list[tuple[dict, str, str, str]] = []
        plain: dict[int, set[str]] = {id(self.first): set(), id(self.later): set()}

        def one_line(memo: dict[str, bytes | None], part: str) -> None:
            m = _TAILED(part)
            if m:
                head, tail = m.groups()
                tails.append((memo, part, head, tail))
                if head not in memo:
                    plain[id(memo)].add(head)
                if tail not in self.first:
                    plain[id(self.first)].add(tail)
            else:
                plain[id(memo)].add(part)

        for memo, wanted in ((self.first, first), (self.later, later)):
            new = plain[id(memo)]
            for part in wanted.difference(memo):
                if part.isalpha():
                    new.add(part)
                elif "\n" not in part:
                    if _ALONE(part):
                        one_line(memo, part)
                    else:
                        memo[part] = None
                elif _ALONE(part):
                    split = part.split("\n")
                    lines.append((memo, part, split))
                    for own, piece in ((memo, split[0]), *((self.first, p) for p in split[1:])):
                        if piece not in own:
                            one_line(own, piece)
                else:
                    memo[part] = None
        for memo, lead in ((self.first, ""), (self.later, " ")):
            words = [p for p in plain[id(memo)] if _WORD(p)]
            others = list(plain[id(memo)].difference(words))
            memo.update(zip(words, self._ids([lead + p for p in words], True), strict=True))
            memo.update(zip(others, self._ids([lead + p for p in others]), strict=True))
        for memo, part, head, tail in tails:
            memo[part] = memo[head] + self.first[tail]
        for memo, part, split in lines:
            memo[part] = self.line_end.join([memo[split[0]], *[self.first[p] for p in split[1:]]])

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text: by pre-tokens where bytes tell them, else by chunks."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        plain = plainly(column)
        for special in self.special:
            plain &= ~pa.compute.match_substring(column, special).to_numpy(zero_copy_only=False)
        out = self._by_pieces(column.filter(pa.array(plain)))
        if not plain.all():
            rest = iter(self._by_chunks(column.filter(pa.array(~plain))))
            done = iter(out)
            out = [next(done) if p else next(rest) for p in plain.tolist()]
        return out

    def _by_pieces(self, column: pa.Array) -> list[bytes]:
        """Every distinct pre-token of a batch is looked up once, and the library encodes those not seen before."""
        raw, offsets = _bytes(column)
        starts = piece_starts(raw, offsets)
        ends = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.pieces.get, distinct))
        new = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self.older.get(distinct[i])
            if found[i] is None:
                new.append(i)
            else:
                self.pieces[distinct[i]] = found[i]
        if new:
            for i, ids in zip(new, self._ids([distinct[i].decode() for i in new], True), strict=True):
                found[i] = self.pieces[distinct[i]] = ids
        if len(self.pieces) > self.most // 2:
            self.pieces, self.older = {}, self.pieces
        gathered = pa.array(found, pa.large_binary()).take(coded.indices)
        bounds = np.frombuffer(gathered.buffers()[1], np.int64)[np.searchsorted(starts, offsets)].tolist() if len(starts) else [0] * len(offsets)
        ids = memoryview(gathered.buffers()[2] or b"")
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _by_chunks(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Chunks are told apart and ids gathered outside Python."""
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lists = pa.compute.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy()
        chunks = lists.flatten()
        coded = chunks.dictionary_encode()
        distinct, heads = coded.dictionary.to_pylist(), chunks.take(pa.array(offsets[:-1])).to_pylist()
        self._fill(set(heads), set(distinct))
        parts = [*map(self.later.__getitem__, distinct), *map(self.first.__getitem__, heads)]
        which = coded.indices.to_numpy().astype(np.int64)
        which[offsets[:-1]] = len(distinct) + np.arange(len(heads))
        alone = np.fromiter((p is not None for p in parts), bool, len(parts))
        size = np.fromiter((len(p) // 4 if p else 0 for p in parts), np.int64, len(parts))
        every = np.frombuffer(b"".join(p or b"" for p in parts), np.uint32)
        length = size[which]
        end = np.cumsum(length)
        ids = every[np.repeat((np.cumsum(size) - size)[which] - (end - length), length) + np.arange(int(length.sum()))].astype("<u4")
        bounds = np.concatenate([[0], end])[offsets]
        whole = np.logical_or.reduceat(~alone[which], offsets[:-1]) if len(column) else np.zeros(0, bool)
        for special in self.special:
            whole |= pa.compute.match_substring(column, special).to_numpy(zero_copy_only=False)
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.frombuffer(self._ids([column[i].as_py()])[0], np.uint32).astype("<u4").tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}
_PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids and `end_id`, cut to `capacity` if longer; the first may be short."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    ends = int(end_id).to_bytes(4, "little")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_PIECES}" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        for batch in slices(batches, "text", 2_000_000):
            rows: list[tuple] = []
            for d, ids in enumerate(_ENCODERS[tokenizer].encode(pa.compute.fill_null(batch.column("text"), ""))):
                ids += ends
                n = len(ids) // 4
                at, piece, size = 0, 0, n % capacity or capacity
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((d, piece, at, size, zlib.crc32(part), part))
                    at, piece, size = at + size, piece + 1, capacity
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            out = [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`, little-endian, if asked for). A
    null or empty text is one piece of `end_id` alone; a null id stays null; repeated rows are separate documents; an
    empty table gives no rows. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    cutting = pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)
    # Rows alike in id and ids are told apart by their place, so that no bucket gathers them.
    table = cut(cutting.withColumn("salt", F.monotonically_increasing_id() % 65_537), "pieces")
    n_buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt"), F.lit(n_buckets)).cast("int"))
    per = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots(plan(histogram, capacity))
    tables = {length: tuple(np.asarray(c, np.int64) for c in run) for length, run in runs.items()}
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32", "salt")).cast("long"))
    placed = ranked.join(before, ["length", "bucket"]).select(*cols, (F.col("before") + F.col("rank") - 1).alias("rank"))
    schema = placed.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                first, k, bins, at = tables[size]
                j = np.searchsorted(first, rank[rows], "right") - 1
                inside = rank[rows] - first[j]
                sequence[rows] = bins[j] + inside // k[j]
                offset[rows] = at[j] + inside % k[j] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(sequence), pa.array(offset)], [*cols, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema)
