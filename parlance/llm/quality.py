"""Quality rules: document statistics, a base rule, and gradient-boosted trees flattened into numpy arrays.

The trees are trained here, on a sample of at most `max_labels` labelled documents (a bound, whatever the corpus), with
monotonic constraints: more symbols, repeated lines or repeated windows can never raise a document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, utf8

_SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, each with the direction in which it may move the score (0: any).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols_per_char": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": -1, "distinct_share": 0, "words_per_line": 0, "bang_share": -1}


def statistics(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, FEATURES) of one whole text; a null or empty text has zeros."""
    if not text:
        return (0,) * len(COUNTS), (0.0,) * len(FEATURES)
    words = text.split()
    n = len(words)
    joined = b" ".join(words)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - (len(joined) - max(0, n - 1)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n > _WINDOW:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        windows = [joined[a:b] for a, b in zip(starts[: n - _WINDOW + 1].tolist(), ends[_WINDOW - 1 :].tolist(), strict=True)]
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + _WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover[:-1])))
    size = max(1, len(joined))
    upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    marks = len(joined) - len(joined.translate(None, b"!?;:=+~^_@\\/{}[]()\"" + _SYMBOLS))
    features = (np.log1p(n), chars / max(1, n), symbols / max(1, chars), dup_lines / max(1, len(lines)), repeated / max(1, n), upper / size, digits / size, marks / size, len(set(words)) / max(1, n), n / max(1, len(lines)), joined.count(b"!") / max(1, n))
    return (n, chars, symbols, dup_lines, repeated), features


@dataclass
class Trees:
    """Trees in flat arrays: node i splits `feature[i]` at `threshold[i]` to `left[i]`/`right[i]`; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0) -> Trees:
    """Boost regression trees on the logistic loss; a split that breaks a constraint is not taken, and the leaves below a
    constrained split stay on their side of its middle."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    rate_ok = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate_ok / (1 - rate_ok)))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-total_g / (total_h + l2), low, high))
        nodes.append([0, np.inf, me, me, leaf * rate])
        best = (1e-3, None)
        if left and len(rows) >= 20:
            for f in range(x.shape[1]):
                k = len(cuts[f])
                if not k:
                    continue
                cg = np.cumsum(np.bincount(codes[rows, f], g[rows], k + 1))[:-1]
                ch = np.cumsum(np.bincount(codes[rows, f], h[rows], k + 1))[:-1]
                lw, rw = np.clip(-cg / (ch + l2), low, high), np.clip(-(total_g - cg) / (total_h - ch + l2), low, high)
                gain = cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - total_g**2 / (total_h + l2)
                ok = (ch > 1) & (total_h - ch > 1)
                if monotone[f]:
                    ok &= (rw - lw) * monotone[f] >= 0
                gain = np.where(ok, gain, -1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (f, j, lw[j], rw[j]))
        if best[1]:
            f, j, lw, rw = best[1]
            mask = codes[rows, f] <= j
            middle = (lw + rw) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[f]]
            a = grow(rows[mask], g, h, left - 1, *bounds[0])
            b = grow(rows[~mask], g, h, left - 1, *bounds[1])
            nodes[me] = [f, cuts[f][j], a, b, 0.0]
        return me

    def flat() -> Trees:
        c = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
        return Trees(np.array(c[0], np.int64), np.array(c[1], float), np.array(c[2], np.int64), np.array(c[3], np.int64), np.array(c[4], float), np.array(roots, np.int64), depth, bias)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        begin = len(nodes)
        roots.append(grow(np.arange(len(y)), g, h, depth, -4.0, 4.0))
        one = flat()
        margin += Trees(one.feature, one.threshold, one.left, one.right, one.value, np.array([begin]), depth, 0.0).score(x)
    return flat()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 12_000) -> Trees | None:
    """Train on at most `max_labels` labelled documents, chosen by a hash of the id; None if the chosen ones do not hold both classes.

    The chosen ids are broadcast (the parameter bounds them) and filter the documents where they are read. An id with
    several labels counts as its lowest; nulls are left out.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [statistics(t)[1] for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return train(x, y, tuple(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """Statistics and verdict of every document, from its whole text.

    Returns doc_id, COUNTS, base_failed, kept, score; with `keep_columns` all columns of `docs` and these, where a name
    of `docs` stays and the clashing new one gets a leading underscore. A null text has no words, so it fails the base
    rule; null ids and repeated rows pass through; an empty table gives no rows. Without a model the base rule decides.
    """
    limit = float(np.log(threshold / (1 - threshold)))
    source = docs if keep_columns else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text_at = text_col if keep_columns else "text"
    held = docs.columns if keep_columns else ["doc_id"]
    new = [*COUNTS, "base_failed", "kept", "score"]
    if keep_columns:
        new = fresh(docs, *new)
    schema = source.select(*[F.col(f"`{c}`") for c in held]).schema
    for name in new[:5]:
        schema = schema.add(name, "long")
    schema = schema.add(new[5], "boolean").add(new[6], "boolean").add(new[7], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            found = [statistics(t) for t in utf8(batch.column(text_at))]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])
            score = model.score(x) if model else np.zeros(len(x))
            kept = ~failed & ((score >= limit) if model else True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *(pa.array(c) for c in counts.T.copy()), pa.array(failed), pa.array(kept), pa.array(score)], schema.names)

    return source.mapInArrow(run, schema)
