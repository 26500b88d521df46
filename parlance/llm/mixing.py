"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the mixture over its share of the corpus. Every document draws its count of
copies by inverting that Poisson distribution at a number in [0, 1) hashed from its id, its text and a seed (a rate over MAX_RATE as
the sum of equal independent parts, each with a number of its own, so any weight is met), is exploded by its count, and the copies are dealt over all partitions by a hashed key and sorted by it, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_sized

SEED = 42
#: exp(-rate) must stay a normal double: a higher rate is drawn in parts of at most this one. The SQL stops here.
MAX_RATE = 500.0
_DIGITS = 13  # hex digits of a hash that make a number below 2**52, exact in a double


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) hashed from the parts; nulls hash like empty strings."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def cumulative(rate: Column) -> Column:
    """The probabilities of at most 0, 1, 2 ... at that rate, up to where no double below 1 lies beyond: twelve standard
    deviations."""

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        total = F.element_at(s["sums"], -1) + p
        return F.struct(p.alias("p"), F.concat(s["sums"], F.array(total)).alias("sums"))

    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.floor(rate + 12 * F.sqrt(rate) + 40).cast("int")), start, step)["sums"]


def inverse(sums: Column, u: Column) -> Column:
    """The least n whose cumulative probability exceeds u."""
    return F.size(F.filter(sums, lambda s: s <= u))


def copies(shares: Column, sums: Column, seed: int, *parts: Column | str) -> Column:
    """The Poisson count for the parts' hash: one draw, or the sum of the draws of equal shares of the rate."""
    draw = lambda i: uniform(F.lit(f"{seed}/part"), i.cast("string"), *parts)
    first = inverse(sums, uniform(F.lit(str(seed)), *parts))
    rest = F.aggregate(F.sequence(F.lit(1), shares - 1), F.lit(0), lambda n, i: n + inverse(sums, draw(i)))
    return F.when(shares > 1, first + rest).otherwise(first)


def rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, text_col: str, total: float) -> DataFrame:
    """(source, rate, shares, sums) over all documents: a source's rate is drawn in equal shares of at most MAX_RATE, each by
    the cumulative probabilities `sums`. Sizes are code points, one at least for each document."""
    size = F.greatest(F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), F.lit(1))
    sizes = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weight = F.sqrt("size")
    else:
        given = F.map_from_arrays(F.array(*[F.lit(k) for k in weights]), F.array(*[F.lit(float(v)) for v in weights.values()]))
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    # A row for each source, written once: the documents are read once for their sizes and once to be mixed.
    sizes = cut(sizes, "sizes")
    sums = sizes.agg(F.sum("weight"), F.sum("size")).first()
    weights_sum, sizes_sum = F.lit(float(sums[0] or 0.0)), F.lit(float(sums[1] or 0.0))
    rate = F.coalesce(F.try_divide(F.col("weight") * sizes_sum * F.lit(float(total)), weights_sum * F.col("size")), F.lit(0.0))
    out = sizes.select("source", rate.alias("rate")).withColumn("shares", F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE))).cast("int"))
    return cut(out.withColumn("sums", cumulative(F.col("rate") / F.col("shares"))), "rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shuffle: bool = True) -> DataFrame:
    """All columns of `docs` for each drawn copy, with copy (from 0), rate and shuffle_key, in order of the key within
    partitions.

    `weights` are the sources' target shares of the mixture (sources not named get none; None: in proportion to the square
    root of their size); `total` is the mixture's size as a multiple of the corpus. A null source is a source of its own,
    with weight under the key ""; mean rates have no bound. Null and empty texts count as one code point. A draw is keyed by id
    and text, so rows without an id or with a repeated one draw for themselves, and rows alike in both are repeated alike but
    still dealt over all partitions; an empty table gives no rows. New names that clash get a leading underscore.
    """
    spark = docs.sparkSession
    copy, rate_col, key_col = fresh(docs, "copy", "rate", "shuffle_key")
    side = rates(docs, weights, source_col, text_col, total).select(F.coalesce("source", F.lit("\0")).alias("__source"), F.col("rate").alias(rate_col), F.col("shares").alias("__shares"), F.col("sums").alias("__sums"))
    df = docs.withColumn("__source", F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\0")))
    df = join_sized(df, side, ["__source"], "inner").drop("__source")
    df = df.withColumn("__text", F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    own = (F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "__text")
    n = copies(F.col("__shares"), F.col("__sums"), seed, *own)
    # A list of n marks gives n rows, and none for 0; the count is worked out once.
    df = df.select("*", F.posexplode(F.array_repeat(F.lit(True), n)).alias(copy, "__mark")).drop("__shares", "__sums", "__mark")
    df = df.withColumn(key_col, (uniform(F.lit(f"{seed}/order"), *own, copy) * F.lit(float(16**_DIGITS))).cast("long"))
    if shuffle:
        # Rows alike share a key; their place in the input, which is the same in every attempt at a scan, parts them.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.withColumn("__at", F.monotonically_increasing_id() % 1009).repartition(parts, F.col(key_col), F.col(copy), F.col("__at")).sortWithinPartitions(key_col).drop("__at")
    return df.select(*[f"`{c}`" for c in docs.columns], copy, rate_col, key_col)


def oracle() -> str:
    """The same mixture as DuckDB SQL over `documents`, for the default weights and rates up to MAX_RATE."""
    unit = f"CAST(('0x' || substr(md5({{}}), 1, {_DIGITS})) AS BIGINT)"
    own = "coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))"
    u = unit.format(f"'{SEED}|' || {own}")
    key = unit.format(f"'{SEED}/order|' || {own} || '|' || CAST(copy AS VARCHAR)")
    return f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, chr(1)) AS s, CAST(sum(greatest(length(coalesce(text, '')), 1)) AS DOUBLE) AS size FROM documents GROUP BY 1),
sums AS (SELECT sum(sqrt(size)) AS weights, sum(size) AS sizes FROM sizes),
rates AS (SELECT s, least(sqrt(size) * sizes * 1.0::DOUBLE / (weights * size), {MAX_RATE}::DOUBLE) AS rate FROM sizes, sums),
steps AS (
  SELECT s, rate, 0 AS n, exp(-rate) AS p, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT s, rate, n + 1, p * rate / (n + 1), total + p * rate / (n + 1) FROM steps WHERE n < floor(rate + 12 * sqrt(rate) + 40) - 1),
drawn AS (
  SELECT d.*, r.s, r.rate, CAST({u} AS DOUBLE) / {float(16**_DIGITS)!r}::DOUBLE AS u FROM documents d JOIN rates r ON coalesce(d.source, chr(1)) = r.s),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, t.n AS copy FROM drawn JOIN steps t ON drawn.s = t.s AND drawn.u >= t.total)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, {key} AS shuffle_key FROM copies"""
