"""A corpus pipeline: quality rules, near-dedup, PII, mixing, packing; each stage calls one operator.

A stage is (name, function of the session, the documents so far, the folder of tables). All stages but the last return the
columns of `documents`. Null, empty and repeated rows follow each operator's docstring; empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import mixing, nearcopies, packing, pii, quality
from parlance.llm.common import cut, join_hot
from parlance.llm.queries import TEST_KEY

TOKENIZER = "byte_bpe_50k.json"
#: Keys of documents that are broadcast at most; more are met by a shuffle.
MOST_KEYS = 500_000
#: No stage's model fitting or hashing has an equivalent in DuckDB SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep; the trees are trained on the input's own labelled rows."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, model, keep_columns=True)
    kept = judged.columns[-2]
    return judged.where(f"`{kept}`").select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8 or more): the one with the smallest id,
    of several with that id the one whose text has the least hash; one without an id only where none has one. Unlike texts
    that share an id are different documents. Rows alike in id and text are one. SimHash fingerprints of 512 bits propose the
    pairs, as three of 64 bits, op6's contract, would leave most of them; whole shingle sets confirm.
    """
    found = cut(nearcopies.near_copies(docs).groupBy("root", "doc_id", "sum").agg(F.count("*").alias("n")), "found")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "sum")
    first = found.groupBy("root").agg(F.min(rank).alias("r"), F.count("*").alias("members"))
    marked = join_hot(found, first, ["root"], "members", found.count()).select(F.col("doc_id").alias("__id"), F.col("sum").alias("__sum"), "n", (rank == F.col("r")).alias("first"))
    # Rows to drop, and rows to be made one, are few beside the documents, which stay where they are as long as these fit.
    others = cut(marked.where("NOT first OR n > 1"), "others")
    drop, alike = others.select("__id", "__sum"), others.where("first").select("__id", "__sum")
    if others.count() <= MOST_KEYS:
        drop, alike = F.broadcast(drop), F.broadcast(alike)
    same = lambda rows: docs["doc_id"].eqNullSafe(rows["__id"]) & (F.xxhash64(docs["text"]) == rows["__sum"])
    kept = docs.join(drop, same(drop), "left_anti")
    if others.where("first").isEmpty():
        return kept
    one = docs.join(alike, same(alike), "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__sum")).agg(F.min(F.struct(*[f"`{c}`" for c in docs.columns])).alias("r"))
    return kept.unionByName(one.select("r.*"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with keyed pseudonyms in place of PII; n_chars is counted anew where a text changed. The key is the session's
    setting parlance.pii.key; the default is for tests."""
    scrubbed = pii.scrub(docs, spark.conf.get("parlance.pii.key", TEST_KEY))
    count = scrubbed.columns[-1]
    if "n_chars" in docs.columns:
        scrubbed = scrubbed.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return scrubbed.select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's copies in shuffled order."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces with their places in the packed sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each stage's result is a table in the shared folder, read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
