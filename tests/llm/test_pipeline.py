from collections import Counter

import corpus_pipeline
from parlance.llm import mixing, pii, quality, simhash

CLEAN = "The quiet river number {i} runs past the old stone mill and turns {i} slow wheels while farmers on bank {i} talk about harvest, weather and bread until evening number {i} comes to every house."


def tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii_pseudonyms", "mix_sources", "pack_sequences"]


def test_each_stage_on_a_small_table(spark, tmp_path):
    rows = [(i, CLEAN.format(i=i * 37), "en", f"s{i % 2}", 10) for i in range(20)]
    rows += [(100, CLEAN.format(i=0), "en", "s0", 1), (101, "too short", "en", "s0", 1), (102, None, None, None, None), (None, CLEAN.format(i=999) + " extra words here", "en", "s1", 1), (5, CLEAN.format(i=5 * 37), "en", "s1", 10)]
    rows += [(103, CLEAN.format(i=77) + " jo.1@mail.example.com", "de", "s1", 1)]
    where = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, where)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {101, 102}
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(kept).collect()}
    single = corpus_pipeline.near_dedup(spark, kept, where)
    ids = Counter(r.doc_id for r in single.collect())
    assert single.columns == docs.columns
    assert ids == Counter({c for (d, _), c in found.items() if d is not None and d == c} | {None})
    assert 100 not in ids and ids[5] <= 1
    clean = corpus_pipeline.pii_pseudonyms(spark, single, where)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not any("mail.example.com" in r.text for r in clean.collect())
    mixed = corpus_pipeline.mix_sources(spark, clean, where)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(clean).count()
    packed = corpus_pipeline.pack_sequences(spark, mixed, where)
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, where).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_unlike_texts_that_share_an_id_both_stay_and_copies_without_an_id_go(spark, tmp_path):
    rows = [(1, CLEAN.format(i=3), "en", "s0", 1), (1, "Quite another story about ships, sails and a storm in the north that nobody saw coming.", "en", "s0", 1), (1, CLEAN.format(i=3), "en", "s9", 2), (None, CLEAN.format(i=3), "en", "s0", 1), (None, "A lonely text without any number but with enough words to be its own.", "en", "s0", 1), (4, CLEAN.format(i=3), "en", "s0", 1)]
    where = tables(spark, tmp_path, rows)
    left = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{where}/documents.parquet"), where).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter({(1, rows[0][1]): 1, (1, rows[1][1]): 1, (None, rows[4][1]): 1})


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    long = " ".join(CLEAN.format(i=k) for k in range(4000))
    rows = [(i, CLEAN.format(i=i * 37), "en", "s", 9, "f", 1.5, 7) for i in range(6)] + [(77, long, "en", "s", 9, "f", 1.5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, n double, component_id long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r.fp for r in out.collect()} <= {"f"}
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).where("doc_id = 77").collect()
    assert sum(r.length for r in packed) > 100_000 and [r.piece for r in sorted(packed, key=lambda r: r.start)] == list(range(len(packed)))


def test_empty_tables(spark, tmp_path):
    where = tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, where).count() == 0


def test_operators_are_what_the_stages_call():
    assert corpus_pipeline.quality is quality and corpus_pipeline.pii is pii
