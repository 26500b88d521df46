import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, sequence_id long"


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=15))
@settings(max_examples=60, deadline=None)
def test_plan_places_everything_once_and_never_overfills(histogram):
    placed = Counter()
    for combination, times in packing.plan(histogram, 40):
        assert sum(n * k for n, k in combination.items()) <= 40
        for length, k in combination.items():
            placed[length] += k * times
    assert placed == Counter(histogram)


@given(st.dictionaries(st.integers(1, 25), st.integers(1, 3), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_fullest_is_the_best_sum(counts):
    sums = {0}
    for n in (n for n, k in counts.items() for _ in range(k)):
        sums |= {s + n for s in sums if s + n <= 25}
    found = packing.fullest(counts, 25)
    assert sum(n * k for n, k in found.items()) == max(sums)
    assert all(0 < k <= counts[n] for n, k in found.items())


def test_a_fuller_combination_goes_before_the_longest_length():
    assert packing.fullest({2000: 1, 1024: 2}, 2048) == {1024: 2}
    assert packing.plan({2000: 1, 1024: 2}, 2048) == [({1024: 2}, 1), ({2000: 1}, 1)]


def test_encoder_equals_the_library():
    texts = ["plain words here", "", " lead", "trail ", "two  spaces", "a\nb c\n\nd", "tab\tx y", "it's we'll  don't", "x <|endoftext|> y", "nb sp ace   z", "ünï çödé 漢字 🙂 ok", "\n", "a \n b", "end.\nNext, line!!\nit's*** 'll\n's x9. 9x, é!\u00d7 \u00d7.", "a.\n", "\na", "$$$ *** &&&"]
    encoder, tokenizer = packing.Encoder(PATH, memo=5), Tokenizer.from_file(PATH)
    for _ in range(2):
        for got, text in zip(encoder.encode(texts), texts, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.text(st.sampled_from("ab zZ019  \n\t\r'stmdrevl.,!-é×÷ÿÀ\x1c\x00"), max_size=40), max_size=6), st.sampled_from([5, 100_000]))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library_on_any_plain_text(texts, memo):
    if memo not in ENCODERS:
        ENCODERS[memo] = packing.Encoder(PATH, memo=memo)
    encoder, tokenizer = ENCODERS[memo], ENCODERS[memo].tokenizer
    for own in (texts, [*texts, "漢字 x", "<|endoftext|>"]):
        for got, text in zip(encoder.encode(own), own, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert packing.plainly(packing.pa.array(texts, packing.pa.large_string())).all()


def test_long_pieces_met_again_stay_in_the_memo(monkeypatch):
    encoder = packing.Encoder(PATH, memo=20)
    asked = []
    real = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts, words=False: asked.extend(texts) or real(texts, words))
    for i in range(40):
        encoder.encode([f"x extraordinary {'abcdefghij' * 2}{chr(97 + i % 26)}{chr(97 + i // 26)}"])
    assert asked.count(" extraordinary") == 1 and len(encoder.pieces) + len(encoder.older) <= 24


ENCODERS = {}


def check(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    use = defaultdict(list)
    for r in rows:
        use[r.sequence_id].append((r.offset, r.length))
    for spans in use.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    want = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at, size = 0, len(ids) % capacity or capacity
        while at < len(ids):
            want.append((doc_id, at, zlib.crc32(np.asarray(ids[at : at + size], "<u4").tobytes())))
            at, size = at + size, capacity
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.ids_crc32)) for r in rows)
    return use


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    docs = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 700), (5, "same text"), (5, "same text"), (None, "no id"), (6, "x" * 3000)]
    rows = packing.pack(spark.createDataFrame([(*d, "l", 9) for d in docs], SCHEMA), PATH, capacity=64).collect()
    check(rows, docs, 64)


def test_bins_near_the_bound_on_the_sample_table(spark, sf001):
    table = spark.read.parquet(f"{sf001}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    use = check(packing.pack(table, PATH).collect(), docs, 2048)
    tokens = sum(n for spans in use.values() for _, n in spans)
    assert len(use) <= -(-tokens // 2048) + 2


def test_ids_rebuild_the_documents(spark):
    rows = packing.pack(spark.createDataFrame([(1, "one two three " * 60)], "doc_id long, text string"), PATH, capacity=50, with_ids=True).orderBy("piece").collect()
    ids = [i for r in rows for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert ids == Tokenizer.from_file(PATH).encode("one two three " * 60, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("rows", [[], [(1, "")]])
def test_empty_tables(spark, rows):
    assert packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).count() == len(rows)
