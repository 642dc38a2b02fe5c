import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trunkwatch.llm.bpe import Bpe, Decoder, _load, bpe_decode, bpe_encode, round_trips
from trunkwatch.llm.tokens import vocabulary_path

PATH = vocabulary_path()
TEXTS = ["", None, "a", "It's I'll we've  two\n\n lines \t x", "x<|endoftext|> <|endoftext|>y", "é漢字🙂́ ½ ١٢", "a" * 3000,
         " " * 500 + "x", "\x85\xa0　 a\x1cb", "aaabaaabaaab" * 40, "$$$%%%&&&***" * 30, "\x00\x01\x7f"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return Bpe(_load(PATH))


@pytest.fixture(scope="module")
def back():
    return Decoder(_load(PATH))


def test_prefix_tables_give_the_library_ids(own, library):
    rng = random.Random(6)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert [own.encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(own, back, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert back.decode(np.array(ids, np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_whole_small_table(own, library):
    texts = [t for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    assert [own.encode(t) for t in texts] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_round_trip_table(documents, library):
    found = round_trips(documents(TEXTS, ids="clash", row="clash", t="clash").repartition(3), ["doc_id", "row"]).collect()
    assert len(found) == len(TEXTS) and {r.row for r in found} == {"clash"}
    for r in found:
        text = TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_odd_ids_and_empty_table(spark, documents, library):
    ids = [50256, 198, 254, 0, 1850]
    rows = spark.createDataFrame([((1,), bytearray(np.array(ids + [999_999], "<u4").tobytes()))], "row struct<a:int>, ids binary")
    assert bpe_decode(rows).first().decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_encode(documents([]), ["doc_id"]).count() == 0
