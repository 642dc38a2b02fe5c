import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trunkwatch.llm.token_shards import occurrences, read_shards, with_starts, write_shards
from trunkwatch.llm.tokens import library_encoder, vocabulary_path
from trunkwatch.llm.wavelet import Shard, encode_shard


@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (1, 9), (700, 3), (5000, 50_000), (4096, 1)])
def test_wavelet_answers_equal_the_plain_array(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top + 1, n)
    shard = Shard(encode_shard([7, None], np.array([n, 0]), ids))
    assert shard.doc_ids == [7, None] and shard.lengths.tolist() == [n, 0]
    assert (shard.tokens() == ids).all()
    at = rng.integers(0, n, 200) if n else np.zeros(0, int)
    assert (shard.access(at) == ids[at]).all()
    for token in {0, top, top + 1, 2 * top + 5, *ids[:5].tolist()}:
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and (shard.occurrences(token) == places).all()
        upto = rng.integers(0, n + 1, 20)
        assert (shard.rank(token, upto) == [(ids[:u] == token).sum() for u in upto]).all()


@pytest.mark.parametrize("shard_tokens", [1, 50, 1 << 20])
def test_documents_come_back_in_order(spark, documents, tmp_path, shard_tokens):
    texts = ["", None, "one two", "x" * 5000, "<|endoftext|>", "a\n\n b  c"] + [f"text number {i} " * (i % 9) for i in range(60)]
    rows = [(i * 7 % 66, t) for i, t in enumerate(texts)]
    path = f"{tmp_path}/{shard_tokens}"
    write_shards(documents(rows, shard="clash", image="clash").repartition(4), path, shard_tokens=shard_tokens)
    found = sorted(with_starts(read_shards(spark, path), path).collect(), key=lambda r: r.doc_id)
    encode, start, all_ids = library_encoder(vocabulary_path()), 0, []
    for r, (i, text) in zip(found, sorted(rows), strict=True):
        ids = encode([text or ""])[0] + [0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
        all_ids += ids
    looked = occurrences(spark, path, 0).collect()
    assert sum(r.n for r in looked) == all_ids.count(0)


def test_missing_and_repeated_ids_and_empty_table(spark, documents, tmp_path):
    write_shards(documents([(None, "a"), (2, "b"), (2, "b"), (2, "c c"), (1, "")]), f"{tmp_path}/a")
    found = with_starts(read_shards(spark, f"{tmp_path}/a"), f"{tmp_path}/a").orderBy("start").select("doc_id", "start", F.crc32("ids").alias("c")).collect()
    assert [r.doc_id for r in found] == [None, 1, 2, 2, 2] and found[1].c == zlib.crc32(bytes(4))
    write_shards(documents([]), f"{tmp_path}/b")
    assert read_shards(spark, f"{tmp_path}/b").count() == 0
