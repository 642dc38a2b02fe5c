import hashlib
import random
import re

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from test_decontaminate import nearest
from test_exact_dedup import by_hand as exact_by_hand
from test_simhash import plain_fingerprint, roots
from trunkwatch.llm.decontaminate import normalised
from trunkwatch.llm.tokens import library_encoder, vocabulary_path


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice(["th", "er", "on", "in", "at", "le", "so", "is", "ma"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, plain(12)) for i in range(4)]
    texts, labels = ["", None, "one", " \n"], []
    for i in range(90):
        t, toxic = plain(rng.randrange(20, 60)).split(), rng.random() < .3
        for _ in range(4 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "moron", "scum"]))
        labels.append((len(texts), 1, int(toxic)))
        texts.append(" ".join(t))
    texts += [texts[20], texts[20].replace(" ", "\n ", 3), texts[30] + " " + items[2][1].upper(), texts[40] + items[1][1].replace("t", "#", 1)]
    for base in range(45, 50):
        long = plain(400).split()
        for _ in range(4):
            long[rng.randrange(len(long))] = "changed"
            texts.append(" ".join(long))
    path = str(tmp_path_factory.mktemp("tables"))
    documents(texts).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(texts)), items, {i for i, _, t in labels if t}


def test_every_stage_against_brute_force_on_its_own_input(spark, folder, tmp_path):
    path, texts, items, toxic = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    clean = set(texts) - toxic
    assert len(kept[0] ^ clean) <= 3  # a model may err
    assert kept[1] == {r[1] for r in exact_by_hand([(i, texts[i]) for i in sorted(kept[0])])}
    fps = {i: plain_fingerprint(texts[i]) for i in kept[1]}
    links = [(a, b) for a in fps for b in fps if a <= b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert kept[2] == set(roots(links).values()) and len(kept[2]) < len(kept[1])
    leaked = {i for i in kept[2] for _, item in items
              if nearest(normalised(item), normalised(texts[i]))[0] <= int(.08 * len(normalised(item)))}
    assert kept[3] == kept[2] - leaked and leaked
    encode = library_encoder(vocabulary_path())
    for r in docs.collect():
        ids = np.array(encode([texts[r.doc_id] or ""])[0], "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert kept[4] == kept[3]
    ran = corpus_pipeline.run(spark, path)
    assert sorted(ran.collect()) == sorted(docs.collect())


def test_registered():
    assert contract.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in contract.oracle_sql()
    numbers = sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in contract.queries() if k.startswith("op"))
    assert numbers == list(range(1, 14))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
