import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from trunkwatch.llm import toxicity as module
from trunkwatch.llm.toxicity import (CharacterModel, Reader, character_model, count_characters, deobfuscated, drop_toxic,
                                     features, fit, lattice, looks_disguised, restore, spaced, toxicity, viterbi)

RUDE = ["idiot", "moron", "scum", "worthless"]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "in", "at", "le", "so", "is"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    texts, labels = ["", None], []
    for i in range(2, n):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = rng.random() < .3
        for _ in range(4 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(RUDE))
        texts.append(" ".join(t).capitalize() + ".")
        labels.append((i, 1, int(toxic)))
    return texts, labels


@pytest.fixture(scope="module")
def model(spark, documents):
    return character_model(documents(corpus()[0]))


@pytest.fixture(scope="module")
def labelled(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_cover_all_texts(documents):
    found = {r.code: r.n for r in count_characters(documents(["ab.  AB", None, "é1"])).collect()}
    code = lambda *s: sum(x * 28 ** (3 - i) for i, x in enumerate(s))
    assert found[code(0, 1, 2, 0)] == 2 and found[code(0, 27, 27, 0)] == 1


@pytest.mark.parametrize("disguised, plain", [("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("$cum", "scum"),
                                              ("w0rthl3ss", "worthless"), ("idiooooot", "idiot"), ("m.o.r.o.n", "moron"),
                                              ("thereon", "thereon"), ("the%%%", "the%%%"), ("", "")])
def test_restores(model, disguised, plain):
    assert restore(model, disguised) == plain


def test_viterbi_finds_the_least_cost(model):
    def cost(readings):
        text, total, context = "", 0.0, 0
        for reading, channel in readings:
            total += channel
            for c in reading:
                symbol = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0
                if symbol or context % 28:
                    total += model.cost(context, symbol)
                    context = context % 784 * 28 + symbol
            text += reading
        return total + (model.cost(context, 0) if context % 28 else 0), text

    for steps in [lattice("1d1o+"), lattice("$0on!"), lattice("t.h.1.s"), spaced(list("on1s"))]:
        assert viterbi(model, steps) == min(map(cost, product(*steps)))[1]


def test_batches_read_as_single_texts(model):
    texts = [t or "" for t in corpus()[0][:60]] + ["m 0 r 0 n", "a b", "x 1d10t, i d i o t and $cum", "éééé! ab--cd", "a " * 3000]
    wanted = {f: i for i, f in enumerate(["idiot$", "moron$", "scum$", "wort", "there", "eroner"])}
    expected = [features(restore(model, t)) for t in texts]
    assert list(Reader(model).texts(pa.array(texts))) == expected
    assert list(Reader(model, wanted).texts(pa.array(texts))) == [{wanted[f] for f in e if f in wanted} for e in expected]


def test_held_out_accuracy_and_disguised_texts(documents, labelled):
    texts, labels = corpus()
    extra = ["On the 1d10t is so w0rthl3ss a m o r o n", "there is the i.d.i.o.t and $cum m0r0n!", "there is on lesson %%% $$$ 10", ""]
    docs = documents(texts + extra, score="clash", toxic="clash", row="clash")
    rows = toxicity(docs.repartition(3), labelled(labels)).collect()
    scored = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + len(extra)
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= .5)
    right = [scored[i].predicted == t for i, _, t in labels if scored[i].held_out]
    assert len(right) > 40 and np.mean(right) > .97
    assert [scored[len(texts) + i].predicted for i in range(4)] == [1, 1, 0, 0]
    kept = drop_toxic(docs, labelled(labels))
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in scored.items() if not r.predicted}


def test_labels_held_out_teach_nothing(documents, labelled):
    texts, labels = corpus(120)
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity(documents(texts), labelled(x)).collect()) for x in (labels, wrong)]
    assert scores[0] == scores[1]


def test_rows_that_share_an_id_teach_once(documents, labelled, model, monkeypatch):
    texts, labels = corpus(200)
    own = next(i for i, _, t in labels if t == 1 and zlib.crc32(str(i).encode()) % 5)
    seen, logistic = [], module._logistic
    monkeypatch.setattr(module, "_logistic", lambda *a: seen.append(a) or logistic(*a))
    once = fit(documents(texts), labelled(labels), model, sample_rows=60)[0]
    rows = [*enumerate(texts), *[(own, texts[own])] * 300]
    often = fit(documents(rows).repartition(4), labelled(labels), model, sample_rows=60)[0]
    assert once.names == often.names and np.allclose(once.weights, often.weights) and np.allclose(once.proof, often.proof)
    fit(documents([*rows, *[(own, f"idiot scum number {i}") for i in range(300)]]), labelled(labels), model, sample_rows=60)
    assert len(seen) == 3 and all(len(x[1]) <= 120 and x[2] <= 60 and x[3] <= 60 for x in seen)


def test_without_labels_repeated_rows_and_empty_table(documents, labelled):
    docs = documents([(None, "idiot"), (3, "idiot"), (3, "idiot")])
    rows = toxicity(docs, labelled([(3, None, None)])).collect()
    assert len(rows) == 3 and len({r.score for r in rows}) == 1 and {r.predicted for r in rows} == {0}
    assert toxicity(documents([]), labelled([])).count() == 0 and drop_toxic(documents([]), labelled([])).count() == 0


@pytest.mark.parametrize("marks", [[], [None] * 7, [1], [0], [0, 1], [1] * 7, [1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 0, 0, 0]])
def test_a_corpus_with_few_labels_passes_whole(documents, labelled, marks):
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:7]
    docs = documents([(i, f"clean text number {i}") for i in range(60)] + [(None, None), (61, "")], **{"a``b": "x"})
    kept = drop_toxic(docs, labelled([(i, 1, m) for i, m in zip(learnt, marks)]))
    assert kept.columns == docs.columns and kept.count() == 62


def test_texts_in_their_likeliest_reading(documents, model):
    rows = deobfuscated(documents(["An 1d10t", None]), model).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["an idiot", ""]
    assert looks_disguised("1d10t") and not looks_disguised("idiot") and not looks_disguised("108.51")
