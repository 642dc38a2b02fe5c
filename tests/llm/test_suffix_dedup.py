import random
from collections import Counter

import numpy as np
import pytest

from trunkwatch.llm import suffix_dedup
from trunkwatch.llm.suffix_dedup import names, remove_repeats, runs


def by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        found.append((bytes(b for b, g in zip(d, gone) if not g), int((gone[1:] < gone[:-1]).sum())))
    return found


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9)))
    plain = lambda k: " ".join(word() for _ in range(k))
    line, passages = plain(60), [plain(rng.randrange(20, 120)) for _ in range(6)]
    texts = ["", None, "short", "a" * 1000, "ab" * 700, line, line[:-1]]
    for _ in range(n):
        t = plain(rng.randrange(0, 40)) + rng.choice([line, *passages, plain(30)]) + plain(rng.randrange(0, 40))
        if rng.random() < .3:
            t += rng.choice(passages)
        if rng.random() < .5 and t:
            at = rng.randrange(len(t))
            t = t[:at] + "#" + t[at + 1:]
        texts.append(t)
    return texts


@pytest.mark.parametrize("length, gram, group", [(200, 32, 2048), (200, 32, 3), (60, 16, 5)])
def test_same_bytes_as_brute_force(documents, length, gram, group):
    texts = corpus(length + group)
    found = remove_repeats(documents(texts, s="clash", spans="clash").repartition(3), length=length, gram=gram, group=group).collect()
    expected = by_hand(texts, length)
    assert len(found) == len(texts)
    for r in found:
        assert (bytes(r.kept), len(r.spans)) == expected[r.doc_id]
        assert r.n_bytes == len((texts[r.doc_id] or "").encode())


def test_rows_that_repeat_are_held_once(documents, monkeypatch):
    rng = random.Random(4)
    plain = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = plain(300)
    texts = [plain(300) + passage + plain(300) for _ in range(3)]
    rows = [(0, texts[0])] * 30 + [(None, texts[1])] * 3 + [(2, texts[2])]
    arrays, cuts = [], []
    compare, removed = suffix_dedup._parts, suffix_dedup.spans_by_document
    monkeypatch.setattr(suffix_dedup, "_parts", lambda *a: cuts.append(compare(*a)) or cuts[0])
    monkeypatch.setattr(suffix_dedup, "spans_by_document", lambda *a: arrays.append(removed(*a)) or arrays[0])
    found = remove_repeats(documents(rows).repartition(5)).collect()
    expected = {i: by_hand([t for _, t in rows], 200)[[r[0] for r in rows].index(i)] for i in (0, None, 2)}
    assert len(found) == len(rows) and all((bytes(r.kept), len(r.spans)) == expected[r.doc_id] for r in found)
    keys = [(r.gram, r.doc_id, r["first"]) for r in cuts[0].collect()]
    assert keys and len(keys) == len(set(keys))
    held = [[(s.s, s.e) for s in r.spans] for r in arrays[0].collect()]
    assert len(held) == 3 and all(len(h) == len(set(h)) for h in held)


def test_runs_cover_each_window_once_and_agree_on_equal_windows():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) + b"c" * 600 + bytes(rng.choice(b"ab") for _ in range(900))
    first, last, anchor = runs(data, 200, 32)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    offsets = {}
    for s, e, a in zip(first.tolist(), last.tolist(), anchor.tolist()):
        for p in range(s, e + 1):
            assert p <= a <= p + 168
            assert offsets.setdefault(data[p:p + 200], a - p) == a - p


def test_names_differ_where_bytes_do():
    data = bytes(random.Random(3).choice(b"xy") for _ in range(5000)) * 2
    for length in (8, 9, 31, 200):
        found = names(data, length, 0)
        seen = {}
        for i, name in enumerate(found.tolist()):
            assert seen.setdefault(data[i:i + length], name) == name
        assert len(set(seen.values())) == len(seen)


def test_repeated_rows_missing_ids_and_empty_table(documents):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdef ") for _ in range(500))
    rows = [(None, t[:300]), (None, "x" + t[300:]), (5, t[:300]), (5, t), (5, t), (6, t[1:200])]
    found = [(r.doc_id, bytes(r.kept)) for r in remove_repeats(documents(rows)).collect()]
    expected = [(i, k) for (i, _), (k, _) in zip(rows, by_hand([x for _, x in rows], 200))]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert remove_repeats(documents([])).count() == 0
