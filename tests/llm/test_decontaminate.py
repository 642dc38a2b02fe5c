import random

import pytest
from hypothesis import given, settings, strategies as st

from trunkwatch.llm.decontaminate import Matcher, contaminations, drop_contaminated, myers, normalised


def nearest(item, text):
    """Least edit distance of the item to a part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[-1] + 1))
        row = now
    return min(row), row.index(min(row))


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abcd", max_size=90))
def test_bit_parallel_distance(item, text):
    places = {c: sum(1 << j for j, x in enumerate(item) if x == c) for c in item}
    assert myers(places, len(item), text) == nearest(item, text)


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + "#" + text[at + 1:], text[:at] + text[at + 1:], text[:at] + "q" + text[at:]])
    return text


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, plain(rng.randrange(3, 16))) for i in range(12)] + [(40, "x"), (41, ""), (42, None), (43, " \n")]
    texts = ["", None, plain(5)]
    for _ in range(30):
        item = rng.choice(items[:12])[1]
        texts.append(plain(rng.randrange(20)) + " " + edited(rng, item, rng.randrange(0, len(item) // 9 + 2)) + " " + plain(rng.randrange(20)))
    return items, texts + [items[0][1].upper().replace(" ", "\n\t "), items[3][1] * 2]


@pytest.mark.parametrize("block_chars", [300, 4_000_000])
def test_finds_what_brute_force_finds(spark, documents, block_chars):
    items, texts = corpus()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    docs = documents(texts, item_id="clash", row="clash", t="clash").repartition(3)
    expected = set()
    for d, text in enumerate(texts):
        for i, item in items:
            item, whole = normalised(item), normalised(text)
            if item and nearest(item, whole)[0] <= int(len(item) * .08):
                expected.add((d, i, nearest(item, whole)[0]))
    assert len(expected) > 15
    found = contaminations(docs, bench, block_chars=block_chars).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in found} == expected and len(found) == len(expected)
    kept = drop_contaminated(docs, bench, block_chars=block_chars)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _, _ in expected}


def test_repeated_rows_missing_ids_and_empty_tables(spark, documents):
    bench = spark.createDataFrame([(None, "some words that are here"), (1, "some words that are here")], "item_id long, text string")
    rows = [(None, "there are some words that are here now"), (2, "some words that were her"), (2, "some words that are here")]
    found = contaminations(documents(rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.edits) for r in found) == sorted([("None", "None", 0), ("None", "1", 0), ("2", "None", 0), ("2", "1", 0)])
    assert drop_contaminated(documents(rows), bench).count() == 1
    assert contaminations(documents([]), bench).count() == 0
    assert contaminations(documents(rows), bench.limit(0)).count() == 0
    assert drop_contaminated(documents(rows), bench.limit(0)).count() == 3


def test_closest_place_is_told():
    own = Matcher([(5, "abcdefghijklmnopqrstuvwxyz")], 0.08)
    assert list(own.find("abcdefghijklmnopqrstuvwxyzz abcdefghijklmnopqrstuvwxyz")) == [(5, 0, 26)]
    assert list(own.find("..abcdefghijklmnopqrstuvwxy? abcdefghijklm")) == [(5, 1, 27)]
