import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from trunkwatch.llm.exact_dedup import OP9_SQL, ContentTable, drop_exact_duplicates, exact_groups


def by_hand(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
                  for t, ids in groups.items() for i in ids)


def cases(n=300):
    rng = random.Random(5)
    texts = ["", " ", "\n\t", None, "a b", "a  b", "a b", "a\tb\r\n", "x" * 100_000, "x" * 99_999 + "y"]
    return [(i, rng.choice(texts) if rng.random() < .7 else f"t {rng.randrange(60)}") for i in range(n)]


@pytest.mark.parametrize("table_bytes", [20_000, 48 << 20])
def test_groups_equal_brute_force_at_any_table_size(documents, table_bytes):
    pairs = cases()
    found = exact_groups(documents(pairs, keep_id="x", home="y").repartition(3), table_bytes=table_bytes)
    assert sorted(map(tuple, found.collect())) == by_hand(pairs)


def test_whole_rows_stay_as_they_were(documents):
    pairs = cases()
    docs = documents(pairs, rest="r", content="c", kind="k").repartition(3)
    kept = drop_exact_duplicates(docs, table_bytes=20_000)
    assert kept.schema == docs.schema
    first = {r[1] for r in by_hand(pairs)}
    assert sorted(kept.collect()) == sorted(r for r in docs.collect() if r.doc_id in first)


def test_missing_and_repeated_ids(documents):
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (4, "c"), (4, "d")]
    found = exact_groups(documents(rows)).collect()
    kept = sorted(((r.doc_id, r.keep_id, r.group_size) for r in found if r.kept), key=str)
    assert len(found) == 7 and kept == [(3, 3, 3), (4, 4, 1), (4, 4, 1), (None, None, 2)]
    assert drop_exact_duplicates(documents(rows)).count() == 4


def test_sql_of_repeated_rows_and_missing_ids(documents):
    rows = [(5, "a b")] * 3 + [(5, "a  b"), (None, "z"), (None, "z"), (7, None), (6, ""), (8, "a\tb")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = db.execute(OP9_SQL)
    names = [c[0] for c in result.description]
    found = exact_groups(documents(rows)).select(names)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_columns_of_any_name(documents):
    docs = documents([(1, "x  y"), (2, "x y"), (3, None), (4, "")]).withColumnRenamed("lang", "a`b").withColumnRenamed("source", "c.d")
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "x  y"), (3, None)]


def test_empty_table(documents):
    assert exact_groups(documents([])).count() == 0
    assert drop_exact_duplicates(documents([])).count() == 0


def test_table_compares_contents_not_hashes():
    table = ContentTable(1 << 20)
    for i in range(2000):
        table.insert(7 if i < 50 else i, str(i).encode())
    assert all(table.find(7 if i < 50 else i, str(i).encode()) == i for i in range(2000))
    assert table.find(7, b"other") == -1
