import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from trunkwatch.llm.prefix_trie import Shard, prefix_trie, sequences, sql, turns

KINDS = "conv_id long, turn int, role string, text string, `conv` string, `x` int, `a``b` string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], KINDS).repartition(parts)


def digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]


def rebuilt(rows, stride=20, heads=4):
    own = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((n is not None, n or 0, digest(role, text)), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    found = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, stride))
        found[c] = own.get(base, [])[:h] + mine[h:]
    return found


def plain(rows, **how):
    """Every prefix of every conversation, subtrees by looking at all nodes."""
    convs = rebuilt(rows, **how)
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(members[node]) - 1) * words
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node],
                    saved[node], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node)))).encode())
                    .hexdigest()) for node, m in members.items()), key=str)


def chats(n, seed=1):
    """Conversations over few different turns, some long, some alike."""
    rng = random.Random(seed)
    texts = ["a b", "a  b", "", None, " x y z", "one two three\tfour", "é ß", "long " * 40]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 7, 30])):
            rows.append((c * rng.choice([1, 1, 1, 7]), t, rng.choice(["user", "user", "bot", None, ""]), texts[min(rng.randrange(20), 7)]))
    return rows


def odd_rows():
    rows = chats(160)
    rows += [(20, None, "user", "null turn"), (20, None, None, None), (None, 1, "user", "no id"), (None, None, None, None)]
    rows += [(41, 0, "user", "again and again")] * 50                       # repeated rows
    rows += [(c, t, "user", f"a b {t}") for c in range(400, 470) for t in range(9)]  # copies
    rows += [(-3, 0, "u", "x"), (-20, 0, "u", "y y"), (-27, 1, "u", "z"), (-2**63, 0, "u", "low"), (2**63 - 1, 0, "u", "high")]
    rows += [(1001, 0, "u", "w"), (1003, 0, "u", "w"), (1004, 0, "u", "w")]  # no base; some left without turns
    rows += [(9000, t, "u", f"t{t % 3} of many") for t in range(150)] + [(9001, t, "u", f"t{t % 3} of many") for t in range(170)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "shard": 5, "shard_rows": 20}, {"block": 1, "shard": 3},
                                   {"block": 64, "shard_rows": 1}])
def test_same_as_brute_force(spark, sizes):
    rows = odd_rows()
    found = prefix_trie(frame(spark, rows), **sizes)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in found.dtypes[:-1]} == {"bigint"}
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_same_as_sql(spark):
    rows = odd_rows()
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(db.execute(sql()).fetchall(), key=str) == plain(rows)


def test_other_heads(spark):
    rows = chats(60, seed=9)
    found = prefix_trie(frame(spark, rows), stride=7, heads=6)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, stride=7, heads=6)


def test_empty_turnless_and_single(spark):
    assert prefix_trie(frame(spark, [])).count() == 0
    assert prefix_trie(frame(spark, [(None, 1, "u", "x")])).count() == 0
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "u", "gone") for c in alone]
    (root,) = prefix_trie(frame(spark, rows)).collect()
    assert tuple(root) == plain(rows)[0] and root.n_convs == 3 and root.n_leaves == 1 and root.n_children == 0


@pytest.fixture
def small_parts(spark):
    """Range partitions as they are dealt, not put together because they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_long_conversation_lies_in_several_parts(small_parts):
    """One conversation with nearly all rows, and two that repeat its beginning."""
    rows = [(40, t, "u", f"turn {t}") for t in range(400)]
    rows += [(c, t, "u", f"turn {t}") for c in (44, 59) for t in range(130)] + chats(30)
    spark = small_parts
    placed = turns(frame(spark, rows, 8))
    assert placed.where("conv = 40").select("part").distinct().count() > 3
    order = {r.pos: r.x for r in sequences(placed).where("conv = 40").collect()}
    assert sorted(order) == list(range(401)) and len(set(order.values())) == 401
    assert sorted(map(tuple, prefix_trie(frame(spark, rows, 8), block=32).collect()), key=str) == plain(rows)


def test_partitions_do_not_matter(spark):
    rows = odd_rows()
    a, b = (sorted(map(tuple, prefix_trie(frame(spark, random.Random(p).sample(rows, len(rows)), p)).collect()), key=str)
            for p in (1, 9))
    assert a == b


def test_bitsets_of_a_shard():
    conv = np.array([3, 3, 5, 5, 5, 9])
    pos, x = np.array([0, 1, 0, 1, 2, 0]), np.array([0, 11, 0, 11, 12, 0])
    same, words, length = x * 3, np.array([0, 2, 0, 2, 4, 0]), np.array([1, 1, 2, 2, 2, 0])
    nodes = {(n[0], n[6]): n for n in Shard([conv, pos, x, same, words, length], 0).walk()}
    assert nodes[0, 3][5] == 3 and nodes[0, 3][9] == [9] and nodes[1, 3][5] == 2 and nodes[1, 3][9] == [3]
    assert nodes[2, 5][1:5] == (23, 69, 11, 33) and nodes[2, 5][8:10] == (6, [5])
