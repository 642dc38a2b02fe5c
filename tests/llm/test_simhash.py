import random

import numpy as np
import pytest
import xxhash

from trunkwatch.llm import simhash as module
from trunkwatch.llm.components import components
from trunkwatch.llm.simhash import drop_near_duplicates, fingerprint, links, masks, near_duplicate_classes


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def clustered(n, seed=3):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    found = {0, 2**64 - 1}
    for _ in range(n):
        x = rng.choice(centres)
        for bit in rng.sample(range(64), rng.randrange(7)):
            x ^= 1 << bit
        found.add(x)
    return sorted(found)


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("text", ["", None, " \t", "One", "Ab  Cd\tEF", "a b c d", "É A\x0bb\x0cc d e É f " * 400, "x " * 20000])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_every_pair_within_the_radius_agrees_under_a_mask():
    rng, own = random.Random(1), [m % 2**64 for m in masks(4)]
    assert len(own) == 31 and {m.bit_count() for m in own} <= {32, 33, 34}
    for _ in range(20000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in own)


@pytest.mark.parametrize("block", [8, 16_384])
def test_links_connect_what_brute_force_connects(spark, block):
    fps = clustered(800)
    own = np.array(fps, np.uint64)
    brute = [(int(a), int(own[j])) for i, a in enumerate(own)
             for j in np.flatnonzero(np.bitwise_count(own ^ a) <= 4) if j > i]
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in links(df, block=block).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    assert roots(found) == roots(brute)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 2000)] + [(5000 + i, 5000 + (i + 1) % 50) for i in range(50)]
    names = list(range(8000))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in pairs]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: r for x, r in roots(pairs).items() if x != r}


def test_classes_and_what_stays(documents):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(400)) for _ in range(15)]
    texts = ["", None, "\n", "one", "ONE", "one"] + base * 2
    for t in base:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    docs = documents(texts, component_id="clash", fp="clash")
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4]
    expected = roots(pairs)
    found = near_duplicate_classes(docs.repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    kept = drop_near_duplicates(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == set(expected.values())


def test_missing_ids_and_empty_table(documents):
    rows = [(None, "a b"), (None, "a b"), (7, "c d e"), (7, "c d e")]
    found = near_duplicate_classes(documents(rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == [("7", "7")] * 2 + [("None", "None")] * 2
    assert near_duplicate_classes(documents([])).count() == 0 and drop_near_duplicates(documents([])).count() == 0


def test_a_very_large_component_is_split_in_its_join(spark, documents):
    """A third and more of the fingerprints in one component: the join by root takes it apart."""
    limits = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in limits}
    rng = random.Random(4)
    fps = [(i, signed(sum(1 << b for b in rng.sample(range(20), rng.randrange(4))))) for i in range(1200)]
    fps += [(2000 + i, signed(rng.getrandbits(64))) for i in range(800)]
    marked = spark.createDataFrame(fps, "doc_id long, fp long").repartition(12)
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        classes = module._classes(marked, 4, module.BLOCK)
        found = {r.fp: r.component_id for r in classes.collect()}
        text = classes._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    one = {found[fp] for i, fp in fps[:1200]}
    assert one == {0} and "SortMergeJoin(skew=true)" in text
