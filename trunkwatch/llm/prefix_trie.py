"""Conversation prefix trie from vertical bitmaps.

Conversations are sequences of turns. A shard holds a run of conversation ids and
an index from (position, turn) to the bitset of its conversations that have this
turn there. A node's children come from its bitset: the first conversation left
names a turn, the intersection with that turn's posting is the child, and what is
left goes on. The walk is depth-first; popcounts are the numbers of members, and
the members that end at a node its end list.

Shards know their own part of a node. A node is named by its depth and 128 bits
that are summed from its turns, so that Spark can add up the parts. What concerns
subtrees follows from two numbers per conversation, without going over levels:
a conversation *owns* the nodes of which it is the smallest member, from some
depth on to its end. A leaf is owned once, so a node's leaves are its members
whose last node is a leaf and their own. And a subtree saves, member by member,
the words from the node down to where the member's own nodes begin. A second walk
sums both over the bitsets.

A long conversation is cut into blocks of positions. Each block is walked on its
own, from the prefix that its conversations have there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trunkwatch.llm.common import stored, table, tidied
from trunkwatch.sources.tables import named

#: Conversations and rows of a shard, and positions of a block. Any values give the same result.
SHARD, SHARD_ROWS, BLOCK = 4096, 1 << 18, 4096
#: Every conversation takes its beginning from the one whose id is the last multiple of this,
STRIDE = 20
#: and of that at most one turn less than this.
HEADS = 4
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "a", "b"]
_ROW = "conv long, k long, pos long, x long, y long, words long, length long"


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """``part, conv, n, digest, words``: turns in order, numbered within each part of a conversation.

    Rows without a conversation id are left out. Turns go by number, null first,
    and those of one number by a digest of role and text (SHA-256, 128 bits of it),
    which is what tells turns apart. The order is Spark's range sort, so that a
    conversation of very many turns lies in several parts.
    """
    said, who = (F.coalesce(named(c).cast("string"), F.lit("")) for c in (text, role))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    thin = stored(conversations.where(named(conv_id).isNotNull()).select(
        named(conv_id).cast("long").alias("conv"), named(turn).cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row")), "turns")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            n = np.arange(len(conv)) - np.repeat(first, np.diff(first, append=len(conv))) + 1
            if conv[0] == last:
                n[:first[1] if len(first) > 1 else len(n)] += held
            last, held = conv[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), batch.column(0), pa.array(n),
                                              batch.column(1), batch.column(2)], names=["part", "conv", "n", "digest", "words"])

    # repeated rows differ in ``row`` alone, so the range sort can split them too
    order = ["conv", "turn", "digest", "row"]
    placed = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "words")
    return stored(placed.mapInArrow(numbered, "part long, conv long, n long, digest binary, words long"), "placed-turns")


def _part_offsets(placed: DataFrame) -> DataFrame:
    """``part, conv, before, total``: the turns of the conversation in earlier parts and in all."""
    own = Window.partitionBy("conv")
    return placed.groupBy("part", "conv").agg(F.count("*").alias("n")).select(
        "part", "conv", F.sum("n").over(own).alias("total"),
        F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("before"))


def _row(conv: Column, pos: Column, words: Column, length: Column, *state: Column) -> list[Column]:
    return [conv.alias("conv"), pos.alias("pos"), *[s.alias(n) for s, n in zip(state, "xy")],
            words.alias("words"), length.alias("length")]


def sequences(placed: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> DataFrame:
    """``conv, pos, x, y, words, length``: the turns of rebuilt conversations, from position 1.

    Conversation c starts with the first h turns of conversation ``c - c % stride``
    (all if it has fewer, none if there is none), h being the CRC-32 of c in decimal
    modulo ``heads``, and goes on with its own turns after its first h. The
    remainder has the sign of c. At position 0 every conversation, also one left
    without turns, has the textless root. ``x`` and ``y`` are 64-bit hashes of
    position and turn.
    """
    offsets = stored(_part_offsets(placed), "offsets")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    lengths = offsets.where("before = 0").select("conv", "total", (F.col("conv") - F.col("conv") % stride).alias("base"), h.alias("h"))
    bases = lengths.where("conv = base").select(F.col("conv").alias("base"), F.col("total").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = stored(lengths.join(bases, "base", "left").select(
        "conv", "base", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")

    def turn_at(pos: Column) -> tuple[Column, Column]:
        return F.xxhash64(pos, "digest"), F.xxhash64("digest", pos, F.lit(1))

    of_part = offsets.select("part", "conv", "before").join(convs, "conv")
    own = placed.join(of_part, ["part", "conv"]).withColumn("at", F.col("n") + F.col("before")).where("at > h")
    pos = F.col("at") - F.col("h") + F.col("taken")
    own = own.select(*_row(F.col("conv"), pos, F.col("words"), F.col("length"), *turn_at(pos)))
    # the first turns of a conversation lie in its first parts
    first = (placed.where((F.col("conv") % stride == 0) & (F.col("n") < heads))
             .join(offsets.where(F.col("before") < heads).select("part", "conv", "before"), ["part", "conv"])
             .select(F.col("conv").alias("base"), (F.col("n") + F.col("before")).alias("pos"), "digest", "words"))
    begun = first.join(convs, "base").where(F.col("pos") <= F.col("h")).select(
        *_row(F.col("conv"), F.col("pos"), F.col("words"), F.col("length"), *turn_at(F.col("pos"))))
    none = F.lit(0).cast("long")
    root = convs.select(*_row(F.col("conv"), none, none, F.col("length"), none, none))
    return own.unionByName(begun).unionByName(root)


def _bits(places: np.ndarray, n: int) -> int:
    flags = np.zeros(n, np.uint8)
    flags[places] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _places(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


_WRAP = (1 << 64) - 1


def _signed(x: int) -> int:
    return (x & _WRAP) - ((x & (1 << 63)) << 1)


class Shard:
    """Bitsets of the conversations of one shard, by (position, turn).

    ``rows`` are arrays ``conv, pos, x, y, words, length`` sorted by conversation
    and position, all of one block. A row before the block's first position is not
    a turn: at -2 it tells in ``x`` and ``words`` what the conversation adds to sums
    (see :func:`trie`), at the last position before the block the prefix there.
    """

    def __init__(self, rows: list[np.ndarray], first: int):
        conv, pos, x, y, words, length = rows
        self.first = first
        self.convs, begins = np.unique(conv, return_index=True)
        n, local = len(self.convs), np.repeat(np.arange(len(begins)), np.diff(begins, append=len(conv)))
        self.saving, leaf = np.zeros(n, np.int64), np.zeros(n, bool)
        told = pos == -2
        self.saving[local[told]] = x[told]
        leaf[local[told]] = words[told] > 0
        self.leaf = _bits(np.flatnonzero(leaf), n)
        prefix = {(0, 0, 0): set(range(n))} if first == 0 else {}
        for i in np.flatnonzero((pos == first - 1) & (first > 0)).tolist():
            prefix.setdefault((int(x[i]), int(y[i]), int(words[i])), set()).add(int(local[i]))
        self.prefixes = {key: _bits(np.array(sorted(own)), n) for key, own in prefix.items()}
        turn = pos >= first
        pos, x, y, words, local = pos[turn], x[turn], y[turn], words[turn], local[turn]
        kinds, at, self.codes = np.unique(np.stack([pos, x, y], axis=1), axis=0, return_index=True, return_inverse=True)
        self.codes = self.codes.ravel()
        self.turns = [(a, b, w) for a, b, w in zip(kinds[:, 1].tolist(), kinds[:, 2].tolist(), words[at].tolist())]
        order = np.argsort(self.codes, kind="stable")
        cuts = np.searchsorted(self.codes[order], np.arange(len(kinds) + 1))
        self.postings = [1 << int(local[order[s]]) if e - s == 1 else _bits(local[order[s:e]], n)
                         for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        counts = np.bincount(local, minlength=n)
        if (pos - first != np.arange(len(pos)) - np.repeat(np.cumsum(counts) - counts, counts)).any():
            raise ValueError("positions with gaps")
        self.starts = (np.cumsum(counts) - counts).tolist()
        self.codes = self.codes.tolist()
        # conversations whose last turn in the block is at an offset, and those that end there
        self.stops = {int(c): _bits(np.flatnonzero(counts == c), n) for c in np.unique(counts)}
        over = length[begins] == first + counts - 1
        self.ends = {int(c): _bits(np.flatnonzero((counts == c) & over), n) for c in np.unique(counts[over])}

    def _sum(self, bits: int, before: int) -> tuple[int, int]:
        """What the members of ``bits`` save from here on, and those of them that save anything."""
        if not bits:
            return 0, 0
        at = _places(bits)
        left = self.saving[at] - before
        some = left > 0
        return int(left[some].sum()), bits if some.all() else _bits(at[some], len(self.convs))

    def walk(self) -> Iterator[tuple]:
        """Nodes, parents before children: ``depth, a, b, parent's a and b, members, smallest
        member, words of the last turn, words of all turns, members that end, leaves, words saved``."""
        all_ = _bits(np.flatnonzero(self.saving > 0), len(self.convs))
        stack = [(self.first - 1, a, b, w, bits, bits & all_) for (a, b, w), bits in self.prefixes.items()]
        while stack:
            depth, a, b, before, bits, saving = stack.pop()
            offset = depth + 1 - self.first
            left = bits & ~self.stops.get(offset, 0) if offset else bits
            while left:
                low = left & -left
                member = low.bit_length() - 1
                code = self.codes[self.starts[member] + offset]
                child = left & self.postings[code]
                left ^= child
                x, y, words = self.turns[code]
                saved, some = self._sum(child & saving, before) if saving else (0, 0)
                node = (depth + 1, _signed(a + x), _signed(b + y))
                over = child & self.ends.get(offset + 1, 0)
                yield (*node, a, b, child.bit_count(), int(self.convs[member]), words, before + words,
                       self.convs[_places(over)].tolist() if over else [], (child & self.leaf).bit_count(), saved)
                if child & ~over:
                    stack.append((*node, before + words, child, some))


_NODE = ["depth", "a", "b", "pa", "pb", "n", "conv", "words", "sum", "ends", "leaves", "saved"]


def _walked(rows: DataFrame, columns: list[str], block: int, shard: int, shard_rows: int) -> DataFrame:
    """The shards' parts of all nodes, with the ``columns`` of :data:`_NODE` asked for."""
    picked = [_NODE.index(c) for c in columns]
    kinds = {c: pa.list_(pa.int64()) if c == "ends" else pa.int64() for c in _NODE}

    def batches_of(nodes: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for node in nodes:
            held.append(node)
            if len(held) == 8192:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def packed(nodes: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n[i] for n in nodes], kinds[_NODE[i]]) for i in picked], names=columns)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def taken(n: int, whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while n:
                conv, k = held[0], held[1]
                change = np.flatnonzero((np.diff(conv) != 0) | (np.diff(k) != 0)) + 1
                bounds, other = np.append(change, n) if whole else change, int(np.searchsorted(k, k[0], side="right"))
                # a shard ends with its block, or with the conversation that fills it
                there = int(np.searchsorted(bounds, other, side="right"))
                if not there or not (whole or other < n or there >= shard or bounds[there - 1] >= shard_rows):
                    return
                cut = int(bounds[min(there, shard, int(np.searchsorted(bounds, shard_rows)) + 1) - 1])
                yield from batches_of(Shard([held[i][:cut] for i in (0, 2, 3, 4, 5, 6)], int(k[0]) * block).walk())
                held = [c[cut:] for c in held]
                n -= cut

        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(7)]
            held = [np.concatenate(pair) for pair in zip(held, new)] if held else new
            yield from taken(len(held[0]), False)
        if held:
            yield from taken(len(held[0]), True)

    order = ["k", "conv", "pos"]
    dealt = rows.select("conv", "k", "pos", "x", "y", "words", "length").repartitionByRange("k", "conv").sortWithinPartitions(*order)
    kinds_of = ", ".join(f"{c} {'array<long>' if c == 'ends' else 'long'}" for c in columns)
    return dealt.mapInArrow(tidied(walk), kinds_of)


def _prefixes(rows: DataFrame, block: int) -> DataFrame:
    """For every later block of a long conversation the sums of all turns before it, as a row of its own."""
    wide = "decimal(20,0)"
    sums = rows.where(F.col("length") >= block).groupBy("conv", "k").agg(
        *[F.sum(F.col(c).cast(wide)).alias(c) for c in ("x", "y", "words")], F.max("length").alias("length"))
    before = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.lit(str(1 << 64)).cast("decimal(38,0)")

    def wrapped(name: str) -> Column:
        rest = F.pmod(F.sum(name).over(before).cast("decimal(38,0)"), whole)
        return F.when(rest >= F.lit(str(1 << 63)).cast("decimal(38,0)"), rest - whole).otherwise(rest).cast("long").alias(name)

    return sums.select("conv", "k", (F.col("k") * block - 1).alias("pos"), wrapped("x"), wrapped("y"), wrapped("words"),
                       "length").where("k > 0")


def _end_hashes(parts: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256`` of nodes at which conversations end.

    A hash goes over its ids from first to last, so a node's lists meet in one task;
    there they stream by, a shard's at a time.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for *own, ends in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if own != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, ends)).encode())
            yield packed(done)
        if key:
            yield packed([(*key, state.hexdigest())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                          names=[*_KEY, "ends_sha256"])

    lists = parts.where(F.size("ends") > 0).select(*_KEY, "ends", F.col("ends")[0].alias("first"))
    return (lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").select(*_KEY, "ends")
            .mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string"))


def trie(sequences: DataFrame, block: int = BLOCK, shard: int = SHARD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie over :func:`sequences`, as :func:`prefix_trie` tells."""
    rows = stored(sequences.withColumn("k", F.floor(F.col("pos") / block)), "sequences")
    prefixes = stored(_prefixes(rows, block), "prefixes")
    walkable = rows.unionByName(prefixes)
    parts = stored(_walked(walkable, _NODE[:10], block, shard, shard_rows), "trie-parts")
    merged = stored(parts.groupBy(*_KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), *[F.min(c).alias(c) for c in ("pa", "pb", "words", "sum")]),
        "trie-nodes")
    kids = merged.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"))
    nodes = stored(merged.join(kids, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")

    # where a conversation's own nodes begin, and whether its last one is a leaf of its own
    owners = nodes.groupBy("conv").agg(F.min_by(F.col("sum") - F.col("words"), "depth").alias("shared"),
                                       F.max_by((F.col("n_children") == 0).cast("long"), "depth").alias("leaf"))
    ended = parts.where(F.size("ends") > 0).select(F.explode("ends").alias("conv"), "depth", "sum")
    adds = ended.join(owners, "conv", "left").select(
        "conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depth") / block))).alias("k"),
        F.lit(-2).cast("long").alias("pos"), F.coalesce("shared", "sum").alias("x"), F.lit(0).cast("long").alias("y"),
        F.coalesce("leaf", F.lit(0)).alias("words"), F.col("depth").alias("length"))
    sums = (_walked(walkable.unionByName(stored(adds, "trie-adds")), [*_KEY, "leaves", "saved"], block, shard, shard_rows)
            .groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))

    # a parent may have very many children; both sides come from files, so that the join can split it
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                           F.col("conv").alias("parent_conv_id"))
    return (nodes.join(parents, ["depth", "pa", "pb"], "left").join(sums, _KEY).join(_end_hashes(parts), _KEY, "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", stride: int = STRIDE, heads: int = HEADS, block: int = BLOCK, shard: int = SHARD,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    Conversations are ordered and rebuilt as :func:`turns` and :func:`sequences`
    tell: rows without a conversation id are left out, null roles and texts are
    empty, a null turn comes first, and rows that repeat are turns each. A
    conversation left without turns is a member of the root. Without conversations
    there is no node, not even the root. Other columns are not read.
    """
    return trie(sequences(turns(conversations, conv_id, turn, role, text), stride, heads), block, shard, shard_rows)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt ``conversations``; see :func:`prefix_trie` for odd inputs."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def sql(stride: int = STRIDE, heads: int = HEADS) -> str:
    """The same in DuckDB SQL; a prefix is named by the list of its turns' hashes."""
    crc = """xor(list_reduce(flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''),
            lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END,
            CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
    return f"""WITH turns AS MATERIALIZED (
        SELECT conv_id AS conv, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
        FROM (SELECT conv_id, turn, substr(sha256(strlen(r) || ':' || r || t), 1, 32) AS digest,
                  len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS words
              FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
                    WHERE conv_id IS NOT NULL))),
    convs AS MATERIALIZED (
        SELECT conv, conv - conv % {stride} AS base, h, least(h, coalesce(there, 0)) AS taken
        FROM (SELECT conv, {crc} % {heads} AS h FROM (SELECT DISTINCT conv FROM turns))
        LEFT JOIN (SELECT conv AS base, count(*) AS there FROM turns GROUP BY conv) b ON base = conv - conv % {stride}),
    rebuilt AS MATERIALIZED (
        SELECT c.conv, t.pos, digest, words FROM convs c JOIN turns t ON t.conv = c.base AND t.pos <= h
        UNION ALL
        SELECT c.conv, t.pos - h + taken, digest, words FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos > h
        UNION ALL
        SELECT conv, 0, '', 0 FROM convs),
    named AS MATERIALIZED (
        SELECT conv, pos AS depth, words, sha256(array_to_string(list(digest) OVER (PARTITION BY conv ORDER BY pos), ',')) AS key,
            max(pos) OVER (PARTITION BY conv) AS length FROM rebuilt),
    placed AS MATERIALIZED (
        SELECT *, lag(key) OVER (PARTITION BY conv ORDER BY depth) AS parent FROM named),
    nodes AS MATERIALIZED (
        SELECT depth, key, any_value(parent) AS parent, min(conv) AS conv, count(*) AS n, any_value(words) AS words,
            coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (length = depth), '') AS ends
        FROM placed GROUP BY depth, key),
    kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    below AS (
        SELECT p.depth, p.key, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((x.n - 1) * x.words) AS saved
        FROM nodes x LEFT JOIN kids k USING (depth, key) JOIN placed p ON p.conv = x.conv AND p.depth <= x.depth
        GROUP BY p.depth, p.key)
    SELECT n.conv AS conv_id, n.depth AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children,
        n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM nodes n JOIN below b USING (depth, key) LEFT JOIN kids k USING (depth, key)
        LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.parent"""


OP12_SQL = sql()
