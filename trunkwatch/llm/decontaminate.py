"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to ``k = floor(share * n)`` edits.
Cut into k + 1 pieces, at least one piece survives them unchanged. An automaton
finds all exact piece hits in a text in one pass; around each hit, Myers'
bit-parallel distance says whether the whole item is there within k edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table, tidied
from trunkwatch.sources.tables import named

#: Edits per character of an item: pieces then have twelve characters or more, which ordinary text seldom hits.
EDIT_SHARE = 0.08
#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4_000_000

Item = tuple[int, str]


def normalised(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return " ".join((text or "").lower().split())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 neighbouring pieces of n characters, as even as can be."""
    cuts = [n * j // (k + 1) for j in range(k + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(places: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any part of ``text``, end of the first such part).

    ``places`` has, for each character, the bits of the pattern where it stands.
    """
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    best, end = n, 0
    for at, c in enumerate(text, 1):
        equal = places.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rises, falls = down | (full & ~(horizontal | up)), up & horizontal
        if rises & last:
            distance += 1
        elif falls & last:
            distance -= 1
        rises, falls = rises << 1, falls << 1
        up, down = falls & full | (full & ~(vertical | rises)), rises & vertical & full
        if distance < best:
            best, end = distance, at
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], share: float):
        self.items = [(i, t, int(len(t) * share)) for i, t in items]
        self._places = []
        at: dict[str, list[tuple[int, int, int]]] = {}
        for number, (_, t, k) in enumerate(self.items):
            places: dict[str, int] = {}
            for j, c in enumerate(t):
                places[c] = places.get(c, 0) | 1 << j
            self._places.append(places)
            for a, b in pieces(len(t), k):
                at.setdefault(t[a:b], []).append((number, a, b))
        self._automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self._automaton.add_word(piece, where)
        self._automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item id, edits, end in the normalised text) of each item, where it is closest."""
        if not self.items:
            return
        text = normalised(text)
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, where in self._automaton.iter(text):
            for number, _, b in where:
                start = end + 1 - b  # of the item, were there no edit before the piece
                if best.get(number, (1,))[0] == 0 or (number, start) in tried:
                    continue
                tried.add((number, start))
                _, item, k = self.items[number]
                n = len(item)
                if text.startswith(item, max(start, 0)) and start >= 0:
                    found = 0, start + n
                elif k:
                    low = max(0, start - k)
                    edits, upto = myers(self._places[number], n, text[low:start + n + k])
                    found = edits, low + upto
                else:
                    continue
                if found[0] <= k and found < best.get(number, (k + 1, 0)):
                    best[number] = found
        for number, (edits, end) in best.items():
            yield self.items[number][0], edits, end


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: tuple[Item, ...], share: float) -> Matcher:
    """The worker's own matcher; it keeps the last block's."""
    key = items, share
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(items), share)
    return _MATCHERS[key]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[Item, ...]]:
    """The items in blocks of bounded size; those without a character are none."""
    block, held = [], 0
    rows = benchmark.select(named(item_id).cast("long"), named(text).cast("string"))
    for i, t in rows.toLocalIterator():
        t = normalised(t)
        if t:
            if block and held + len(t) > block_chars:
                yield tuple(block)
                block, held = [], 0
            block.append((i, t))
            held += len(t)
    yield tuple(block)


def _search(items: tuple[Item, ...], share: float) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _matcher(items, share)
        for batch in batches:
            rows = [(d, i, e, at) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))
                    for i, e, at in own.find(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 4)],
                                             names=["doc_id", "item_id", "edits", "end_char"])

    return search


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE,
                   block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, end_char`` for each row and each item in its text.

    Texts are compared in lower case with runs of white space as one space. An
    item is in a text if a part of it is within ``floor(share * n)`` edits; the
    row tells the least number, and where the first such part ends. Null and
    empty texts and items match nothing; rows and items that repeat count each;
    empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(named(doc_id).cast("long").alias("d"), named(text).cast("string").alias("t"))
    kind, found = "doc_id long, item_id long, edits long, end_char long", None
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        if found is not None:  # a pass is done before the next block comes to the driver
            found = stored(found, "contaminations")
        hits = rows.mapInArrow(_search(block, share), kind)
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text has no item by the rule of :func:`contaminations`."""

    def clean(items: tuple[Item, ...]) -> Callable:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matcher(items, share)
            for batch in batches:
                free = [next(own.find(t.as_py()), None) is None for t in batch.column(0).field(at).cast(pa.string())]
                yield batch.filter(pa.array(free, pa.bool_()))

        return keep

    columns = docs.columns
    left = docs.select(F.struct(*[named(c) for c in columns]).alias("row"))
    schema, at = left.schema, columns.index(text)
    for number, block in enumerate(_blocks(benchmark, item_id, item_text, block_chars)):
        left = (stored(left, "decontaminated") if number else left).mapInArrow(tidied(clean(block)), schema)
    return left.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
