"""BPE encoding by dynamic programming over prefixes, and decoding.

A byte string has one encoding, and every prefix of it has one last token. An
automaton over the vocabulary names all tokens that end at a position; the last
token of that prefix is the one that is compatible with the last token of the
prefix before it. Following the last tokens back from the end gives the ids,
in time linear in the string, with no merging.

Two tokens are compatible if encoding their bytes gives just these two. That is
read off the merges: the latest merges at the border are undone one by one, and
at no time may the border have had a merge of its own that came earlier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import table, text_of, tidied
from trunkwatch.llm.tokens import encoder, flat, vocabulary_path
from trunkwatch.sources.tables import named

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: what a byte-level vocabulary's texts are split by.
SPLIT = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+"
         rf"|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Pieces whose ids, and token pairs whose test, a worker remembers. Decides no result.
_PIECES, _PAIRS = 50_000, 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class Decoder:
    """The bytes of each token of a byte-level vocabulary."""

    def __init__(self, whole: dict):
        vocab = whole["model"]["vocab"]
        special = {a["content"]: a["id"] for a in whole.get("added_tokens", ())}
        back = {c: b for b, c in enumerate(byte_letters())}
        parts = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, made in [*vocab.items(), *special.items()]:
            parts[made] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids; those the vocabulary lacks give none."""
        ids = ids[ids < len(self.lengths)].astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes()


class Bpe:
    """A byte-level vocabulary with its merges."""

    def __init__(self, whole: dict):
        model = whole["model"]
        self._ids: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in whole.get("added_tokens", ())}
        letters = byte_letters()
        self._letter = {b: c for b, c in enumerate(letters)}
        size = max([*self._ids.values(), *self.special.values()]) + 1
        self._rank, self._left, self._right = [-1] * size, [0] * size, [0] * size
        self._pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y, made = self._ids[a], self._ids[b], self._ids[a + b]
            self._pairs[x, y] = rank
            if self._rank[made] < 0:
                self._rank[made], self._left[made], self._right[made] = rank, x, y
        self._compatible: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        reachable = {self._ids[c] for c in letters if c in self._ids}
        for token, made in sorted(self._ids.items(), key=lambda t: self._rank[t[1]]):
            x, y = self._left[made], self._right[made]
            if self._rank[made] >= 0 and x in reachable and y in reachable and self._apart(x, y, self._rank[made]):
                reachable.add(made)
            if made in reachable:
                self._automaton.add_word(token, (made, len(token)))
        self._automaton.make_automaton()
        self._reachable = reachable
        self._sizes = [0] * size
        for token, made in self._ids.items():
            self._sizes[made] = len(token)
        self._split = regex.compile(SPLIT)
        self._specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._pieces: dict[str, tuple[int, ...]] = {}

    def _apart(self, x: int, y: int, before: float = float("inf")) -> bool:
        """Whether no merge earlier than ``before`` goes across the border of tokens x and y."""
        rank, pairs = self._rank, self._pairs
        while True:
            across = pairs.get((x, y))
            if across is not None and across < before:
                return False
            if rank[x] > rank[y]:
                before, x = rank[x], self._right[x]
            elif rank[y] >= 0:
                before, y = rank[y] + 1, self._left[y]  # of equal merges the left one comes first
            else:
                return True

    def compatible(self, x: int, y: int) -> bool:
        pair = x << 32 | y
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) >= _PAIRS:
                self._compatible.clear()
            known = self._compatible[pair] = self._apart(x, y)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that the split leaves whole."""
        letters = piece.encode("utf-8").decode("latin-1").translate(self._letter)
        whole = self._ids.get(letters)
        if whole is not None and whole in self._reachable:
            return (whole,)
        last, upto = [0] * (len(letters) + 1), -1
        for end, (token, size) in self._automaton.iter(letters):  # of one end, the longest first
            if end == upto:
                continue
            start = end + 1 - size
            if not start or self.compatible(last[start], token):
                last[end + 1], upto = token, end
        found, at = [], len(letters)
        while at:
            found.append(last[at])
            at -= self._sizes[last[at]]
        return tuple(reversed(found))

    def _encode_plain(self, text: str) -> list[int]:
        ids, known = [], self._pieces
        for piece in self._split.findall(text):
            found = known.get(piece)
            if found is None:
                if len(known) >= _PIECES:
                    known.clear()
                found = known[piece] = self.encode_piece(piece)
            ids += found
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens written out in it are themselves."""
        if self._specials is None or not self._specials.search(text):
            return self._encode_plain(text)
        ids, at = [], 0
        for match in self._specials.finditer(text):
            ids += self._encode_plain(text[at:match.start()])
            ids.append(self.special[match.group()])
            at = match.end()
        return ids + self._encode_plain(text[at:])


_DECODERS: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    """The worker's own table, kept between tasks."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(_load(path))
    return _DECODERS[path]


def _part_encoder(path: str):
    own = Bpe(_load(path))
    return lambda parts: flat([own.encode(p) for p in parts])


def _encoding(file: str):
    """Batches of (text, row) to batches of (row, ids)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, "prefixes", _part_encoder)
        for batch in batches:
            for first, offsets, ids in own.encode(batch.column(0)):
                raw, ends = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
                packed = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(packed)), packed],
                                                 names=["row", "ids"])
        own.forget()  # the worker may wait for long, and its memory with it

    return encode


def _decoding(file: str):
    """Batches of (row, ids) to batches of (row, ids, decoded)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(file)
        for batch in batches:
            ids, row = batch.column(1), 0
            upto = np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))
            while row < len(ids):  # a few megabytes at once
                done = upto[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(upto, done + (4 << 20), side="right")))
                texts = [own.decode(np.frombuffer(i.as_py(), "<u4")).decode("utf-8", "replace")
                         for i in ids.slice(row, end - row)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), ids.slice(row, end - row), pa.array(texts, pa.string())],
                    names=["row", "ids", "decoded"])
                row = end

    return decode


def _packed(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    packed = docs.select(text_of(text).alias("t"), F.struct(*[named(c) for c in keep]).alias("row"))
    return packed, f"row {packed.schema['row'].dataType.simpleString()}, ids binary"


def bpe_encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns) and ``ids`` of every document.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text has
    none; rows that repeat count each; an empty table gives no rows.
    """
    packed, kinds = _packed(docs, keep, text)
    return packed.mapInArrow(tidied(_encoding(path or vocabulary_path())), kinds)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``row``, ``ids`` and ``decoded``, the text of the ids; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(
        _decoding(path or vocabulary_path()), f"row {kind}, ids binary, decoded string")


def round_trips(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``n_tokens, ids_sha256, decoded_sha256`` of every document.

    Encodes and then decodes what came of it, in the same worker.
    """
    file = path or vocabulary_path()
    encode, decode = _encoding(file), _decoding(file)
    packed, kinds = _packed(docs, keep, text)
    both = packed.mapInArrow(tidied(lambda batches: decode(encode(batches))), kinds + ", decoded string")
    return both.select(*[F.col("row").getField(c).alias(c) for c in keep],
                       (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), ["doc_id"])
