"""A wavelet matrix of token ids in one compressed image.

Plane by plane from the highest bit, the sequence is stably divided into those
with a 0 and those with a 1. The planes with a directory of ones per block
answer: the token at a position, the number of occurrences of a token up to a
position, and the position of its k-th occurrence. An image also holds the ids
and lengths of the documents whose tokens it has.

Layout, little endian: ``TWM1``, number of documents and of tokens (u64 each),
number of planes (u8); then sections, each its length (u64) and a zstd frame:
document ids (i64), missing ids (u8), lengths (i64), and per plane the number of
zeros (u64) followed by the bits (u64 words).
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"TWM1"
_HEAD = struct.Struct("<4sQQB")
_WORDS = 8  # 64-bit words of a rank block


def _narrow(bits: int) -> type:
    """The type that moves the fewest bytes."""
    return np.uint16 if bits <= 16 else np.uint32


def encode_shard(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The image of the documents' tokens, which follow one another in ``tokens``."""
    packer = zstandard.ZstdCompressor(level=1)
    bits = max(1, int(tokens.max(initial=0)).bit_length())
    sections = [np.array([i or 0 for i in doc_ids], np.int64).tobytes(),
                np.array([i is None for i in doc_ids], np.uint8).tobytes(),
                np.asarray(lengths, np.int64).tobytes()]
    rest = tokens.astype(_narrow(bits))
    for bit in range(bits - 1, -1, -1):
        one = rest & rest.dtype.type(1 << bit) != 0
        packed = np.packbits(one, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
        rest = np.concatenate([np.compress(~one, rest), np.compress(one, rest)])
        sections.append(struct.pack("<Q", len(one) - int(one.sum())) + packed.tobytes())
    image = [_HEAD.pack(MAGIC, len(doc_ids), len(tokens), bits)]
    for section in sections:
        frame = packer.compress(section)
        image += [struct.pack("<Q", len(frame)), frame]
    return b"".join(image)


class Shard:
    """Reads one image; planes are unpacked when they are first needed."""

    def __init__(self, image: bytes):
        magic, n_docs, self.n_tokens, self.bits = _HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, self._frames = _HEAD.size, []
        for _ in range(3 + self.bits):
            size, = struct.unpack_from("<Q", image, at)
            self._frames.append(image[at + 8:at + 8 + size])
            at += 8 + size
        ids, missing, lengths = (self._section(i) for i in range(3))
        self.doc_ids = [None if m else int(i) for i, m in zip(np.frombuffer(ids, np.int64), missing)]
        self.lengths = np.frombuffer(lengths, np.int64)
        self._planes: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def _section(self, number: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._frames[number])

    def _plane(self, level: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(zeros, words, ones before each block) of a plane."""
        if level not in self._planes:
            raw = self._section(3 + level)
            words = np.frombuffer(raw, np.uint64, offset=8)
            words = np.concatenate([words, np.zeros(_WORDS - len(words) % _WORDS, np.uint64)])
            ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(ones)])
            self._planes[level] = struct.unpack_from("<Q", raw)[0], words, before
        return self._planes[level]

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of the plane before each position."""
        _, words, before = self._plane(level)
        block = at // (64 * _WORDS)
        found = before[block]
        inside = at - block * (64 * _WORDS)
        for w in range(_WORDS):
            n = np.clip(inside - 64 * w, 0, 64).astype(np.uint64)
            mask = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % np.uint64(64))) - np.uint64(1))
            found = found + np.bitwise_count(words[np.minimum(block * _WORDS + w, len(words) - 1)] & mask)
        return found

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        words = self._plane(level)[1]
        return (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1

    def access(self, at) -> np.ndarray:
        """The tokens at some positions."""
        at = np.asarray(at, np.int64)
        token = np.zeros(at.shape, np.uint32)
        for level in range(self.bits):
            one, rank = self._bit(level, at), self._rank1(level, at)
            token = (token << np.uint32(1)) | one
            at = np.where(one, self._plane(level)[0] + rank, at - rank)
        return token

    def rank(self, token: int, upto) -> np.ndarray:
        """How often ``token`` occurs before each position."""
        end = np.asarray(upto, np.int64)
        if token >> self.bits:
            return np.zeros(end.shape, np.int64)
        start = np.zeros(end.shape, np.int64)
        for level in range(self.bits):
            zeros, ones = self._plane(level)[0], (self._rank1(level, start), self._rank1(level, end))
            if token >> (self.bits - 1 - level) & 1:
                start, end = zeros + ones[0], zeros + ones[1]
            else:
                start, end = start - ones[0], end - ones[1]
        return end - start

    def count(self, token: int) -> int:
        return int(self.rank(token, self.n_tokens))

    def select(self, token: int, k) -> np.ndarray:
        """Positions of the occurrences numbered ``k`` (from 0)."""
        k = np.asarray(k, np.int64)
        low, high = np.zeros(k.shape, np.int64), np.full(k.shape, self.n_tokens, np.int64)
        while np.any(low < high):  # the first position up to which there are k + 1
            middle = (low + high) // 2
            enough = self.rank(token, np.minimum(middle + 1, self.n_tokens)) > k
            open_ = low < high
            low, high = np.where(open_ & ~enough, middle + 1, low), np.where(open_ & enough, middle, high)
        return low

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def tokens(self) -> np.ndarray:
        """All tokens in order: the divisions are undone from the lowest plane up."""
        kind = _narrow(self.bits)
        ids = np.zeros(self.n_tokens, kind)
        for level in range(self.bits - 1, -1, -1):
            raw = self._section(3 + level)
            one = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=self.n_tokens, bitorder="little") == 1
            zeros, = struct.unpack_from("<Q", raw)
            below, ids = ids, np.empty_like(ids)
            ids[np.flatnonzero(~one)] = below[:zeros]
            ids[np.flatnonzero(one)] = below[zeros:] | kind(1 << (self.bits - 1 - level))
        return ids.astype(np.uint32)
