"""Encoding whole texts through a dictionary of their words.

The byte-level pattern never lets a token cross a single space between two
characters that are not white space, except that the space goes with what
follows, nor from a letter to a comma or period that ends such a part. So a text
is cut there, each distinct part is encoded once (with its space), and the ids of
the parts are put together by numpy. What encodes the parts is a parameter. A line
end between two characters that are not white space is a token of its own, so
parts are cut there too.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"

#: Parts that one worker remembers; beyond that it forgets those met once. Decides no result.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once, a longer text alone.
_AT_ONCE = 4 << 20

_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_OUTER_SPACE = f"^[{_SPACE}]|[{_SPACE}]$|^$"
_MARKS = [",", "."]
_LINES = f"^[^{_SPACE}]+(\n[^{_SPACE}]+)+$"
_MARKED = r"\p{L}[,.]$"
_INNER_BREAK = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(path: str):
    """The tokenizers library's own of this file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _one_by_one(tokenizer) -> Callable[[list[str]], list[list[int]]]:
    return lambda parts: [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """The tokenizers library's encoding of many short texts, without truncation and padding."""
    return _one_by_one(_library(path))


#: Parts that the library encodes as one text.
_JOINED = 2048


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each part, all ids)"""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))


#: Letters of blocks that all versions of the pattern know, and marks that no contraction begins with.
_LETTERS, _ENDS = "A-Za-zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1\u0400-\u0481\u048a-\u0513", "!#$%&*,.:;?"
#: A part that the pattern cuts in two at most: a word or number, with or without a space, and the marks after it.
_WORD = re.compile(f"( ?(?:[{_LETTERS}]+|[0-9]+))([{_ENDS}]+)?")
_OF_WORDS = re.compile(f"[ {_LETTERS}0-9{_ENDS}]*")
#: Words and marks that the model gets at once. Decides no result.
_WORDS_AT_ONCE = 64
#: What stands for each byte in a byte-level vocabulary.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_PRINTED = {b: chr(b) for b in _PRINTED} | {
    b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(0x100)) - set(_PRINTED)))}


def _by_model_alone(tokenizer, added: str) -> bool:
    """Whether nothing but the byte-level pattern and the merges decides the ids of a word and its marks."""
    cut, model = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}, tokenizer.model
    return (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and tokenizer.normalizer is None and type(model).__name__ == "BPE" and not _OF_WORDS.fullmatch(added)
            and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges))


def _unmerged(tokenizer) -> tuple[str, int] | None:
    """A character that no word has and no merge takes, as what a merge makes is in the vocabulary; and its id."""
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    merged = set().union(*(token for token in vocabulary if len(token) > 1))
    return next(((chr(b), vocabulary[_AS_PRINTED[b]]) for b in range(0x20)
                 if _AS_PRINTED[b] in vocabulary and _AS_PRINTED[b] not in merged), None)


def word_encoder(tokenizer, apart: str, number: int) -> Callable[[list[re.Match]], tuple[np.ndarray, np.ndarray]]:
    """The ids of parts that ``_WORD`` matches, by the library's model alone. ``apart`` keeps
    words apart that the model gets at once: no merge goes over it, and its own id is dropped."""
    tokenize, id_of = tokenizer.model.tokenize, attrgetter("id")

    def encode(found: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [piece for m in found for piece in m.groups() if piece]
        ids = [np.zeros(0, np.uint32)]
        for at in range(0, len(pieces), _WORDS_AT_ONCE):
            # one more at the end of each piece
            text = apart.join([*pieces[at:at + _WORDS_AT_ONCE], ""])
            tokens = tokenize(text.encode().decode("latin1").translate(_AS_PRINTED))
            ids.append(np.fromiter(map(id_of, tokens), np.uint32, len(tokens)))
        all_ids = np.concatenate(ids)
        end = all_ids == number
        ends = np.concatenate([[0], np.cumsum(~end)[end]])
        # a word with marks has two pieces
        upto = np.cumsum(np.fromiter((2 if m[2] else 1 for m in found), np.int64, len(found)))
        return np.diff(ends[upto], prepend=0), all_ids[~end]

    return encode


def part_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """The library's ids of many parts, those of words from its model, the others encoded
    together with an added token between them.

    An added token is cut out before anything else, so parts keep their own ids. That
    holds where there is one such token that no end of itself begins; parts that
    hold it, and vocabularies without it, are encoded part by part.
    """
    tokenizer = _library(path)
    apart, added = _one_by_one(tokenizer), tokenizer.get_added_tokens_decoder()
    (number, token), = added.items() if len(added) == 1 else [(0, None)]
    plain = token is not None and not (token.lstrip or token.rstrip or token.single_word or token.normalized)
    if not plain or any(token.content.startswith(token.content[i:]) for i in range(1, len(token.content))):
        return lambda parts: flat(apart(parts))
    between = token.content

    def joined(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(parts), _JOINED):
            some = parts[at:at + _JOINED]
            text = between.join(some)
            if text.count(between) == len(some) - 1:
                found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(found == number)
                lengths.append(np.diff(cuts, prepend=-1, append=len(found)) - 1)
                ids.append(np.delete(found, cuts))
            else:
                own = flat(apart(some))
                lengths.append(own[0])
                ids.append(own[1])
        return np.concatenate(lengths), np.concatenate(ids)

    unmerged = _unmerged(tokenizer) if _by_model_alone(tokenizer, between) else None
    if not unmerged:
        return joined
    of_words = word_encoder(tokenizer, *unmerged)

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(_WORD.fullmatch, parts))
        words = np.fromiter(map(bool, found), bool, len(parts))
        lengths = np.zeros(len(parts), np.int64)
        lengths[words], of_word = of_words([m for m in found if m])
        lengths[~words], of_other = joined([p for p, m in zip(parts, found) if not m])
        ids, from_word = np.empty(len(of_word) + len(of_other), np.uint32), np.repeat(words, lengths)
        ids[from_word], ids[~from_word] = of_word, of_other
        return lengths, ids

    return encode


class TextEncoder:
    """Ids of whole texts from an encoder of their parts, which gives their numbers of ids and all ids."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode
        self.forget()

    def forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._starts = np.zeros(0, np.int64)
        self._lengths = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)
        self._met = np.zeros(0, np.uint8)

    def _forget_rare(self, parts: list[str]) -> None:
        """Keeps what was met more than once, unless that is half of all, and what is needed now."""
        often, needed = self._met > 1, set(parts)
        if 2 * int(often.sum()) > REMEMBERED:
            often[:] = False
        kept = [(p, s) for p, s in self._slots.items() if often[s] or p in needed]
        slots = np.fromiter((s for _, s in kept), np.int64, len(kept))
        starts, lengths = self._starts[slots], self._lengths[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        ids = self._ids[at]
        self.forget()
        self._slots = {p: i for i, (p, _) in enumerate(kept)}
        self._starts, self._lengths, self._ids = ends - lengths, lengths, ids
        self._met = np.ones(len(kept), np.uint8)
        if len(self._slots) + len(parts) > REMEMBERED:
            self.forget()

    def _slots_of(self, parts: list[str]) -> np.ndarray:
        known = self._slots
        slots = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            new = list(dict.fromkeys([parts[i] for i in missing]))
            if len(known) + len(new) > REMEMBERED and known:
                self._forget_rare(parts)
                return self._slots_of(parts)
            lengths, found = self._encode(new)
            starts = len(self._ids) + np.cumsum(lengths) - lengths
            first = len(known)
            known.update(zip(new, range(first, first + len(new))))
            self._starts = np.concatenate([self._starts, starts])
            self._lengths = np.concatenate([self._lengths, lengths])
            self._ids = np.concatenate([self._ids, found])
            self._met = np.concatenate([self._met, np.zeros(len(new), np.uint8)])
            slots[missing] = (np.arange(first, first + len(new)) if len(new) == len(missing)  # none comes twice
                              else [known[parts[i]] for i in missing])
        self._met[slots] = np.minimum(self._met[slots], 2) + 1
        return slots

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        parts = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        coded = parts.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        loose = pc.match_substring_regex(words, _OUTER_SPACE).to_numpy(zero_copy_only=False)
        # the first part of a text has no space before it
        texts_here = offsets[:-1]
        first, where = np.unique(codes[texts_here], return_inverse=True)
        codes[texts_here] = len(words) + where
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(
            np.concatenate([loose, loose[first]])[codes]), side="right") - 1)
        keys, starts, sizes = _pieces_of(words, first)
        # from parts to the pieces they are cut into
        lengths = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        codes = starts[1][np.repeat(starts[0][codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        offsets = ends[offsets]
        pieces: dict[int, list[str]] = {}
        for row in odd:
            text = texts[int(row)].as_py()
            cut = _INNER_BREAK.split(text) if text else []
            pieces[int(row)] = [p if i == 0 else " " + p for i, p in enumerate(cut)]
        extra = list(dict.fromkeys(p for cut in pieces.values() for p in cut))
        place = {p: len(keys) + i for i, p in enumerate(extra)}
        if pieces:
            runs, last = [], 0
            sizes = np.diff(offsets)
            for row, cut in pieces.items():
                runs += [codes[last:offsets[row]], np.array([place[p] for p in cut], np.int64)]
                last = offsets[row + 1]
                sizes[row] = len(cut)
            codes = np.concatenate([*runs, codes[last:]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        keys += extra
        there = np.zeros(len(keys), bool)
        there[codes] = True
        slots = self._slots_of([keys[u] for u in np.flatnonzero(there)])[(np.cumsum(there) - 1)[codes]]
        lengths = self._lengths[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self._starts[slots] - ends[:-1], lengths) + np.arange(ends[-1])
        return ends[offsets], self._ids[at]

    def encode(self, texts: pa.Array) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, token offsets of its rows, ids) for slices of ``texts`` in order; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        row = 0
        while row < len(texts):
            done = upto[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(upto, done + _AT_ONCE, side="right")))
            offsets, ids = self._encode_slice(pa.concat_arrays([texts.slice(row, end - row)]))
            yield row, offsets, ids
            row = end


def _pieces_of(words: pa.Array, first: np.ndarray) -> tuple[list[str], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(keys, (starts, pieces), sizes): the pieces of each word after a space, and then of the words
    numbered in ``first`` without one, as numbers of keys.

    A word is cut at its line ends, and a mark after a letter is a piece of its own,
    with no space before it.
    """
    n = len(words)
    lined = np.flatnonzero(pc.match_substring_regex(words, _LINES).to_numpy(zero_copy_only=False))
    cut = pc.split_pattern(words.take(pa.array(lined)), "\n")
    n_lines = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    stems = pa.concat_arrays([words, cut.flatten(), pa.array(["\n"], words.type)])
    marked = pc.match_substring_regex(stems, _MARKED)
    marks = pc.if_else(marked, pc.index_in(pc.utf8_slice_codeunits(stems, -1), value_set=pa.array(_MARKS, stems.type)), -1)
    stems = pc.if_else(marked, pc.utf8_slice_codeunits(stems, 0, -1), stems)
    marks = marks.to_numpy(zero_copy_only=False).astype(np.int64)
    # the stems of each word, line ends between lines
    size = np.ones(n, np.int64)
    size[lined] = 2 * n_lines - 1
    start = np.cumsum(size) - size
    stem = np.full(int(size.sum()), len(stems) - 1)
    whole = np.ones(n, bool)
    whole[lined] = False
    stem[start[whole]] = np.flatnonzero(whole)
    line = np.arange(int(n_lines.sum())) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    stem[np.repeat(start[lined], n_lines) + 2 * line] = n + np.arange(len(line))
    # the words of ``first`` once more at the end
    again = np.repeat(start[first], size[first]) + np.arange(int(size[first].sum())) - np.repeat(
        np.cumsum(size[first]) - size[first], size[first])
    stem, spaced = np.concatenate([stem, stem[again]]), np.zeros(len(stem) + len(again), bool)
    spaced[start] = True
    size = np.concatenate([size, size[first]])
    # a key for each stem with a space and each without, then the marks
    after, bare = np.unique(stem[spaced]), np.unique(stem[~spaced])
    texts = pa.concat_arrays([pc.binary_join_element_wise(" ", stems.take(pa.array(after)), ""), stems.take(pa.array(bare))])
    coded = texts.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    key_of = np.empty(len(stem), np.int64)
    key_of[spaced] = number[np.searchsorted(after, stem[spaced])]
    key_of[~spaced] = number[len(after) + np.searchsorted(bare, stem[~spaced])]
    mark = marks[stem]
    at = np.flatnonzero(mark >= 0)
    pieces = np.insert(key_of, at + 1, len(keys) + mark[at])
    ends = np.cumsum(size)
    ends += np.searchsorted(at, ends)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return keys + _MARKS, (starts, pieces), ends - starts


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, kind: str, make: Callable[[str], Callable] = part_encoder) -> TextEncoder:
    """The worker's own encoder of this vocabulary, kept between tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(make(path))
    return _ENCODERS[path, kind]
