"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model is counted over all documents. A token that looks
disguised (letters mixed with signs or digits, letters repeated or set apart)
becomes a lattice: each sign may stand for itself, for nothing, or for letters
it looks like, repeated letters for one or two, gaps for nothing. The Viterbi
path, the likeliest reading under the language model and the costs of the
channel, takes its place. A logistic model over words and their beginnings
scores the restored text by what is present in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table, text_of, tidied
from trunkwatch.sources.tables import named

#: The letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "{": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs of the channel, in nats.
SUBSTITUTED, DROPPED, COLLAPSED, JOINED, PARTED = 2.0, 3.0, 0.5, 0.2, 6.0
#: Letters of the language model: word border, a to z, any other.
_SYMBOLS = 28
_ORDER = 4
#: Labelled rows of each class that the model is fitted on, and features it may use.
SAMPLE_ROWS = 3000
FEATURES = 4096
#: Toxic rows with a feature for it to be used, and for it to be proof.
_EVIDENCE, _PROOF = 5, 20
#: Log odds of a text without any telling word, at most: the labels' share alone finds no text toxic.
_NO_WORD = -0.05
#: Readings that a worker remembers.
_REMEMBERED = 60_000

_SYMBOL_OF_BYTE = np.zeros(256, np.uint8)
_SYMBOL_OF_BYTE[97:123] = np.arange(1, 27)
_SYMBOL_OF_BYTE[128:] = 27

_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
_ORDINARY, _TRIPLE = f"^[{_LETTERS}]*$", "|".join(c * 3 for c in _LETTERS)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SIGN = "".join(map(re.escape, LOOKS_LIKE))
_DISGUISED = re.compile(rf"(?=.*[^\W\d_])(?:.*[{_SIGN}]|.*([^\W\d_])\1\1|.*[^\W\d_][.\-_*~'·][^\W\d_][.\-_*~'·][^\W\d_])", re.S)
_SINGLE = re.compile(r"^[.\-_*~'·]*([^\W\d_]|[" + _SIGN + r"])[.\-_*~'·,]*$")


def count_characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code, n``: how often each four-letter sequence stands in the lower-cased texts.

    Letters are a to z, one for all others, and one for any stretch of what is
    no letter. There are at most 28 ** 4 codes, however much text is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS ** _ORDER, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                joined = b"\n".join(t.as_buffer().to_pybytes() for t in pc.cast(batch.column(0).slice(at, 256), pa.binary()))
                symbols = _SYMBOL_OF_BYTE[np.frombuffer(b" " + joined + b" ", np.uint8)].astype(np.int64)
                symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
                if len(symbols) >= _ORDER:
                    code = np.zeros(len(symbols) - _ORDER + 1, np.int64)
                    for i in range(_ORDER):
                        code = code * _SYMBOLS + symbols[i:i + len(code)]
                    total += np.bincount(code, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])

    rows = docs.select(F.lower(text_of(text)).alias("t"))
    return rows.mapInArrow(tidied(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Negative log likelihood of a letter after three others, with lower orders mixed in."""

    def __init__(self, counts: np.ndarray):
        shape = (_SYMBOLS,) * _ORDER
        four = counts.reshape(shape).astype(np.float64)
        p = np.full(_SYMBOLS, 1 / _SYMBOLS)
        for order in range(1, _ORDER + 1):
            n = four.sum(axis=tuple(range(_ORDER - order))) if order < _ORDER else four
            kinds = (n > 0).sum(axis=-1, keepdims=True) + 1
            p = (n + kinds * p) / (n.sum(axis=-1, keepdims=True) + kinds)
        self.costs = -np.log(p).reshape(-1).astype(np.float32)

    def cost(self, context: int, symbol: int) -> float:
        return float(self.costs[context * _SYMBOLS + symbol])


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27 if letter.isalpha() else 0


Lattice = list[list[tuple[str, float]]]


def lattice(token: str) -> Lattice:
    """The readings of each stretch of equal characters, with their costs."""
    found: Lattice = []
    for c, run in groupby(token):
        n = len(list(run))
        if c in LOOKS_LIKE:
            found.append([(c * n, 0.0), ("", DROPPED),
                          *((letter * min(n, 2), SUBSTITUTED) for letter in LOOKS_LIKE[c])])
        elif c.isalpha():
            found.append([(c * n, 0.0)] if n < 3 else [(c, COLLAPSED), (c * 2, COLLAPSED)])
        else:
            found.append([(c * n, 0.0), ("", JOINED if c in ".-_*~'·" else DROPPED)])
    return found


def spaced(letters: list[str]) -> Lattice:
    """The lattice of letters that stand apart: gaps are nothing, or part two words."""
    found: Lattice = []
    for i, c in enumerate(letters):
        if i:
            found.append([("", 0.0), (" ", PARTED)])
        found.append([("", DROPPED), *((x, SUBSTITUTED) for x in LOOKS_LIKE[c])] if c in LOOKS_LIKE else [(c, 0.0)])
    return found


def viterbi(model: CharacterModel, steps: Lattice) -> str:
    """The likeliest reading of a lattice; states are the last three letters."""
    space, size = 0, _SYMBOLS ** (_ORDER - 2)
    states: dict[int, tuple[float, tuple | None]] = {space: (0.0, None)}
    for readings in steps:
        after: dict[int, tuple[float, tuple | None]] = {}
        for context, (cost, path) in states.items():
            for reading, channel in readings:
                now, total = context, cost + channel
                for c in reading:
                    symbol = _symbol(c)
                    if symbol or now % _SYMBOLS:  # a stretch of what is no letter counts once
                        total += model.cost(now, symbol)
                        now = now % size * _SYMBOLS + symbol
                if now not in after or total < after[now][0]:
                    after[now] = total, (path, reading)
        states = after
    _, path = min(((cost + (model.cost(c, 0) if c % _SYMBOLS else 0), path) for c, (cost, path) in states.items()),
                  key=lambda x: x[0])
    found = []
    while path:
        path, reading = path
        found.append(reading)
    return "".join(reversed(found))


def looks_disguised(token: str) -> bool:
    return _DISGUISED.match(token) is not None


def restore(model: CharacterModel, text: str) -> str:
    """The text in lower case, with disguised tokens and letters set apart in their likeliest reading."""
    tokens, found, at = [t for t in _SPACE.split(text.lower()) if t], [], 0
    while at < len(tokens):
        upto = at
        while upto < len(tokens) and _SINGLE.match(tokens[upto]):
            upto += 1
        if upto - at >= 3:
            found.append(viterbi(model, spaced([_SINGLE.match(t).group(1) for t in tokens[at:upto]])))
            at = upto
        else:
            found.append(viterbi(model, lattice(tokens[at])) if looks_disguised(tokens[at]) else tokens[at])
            at += 1
    return " ".join(found)


def features(restored: str) -> set[str]:
    """The words of a restored text, and their beginnings of four to six letters."""
    found = set()
    for word in _WORDS.findall(restored):
        found.add(word + "$")
        found.update(word[:n] for n in (4, 5, 6) if len(word) > n)
    return found


class Reader:
    """Features of the texts of a batch, each distinct token restored once."""

    def __init__(self, model: CharacterModel, wanted: dict[str, int] | None = None):
        self._model, self._wanted = model, wanted
        self._known: dict[str, tuple] = {}

    def _of(self, restored: str) -> tuple:
        found = features(restored)
        if self._wanted is None:
            return tuple(found)
        return tuple(self._wanted[f] for f in found if f in self._wanted)

    def _token(self, token: str) -> tuple:
        found = self._known.get(token)
        if found is None:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            read = viterbi(self._model, lattice(token)) if looks_disguised(token) else token
            found = self._known[token] = self._of(read)
        return found

    def _may_tell(self, tokens: pa.Array) -> np.ndarray:
        """False for ordinary words of which neither the whole nor a beginning is wanted."""
        if self._wanted is None:
            return np.ones(len(tokens), bool)
        word = pc.ascii_rtrim(tokens, characters=",.")
        ordinary = pc.and_not(pc.match_substring_regex(word, _ORDINARY), pc.match_substring_regex(word, _TRIPLE))
        wanted = pa.array(list(self._wanted), pa.string())
        hit = pc.is_in(pc.binary_join_element_wise(word, "$", ""), value_set=wanted)
        for n in (4, 5, 6):
            hit = pc.or_(hit, pc.is_in(pc.utf8_slice_codeunits(word, 0, n), value_set=wanted))
        return pc.or_(hit, pc.invert(ordinary)).to_numpy(zero_copy_only=False)

    def texts(self, texts: pa.Array) -> Iterator[set]:
        """The features present in each text."""
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        row = 0
        upto = np.cumsum(pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64))
        while row < len(lower):
            done = upto[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(upto, done + (2 << 20), side="right")))
            yield from self._slice(pa.concat_arrays([lower.slice(row, end - row)]))
            row = end

    def _slice(self, lower: pa.Array) -> Iterator[set]:
        lists = pc.ascii_split_whitespace(lower)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        tokens, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        of_token: list[tuple] = [()] * len(tokens)
        for i in np.flatnonzero(self._may_tell(coded.dictionary)):
            of_token[i] = self._token(tokens[i])
        telling = np.fromiter(map(bool, of_token), bool, len(tokens))
        single = np.fromiter((len(t) < 8 and _SINGLE.match(t) is not None for t in tokens), bool, len(tokens))
        found: list[set] = [set() for _ in range(len(lower))]
        apart = np.flatnonzero(single[codes])
        new = np.ones(len(apart), bool)  # letters of a run follow one another in one text
        new[1:] = (np.diff(apart) > 1) | np.isin(apart[1:], offsets)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(apart)]]))
        loose = np.ones(len(codes), bool)
        for start, size in zip(apart[starts[sizes >= 3]], sizes[sizes >= 3]):
            loose[start:start + size] = False
            letters = [_SINGLE.match(tokens[c]).group(1) for c in codes[start:start + size]]
            doc = int(np.searchsorted(offsets, start, side="right")) - 1
            found[doc].update(self._of(viterbi(self._model, spaced(letters))))
        for at in np.flatnonzero(telling[codes] & loose):
            found[int(np.searchsorted(offsets, at, side="right")) - 1].update(of_token[codes[at]])
        return iter(found)


class Scorer:
    """A logistic model over present features.

    A feature that was seen often and in next to no clean row is proof by itself:
    ``proof`` has the share of toxic rows among those with it, and the score is
    at least that.
    """

    def __init__(self, weights: dict[str, float], bias: float, proof: dict[str, float] | None = None):
        self.names = {f: i for i, f in enumerate(weights)}
        self.weights, self.bias = np.array(list(weights.values()), np.float64), bias
        self.proof = np.array([(proof or {}).get(f, 0.0) for f in weights])

    def score(self, present: set[int]) -> float:
        at = list(present)
        z = self.bias + float(self.weights[at].sum())
        return max(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), float(self.proof[at].max(initial=0.0)))


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """The language model of all documents; its table has a fixed size."""
    total = np.zeros(_SYMBOLS ** _ORDER, np.int64)
    for code, n in count_characters(docs, text).toLocalIterator():
        total[code] = n
    return CharacterModel(total)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(named(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _present(rows: DataFrame, model: CharacterModel, wanted: dict[str, int]) -> DataFrame:
    """``doc_id, mark, found``: the numbers of the wanted features in every text of (doc_id, mark, t)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, wanted)
        for batch in batches:
            found = [sorted(f) for f in reader.texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "mark", "found"])

    return rows.mapInArrow(tidied(read), "doc_id long, mark long, found array<int>")


def fit(docs: DataFrame, labels: DataFrame, model: CharacterModel, text: str = "text", doc_id: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> tuple[Scorer, DataFrame]:
    """The scorer, and ``doc_id, mark, found``, the numbers of its features in every document.

    A label speaks for one text: of rows that share its id, the one with the least
    hash (``mark``) teaches. At most ``sample_rows`` labelled ids of each class
    propose features and fit the weights; which, is decided by a hash of their id.
    All labelled ids then say how often a feature goes with a toxic text: copies of one text in the sample make
    its words look telling, which they are not elsewhere. Rows held out take part in
    neither. An id with several labels is toxic if one says so. Without rows of both
    classes no feature counts, and a text without features that count scores below one
    half, however many labels are toxic.
    """
    known = stored(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
                   .where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                   .where(~held_out()), "toxicity-labels")
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for c in (0, 1)]
    # two times sample_rows ids at most
    sample = F.broadcast(stored(chosen[0].unionByName(chosen[1]), "toxicity-chosen"))
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), text_of(text).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("mark"), "t")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for label, found in zip(batch.column(1).to_pylist(), reader.texts(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([list(found)], pa.list_(pa.string()))],
                                                 names=["toxic", "found"])

    drawn = stored(rows.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("t", "mark").alias("t")).select("t", "toxic")
                   .mapInArrow(tidied(propose), "toxic int, found array<string>"), "toxicity-sample")
    n = {r.toxic: r.n for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    ratio = ((F.col("t") + .5) / (n_toxic + 1)) / ((F.col("c") + .5) / (n_clean + 1))
    toxic_rows, clean_rows = F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    proposed = (drawn.select("toxic", F.explode("found").alias("f")).groupBy("f").agg(toxic_rows, clean_rows)
                .where((F.col("t") >= _EVIDENCE) & (ratio >= 3)).orderBy((F.col("t") * F.log(ratio)).desc(), "f").limit(FEATURES))
    names = [r.f for r in proposed.select("f").collect()] if n_toxic and n_clean else []
    present = stored(_present(rows, model, {f: i for i, f in enumerate(names)}), "toxicity-present")
    # the sample may hold more toxic rows, by share, than there are
    odds = float(np.log((total.get(1, 0) + .5) / (total.get(0, 0) + .5)))
    shift = odds - float(np.log((n_toxic + .5) / (n_clean + .5)))
    taught = stored(present.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("found", "mark").alias("found")),
                    "toxicity-taught")
    each = (taught.select("toxic", F.explode("found").alias("f"))
            .groupBy("f").agg(toxic_rows, clean_rows).collect())  # a row per feature
    share = {r.f: r.t / (r.t + r.c + 2) for r in each if r.t >= _EVIDENCE}
    proof = {names[r.f]: share[r.f] for r in each if r.t >= _PROOF and share[r.f] >= .9}
    used = {f for f, p in share.items() if p >= .5}
    fitted = taught.join(sample.select("doc_id"), "doc_id").select("toxic", "found").where(F.size("found") > 0).collect()
    rows_with = [(r.toxic, [f for f in r.found if f in used]) for r in fitted]
    weights, bias = _logistic(names, [r for r in rows_with if r[1]], n_toxic, n_clean) if used else ({}, odds - shift)
    return Scorer({f: weights.get(f, 0.0) for f in names}, min(bias + shift, _NO_WORD), proof), present


def _logistic(names: list[str], present: list[tuple[int, list[int]]], n_toxic: int, n_clean: int) -> tuple[dict[str, float], float]:
    """Weights by full gradient steps with a penalty; classes weigh as they occur, no feature counts against."""
    y = np.array([t for t, _ in present], np.float64)
    rows = np.repeat(np.arange(len(present)), [len(f) for _, f in present])
    columns = np.array([c for _, f in present for c in f], np.int64)
    bare_toxic, bare_clean = n_toxic - int(y.sum()), n_clean - int((1 - y).sum())
    w, bias = np.zeros(len(names)), 0.0
    step_w, step_b = np.full(len(names), 1e-8), 1e-8
    total = n_toxic + n_clean
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[columns], len(present)), -30, 30)))
        p_bare = 1 / (1 + np.exp(-bias))
        g = np.bincount(columns, (p - y)[rows], len(names)) / total + 1e-4 * w
        g_b = (float((p - y).sum()) + p_bare * bare_clean + (p_bare - 1) * bare_toxic) / total
        step_w, step_b = step_w + g * g, step_b + g_b * g_b
        w, bias = np.maximum(0, w - .3 * g / np.sqrt(step_w)), bias - .3 * g_b / np.sqrt(step_b)
    return dict(zip(names, w.tolist())), float(bias)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Only the text decides the score. A null text is empty, and an empty text
    scores as one without any telling word; rows that repeat score alike; an
    empty table gives no rows.
    """
    scorer, present = fit(docs, labels, character_model(docs, text), text, doc_id)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [scorer.score(set(found)) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = present.select("doc_id", "found").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` does not predict toxic, with all their columns, of any names.

    Without labels, or with labels of one class, all rows stay. Null and empty texts
    stay; repeated rows stay or go together; very long texts are read whole.
    """
    model, columns = character_model(docs, text), docs.columns
    scorer, _ = fit(docs, labels, model, text, doc_id)
    packed, at = docs.select(F.struct(*[named(c) for c in columns]).alias("row")), columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, scorer.names)
        for batch in batches:
            texts = batch.column(0).field(at).cast(pa.string())
            yield batch.filter(pa.array([scorer.score(found) < 0.5 for found in reader.texts(texts)], pa.bool_()))

    kept = packed.mapInArrow(tidied(keep), packed.schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])


def deobfuscated(docs: DataFrame, model: CharacterModel, text: str = "text") -> DataFrame:
    """``docs`` with its text in its likeliest reading."""

    @F.pandas_udf("string")
    def read(texts):
        return texts.map(lambda t: restore(model, t))

    return docs.withColumn(text, read(text_of(text)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
