import json
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from trunkwatch.llm import tokens
from trunkwatch.llm.token_counts import length_histogram, length_report, quantiles, truncated_total
from trunkwatch.llm.tokens import TextEncoder, library_encoder, part_encoder, vocabulary_path

TEXTS = ["", None, " ", "a", " a", "a ", "a  b", "a \n b\n\n c", "tab\tx", "no break   em", "  lead", "it's I'll",
         "x<|endoftext|> y <|endoftext|>", "a" * 5000, " " * 300, "\x1c a \x1f b", "é ü 漢字 🙂 1234 $$$ %%%", "\n", "a.\nB c", "x, y. z,", "a,. b., c.,", "é, 漢. 1, x., ,", "ab. ", ", a", "I'll, we've."]


@pytest.fixture(scope="module")
def own():
    return TextEncoder(part_encoder(vocabulary_path()))


LINED = ["a\nb", "a.\nB c", "a.\n\nB", "x,\ny.\nz", " a\nb", "a\nb ", "\na", "a\n", "a\tb\nc", "a.\nb.\n c", "a\r\nb", "1\n2 3\n.4", "it\n's I\n'll",
         "a\nb<|endoftext|>\nc", "é.\nÉ, é\n漢", "a\x0bb\nc", "<|endo\nftext|>"]


_PARTS, _WHOLE = part_encoder(vocabulary_path()), library_encoder(vocabulary_path())


def whole(texts):
    return library_encoder(vocabulary_path())([t or "" for t in texts])


def through_parts(own, texts):
    found = []
    for _, offsets, ids in own.encode(pa.array(texts, pa.string())):
        found += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    return found


def test_parts_give_the_ids_of_whole_texts(own):
    assert through_parts(own, TEXTS) == whole(TEXTS)


def test_lines_and_parts_with_the_added_token(own):
    texts = [*LINED, *[f"w{i}\nv{i}. x<|endoftext|>{i}" for i in range(3000)], *LINED]
    assert through_parts(own, texts) == whole(texts)


WORDS = ["a", " Ab", "é", " Ünï", "ſt", " ошибка,", "Ё.", "12", " 2024", "9,", " a!!", "it?;", "x&&&", " b***", "c###", "d$$$", "ǅ%%%", "ab:,.!"]


def test_words_and_their_marks_go_by_the_model(monkeypatch):
    made, library = part_encoder(vocabulary_path()), library_encoder(vocabulary_path())
    monkeypatch.setattr(np, "delete", None)  # what the way of joined parts needs
    lengths, ids = made(WORDS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library(WORDS)


def test_other_parts_keep_their_place_among_words():
    parts = ["a", "a'll", " b", "", "漢字", "1a", "a1", " a-b,", "c", "n!\n", "a.b", "½", " ٣", "!!", " 'd", "x<|endoftext|>", "z.", "'s!"]
    lengths, ids = part_encoder(vocabulary_path())(parts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library_encoder(vocabulary_path())(parts)


@pytest.mark.parametrize("change", [{"content": "ab"}, {"content": " a."}, {"prefix": True}, {"pattern": False}])
def test_words_of_other_vocabularies(tmp_path, change):
    told = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    told["added_tokens"][0]["content"] = change.get("content", "<|endoftext|>")
    told["pre_tokenizer"] |= {"add_prefix_space": "prefix" in change, "use_regex": change.get("pattern", True)}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    parts = ["abc", " ab", "x a.", "cab,", "12", " 9!!", "c&c"]
    lengths, ids = part_encoder(str(path))(parts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library_encoder(str(path))(parts)


def test_the_model_gets_many_words_at_once():
    library, calls = tokens._library(vocabulary_path()), []
    spied = SimpleNamespace(model=SimpleNamespace(tokenize=lambda text: calls.append(text) or library.model.tokenize(text)))
    words = [f"{w}{end}" for w in [f" w{chr(97 + i % 26)}{'e' * (i % 7)}" for i in range(500)] for end in ("", "!!")]
    lengths, ids = tokens.word_encoder(spied, *tokens._unmerged(library))([tokens._WORD.fullmatch(w) for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == _WHOLE(words)
    assert len(calls) < len(words) / 20


@pytest.mark.parametrize("change", ["merged", "ignore_merges", "suffix"])
def test_words_that_nothing_keeps_apart(tmp_path, change):
    printed = sorted(tokens._AS_PRINTED.values())
    low = [tokens._AS_PRINTED[b] for b in range(0x20)]
    if change == "suffix":
        printed += [c + "</w>" for c in printed]
    merges = [["a", "b"], *([[c, c] for c in low] if change == "merged" else [])]
    names = ["<|endoftext|>", *printed, *["".join(m) for m in merges], *(["abc"] if change == "ignore_merges" else [])]
    told = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    told["added_tokens"][0]["id"] = 0
    told["model"] |= {"vocab": {name: i for i, name in enumerate(names)}, "merges": merges,
                      "ignore_merges": change == "ignore_merges", "end_of_word_suffix": "</w>" if change == "suffix" else None}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    parts = ["abc", " ab", "x!!", "cab,", "12", " 9!!"]
    lengths, ids = part_encoder(str(path))(parts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library_encoder(str(path))(parts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.from_regex(r"\A ?(?:[A-Za-zªµºÀ-ÖØ-öø-ˁЀ-ҁҊ-ԓ]+|[0-9]+)[!#$%&*,.:;?]*\Z"), max_size=20))
def test_any_words(words):
    lengths, ids = _PARTS(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][:len(words)] == _WHOLE(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .,.,'\n\t\r\x1c  é1$<|endoftext|>"), max_size=30), max_size=5))
def test_any_white_space(own, texts):
    assert through_parts(own, texts) == whole(texts)


def test_histogram_and_its_sums(spark, documents, own):
    texts = TEXTS * 3 + ["word " * n for n in range(1, 3000, 100)]
    lengths = np.array([len(x) for x in whole(texts)])
    histogram = length_histogram(documents(texts, n_tokens="clash", n_docs="clash").repartition(4))
    assert {r.n_tokens: r.n_docs for r in histogram.collect()} == dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    report = length_report(histogram)
    for r in report.collect():
        assert r.docs_longer == (lengths > r.n_tokens).sum() and r.tokens_longer == lengths[lengths > r.n_tokens].sum()
        assert r.total_tokens == lengths.sum() and r.truncated_tokens == np.minimum(lengths, r.n_tokens).sum()
        assert r.share_upto == pytest.approx((lengths <= r.n_tokens).mean())
    for limit in (0, 7, 1500, 10**6):
        row = truncated_total(histogram, limit).first()
        assert (row.kept_tokens, row.n_cut) == (np.minimum(lengths, limit).sum(), (lengths > limit).sum())
    found = {r.share: r.n_tokens for r in quantiles(report, [0.1, 0.5, 1.0]).collect()}
    assert found == {q: np.quantile(lengths, q, method="inverted_cdf") for q in (0.1, 0.5, 1.0)}


def test_empty_table(documents):
    empty = length_histogram(documents([]))
    assert length_report(empty).count() == 0 and truncated_total(empty, 9).first().kept_tokens == 0
