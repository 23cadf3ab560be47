import random
from collections import Counter

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from lexiloom.functions.bpe import BpeCoder
from lexiloom.functions.text import PRETOKEN, byte_alphabet, py_to_bytes_alphabet, pretokens, to_bytes_alphabet
from lexiloom.operators import bpe, words
from tests.conftest import rows

_SPLIT = regex.compile(PRETOKEN.replace(r"\x{85}", r"\x85"))
TEXTS = ["  नेपाली x1, é", "aaa aaa ab", "", None, "line\n\nnext  word", "日本語 텍스트 x"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, "en" if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")


def test_pretokens_join_to_the_text(spark):
    got = docs(spark).select("text", pretokens("text").alias("p")).collect()
    pattern = regex.compile(PRETOKEN.replace(r"\x{85}", r"\x85"))
    for r in got:
        assert r.p == (None if r.text is None else pattern.findall(r.text))
        assert r.text is None or "".join(r.p) == r.text
    assert got[0].p[:2] == ["  ", "नेपाली"]


def test_byte_alphabet(spark):
    assert len(set(byte_alphabet())) == 256
    got = docs(spark).where("text is not null").select("text", to_bytes_alphabet("text").alias("b")).collect()
    assert all(r.b == py_to_bytes_alphabet(r.text) for r in got)


def test_pairs_overlap_and_merge_without_overlap(spark):
    w = words.byte_words(spark.createDataFrame([("aaa", 2), ("b", 5)], "word string, freq long"))
    assert rows(words.pair_frequencies(w)) == [("a", "a", 4)]
    assert rows(words.unigram_candidates(w)) == [("b", 5)]
    merged = words.merge_pair(w, "a", "a").select("word", words.symbols().alias("s"))
    assert rows(merged) == [("aaa", ["aa", "a"]), ("b", ["b"])]


def test_top_pair_breaks_ties_by_code_point_with_null_group(spark):
    pairs = spark.createDataFrame([(None, "b", "a", 3), (None, "a", "z", 3), ("x", "q", "r", 1)], "lang string, left string, right string, freq long")
    assert rows(words.top_pairs(pairs, "lang")) == [("x", "q", "r", 1), (None, "a", "z", 3)]


def naive_train(texts, size):
    pattern = regex.compile(PRETOKEN.replace(r"\x{85}", r"\x85"))
    model = bpe.BpeModel()
    freq = Counter(w for t in texts if t for w in pattern.findall(t))
    splits = {w: list(py_to_bytes_alphabet(w)) for w in freq}
    while len(model.vocab) < size:
        count = Counter()
        for w, s in splits.items():
            for p in zip(s, s[1:]):
                count[p] += freq[w]
        if not count:
            break
        a, b = min(count, key=lambda p: (-count[p], model.vocab[p[0]], model.vocab[p[1]]))
        model.add(a, b)
        for w, s in splits.items():
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            splits[w] = out
    return model


def test_training_equals_a_naive_one(spark):
    texts = ["the cat sat on the mat", "the cats sat", "a mat, a cat", None, ""]
    size = len(bpe.base_vocabulary()) + 12
    got, want = bpe.train(docs(spark, texts), size), naive_train(texts, size)
    assert got.merges == want.merges and got.vocab == want.vocab


def test_training_on_nothing(spark):
    assert bpe.train(docs(spark, ["", None]), 500).merges == []


@pytest.mark.parametrize("fetch", [3, 512])
def test_training_on_random_words_equals_a_naive_one(spark, monkeypatch, fetch):
    monkeypatch.setattr(bpe, "FETCH", fetch)
    rng = random.Random(fetch)
    texts = [" ".join("".join(rng.choice("aabbcde") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(12)]
    size = len(bpe.base_vocabulary()) + (25 if fetch < 10 else 150)
    got, want = bpe.train(docs(spark, texts), size), naive_train(texts, size)
    assert got.merges == want.merges and got.vocab == want.vocab


def naive_continue(texts, base, size):
    coder = BpeCoder([(k, a, b) for k, (a, b) in enumerate(base.merges)])
    freq = Counter(w for t in texts if t for w in _SPLIT.findall(t))
    splits = {w: coder.split(py_to_bytes_alphabet(w)) for w in freq}
    singles = Counter()
    for w, x in splits.items():
        if len(x) == 1:
            singles[x[0]] += freq[w]
    units, tokens = [], {}
    while len(tokens) < size:
        pairs = Counter()
        for w, x in splits.items():
            for pair in zip(x, x[1:]):
                pairs[pair] += freq[w]
        ranked = sorted([(-n, (s, "")) for s, n in singles.items()] + [(-n, p) for p, n in pairs.items()])
        if not ranked:
            break
        a, b = ranked[0][1]
        tokens[a + b] = None
        units.append((a, b) if b else (a,))
        if not b:
            del singles[a]
            continue
        for w, x in splits.items():
            out = []
            while x:
                n = 2 if x[:2] == [a, b] else 1
                out.append("".join(x[:n]))
                x = x[n:]
            splits[w] = out
    return units


@pytest.mark.parametrize("seed", [1, 2])
def test_continued_training_equals_a_naive_one(spark, seed):
    rng = random.Random(seed)
    text = lambda letters: [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(40)) for _ in range(10)]
    base = bpe.train(docs(spark, text("abc")), len(bpe.base_vocabulary()) + 30)
    more = text("abcdef")
    assert bpe.continue_training(docs(spark, more), base, 90) == naive_continue(more, base, 90)


def test_continued_training_ties_and_single_symbols(spark):
    assert bpe.continue_training(docs(spark, ["cd", "ab"]), bpe.BpeModel(), 1) == [("a", "b")]
    assert bpe.continue_training(docs(spark, ["x", "x", "x", "cd"]), bpe.BpeModel(), 5) == [("x",), ("c", "d")]


def test_continued_training_refuses_long_tokens(spark):
    units = bpe.continue_training(docs(spark, ["abc abc"]), bpe.BpeModel(), 9, max_token_length=2)
    assert units and max(len("".join(u)) for u in units) <= 2


def test_extraction_is_closed_and_numbered():
    base = bpe.BpeModel()
    base.add("a", "b")
    size = len(base.vocab)
    sub, extended = bpe.extract([("ab", "c"), ("x",), ("d", "e")], base, 10_000)
    assert {"ab", "abc", "de"} <= set(sub.vocab) and extended.vocab["abc"] == size and extended.merges[-2:] == [("ab", "c"), ("d", "e")]
    assert list(sub.vocab.values()) == list(range(len(sub.vocab))) and sub.merges == [("a", "b"), ("ab", "c"), ("d", "e")]
    assert bpe.closure("abc", {"ab": ("a", "b"), "abc": ("ab", "c")}) == ["a", "b", "ab", "c", "abc"]
    with pytest.raises(ValueError):
        bpe.extract([("zz", "c")], base, 10_000)


def test_a_budget_that_bites_keeps_the_rest_out_of_the_global_model():
    base = bpe.BpeModel()
    base.add("a", "b")
    start = len(base.vocab) - 1
    sub, extended = bpe.extract([("d", "e"), ("ab", "c"), ("f", "g")], base, start + 2)
    # d + e and then ab + c with ab, one more than the budget: the highest id goes.
    assert len(sub.vocab) == start + 2 and set(sub.vocab) - set(base.vocab) == {"de"} and "ab" in sub.vocab
    assert extended.merges == [("a", "b"), ("d", "e")] and "fg" not in extended.vocab


def test_sequential_training(spark):
    size = len(bpe.base_vocabulary()) + 6
    texts = {"en": ["the the then"], "fr": ["le les les"], "xx": [None]}
    steps = bpe.train_sequential([(x, docs(spark, t)) for x, t in texts.items()], size, 4)
    assert [s.lang for s in steps] == list(texts)
    model = naive_train(texts["en"], size)
    for step in steps[1:]:
        assert step.units == naive_continue(texts[step.lang], model, 4)
        assert len(step.extracted.vocab) <= size
        new = [t for t in step.extracted.vocab if t not in model.vocab]
        for t in new:
            model.vocab[t] = len(model.vocab)
        assert list(step.model.vocab) == list(model.vocab) and step.model.merges[: len(model.merges)] == model.merges and len(step.model.merges) == len(model.merges) + len(new)
        model = step.model


def test_token_counts_keep_zeros_and_totals(spark):
    w = words.word_frequencies(docs(spark, ["ab ab", "cd"]))
    vocab = spark.createDataFrame([(0, "ab"), (1, "q"), (2, "c")], "token_id int, piece string")
    assert rows(bpe.token_counts(w, [("a", "b")], vocab)) == [(0, "ab", 2), (1, "q", 0), (2, "c", 1)]
    by = bpe.token_counts(words.word_frequencies(docs(spark, ["ab ab", "cd"]), "lang"), [("a", "b")], vocab, "lang")
    assert rows(by.where("n > 0")) == [("en", 2, "c", 1), (None, 0, "ab", 2)] and by.count() in (3, 6)
    nsl = bpe.nsl(words.word_frequencies(docs(spark, [None, "ab ab"]), "lang"), [("a", "b")], [], "lang")
    assert rows(nsl) == [("en", 3, 5, 0.6)]


MERGES = [(k, a, b) for k, (a, b) in enumerate([("a", "b"), ("c", "d"), ("ab", "cd"), ("a", "a"), ("aa", "a"), ("b", "a")])]


@given(st.text("abcd", max_size=60))
def test_short_and_long_paths_agree(word):
    coder = BpeCoder(MERGES)
    if len(word) > 1:
        assert coder._split_short(list(word)) == coder._split_long(list(word))
    assert "".join(coder.split(word)) == word
