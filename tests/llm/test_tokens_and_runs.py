import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import mixing, packing, runs, tokens
from lexiloom.tables import cut
from tests.conftest import rows

PAIRS = [("Ġ", "t"), ("h", "e"), ("Ġt", "he"), ("c", "a"), ("ca", "t")]
TEXTS = ["the cat", "  the  cat\n the", "", None, "日本語" * 30, "\x02odd \x02 text ", "the cat " * 50, "a b c", "é " * 3]


def merges(spark, pairs=PAIRS):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "merge_no int, a string, b string")


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def reference_counts(texts):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    from lexiloom.functions.text import byte_alphabet

    vocab = {t: k for k, t in enumerate([*sorted(byte_alphabet()), *(a + b for a, b in PAIRS)])}
    t = Tokenizer(models.BPE(vocab=vocab, merges=PAIRS))
    split = pre_tokenizers.Split(Regex(r" ?[\p{L}\p{M}]+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"), "isolated")
    t.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return {i: len(t.encode(x or "").ids) for i, x in enumerate(texts)}


@pytest.mark.parametrize("head", [0, 3, 10**6])
def test_counts_equal_the_library(spark, head):
    got = dict(rows(tokens.document_tokens(corpus(spark), merges(spark), head)))
    assert got == reference_counts(TEXTS)


def test_counts_of_nothing(spark):
    assert tokens.document_tokens(corpus(spark).where("false"), merges(spark)).count() == 0
    assert rows(tokens.document_tokens(corpus(spark, [None, ""]), merges(spark).where("false"))) == [(0, 0), (1, 0)]
    null_id = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert tokens.document_tokens(null_id, merges(spark)).count() == 0


@given(st.text(alphabet="ab \n\t 　.\x02é", max_size=90))
@settings(max_examples=300)
def test_pieces_hold_the_pretokens(text):
    got = []
    for key in tokens.text_pieces(text):
        got += tokens._PRETOKEN.findall(key[1:] if key[:1] == "\x02" else " " + key)
    assert got == tokens._PRETOKEN.findall(text)


def test_totals_keep_the_null_group(spark):
    df = spark.createDataFrame([("a", 2), (None, 3), ("a", 4)], "source string, n_tokens long")
    assert rows(tokens.totals(df, "source")) == [("a", 2, 6), (None, 1, 3)]


def run(**change):
    base = dict(run_id=1, shares={"a": 0.5, "b": 0.5}, max_repeats=3, token_budget=400, context_size=16, seed=7, min_doc_chars=None, max_doc_chars=None)
    return runs.Run(**(base | change))


def sized(spark, docs, parts=3):
    return cut(spark.createDataFrame(docs, "doc_id long, source string, n_code_points int, n_tokens long").repartition(parts, "doc_id"))


def test_runs_are_read(spark):
    schema = "run_id int, sources map<string,string>, weights map<string,double>, max_repeats int, token_budget long, context_size int, seed long, min_doc_chars int, max_doc_chars int, extra string"
    df = spark.createDataFrame([(2, {"x": "p", "y": "q"}, None, None, None, 8, None, None, None, "e"), (1, {"x": "p", "y": "q"}, {"x": 3.0, "y": 0.0}, 2, 10, 8, 1, 5, None, "e"), (3, None, None, 1, 1, 1, 1, 1, 1, "e"), (4, {"x": "p"}, {"x": 0.0}, 1, 1, 1, 1, 1, 1, "e")], schema)
    got = runs.read_runs(df)
    assert [r.run_id for r in got] == [1, 2, 4]
    assert got[0].shares == {"x": 1.0, "y": 0.0} and got[1].shares == {"x": 0.5, "y": 0.5} and got[2].shares == {"x": 0.0}
    assert got[1].max_repeats == 1 and got[1].token_budget == 0


@given(st.floats(0.01, 0.99), st.floats(0.01, 0.99), st.integers(1, 500), st.integers(1, 500), st.floats(0, 0.999))
def test_a_duel_keeps_the_mass_and_decides_one(p, q, a, b, draw):
    x, y = mixing.duel(p, a, q, b, draw)
    assert abs(x * a + y * b - p * a - q * b) < 1e-6 and 0 <= x <= 1 and 0 <= y <= 1 and (x in (0, 1) or y in (0, 1))


def test_duels_keep_expectations():
    rng, n = random.Random(1), 20_000
    mean = sum(mixing.duel(0.3, 5, 0.6, 9, rng.random())[0] for _ in range(n)) / n
    assert abs(mean - 0.3) < 0.02


@pytest.mark.parametrize("parts", [1, 5, 130])
def test_mixture_meets_targets(spark, parts):
    rng = random.Random(2)
    docs = [(i, "a" if i % 3 else "b", 10, rng.randint(1, 9)) for i in range(300)] + [(999, None, 5, 5), (1000, "a", 5, 0), (1001, "c", 5, 5)]
    chosen, rates = mixing.mix(sized(spark, docs, parts), [run()])
    got = chosen.collect()
    total = defaultdict(int)
    for r in got:
        total[r.source] += r.n_tokens * r.n_copies
        assert 1 <= r.n_copies <= 3
    size = {s: sum(d[3] for d in docs if d[1] == s) for s in "ab"}
    for s in "ab":
        target = min(200, 3 * size[s])
        assert target - 9 < total[s] <= target
    assert len({r.doc_id for r in got}) == len(got)
    report = {r.source: r for r in mixing.source_shares(chosen, [run()], rates).collect()}
    assert report["a"].actual_tokens == total["a"] and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_mixture_depends_on_no_layout(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_DOCUMENTS", 3)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = random.Random(4)
    docs = [(i, "a" if i % 3 else "b", 10, rng.randint(1, 9)) for i in range(300)]
    configured = [run(), run(run_id=2, seed=8, token_budget=150)]
    got = [rows(mixing.mix(sized(spark, rng.sample(docs, len(docs)), parts), configured)[0]) for parts in (1, 3, 17)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {1, 2}
    assert rows(mixing.mix(sized(spark, docs), [run(seed=9)])[0]) != [r for r in got[0] if r[0] == 1]


def test_inclusion_keeps_expectations(spark):
    docs = [(i, "a", 10, 1 + i % 4) for i in range(40)]
    runs_ = [run(run_id=k, seed=k, shares={"a": 1.0}, token_budget=33) for k in range(400)]
    for draw_last in (False, True):
        got = mixing.mix(sized(spark, docs), runs_, draw_last)[0].collect()
        mean = sum(r.n_tokens * r.n_copies for r in got) / 400
        # Rounded down, the last document costs less than half of the largest on average; drawn, nothing.
        assert (33 - 2 < mean <= 33) if not draw_last else abs(mean - 33) < 0.3
    share = defaultdict(float)
    for r in got:
        share[r.n_tokens] += r.n_copies / 400 / 10
    assert all(abs(share[n] - 0.33) < 0.05 for n in (1, 2, 3, 4))


def test_repeats_are_capped_and_small_sources_fall_short(spark):
    docs = [(i, "a", 10, 2) for i in range(4)] + [(10 + i, "b", 10, 5) for i in range(100)]
    chosen, _ = mixing.mix(sized(spark, docs), [run(), run(run_id=2, token_budget=0)])
    assert {r.n_copies for r in chosen.where("source = 'a'").collect()} == {3}
    assert chosen.where("run_id = 2").count() == 0
    empty, rates = mixing.mix(sized(spark, docs).where("false"), [run()])
    assert empty.count() == 0 and mixing.source_shares(empty, [run()], rates).count() == 2


def test_length_bounds(spark):
    docs = [(1, "a", 4, 2), (2, "a", 5, 2), (3, "a", 9, 2)]
    assert rows(runs.documents_of_runs(sized(spark, docs), [run(min_doc_chars=5, max_doc_chars=8)]).select("doc_id")) == [(2,)]


@given(st.lists(st.integers(1, 20), max_size=80))
def test_bins_of_classes(sizes):
    sizes = sorted(sizes, reverse=True)
    bins = defaultdict(list)
    for size, b in zip(sizes, packing.fill_bins(sizes, 20)):
        bins[b].append(size)
    assert sorted(bins) == list(range(len(bins))) and all(sum(x) <= 20 for x in bins.values())
    assert len(bins) <= 1.25 * -(-sum(sizes) // 20) + 2 + sum(2 * s > 20 for s in sizes)
    # Each bin is of the class of its largest document and holds as many of it as the class says, but for the last one of a class.
    short = defaultdict(int)
    for x in bins.values():
        k = 20 // x[0]
        short[k] += sum(20 // s == k for s in x) < k
    assert all(n <= 1 for n in short.values())


def test_packing_keeps_documents_whole(spark):
    rng = random.Random(3)
    docs = [(i, "a", 1, rng.choice([3, 3, 3, 7, 16, 40, 1])) for i in range(500)] + [(900, "b", 1, 0)]
    got = packing.pack(sized(spark, docs), [run(), run(run_id=2, context_size=64)]).collect()
    for run_id, capacity in ((1, 16), (2, 64)):
        mine = [r for r in got if r.run_id == run_id]
        by_doc, by_bin = defaultdict(list), defaultdict(int)
        for r in mine:
            by_doc[r.doc_id].append(r.n_tokens)
            by_bin[r.container] += r.n_tokens
        assert {d: sum(x) for d, x in by_doc.items()} == {d[0]: d[3] for d in docs if d[3]}
        assert all(len(by_doc[d[0]]) == 1 for d in docs if 0 < d[3] <= capacity)
        assert all(r.fill_tokens == by_bin[r.container] <= capacity for r in mine)
        assert sum(by_bin.values()) / (len(by_bin) * capacity) > 0.95
    report = {r.run_id: r for r in packing.fill_report(packing.pack(sized(spark, docs), [run()]), [run()]).collect()}
    assert report[1].n_containers == len({r.container for r in got if r.run_id == 1})
    assert packing.pack(sized(spark, docs).where("false"), [run()]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sized(spark, docs), [run(context_size=0)])


def test_packing_in_many_parts_depends_on_no_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_PIECES", 10)
    docs = [(i, "a", 1, 5) for i in range(100)]
    got = [rows(packing.pack(sized(spark, docs, parts), [run()])) for parts in (1, 4)]
    assert got[0] == got[1]
    bins = defaultdict(int)
    for r in got[0]:
        bins[r[4]] += 1
    assert sorted(bins) == list(range(len(bins))) and max(bins.values()) == 3
    # At most one bin of each part is short.
    assert sum(n < 3 for n in bins.values()) <= 10
