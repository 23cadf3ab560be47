import random

import numpy as np
import pytest

from lexiloom.llm import contexts, labels, leaks, lexicon, normal, overlaps, pages
from tests.conftest import rows

EN = "the of and a to in is was for it with as his on be at by this that from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us near once every while where very".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ihre ihrer wir ich kann gegen vom können schon wenn habe unter wo".split()
NOUNS = {"en": "house river lantern teacher garden market bridge island winter letter".split(), "de": "haus fluss laterne lehrer garten markt brücke insel winter brief".split()}


def sentence(lang, rng, n=14):
    words = [rng.choice(EN if lang == "en" else DE) if k % 3 else rng.choice(NOUNS[lang]) + rng.choice(["", "ton", "berg", "dor", "mar"]) for k in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def models():
    langs = ["de", "en", "zh"]
    masks = {}
    for lang, words in (("en", EN), ("de", DE)):
        for w in words:
            if len(w) > 1:
                masks[lexicon.fold(w)] = masks.get(lexicon.fold(w), 0) | 1 << langs.index(lang)
    lex = lexicon.Lexicon(langs, masks, ["一个", "他们", "没有人知道"])
    lex.__setstate__(lex.__getstate__())
    rng = random.Random(5)
    texts = {x: [" ".join(sentence(x, rng) for _ in range(4)) for _ in range(40)] for x in ("en", "de")}
    trees = contexts.ContextTrees(texts, {"en": EN, "de": DE}, langs)
    return lex, pages.prose_profiles(texts, lex), trees


def prose(lang="en", n=20, seed=1):
    rng = random.Random(seed)
    return [sentence(lang, rng) for _ in range(n)]


def documents(models=None):
    rng = random.Random(9)
    table = "\n".join(f"| {rng.randint(1, 999)} | {rng.random() * 100:.2f} | house | {rng.randint(1, 30)}% |" for _ in range(20))
    code = "\n".join(f"    river = garden(market, {k});" for k in range(20))
    listing = "\n".join(f"- {''.join(rng.choice('abcdefgh') for _ in range(7))} {w}" for w in "bark leaf root stem bud seed cone twig".split() for _ in "xx")
    keywords = ", ".join(rng.choice(["cheap lantern", "lantern", "lantern shop", "buy lantern"]) for _ in range(60))
    links = "\n".join(f"https://site{k}.example/page » offer" for k in range(15))
    shop = "\n".join(f"Lantern | red | XL | SKU-{10000 + k} | {k + 0.5:.2f} EUR" for k in range(12))
    tags = " ".join(f"#lantern{k % 4}" for k in range(40))
    return {1: "\n".join(prose()), 2: table, 3: code, 4: listing, 5: keywords, 6: links, 7: shop, 8: tags, 9: "", 10: None, 11: "x", 12: "\n".join(prose()) + "\n" + links[:300], 13: "word " * 60_000, 14: "\n".join(s.upper() for s in prose(seed=3))}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "en", "clash") for k, t in docs.items()], "doc_id long, text string, lang string, structure string")


def test_structures_and_keyword_pages(spark, models):
    from lexiloom.tables import cut

    docs = documents() | {100 + k: " ".join(prose(seed=k)) for k in range(40)}
    profiles = cut(pages.profile_documents(frame(spark, docs), *models[:2]))
    by_id = {r.doc_id: r for r in profiles.collect()}
    is_prose = {k for k, r in by_id.items() if r.n_chars_dense and 2 * r.prose_chars >= r.n_chars_dense}
    assert is_prose == {1, 12, 14} | {k for k in docs if k >= 100}
    assert by_id[9].structure == by_id[10].structure == "empty" and by_id[1].structure == "prose" and by_id[2].structure == "table" and by_id[3].structure == "code"
    assert by_id[1].n_words == 280 and 0 <= by_id[1].common_word_share <= 1 and by_id[1].line_end_punct == 1.0
    spam = {r.doc_id for r in pages.keyword_pages(profiles).where("is_keyword_page").collect()}
    assert spam == {5, 6, 7, 8, 13}
    curves = {r.doc_id: r for r in pages.rank_frequency(profiles).collect()}
    assert curves[5].slope < -0.5 and curves[5].top > 40
    assert pages.keyword_pages(cut(profiles.where("false"))).count() == 0


def test_pages_of_equally_frequent_keywords(spark, models):
    from lexiloom.tables import cut

    rng = random.Random(7)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(30)]
    order = stems * 10
    rng.shuffle(order)
    # Prose of 300 words in which the most frequent content words occur up to 7 times.
    def page(seed):
        r = random.Random(seed)
        nouns = [x for k in range(9) for x in ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))] * max(1, 7 - k)]
        return " ".join(" ".join(r.choice(EN) if k % 3 else r.choice(nouns) if r.random() < 0.3 else "x" + "".join(r.choice("aeioulmnr") for _ in range(6)) for k in range(15)).capitalize() + "." for _ in range(20))

    docs = {1: ", ".join(order), 2: "\n".join(order)} | {100 + k: page(k) for k in range(60)}
    profiles = cut(pages.profile_documents(frame(spark, docs), *models[:2]))
    found = {r.doc_id: r for r in pages.keyword_pages(profiles).collect()}
    assert found[1].top == 10 < pages.EXTREME * found[1].prose_top
    assert {k for k, r in found.items() if r.is_keyword_page} == {1, 2}


def test_language_of_pages_without_prose(spark, models):
    profile = pages.profile_documents(frame(spark, {1: "| die | 5 | 7 | 9 |\n| und | 4 | 8 | 2 |", 2: "\n".join(prose())}), *models[:2])
    assert {r.doc_id: (r.prose_lang, r.words_lang) for r in profile.collect()} == {1: (None, "de"), 2: ("en", "en")}


def test_curve_is_the_least_squares_line(spark):
    df = spark.createDataFrame([(1, [(8, 1), (4, 1), (2, 2), (1, 4)])], "doc_id long, spectrum array<struct<n: int, words: int>>")
    got = pages.rank_frequency(df).first()
    ranks, counts = [1, 2, 3.5, 3.5, 6.5, 6.5, 6.5, 6.5], [8, 4, 2, 2, 1, 1, 1, 1]
    slope, shift = np.polyfit(np.log(ranks), np.log(counts), 1)
    assert got.slope == pytest.approx(slope) and got.residual == pytest.approx(max(abs(np.log(counts) - slope * np.log(ranks) - shift)))


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert pages.divergence(p, np.array([0.5, 0.5, 0.0])) == pytest.approx([0, 0.3112781244591328])
    assert pages.divergence(np.array([[1.0, 0.0]]), np.array([0.0, 1.0])) == pytest.approx([1.0])


def naive_bits(trees, counts_of, word, lang):
    """PPM with escapes of method C, straight from counts."""
    code, total = contexts._bytes(word), 0.0
    for i in range(1, len(code)):
        for k in range(min(i, contexts.ORDER), -1, -1):
            following = counts_of(lang, code[i - k : i])
            if not following:
                continue
            n, d = sum(following.values()), len(following)
            if code[i] in following:
                total += -np.log2(following[code[i]] / (n + d))
                break
            total += -np.log2(d / (n + d))
        else:
            total += 8.0
    return total


def test_code_lengths_equal_a_plain_coder():
    texts = {"en": ["the cat sat on the mat and the dog"], "de": ["der hund und die katze auf der matte"]}
    trees = contexts.ContextTrees(texts, {}, ["de", "en"])
    counts = {}
    for lang, (text,) in texts.items():
        for w in text.split():
            code = contexts._bytes(w)
            for i in range(1, len(code)):
                for k in range(min(i, contexts.ORDER) + 1):
                    counts.setdefault((lang, code[i - k : i]), {}).setdefault(code[i], 0)
                    counts[lang, code[i - k : i]][code[i]] += 1
    for word in ("the", "katze", "matter", "zzz", "é", "dogs"):
        want = [naive_bits(trees, lambda x, c: counts.get((x, c)), word, x) for x in ("de", "en")]
        assert trees.word_bits(word) == pytest.approx(want, rel=1e-4)


def test_heldout_languages(models):
    trees = models[2]
    right = 0
    for seed in range(200):
        lang = "en" if seed % 2 else "de"
        line = sentence(lang, random.Random(1000 + seed), 8)
        main, confidence, _ = contexts.document_languages([(1, line, lexicon.words_of(line))], trees)
        right += trees.langs[main] == lang
        assert 0 <= confidence <= 1
    assert right >= 196


def test_mixed_lines(models):
    trees = models[2]
    rng = random.Random(4)
    lines = [sentence("en", rng) + " " + sentence("en", rng), sentence("de", rng), sentence("en", rng) + " " + sentence("de", rng), "Der Markt " + sentence("en", rng).lower()]
    main, _, found = contexts.document_languages([(k + 1, x, lexicon.words_of(x)) for k, x in enumerate(lines)], trees)
    assert trees.langs[main] == "en" and [(n, trees.langs[k]) for n, k in found] == [(1, "en"), (2, "de"), (3, "de"), (3, "en"), (4, "en")]
    assert contexts.document_languages([(1, "...", [])], trees) == (-1, 0.0, [])


def test_wrapped_sentences_are_not_full():
    lines = [(1, "One two three four. Five six"), (2, "seven eight nine. Ten eleven"), (3, "twelve thirteen.")]
    assert [(n, full) for n, _, full in contexts.sentences(lines)] == [(1, True), (1, False), (2, False), (2, False), (3, False)]
    assert all(full for *_, full in contexts.sentences([(1, "one two"), (2, "three"), (3, "four")]))


def test_labels(spark):
    languages = spark.createDataFrame([("en", "eng", "English"), ("de", "deu", None)], "lang string, iso3 string, lang_name string")
    assert rows(labels.language_names(languages)) == [("de", "de"), ("deu", "de"), ("en", "en"), ("eng", "en"), ("english", "en")]


def passage_words(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_leaks(spark):
    item, other = passage_words(1), passage_words(2)
    noise = passage_words(3, 200)
    edited = item[5:45]
    for k, w in ((4, "changed"), (20, None), (33, "x y")):
        edited[k] = w
    docs = {
        1: noise[:50] + item[10:42] + noise[50:],  # 32 words
        2: noise[:50] + item[10:41] + noise[50:],  # 31 words
        3: noise + [w for w in edited if w] + noise[:9],
        4: ["> " + w.upper() + "," for w in other[:40]],
        5: noise,
        6: [w if k % 5 else "edit" for k, w in enumerate(item)],
        9: item * 400,
    }
    rows_ = [(k, " ".join(v), "x") for k, v in docs.items()] + [(7, None, "x"), (8, "", "x"), (None, " ".join(item), "x")]
    corpus = spark.createDataFrame(rows_, "doc_id long, text string, item_id string")
    instruction = "Read the passage and answer"
    items = spark.createDataFrame([(1, instruction + "\n" + " ".join(item)), (2, instruction + "\n" + " ".join(other)), (3, instruction + "\n" + " ".join(item[:50])), (4, None), (5, "short"), (1, instruction + "\n" + " ".join(item))], "item_id long, text string")
    assert rows(leaks.find_leaks(corpus, items)) == [(1, 1), (1, 3), (3, 1), (3, 3), (4, 2), (9, 1), (9, 3)]
    assert leaks.find_leaks(corpus.where("false"), items).count() == 0
    assert leaks.find_leaks(corpus, items.where("false")).count() == 0


def test_leaks_with_neighbouring_edits(spark):
    item, noise = passage_words(1, 90), passage_words(3, 120)
    near = item[:32]
    near[10:13] = ["one", near[11], "two"]
    docs = {
        1: item[:29] + ["changed"] * 6 + item[35:64],  # 64 words, 6 edits
        2: item[:29] + item[35:64],
        3: item[:29] + ["added"] * 5 + item[29:60],
        4: near[:31] + ["added"] + near[31:],  # 32 words, 3 edits, one equal word between two of them and one at the end
        5: item[:29] + ["changed"] * 6 + item[35:63],  # 63 words, 6 edits
        6: item[:29] + ["changed"] * 7 + item[36:64],
        7: near[:20] + ["added"] + near[20:25] + ["more"] + near[25:],  # 32 words, 4 edits
    }
    corpus = spark.createDataFrame([(k, " ".join(noise[:60] + v + noise[60:])) for k, v in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = [k for k, _ in rows(leaks.find_leaks(corpus, items))]
    assert found == [1, 2, 3, 4, 5]


def test_passages_equal_alignment():
    rng = random.Random(6)
    for _ in range(150):
        doc, item = ([rng.randint(0, 3) for _ in range(rng.randint(0, 16))] for _ in range(2))
        want = [0] + [-1] * leaks.MOST_EDITS
        cost = {(0, 0): 0}
        for y in range(len(item) + 1):
            for x in range(len(doc) + 1):
                if x or y:
                    ways = [cost[p] + c for p, c in (((x - 1, y), 1), ((x, y - 1), 1), ((x - 1, y - 1), int(x > 0 < y and doc[x - 1] != item[y - 1]))) if p in cost]
                    cost[x, y] = min(ways)
                if x and y and doc[x - 1] == item[y - 1] and cost[x - 1, y - 1] <= leaks.MOST_EDITS:
                    want[cost[x - 1, y - 1]] = y
        assert leaks._reach(doc, item) == want


def test_leaks_by_join_equal_those_by_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    noise = passage_words(99, 400)
    items = [(k, "Answer this\n" * (k < 5) + " ".join(passage_words(k % 6, 60))) for k in range(9)] + [(20, None), (21, ""), (22, "short")]
    docs = [(d, " ".join(noise[:d] + passage_words(d % 6, 60)[: 25 + rng.randint(0, 30)] + noise[d : 2 * d])) for d in range(30)] + [(50, None), (51, ""), (52, " ".join(noise))]
    corpus, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = rows(leaks.find_leaks(corpus, held))
    monkeypatch.setattr(leaks, "BROADCAST_CHARS", 0)
    assert len(want) > 20 and rows(leaks.find_leaks(corpus, held)) == want
    assert leaks.find_leaks(corpus.where("false"), held).count() == leaks.find_leaks(corpus, held.where("false")).count() == 0


def test_a_gap_of_five_words_in_sixty(spark):
    item, noise = passage_words(1, 60), passage_words(3, 80)
    docs = [(k, " ".join(noise[:40] + item[:at] + item[at + 5 :] + noise[40:])) for k, at in enumerate((20, 27, 40))]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(leaks.find_leaks(corpus, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))) == [(0, 1), (1, 1), (2, 1)]


def test_long_words_are_scored_whole(models):
    *_, trees = models
    word = "lantern" * 60
    assert trees.word_bits(word)[1] > 1.5 * trees.word_bits(word[:200])[1]


def test_share_of_listed_words(models):
    lex, *_ = models
    share = lambda line: pages.line_counts(line, lex)[4:]
    assert share("the lantern and a river 12") == (3, 6) or share("the lantern and a river 12") == (2, 6)
    assert share("他们喝水一个") == (2, 3)
    assert share("") == (0, 0)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MAX_LANGUAGES", 2)
    langs = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "lang string")
    with pytest.raises(ValueError):
        lexicon.read_lexicon({}, langs)
    assert lexicon.read_lexicon({"b": ["x y"]}, langs.where("lang != 'c'")).masks == {"x": 2, "y": 2}


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**62, leaks.GRAM + leaks.WINDOW - 1).astype(np.uint64)
    for _ in range(200):
        sides = [np.concatenate([rng.integers(0, 2**62, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 2**62, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        prints = []
        for words in sides:
            grams = leaks.gram_hashes(words, np.zeros(len(words), int))
            prints.append({int(grams[i]) for i in leaks.winnow(grams)})
        assert prints[0] & prints[1]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_words_and_plain_text():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert overlaps.common_words(a, b) == naive_lcs(a, b)
    assert lexicon.words_of(normal.plain("<p>H&eacute;llo&nbsp;wo­rld</p><b>x</b>y")) == ["Héllo", "world", "xy"]
    assert lexicon.fold("É") == "e" and lexicon.fold("é") == "e"


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    base = [["w" + name(rng.randint(0, 400)) for _ in range(rng.randint(8, 60))] for _ in range(120)]
    records = []
    for k, words in enumerate(base):
        records.append((2 * k, "train", " ".join(words)))
        copy = list(words)
        for _ in range(rng.randint(0, len(words) // 6)):
            copy[rng.randrange(len(copy))] = "e" + name(rng.randint(0, 999))
        records.append((2 * k + 1, rng.choice(["val", "test"]), " ".join(copy).upper()))
    records += [(1000, "train", None), (1001, "test", ""), (1002, "test", "too short"), (1003, "train", "Numbers 1 2 3 " + " ".join(base[0])), (1004, "test", "Numbers 1 2 4 " + " ".join(base[0])), (1004, "test", "Numbers 1 2 4 " + " ".join(base[0]))]
    df = spark.createDataFrame([("t", i, s, "task", t, "x") for i, s, t in records], "tab string, rec_id long, split string, task string, text string, words string")
    pairs = overlaps.cross_split_pairs(df)
    got = {(r.id_train, r.id_eval) for r in pairs.collect()}
    hashes = normal.WordHashes()
    known = {i: (s, *overlaps.digest_text(t, hashes)) for i, s, t in records if t}
    want = {
        (i, j) for i, a in known.items() for j, b in known.items()
        if a[0] == "train" != b[0] and min(len(a[1]), len(b[1])) >= 8 and (a[3] == b[3] or a[2] == b[2] and naive_lcs(a[1], b[1]) >= 0.8 * max(len(a[1]), len(b[1])))
    }
    assert len(want) > 100 and got <= want and len(want - got) <= 0.01 * len(want)
    assert all(0.8 - 1e-9 <= r.overlap <= 1 for r in pairs.collect())
    report = overlaps.reports(*overlaps.cross_split_classes(df)).collect()
    assert sum(r.n_pairs for r in report) == len(got) and sum(r.n_records for r in report) == len({j for _, j in got})
    assert all(0.8 <= r.mean_overlap <= 1 for r in report)
    assert overlaps.cross_split_pairs(df.where("false")).count() == 0


def test_edits_of_one_word_in_five_equal_brute_force(spark):
    rng = random.Random(12)
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    records = []
    for k in range(60):
        words = ["w" + name(int(rng.paretovariate(0.7)) % 5000) for _ in range(rng.randint(100, 600))]
        copy, share = list(words), rng.choice([0.15, 0.18, 0.2])
        for n, at in enumerate(sorted(rng.sample(range(len(words)), int(share * len(words))) if k % 2 else range(2, int(share * len(words)) * 5, 5), reverse=True)):
            # Words changed, or in each third copy one left out and another put elsewhere.
            copy[at : at + 1] = ["e" + name(rng.randint(0, 999))] if k % 3 or n % 2 else []
            if k % 3 == 0 and n % 2 == 0:
                copy.insert(at // 2, "f" + name(n))
        records += [(2 * k, "train", " ".join(words)), (2 * k + 1, "test", " ".join(copy))]
    df = spark.createDataFrame([("t", i, s, "task", t) for i, s, t in records], "tab string, rec_id long, split string, task string, text string")
    got = {(r.id_train, r.id_eval): r.overlap for r in overlaps.cross_split_pairs(df).collect()}
    words = {i: t.split() for i, _, t in records}
    common = {(i, j): naive_lcs(words[i], words[j]) / max(len(words[i]), len(words[j])) for i in words for j in words if i % 2 == 0 and j % 2 and (i + 1 == j or i % 20 == 0)}
    want = {pair: c for pair, c in common.items() if c >= 0.8}
    assert len(want) >= 50 and set(got) == set(want)
    assert got == pytest.approx(want)


def test_a_hot_group_of_copies(spark):
    text = " ".join(f"word{k}" for k in range(20))
    df = spark.createDataFrame([("t", k, "train" if k % 2 else "test", "task", text) for k in range(60)], "tab string, rec_id long, split string, task string, text string")
    got = overlaps.cross_split_pairs(df)
    assert got.count() == 900 and {r.overlap for r in got.collect()} == {1.0}


def test_numbers_are_told_apart():
    hashes = normal.WordHashes()
    numbers = lambda t: overlaps.digest_text(t, hashes)[1]
    assert numbers("1 red and 23 blue") != numbers("12 red and 3 blue")
    assert numbers("1,234 red") == numbers("1234 RED") == numbers("1\u202f234 red") != numbers("1 234 red")
    assert numbers("no number") == numbers("") != numbers("0")


def naive_chunks(text):
    base, out, start = int(overlaps._BASE), [], 0
    for i in range(len(text)):
        rolled = sum(ord(text[i - k]) * pow(base, k, 2**64) for k in range(min(i + 1, overlaps.CHUNK_WINDOW))) % 2**64
        mixed = int(overlaps._mixed(np.array([rolled], np.uint64))[0])
        if i == len(text) - 1 or i >= overlaps.CHUNK_WINDOW - 1 and mixed % overlaps.CHUNK_CHARS == 0:
            out.append(text[start : i + 1])
            start = i + 1
    return out


def test_chunks_equal_plain_cuts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeé中") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    owner, digest, length = overlaps.cut_chunks(texts)
    seen = {}
    at = 0
    for k, text in enumerate(texts):
        for chunk in naive_chunks(text):
            assert owner[at] == k and length[at] == len(chunk) and seen.setdefault(chunk, digest[at]) == digest[at]
            at += 1
    assert at == len(owner) and len(set(seen.values())) == len(seen)
    # Cuts follow the content: after an insertion they fall in the same places again.
    assert naive_chunks("x" * 7 + texts[0])[-3:] == naive_chunks(texts[0])[-3:]
    assert len(overlaps.cut_chunks([])[0]) == len(overlaps.cut_chunks(["", ""])[0]) == 0


def test_chunk_overlaps_equal_brute_force(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base = [text(30) for _ in range(10)]
    records = [(k, "train", b) for k, b in enumerate(base)]
    records += [(100 + k, "test", " ".join(b.upper().split()[: 5 * k // 2] + text(12).split())) for k, b in enumerate(base)]
    records += [(105, "test", records[15][2]), (200, "test", None), (201, "val", ""), (202, "val", base[0]), (None, "val", base[0])]
    df = spark.createDataFrame([("t", i, s, "task", t, 1) for i, s, t in records], "tab string, rec_id long, split string, task string, text string, overlap int")
    got = {r.rec_id: r for r in overlaps.chunk_overlaps(df).collect()}
    form = lambda t: t.lower().replace(" ", "")
    known = {c for b in base for c in naive_chunks(form(b))}
    assert set(got) == {*range(100, 110), 202}
    for i, _, t in records:
        if i in got:
            parts = naive_chunks(form(t))
            assert got[i].n_chars == len(form(t)) and got[i].shared_chars == sum(len(c) for c in parts if c in known) and 0 <= got[i].overlap <= 1
    assert got[202].overlap == 1.0 and got[109].overlap > 0.4
    assert overlaps.chunk_overlaps(df.where("false")).count() == 0


def test_lines_of_short_sentences_go_with_those_around_them(models):
    *_, trees = models
    en, de = prose("en", 8, 3), prose("de", 6, 4)
    lines = [(k + 1, t, None) for k, t in enumerate([*en[:4], "Yes.", *en[4:], de[0], "Ja.", *de[1:]])]
    main, _, found = contexts.document_languages(lines, trees)
    named = {n: trees.langs[k] for n, k in found}
    assert trees.langs[main] == "en" and named[5] == "en" and named[11] == "de" and len(named) == len(lines)
