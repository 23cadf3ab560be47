import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.stem import stem
from lexiloom.operators import batches as B
from lexiloom.operators import metrics as M
from lexiloom.streaming import batches as S
from tests.conftest import rows

STREAM = "lang string, subtok string, pos long, doc_id long, n_tokens long, n_bytes long"


def naive(stream, n):
    """Stateful loop over buffers of one language: (subtok, b, [(pos, first, grab)], ready_pos) in order of emission."""
    queues, out, count = defaultdict(deque), [], defaultdict(int)
    for lang, subtok, pos, _, size, _ in stream:
        if size:
            queues[subtok].append([pos, 0, size])
        while sum(s - u for _, u, s in queues[subtok]) >= n:
            taken, parts = 0, []
            while taken < n:
                d = queues[subtok][0]
                grab = min(n - taken, d[2] - d[1])
                parts.append((d[0], d[1], grab))
                d[1] += grab
                taken += grab
                if d[1] == d[2]:
                    queues[subtok].popleft()
            out.append((subtok, count[subtok], parts))
            count[subtok] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_a_stateful_loop(spark, seed):
    rng = random.Random(seed)
    stream = [("en", rng.choice("ab"), k, k, rng.choice([0, 1, 3, 9, 40]), 7) for k in range(40)]
    df = spark.createDataFrame(stream, STREAM)
    parts = B.spans(df, 8)
    order = [(r.subtok, r.b) for r in B.emission_order(B.batch_factors(parts)).orderBy("nth").collect()]
    want = naive(stream, 8)
    assert order == [(s, b) for s, b, _ in want]
    got = defaultdict(list)
    for r in parts.orderBy("pos").collect():
        got[r.subtok, r.b].append((r.pos, r["first"], r.grab))
    assert dict(got) == {(s, b): p for s, b, p in want}
    # A restored stream holds exactly what is left after two batches of each buffer.
    taken = parts.groupBy("lang", "subtok").agg(F.lit(2).alias("n_batches"))
    left = B.restore(df, B.snapshot(df, parts, taken))
    used = sum(g for s, b, p in want if b < 2 for *_, g in p)
    assert left.agg(F.sum(F.col("n_tokens") - F.col("used"))).first()[0] == sum(x[4] for x in stream) - used


def test_factors_and_rows(spark):
    df = spark.createDataFrame([("en", "all", 0, 10, 3, 6), ("en", "all", 1, 11, 6, 6), ("en", "all", 2, 12, 2, 2)], STREAM)
    parts = B.spans(df, 4)
    factors = {r.b: r.c_bpb for r in B.batch_factors(parts).collect()}
    assert factors[0] == pytest.approx(4 / 7 / math.log(2)) and set(factors) == {0, 1}
    tokens = spark.createDataFrame([(10, [1, 2, 3]), (11, [4, 5, 6, 7, 8, 9]), (12, [0, 0])], "doc_id long, tokens array<int>")
    got = rows(B.batch_rows(parts, tokens, 2, 1).select("b", "row", "x", "y"))
    assert got == [(0, 0, [1], [2]), (0, 1, [3], [4]), (1, 0, [5], [6]), (1, 1, [7], [8])]
    none = spark.createDataFrame([], STREAM)
    assert B.spans(none, 4).count() == 0


def test_padding_and_numbering(spark):
    t = spark.createDataFrame([([1, 2, 3],), ([],)], "t array<int>")
    assert [r[0] for r in t.select(B.padded(F.col("t"), 2, 9)).collect()] == [[1, 2], [9, 9]]
    assert [r[0] for r in t.select(B.padded(F.col("t"), 4, 9, left=True)).collect()] == [[9, 1, 2, 3], [9, 9, 9, 9]]
    assert sorted(r.batch for r in B.numbered_batches(spark.range(5), "id", 2).collect()) == [0, 0, 1, 1, 2]


def test_answers(spark):
    df = spark.createDataFrame([("The Cat's, a  (big) hat; an owl -- theme",)], "s string")
    assert df.select(M.normalize_answer("s")).first()[0] == "cats big hat owl theme"
    pairs = spark.createDataFrame([(1, "a cat cat", ["cat dog", "x"]), (2, "", ["y"]), (3, "z", [])], "id long, prediction string, golds array<string>")
    assert rows(M.token_f1(pairs)) == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(pairs.select(M.exact_match(F.lit("The x!"), "golds"))) == [(0.0,), (0.0,), (1.0,)]


def test_bleu_words(spark):
    split = lambda t, zh=None: spark.createDataFrame([(t,)], "s string").select(M.bleu_words("s", zh)).first()[0]
    assert split("It costs $1,000.50, don't-you? (Yes) 3-4 a&amp;b &quot;x&quot;") == ["it", "costs", "$", "1,000.50", ",", "don't-you", "?", "(", "yes", ")", "3", "-", "4", "a", "&", "b", '"', "x", '"']
    assert split("end-\nless\nline. v1.5.") == ["endless", "line", ".", "v1.5", "."]
    assert split("我们有2个 apples。", F.lit(True)) == ["我", "们", "有", "2", "个", "apples", "。"]
    assert split("我们有2个", F.lit(False)) == ["我们有2个"] and split("") == []


def test_bleu(spark):
    pairs = [(1, "The cat sat on the mat.", "the cat sat on the mat."), (2, "", "x"), (3, "the the the the", "the cat"), (4, "a b c d e", "a b x d e f")]
    same = spark.createDataFrame(pairs, "id long, hypothesis string, reference string")
    assert M.bleu(same.where("id = 1")).first().bleu == pytest.approx(100.0)
    assert M.bleu(same.where("id = 2")).first().bleu == 0.0 and M.bleu(same.where("false")).first().bleu == 0.0
    # Matches 1 of 4, then 0 of 3, 2 and 1: smoothed to 1/2, 1/4 and 1/8 of a match.
    assert M.bleu(same.where("id = 3")).first().bleu == pytest.approx(100 * (1 / 4 * 1 / 6 * 1 / 8 * 1 / 8) ** 0.25)
    assert M.bleu(same.where("id = 4")).first().bleu == pytest.approx(100 * math.exp(1 - 6 / 5) * (4 / 5 * 2 / 4 * 1 / 6 * 1 / 8) ** 0.25)
    by = {r.id2: r.bleu for r in M.bleu(same.withColumn("id2", F.col("id")), "id2").collect()}
    assert by[1] == pytest.approx(100.0) and by[2] == 0.0 and len(by) == 4


def test_rouge(spark):
    pairs = [(1, "The cats sat.", "the cat sat"), (2, None, "x"), (3, "police killed the gunman", "police kill the gunman"), (4, "w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5")]
    got = {r.id: r[1:] for r in M.rouge(spark.createDataFrame(pairs, "id long, hypothesis string, reference string")).collect()}
    assert got[1] == pytest.approx((1, 1, 1, 1)) and got[2] == (0, 0, 0, 0) and got[3] == pytest.approx((1, 1, 1, 1))
    # The union of both lines' subsequences is w1 w2 w3 w5, of 5 and 10 words.
    assert got[4][3] == pytest.approx(2 * 4 / 15)
    plain = M.rouge(spark.createDataFrame(pairs[2:3], "id long, hypothesis string, reference string"), stemmed=False).first()
    assert plain[1:] == pytest.approx((3 / 4, 1 / 3, 3 / 4, 3 / 4))


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "dies": "die", "died": "die", "tried": "tri", "relational": "relat", "hopping": "hop", "generalization": "gener", "sky": "sky", "skies": "sky", "agreed": "agre",
        "dying": "die", "news": "news", "happy": "happi", "enjoy": "enjoy", "say": "say", "by": "by", "cry": "cri", "geology": "geolog", "possibly": "possibl", "hopefully": "hope", "controlling": "control", "proceed": "proceed",
        "national": "nation", "feed": "feed", "filing": "file", "falling": "fall", "formaliti": "formal", "triplicate": "triplic", "electrical": "electr", "adoption": "adopt", "probate": "probat", "cease": "ceas",
    }
    assert {w: stem(w) for w in known} == known


def test_choices(spark):
    s = spark.createDataFrame([(1, 0, 5.0, 1.0, 1.0, 2, 0), (1, 1, 5.0, 4.0, 1.0, 8, 0), (2, 0, None, None, None, 1, 0)], "id long, choice int, full_ce double, answer_ce double, prompt_ce double, n_chars int, gold int")
    r = M.choice_accuracy(s).first()
    assert (r.n_examples, r.unnormalized, r.length_normalized, r.prob_normalized) == (2, 0.5, 0.0, 0.0)
    logits = spark.createDataFrame([(1, 0, 2.0, 0), (1, 1, 2.0, 0)], "id long, choice int, logit double, gold int")
    assert M.letter_accuracy(logits).first().acc == 1.0
    assert M.macro_average(spark.createDataFrame([("a", 1.0), ("b", 0.0)], "topic string, acc double"), "acc").first().acc == 0.5


def test_schedules_and_prompts(spark):
    lr = [r.lr for r in M.learning_rates(spark, 10, 1.0, 2, 6, 4).orderBy("step").collect()]
    assert lr == pytest.approx([0, 0.5, 1, 1, 1, 1, 1, 0.75, 0.5, 0.25])
    with pytest.raises(ValueError):
        M.learning_rates(spark, 10, 1.0, 5, 2)
    ex = spark.createDataFrame([("t", 1, True, "q1", "a1", None), ("t", 2, False, "q2", None, "c"), ("u", 3, False, None, None, None)], "task string, id long, is_shot boolean, question string, answer string, context string")
    got = {r.id: r.prompt for r in M.few_shot_prompts(ex, 5, "P", "Q {q} A {a}", "task").collect()}
    assert got == {2: "P\nQ q1 A a1\nc\nQ q2 A", 3: "P\n\nQ  A"}
    out = spark.createDataFrame([(" a b \nc\n\nd",)], "s string")
    assert out.select(M.first_line("s"), M.first_paragraph("s")).first() == ("a b", "a b \nc")


def test_streaming_goes_on_after_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    data = [("en", "all", k, k, n) for k, n in enumerate([3, 5, 1, 9, 2, 4])]
    schema = "lang string, subtok string, pos long, doc_id long, n_tokens long"
    for part in (data[:3], data[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = S.pack_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), 6)
        stream.writeStream.format("json").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out")).select("b", "pos", "first", "grab")
    want = B.spans(spark.createDataFrame([(*d, 1) for d in data], STREAM), 6).select("b", "pos", "first", "grab")
    assert rows(got.join(want.select("b").distinct(), "b")) == rows(want)


def test_windows(spark):
    events = spark.createDataFrame([("2020-01-01 00:10:00", "a", 1.0), ("2020-01-01 00:50:00", "a", 2.0), ("2020-01-01 01:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert [r.n for r in S.tumbling_counts(events, 60).orderBy("window_start").collect()] == [2, 1]
    log = spark.createDataFrame([(5, "en", 1.0), (150, None, 3.0)], "step long, lang string, v double")
    assert rows(M.window_means(log, "step", "v", 100)) == [(0, "*", 1, 1.0), (0, "en", 1, 1.0), (1, "", 1, 3.0), (1, "*", 1, 3.0)]


def test_latency_batches_and_small_facts(spark):
    from lexiloom.operators import reports as R

    tokens = spark.createDataFrame([(2, [4, 5, 6]), (1, [1, 2, 3])], "doc_id long, tokens array<int>")
    assert rows(R.latency_batches(tokens, 2, 2)) == [(0, 0, [1, 2]), (0, 1, [3, 4])]
    assert rows(R.latency_batches(tokens, 2, 4)) == [(0, 0, [1, 2, 3, 4]), (0, 1, [5, 6, 0, 0])]
    assert R.latency_batches(tokens.where("false"), 2, 4).count() == 0
    assert tokens.agg(R.padded_length("tokens", 8)).first()[0] == 8
    numbers = spark.createDataFrame([(5,), (1500,), (2_500_000,), (3 * 10**9,)], "n long")
    assert [r[0] for r in numbers.select(R.short_number("n")).collect()] == ["5", "1.50K", "2.50M", "3.00B"]
    times = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "name string, seconds double")
    assert rows(R.mean_times(times, "name")) == [("a", 2, 2.0)]
    assert R.kept_steps([10, 20, 30, 40, 50], 1, 20, rewind_to=40) == [20, 40]


def test_prompts(spark):
    from lexiloom.operators import prompts as P

    ex = spark.createDataFrame([("winogrande", 1, " end", ["x", "yy"], 0, None), ("boolq", 2, "q", None, 0, "c"), ("other", 3, "q", ["a"], 0, None)], "task string, id long, question string, choices array<string>, gold int, context string")
    got = rows(P.cloze_sequences(ex).select("id", "choice", "full", "answer", "n_chars"))
    assert got == [(1, -1, "end", "", 0), (1, 0, "x end", "x", 1), (1, 1, "yy end", "yy", 2), (2, -1, "c\nQuestion: q Answer:", "Answer:", 0)]
    letters = ex.where("id = 1").select(P.letter_prompt(F.col("question"), F.col("choices"), F.lit("ctx"), F.lit(1))).first()[0]
    assert letters == "ctx\n end\nA. x\nB. yy\nAnswer: B"
    pairs = spark.createDataFrame([(1, True, "a", ["b"]), (2, False, "c", None)], "id long, is_shot boolean, question string, answer array<string>")
    assert P.translation_prompts(pairs, 3, "en", "fr").first().prompt == "en: a fr: b\nen: c fr:"
    sums = spark.createDataFrame([(1, True, "s", "t"), (2, False, "u", "v")], "id long, is_shot boolean, source string, summary string")
    assert P.summary_prompts(sums, 1, "Text", "Summary").first().prompt == "Text: s\nSummary: t\n\nText: u\nSummary:"
