"""Evaluation metrics and schedules. Model scores and predictions come in as tables."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.stem import stem

#: ASCII punctuation and the articles that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def answer_words(text: Column | str) -> Column:
    """Words of an answer: lower case, without ASCII punctuation and articles."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.filter(F.split(F.trim(F.regexp_replace(bare, r"[\t-\r\x{85}\p{Z}]+", " ")), " "), lambda w: (w != "") & ~w.isin(*ARTICLES))


def normalize_answer(text: Column | str) -> Column:
    """:func:`answer_words` joined by blanks."""
    return F.array_join(answer_words(text), " ")


def exact_match(prediction: Column | str, golds: Column | str) -> Column:
    """1.0 if the answer equals one of the array ``golds`` after normalization, else 0.0."""
    p = normalize_answer(prediction)
    return F.exists(F.col(golds) if isinstance(golds, str) else golds, lambda g: normalize_answer(g) == p).cast("double")


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, prediction, golds array) -> (id, f1): the best F1 of word multisets over the golds; 0 where no word is shared or there are no golds."""
    golds = pairs.select("id", answer_words("prediction").alias("p"), F.posexplode("golds").alias("k", "gold")).withColumn("g", answer_words("gold"))
    count = lambda side: golds.select("id", "k", F.explode(side).alias("w")).groupBy("id", "k", "w").agg(F.count("*").alias(f"n_{side}"))
    same = count("p").join(count("g"), ["id", "k", "w"]).groupBy("id", "k").agg(F.sum(F.least("n_p", "n_g")).alias("same"))
    scored = golds.join(same, ["id", "k"], "left").withColumn("same", F.coalesce("same", F.lit(0)))
    f1 = F.when(F.col("same") == 0, F.lit(0.0)).otherwise(2.0 * F.col("same") / (F.size("p") + F.size("g")))
    best = scored.withColumn("f1", f1).groupBy("id").agg(F.max("f1").alias("f1"))
    return pairs.select("id").join(best, "id", "left").select("id", F.coalesce("f1", F.lit(0.0)).alias("f1"))


#: The split of the standard BLEU tokenizers (13a) as (pattern, replacement), applied in order to a text between blanks.
BLEU_SPLIT = (
    (r"([{-~\[-` -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
#: Entities and breaks that the 13a tokenizer undoes first, and the code points that its Chinese variant sets apart.
BLEU_UNDONE = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", "\""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
CHINESE = (
    "\\x{2600}-\\x{27bf}\\x{2e80}-\\x{2fdf}\\x{2ff0}-\\x{303f}\\x{3100}-\\x{312f}\\x{31a0}-\\x{31bf}\\x{31c0}-\\x{31ef}\\x{3200}-\\x{33ff}\\x{3400}-\\x{4db5}\\x{4e00}-\\x{9fbb}"
    "\\x{f900}-\\x{fa2d}\\x{fa30}-\\x{fa6a}\\x{fa70}-\\x{fad9}\\x{fe10}-\\x{fe1f}\\x{fe30}-\\x{fe4f}\\x{ff00}-\\x{ffef}"
)


def bleu_words(text: Column | str, chinese: Column | None = None) -> Column:
    """Lower-case words of a text as the 13a tokenizer splits them; where ``chinese`` holds, as its Chinese variant does: every such character alone."""
    text = F.lower(F.col(text) if isinstance(text, str) else text)
    plain = text
    for old, new in BLEU_UNDONE:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    if chinese is not None:
        plain = F.when(chinese, F.regexp_replace(F.trim(text), f"([{CHINESE}])", " $1 ")).otherwise(plain)
    plain = F.concat(F.lit(" "), plain, F.lit(" "))
    for pattern, new in BLEU_SPLIT:
        plain = F.regexp_replace(plain, pattern, new)
    return F.filter(F.split(F.trim(F.regexp_replace(plain, r"[\t-\r\x{85}\p{Z}]+", " ")), " "), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    )


def _bleu_parts(pairs: DataFrame, by: Sequence[str], chinese: Column | None) -> DataFrame:
    return pairs.select(*by, "id", bleu_words("hypothesis", chinese).alias("h"), bleu_words("reference", chinese).alias("r"))


def bleu_counts(pairs: DataFrame, *by: str, longest: int = 4, chinese: Column | None = None) -> DataFrame:
    """(by..., id, hypothesis, reference) -> (by..., n, matched, total): clipped matches and n-grams of the corpus.

    Both sides are counted in one pass over all lengths.
    """
    parts = _bleu_parts(pairs, by, chinese)
    grams = lambda side: F.flatten(F.array(*(F.transform(_grams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), g.alias("g"))) for n in range(1, longest + 1))))  # noqa: B023, E731
    each = parts.select(*by, "id", F.explode(F.concat(grams("h"), grams("r"))).alias("x")).groupBy(*by, "id", "x.n", "x.g")
    counts = each.agg(F.count(F.when(F.col("x.side") == "h", 1)).alias("n_h"), F.count(F.when(F.col("x.side") == "r", 1)).alias("n_r"))
    sums = counts.groupBy(*by, "n").agg(F.sum(F.least("n_h", "n_r")).alias("matched"), F.sum("n_h").alias("total"))
    groups = pairs.select(*by).distinct() if by else pairs.sparkSession.range(1).select()
    lengths = groups.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    filled = lengths.join(sums, [*by, "n"], "left")
    return filled.select(*by, "n", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("total", F.lit(0)).alias("total"))


def bleu(pairs: DataFrame, *by: str, longest: int = 4, chinese: Column | None = None) -> DataFrame:
    """(by..., hyp_len, ref_len, bleu): corpus BLEU of up to four words with brevity penalty, in percent.

    Lengths without a match are smoothed exponentially: the first counts 1/2 match, the next 1/4 and so on. Without any match, or where
    no hypothesis is long enough, it is 0.
    """
    sizes = _bleu_parts(pairs, by, chinese).groupBy(*by).agg(F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("hyp_len"), F.coalesce(F.sum(F.size("r")), F.lit(0)).alias("ref_len"))
    counts = bleu_counts(pairs, *by, longest=longest, chinese=chinese).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "matched", "total"))).alias("c"))
    counts = counts.withColumn("zeros", F.transform("c", lambda x: F.size(F.filter("c", lambda y: (y["matched"] == 0) & (y["n"] <= x["n"])))))
    logs = F.transform(F.arrays_zip("c", "zeros"), lambda x: F.when(x["c"]["matched"] > 0, F.log(x["c"]["matched"] / F.nullif(x["c"]["total"], F.lit(0)))).otherwise(-F.log(F.pow(F.lit(2.0), x["zeros"]) * F.nullif(x["c"]["total"], F.lit(0)))))
    counts = counts.withColumn("logs", logs).withColumn("any", F.exists("c", lambda x: x["matched"] > 0) & F.forall("c", lambda x: x["total"] > 0))
    mean = F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + x) / longest
    both = sizes.join(counts, list(by)) if by else sizes.join(F.broadcast(counts))
    penalty = F.when(F.col("hyp_len") >= F.col("ref_len"), F.lit(0.0)).otherwise(1 - F.col("ref_len") / F.nullif(F.col("hyp_len"), F.lit(0)))
    return both.select(*by, "hyp_len", "ref_len", F.when(F.col("any"), 100 * F.exp(mean + penalty)).otherwise(F.lit(0.0)).alias("bleu"))


_WORD = re.compile("[a-z0-9]+")


def rouge_words(text: str | None, stemmed: bool = True) -> list[str]:
    """Lower-case runs of ASCII letters and digits; with ``stemmed`` those of more than three are stemmed."""
    found = _WORD.findall((text or "").lower())
    return [stem(w) if len(w) > 3 else w for w in found] if stemmed else found


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(id, hypothesis, reference) -> (id, f): F-measure of shared n-grams of lower-case alphanumeric words, not stemmed; all in built-ins."""
    word = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    parts = pairs.select("id", _grams(word("hypothesis"), n).alias("h"), _grams(word("reference"), n).alias("r"))
    side = lambda s: F.transform(s, lambda g: F.struct(F.lit(s).alias("side"), g.alias("g")))
    each = parts.select("id", F.explode(F.concat(side("h"), side("r"))).alias("x")).groupBy("id", "x.g")
    counts = each.agg(F.count(F.when(F.col("x.side") == "h", 1)).alias("n_h"), F.count(F.when(F.col("x.side") == "r", 1)).alias("n_r"))
    f = F.when(F.sum(F.least("n_h", "n_r")) == 0, F.lit(0.0)).otherwise(2.0 * F.sum(F.least("n_h", "n_r")) / (F.sum("n_h") + F.sum("n_r")))
    scored = counts.groupBy("id").agg(f.alias("f"))
    return pairs.select("id").join(scored, "id", "left").select("id", F.coalesce("f", F.lit(0.0)).alias("f"))


def _shared(a: list, b: list) -> float:
    """F-measure of two multisets."""
    same = (Counter(a) & Counter(b)).total()
    return 2 * same / (len(a) + len(b)) if same else 0.0


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _lcs_hits(reference: Sequence[str], sentences: Sequence[Sequence[str]]) -> set[int]:
    """Places of ``reference`` in the union of its longest common subsequences with each sentence."""
    hits: set[int] = set()
    for s in sentences:
        table = [[0] * (len(s) + 1) for _ in range(len(reference) + 1)]
        for i, x in enumerate(reference):
            for j, y in enumerate(s):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        i, j = len(reference), len(s)
        while i and j:
            if reference[i - 1] == s[j - 1]:
                hits.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
    return hits


def rouge_of(hypothesis: str | None, reference: str | None, stemmed: bool = True) -> tuple[float, float, float, float]:
    """ROUGE-1, -2, -L and -Lsum of two texts: F-measures of shared words, neighbours, the longest common subsequence and, with lines as
    sentences, the union of subsequences of each reference line with all lines."""
    h, r = rouge_words(hypothesis, stemmed), rouge_words(reference, stemmed)
    f = lambda same, n, m: 2 * same / (n + m) if same else 0.0
    hyp, ref = ([rouge_words(x, stemmed) for x in (t or "").split("\n") if x.strip()] for t in (hypothesis, reference))
    left_h, left_r, same = Counter(w for x in hyp for w in x), Counter(w for x in ref for w in x), 0
    for line in ref:
        for at in sorted(_lcs_hits(line, hyp)):
            if left_h[line[at]] > 0 and left_r[line[at]] > 0:
                same += 1
                left_h[line[at]] -= 1
                left_r[line[at]] -= 1
    return _shared(h, r), _shared(list(zip(h, h[1:])), list(zip(r, r[1:]))), f(_lcs(h, r), len(h), len(r)), f(same, sum(map(len, hyp)), sum(map(len, ref)))


def rouge(pairs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(id, hypothesis, reference) -> (id, rouge1, rouge2, rougeL, rougeLsum) of stemmed words; null texts count as empty."""
    names = ["id", "rouge1", "rouge2", "rougeL", "rougeLsum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rouge_of(h, r, stemmed) for h, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = list(zip(*scores)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], names)

    return pairs.select(F.col("id").cast("long"), "hypothesis", "reference").mapInArrow(run, "id long, rouge1 double, rouge2 double, rougeL double, rougeLsum double")


def corpus_rouge(pairs: DataFrame, stemmed: bool = True) -> DataFrame:
    """(n_examples, rouge1, rouge2, rougeL, rougeLsum): means over all examples."""
    return rouge(pairs, stemmed).agg(F.count("*").alias("n_examples"), *(F.avg(c).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")))


def choice_accuracy(scores: DataFrame, *by: str) -> DataFrame:
    """(by..., id, choice, full_ce, answer_ce, prompt_ce, n_chars, gold) -> accuracies by group: the choice of least cost as it is, by its
    characters beyond the prompt, and less the cost of the answer alone. Of equal costs the first choice; nulls never win, nor do choices without characters by characters."""
    costs = {"unnormalized": F.col("full_ce"), "length_normalized": (F.col("full_ce") - F.col("prompt_ce")) / F.nullif("n_chars", F.lit(0)), "prob_normalized": F.col("full_ce") - F.col("answer_ce")}
    best = scores.groupBy(*by, "id").agg(F.first("gold").alias("gold"), *(F.min(F.when(c.isNotNull(), F.struct(c.alias("c"), F.col("choice")))).alias(name) for name, c in costs.items()))
    return best.groupBy(*by).agg(F.count("*").alias("n_examples"), *(F.avg(F.coalesce((F.col(name)["choice"] == F.col("gold")).cast("double"), F.lit(0.0))).alias(name) for name in costs))


def letter_accuracy(logits: DataFrame, *by: str) -> DataFrame:
    """(by..., id, choice, logit, gold) -> (by..., n_examples, acc): the choice of greatest logit, of equal ones the first."""
    best = logits.groupBy(*by, "id").agg(F.first("gold").alias("gold"), F.max(F.struct("logit", (-F.col("choice")).alias("c"))).alias("m"))
    return best.groupBy(*by).agg(F.count("*").alias("n_examples"), F.avg(F.coalesce((-F.col("m.c") == F.col("gold")).cast("double"), F.lit(0.0))).alias("acc"))


def macro_average(by_topic: DataFrame, *metrics: str) -> DataFrame:
    """Unweighted mean of metrics over topics."""
    return by_topic.agg(F.count("*").alias("n_topics"), *(F.avg(m).alias(m) for m in metrics))


def window_means(log: DataFrame, step: str, value: str, size: int) -> DataFrame:
    """(window, lang, n, mean) of ``value`` for each ``size`` steps, by language and overall (lang '*')."""
    named = log.select(F.floor(F.col(step) / size).alias("window"), F.coalesce("lang", F.lit("")).alias("lang"), F.col(value).alias("v"))
    rolled = named.rollup("window", "lang").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.grouping_id().alias("level")).where("level < 3 and n > 0")
    return rolled.select("window", F.when(F.col("level") == 1, F.lit("*")).otherwise(F.col("lang")).alias("lang"), "n", "mean")


def learning_rates(spark: SparkSession, steps: int, peak: float, warmup: int, decay_start: int | None = None, decay_steps: int | None = None, final_share: float = 0.0, shape: str = "linear") -> DataFrame:
    """(step, lr): linear warm-up, a constant part and a decay of the given shape (linear, cosine or 1-sqrt); no decay without a start.

    The warm-up and cosine schedule is that with ``decay_start`` = ``warmup``.
    """
    step = F.col("id").cast("double")
    rate = F.when(step < warmup, peak * step / max(1, warmup)).otherwise(F.lit(float(peak)))
    if decay_start is not None:
        if decay_start < warmup:
            raise ValueError("the decay starts inside of the warm-up")
        length = decay_steps or max(1, steps - decay_start)
        done = F.least(F.lit(1.0), (step - decay_start) / length)
        shapes = {"linear": 1 - done, "cosine": (1 + F.cos(math.pi * done)) / 2, "1-sqrt": 1 - F.sqrt(F.greatest(F.lit(0.0), done))}
        low = peak * final_share
        rate = F.when(step >= decay_start, low + (peak - low) * shapes[shape]).otherwise(rate)
    return spark.range(steps).select(F.col("id").alias("step"), rate.alias("lr"))


def few_shot_prompts(examples: DataFrame, shots: int, prefix: str, pattern: str, *by: str) -> DataFrame:
    """(by..., id, prompt): ``prefix``, the first ``shots`` examples with their answers and the question itself with an empty one.

    ``examples`` is (by..., id, is_shot, question, answer, context); ``pattern`` holds {q} and {a}. A context stands in a line before.
    """
    def text(answer: Column) -> Column:
        filled = F.replace(F.replace(F.lit(pattern), F.lit("{q}"), F.coalesce("question", F.lit(""))), F.lit("{a}"), answer)
        return F.when(F.col("context").isNull(), filled).otherwise(F.concat(F.col("context"), F.lit("\n"), filled))

    first = examples.where("is_shot").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("k") <= shots)
    lines = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", text(F.coalesce("answer", F.lit(""))).alias("line")))).alias("s"))
    head = lines.select(*by, F.concat(F.lit(prefix + "\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n")).alias("head"))
    asked = examples.where("not is_shot").join(F.broadcast(head), [*by], "left")
    return asked.select(*by, "id", F.concat(F.coalesce("head", F.lit(prefix + "\n\n")), F.rtrim(text(F.lit("")))).alias("prompt"))


def top_n_choice(logits: DataFrame, n: int, temperature: float, draw: Column, *by: str) -> DataFrame:
    """(by..., token_id, logit) -> (by..., token_id): one of the ``n`` tokens of greatest logit (of equal ones the smaller id), drawn by softmax at a temperature.

    ``draw`` is a number in (0, 1) for each row; the greatest of logit / temperature - ln(-ln(draw)) is such a draw. At temperature 0 it is the greatest logit.
    """
    ranked = logits.withColumn("_u", draw).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("logit"), "token_id"))).where(F.col("_k") <= n)
    score = F.col("logit") / temperature - F.log(-F.log("_u")) if temperature > 0 else F.col("logit")
    return ranked.groupBy(*by).agg(F.max_by("token_id", F.struct(score, -F.col("_k"))).alias("token_id"))


def first_line(text: Column | str) -> Column:
    """The first line of an output, without surrounding blanks."""
    return F.trim(F.split_part(F.col(text) if isinstance(text, str) else text, F.lit("\n"), F.lit(1)))


def first_paragraph(text: Column | str) -> Column:
    """An output up to the first blank line, without surrounding blanks."""
    return F.trim(F.split_part(F.col(text) if isinstance(text, str) else text, F.lit("\n\n"), F.lit(1)))
