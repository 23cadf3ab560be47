"""Scorers of texts: anything that gives a table of texts their costs can take a language model's place in the evaluation of choices.

Costs are whole millionths of a nat, so that sums don't depend on their order and equal costs are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import pretokens
from lexiloom.operators import prompts

#: (key, text) -> (key, cost); keys are different, texts needn't be.
Scorer = Callable[[DataFrame], DataFrame]
MICRO = 1_000_000
#: Most words of the model that are broadcast, about 100 bytes each.
HEAD_WORDS = 65_536


def word_scorer(words: DataFrame, common: Sequence[str] = (), head: int = HEAD_WORDS) -> Scorer:
    """A scorer by word frequencies (word, freq), one added to each count; ``words`` has to be written already.

    Costs of the most frequent words are broadcast, at most ``head`` of them, and summed where the text is; only other words are
    shuffled, with the key of their text. ``common`` are a few words of many texts, which are broadcast even if the model lacks them.
    """
    z = words.agg(F.log(F.sum("freq") + F.count("*")).alias("z")).first().z or 0.0
    cost = lambda freq: F.round(MICRO * (F.lit(z) - F.log(freq + 1))).cast("long")
    octave = F.floor(F.log2("freq") * 8)
    taken, least = 0, 1 << 20
    for r in sorted(words.groupBy(octave.alias("octave")).count().collect(), key=lambda r: -r.octave):  # at most 8 * 64 rows
        taken += r["count"]
        if taken > head:
            break
        least = r.octave
    given = words.sparkSession.createDataFrame([(w,) for w in sorted(set(common))], "word string")
    near = (octave >= least) | F.col("word").isin(*sorted(set(common)))
    lacking = given.join(words.where(near), "word", "left_anti").select("word", F.lit(0).alias("freq"))
    frequent = words.where(near).select("word", "freq").union(lacking).select("word", cost(F.col("freq")).alias("near"))
    others = words.where(~near).select("word", cost(F.col("freq")).alias("far"), F.xxhash64("word").alias("at"))

    def score(texts: DataFrame) -> DataFrame:
        parts = texts.select("key", F.explode_outer(pretokens("text")).alias("word")).join(F.broadcast(frequent), "word", "left")
        # One row a text for its frequent words, without a word, and one for each other word.
        counts = parts.groupBy("key", F.when(F.col("near").isNull(), F.col("word")).alias("word")).agg(F.sum("near").alias("near"), F.count("word").alias("n"))
        # Rows without a word match nothing; their keys spread them.
        placed = counts.withColumn("at", F.when(F.col("word").isNull(), F.xxhash64("key")).otherwise(F.xxhash64("word")))
        each = placed.join(others, ["word", "at"], "left")
        costs = F.when(F.col("word").isNull(), F.coalesce("near", F.lit(0))).otherwise(F.col("n") * F.coalesce("far", cost(F.lit(0))))
        return each.groupBy("key").agg(F.sum(costs).cast("long").alias("cost"))

    return score


def choice_scores(examples: DataFrame, scorer: Scorer) -> DataFrame:
    """(task, id, question, choices, gold, context) -> (task, id, choice, full_ce, answer_ce, prompt_ce, n_chars, gold) by a scorer.

    Tasks without a format and examples without choices or id give no rows; of examples with the same task and id each choice meets each
    prompt. Texts are never shuffled, only their keys, which hold all else that the result needs.
    """
    same = examples.where("task is not null and id is not null").groupBy("task", "id").agg(F.array_sort(F.collect_list(F.struct("question", "choices", "gold", "context"))).alias("same"))
    rows = prompts.cloze_sequences(same.select("task", "id", F.posexplode("same").alias("nth", "x")).select("task", F.struct("id", "nth").alias("id"), "x.*"))
    side = lambda name, text: F.struct(F.struct("task", "id.id", "id.nth", "choice", "n_chars", "gold", F.lit(name).alias("side")).alias("key"), text.alias("text"))
    both = F.array(side("full", F.col("full")), side("answer", F.when(F.col("choice") >= 0, F.col("answer"))))
    costs = scorer(rows.select(F.explode(F.filter(both, lambda x: x["text"].isNotNull())).alias("x")).select("x.key", "x.text"))
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("cost"))).alias(f"{name}_ce")
    each = costs.select("key.*", "cost").repartition("task", "id").groupBy("task", "id", "nth", "choice", "n_chars", "gold").agg(of("full"), of("answer"))
    choices = F.collect_list(F.when(F.col("choice") >= 0, F.struct("choice", "full_ce", "answer_ce", "n_chars", "gold")))
    met = each.groupBy("task", "id").agg(F.collect_list(F.when(F.col("choice") == -1, F.col("full_ce"))).alias("prompt"), choices.alias("x"))
    met = met.select("task", "id", "x", F.explode("prompt").alias("prompt_ce")).select("task", "id", "prompt_ce", F.explode("x").alias("x"))
    return met.select("task", "id", "x.choice", "x.full_ce", "x.answer_ce", "prompt_ce", "x.n_chars", "x.gold")
