"""Prompt texts for evaluation tasks, as columns and small tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ABCDEFGH"

#: Fixed values: (task, prefix, question pattern, answer pattern, shots) of the multiple-choice tasks.
TASK_FORMATS = (
    ("arc", "The following is a list of elementary questions and answers.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("csqa", "The following is a list of elementary questions and answers.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("exams", "The following is a list of elementary questions and answers.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("belebele", "The following is a list of elementary questions and answers.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("obqa", "The following is a list of elementary questions and answers.", "Question: {q} {a}", "Answer: {a}", 5),
    ("siqa", "The following is a list of elementary questions and answers.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("piqa", "The following is a list of elementary facts.", "{q} {a}", "Answer: {a}", 5),
    ("global_piqa", "The following is a list of elementary facts.", "Goal: {q} Answer: {a}", "Answer: {a}", 0),
    ("hellaswag", "The following is a list of commonsense facts.", "{q} {a}", "Answer: {a}", 0),
    ("winogrande", "The following is a list of elementary facts.", "{a}{q}", "{a}", 5),
    ("sciq", "", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("boolq", "", "Question: {q} Answer: {a}", "Answer: {a}", 5),
    ("mmlu", "The following are multiple choice questions (with answers) about {topic}.", "Question: {q} Answer: {a}", "Answer: {a}", 5),
)


def task_formats(spark: SparkSession) -> DataFrame:
    """The formats as a table that example tables are joined with."""
    return spark.createDataFrame(list(TASK_FORMATS), "task string, prefix string, question_pattern string, answer_pattern string, shots int")


def format_words() -> list[str]:
    """Pre-tokens that the patterns of the formats put into texts, whatever is filled in."""
    return sorted({w for _, _, *patterns, _ in TASK_FORMATS for p in patterns for w in re.findall(r" ?[A-Za-z]+|:", re.sub(r"\{\w\}", "\n", p))})


def topic_prefix(task: str, topic: Column) -> Column:
    """The opening line of a task with its topic, underscores as blanks."""
    prefix = next(p for name, p, *_ in TASK_FORMATS if name == task)
    return F.replace(F.lit(prefix), F.lit("{topic}"), F.replace(topic, F.lit("_"), F.lit(" ")))


def filled(pattern: Column | str, question: Column, answer: Column) -> Column:
    """``pattern`` with its question and answer; nulls count as empty."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    with_question = F.replace(pattern, F.lit("{q}"), F.coalesce(question, F.lit("")))
    return F.replace(with_question, F.lit("{a}"), F.coalesce(answer, F.lit("")))


def cloze_sequences(examples: DataFrame) -> DataFrame:
    """(task, id, question, choices, gold, context) -> (task, id, choice, full, answer, n_chars, gold): what a scorer has to score.

    The row with choice -1 is the prompt with an empty answer. Tasks without a format are left out.
    """
    joined = examples.join(F.broadcast(task_formats(examples.sparkSession)), "task")
    empty = F.transform(F.array(F.lit("")), lambda c: F.struct(F.lit(-1).alias("choice"), c.alias("text")))
    listed = F.transform("choices", lambda c, k: F.struct(k.alias("choice"), c.alias("text")))
    rows = joined.withColumn("x", F.explode(F.concat(empty, F.coalesce(listed, F.array().cast("array<struct<choice: int, text: string> >")))))
    body = filled("question_pattern", F.col("question"), F.col("x.text"))
    full = F.trim(F.when(F.col("context").isNull(), body).otherwise(F.concat("context", F.lit("\n"), body)))
    return rows.select("task", "id", F.col("x.choice").alias("choice"), full.alias("full"), F.trim(filled("answer_pattern", F.lit(""), F.col("x.text"))).alias("answer"), F.length("x.text").alias("n_chars"), "gold")


def letter_prompt(question: Column, choices: Column, context: Column, gold: Column | None = None) -> Column:
    """Question, lettered choices (up to eight) and the answer line, with the letter of ``gold`` if that is given."""
    shown = F.transform(F.slice(choices, 1, len(LETTERS)), lambda c, k: F.concat(F.substring(F.lit(LETTERS), k + 1, F.lit(1)), F.lit(". "), c))
    text = F.concat(question, F.lit("\n"), F.array_join(shown, "\n"), F.lit("\nAnswer:"))
    if gold is not None:
        text = F.concat(text, F.lit(" "), F.substring(F.lit(LETTERS), gold + 1, F.lit(1)))
    return F.when(context.isNull(), text).otherwise(F.concat(context, F.lit("\n"), text))


def _with_shots(examples: DataFrame, shots: int, line: Column, asked: Column, between: str) -> DataFrame:
    order = Window.partitionBy("is_shot").orderBy("id")
    first = examples.where("is_shot").withColumn("k", F.row_number().over(order)).where(F.col("k") <= shots)
    # As many lines as there are shots.
    lines = [r.line for r in first.orderBy("k").select(line.alias("line")).collect()]
    head = F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>")
    return examples.where("not is_shot").select("id", F.array_join(F.concat(head, F.array(asked)), between).alias("prompt"))


def translation_prompts(examples: DataFrame, shots: int, name_q: str, name_a: str) -> DataFrame:
    """(id, is_shot, question, answer array) -> (id, prompt): a line for each shot and the open line of the question."""
    asked = F.concat(F.lit(f"{name_q}: "), F.coalesce("question", F.lit("")), F.lit(f" {name_a}:"))
    answer = F.coalesce(F.get("answer", F.lit(0)), F.lit(""))
    return _with_shots(examples, shots, F.concat(asked, F.lit(" "), answer), asked, "\n")


def summary_prompts(examples: DataFrame, shots: int, name_q: str, name_a: str) -> DataFrame:
    """(id, is_shot, source, summary) -> (id, prompt): shots and the open example, apart by blank lines."""
    text = lambda summary: F.rtrim(F.concat(F.lit(f"{name_q}: "), F.coalesce("source", F.lit("")), F.lit(f"\n{name_a}: "), summary))
    return _with_shots(examples, shots, text(F.coalesce("summary", F.lit(""))), text(F.lit("")), "\n\n")
