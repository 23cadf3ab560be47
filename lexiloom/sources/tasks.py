"""Reading evaluation tasks: multiple choice in five shapes, parallel text, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGH"


def multiple_choice(spark: SparkSession, path: str) -> DataFrame:
    """(question, choices, gold, context) of JSON lines with question, choices, answer and perhaps context."""
    return spark.read.schema("question string, choices array<string>, answer int, context string").json(path).select("question", "choices", F.col("answer").alias("gold"), "context")


def labelled_choices(spark: SparkSession, path: str) -> DataFrame:
    """The same of questions with a stem and labelled choices; rows whose key is no label are left out, of equal labels the last counts."""
    rows = spark.read.schema("question struct<stem: string, choices: array<struct<label: string, text: string> > >, answerKey string").json(path)
    n = F.size("question.choices")
    back = F.array_position(F.reverse(F.transform("question.choices", lambda c: c["label"])), F.col("answerKey"))
    gold = F.when(back > 0, n - back).cast("int")
    out = rows.select(F.col("question.stem").alias("question"), F.transform("question.choices", lambda c: c["text"]).alias("choices"), gold.alias("gold"), F.lit(None).cast("string").alias("context"))
    return out.where("gold is not null")


def endings(spark: SparkSession, path: str) -> DataFrame:
    """The same of contexts with endings; an activity label stands before the context."""
    rows = spark.read.schema("ctx string, endings array<string>, label string, activity_label string").json(path)
    question = F.concat(F.coalesce(F.concat("activity_label", F.lit(": ")), F.lit("")), F.col("ctx"))
    return rows.select(question.alias("question"), F.col("endings").alias("choices"), F.col("label").cast("int").alias("gold"), F.lit(None).cast("string").alias("context"))


def two_contexts(spark: SparkSession, path: str) -> DataFrame:
    """The same of two contexts with one end: the end is the question, the contexts are the choices."""
    rows = spark.read.schema("ctx array<string>, end string, label int").json(path)
    return rows.select(F.col("end").alias("question"), F.col("ctx").alias("choices"), F.col("label").alias("gold"), F.lit(None).cast("string").alias("context"))


def topic_csv(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(topic, question, choices, gold) of CSV files <topic>_<split>.csv in the split's folder: question, four choices, letter."""
    rows = spark.read.schema("question string, a string, b string, c string, d string, letter string").csv(f"{path}/{split}", quote='"', escape='"', multiLine=True)
    topic = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)_{split}\.csv$", 1)
    return rows.select(topic.alias("topic"), "question", F.array("a", "b", "c", "d").alias("choices"), F.expr(f"instr('{LETTERS}', trim(letter)) - 1").alias("gold"))


def parallel(left: DataFrame, right: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """(line_id, question, answer) -> the same; ``reverse`` swaps them, ``right`` gives the answers of the same lines.

    Two files are paired by line, up to the end of the shorter one; raises ValueError if their questions differ.
    """
    if right is not None:
        both = left.join(right.select("line_id", F.col("question").alias("q2"), F.col("answer").alias("a2")), "line_id")
        if both.where("not question <=> q2").limit(1).count():
            raise ValueError("the files don't hold the same questions")
        left = both.select("line_id", F.get("answer", F.lit(0)).alias("question"), F.col("a2").alias("answer"))
    if reverse:
        left = left.select("line_id", F.get("answer", F.lit(0)).alias("question"), F.array("question").alias("answer"))
    return left


def summaries(spark: SparkSession, path: str, source: str = "text", target: str = "summary", title: str | None = None) -> DataFrame:
    """(source, summary) of JSON lines by field names; with ``title`` that field stands in a line before the source."""
    fields = [source, target] + ([title] if title else [])
    rows = spark.read.schema(", ".join(f"`{f}` string" for f in fields)).json(path)
    text = F.concat_ws("\n", F.col(title), F.col(source)) if title else F.col(source)
    return rows.select(text.alias("source"), F.col(target).alias("summary"))
