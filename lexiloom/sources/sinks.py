"""Writing of metrics, scores and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.operators.order import block_of, rank_from_zero
from lexiloom.sources.files import write_json


def append_metrics(metrics: DataFrame, run: dict[str, str], folder: str) -> None:
    """Metric rows with the run's facts, appended as JSON lines."""
    metrics.select(*(F.lit(v).alias(k) for k, v in run.items()), "*").coalesce(1).write.mode("append").json(folder)


def write_scores(scores: dict[str, float], round_no: int, spark: SparkSession, folder: str) -> None:
    """Scores of one training round, in a partition of its own."""
    rows = spark.createDataFrame([(p, s, round_no) for p, s in scores.items()], "piece string, score double, iter int")
    rows.write.mode("append").partitionBy("iter").parquet(folder)


def write_nsl(nsl: DataFrame, path: str) -> None:
    """Normalized sequence lengths (lang, n_tokens, n_tokens_ref, nsl) as one JSON object by language; as many rows as languages."""
    write_json(nsl.sparkSession, {r.lang: {"nsl": r.nsl, "n_tokens": r.n_tokens, "n_tokens_ref": r.n_tokens_ref} for r in nsl.orderBy("lang").collect()}, path)


def count_snapshots(counts: DataFrame, every: int) -> DataFrame:
    """(doc_id, token_id, n) -> (snapshot, docs, token_id, n): counts of tokens in the first ``every``, twice ``every``, ... documents by doc_id and in all.

    ``counts`` has a row with a null token for each document without tokens. A snapshot holds what was counted until then, tokens with none left out.
    """
    docs = counts.select("doc_id").distinct().withColumn("block", block_of("doc_id"))
    placed = rank_from_zero(docs, [], ["block"], ["doc_id"], "place").withColumn("part", F.floor(F.col("place") / every))
    sizes = placed.groupBy("part").agg((F.max("place") + 1).alias("docs"))  # a row a snapshot
    parts = counts.where("token_id is not null").join(placed.select("doc_id", "part"), "doc_id").groupBy("part", "token_id").agg(F.sum("n").alias("n"))
    last = sizes.agg(F.max("part").alias("last")).first().last or 0
    order = Window.partitionBy("token_id").orderBy("part")  # a row a snapshot and token
    upto = parts.withColumn("n", F.sum("n").over(order)).withColumn("until", F.coalesce(F.lead("part").over(order), F.lit(last + 1)) - 1)
    held = upto.select("token_id", "n", F.explode(F.sequence("part", "until")).alias("part"))
    return held.join(sizes, "part").select(F.col("part").alias("snapshot"), "docs", "token_id", "n")
