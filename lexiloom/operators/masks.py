"""Language masks by strategy, restricted unigram models, and what a model's edges need of them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.operators import vocab as V


class Extraction(Enum):
    """Where the part of the vocabulary that a language sees comes from."""

    NONE = "none"
    COMMON = "common"
    MERGED_NORM = "merged_norm"
    MERGED_SEQ_BPE = "merged_seq_bpe"
    MERGED_UNNORM = "merged_unnorm"


def language_masks(strategy: Extraction, vocab: DataFrame, langs: list[str], counts: DataFrame | None = None, size: int = 0, lang_ids: DataFrame | None = None, own_vocabs: DataFrame | None = None) -> DataFrame:
    """(lang, token_id): what each language sees; special tokens always belong to it.

    Without a strategy that is everything; by COMMON the most frequent tokens (``counts``, ``size``); by the merged strategies the ids
    recorded at training (``lang_ids``) or the pieces of the language's own vocabulary (``own_vocabs``). Raises ValueError if the table is missing.
    """
    spark = vocab.sparkSession
    named = spark.createDataFrame([(x,) for x in langs], "lang string")
    # Each language with the whole vocabulary: the languages are configuration, the vocabulary stays where it is.
    every = vocab.withColumn("lang", F.explode(F.array(*map(F.lit, langs)))) if langs else vocab.withColumn("lang", F.lit(None).cast("string")).where("false")
    if strategy is Extraction.NONE:
        return every.select("lang", "token_id")
    table = {Extraction.COMMON: counts, Extraction.MERGED_NORM: lang_ids, Extraction.MERGED_SEQ_BPE: lang_ids, Extraction.MERGED_UNNORM: own_vocabs}[strategy]
    if table is None:
        raise ValueError(f"{strategy.value} needs its table")
    table = table.join(F.broadcast(named), "lang", "left_semi")
    if strategy is Extraction.COMMON:
        return V.common_mask(table, vocab, size)
    ids = V.monolingual_mask(table, vocab) if strategy is Extraction.MERGED_UNNORM else table.select("lang", "token_id")
    return ids.union(every.where("is_special").select("lang", "token_id")).distinct()


def pieces_by_language(lang_ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, piece, token_id) of the tokens each language sees."""
    return lang_ids.join(F.broadcast(vocab.select("token_id", "piece")), "token_id").select("lang", "piece", "token_id")


def restrict_unigram(vocab: DataFrame, keep: DataFrame) -> DataFrame:
    """(sub_id, piece, score) of the kept pieces of a scored vocabulary, renumbered in global order; scores stay."""
    kept = vocab.join(F.broadcast(keep.select("token_id").distinct()), "token_id", "left_semi")
    return kept.select((F.row_number().over(Window.orderBy("token_id")) - 1).alias("sub_id"), "piece", "score")


def logit_mask(mask: DataFrame, size: int) -> DataFrame:
    """(token_id, add): 0 for ids in ``mask`` and minus infinity for the others below ``size``."""
    ids = mask.sparkSession.range(size).select(F.col("id").cast("int").alias("token_id"))
    seen = F.broadcast(mask.select("token_id", F.lit(0.0).alias("add")).distinct())
    return ids.join(seen, "token_id", "left").select("token_id", F.coalesce("add", F.lit(float("-inf"))).alias("add"))


def missing_languages(used: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct languages of ``used`` that ``known`` lacks; none if an evaluation can run."""
    return used.select("lang").distinct().join(F.broadcast(known.select("lang").distinct()), "lang", "left_anti")
