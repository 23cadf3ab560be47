"""Vocabularies: union, language masks, id maps, restriction to languages, validation. Relations of tokenizer size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Names of special tokens and the forms of byte and unused pieces.
SPECIAL_NAMES = ("<s>", "</s>", "<pad>", "<unk>")
BYTE_PIECE, UNUSED_PIECE = "^<0x[0-9A-Fa-f]{2}>$", "^<unused[0-9]+>$"


def is_special(piece: Column | str, unused: bool = False) -> Column:
    """Whether a piece is a special token or a byte piece; with ``unused`` also whether it is reserved."""
    piece = F.col(piece) if isinstance(piece, str) else piece
    out = piece.isin(*SPECIAL_NAMES) | piece.rlike(BYTE_PIECE)
    return out | piece.rlike(UNUSED_PIECE) if unused else out


def union(vocabs: DataFrame) -> DataFrame:
    """(position, own_id, piece) -> (token_id, piece): the first vocabulary and id that has a piece gives its place."""
    first = Window.partitionBy("piece").orderBy("position", "own_id")
    kept = vocabs.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select((F.row_number().over(Window.orderBy("position", "own_id")) - 1).alias("token_id"), "piece")


def language_ids(vocabs: DataFrame, merged: DataFrame) -> DataFrame:
    """(lang, token_id): ids in ``merged`` (token_id, piece) of the pieces of each language's vocabulary (lang, piece)."""
    return vocabs.join(F.broadcast(merged), "piece").select("lang", "token_id").distinct()


def common_mask(counts: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """(lang, token_id): special tokens and the most frequent others, ``size`` in all; of equal counts the smaller id first.

    ``counts`` is (lang, token_id, n). A ``size`` below the number of special tokens keeps just those.
    """
    specials = sorted(r.token_id for r in vocab.where("is_special").select("token_id").collect())
    room = max(0, size - len(specials))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "token_id")
    content = counts.where(~F.col("token_id").isin(specials)) if specials else counts
    content = content.withColumn("k", F.row_number().over(order)).where(F.col("k") <= room).select("lang", "token_id")
    if not specials:
        return content
    named = counts.select("lang").distinct().withColumn("token_id", F.explode(F.array(*map(F.lit, specials))))
    return content.unionByName(named)


def subtokenizer_name(langs: Sequence[str]) -> str:
    """Sorted distinct languages joined by commas."""
    return ",".join(sorted(set(langs)))


def name_of(langs: Column) -> Column:
    """:func:`subtokenizer_name` of an array of languages."""
    return F.array_join(F.array_sort(F.array_distinct(langs)), ",")


def subtokenizer_mask(masks: DataFrame, vocab: DataFrame, subtok: str | None) -> DataFrame:
    """Distinct token_ids of a subtokenizer: the union of its languages and the special tokens; unknown languages add nothing.

    ``all`` and None stand for the whole vocabulary.
    """
    if subtok in (None, "all"):
        return vocab.select("token_id").distinct()
    langs = [x.strip() for x in subtok.split(",")]
    return masks.where(F.col("lang").isin(langs)).select("token_id").union(vocab.where("is_special").select("token_id")).distinct()


def monolingual_mask(vocabs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(lang, token_id): pieces of each language's own vocabulary that the global one has; others are dropped."""
    return vocabs.join(F.broadcast(vocab.select("token_id", "piece")), "piece").select("lang", "token_id").distinct()


def id_map(masks: DataFrame, *by: str) -> DataFrame:
    """(by..., sub_id, global_id): kept ids renumbered from 0 in global order."""
    order = Window.partitionBy(*by).orderBy("token_id")
    return masks.select(*by, (F.row_number().over(order) - 1).alias("sub_id"), F.col("token_id").alias("global_id"))


def dense_map(mapping: DataFrame, size: int) -> DataFrame:
    """(global_id, sub_id) for every id below ``size``, -1 where the map has none."""
    whole = mapping.sparkSession.range(size).select(F.col("id").cast("int").alias("global_id"))
    return whole.join(F.broadcast(mapping), "global_id", "left").select("global_id", F.coalesce("sub_id", F.lit(-1)).alias("sub_id"))


def restrict_merges(merges: DataFrame, pieces: DataFrame) -> DataFrame:
    """Merges whose parts and result are all in ``pieces`` (piece), in their order, renumbered from 0."""
    keep = F.broadcast(pieces.select("piece").distinct())
    out = merges.withColumn("ab", F.concat("a", "b"))
    for side in ("a", "b", "ab"):
        out = out.join(keep.withColumnRenamed("piece", side), side, "left_semi")
    return out.select((F.row_number().over(Window.orderBy("merge_no")) - 1).alias("merge_no"), "a", "b")


def new_tokens(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """(ord, piece) -> (token_id, piece): tokens that ``base`` lacks, numbered after its last id in their order."""
    size = base.count()
    fresh = tokens.join(F.broadcast(base.select("piece")), "piece", "left_anti")
    return fresh.select((F.row_number().over(Window.orderBy("ord")) - 1 + size).alias("token_id"), "piece")


def unbuildable(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """(merge_no, piece): parts and results of merges that the vocabulary lacks; none in a sound tokenizer."""
    parts = merges.select("merge_no", F.explode(F.array("a", "b", F.concat("a", "b"))).alias("piece"))
    return parts.join(F.broadcast(vocab.select("piece")), "piece", "left_anti").select("merge_no", "piece").distinct()


def underived(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """(token_id, piece): tokens that no merge builds."""
    built = merges.select(F.concat("a", "b").alias("piece")).distinct()
    return vocab.join(F.broadcast(built), "piece", "left_anti").select("token_id", "piece")


def validate(vocab: DataFrame, merges: DataFrame, lang_ids: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(rule, n): violations of each rule of a tokenizer directory; all 0 in a sound one.

    ``extracted`` (lang, piece), the vocabularies of subtokenizers, have to be part of the global one and as large as the language's ids.
    """
    size = vocab.count()
    checks = {
        "duplicate_id": vocab.groupBy("token_id").count().where("count > 1"),
        "duplicate_piece": vocab.groupBy("piece").count().where("count > 1"),
        "id_out_of_range": vocab.where((F.col("token_id") < 0) | (F.col("token_id") >= size)),
        "language_id_unknown": lang_ids.join(F.broadcast(vocab.select("token_id")), "token_id", "left_anti"),
        "merge_not_buildable": unbuildable(merges, vocab),
    }
    if extracted is not None:
        sizes = [df.groupBy("lang").agg(F.count("*").alias(name)) for df, name in ((extracted, "pieces"), (lang_ids, "ids"))]
        checks["extracted_unknown"] = extracted.join(F.broadcast(vocab.select("piece")), "piece", "left_anti")
        checks["extracted_size"] = sizes[0].join(sizes[1], "lang", "left").where("not pieces <=> ids")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def padded_size(size: int, multiple: int | None) -> int:
    """``size`` rounded up to a multiple."""
    return size if not multiple else -(-size // multiple) * multiple
