"""Batches of tokens cut from streams of documents, as a relational plan.

A buffer (language and subtokenizer) is a first-in-first-out queue of tokens, and a batch takes ``n_target`` of them, so batch b owns
the tokens [b N, (b + 1) N) of the running sum of lengths. At most one buffer of a language is ready at any time, hence
batches of a language come in the order of the document that completes them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.operators.order import block_of, rank_from_zero, running_sum


def spans(stream: DataFrame, n_target: int) -> DataFrame:
    """(lang, subtok, b, pos, doc_id, first, grab, share_bytes): the part of each document in each full batch.

    ``stream`` is (lang, subtok, pos, doc_id, n_tokens, n_bytes); documents without tokens are skipped. ``first`` is the place of
    the part in the document, from 0.
    """
    blocks = stream.where("n_tokens > 0").withColumn("block", block_of("pos"))
    ends = running_sum(blocks, ["lang", "subtok"], ["block"], ["pos"], F.col("n_tokens"), "stop").withColumn("start", F.col("stop") - F.col("n_tokens"))
    parts = ends.withColumn("b", F.explode(F.expr(f"sequence(start div {n_target}, (stop - 1) div {n_target})")))
    parts = parts.withColumn("first", F.greatest(F.lit(0), F.col("b") * n_target - F.col("start")))
    parts = parts.withColumn("grab", F.least("stop", (F.col("b") + 1) * n_target) - F.greatest("start", F.col("b") * n_target))
    whole = Window.partitionBy("lang", "subtok", "b")
    parts = parts.withColumn("filled", F.sum("grab").over(whole)).where(F.col("filled") == n_target)
    return parts.select("lang", "subtok", "b", "pos", "doc_id", "first", "grab", (F.col("n_bytes") * F.col("grab") / F.col("n_tokens")).alias("share_bytes"))


def batch_factors(parts: DataFrame) -> DataFrame:
    """(lang, subtok, b, n_tokens, n_docs, ready_pos, c_bpb): tokens over bytes over ln 2 of each batch; 0 where there are no bytes."""
    sums = parts.groupBy("lang", "subtok", "b").agg(F.sum("grab").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("pos").alias("ready_pos"), F.sum("share_bytes").alias("n_bytes"))
    factor = F.when(F.col("n_bytes") > 0, F.col("n_tokens") / F.col("n_bytes") / math.log(2)).otherwise(F.lit(0.0))
    return sums.select("lang", "subtok", "b", "n_tokens", "n_docs", "ready_pos", factor.alias("c_bpb"))


def readiness(stream: DataFrame, n_target: int) -> DataFrame:
    """(lang, subtok, n_ready, waiting): full batches of each buffer, and its tokens beyond them."""
    sums = stream.groupBy("lang", "subtok").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"))
    return sums.select("lang", "subtok", F.expr(f"n div {n_target}").alias("n_ready"), (F.col("n") % n_target).alias("waiting"))


def emission_order(factors: DataFrame) -> DataFrame:
    """``factors`` with ``nth``, the place of each batch among those of its language."""
    return rank_from_zero(factors.withColumn("block", block_of("ready_pos")), ["lang"], ["block"], ["ready_pos", "b"], "nth").drop("block")


def scheduled(factors: DataFrame, schedule: DataFrame) -> DataFrame:
    """The batch of each step: (step, lang, nth) of the schedule joined with batches in emission order."""
    return schedule.join(emission_order(factors), ["lang", "nth"])


def batch_rows(parts: DataFrame, tokens: DataFrame, batch_size: int, context_size: int) -> DataFrame:
    """(lang, subtok, b, row, x, y): input and shifted target of each row; ``tokens`` is (doc_id, tokens array<int>)."""
    cut_out = parts.join(tokens, "doc_id").withColumn("piece", F.expr("slice(tokens, cast(first + 1 as int), cast(grab as int))"))
    flat = cut_out.groupBy("lang", "subtok", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    flat = flat.withColumn("flat", F.flatten(F.transform("pieces", lambda p: p["piece"])))
    width = context_size + 1
    rows = flat.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))))
    row = F.expr(f"slice(flat, row * {width} + 1, {width})")
    return rows.select("lang", "subtok", "b", "row", row.alias("r")).select("lang", "subtok", "b", "row", F.slice("r", 1, context_size).alias("x"), F.slice("r", 2, context_size).alias("y"))


def snapshot(stream: DataFrame, parts: DataFrame, taken: DataFrame) -> DataFrame:
    """(lang, subtok, last_pos, last_n_tokens, anchor_pos): where consumption of each buffer stands after the batches ``taken``.

    ``taken`` is (lang, subtok, n_batches). ``anchor_pos`` is the first document of the buffer with tokens left, null if none is.
    """
    done = parts.join(taken, ["lang", "subtok"]).where("b < n_batches")
    used = done.groupBy("lang", "subtok", "pos").agg(F.sum("grab").alias("used"))
    last = used.groupBy("lang", "subtok").agg(F.max(F.struct("pos", "used")).alias("l")).select("lang", "subtok", F.col("l.pos").alias("last_pos"), F.col("l.used").alias("last_n_tokens"))
    left = stream.where("n_tokens > 0").join(used, ["lang", "subtok", "pos"], "left").where(F.coalesce("used", F.lit(0)) < F.col("n_tokens"))
    anchor = left.groupBy("lang", "subtok").agg(F.min("pos").alias("anchor_pos"))
    return anchor.join(last, ["lang", "subtok"], "full").select("lang", "subtok", "last_pos", "last_n_tokens", "anchor_pos")


def restore(stream: DataFrame, state: DataFrame) -> DataFrame:
    """``stream`` without what a snapshot says is consumed: documents after the last one, and the rest of that."""
    joined = stream.join(state.select("lang", "subtok", "last_pos", "last_n_tokens"), ["lang", "subtok"], "left")
    ahead = joined.where(F.col("last_pos").isNull() | (F.col("pos") >= F.col("last_pos")))
    used = F.when(F.col("pos") == F.col("last_pos"), F.col("last_n_tokens")).otherwise(F.lit(0))
    out = ahead.withColumn("used", F.coalesce(used, F.lit(0))).where("used < n_tokens")
    return out.drop("last_pos", "last_n_tokens")


def restore_faults(stream: DataFrame, state: DataFrame, then: dict[str, object], now: dict[str, object]) -> list[str]:
    """Why a snapshot doesn't fit a stream; empty if it does.

    ``then`` and ``now`` are the facts that have to be the same (world size, rank, seed); the buffers have to be the same too, and no
    buffer may have been read further than the stream goes.
    """
    faults = [f"{k}: {then.get(k)!r} then, {now.get(k)!r} now" for k in sorted({*then, *now}) if then.get(k) != now.get(k)]
    ends = stream.groupBy("lang", "subtok").agg(F.max("pos").alias("end")).withColumn("here", F.lit(True))
    both = ends.join(state.withColumn("there", F.lit(True)), ["lang", "subtok"], "full")
    counts = both.agg(
        F.count(F.when(F.col("there").isNull(), 1)).alias("new"), F.count(F.when(F.col("here").isNull(), 1)).alias("gone"), F.count(F.when(F.greatest("last_pos", "anchor_pos") > F.col("end"), 1)).alias("beyond")
    ).first()
    names = {"new": "buffers that the snapshot lacks", "gone": "buffers that are gone", "beyond": "buffers read beyond the stream"}
    return faults + [f"{name}: {counts[k]}" for k, name in names.items() if counts[k]]


def padded(tokens: Column, length: int, pad: int, left: bool = False) -> Column:
    """``tokens`` filled up with ``pad`` to ``length``; longer ones keep their first tokens on either side."""
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(tokens)).cast("int"))
    both = F.concat(fill, tokens) if left else F.concat(tokens, fill)
    return F.slice(both, 1, length)


def numbered_batches(items: DataFrame, order: str, size: int) -> DataFrame:
    """``items`` with ``batch``: groups of ``size`` in order of the whole number ``order``, the last one may be short."""
    ranked = rank_from_zero(items.withColumn("_block", block_of(order)), [], ["_block"], [order], "_rank")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).drop("_block", "_rank")
