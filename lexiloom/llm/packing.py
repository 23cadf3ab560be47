"""Filling fixed-capacity containers with documents (problem 6).

Harmonic packing: a document of s tokens in a container of C tokens belongs to the class k = floor(C / s), and every bin of
class k takes k of its documents, so which documents share a bin follows from their order in the class alone. Pieces are hashed into
parts of about ``PART_PIECES``, and workers fill the bins of each part without talking to each other.

A second step tops up: what k documents of a class leave free in their bin, less than C / (k + 1), is given to the largest smaller
documents of the part that still fit, before the bins of their own classes are filled. Nothing but the number of bins of each part
is gathered, to number containers from 0.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.runs import Run, documents_of_runs
from lexiloom.tables import cut

#: Pieces that a worker packs at once, about.
PART_PIECES = 50_000


def fill_bins(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each of ``sizes``, which go from large to small; bins are numbered from 0 in the order they are opened.

    Raises ValueError where a size is outside the capacity.
    """
    if any(not 0 < s <= capacity for s in sizes):
        raise ValueError("a size is outside the capacity")
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    kinds = sorted(waiting)
    out = [0] * len(sizes)
    n_bins = 0

    def take(at: int) -> int:
        """One document of the size ``kinds[at]`` for the open bin."""
        size = kinds[at]
        out[waiting[size].pop()] = n_bins
        if not waiting[size]:
            kinds.pop(at)
        return size

    while kinds:
        largest = kinds[-1]
        each = capacity // largest
        least = capacity // (each + 1)  # the class holds the sizes above this
        free, taken = capacity, 0
        while taken < each and kinds and kinds[-1] > least:
            free -= take(len(kinds) - 1)
            taken += 1
        top = len(kinds)
        while free and (top := bisect_right(kinds, free, 0, min(top, len(kinds)))):
            free -= take(top - 1)
        n_bins += 1
    return out


def pieces_of(chosen: DataFrame, runs: list[Run]) -> DataFrame:
    """(run_id, doc_id, piece_no, n_tokens, capacity): whole documents, or full containers and a rest where a document exceeds one."""
    sizes = chosen.sparkSession.createDataFrame([(r.run_id, r.context_size) for r in runs], "run_id int, capacity int")
    cut_up = chosen.join(F.broadcast(sizes), "run_id").withColumn("piece_no", F.explode(F.expr("sequence(0, cast((n_tokens - 1) div capacity as int))")))
    return cut_up.select("run_id", "doc_id", "piece_no", F.expr("cast(least(capacity, n_tokens - piece_no * capacity) as int)").alias("n_tokens"), "capacity")


def pack(sized: DataFrame, runs: list[Run]) -> DataFrame:
    """(run_id, doc_id, piece_no, n_tokens, container, fill_tokens): the container of each document or piece.

    ``sized`` is (doc_id, source, n_code_points, n_tokens), already written. Documents without tokens need no container; an empty table
    gives no rows. The result depends on no layout. Runs with a capacity below 1 raise ValueError.
    """
    if any(r.context_size < 1 for r in runs):
        raise ValueError("context_size is below 1")
    chosen = documents_of_runs(sized, runs)
    sizes = sized.sparkSession.createDataFrame([(r.run_id, r.context_size) for r in runs], "run_id int, capacity int")
    pieces_a_run = chosen.join(F.broadcast(sizes), "run_id").groupBy("run_id").agg(F.sum(F.expr("(n_tokens - 1) div capacity + 1")).alias("n"))
    counts = {r.run_id: r.n for r in pieces_a_run.collect()}  # a row a run
    parts = sized.sparkSession.createDataFrame([(r.run_id, max(1, math.ceil(counts.get(r.run_id, 0) / PART_PIECES))) for r in runs], "run_id int, parts int")
    placed = pieces_of(chosen, runs).join(F.broadcast(parts), "run_id").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts")).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
        pdf["bin"] = fill_bins(pdf.n_tokens.tolist(), int(pdf.capacity.iloc[0]))
        pdf["fill_tokens"] = pdf.groupby("bin").n_tokens.transform("sum")
        return pdf[["run_id", "part", "doc_id", "piece_no", "n_tokens", "bin", "fill_tokens"]]

    schema = "run_id int, part int, doc_id long, piece_no int, n_tokens int, bin long, fill_tokens int"
    packed = cut(placed.drop("parts").groupBy("run_id", "part").applyInPandas(fill, schema))
    earlier = Window.partitionBy("run_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bins = packed.groupBy("run_id", "part").agg((F.max("bin") + 1).alias("bins"))  # a row a part
    before = bins.select("run_id", "part", F.coalesce(F.sum("bins").over(earlier), F.lit(0)).alias("before"))
    return packed.join(before, ["run_id", "part"]).select("run_id", "doc_id", "piece_no", "n_tokens", (F.col("before") + F.col("bin")).alias("container"), "fill_tokens")


def fill_report(packed: DataFrame, runs: list[Run]) -> DataFrame:
    """Containers, tokens and share of filled space of each run; runs without documents are left out."""
    sizes = packed.sparkSession.createDataFrame([(r.run_id, r.context_size) for r in runs], "run_id int, capacity int")
    sums = packed.groupBy("run_id").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("tokens"), (F.max("container") + 1).alias("n_containers"))
    return sums.join(F.broadcast(sizes), "run_id").select("run_id", "capacity", "n_pieces", "tokens", "n_containers", (F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))
