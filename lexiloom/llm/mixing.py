"""Mixing sources to target weights (problem 1).

A source with target T and A tokens available is read T / A times, at most ``max_repeats`` times: every document gets the
whole part as copies, and the fractional parts are rounded by the pivotal method. Two fractional documents meet and token
mass moves from one to the other, in a random direction that keeps both expectations, until one of them is 0 or 1. The
total mass never changes, so the chosen tokens of a source miss the target by less than one document.

Documents meet inside of leaves, in order of doc_id; a leaf is a hash of doc_id and there are as many leaves as the largest source
needs. Each leaf leaves at most one fractional document of a source and run, and those meet in a reduction tree. Every
draw is a hash of (seed, source, level, doc_id), so the result depends on the data and the configuration alone, not on partitions.

The one document that is left at the root has a fraction p. It is rounded down, so that no source exceeds its target (the budget is
a bound); all other documents keep their probabilities exactly, this one loses p. With ``draw_last`` it is drawn by p, and a
source may exceed its target by less than that document.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.runs import Run, documents_of_runs
from lexiloom.tables import cut

#: Residuals that meet in one node of the reduction tree.
FAN_IN = 64
#: Documents of the largest source in a leaf, about.
LEAF_DOCUMENTS = 50_000
_EPS = 1e-9
_COLUMNS = ["run_id", "source", "doc_id", "n_tokens", "n_copies", "fraction", "node"]
_ROWS = "run_id int, source string, doc_id long, n_tokens long, n_copies int, fraction double, node int"


def draw(seed: int, source: str, level: int, doc_id: int) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    return (xxhash.xxh64_intdigest(f"{seed}/{source}/{level}/{doc_id}") >> 11) / 2**53


def duel(p: float, a: float, q: float, b: float, u: float) -> tuple[float, float]:
    """One pivotal step on inclusion probabilities p, q of documents with a, b tokens: p * a + q * b stays, one gets integral."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        p, q = p + up / a, q - up / b
    else:
        p, q = p - down / a, q + down / b
    snap = lambda x: 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
    return snap(p), snap(q)


class Pivot:
    """The pivotal method over a stream of fractional documents; one of them is held."""

    def __init__(self, seed: int, source: str, level: int):
        self.key = (seed, source, level)
        self.held: tuple[int, int, int, float] | None = None

    def meet(self, doc_id: int, size: int, copies: int, q: float) -> Iterator[tuple[int, int, int, float]]:
        """Takes (doc_id, tokens, whole copies, fraction); gives the documents that are decided by it, with fraction 0."""
        if q < _EPS or q > 1 - _EPS:
            yield doc_id, size, copies + (q > 0.5), 0.0
        elif self.held is None:
            self.held = (doc_id, size, copies, q)
        else:
            first, self.held = self.held, None
            p, q = duel(first[3], first[1], q, size, draw(*self.key, doc_id))
            for x in ((*first[:3], p), (doc_id, size, copies, q)):
                if x[3] in (0.0, 1.0):
                    yield x[0], x[1], x[2] + int(x[3]), 0.0
                else:
                    self.held = x


def pivotal(items: Iterable[tuple[int, int, int, float]], seed: int, source: str, level: int) -> Iterator[tuple[int, int, int, float]]:
    """(doc_id, tokens, whole copies, fraction) -> the same rows rounded; at most one, the last, keeps a fraction above 0."""
    pivot = Pivot(seed, source, level)
    for item in items:
        yield from pivot.meet(*item)
    if pivot.held is not None:
        yield pivot.held


def read_rates(chosen: DataFrame, runs: list[Run]) -> tuple[dict[tuple[int, str], tuple[float, int]], int]:
    """(run, source) -> (times the source is read, its tokens), as many rows as the configuration has; documents of the largest source."""
    have = {(r.run_id, r.source): r for r in chosen.groupBy("run_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    out = {}
    for run in runs:
        for source, share in run.shares.items():
            tokens = have[run.run_id, source].tokens if (run.run_id, source) in have else 0
            out[run.run_id, source] = (min(share * run.token_budget / tokens, float(run.max_repeats)) if tokens else 0.0, tokens)
    return out, max((r.docs for r in have.values()), default=0)


def mix(sized: DataFrame, runs: list[Run], draw_last: bool = False) -> tuple[DataFrame, dict[tuple[int, str], tuple[float, int]]]:
    """(run_id, source, doc_id, n_tokens, n_copies) of all documents with a copy, and the rates.

    ``sized`` is (doc_id, source, n_code_points, n_tokens), one row a document, already written. Documents without tokens, with a null
    or unlisted source or outside the run's length bounds are never chosen. An empty table gives no rows. A repeated doc_id counts as
    another document.
    """
    chosen = documents_of_runs(sized, runs)
    rates, most = read_rates(chosen, runs)
    seeds = {r.run_id: r.seed for r in runs}
    leaves = max(1, math.ceil(most / LEAF_DOCUMENTS))
    key = ["run_id", "source", "node"]
    placed = chosen.withColumn("node", F.pmod(F.xxhash64("doc_id", F.lit("leaf")), F.lit(leaves)).cast("int"))
    placed = placed.repartition(*key).sortWithinPartitions(*key, "doc_id", "n_tokens").select("run_id", "source", "node", "doc_id", "n_tokens")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot, whole, fraction = None, None, 0, 0.0
        rows: list[tuple] = []
        for batch in batches:
            for run_id, source, node, doc_id, n in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (run_id, source, node):
                    if pivot is not None and pivot.held is not None:
                        rows.append((*group[:2], *pivot.held, group[2]))
                    rate = rates[run_id, source][0]
                    group, pivot, whole = (run_id, source, node), Pivot(seeds[run_id], source, 0), int(rate)
                    fraction = rate - whole
                rows += [(run_id, source, *x, node) for x in pivot.meet(doc_id, n, whole, fraction) if x[2]]
            yield _batch(rows)
            rows = []
        if pivot is not None and pivot.held is not None:
            yield _batch([(*group[:2], *pivot.held, group[2])])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "doc_id"])
        run_id, source, node = int(pdf.run_id.iloc[0]), pdf.source.iloc[0], int(pdf.node.iloc[0]) // FAN_IN
        rows = pivotal(zip(pdf.doc_id.tolist(), pdf.n_tokens.tolist(), pdf.n_copies.tolist(), pdf.fraction.tolist()), seeds[run_id], source, int(pdf.level.iloc[0]))
        return pd.DataFrame([(run_id, source, *x, node) for x in rows], columns=_COLUMNS)

    level = cut(placed.mapInArrow(first, _ROWS))
    done, open_rows, level_no = level.where("fraction = 0"), level.where("fraction > 0"), 0
    while leaves > 1:
        level_no, leaves = level_no + 1, -(-leaves // FAN_IN)
        level = cut(open_rows.withColumn("level", F.lit(level_no)).groupBy("run_id", "source", F.expr(f"node div {FAN_IN}")).applyInPandas(meet, _ROWS))
        done, open_rows = done.unionByName(level.where("fraction = 0")), level.where("fraction > 0")
    if draw_last:
        # One row of each source and run: configuration-sized.
        last = [(r.run_id, r.source, r.doc_id, r.n_tokens, r.n_copies + (draw(seeds[r.run_id], r.source, -1, r.doc_id) < r.fraction), 0.0, 0) for r in open_rows.collect()]
        open_rows = sized.sparkSession.createDataFrame(last, _ROWS)
    rounded = done.unionByName(open_rows).where("n_copies > 0")
    return rounded.select("run_id", "source", "doc_id", "n_tokens", "n_copies"), rates


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _COLUMNS)


def source_shares(mixed: DataFrame, runs: list[Run], rates: dict[tuple[int, str], tuple[float, int]]) -> DataFrame:
    """Target and actual tokens and shares of each source of each run; sources that give nothing are listed with 0."""
    plan = [(r.run_id, s, share, share * r.token_budget, rates[r.run_id, s][1], rates[r.run_id, s][0]) for r in runs for s, share in r.shares.items()]
    plan = mixed.sparkSession.createDataFrame(plan, "run_id int, source string, target_share double, target_tokens double, available_tokens long, times_read double")
    got = mixed.groupBy("run_id", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.count("*").alias("docs"))
    both = plan.join(got, ["run_id", "source"], "left").withColumn("actual_tokens", F.coalesce("tokens", F.lit(0)))
    of_run = both.groupBy("run_id").agg(F.sum("actual_tokens").alias("of_run"))
    share = F.when(F.col("of_run") > 0, F.col("actual_tokens") / F.col("of_run")).otherwise(F.lit(0.0))
    return both.join(of_run, "run_id").select("run_id", "source", "target_share", "target_tokens", "available_tokens", "times_read", "actual_tokens", share.alias("actual_share"), F.coalesce("docs", F.lit(0)).alias("n_docs"))
