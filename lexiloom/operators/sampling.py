"""Subtokenizers and languages drawn for documents and batches."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.seeds import block_starts, chain, create_seed
from lexiloom.operators.order import block_of, rank_from_zero
from lexiloom.operators.vocab import subtokenizer_name


class Strategy(Enum):
    """How subtokenizers of several languages are drawn."""

    FULL = "full"
    DATA_WEIGHTED = "data_weighted"
    UNIFORM = "uniform"


@dataclass(frozen=True)
class SamplingConfig:
    """Which subtokenizers the documents of a language may use. Raises ValueError where a field is missing or out of place."""

    strategy: Strategy | None = None
    p_lang: float | None = None
    n_groups: int | None = None
    n_extra_langs: int | None = None
    main_lang: str | None = None
    p_main_lang: float | None = None

    def __post_init__(self) -> None:
        if (self.strategy is None) != (self.p_lang is None):
            raise ValueError("strategy and p_lang go together")
        needed = {Strategy.UNIFORM: ("n_groups", "n_extra_langs"), Strategy.DATA_WEIGHTED: ("n_groups", "n_extra_langs", "main_lang", "p_main_lang")}
        if missing := [f for f in needed.get(self.strategy, ()) if getattr(self, f) is None]:
            raise ValueError(f"missing: {', '.join(missing)}")
        if self.strategy is Strategy.UNIFORM and (self.main_lang, self.p_main_lang) != (None, None):
            raise ValueError("no main language when all are drawn alike")

    def groups(self, lang: str, langs: Sequence[str], rng: random.Random) -> list[str]:
        """Distinct subtokenizers of ``lang`` with extra languages, in the order drawn; within one none is drawn twice."""
        others = [x for x in langs if x != lang]
        weight = {x: 1.0 for x in others}
        if self.strategy is Strategy.DATA_WEIGHTED and self.main_lang in others:
            rest = len(others) - 1
            weight = {x: self.p_main_lang if x == self.main_lang else (1 - self.p_main_lang) / rest for x in others}
        out: dict[str, None] = {}
        for _ in range(self.n_groups if others else 0):
            left, picked = {x: w for x, w in weight.items() if w > 0}, []
            while left and len(picked) < self.n_extra_langs:
                picked.append(rng.choices(list(left), list(left.values()))[0])
                del left[picked[-1]]
            out.setdefault(subtokenizer_name([lang, *picked]))
        return list(out)

    def table(self, spark: SparkSession, langs: Sequence[str], seed: int = 0) -> DataFrame:
        """(lang, subtok, p, ord): subtokenizers of each language with probabilities."""
        rows = []
        for lang in langs:
            if self.strategy is None:
                names = ["all"]
            elif self.strategy is Strategy.FULL:
                names = [lang, "all"]
            else:
                extra = self.groups(lang, langs, random.Random(create_seed(seed, "groups", lang)))
                names = [lang, *(n for n in extra if n != lang)]
            for k, name in enumerate(names):
                p = 1.0 if self.p_lang is None else self.p_lang if k == 0 else (1 - self.p_lang) / (len(names) - 1)
                rows.append((lang, name, p, k))
        return spark.createDataFrame(rows, "lang string, subtok string, p double, ord int")


def normalized_weights(runs: DataFrame) -> DataFrame:
    """(run_id, source, share): the normalized weight of each source of a run; a source without weight counts 1."""
    listed = runs.select("run_id", "weights", F.explode(F.map_keys("sources")).alias("source"))
    weight = F.coalesce(F.element_at("weights", F.col("source")), F.lit(1.0))
    listed = listed.select("run_id", "source", weight.alias("w"))
    total = listed.groupBy("run_id").agg(F.sum("w").alias("total"))
    return listed.join(total, "run_id").select("run_id", "source", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


#: Draws of a chain that a worker makes in one row of the plan.
CHAIN_BLOCK = 65_536


def chain_draws(spark: SparkSession, chains: dict[str, tuple[int, int, Sequence[str], Sequence[float]]]) -> DataFrame:
    """(chain, pos, choice): for each chain (start seed, length, names, weights) one name a step, drawn by the seed of that step.

    A chain has to be walked, so the driver keeps the state at the start of each block; workers walk the blocks and draw.
    """
    rows = [(name, k, state, min(CHAIN_BLOCK, length - k * CHAIN_BLOCK)) for name, (seed, length, *_) in chains.items() for k, state in enumerate(block_starts(seed, length, CHAIN_BLOCK))]
    blocks = spark.createDataFrame([(name, k, str(state), n) for name, k, state, n in rows], "chain string, block long, state string, n int").repartition(max(1, len(rows)))
    options = {name: (list(names), list(weights)) for name, (_, _, names, weights) in chains.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, state, n in zip(*(c.to_pylist() for c in batch.columns)):
                picks = [random.Random(s).choices(*options[name])[0] for s in chain(int(state), n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(block * CHAIN_BLOCK, block * CHAIN_BLOCK + n), pa.int64()), pa.array(picks, pa.string())], ["chain", "pos", "choice"])

    return blocks.mapInArrow(run, "chain string, pos long, choice string")


def draw_subtokenizers(documents: DataFrame, choices: dict[str, tuple[list[str], list[float]]], seed: int, rank: int = 0) -> DataFrame:
    """``documents`` (lang, pos, ...) with ``subtok``, drawn for each document from its language's chain, which advances once a document."""
    spark = documents.sparkSession
    sizes = {r.lang: r.n for r in documents.groupBy("lang").agg((F.max("pos") + 1).alias("n")).collect()}
    draws = chain_draws(spark, {x: (create_seed(seed, "subtokenizer", rank, x), sizes.get(x, 0), *c) for x, c in choices.items()})
    return documents.join(draws.select(F.col("chain").alias("lang"), "pos", F.col("choice").alias("subtok")), ["lang", "pos"])


def hashed_choice(key: Column, names: Sequence[str]) -> Column:
    """One of ``names`` by the hash of ``key``: a draw without a chain, for corpora of any size."""
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(key), F.lit(len(names))) + 1).cast("int"))


def language_schedule(spark: SparkSession, weights: dict[str, float], steps: int, seed: int, rank: int = 0) -> DataFrame:
    """(step, lang, nth): the language of each batch, drawn from the rank's chain, and the how manieth of its language it is."""
    langs = sorted(weights)
    draws = chain_draws(spark, {"language": (create_seed(seed, "language", rank), steps, langs, [weights[x] for x in langs])})
    drawn = draws.select(F.col("pos").alias("step"), F.col("choice").alias("lang")).withColumn("block", block_of("step"))
    return rank_from_zero(drawn, ["lang"], ["block"], ["step"], "nth").drop("block")
