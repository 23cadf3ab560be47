"""The table of pretraining runs and the documents each run reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import clean_source

#: Most runs and sources of a run; configuration, not data (checked).
MAX_RUNS, MAX_SOURCES = 1_000, 10_000


@dataclass(frozen=True)
class Run:
    """One row of the configuration; ``shares`` are the normalized weights of its sources."""

    run_id: int
    shares: dict[str, float]
    max_repeats: int
    token_budget: int
    context_size: int
    seed: int
    min_doc_chars: int | None
    max_doc_chars: int | None


def read_runs(runs: DataFrame) -> list[Run]:
    """Runs in order of run_id.

    A null weights map, or a source without a weight in it, counts 1.0; negative weights count 0; if all are 0 no source has a share.
    A null max_repeats is 1, a null budget 0. Rows without run_id or sources are left out.
    """
    rows = runs.where("run_id is not null and sources is not null").limit(MAX_RUNS + 1).collect()
    if len(rows) > MAX_RUNS or any(len(r.sources) > MAX_SOURCES for r in rows):
        raise ValueError("too many runs or sources for a configuration table")
    out = []
    for r in sorted(rows, key=lambda r: r.run_id):
        given = r.weights
        weights = {s: 1.0 if given is None or given.get(s) is None else max(0.0, given[s]) for s in r.sources}
        total = sum(weights.values())
        shares = {s: w / total if total else 0.0 for s, w in sorted(weights.items())}
        out.append(Run(r.run_id, shares, 1 if r.max_repeats is None else r.max_repeats, r.token_budget or 0, r.context_size or 0, r.seed or 0, r.min_doc_chars, r.max_doc_chars))
    return out


def sized_documents(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, source, n_code_points, n_tokens): what the runs need to know of a document."""
    facts = docs.where("doc_id is not null").select("doc_id", clean_source("source").alias("source"), F.coalesce(F.length("text"), F.lit(0)).alias("n_code_points"))
    return facts.join(counts, "doc_id")


def documents_of_runs(sized: DataFrame, runs: list[Run]) -> DataFrame:
    """The documents that each run reads: those of its sources within its length bounds, with at least one token."""
    table = sized.sparkSession.createDataFrame(
        [(r.run_id, s, r.min_doc_chars, r.max_doc_chars) for r in runs for s in r.shares], "run_id int, source string, min_doc_chars int, max_doc_chars int"
    )
    fits = F.expr("n_tokens > 0 and n_code_points >= coalesce(min_doc_chars, 0) and n_code_points <= coalesce(max_doc_chars, 2147483647)")
    return sized.join(F.broadcast(table), "source").where(fits).select("run_id", "source", "doc_id", "n_tokens")
