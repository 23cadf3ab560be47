"""Small facts beside evaluation runs: latency batches, padding, sizes, kept checkpoints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.order import block_of, running_sum


def latency_batches(tokens: DataFrame, batch_size: int, context_size: int) -> DataFrame:
    """(doc_id, tokens) -> (batch, row, tokens): the stream of all tokens in rows of ``context_size``, only whole batches.

    A stream shorter than one batch is filled up with zeros; without documents there are no rows.
    """
    sizes = tokens.select("doc_id", F.size("tokens").alias("n")).withColumn("block", block_of("doc_id"))
    before = running_sum(sizes, [], ["block"], ["doc_id"], F.col("n"), "upto").select("doc_id", (F.col("upto") - F.col("n")).alias("before"), "n")
    whole, total = batch_size * context_size, sizes.agg(F.sum("n").alias("n")).first().n or 0
    batches = max(total // whole, 1) if sizes.limit(1).count() else 0
    # Each document is cut where lines end, so whole pieces are shuffled and not single tokens.
    kept = before.where((F.col("before") < batches * whole) & (F.col("n") > 0)).join(tokens, "doc_id")
    pieces = kept.withColumn("line", F.explode(F.expr(f"sequence(before div {context_size}, (before + n - 1) div {context_size})"))).where(F.col("line") < batches * batch_size)
    first = F.greatest(F.col("line") * context_size, "before")
    pieces = pieces.select("line", first.alias("first"), F.slice("tokens", (first - F.col("before") + 1).cast("int"), (F.least((F.col("line") + 1) * context_size, F.col("before") + F.col("n")) - first).cast("int")).alias("piece"))
    rows = pieces.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("first", "piece"))).alias("t"))
    lines = tokens.sparkSession.range(batches * batch_size).withColumnRenamed("id", "line")
    filled = lines.join(rows, "line", "left").withColumn("t", F.coalesce(F.flatten(F.transform("t", lambda x: x["piece"])), F.array().cast("array<int>")))
    padded = F.slice(F.concat("t", F.array_repeat(F.lit(0), context_size)), 1, context_size)
    return filled.select(F.floor(F.col("line") / batch_size).alias("batch"), (F.col("line") % batch_size).alias("row"), padded.alias("tokens"))


def padded_length(tokens: Column | str, multiple: int) -> Column:
    """Aggregate: the longest array, rounded up to a multiple."""
    return (F.ceil(F.max(F.size(tokens)) / multiple) * multiple).cast("int")


def mean_times(runs: DataFrame, *by: str) -> DataFrame:
    """(by..., n, seconds): mean over repeats."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("seconds").alias("seconds"))


def short_number(n: Column | str) -> Column:
    """A count with two decimals and K, M or B from a thousand on."""
    n = F.col(n) if isinstance(n, str) else n
    out = n.cast("string")
    for scale, name in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(n >= scale, F.format_string(f"%.2f{name}", (n / scale).cast("double"))).otherwise(out)
    return out


def kept_steps(steps: Iterable[int], keep_last: int, period: int | None = None, rewind_to: int | None = None) -> list[int]:
    """Checkpoints that stay: the last ones and every multiple of ``period``; those after ``rewind_to`` go first."""
    known = sorted(s for s in set(steps) if rewind_to is None or s <= rewind_to)
    last = set(known[-keep_last:]) if keep_last > 0 else set()
    return [s for s in known if s in last or period and s % period == 0]


def listed_steps(names: Iterable[str]) -> list[int]:
    """Steps among the names in a folder of checkpoints, in order; other names are passed over."""
    return sorted(int(n) for n in names if n.isdigit())


def step_range(log: DataFrame, step: str = "step") -> DataFrame:
    """(latest, first, n): the ends and the number of the different steps of a log, nulls aside; one row, also of an empty log.

    The counterpart of :func:`listed_steps` for logs of any length: nothing is written, and only pre-aggregated steps are shuffled.
    """
    return log.agg(F.max(step).alias("latest"), F.min(step).alias("first"), F.count_distinct(step).alias("n"))


def log_time(at: Column) -> Column:
    """A time as log lines show it."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")
