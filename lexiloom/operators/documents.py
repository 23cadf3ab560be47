"""Documents: lines, filters, shards, statistics and weighted interleaving."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import pretokens
from lexiloom.operators.order import block_of, rank_from_zero, running_sum


def nonblank_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines that hold more than blanks, counted from 1 with blank ones included. Null texts have none."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length(F.regexp_replace("line", r"[\t-\r\x{85}\p{Z}]+", "")) > 0).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(source, line_no, line) -> (source, paragraph, text): lines up to the next blank one, which joins the paragraph before it.

    A source is never sorted in one task: it goes in blocks of line numbers, and a block knows how the one before it ends.
    """
    blank = F.trim("line") == ""
    cut_up = lines.withColumn("block", block_of("line_no")).withColumn("blank", blank)
    ends = cut_up.groupBy("source", "block").agg(F.max_by("blank", "line_no").alias("last"))
    before = F.lag("last").over(Window.partitionBy("source").orderBy("block"))
    ends = ends.select(F.col("source").alias("_source"), F.col("block").alias("_block"), before.alias("before"))
    joined = cut_up.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    previous = F.lag("blank").over(Window.partitionBy("source", "block").orderBy("line_no"))
    starts = F.when(~F.col("blank") & F.coalesce(previous, "before", F.lit(True)), 1).otherwise(0)
    numbered = running_sum(joined.select("source", "block", "line_no", "line", starts.alias("start")), ["source"], ["block"], ["line_no"], F.col("start"), "paragraph")
    pieces = numbered.where("paragraph > 0").groupBy("source", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return pieces.select("source", "paragraph", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def length_filter(docs: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Documents whose text has between ``least`` and ``most`` characters; a bound of None doesn't hold. Null texts are left out."""
    size = F.length("text")
    out = docs.where(size.isNotNull())
    out = out if least is None else out.where(size >= least)
    return out if most is None else out.where(size <= most)


def shards(docs: DataFrame, world_size: int) -> DataFrame:
    """(source, file_id, line_id, rank): the rank that reads each line."""
    return docs.select("source", "file_id", "line_id", F.pmod("line_id", F.lit(world_size)).cast("int").alias("rank"))


def stream_positions(docs: DataFrame, rank: int, world_size: int, wraps: int) -> DataFrame:
    """(source, pos, wrap, file_id, line_id, doc_id): the order in which a rank reads a source over and over, ``wraps`` times.

    A source without a document for the rank would never end in an endless reader; here it has no rows.
    """
    mine = docs.where(F.pmod("line_id", F.lit(world_size)) == rank)
    return _cycled(mine, [], wraps).select("source", "pos", "wrap", "file_id", "line_id", "doc_id")


def all_positions(docs: DataFrame, world_size: int, wraps: int) -> DataFrame:
    """(rank, source, pos, wrap, file_id, line_id, doc_id): :func:`stream_positions` of all ranks."""
    return _cycled(docs.withColumn("rank", F.pmod("line_id", F.lit(world_size)).cast("int")), ["rank"], wraps).select("rank", "source", "pos", "wrap", "file_id", "line_id", "doc_id")


def _cycled(docs: DataFrame, by: list[str], wraps: int) -> DataFrame:
    """``docs`` read ``wraps`` times in the order of their addresses, with their place ``pos``; a file is ordered in blocks of lines."""
    cycled = docs.withColumn("wrap", F.explode(F.sequence(F.lit(0), F.lit(wraps - 1)))).withColumn("block", block_of("line_id"))
    return rank_from_zero(cycled, [*by, "source"], ["wrap", "file_id", "block"], ["line_id", "doc_id"], "pos")


def seek(positions: DataFrame, wrap: int, file_id: int, line_id: int) -> DataFrame:
    """What a reader still reads that stands at an address: ``positions`` from there on, the address itself included."""
    at = F.struct("wrap", "file_id", "line_id")
    return positions.where(at >= F.struct(F.lit(wrap), F.lit(file_id).cast("int").alias("file_id"), F.lit(line_id).cast("long").alias("line_id")))


def heads(positions: DataFrame, *by: str) -> DataFrame:
    """(by..., wrap, file_id, line_id): the address that each reader reads next."""
    first = positions.groupBy(*by).agg(F.min(F.struct("wrap", "file_id", "line_id")).alias("h"))
    return first.select(*by, "h.wrap", "h.file_id", "h.line_id")


def statistics(docs: DataFrame, by: str = "lang") -> DataFrame:
    """Documents, characters, bytes and pre-tokens by ``by``; null is a group of its own."""
    return docs.groupBy(by).agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(F.size(pretokens(F.coalesce("text", F.lit(""))))), F.lit(0)).cast("long").alias("n_words"),
    )


def sentence_weights(docs: DataFrame) -> DataFrame:
    """(line, weight): distinct non-blank lines with the number of times they occur."""
    return nonblank_lines(docs).groupBy("line").agg(F.count("*").alias("weight"))


def pick_sequence(sizes: Sequence[int], weights: Sequence[float] | None, seed: int) -> list[int]:
    """Sources in the order an interleaving reads them: drawn by weight, a source drops out when it is read.

    One number for each document, so this is for corpora whose order has to be reproduced draw by draw.
    """
    rng, left = random.Random(seed), list(sizes)
    live = [k for k, n in enumerate(sizes) if n]
    share = list(weights) if weights is not None else [1.0] * len(sizes)
    out = []
    while live:
        k = rng.choices(live, [share[i] for i in live])[0]
        out.append(k)
        left[k] -= 1
        if not left[k]:
            live.remove(k)
    return out


def interleave_exactly(docs: DataFrame, sources: Sequence[str], weights: Sequence[float] | None = None, seed: int = 1234) -> DataFrame:
    """``docs`` of ``sources`` with ``pos`` from :func:`pick_sequence`, which the driver draws one number a document for."""
    sizes = {r.source: r["count"] for r in docs.where(F.col("source").isin(list(sources))).groupBy("source").count().collect()}
    picks = pick_sequence([sizes.get(s, 0) for s in sources], weights, seed)
    rows, seen = [], [0] * len(sources)
    for pos, k in enumerate(picks):
        rows.append((sources[k], seen[k], pos))
        seen[k] += 1
    place = docs.sparkSession.createDataFrame(rows, "source string, nth long, pos int")
    return _numbered(docs).join(place, ["source", "nth"]).drop("nth")


def _numbered(docs: DataFrame) -> DataFrame:
    return rank_from_zero(docs.withColumn("block", block_of("line_id")), ["source"], ["file_id", "block"], ["line_id", "doc_id"], "nth").drop("block")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` alone: 52 bits of their MD5 digest."""
    digest = F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2**52


def interleave(docs: DataFrame, weights: dict[str, float], seed: int = 1234) -> DataFrame:
    """``docs`` (source, file_id, line_id, doc_id, ...) of the weighted sources with ``pos``, the place of each in the interleaving.

    Each source sends its documents in order after waits that are exponential at the rate of its weight; whoever comes first is next. By the
    memoryless property that draws, at each place, a source by weight among those that have documents left, and one that is
    exhausted drops out. A wait is a hash of (seed, source, number), so nothing is drawn on the driver. Raises ValueError for weights that aren't above 0.
    """
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights have to be above 0")
    table = docs.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
    numbered = _numbered(docs.join(F.broadcast(table), "source")).withColumn("block", block_of("nth"))
    wait = -F.log(uniform(F.lit(seed), F.col("source"), F.col("nth"))) / F.col("weight")
    timed = running_sum(numbered.withColumn("wait", wait), ["source"], ["block"], ["nth"], F.col("wait"), "at")
    timed = timed.withColumn("block", block_of(F.col("at") * sum(weights.values())))
    return rank_from_zero(timed, [], ["block"], ["at", "source"], "pos").drop("weight", "wait", "at", "nth", "block")


def select_texts(texts: DataFrame, wanted: int, seed: int = 1234) -> DataFrame:
    """The first ``wanted`` rows of a uniform interleaving of all sources of ``texts``, which hold only what may be selected, with ``pos``."""
    sources = [r.source for r in texts.where("source is not null").select("source").distinct().collect()]
    return interleave(texts, dict.fromkeys(sources, 1.0), seed).where(F.col("pos") < wanted)
