"""Words, their byte symbols and neighbouring pairs: the statistics that byte-pair training works on.

A word is kept as one string in which every symbol stands between two marks, so merging a pair is one built-in ``replace``.
The unit of work is the distinct word with its frequency; documents are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import pretokens, to_bytes_alphabet

#: Marks before and after a symbol; neither is in the byte alphabet.
OPEN, CLOSE = "\x01", "\x02"


def word_frequencies(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., word, freq): pre-tokens of all texts; null texts have none."""
    return docs.select(*by, F.explode(pretokens("text")).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("freq"))


def byte_words(words: DataFrame) -> DataFrame:
    """``words`` with ``split``, the marked byte symbols of the word."""
    return words.withColumn("split", F.regexp_replace(to_bytes_alphabet("word"), "(?s)(.)", f"{OPEN}$1{CLOSE}"))


def marked(left: Column | str, right: Column | str | None = None) -> Column:
    """The marked form of one symbol or of two neighbours."""
    one = lambda c: F.concat(F.lit(OPEN), F.col(c) if isinstance(c, str) else c, F.lit(CLOSE))
    return one(left) if right is None else F.concat(one(left), one(right))


def symbols(split: Column | str = "split") -> Column:
    """The symbols of a marked word as an array."""
    split = F.col(split) if isinstance(split, str) else split
    return F.split(F.substring(split, F.lit(2), F.length(split) - 2), f"{CLOSE}{OPEN}")


def symbol_frequencies(words: DataFrame, *by: str) -> DataFrame:
    """(by..., symbol, freq) weighted by word frequency."""
    return words.select(*by, "freq", F.explode(symbols()).alias("symbol")).groupBy(*by, "symbol").agg(F.sum("freq").alias("freq"))


def pair_frequencies(words: DataFrame, *by: str) -> DataFrame:
    """(by..., left, right, freq): neighbours inside words, weighted by word frequency; overlapping pairs all count."""
    parts = words.select(*by, "freq", symbols().alias("s"))
    pairs = parts.select(*by, "freq", F.explode(F.expr("arrays_zip(slice(s, 1, size(s) - 1), slice(s, 2, size(s)))")).alias("p"))
    return pairs.select(*by, "freq", F.col("p.0").alias("left"), F.col("p.1").alias("right")).groupBy(*by, "left", "right").agg(F.sum("freq").alias("freq"))


def unigram_candidates(words: DataFrame, *by: str) -> DataFrame:
    """(by..., symbol, freq): words that are one symbol."""
    return words.where(F.size(symbols()) == 1).select(*by, F.expr("substring(split, 2, length(split) - 2)").alias("symbol"), "freq").groupBy(*by, "symbol").agg(F.sum("freq").alias("freq"))


def top_pairs(pairs: DataFrame, *by: str) -> DataFrame:
    """The most frequent pair of each group; of equal ones the first in code-point order."""
    if not by:
        return pairs.orderBy(F.desc("freq"), "left", "right").limit(1)
    most = pairs.groupBy(*by).agg(F.max("freq").alias("freq"))
    keys = [pairs[c].eqNullSafe(most[c]) for c in by] + [pairs["freq"] == most["freq"]]
    tied = pairs.join(most, keys, "left_semi")
    return tied.groupBy(*by).agg(F.min(F.struct("left", "right", "freq")).alias("m")).select(*by, "m.left", "m.right", "m.freq")


def merge_pair(words: DataFrame, left: str, right: str) -> DataFrame:
    """``words`` after one merge, leftmost first and without overlap."""
    pair, one = f"{OPEN}{left}{CLOSE}{OPEN}{right}{CLOSE}", f"{OPEN}{left}{right}{CLOSE}"
    return words.withColumn("split", F.replace("split", F.lit(pair), F.lit(one)))


def merge_pairs(words: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """``words`` after several merges, one after the other; a fold over a constant list, so the plan doesn't grow with their number."""
    if not merges:
        return words
    pairs = F.array(*(F.struct(F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}").alias("pair"), F.lit(f"{OPEN}{a}{b}{CLOSE}").alias("one")) for a, b in merges))
    return words.withColumn("split", F.aggregate(pairs, F.col("split"), lambda s, m: F.replace(s, m["pair"], m["one"])))
