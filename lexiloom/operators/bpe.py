"""Byte-pair encoding: training from scratch, continued and sequential training, encoding, token counts, NSL.

The words and the table of their pairs are kept as DataFrames. A round brings the most frequent pairs to the driver (``FETCH`` rows), takes as
many of them as can't influence each other, and updates the pair table by the difference that the changed words make; so
a few rounds give many merges, and unchanged words are never counted again. The merges are those of one merge at a time. The pair table is
written each round and the words every ``CUT_EVERY`` rounds. Vocabularies and merge tables are bounded by the size asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.bpe import BpeCoder
from lexiloom.functions.text import byte_alphabet, py_to_bytes_alphabet
from lexiloom.operators.words import CLOSE, OPEN, byte_words, merge_pairs, pair_frequencies, unigram_candidates, word_frequencies
from lexiloom.tables import cut

#: Special tokens come first, in this order.
SPECIALS = ("<s>", "</s>", "<pad>", "<unk>")
#: Rounds between two cuts of the words, rows of the pair table that are looked at in a round, merges taken of them at most.
CUT_EVERY, FETCH, BATCH = 4, 512, 64

Merge = tuple[str, str]
#: What continued training finds: a pair, or a symbol that is a word of its own.
Unit = tuple[str, ...]


def base_vocabulary() -> dict[str, int]:
    """Special tokens and the byte alphabet in code-point order."""
    return {t: k for k, t in enumerate([*SPECIALS, *sorted(byte_alphabet())])}


@dataclass
class BpeModel:
    """A vocabulary token -> id and its merges in order."""

    vocab: dict[str, int] = field(default_factory=base_vocabulary)
    merges: list[Merge] = field(default_factory=list)

    def add(self, left: str, right: str) -> None:
        """Append a merge; a token that exists keeps its id."""
        self.merges.append((left, right))
        self.vocab.setdefault(left + right, len(self.vocab))


def independent(ranked: Sequence[tuple[str, str, int]], whole: bool, exists: Callable[[str], bool], most: int, key: Callable[[str, str], tuple]) -> list[tuple[str, str, int]]:
    """The first of the ranked (left, right, freq) that merging one at a time would take in this order, too; equal counts are in order of ``key``.

    A pair that opens with what an earlier one ends with, or ends with what that opens with, changes its count. A new pair is at most as
    frequent as such a neighbour, so it can only come in between where one has the same count, at the place that its own key gives it. After a
    pair of equal symbols, or one whose token ``exists``, that doesn't hold, so it is the last. Without ``whole`` further pairs may have the
    last count. An empty right is a symbol of its own.
    """
    taken: list[tuple[str, str, int]] = []
    opens: dict[str, list[str]] = {}
    ends: dict[str, list[str]] = {}
    made: set[str] = set()

    def new_keys(left: str, right: str) -> Iterator[tuple]:
        """Keys of the pairs that merges so far make of the occurrences of a pair."""
        for a in ends.get(left, ()):
            yield key(a, right)
            yield from (key(a, b) for b in opens.get(right, ()))
        yield from (key(left, b) for b in opens.get(right, ()))

    for freq, group in groupby(ranked, key=lambda r: r[2]):
        ties = list(group)
        if not whole and freq == ranked[-1][2]:
            return taken or ties[:1]
        pairs = [(a, b) for a, b, _ in ties if b]
        bound = min((k for a, b in pairs for k in new_keys(a, b)), default=None)
        for left, right, _ in ties:
            if len(taken) >= most or bound is not None and not key(left, right) < bound or right and (left in ends or right in opens):
                return taken
            taken.append((left, right, freq))
            if right:
                token = left + right
                if left == right or token in made or exists(token):
                    return taken
                made.add(token)
                opens.setdefault(left, []).append(token)
                ends.setdefault(right, []).append(token)
                touched = (k for a, b in pairs if a == right or b == left for k in new_keys(a, b))
                bound = min((k for k in (bound, *touched) if k is not None), default=None)
    return taken


class PairTable:
    """Words (split, freq) and their pairs (left, right, freq), kept together while merges are applied."""

    def __init__(self, words: DataFrame):
        self.words = cut(words.select("split", "freq"))
        self.pairs = cut(pair_frequencies(self.words))
        self.rounds = 0

    def top(self, singles: DataFrame | None = None, longest: int | None = None) -> tuple[list[tuple[str, str, int]], bool]:
        """(pairs of greatest count, unordered among equal ones; whether these are all). Equal counts are given whole, if there are others."""
        found = self.pairs if longest is None else self.pairs.where(F.length("left") + F.length("right") <= longest)
        found = found if singles is None else found.unionByName(singles)
        rows = [(r.left, r.right, r.freq) for r in found.orderBy(F.desc("freq"), "left", "right").limit(FETCH).collect()]
        return rows, len(rows) < FETCH

    def merge(self, merges: Sequence[Merge]) -> None:
        """Apply merges that are independent of each other."""
        if not merges:
            return
        # Only words that hold a merged pair are rewritten for the difference.
        held = reduce(or_, (F.col("split").contains(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}") for a, b in merges))
        changed = self.words.where(held)
        moved = merge_pairs(changed, merges).unionByName(changed.select("split", (-F.col("freq")).alias("freq")))
        self.pairs = cut(self.pairs.unionByName(pair_frequencies(moved)).groupBy("left", "right").agg(F.sum("freq").alias("freq")).where("freq > 0"))
        self.words, self.rounds = merge_pairs(self.words, merges), self.rounds + 1
        if self.rounds % CUT_EVERY == 0:
            self.words = cut(self.words)


def _ordered(rows: list[tuple[str, str, int]], whole: bool, key: Callable[[tuple[str, str, int]], tuple]) -> list[tuple[str, str, int]]:
    """Rows by falling count and then by ``key``; the last count is left out where it isn't whole, unless it is the only one."""
    if not whole and rows[0][2] != rows[-1][2]:
        rows = [r for r in rows if r[2] != rows[-1][2]]
    return sorted(rows, key=lambda r: (-r[2], key(r)))


def train(docs: DataFrame, vocab_size: int) -> BpeModel:
    """BPE from scratch until the vocabulary has ``vocab_size`` tokens or no pair is left.

    The most frequent pair is merged; of equal ones that with the smallest ids. Empty corpora give the byte alphabet.
    """
    spark, model = docs.sparkSession, BpeModel()
    table = PairTable(byte_words(word_frequencies(docs)))
    while len(model.vocab) < vocab_size:
        rows, whole = table.top()
        if not rows:
            break
        known = whole or rows[0][2] != rows[-1][2]
        if not known:
            # More pairs share the greatest count than were fetched: their ids decide among all of them.
            ids = spark.createDataFrame(list(model.vocab.items()), "token string, id int")
            ranked = table.pairs.where(F.col("freq") == rows[0][2]).join(ids.select(F.col("token").alias("left"), F.col("id").alias("a")), "left").join(ids.select(F.col("token").alias("right"), F.col("id").alias("b")), "right")
            rows = [(r.left, r.right, r.freq) for r in ranked.orderBy("a", "b").limit(1).collect()]
        else:
            rows = _ordered(rows, whole, lambda r: (model.vocab[r[0]], model.vocab[r[1]]))
        taken = independent(rows, known, lambda t: t in model.vocab, min(BATCH, vocab_size - len(model.vocab)), lambda a, b: (model.vocab.get(a, math.inf), model.vocab.get(b, math.inf)))
        for left, right, _ in taken:
            model.add(left, right)
        table.merge([x[:2] for x in taken])
    return model


def continue_training(docs: DataFrame, base: BpeModel, extension_size: int, max_token_length: int | None = None) -> list[Unit]:
    """Pairs and single symbols found, in order, when training goes on over the segmentation of ``base``.

    Candidates are neighbouring pairs and words that are one symbol at the start; the most frequent one is taken, of equal
    ones the first in code-point order (a single symbol before the pairs it opens). It ends at ``extension_size`` different tokens,
    re-discovered ones included. Merges longer than ``max_token_length`` are dropped for good.
    """
    table = PairTable(encode_words(word_frequencies(docs), base.merges).select(F.concat(F.lit("\x01"), F.array_join("pieces", "\x02\x01"), F.lit("\x02")).alias("split"), "freq"))
    singles = cut(unigram_candidates(table.words).select(F.col("symbol").alias("left"), F.lit("").alias("right"), "freq"))
    tokens: dict[str, None] = {}
    units: list[Unit] = []
    met = set(base.vocab)
    gone: list[str] = []
    while len(tokens) < extension_size:
        left_over = singles.where(~F.col("left").isin(gone)) if gone else singles
        rows, whole = table.top(left_over, max_token_length)
        if not rows:
            break
        only = not whole and rows[0][2] == rows[-1][2]
        rows = rows[:1] if only else _ordered(rows, whole, lambda r: r[:2])
        taken = []
        for left, right, freq in independent(rows, True, lambda t: t in met, BATCH, lambda a, b: (a, b)):
            tokens.setdefault(left + right)
            units.append((left, right) if right else (left,))
            met.add(left + right)
            if right:
                taken.append((left, right))
            else:
                gone.append(left)
            if len(tokens) >= extension_size:
                return units
        table.merge(taken)
    return units


def closure(token: str, rules: dict[str, Merge]) -> list[str]:
    """``token`` after all tokens it is built of, each once."""
    out: dict[str, None] = {}
    stack: list[tuple[str, bool]] = [(token, False)]
    while stack:
        t, built = stack.pop()
        if built or t not in rules:
            out.setdefault(t)
        elif t not in out:
            stack += [(t, True), (rules[t][1], False), (rules[t][0], False)]
    return list(out)


def extract(units: Sequence[Unit], base: BpeModel, size: int) -> tuple[BpeModel, BpeModel]:
    """(subtokenizer of at most ``size`` tokens, extended global model) of one language after continued training.

    The subtokenizer starts with the base tokens that no merge builds and takes the units in order, each with what it is built of, until it
    has ``size`` tokens; base tokens come first by id, new ones in the order found, and it is cut to ``size`` and numbered from 0. The
    global model takes the new tokens of the subtokenizer with their merges, and no others. A new rule for a known token
    counts from then on. Raises ValueError if a token can't be built.
    """
    rules = {a + b: (a, b) for a, b in base.merges}
    for unit in units:
        if missing := [t for t in unit if t not in rules and t not in base.vocab]:
            raise ValueError(f"no way to build {missing[0]!r}")
        if len(unit) == 2:
            rules["".join(unit)] = unit
    place = {t: i for t, i in base.vocab.items() if t not in rules}
    found = len(base.vocab)
    for unit in units:
        token = "".join(unit)
        for t in closure(token, rules):
            place.setdefault(t, base.vocab.get(t, found))
        found += len(unit) == 2
        if len(place) >= size:
            break
    kept = sorted(place, key=place.__getitem__)[:size]
    inside = set(kept)
    merges = [rules[t] for t in kept if t in rules]
    if broken := [m for m in merges if not inside.issuperset(m)]:
        raise ValueError(f"no way to build {broken[0]!r} within {size} tokens")
    extended = BpeModel(dict(base.vocab), list(base.merges))
    for t in kept:
        if t not in base.vocab:
            extended.add(*rules[t])
    return BpeModel({t: k for k, t in enumerate(kept)}, merges), extended


@dataclass
class Step:
    """What one language adds: the model after it, its subtokenizer and what continued training found."""

    lang: str
    model: BpeModel
    extracted: BpeModel
    units: list[Unit]


def train_sequential(
    docs_by_lang: Sequence[tuple[str, DataFrame]], vocab_size: int, extension_size: int | None = None, max_token_length: int | None = None, max_sentences: int | None = None, order: Sequence[str] = ("file_id", "line_id")
) -> list[Step]:
    """One step for each language: the first is trained from scratch, each further one on top of the model so far.

    ``extension_size`` is ``vocab_size`` if not given. ``max_sentences`` keeps the first documents by ``order`` of each language but
    the first, as does ``max_token_length``.
    """
    (first, docs), *rest = docs_by_lang
    model = train(docs, vocab_size)
    steps = [Step(first, model, model, [])]
    for lang, docs in rest:
        part = docs if max_sentences is None else docs.orderBy(*order).limit(max_sentences)
        units = continue_training(part, model, extension_size or vocab_size, max_token_length)
        extracted, model = extract(units, model, vocab_size)
        steps.append(Step(lang, model, extracted, units))
    return steps


def encode_words(words: DataFrame, merges: Sequence[Merge]) -> DataFrame:
    """``words`` (word, ...) with ``pieces``, the symbols of each word; every distinct word is encoded once, in Arrow batches."""
    shared = words.sparkSession.sparkContext.broadcast([(k, a, b) for k, (a, b) in enumerate(merges)])
    names = words.columns
    at = names.index("word")

    def run(batches):
        coder = BpeCoder(shared.value)
        for batch in batches:
            pieces = [coder.split(py_to_bytes_alphabet(w)) for w in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.list_(pa.string()))], [*names, "pieces"])

    schema = T.StructType([*words.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))])
    return words.mapInArrow(run, schema)


def read_model(spark: SparkSession, vocab: DataFrame, merges: DataFrame, most: int = 5_000_000) -> BpeModel:
    """A model from its tables (token_id, piece) and (merge_no, a, b); tokenizer-sized, checked."""
    rows, rules = vocab.select("token_id", "piece").limit(most + 1).collect(), merges.select("merge_no", "a", "b").limit(most + 1).collect()
    if max(len(rows), len(rules)) > most:
        raise ValueError("too large for a tokenizer")
    return BpeModel({r.piece: r.token_id for r in rows}, [(r.a, r.b) for r in sorted(rules, key=lambda r: r.merge_no)])


def token_counts(words: DataFrame, merges: Sequence[Merge], vocab: DataFrame, *by: str) -> DataFrame:
    """(by..., token_id, piece, n) over the whole vocabulary, zeros included; ``words`` is (by..., word, freq)."""
    counts = encode_words(words, merges).select(*by, "freq", F.explode("pieces").alias("piece")).groupBy(*by, "piece").agg(F.sum("freq").alias("n"))
    if not by:
        return vocab.join(counts, "piece", "left").select("token_id", "piece", F.coalesce("n", F.lit(0)).alias("n"))
    tokens = pa.table({"token_id": pa.array([], pa.int32()), "piece": pa.array([], pa.string())}) if vocab.isEmpty() else vocab.select(F.col("token_id").cast("int"), "piece").toArrow()  # tokenizer-sized
    shared = words.sparkSession.sparkContext.broadcast(tokens)

    def listed(batches):
        table = shared.value.combine_chunks()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).take(pa.array([0] * table.num_rows, pa.int64()))
                yield from pa.table([*row.columns, *table.columns], names=[*batch.schema.names, "token_id", "piece"]).to_batches()

    groups = words.select(*by).distinct()
    fields = [*groups.schema.fields, T.StructField("token_id", T.IntegerType()), T.StructField("piece", T.StringType())]
    groups = groups.mapInArrow(listed, T.StructType(fields))
    return null_safe_join(groups, counts, [*by, "piece"], "left").select(*by, "token_id", "piece", F.coalesce("n", F.lit(0)).alias("n"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns in which null equals null; the keys are those of ``left``."""
    renamed = right.select(*(F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns))
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys], how).drop(*(f"_right_{k}" for k in keys))


def token_totals(words: DataFrame, merges: Sequence[Merge], *by: str) -> DataFrame:
    """(by..., n_tokens) of ``words`` (by..., word, freq), without begin and end tokens."""
    return encode_words(words, merges).groupBy(*by).agg(F.sum(F.col("freq") * F.size("pieces")).alias("n_tokens"))


def nsl(words: DataFrame, merges: Sequence[Merge], reference: Sequence[Merge], *by: str) -> DataFrame:
    """(by..., n_tokens, n_tokens_ref, nsl): tokens over those of a reference tokenizer, for each group."""
    ours, theirs = token_totals(words, merges, *by), token_totals(words, reference, *by).withColumnRenamed("n_tokens", "n_tokens_ref")
    joined = null_safe_join(ours, theirs, by)
    return joined.select(*by, "n_tokens", "n_tokens_ref", (F.col("n_tokens") / F.col("n_tokens_ref")).alias("nsl"))
