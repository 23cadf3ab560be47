"""Unigram tokenizers: match lattice, expectation-maximization over a fixed vocabulary, best segmentation, training."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.operators.vocab import is_special
from lexiloom.tables import cut

#: Fixed value: stands for a blank.
META = "▁"
#: A digit, a word with or without its blank mark, or a blank mark before a digit.
WORDS = rf"\p{{N}}|{META}?[^{META}\p{{N}}]+|{META}"


def normalize(text: Column | str) -> Column:
    """A text as the model reads it: a blank mark in front and in place of each blank."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(META), F.replace(text, F.lit(" "), F.lit(META)))


def pretokens(text: Column | str) -> Column:
    """Words that begin with the blank mark, every digit on its own."""
    return F.regexp_extract_all(normalize(text), F.lit(WORDS), F.lit(0))


def usable_sentences(texts: DataFrame, longest: int) -> DataFrame:
    """Non-empty texts of at most ``longest`` characters, tested before normalization; ``sentence`` is the normalized form."""
    return texts.where((F.length("text") > 0) & (F.length("text") <= longest)).withColumn("sentence", normalize("text"))


#: Pieces that are broadcast to find their places, at most; more are joined by a shuffle.
BROADCAST_PIECES = 1_000_000


def lattice(sentences: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sent_id, i, j, piece): every piece that equals sentence[i:j].

    Up to ``BROADCAST_PIECES`` pieces, a checked number, are held by the workers; more of them are joined with all substrings of the
    lengths that pieces have.
    """
    sizes = pieces.agg(F.collect_set(F.length("piece")).alias("lengths"), F.count("*").alias("n")).first()
    if sizes.n > BROADCAST_PIECES:
        return _lattice_by_join(sentences, pieces, sorted(x for x in sizes.lengths if x))
    held = sorted({r.piece for r in pieces.where("piece != ''").select("piece").collect()})
    shared = pieces.sparkSession.sparkContext.broadcast(held)
    kind = sentences.schema["sent_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        known = {p: k for k, p in enumerate(shared.value)}
        lengths = _lengths(known)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = [_edges(s or "", known, lengths, False) for s in part.column(1).to_pylist()]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(x[2]) for x in found]))
                i, j, ids = (pa.array([v for x in found for v in x[side]], pa.int32()) for side in range(3))
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), i, j, names.take(ids)], ["sent_id", "i", "j", "piece"])

    schema = T.StructType([T.StructField("sent_id", kind), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("piece", T.StringType())])
    return sentences.select("sent_id", "sentence").mapInArrow(run, schema)


def _lattice_by_join(sentences: DataFrame, pieces: DataFrame, lengths: list[int]) -> DataFrame:
    starts = sentences.where(F.length("sentence") > 0).select("sent_id", "sentence", F.explode(F.expr("sequence(0, length(sentence) - 1)")).alias("i"))
    parts = starts.select("sent_id", "i", F.explode(F.array(*map(F.lit, lengths))).alias("n"), "sentence").where("i + n <= length(sentence)")
    parts = parts.select("sent_id", "i", F.expr("i + n").alias("j"), F.expr("substring(sentence, i + 1, n)").alias("piece"))
    return parts.join(pieces.select("piece").distinct(), "piece").select("sent_id", "i", "j", "piece")


class Lattices:
    """Forward and backward passes over sentences, for one table of log probabilities."""

    def __init__(self, logp: dict[str, float]):
        self.logp = logp
        self.longest = max(map(len, logp), default=0)

    def edges(self, s: str, i: int) -> list[tuple[int, float, str]]:
        """(end, log probability, piece) of the pieces at position ``i``."""
        out = []
        for j in range(i + 1, min(i + self.longest, len(s)) + 1):
            p = self.logp.get(s[i:j])
            if p is not None:
                out.append((j, p, s[i:j]))
        return out

    def expected(self, s: str, weight: float, into: dict[str, float]) -> float | None:
        """Adds expected counts of pieces; log-likelihood, or None where a position that can be reached has no piece."""
        n, none = len(s), -math.inf
        alpha = [none] * (n + 1)
        alpha[0] = 0.0
        found: list[list[tuple[int, float, str]]] = [[] for _ in range(n)]
        for i in range(n):
            if alpha[i] == none:
                continue
            found[i] = self.edges(s, i)
            if not found[i]:
                return None
            for j, p, _ in found[i]:
                alpha[j] = log_add(alpha[j], alpha[i] + p)
        z = alpha[n]
        if z == none:
            return None
        beta = [none] * (n + 1)
        beta[n] = 0.0
        for i in range(n - 1, -1, -1):
            for j, p, piece in found[i]:
                if beta[j] != none:
                    beta[i] = log_add(beta[i], p + beta[j])
                    into[piece] += weight * math.exp(alpha[i] + p + beta[j] - z)
        return z

    def best(self, s: str) -> list[str]:
        """The likeliest segmentation; characters no piece covers stand alone, at a cost below any piece's."""
        n, low = len(s), min(self.logp.values(), default=0.0) - 10.0
        score, back = [-math.inf] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        for i in range(n):
            edges = self.edges(s, i)
            if not any(j == i + 1 for j, *_ in edges):
                edges = [*edges, (i + 1, low, s[i])]
            for j, p, _ in edges:
                if score[i] + p > score[j]:
                    score[j], back[j] = score[i] + p, i
        out, j = [], n
        while j:
            out.append(s[back[j] : j])
            j = back[j]
        return out[::-1]


def log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def e_step(sentences: DataFrame, logp: dict[str, float]) -> DataFrame:
    """(piece, n): expected counts over (sentence, weight); the row with a null piece has the log-likelihood.

    Sentences that can't be covered add nothing. Workers add up before the shuffle.
    """
    shared = sentences.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, into, total = Lattices(shared.value), defaultdict(float), 0.0
        for batch in batches:
            for s, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = net.expected(s, w, into)
                total += 0.0 if z is None else w * z
        yield pa.RecordBatch.from_arrays([pa.array([*into, None], pa.string()), pa.array([*into.values(), total], pa.float64())], ["piece", "n"])

    parts = sentences.select("sentence", F.col("weight").cast("double")).mapInArrow(run, "piece string, n double")
    return parts.groupBy("piece").agg(F.sum("n").alias("n"))


def m_step(counts: dict[str, float], pieces: list[str]) -> dict[str, float]:
    """log((1 + count) / (1 + all counts)) for each piece; one is added to the whole once, so it isn't a distribution."""
    whole = math.log1p(sum(counts.values()))
    return {p: math.log1p(counts.get(p, 0.0)) - whole for p in pieces}


def start_scores(pieces: list[str]) -> dict[str, float]:
    """Equal scores; a piece that several languages list counts for each of them."""
    return dict.fromkeys(pieces, -math.log(len(pieces))) if pieces else {}


#: Sentences whose lattices a worker takes through both passes at once.
BLOCK = 1024
#: Most pieces of a vocabulary that workers hold (checked).
MAX_PIECES = 5_000_000


def match_lattices(sentences: DataFrame, pieces: list[str]) -> DataFrame:
    """(weight, n, starts, ends, ids): every place of every piece in each sentence (sentence, weight) of n characters.

    The vocabulary is fixed while scores are fitted, so pieces are looked up once and not in each round; ``ids`` are places in ``pieces``.
    Sentences in which a position that can be reached has no piece are left out. More than ``MAX_PIECES`` pieces raise ValueError.
    """
    if len(pieces) > MAX_PIECES:
        raise ValueError("too many pieces for a worker")
    shared = sentences.sparkSession.sparkContext.broadcast(pieces)
    names = ["weight", "n", "starts", "ends", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {p: k for k, p in enumerate(shared.value)}
        lengths = _lengths(known)
        for batch in batches:
            rows = []
            for s, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _edges(s, known, lengths)
                if found is not None:
                    rows.append((w, len(s), *found))
            weight, n, *lists = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(weight, pa.float64()), pa.array(n, pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names)

    # Lattices take far more room than sentences, so they are made on all cores.
    spread = sentences.select("sentence", F.col("weight").cast("double")).repartition(sentences.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "weight double, n int, starts array<int>, ends array<int>, ids array<int>")


def _lengths(pieces: Iterable[str]) -> dict[str, list[int]]:
    """Lengths that pieces have, by first character: most substrings are never looked up."""
    out: dict[str, list[int]] = {}
    for c, n in sorted({(p[0], len(p)) for p in pieces if p}):
        out.setdefault(c, []).append(n)
    return out


def _edges(s: str, known: dict[str, int], lengths: dict[str, list[int]], reachable: bool = True) -> tuple[list[int], list[int], list[int]] | None:
    """(starts, ends, ids) of pieces. With ``reachable`` only where the start leads to, and None where the end can't be reached without a gap."""
    starts, ends, ids = [], [], []
    reached = bytearray(len(s) + 1)
    reached[0] = 1
    for i, c in enumerate(s):
        if reachable and not reached[i]:
            continue
        before = len(ids)
        for n in lengths.get(c, ()):
            k = known.get(s[i : i + n])
            if k is not None and i + n <= len(s):
                starts.append(i)
                ends.append(i + n)
                ids.append(k)
                reached[i + n] = 1
        if reachable and len(ids) == before:
            return None
    return (starts, ends, ids) if not reachable or s and reached[-1] else None


def _sweep(into: np.ndarray, owner: np.ndarray, at: np.ndarray, other: np.ndarray, score: np.ndarray, descending: bool) -> None:
    """Fill ``into`` [sentence, position]: at each position ``at`` the log of the sum over edges of exp(score + into[other end])."""
    # Edges come by sentence, so a stable sort by position (a radix sort of small numbers) keeps those of a sentence together.
    place = int(at.max()) - at if descending else at
    order = np.argsort(place.astype(np.int16) if into.shape[1] < 2**15 else place, kind="stable")
    owner, at, other, score = owner[order], at[order], other[order], score[order]
    bounds = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at))
    for a, b in zip(bounds, bounds[1:]):
        x = into[owner[a:b], other[a:b]] + score[a:b]
        heads = np.flatnonzero(np.append(True, owner[a + 1 : b] != owner[a : b - 1]))
        top = np.maximum.reduceat(x, heads)
        base = np.where(np.isfinite(top), top, 0.0)
        total = np.add.reduceat(np.exp(x - np.repeat(base, np.diff(np.append(heads, b - a)))), heads)
        with np.errstate(divide="ignore"):
            into[owner[a:b][heads], at[a]] = base + np.log(total)


def posteriors(weight: np.ndarray, n: np.ndarray, starts: list, ends: list, ids: list, logp: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected count of each piece, log-likelihood) of some lattices: forward and backward passes over all of them at once, position by position."""
    owner = np.repeat(np.arange(len(n)), [len(x) for x in ids])
    start, end, piece = (np.concatenate([np.asarray(x, np.int64) for x in part]) for part in (starts, ends, ids))
    score = logp[piece]
    alpha = np.full((len(n), int(n.max()) + 1), -np.inf)
    beta = alpha.copy()
    alpha[:, 0] = 0.0
    beta[np.arange(len(n)), n] = 0.0
    _sweep(alpha, owner, end, start, score, False)
    _sweep(beta, owner, start, end, score, True)
    z = alpha[np.arange(len(n)), n]
    share = np.exp(alpha[owner, start] + score + beta[owner, end] - z[owner]) * weight[owner]
    return np.bincount(piece, share, len(logp)), float((weight * z).sum())


def expected_counts(lattices: DataFrame, logp: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected count of each piece, log-likelihood) over the lattices; workers add up before the shuffle, a row a piece comes back."""
    shared = lattices.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        counts, total = np.zeros(len(logp)), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                weight, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                lists = [part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
                more, z = posteriors(weight, n, *lists, logp)
                counts += more
                total += z
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(counts[used], total))], ["id", "n"])

    sums = lattices.mapInArrow(run, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, values = sums.column(0).to_numpy(), sums.column(1).to_numpy()
    counts = np.zeros(len(logp))
    counts[ids[ids >= 0]] = values[ids >= 0]
    return counts, float(values[ids < 0].sum())


def fit(sentences: DataFrame, pieces: list[str], rounds: int, tolerance: float = 1e-4) -> tuple[dict[str, float], list[float]]:
    """(log probabilities, log-likelihood of each round) after at most ``rounds`` rounds or when no score moves by ``tolerance``.

    A piece that ``pieces`` repeats counts each time for the equal scores of the start, and once from then on.
    """
    known = list(dict.fromkeys(pieces))
    if not known:
        return {}, []
    lattices = cut(match_lattices(sentences, known))
    logp, history = np.full(len(known), -math.log(len(pieces))), []
    for _ in range(rounds):
        counts, z = expected_counts(lattices, logp)
        history.append(z)
        new = np.log1p(counts) - math.log1p(counts.sum())
        moved = np.abs(new - logp).max()
        logp = new
        if moved < tolerance:
            break
    return dict(zip(known, logp.tolist())), history


def apply_scores(vocab: DataFrame, logp: DataFrame) -> DataFrame:
    """``vocab`` (token_id, piece, score) with the scores of ``logp`` (piece, score); special pieces and pieces without a new score keep theirs."""
    new = F.broadcast(logp.select("piece", F.col("score").alias("new")))
    score = F.when(is_special("piece", unused=True), F.col("score")).otherwise(F.coalesce("new", "score"))
    return vocab.join(new, "piece", "left").select("token_id", "piece", score.alias("score"))


def segment(sentences: DataFrame, logp: dict[str, float]) -> DataFrame:
    """(sent_id, sentence) -> (sent_id, pieces): the likeliest segmentation of each sentence."""
    shared = sentences.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Lattices(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([net.best(s) for s in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["sent_id", "pieces"])

    return sentences.select(F.col("sent_id").cast("long"), "sentence").mapInArrow(run, "sent_id long, pieces array<string>")


def seed_pieces(words: DataFrame, size: int, longest: int = 8) -> list[str]:
    """All characters and the substrings of words (word, freq) with the greatest length times frequency, ``size`` in all."""
    starts = words.select("freq", normalize(F.trim("word")).alias("w")).select("freq", "w", F.explode(F.expr("sequence(1, length(w))")).alias("i"))
    parts = starts.select("freq", F.explode(F.expr(f"transform(sequence(1, least({longest}, length(w) - i + 1)), k -> substring(w, i, k))")).alias("piece"))
    counts = parts.groupBy("piece").agg(F.sum("freq").alias("n"))
    letters = [r.piece for r in counts.where(F.length("piece") == 1).select("piece").collect()]
    best = counts.where((F.length("piece") > 1) & (F.col("n") > 1)).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(max(0, size - len(letters)))
    return sorted(letters) + [r.piece for r in best.select("piece").collect()]


#: Special pieces come first, then the pieces of single bytes with their score.
SPECIALS, BYTE_SCORE = ("<unk>", "<s>", "</s>", "<pad>"), -20.0


def with_bytes(logp: dict[str, float]) -> list[tuple[int, str, float]]:
    """(token_id, piece, score): special pieces, a piece for each byte (so that any text has one), and the pieces by falling score."""
    first = [(t, 0.0) for t in SPECIALS] + [(f"<0x{b:02X}>", BYTE_SCORE) for b in range(256)]
    return [(k, p, x) for k, (p, x) in enumerate(first + sorted(logp.items(), key=lambda r: (-r[1], r[0])))]


def train(words: DataFrame, size: int, rounds: int = 2, shrink: float = 0.75) -> dict[str, float]:
    """A unigram vocabulary of ``size`` pieces from words (word, freq): seeds, then rounds of fitting and pruning.

    Pieces of least expected count go first; single characters always stay.
    """
    sentences = words.select(normalize(F.trim("word")).alias("sentence"), F.col("freq").alias("weight"))
    pieces = seed_pieces(words, 4 * size)
    while True:
        logp, _ = fit(sentences, pieces, rounds)
        letters = [p for p in pieces if len(p) == 1]
        if len(pieces) <= max(size, len(letters)):
            return logp
        keep = max(size, int(len(pieces) * shrink)) - len(letters)
        longer = sorted((p for p in pieces if len(p) > 1), key=lambda p: (-logp[p], p))
        pieces = letters + longer[: max(0, keep)]
