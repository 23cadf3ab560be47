"""Token counts of documents under an existing byte-level BPE tokenizer (problem 2).

The tokenizer has no normalizer; its pre-splitting is a regular expression. A first pass over the corpus counts its
distinct pieces, each is tokenized once, and a second pass joins the cached lengths with the pieces of each document.
Lengths of the most frequent pieces are broadcast (at most ``HEAD_PIECES`` rows, whatever the corpus), which keeps hot
keys out of the shuffle; all other pieces go through a shuffle join, so totals are exact at every size.

Both passes run in Arrow batches: splitting a text at single blanks in a worker costs a fifth of what the regular
expression and the explode of every word cost inside the JVM. A piece is therefore what stands between two blanks; the
regular expression is applied to each distinct piece once, and inside a text only where blanks are doubled or a piece is
long (text without blanks).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.bpe import BpeCoder
from lexiloom.functions.text import PRETOKEN, py_to_bytes_alphabet
from lexiloom.tables import cut

#: Most pieces that are broadcast. A piece and its length take about 100 bytes, so this is about 13 MB.
HEAD_PIECES = 131_072
#: Most merge rules a worker may hold; tokenizers have at most a few hundred thousand.
MAX_MERGES = 1_000_000
#: A worker's counter is emptied into the shuffle when it holds so many pieces.
COUNTER_ROWS = 400_000
#: A piece without blanks that is longer than this is split by the regular expression at once.
LONG_PIECE = 40

_PRETOKEN = regex.compile(PRETOKEN.replace(r"\x{85}", r"\x85"))
_BLANKS = re.compile(r" (?=\s)|\s(?= )")
#: Marks a piece that no blank precedes; every other piece stands for itself with a blank before it.
_BARE = "\x02"


def text_pieces(text: str) -> list[str]:
    """Keys of the pieces of a text; the pre-tokens of all of them, in order, are those of the text."""
    if _BARE in text or _BLANKS.search(text):
        return [_BARE + p for p in _PRETOKEN.findall(text)]
    parts = text.split(" ")
    parts[0] = _BARE + parts[0]
    if max(map(len, parts)) > LONG_PIECE:
        out: list[str] = []
        for part in parts:
            if len(part) <= LONG_PIECE:
                out.append(part)
            else:
                out += [_BARE + p for p in _PRETOKEN.findall(part[1:] if part[0] == _BARE else " " + part)]
        return out
    return parts


def key_length(key: str, coder: BpeCoder) -> int:
    """Tokens of the piece that a key stands for."""
    text = key[1:] if key[:1] == _BARE else " " + key
    return sum([coder.length(py_to_bytes_alphabet(w)) for w in _PRETOKEN.findall(text)])


def read_merges(merges: DataFrame) -> list[tuple[int, str, str]]:
    """Merge rules on the driver: a tokenizer's table, whose size doesn't depend on the corpus (checked)."""
    rows = merges.select("merge_no", "a", "b").dropna().limit(MAX_MERGES + 1).collect()
    if len(rows) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merge rules")
    return sorted((r.merge_no, r.a, r.b) for r in rows)


def piece_frequencies(docs: DataFrame) -> DataFrame:
    """(piece, freq) over all texts; workers pre-aggregate, so a hot piece is one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text_pieces(text))
                if len(counts) >= COUNTER_ROWS:
                    yield flush()
        yield flush()

    texts = docs.where(F.length("text") > 0).select("text")
    return texts.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("freq"))


def piece_lengths(pieces: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """(piece, freq) -> (piece, freq, n_tok): each row is tokenized once."""
    shared = pieces.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BpeCoder(shared.value)
        for batch in batches:
            lengths = [key_length(p, coder) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32())], ["piece", "freq", "n_tok"])

    return pieces.select("piece", "freq").mapInArrow(run, "piece string, freq long, n_tok int")


def _head_threshold(lexicon: DataFrame, head: int) -> tuple[int, bool]:
    """Least eighth of a power of two such that at most ``head`` pieces are as frequent; whether those are all pieces."""
    rows = lexicon.groupBy(F.floor(F.log2("freq") * 8).alias("octave")).count().collect()  # at most 8 * 64 rows
    taken, least = 0, 1 << 20
    for r in sorted(rows, key=lambda r: -r.octave):
        if taken + r["count"] > head:
            return least, False
        taken, least = taken + r["count"], r.octave
    return least, True


def document_tokens(docs: DataFrame, merges: DataFrame, head: int = HEAD_PIECES) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens): one row for each doc_id that isn't null.

    Null and empty texts have 0 tokens. Repeated doc_ids (not in a clean corpus) are summed. Other columns are ignored.
    """
    spark = docs.sparkSession
    lexicon = cut(piece_lengths(piece_frequencies(docs), read_merges(merges)))
    least, whole = _head_threshold(lexicon, head)
    hot = lexicon.where(F.floor(F.log2("freq") * 8) >= least)
    shared = spark.sparkContext.broadcast({r.piece: r.n_tok for r in hot.select("piece", "n_tok").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            ids, pieces, counts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = text_pieces(text) if text else []
                lengths = list(map(known, keys))
                if None in lengths:
                    rest = Counter([k for k, n in zip(keys, lengths) if n is None])
                    ids += [doc_id] * len(rest)
                    pieces += rest
                    counts += rest.values()
                    lengths = [n for n in lengths if n is not None]
                ids.append(doc_id)
                pieces.append(None)
                counts.append(sum(lengths))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "piece", "n"])

    parts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece string, n long")
    if not whole:
        # The sums of known pieces get keys that match nothing and only spread them.
        key = F.coalesce("piece", F.concat(F.lit("\0 "), F.pmod(F.hash("doc_id"), F.lit(4096)).cast("string")))
        lengths = lexicon.select(F.col("piece").alias("key"), "n_tok")
        parts = parts.withColumn("key", key).join(lengths, "key", "left").withColumn("n", F.when(F.col("piece").isNull(), F.col("n")).otherwise(F.col("n") * F.col("n_tok")))
    return parts.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))


def totals(counted: DataFrame, by: str) -> DataFrame:
    """Documents and tokens for each value of ``by``; null is a group of its own."""
    return counted.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
