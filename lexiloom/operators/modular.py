"""A tokenizer with subtokenizers: one global vocabulary of which each set of languages sees a part."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.bpe import BpeCoder
from lexiloom.functions.text import byte_alphabet, pretokens, py_to_bytes_alphabet
from lexiloom.operators import vocab as V
from lexiloom.operators.bpe import BpeModel


@dataclass
class ModularTokenizer:
    """Global model, language masks and what derives from them. Ids in results are global ids."""

    model: BpeModel
    masks: dict[str, set[int]]
    pad_multiple: int | None = None

    @property
    def vocab_size(self) -> int:
        """Size of the padded global vocabulary."""
        return V.padded_size(len(self.model.vocab), self.pad_multiple)

    def ids(self, subtok: str | None) -> list[int]:
        """Global ids that a subtokenizer sees, in order."""
        specials = {i for t, i in self.model.vocab.items() if t in V.SPECIAL_NAMES}
        if subtok in (None, "all"):
            return sorted(self.model.vocab.values())
        return sorted(specials.union(*(self.masks.get(x.strip(), set()) for x in subtok.split(","))))

    def is_modular(self, subtok: str | None) -> bool:
        """Whether a subtokenizer sees a part of the vocabulary only."""
        return subtok not in (None, "all")

    def rules(self, subtok: str | None) -> list[tuple[int, str, str]]:
        """Ranked merges among the tokens that a subtokenizer sees."""
        seen = set(self.ids(subtok))
        v = self.model.vocab
        return [(k, a, b) for k, (a, b) in enumerate(self.model.merges) if v.get(a) in seen and v.get(b) in seen and v.get(a + b) in seen]

    def encode(self, docs: DataFrame, subtok: str | None = None, bos: bool = True, eos: bool = True) -> DataFrame:
        """(doc_id, text) -> (doc_id, tokens array<int>); a null text gives just the begin and end tokens."""
        vocab, seen, unk = self.model.vocab, set(self.ids(subtok)), self.model.vocab["<unk>"]
        shared = docs.sparkSession.sparkContext.broadcast((self.rules(subtok), {t: i for t, i in vocab.items() if i in seen}))
        first, last = [vocab["<s>"]] * bos, [vocab["</s>"]] * eos

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules, known = shared.value
            coder, cache = BpeCoder(rules), {}
            for batch in batches:
                rows = []
                for words in batch.column(1).to_pylist():
                    tokens = list(first)
                    for w in words or []:
                        got = cache.get(w)
                        if got is None:
                            if len(cache) > 200_000:
                                cache.clear()
                            got = cache[w] = [known.get(p, unk) for p in coder.split(py_to_bytes_alphabet(w))]
                        tokens += got
                    rows.append(tokens + last)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "tokens"])

        return docs.select(F.col("doc_id").cast("long"), pretokens("text").alias("words")).mapInArrow(run, "doc_id long, tokens array<int>")

    def encode_parts(self, parts: DataFrame, subtoks: dict[str, str | None], bos: bool = True) -> DataFrame:
        """(doc_id, k, side, text) -> (doc_id, tokens): the parts of each prompt in order of ``k``, each by the subtokenizer of its side.

        Prompts whose questions and answers are read under different subtokenizers are made so; ids are global. ``subtoks`` names sides.
        """
        out = None
        for side, subtok in subtoks.items():
            # Both passes of one side go through the same rules; the place of a part stays with it.
            mine = parts.where(F.col("side") == side).select("doc_id", "k", "text")
            keyed = mine.select(F.xxhash64("doc_id", "k").alias("doc_id"), "text")
            ids = mine.select("doc_id", "k", F.xxhash64("doc_id", "k").alias("key")).join(self.encode(keyed, subtok, False, False).withColumnRenamed("doc_id", "key"), "key").select("doc_id", "k", "tokens")
            out = ids if out is None else out.unionByName(ids)
        joined = out.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
        return joined.withColumn("tokens", F.concat(F.array(F.lit(self.model.vocab["<s>"])), "tokens")) if bos else joined

    def truncate(self, docs: DataFrame, budget: int, subtok: str | None = None) -> DataFrame:
        """(doc_id, tokens, text): the first ``budget`` tokens of each text and the text they stand for."""
        tokens = self.encode(docs, subtok, bos=False, eos=False).withColumn("tokens", F.slice("tokens", 1, budget))
        return tokens.join(self.decode(tokens), "doc_id")

    def decode(self, tokens: DataFrame) -> DataFrame:
        """(doc_id, tokens) -> (doc_id, text): padding and unknown tokens dropped, cut at a second begin or end token, bytes that are no UTF-8 replaced."""
        vocab = self.model.vocab
        pieces = {i: t for t, i in vocab.items()}
        drop, marks = {vocab["<pad>"], vocab["<unk>"]}, {vocab["<s>"], vocab["</s>"]}
        byte = {c: b for b, c in enumerate(byte_alphabet())}

        def text(ids: list[int]) -> str:
            ids = [i for i in ids if i not in drop]
            end = next((k for k, i in enumerate(ids) if k and i in marks), len(ids))
            return bytes(byte[c] for i in ids[:end] if i not in marks for c in pieces[i]).decode("utf-8", "replace")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

        return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def _translated(tokens: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """Arrays of ids mapped by ``pairs`` (key, value), which are tokenizer-sized, in Arrow batches of the workers."""
    shared = tokens.sparkSession.sparkContext.broadcast({r.key: r.value for r in pairs.collect()})
    at, names = tokens.columns.index(column), tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = [None if x is None else [known[i] for i in x] for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return tokens.mapInArrow(run, tokens.schema)


def sub_to_global(tokens: DataFrame, mapping: DataFrame, column: str = "tokens") -> DataFrame:
    """Arrays of subtokenizer ids as global ids by ``mapping`` (sub_id, global_id); an id that isn't in it raises KeyError."""
    return _translated(tokens, mapping.select(F.col("sub_id").alias("key"), F.col("global_id").alias("value")), column)


def global_to_sub(tokens: DataFrame, mapping: DataFrame, column: str = "tokens") -> DataFrame:
    """Arrays of global ids as those of the subtokenizer; an id that it lacks raises KeyError."""
    return _translated(tokens, mapping.select(F.col("global_id").alias("key"), F.col("sub_id").alias("value")), column)
