"""Evaluation texts that leak into a corpus (problem 7).

Winnowing: of each window of ``WINDOW`` consecutive hashes of ``GRAM`` words the least is a fingerprint, so every shared run of
``GRAM + WINDOW - 1`` words shares one. A passage of ``PASSAGE`` words of which at most one in ten is changed, left out or added has
such a run. Fingerprints of corpus and items are joined, and hits are aligned to both sides in a band of all allowed edits and accepted
when the passage is long enough. Items of at most ``BROADCAST_CHARS`` characters, as a checked sum, are joined in the workers, so nothing
of the corpus is shuffled; more of them are joined as tables of fingerprints, and only documents with a hit meet the items' words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.normal import WordHashes
from lexiloom.tables import cut

GRAM, WINDOW = 5, 4
#: Least length of a passage in words of the item, and the words for each edit.
PASSAGE, WORDS_AN_EDIT = 32, 10
#: Words and edits of the longest passage to look for: one with at least 2 * PASSAGE + 1 words beside its edits falls into two parts of
#: at least PASSAGE words, of which one has at most its share of the edits.
LONGEST = (2 * PASSAGE + 1) * WORDS_AN_EDIT // (WORDS_AN_EDIT - 1)
MOST_EDITS = LONGEST // WORDS_AN_EDIT
#: Characters of the items that are broadcast at most; their words and fingerprints take about 5 bytes for each.
BROADCAST_CHARS = 16_000_000
#: An opening line that at least so many items share and that has at most so many words is an instruction.
INSTRUCTION_ITEMS, INSTRUCTION_WORDS = 3, 25
#: Documents that a worker fingerprints at once.
BLOCK = 500
_NONE = np.uint64(2**64 - 1)


def gram_hashes(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` words from each position; the greatest value where they aren't of one document."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out[owner[:n] != owner[GRAM - 1 :]] = _NONE
    return out


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the last least hash of each window (of all, where there are fewer)."""
    if len(grams) < WINDOW:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())] if len(grams) else [], int)
    n = len(grams) - WINDOW + 1
    windows = np.stack([grams[WINDOW - 1 - k : WINDOW - 1 - k + n] for k in range(WINDOW)])
    at = np.unique(np.arange(n) + WINDOW - 1 - windows.argmin(0))
    return at[grams[at] != _NONE]


def passage(doc: list[int], item: list[int], i: int, j: int) -> tuple[bool, int]:
    """Whether the match of doc[i:] and item[j:] is part of a leaked passage; the end of its exact run in the document."""
    a, b = i, j
    while a and b and doc[a - 1] == item[b - 1]:
        a, b = a - 1, b - 1
    e, f = i, j
    while e < len(doc) and f < len(item) and doc[e] == item[f]:
        e, f = e + 1, f + 1
    end = e
    if e - a < GRAM + WINDOW - 1:
        return False, end
    right = _reach(doc[e : e + LONGEST + MOST_EDITS], item[f : f + LONGEST])
    left = _reach(doc[max(0, a - LONGEST - MOST_EDITS) : a][::-1], item[max(0, b - LONGEST) : b][::-1])
    for before, x in enumerate(left):
        for after, y in enumerate(right):
            if x >= 0 and y >= 0 and f - b + x + y >= max(PASSAGE, WORDS_AN_EDIT * (before + after)):
                return True, end
    return False, end


def _reach(doc: list[int], item: list[int]) -> list[int]:
    """For each number of edits the most words of the item, the last one equal, that align with a start of ``doc``; -1 where none do."""
    out = [0] + [-1] * MOST_EDITS
    # Least edits for the first y words of the item and y + k - MOST_EDITS of the document.
    width, far = 2 * MOST_EDITS + 1, MOST_EDITS + 1
    row = [k - MOST_EDITS if k >= MOST_EDITS else far for k in range(width)] + [far]
    for y, word in enumerate(item):
        last, new = far, []
        for k in range(width):
            x = y + k - MOST_EDITS
            cost = row[k + 1] + 1
            if 0 <= x < len(doc):
                equal = doc[x] == word
                if equal and row[k] < far:
                    out[row[k]] = y + 1
                cost = min(cost, last + 1, row[k] if equal else row[k] + 1)
            elif x >= len(doc):
                cost = far
            last = min(cost, far)
            new.append(last)
        if min(new) == far:
            break
        row = [*new, far]
    return out


class ItemIndex:
    """Fingerprints and words of a block of items."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.items = items
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            grams = gram_hashes(np.array(words, np.uint64), np.zeros(len(words), int))
            for at in winnow(grams):
                self.postings[int(grams[at])].append((k, int(at)))
        self.keys = np.array(sorted(self.postings), np.uint64)

    def search(self, docs: list[list[int]]) -> list[tuple[int, int]]:
        """(document number, item id) of each leak."""
        lengths = np.array([len(d) for d in docs], int)
        words = np.array([w for d in docs for w in d], np.uint64)
        starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(docs)), lengths)
        grams = gram_hashes(words, owner)
        at = winnow(grams)
        if not len(at) or not len(self.keys):
            return []
        near = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        out: set[tuple[int, int]] = set()
        done: dict[tuple[int, int, int], int] = {}
        for pos in at[self.keys[near] == grams[at]].tolist():
            d = int(owner[pos])
            i = pos - int(starts[d])
            for k, j in self.postings[int(grams[pos])]:
                item_id, item = self.items[k]
                if (d, item_id) in out or done.get((d, k, i - j), -1) >= i:
                    continue
                leaked, done[d, k, i - j] = passage(docs[d], item, i, j)
                if leaked:
                    out.add((d, item_id))
        return sorted(out)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words): hashed words of each item that is long enough, without an instruction line at its start; repeated rows once."""
    rows = items.where("item_id is not null and length(text) > 0").select(F.col("item_id").cast("long"), "text").distinct()
    head = F.when(F.instr("text", "\n") > 0, F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))
    rows = rows.withColumn("head", head)
    shared = rows.where("head is not null").groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") >= INSTRUCTION_ITEMS)
    rows = rows.join(shared, "head", "left").select("item_id", "text", F.col("n").isNotNull().alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, lists = [], []
            for item_id, text, is_shared in zip(*(c.to_pylist() for c in batch.columns)):
                head, _, rest = text.partition("\n")
                words = hashes.of_text(rest if is_shared and len(hashes.of_text(head)) <= INSTRUCTION_WORDS else text)
                if len(words) >= PASSAGE:
                    ids.append(item_id)
                    lists.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["item_id", "words"])

    return rows.mapInArrow(run, "item_id long, words array<long>")


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each document that holds a passage of an item, each pair once.

    Rows without id, null and short texts give none. An item_id with several texts stands for all of them.
    """
    words = item_words(items)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    if size <= BROADCAST_CHARS:
        return _search(texts, [(r.item_id, r.words) for r in words.orderBy("item_id").collect()]).distinct()
    return _search_by_join(texts, cut(words))


def _search(texts: DataFrame, items: list[tuple[int, list[int]]]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = ItemIndex(shared.value), WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, found = part.column(0).to_pylist(), part.column(1).to_pylist()
                pairs = index.search([hashes.of_text(t) for t in found])
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], ["doc_id", "item_id"])

    return texts.mapInArrow(run, "doc_id long, item_id long")


def _search_by_join(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The same for items of any size: distinct fingerprints of documents and items are joined, then the words of the pairs that meet."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _fingerprints(batch.column(0).to_pylist(), batch.column(1).to_pylist(), "item_id")

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield _fingerprints(batch.column(0).to_pylist(), [hashes.of_text(t) for t in batch.column(1).to_pylist()], "doc_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            kept = [bool(ItemIndex([(i, w)]).search([hashes.of_text(t)])) for i, w, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    known = items.mapInArrow(of_items, "item_id long, print long")
    prints = texts.mapInArrow(of_docs, "doc_id long, print long").join(known.select("print").distinct(), "print", "left_semi")
    pairs = cut(prints.join(known, "print").select("doc_id", "item_id").distinct())
    met = pairs.join(items, "item_id").join(texts, "doc_id").select("doc_id", "item_id", "words", "text")
    return met.mapInArrow(check, "doc_id long, item_id long").distinct()


def _fingerprints(ids: list[int], lists: list[list[int]], name: str) -> pa.RecordBatch:
    """(id, print): the distinct fingerprints of each list of hashed words."""
    rows = []
    for key, words in zip(ids, lists):
        grams = gram_hashes(np.array(words, np.uint64), np.zeros(len(words), int))
        rows += [(key, p) for p in np.unique(grams[winnow(grams)]).view(np.int64).tolist()]
    keys, prints = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prints, pa.int64())], [name, "print"])
