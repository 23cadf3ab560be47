"""Records of evaluation splits that also stand in the training split, exactly or nearly (problem 4).

Two operators share the normalised records (words without case, accents, markup and spacing):

:func:`chunk_overlaps` is the method named for the problem. A polynomial hash rolls over ``CHUNK_WINDOW`` characters of a record, the
record is cut where it falls on one of ``CHUNK_CHARS`` residues, digests of chunks are joined across splits, and the lengths of
shared chunks add up to the share of each evaluation record that stands in the training split. One chunk size serves all lengths.

:func:`cross_split_pairs` finds the pairs. A pair keeps 80% of its words in order with edits anywhere, so no run of more than two words is
sure to be kept, and no chunk cut by a window of several words either; its chunks are therefore single words. Each record
joins with its rarest words only: two similar records have ``SIMILAR`` of the words of the longer one in common, so the rarest of
these is among the ``n - ceil(SIMILAR * n) + 1`` rarest words of either (prefix filtering), whatever order of words is agreed on. The order is
that of a table of ``BUCKETS`` counts, a broadcast of fixed size. What else drops a pair before the words are compared is a bound that
follows from ``SIMILAR`` as well, so no pair is lost. Texts apart from form that are equal make a class, and classes are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.lexicon import fold, words_of
from lexiloom.llm.normal import WordHashes, plain
from lexiloom.tables import cut

#: Share of the words of the longer text that a near copy keeps, and the least length of a case.
SIMILAR, LEAST_WORDS = 0.8, 8
#: Bits of the sketch of a record's words, a multiple of 64.
SKETCH = 256
#: Counts in the table that orders words, 4 bytes each.
BUCKETS = 1 << 20
#: Texts are compared within classes of length of this ratio.
LENGTH_STEP = 4.0
#: Characters that the hash rolls over, and the mean length of a chunk.
CHUNK_WINDOW, CHUNK_CHARS = 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_NUMBER = re.compile(r"\d+")
#: What groups the digits of one number.
_GROUPED = re.compile(r"(?<=\d)(?:[.,'’٬٫](?=\d)|[\u00a0\u2009\u202f](?=\d{3}(?!\d)))")


def least_common(n: Column) -> Column:
    """Words that a near copy has in common with a text of ``n`` words, where that is the longer one."""
    return F.ceil(SIMILAR * n - 1e-9).cast("int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def digest_text(text: str, hashes: WordHashes) -> tuple[list[int], int, int]:
    """(hashed words, hash of its numbers in order, hash of the letters without spacing).

    A number is a run of digits; marks that group its digits don't count, so that 1,234 and 1234 are the same number apart from form.
    """
    shown = plain(text)
    words = words_of(shown)
    numbers = " ".join([n for w in map(fold, words_of(_GROUPED.sub("", shown))) for n in _NUMBER.findall(w)])
    return hashes.of(words), xxhash.xxh64_intdigest(numbers) >> 1, xxhash.xxh64_intdigest("".join(map(fold, words))) >> 1


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    where: dict[int, int] = {}
    for k, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << k
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        hit = where.get(w, 0)
        if hit:
            kept = row & hit
            row = ((row + kept) | (row - kept)) & full
    return len(b) - row.bit_count()


def digests(records: DataFrame) -> DataFrame:
    """(tab, rec_id, split, task, text) -> (tab, rec_id, split, task, same, numbers, words, train) of rows that can be cases.

    Null texts and texts of fewer than ``LEAST_WORDS`` words are left out, as are rows without rec_id or split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [digest_text(t, hashes) for t in batch.column(4).to_pylist()]
            words, numbers, same = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same, pa.int64()), pa.array(numbers, pa.int64()), pa.array(words, pa.list_(pa.int64()))], ["tab", "rec_id", "split", "task", "same", "numbers", "words"])

    rows = records.where("rec_id is not null and split is not null and text is not null").select("tab", F.col("rec_id").cast("long"), "split", "task", "text")
    out = rows.mapInArrow(run, "tab string, rec_id long, split string, task string, same long, numbers long, words array<long>")
    return out.where(F.size("words") >= LEAST_WORDS).withColumn("train", F.col("split") == "train")


def _words_of_rows(lists: list[list[int]], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, digest, times, first, last) of the distinct words of each list; a digest is of the word and its group."""
    sizes = np.array([len(x) for x in lists], np.int64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    words = _mixed(np.array([w for x in lists for w in x], np.int64).astype(np.uint64))
    words = (_mixed(words + np.repeat(_mixed(group.astype(np.uint64)), sizes)) >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((words, owner))
    owner, words, at = owner[order], words[order], order - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    ends = np.append(start[1:], len(words))
    return owner[start], words[start], ends - start, at[start], at[ends - 1] if len(words) else start


def word_ranks(classes: DataFrame) -> np.ndarray:
    """For each bucket of word digests how many classes have a word in it; 0 where these aren't two classes of both sides.

    Workers count their rows; at most ``BUCKETS`` rows of sums come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            owner, words, *_ = _words_of_rows(batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False))
            for k, side in enumerate((None, 2, 3)):
                kept = words if side is None else words[batch.column(side).to_numpy(zero_copy_only=False)[owner]]
                counts[k] += np.bincount(kept % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c[at]) for c in counts)], ["bucket", "n", "t", "e"])

    parts = classes.select("grouped", "words", "in_train", "in_eval").mapInArrow(run, "bucket int, n long, t long, e long")
    sums = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in "nte")).where("t > 0 and e > 0 and n > 1").select("bucket", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    ranks = np.zeros(BUCKETS, np.int32)
    ranks[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return ranks


def prefix_rows(classes: DataFrame, ranks: np.ndarray) -> DataFrame:
    """A row for each of the rarest words of each class: (id, n, in_train, in_eval, sketch..., word, first, last).

    ``word`` is a digest of the word with table and numbers, ``first`` and ``last`` are its positions. A bit of the sketch tells whether an
    odd number of words falls on it, so two records differ in at most as many bits as in words.
    """
    carried = ["id", "n", "in_train", "in_eval"]
    sketch = [f"s{k}" for k in range(SKETCH // 64)]
    shared = classes.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(carried) + 1).to_pylist()
            n = np.array([len(x) for x in lists], np.int64)
            owner, words, times, first, last = _words_of_rows(lists, batch.column(len(carried)).to_numpy(zero_copy_only=False))
            bits = np.bincount(owner * SKETCH + words % SKETCH, weights=times, minlength=len(lists) * SKETCH).astype(np.int64) & 1
            sketches = np.packbits(bits.astype(np.uint8).reshape(len(lists), SKETCH), axis=1).view(np.int64)
            rank = shared.value[words % BUCKETS]
            order = np.lexsort((words, rank, owner))
            owner, words, times, first, last, rank = (x[order] for x in (owner, words, times, first, last, rank))
            upto = np.cumsum(times)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            before = upto - times
            before = before - np.repeat(before[start], np.diff(np.append(start, len(owner))))
            spare = n - np.ceil(SIMILAR * n - 1e-9).astype(np.int64)
            keep = np.flatnonzero((before <= spare[owner]) & (rank > 0))
            picked = batch.select(carried).take(pa.array(owner[keep]))
            columns = [*picked.columns, *(pa.array(sketches[owner[keep], k]) for k in range(len(sketch))), pa.array(words[keep]), *(pa.array(x[keep].astype(np.int32)) for x in (first, last))]
            yield pa.RecordBatch.from_arrays(columns, [*carried, *sketch, "word", "first", "last"])

    schema = f"id long, n int, in_train boolean, in_eval boolean, {', '.join(f'{c} long' for c in sketch)}, word long, first int, last int"
    return classes.select(*carried, "grouped", "words").mapInArrow(run, schema)


def similar_classes(classes: DataFrame) -> DataFrame:
    """(tab, a, b, overlap): classes a != b, a with a training record and b with another, of near-equal texts; every such pair.

    ``classes`` (tab, same, numbers, n, words, in_train, in_eval) has to be written already; ``overlap`` is the share of the
    longer text that is in the other in the same order.
    """
    classes = classes.withColumn("id", F.xxhash64("tab", "same")).withColumn("grouped", F.xxhash64("tab", "numbers"))
    kept = prefix_rows(classes, word_ranks(classes))
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(LENGTH_STEP))).cast("int")
    sketch = [f"s{k}" for k in range(SKETCH // 64)]
    side = lambda df, end: df.select("word", "size_class", *(F.col(c).alias(f"{c}_{end}") for c in ("id", "n", "first", "last", *sketch)))
    left = kept.where("in_train").withColumn("size_class", size_class(F.col("n")))
    right = kept.where("in_eval").withColumn("size_class", F.explode(F.array_distinct(F.array(size_class(F.col("n") * SIMILAR - 1e-6), size_class(F.col("n") / SIMILAR + 1e-6)))))
    met = side(left, "a").join(side(right, "b"), ["word", "size_class"])
    common = least_common(F.greatest("n_a", "n_b"))
    met = met.where((F.col("id_a") != F.col("id_b")) & (F.least("n_a", "n_b") >= common))
    # Words before a common one that aren't in common are at most all of those; nor can more words differ than these of both.
    met = met.where((F.col("first_a") - F.col("last_b") <= F.col("n_a") - common) & (F.col("first_b") - F.col("last_a") <= F.col("n_b") - common))
    differing = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch), F.lit(0))
    pairs = met.where(differing <= F.col("n_a") + F.col("n_b") - 2 * common).select("id_a", "id_b").distinct()
    texts = classes.select("id", "tab", "numbers", "same", "words")
    ends = [texts.select(*(F.col(c).alias(f"{c}_{end}") for c in texts.columns)) for end in "ab"]
    both = pairs.join(ends[0], "id_a").join(ends[1], "id_b").where("tab_a = tab_b and numbers_a = numbers_b")
    both = both.select(F.col("tab_a").alias("tab"), F.col("same_a").alias("a"), F.col("same_b").alias("b"), F.col("words_a").alias("x"), F.col("words_b").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [common_words(x, y) / max(len(x), len(y)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            keep = pa.array([s >= SIMILAR - 1e-9 for s in share], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], ["tab", "a", "b", "overlap"]).filter(keep)

    return both.mapInArrow(run, "tab string, a long, b long, overlap double")


def cross_split_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs of classes): (tab, same, rec_id, split, task, train), each record once, and (tab, a, b, overlap), a in train and b in another split.

    ``a`` = ``b``, with overlap 1.0, are texts that are equal apart from form. An empty table gives no rows.
    """
    rows = cut(digests(records))
    members = rows.select("tab", "same", "rec_id", "split", "task", "train").dropDuplicates(["tab", "rec_id", "split", "same"])
    first = F.min_by(F.struct("numbers", "words"), "rec_id").alias("first")
    classes = rows.groupBy("tab", "same").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"), first)
    classes = cut(classes.select("tab", "same", "in_train", "in_eval", "first.numbers", "first.words", F.size("first.words").alias("n")))
    equal = classes.where("in_train and in_eval").select("tab", F.col("same").alias("a"), F.col("same").alias("b"), F.lit(1.0).alias("overlap"))
    return members, similar_classes(classes).unionByName(equal)


def cross_split_pairs(records: DataFrame) -> DataFrame:
    """(tab, id_train, id_eval, eval_split, task, overlap): every pair of a training record and a record of another split that
    are equal apart from form or nearly equal, both of the same table. ``overlap`` is the share of the longer text, 1.0 for equal ones.

    An empty table gives no rows. Every pair is given, also between groups of copies.
    """
    members, near = cross_split_classes(records)
    train = members.where("train").select("tab", F.col("same").alias("a"), F.col("rec_id").alias("id_train"))
    other = members.where("not train").select("tab", F.col("same").alias("b"), F.col("rec_id").alias("id_eval"), F.col("split").alias("eval_split"), "task")
    return near.join(train, ["tab", "a"]).join(other, ["tab", "b"]).where("id_train != id_eval").select("tab", "id_train", "id_eval", "eval_split", "task", "overlap")


def reports(members: DataFrame, near: DataFrame) -> DataFrame:
    """(tab, eval_split, task, n_records, n_pairs, mean_overlap): records of each table, split and task with a counterpart in train, the
    pairs they make, and the mean over records of the overlap fraction with their nearest counterpart.

    Classes are counted, not expanded: a pair of classes stands for the product of its members.
    """
    trained = members.where("train").groupBy("tab", F.col("same").alias("a")).agg(F.count("*").alias("n_train"))
    partners = near.join(trained, ["tab", "a"]).groupBy("tab", F.col("b").alias("same")).agg(F.sum("n_train").alias("partners"), F.max("overlap").alias("overlap"))
    tested = members.where("not train").groupBy("tab", "same", F.col("split").alias("eval_split"), "task").agg(F.count("*").alias("n"))
    sums = tested.join(partners, ["tab", "same"]).groupBy("tab", "eval_split", "task")
    return sums.agg(F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("partners")).alias("n_pairs"), (F.sum(F.col("n") * F.col("overlap")) / F.sum("n")).alias("mean_overlap"))


def cut_chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, digest, characters) of the content-defined chunks of texts; an empty text has none.

    A chunk ends where the hash of the last ``CHUNK_WINDOW`` characters is a multiple of ``CHUNK_CHARS``, and at the end of the text.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(CHUNK_WINDOW):
        rolled[k:] += codes[: len(codes) - k] * np.uint64(pow(int(_BASE), k, 2**64))
    ends = (_mixed(rolled) % np.uint64(CHUNK_CHARS) == 0) & (place >= CHUNK_WINDOW - 1)
    ends[np.cumsum(sizes)[sizes > 0] - 1] = True
    last = np.flatnonzero(ends)
    start = np.append(0, last[:-1] + 1)
    length = last - start + 1
    powers = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), _BASE)), dtype=np.uint64)
    digest = _mixed(np.add.reduceat(codes * powers[np.arange(len(codes)) - np.repeat(start, length)], start) + length.astype(np.uint64))
    return owner[start], (digest >> np.uint64(1)).astype(np.int64), length


def chunk_overlaps(records: DataFrame) -> DataFrame:
    """(tab, rec_id, split, task, n_chars, shared_chars, overlap): for each record outside of train the share of its text, in characters apart
    from form, in chunks that a training record of the same table has too.

    Null and empty texts, and rows without rec_id or split, give no rows; repeated rows count once. Digests alone are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, digest, length = cut_chunks(["".join(map(fold, words_of(plain(t)))) for t in batch.column(4).to_pylist()])
            # A row without a chunk stands for the record itself, so that repeated rows can be told.
            picked = batch.select([0, 1, 2, 3]).take(pa.array(np.append(owner, np.arange(batch.num_rows))))
            chunk = pa.array([*digest.tolist(), *[None] * batch.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*picked.columns, chunk, pa.array(np.append(length, np.zeros(batch.num_rows, np.int64)))], ["tab", "rec_id", "split", "task", "chunk", "chars"])

    rows = records.where("rec_id is not null and split is not null and text is not null").select("tab", F.col("rec_id").cast("long"), "split", "task", "text")
    chunks = cut(rows.mapInArrow(run, "tab string, rec_id long, split string, task string, chunk long, chars long"))
    trained = chunks.where("split = 'train' and chunk is not null").select("tab", "chunk").distinct().withColumn("known", F.lit(True))
    each = chunks.where("split != 'train'").groupBy("tab", "rec_id", "split", "task", "chunk").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    known = F.sum(F.when(F.col("known"), F.col("chars")))
    rows = F.sum(F.when(F.col("chunk").isNull(), F.col("n")))
    sums = each.join(trained, ["tab", "chunk"], "left").groupBy("tab", "rec_id", "split", "task").agg(F.sum("chars").alias("all"), F.coalesce(known, F.lit(0)).alias("shared"), rows.alias("rows"))
    one = lambda c: (F.col(c) / F.col("rows")).cast("long")
    return sums.where("all > 0").select("tab", "rec_id", "split", "task", one("all").alias("n_chars"), one("shared").alias("shared_chars"), (F.col("shared") / F.col("all")).alias("overlap"))
