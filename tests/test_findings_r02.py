"""Findings of round 2: queries against their SQL over small tables with odd rows."""

import math
import random
import string
from pathlib import Path

import duckdb
import pytest

from lexiloom.operators import reports as R
from lexiloom.operators import scoring
from lexiloom.plans import queries as core
from lexiloom.sources import files
from lexiloom.tables import shared_folder
from tests.conftest import rows


def by_sql(name, folder, *tables):
    """Rows of a query's SQL over the tables of a folder, sorted."""
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(db.sql(core.ORACLES[name]).fetchall(), key=repr)


@pytest.mark.parametrize("steps", [[], [None], [7, None, 7, 120, 3], [-4, 0, 10]])
def test_checkpoint_steps(spark, tmp_path, steps):
    spark.createDataFrame([(s,) for s in steps], "step long").write.parquet(f"{tmp_path}/batch_docs.parquet")
    assert rows(core.QUERIES["checkpoint_steps"](spark, str(tmp_path))) == by_sql("checkpoint_steps", tmp_path, "batch_docs")


def test_checkpoint_steps_writes_no_files(spark, tmp_path):
    kept = lambda: set(Path(shared_folder(spark).removeprefix("file:")).glob("steps/*/*"))
    before = kept()
    spark.range(300).withColumnRenamed("id", "step").write.parquet(f"{tmp_path}/batch_docs.parquet")
    assert rows(core.QUERIES["checkpoint_steps"](spark, str(tmp_path))) == [(299, 0, 300)] and kept() == before


def test_step_range_is_what_a_listing_gives(spark, tmp_path):
    log = spark.createDataFrame([(30,), (5,), (30,), (100,)], "step long")
    for name in ("30", "5", "100", "args.json"):
        files.write_bytes(spark, f"{tmp_path}/run/{name}", b"")
    found = R.listed_steps([f.rsplit("/", 1)[1] for f in files.files_in(spark, f"{tmp_path}/run")])
    assert found == [5, 30, 100] and rows(R.step_range(log)) == [(found[-1], found[0], len(found))]


ITEMS = "rec_id long, task string, question string, choices array<string>, answer int, context string"
#: Repeated rows, different rows of one id, an id in two tasks and none, ties, empty and absent parts, words that no document has.
ODD = [
    (1, "std_yesno", "Is the cat big?", ["yes", "no"], 0, "The cat\nsat."),
    (1, "std_yesno", "Is the cat big?", ["yes", "no"], 0, "The cat\nsat."),
    (1, "std_yesno", "Is the cat small?", ["no", "the cat", "yes"], 0, None),
    (1, "std_science", "Where is the cat?", ["on the mat", "zyx wvu", ""], 2, None),
    (2, "std_science", None, ["the the", "the the"], 1, "unheard words of the zyx zyx"),
    (3, "std_other", "The end", ["cat", "mat", "zyx"], None, ""),
    (4, "std_other", "no choices", [], 0, None),
    (5, "std_other", "none", None, 0, "the"),
    (None, "std_yesno", "lost", ["a", "b"], 0, None),
    (6, None, "a  b\tc 12 3.5!", ["1", " 2 ", "猫 12"], 2, "x\n\ny"),
]
TEXTS = ["The cat sat on the mat.", "the cat, the mat 12 times\n", None, "", "Is the big cat on a mat? yes no yes", "Answer: yes, the end"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ODD, ITEMS).write.parquet(f"{folder}/std_items.parquet")
    return folder


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Folder of questions with long contexts of words that the documents have; (folder, bytes of text)."""
    folder, rng = tmp_path_factory.mktemp("wide"), random.Random(7)
    words = ["".join(rng.choices(string.ascii_lowercase, k=8)) for _ in range(2000)]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    items = [(k, ("std_science", "std_other")[k % 2], "which", rng.sample(words, 4), k % 4, " ".join(rng.sample(words, 1000))) for k in range(30)]
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/std_items.parquet")
    return folder, sum(len(x[-1]) for x in items)


def shuffled(spark, name, folder):
    """Sorted rows of a query and the bytes that it wrote for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    found = rows(core.QUERIES[name](spark, str(folder)))
    return found, written() - before


def check_choices(spark, name, odd, wide):
    """A query of choices agrees with SQL on odd rows and over long texts, and shuffles less than two times the text."""
    assert rows(core.QUERIES[name](spark, str(odd))) == by_sql(name, odd, "documents", "std_items")
    folder, size = wide
    found, bytes_written = shuffled(spark, name, folder)
    assert found == by_sql(name, folder, "documents", "std_items") and bytes_written < 2 * size


def test_mcq_by_task(spark, odd, wide):
    check_choices(spark, "mcq_by_task", odd, wide)


def test_words_are_scored_alike_near_and_far(spark):
    """However many words are broadcast, and which, costs are the same."""
    model = spark.createDataFrame([("a", 40), (" b", 3), (" c", 3), (" d", 1)], "word string, freq long")
    texts = spark.createDataFrame([(1, "a b c b zz"), (2, ""), (3, None), (4, "zz zz zz"), (5, "a"), (6, "a b c b zz")], "key long, text string")
    found = [rows(scoring.word_scorer(model, common, head)(texts)) for common, head in (((), 100), ((), 0), ((), 2), (("zz", " zz", " d"), 2))]
    total = math.log(51)
    cost = lambda *freq: sum(round(1e6 * (total - math.log(f + 1))) for f in freq)
    first = cost(40, 3, 3, 3, 0)
    assert found == [[(1, first), (2, 0), (3, 0), (4, 3 * cost(0)), (5, cost(40)), (6, first)]] * 4


def test_choice_scores(spark, odd, wide):
    check_choices(spark, "choice_scores", odd, wide)


def test_letter_accuracy(spark, odd, wide):
    check_choices(spark, "letter_accuracy", odd, wide)


def test_mcq_macro(spark, odd, wide):
    check_choices(spark, "mcq_macro", odd, wide)


def test_mcq_accuracy(spark, odd, wide):
    # The id that two tasks share counts in both.
    check_choices(spark, "mcq_accuracy", odd, wide)
