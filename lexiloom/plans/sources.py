"""Queries of sources and sinks: the test tables are written in the formats that readers expect and read back."""

from __future__ import annotations

import json
import uuid

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import bpe, modular, unigram, words
from lexiloom.plans import oracles as O
from lexiloom.plans.catalogue import _EM, _LISTS, _docs, _merges, _model, _nsl_sql, _piece_list, _round_sql, _sentences, _word_lists
from lexiloom.plans.loader import ids_sql
from lexiloom.plans.registry import query
from lexiloom.sources import files, models, sinks, tasks, text
from lexiloom.tables import cut, shared_folder, table


def _scratch(spark: SparkSession) -> str:
    """A new folder among the intermediate results."""
    return f"{shared_folder(spark)}/sources/{uuid.uuid4().hex}"


def _shown(array: str) -> Column:
    """An array of strings as one string, so that results compare on every engine."""
    return F.array_join(F.transform(array, lambda c: F.coalesce(c, F.lit("-"))), "|")


# Text and JSON lines


def _corpus_files(spark: SparkSession, folder: str) -> str:
    """Evaluation texts (a fixed table) as files of all four kinds, by item_id: two plain and two of JSON lines, of each one compressed; blank lines between."""
    path = _scratch(spark)
    kinds: dict[int, list[str]] = {k: [] for k in range(4)}
    for r in table(spark, folder, "heldout_items").select("item_id", "text").orderBy("item_id").collect():
        value = " ".join((r.text or "").split())
        kinds[r.item_id % 4] += [value if r.item_id % 4 < 2 else json.dumps({"id": r.item_id, "text": value}, ensure_ascii=False), ""]
    for k, name in enumerate(("a.txt", "b.txt.zst", "c.jsonl", "d.jsonl.zst")):
        data = "\n".join(kinds[k]).encode("utf-8")
        files.write_bytes(spark, f"{path}/{name}", zstandard.compress(data) if name.endswith(".zst") else data)
    return path


_FILES = f"f AS (SELECT item_id % 4 AS kind, 2 * (row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) - 1) AS line_id, trim(regexp_replace(coalesce(text, ''), '[{O.WHITE}]+', ' ', 'g')) AS value FROM heldout_items)"


@query(f"WITH {_FILES} SELECT (CASE kind WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END)::INT AS file_id, count(*) - 1 + count(*) FILTER (kind < 2 AND value = '') AS n_blank, count(*) FILTER (kind >= 2 OR value <> '') AS n_lines, sum(line_id) FILTER (kind >= 2 OR value <> '')::BIGINT AS places FROM f GROUP BY kind")
def source_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and blank lines of each file of a source, plain files first, with the sum of the places of lines that aren't blank."""
    lines = text.raw_lines(spark, _corpus_files(spark, folder), plain_first=True)
    full = F.col("value") != ""
    sums = lines.groupBy("file_id").agg(F.count(F.when(~full, 1)).alias("n_blank"), F.count(F.when(full, 1)).alias("n_lines"), F.sum(F.when(full, F.col("line_id"))).alias("places"))
    return sums.select("file_id", "n_blank", "n_lines", "places")


@query(f"WITH {_FILES} SELECT (kind)::INT AS file_id, line_id, value AS text FROM f WHERE kind < 2 AND value <> ''")
def source_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the plain files of a source, one a line that isn't blank."""
    path = _corpus_files(spark, folder)
    parts = [text.documents(spark, f"{path}/{name}").withColumn("file_id", F.lit(k)) for k, name in enumerate(("a.txt", "b.txt.zst"))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_FILES} SELECT (kind - 2)::INT AS file_id, line_id, value AS text FROM f WHERE kind >= 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY line_id) <= 20")
def source_first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 documents of each file of JSON lines."""
    path = _corpus_files(spark, folder)
    parts = [text.documents(spark, f"{path}/{name}", "text", max_docs=20).withColumn("file_id", F.lit(k)) for k, name in enumerate(("c.jsonl", "d.jsonl.zst"))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_FILES} SELECT kind::INT AS file_id, line_id, value AS text FROM f WHERE kind >= 2 OR value <> ''")
def pretraining_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a mixed source, its format by the file's name."""
    return text.pretraining_documents(spark, _corpus_files(spark, folder))


@query("SELECT DISTINCT trim(word) AS piece FROM common_words WHERE trim(word) <> ''")
def vocabulary_file(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of a vocabulary file with surrounding blanks and empty lines."""
    path = _scratch(spark)
    listed = table(spark, folder, "common_words").select(F.explode(F.array(F.concat(F.lit("  "), F.trim("word"), F.lit(" ")), F.lit(""))).alias("value")).where("value is not null").distinct()
    listed.write.text(path)
    return text.vocabulary_file(spark, path)


# Evaluation tasks


def _std(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "std_items")


def _json(df: DataFrame) -> str:
    path = _scratch(df.sparkSession)
    df.write.option("ignoreNullFields", "true").json(path)
    return path


def _choices_shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("choices", _shown("choices"))


_LISTED = "array_to_string(list_transform(choices{0}, lambda c: coalesce(c, '-')), '|') AS choices"


@query(f"SELECT question, {_LISTED.format('')}, answer AS gold, context FROM std_items")
def task_multiple_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with choices from JSON lines."""
    path = _json(_std(spark, folder).select("question", "choices", "answer", "context"))
    return _choices_shown(tasks.multiple_choice(spark, path))


@query(f"SELECT question, {_LISTED.format('')}, answer AS gold, NULL::VARCHAR AS context FROM std_items WHERE answer BETWEEN 0 AND len(choices) - 1")
def task_labelled_choices(spark: SparkSession, folder: str) -> DataFrame:
    """The same from nested lines with a stem, labelled choices and the label of the answer; a key that is no label drops the question."""
    labelled = F.transform("choices", lambda c, k: F.struct(F.substring(F.lit("ABCDEFGHIJ"), k + 1, F.lit(1)).alias("label"), c.alias("text")))
    key = F.substring(F.lit("ABCDEFGHIJ"), F.col("answer") + 1, F.lit(1))
    path = _json(_std(spark, folder).where("choices is not null and answer is not null").select(F.struct(F.col("question").alias("stem"), labelled.alias("choices")).alias("question"), key.alias("answerKey")))
    return _choices_shown(tasks.labelled_choices(spark, path))


@query(f"SELECT CASE WHEN task IS NULL THEN '' ELSE task || ': ' END || question AS question, {_LISTED.format('')}, answer AS gold, NULL::VARCHAR AS context FROM std_items")
def task_endings(spark: SparkSession, folder: str) -> DataFrame:
    """The same from contexts with endings, the activity's label in front."""
    path = _json(_std(spark, folder).select(F.col("question").alias("ctx"), F.col("choices").alias("endings"), F.col("answer").cast("string").alias("label"), F.col("task").alias("activity_label")))
    return _choices_shown(tasks.endings(spark, path))


@query(f"SELECT question, {_LISTED.format('[1:2]')}, answer AS gold, NULL::VARCHAR AS context FROM std_items")
def task_two_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The same from two contexts with one end."""
    path = _json(_std(spark, folder).select(F.slice("choices", 1, 2).alias("ctx"), F.col("question").alias("end"), F.col("answer").alias("label")))
    return _choices_shown(tasks.two_contexts(spark, path))


@query(
    "SELECT DISTINCT task AS topic, regexp_replace(question, '\\r\\n?', chr(10), 'g') AS question, array_to_string([coalesce(choices[1], '-'), coalesce(choices[2], '-'), coalesce(choices[3], '-'), coalesce(choices[4], '-')], '|') AS choices, answer AS gold FROM std_items "
    "WHERE split = 'val' AND question <> '' AND answer BETWEEN 0 AND 7 AND task IS NOT NULL AND NOT list_contains(coalesce(choices, []), '')"
)
def task_topic_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a tree of CSV files, one for each topic and split, with the answer as a letter."""
    path = _scratch(spark)
    rows = _std(spark, folder).where("split = 'val' and question != '' and answer between 0 and 7 and task is not null and not array_contains(coalesce(choices, array()), '')").distinct()
    columns = [F.regexp_replace("question", "\\r\\n?", "\n").alias("question"), *(F.get("choices", F.lit(k)).alias(f"c{k}") for k in range(4)), F.substring(F.lit(tasks.LETTERS), F.col("answer") + 1, F.lit(1)).alias("letter")]
    for r in rows.select("task").distinct().collect():
        mine = rows.where(F.col("task") == r.task).select(*columns)
        files.write_single(mine, f"{path}/val/{r.task}_val.csv", "csv", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    return _choices_shown(tasks.topic_csv(spark, path, "val")).distinct()


_PARALLEL = "p AS (SELECT row_number() OVER (ORDER BY rec_id, question, answer) - 1 AS line_id, coalesce(question, '') AS q, list_filter(answer, lambda a: a IS NOT NULL) AS a FROM parallel_items WHERE rec_id IS NOT NULL)"


def _parallel(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, question, answer) of JSON lines in one file, in order of rec_id."""
    path = f"{_scratch(spark)}/lines.jsonl"
    rows = table(spark, folder, "parallel_items").where("rec_id is not null").orderBy("rec_id", "question", "answer")
    rows = rows.select(F.coalesce("question", F.lit("")).alias("question"), F.coalesce(F.filter("answer", lambda a: a.isNotNull()), F.array().cast("array<string>")).alias("answer"))
    files.write_single(rows.select(F.to_json(F.struct("question", "answer")).alias("value")), path)
    parsed = F.from_json("value", "question string, answer array<string>", {"mode": "FAILFAST"})
    return text.raw_lines(spark, path).select("line_id", parsed.alias("x")).select("line_id", "x.question", "x.answer")


@query(f"WITH {_PARALLEL} SELECT line_id, q AS question, coalesce(array_to_string(a, '|'), '') AS answer FROM p")
def task_parallel(spark: SparkSession, folder: str) -> DataFrame:
    """Parallel text by line."""
    return tasks.parallel(_parallel(spark, folder)).withColumn("answer", _shown("answer"))


@query(f"WITH {_PARALLEL} SELECT line_id, a[1] AS question, q AS answer FROM p")
def task_parallel_reversed(spark: SparkSession, folder: str) -> DataFrame:
    """The same with questions and answers swapped."""
    return tasks.parallel(_parallel(spark, folder), reverse=True).withColumn("answer", _shown("answer"))


@query(f"WITH {_PARALLEL} SELECT line_id, a[1] AS question, coalesce(array_to_string(list_transform(a, lambda x: x || '!'), '|'), '') AS answer FROM p WHERE line_id < (SELECT count(*) - 5 FROM p)")
def task_parallel_zipped(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of two files paired by line, up to the end of the shorter one."""
    left = cut(_parallel(spark, folder))
    right = left.where(F.col("line_id") < left.count() - 5).withColumn("answer", F.transform("answer", lambda a: F.concat(a, F.lit("!"))))
    return tasks.parallel(left, right).withColumn("answer", _shown("answer"))


@query("SELECT concat_ws(chr(10), title, text) AS source, summary FROM xlsum_items")
def task_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with their titles in front, and summaries, from JSON lines."""
    path = _json(table(spark, folder, "xlsum_items").select(F.col("title").alias("headline"), F.col("text").alias("body"), F.col("summary").alias("abstract")))
    return tasks.summaries(spark, path, "body", "abstract", "headline")


# Tokenizer folders


def _bpe_folder(spark: SparkSession, folder: str) -> str:
    path = _scratch(spark)
    lists = _word_lists(spark, folder).join(table(spark, folder, "tok_vocab").select("piece", "token_id"), "piece").select("lang", "token_id").distinct()
    ids: dict[str, list[int]] = {}
    for r in lists.orderBy("lang", "token_id").collect():
        ids.setdefault(r.lang, []).append(r.token_id)
    models.write_bpe(spark, _model(spark, folder), ids, path)
    return path


@query("SELECT 'bpe' AS kind, token_id, piece FROM tok_vocab")
def model_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of a tokenizer folder, whose kind is found in its file."""
    loaded = models.load_model(spark, _bpe_folder(spark, folder))
    return loaded.table(spark).select(F.lit(loaded.kind).alias("kind"), "token_id", "piece")


@query("SELECT (row_number() OVER (ORDER BY merge_no) - 1)::INT AS merge_no, a, b FROM tok_merges")
def model_merges(spark: SparkSession, folder: str) -> DataFrame:
    """The merges of a tokenizer folder."""
    loaded = models.load_model(spark, models.global_path(_bpe_folder(spark, folder)))
    return spark.createDataFrame([(k, *m) for k, m in enumerate(loaded.bpe.merges)], "merge_no int, a string, b string")


@query("SELECT unnest(['duplicate_id', 'duplicate_piece', 'id_out_of_range', 'language_id_unknown', 'merge_not_buildable', 'extracted_unknown', 'extracted_size']) AS rule, unnest([0, 0, 0, 0, 0, 1, 1])::BIGINT AS n")
def model_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that a tokenizer folder breaks into which a subtokenizer was put that has a strange token."""
    path = _bpe_folder(spark, folder)
    files.write_json(spark, {"model": {"type": "BPE", "vocab": {"<strange>": 0}, "merges": []}}, models.extracted_path(path, "en"))
    return models.faults(spark, path)


_OWN = "own AS (SELECT lang, piece, own_id - 1 AS own_id, -1.0 - own_id / 8.0 AS score, position FROM lists)"


def _monolingual(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """(folders, languages): the word list of each language as a unigram model."""
    path = _scratch(spark)
    own: dict[str, list[tuple[int, str]]] = {}
    for r in _word_lists(spark, folder).orderBy("lang", "own_id").collect():
        own.setdefault(r.lang, []).append((r.own_id, r.piece))
    for lang, pieces in own.items():
        models.write_unigram(spark, [(p, -1.0 - k / 8.0) for k, p in pieces], {lang: range(len(pieces))}, f"{path}/{lang}")
    return [f"{path}/{x}" for x in sorted(own)], sorted(own)


@query(f"WITH {_LISTS}, {_OWN}, m AS (SELECT piece, score, (row_number() OVER (ORDER BY position, own_id) - 1)::INT AS token_id FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY position, own_id) AS k FROM own) WHERE k = 1) SELECT token_id, piece, score::DOUBLE AS score FROM m")
def merged_models(spark: SparkSession, folder: str) -> DataFrame:
    """The union of monolingual unigram models, merged from their files; the first model that has a piece gives its score."""
    return models.merge_unigram(spark, *_monolingual(spark, folder), _scratch(spark)).table(spark)


@query(
    f"WITH {_LISTS}, {_OWN}, m AS (SELECT piece, (row_number() OVER (ORDER BY position, own_id) - 1)::INT AS token_id FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY position, own_id) AS k FROM own) WHERE k = 1) "
    "SELECT lang, own_id::INT AS own_id, token_id FROM own JOIN m USING (piece)"
)
def merged_model_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids in the merged model of each monolingual model's pieces."""
    merged = models.merge_unigram(spark, *_monolingual(spark, folder), _scratch(spark))
    return spark.createDataFrame([(x, k, i) for x, ids in merged.lang_ids.items() for k, i in enumerate(ids)], "lang string, own_id int, token_id int")


@query()
def step_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a sequential training over questions of all languages leaves, with the kind of model and the size of each."""
    path = _scratch(spark)
    items = cut(_std(spark, folder).where("lang is not null").select("lang", "rec_id", F.col("question").alias("text")).distinct())
    langs = sorted(r.lang for r in items.select("lang").distinct().collect())
    steps = bpe.train_sequential([(x, items.where(F.col("lang") == x)) for x in langs], len(bpe.base_vocabulary()) + 24, 12, max_sentences=500, order=("rec_id",))
    models.write_steps(spark, steps, path)
    models.check(spark, path)
    rows = [("global", len(models.load_model(spark, path).pieces))]
    for k, x in enumerate(langs):
        rows += [(f"{name}/{x}", len(models.load_model(spark, f"{path}/{name}/step_{k}_{x}").pieces)) for name in ("sequential", "extracted")]
        rows += [(f"added/{x}", len(files.read_json(spark, f"{path}/added/step_{k}_{x}/merges.json")))] if k else []
    return spark.createDataFrame(rows, "name string, size int")


# Results


@query(_nsl_sql())
def nsl_file(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized sequence lengths by language, written as one JSON object and read back."""
    merges, path = _merges(spark, folder), f"{_scratch(spark)}/nsl.json"
    sinks.write_nsl(bpe.nsl(words.word_frequencies(_docs(spark, folder).where("lang is not null"), "lang"), merges, merges[:1000], "lang"), path)
    rows = [(x, r["n_tokens"], r["n_tokens_ref"], r["nsl"]) for x, r in files.read_json(spark, path).items()]
    return spark.createDataFrame(rows, "lang string, n_tokens long, n_tokens_ref long, nsl double")


@query("SELECT 'r' || k AS run, run_id, count(*) AS n, round(avg(c_bpb), 9) AS mean FROM batch_docs, (VALUES (1), (2)) v(k) WHERE run_id IS NOT NULL GROUP BY ALL")
def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of two runs appended to one log of JSON lines and read back."""
    path = _scratch(spark)
    means = cut(table(spark, folder, "batch_docs").where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("c_bpb"), 9).alias("mean")))
    for k in (1, 2):
        sinks.append_metrics(means, {"run": f"r{k}"}, path)
    return spark.read.schema("run string, run_id int, n long, mean double").json(path)


@query(f"{_EM}, {_round_sql(0)}, {_round_sql(1)} SELECT 0 AS iter, count(*) AS n, round(sum(p), 3) AS total FROM p1 UNION ALL SELECT 1, count(*), round(sum(p), 3) FROM p2")
def round_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of two rounds of re-estimation, each written as a partition of its own and read back."""
    path, sentences = _scratch(spark), _sentences(spark, folder)
    pieces = _piece_list(sentences, _word_lists(spark, folder))
    for k in (0, 1):
        sinks.write_scores(unigram.fit(sentences, pieces, k + 1, 0.0)[0], k, spark, path)
    return spark.read.parquet(path).groupBy("iter").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))


@query(
    f"{_EM}, {_round_sql(0)} SELECT token_id, piece, CASE WHEN is_special OR regexp_matches(piece, '^<0x[0-9A-Fa-f]{{2}}>$') OR regexp_matches(piece, '^<unused[0-9]+>$') THEN 0.0 ELSE round(coalesce(p, -token_id / 100.0), 6) END::DOUBLE AS score FROM "
    "(SELECT token_id, piece, is_special FROM tok_vocab UNION ALL SELECT 100000 + k, '<unused' || k || '>', FALSE FROM range(3) t(k)) LEFT JOIN p1 USING (piece)"
)
def applied_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A scored vocabulary with the scores of one round; special, byte and reserved pieces keep theirs, as do pieces that the round lacks."""
    sentences = _sentences(spark, folder)
    logp, _ = unigram.fit(sentences, _piece_list(sentences, _word_lists(spark, folder)), 1)
    new = spark.createDataFrame(list(logp.items()), "piece string, score double")
    reserved = spark.createDataFrame([(100_000 + k, f"<unused{k}>", False) for k in range(3)], "token_id int, piece string, is_special boolean")
    old = table(spark, folder, "tok_vocab").select("token_id", "piece", "is_special").unionByName(reserved)
    from lexiloom.operators.vocab import is_special

    old = old.withColumn("score", F.when(is_special("piece", unused=True) | F.col("is_special"), F.lit(0.0)).otherwise(-F.col("token_id") / 100.0))
    return unigram.apply_scores(old, new).withColumn("score", F.round("score", 6))


_EVERY = 250


@query(
    f"{ids_sql('SELECT doc_id, text FROM documents')}, pl AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // {_EVERY} AS part FROM ids), sn AS (SELECT part AS snapshot, sum(count(*)) OVER (ORDER BY part)::BIGINT AS docs FROM pl GROUP BY part), "
    "c AS (SELECT part, token_id, count(*) AS n FROM (SELECT part, unnest(ids) AS token_id FROM pl) GROUP BY ALL) SELECT snapshot::BIGINT AS snapshot, docs, token_id, sum(n)::BIGINT AS n FROM sn JOIN c ON part <= snapshot GROUP BY ALL"
)
def count_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of tokens after each 250 documents and at the end."""
    tokens = modular.ModularTokenizer(_model(spark, folder), {}).encode(_docs(spark, folder), bos=False, eos=False)
    each = tokens.select("doc_id", F.explode_outer("tokens").alias("token_id")).groupBy("doc_id", "token_id").agg(F.count("*").alias("n"))
    return sinks.count_snapshots(cut(each), _EVERY)


# Commands


@query(f"{O.bpe_merges(16)} " + " UNION ALL ".join(f'SELECT {k} AS merge_no, "left" AS a, "right" AS b FROM m{k}' for k in range(16)))
def command_train_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The first merges that the training command finds in all documents, written as JSON lines, with its settings in a file."""
    path = _json(_docs(spark, folder).select("text").where("text is not null"))
    cli.run(spark, "train-bpe", [f"input_path={path}", f"output_dir={path}-model", "text_field=text", f"vocab_size={len(bpe.base_vocabulary()) + 16}"])
    return spark.createDataFrame([(k, *m) for k, m in enumerate(models.load_model(spark, f"{path}-model").bpe.merges)], "merge_no int, a string, b string")


@query(
    f"{O.encoded(O.ALL_WORDS, 'freq')}, c AS (SELECT piece, sum(freq)::BIGINT AS n FROM (SELECT freq, unnest(string_split(done[2:-2], chr(2) || chr(1))) AS piece FROM enc) GROUP BY piece) "
    "SELECT 'all' AS lang, token_id, piece, coalesce(n, 0) AS n FROM tok_vocab LEFT JOIN c USING (piece)"
)
def command_count(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of tokens that the counting command writes for all documents."""
    path = _json(_docs(spark, folder).select("text").where("text is not null"))
    return cli.run(spark, "count", [f"input_path={path}", f"model_path={_bpe_folder(spark, folder)}", f"output_dir={path}-counts", "lang=all", "text_field=text"])
