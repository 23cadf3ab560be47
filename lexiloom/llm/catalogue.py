"""All queries of this package with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import clean_source, label_key
from lexiloom.llm import contexts, leaks, lexicon, mixing, overlaps, packing, pages, runs, tokens
from lexiloom.llm.labels import language_names
from lexiloom.plans import oracles
from lexiloom.tables import corpus, cut, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    """Register ``run`` under its own name."""
    QUERIES[run.__name__] = run
    return run


_DOC_WORDS = f"words AS MATERIALIZED (SELECT doc_id, word, count(*) AS freq FROM (SELECT doc_id, unnest({oracles.WORDS_OF}) AS word FROM documents) GROUP BY ALL)"
_COUNTED = f"{oracles.encoded(_DOC_WORDS, 'doc_id, freq')}, counted AS MATERIALIZED (SELECT d.doc_id, coalesce(sum(freq * n_tok), 0)::BIGINT AS n_tokens FROM documents d LEFT JOIN enc USING (doc_id) GROUP BY d.doc_id)"
_NAMES = "names AS (SELECT lower(trim(k)) AS k, min(lang) AS name FROM (SELECT lang, unnest([lang, iso3, lang_name]) AS k FROM languages) WHERE k IS NOT NULL GROUP BY ALL)"
_KEY = "nullif(split_part(replace(lower(trim(lang)), '_', '-'), '-', 1), '')"


def _totals_sql(by: str, name: str) -> str:
    return f"SELECT {by} AS {name}, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens"


ORACLES["p2_document_tokens"] = f"{_COUNTED} SELECT doc_id, n_tokens FROM counted"
ORACLES["p2_totals_by_source"] = f"{_COUNTED} {_totals_sql(oracles.SOURCE, 'source')} FROM documents JOIN counted USING (doc_id) GROUP BY ALL"
ORACLES["p2_totals_by_domain"] = f"{_COUNTED} {_totals_sql('domain', 'domain')} FROM documents JOIN counted USING (doc_id) GROUP BY ALL"
ORACLES["p2_totals_by_lang"] = f"{_COUNTED}, {_NAMES} {_totals_sql('name', 'lang')} FROM (SELECT doc_id, {_KEY} AS k FROM documents) JOIN counted USING (doc_id) LEFT JOIN names USING (k) GROUP BY ALL"
ORACLES["p2_consumed_by_lang"] = (
    f"{_COUNTED}, log AS (SELECT arg_min({{'l': lang, 'd': doc_id}}, {{'r': received_at, 'g': logged_at}}) AS f FROM batch_docs WHERE read_id IS NOT NULL GROUP BY read_id) "
    "SELECT f.l AS lang, count(*) AS n_reads, count(DISTINCT f.d) AS n_docs, coalesce(sum(n_tokens), 0)::BIGINT AS n_tokens FROM log LEFT JOIN counted ON counted.doc_id = f.d GROUP BY ALL"
)


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """documents with n_tokens and cleaned source."""
    docs = corpus(spark, folder)
    counts = tokens.document_tokens(docs, table(spark, folder, "tok_merges"))
    facts = docs.select("doc_id", clean_source("source").alias("source"), "lang", "domain")
    return facts.join(counts, "doc_id")


@query
def p2_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document under the project's tokenizer."""
    return tokens.document_tokens(corpus(spark, folder), table(spark, folder, "tok_merges"))


@query
def p2_totals_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by source, names cleaned."""
    return tokens.totals(_counted(spark, folder), "source")


@query
def p2_totals_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by web site."""
    return tokens.totals(_counted(spark, folder), "domain")


@query
def p2_totals_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by the language that the label names, whatever its spelling."""
    named = _counted(spark, folder).withColumn("lang", label_key("lang"))
    known = language_names(table(spark, folder, "languages"))
    return tokens.totals(named.withColumnRenamed("lang", "key").join(F.broadcast(known), "key", "left"), "lang")


@query
def p2_consumed_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Reads, documents and tokens by Batch.lang of what the loader's log consumed; a repeated read_id counts once."""
    counts = tokens.document_tokens(corpus(spark, folder), table(spark, folder, "tok_merges"))
    log = table(spark, folder, "batch_docs").where("read_id is not null").groupBy("read_id").agg(F.min_by(F.struct("lang", "doc_id"), F.struct("received_at", "logged_at")).alias("first"))
    reads = log.select("first.lang", "first.doc_id").groupBy("lang", "doc_id").agg(F.count("*").alias("n"))
    joined = reads.join(counts, "doc_id", "left")
    return joined.groupBy("lang").agg(F.sum("n").alias("n_reads"), F.countDistinct("doc_id").alias("n_docs"), F.coalesce(F.sum(F.col("n") * F.col("n_tokens")), F.lit(0)).alias("n_tokens"))


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, list[runs.Run]]:
    docs = corpus(spark, folder)
    counts = tokens.document_tokens(docs, table(spark, folder, "tok_merges"))
    return cut(runs.sized_documents(docs, counts)), runs.read_runs(table(spark, folder, "pretrain_runs"))


@query
def p1_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The records chosen for each run, with repeat counts."""
    sized, configured = _sized(spark, folder)
    return mixing.mix(sized, configured)[0]


@query
def p1_source_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of each run."""
    sized, configured = _sized(spark, folder)
    mixed, rates = mixing.mix(sized, configured)
    return mixing.source_shares(cut(mixed), configured, rates)


_RUN_SOURCES = (
    "rs AS (SELECT *, w / nullif(sum(w) OVER (PARTITION BY run_id), 0) AS share FROM (SELECT run_id, source, CASE WHEN weights IS NULL THEN 1.0 ELSE greatest(0.0, coalesce(weights[source], 1.0)) END AS w, coalesce(max_repeats, 1) AS reps, coalesce(token_budget, 0) AS budget, "
    "context_size, min_doc_chars, max_doc_chars FROM (SELECT *, unnest(map_keys(sources)) AS source FROM pretrain_runs WHERE run_id IS NOT NULL))), "
    f"sized AS MATERIALIZED (SELECT {oracles.SOURCE} AS source, coalesce(length(text), 0) AS n_chars, n_tokens FROM documents JOIN counted USING (doc_id)), "
    "chosen AS MATERIALIZED (SELECT rs.*, n_tokens FROM rs JOIN sized USING (source) WHERE n_tokens > 0 AND n_chars >= coalesce(min_doc_chars, 0) AND n_chars <= coalesce(max_doc_chars, 2147483647))"
)
ORACLES["p1_invariants"] = (
    f"{_COUNTED}, {_RUN_SOURCES}, a AS (SELECT run_id, source, sum(n_tokens)::BIGINT AS tokens FROM chosen GROUP BY ALL) "
    "SELECT run_id, source, round(coalesce(share, 0) * budget, 3) AS target_tokens, coalesce(tokens, 0) AS available_tokens, round(CASE WHEN tokens > 0 THEN least(coalesce(share, 0) * budget / tokens, reps) ELSE 0.0 END, 9) AS times_read, "
    "TRUE AS within_target, TRUE AS within_one_document, TRUE AS within_repeats FROM rs LEFT JOIN a USING (run_id, source)"
)
ORACLES["p6_invariants"] = f"{_COUNTED}, {_RUN_SOURCES} SELECT run_id, sum((n_tokens - 1) // context_size + 1)::BIGINT AS n_pieces, sum(n_tokens)::BIGINT AS tokens, TRUE AS within_capacity, TRUE AS whole, TRUE AS numbered FROM chosen GROUP BY run_id"
ORACLES["p3_line_ends"] = (
    f"WITH l AS (SELECT doc_id, length(text)::INT AS n_code_points, regexp_replace(unnest(string_split(text, chr(10))), '[{oracles.WHITE}]+$', '') AS line FROM documents WHERE length(text) >= coalesce((SELECT min_doc_chars FROM pretrain_runs WHERE run_id = 1), 0)) "
    "SELECT doc_id, n_code_points, round(coalesce(avg((right(line, 1) IN ('.', '!', '?', '…', ':', ';', '।', '。', '！', '？', '”', '\"', '»', chr(39)))::INT) FILTER (line <> ''), 0), 9) AS line_end_punct FROM l GROUP BY ALL"
)


@query
def p1_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Target, available tokens and rate of each source of each run, and whether the mixture keeps its bounds: never beyond the target, less than one document below it, no document too often."""
    sized, configured = _sized(spark, folder)
    mixed, rates = mixing.mix(sized, configured)
    mixed = cut(mixed)
    largest = runs.documents_of_runs(sized, configured).groupBy("run_id", "source").agg(F.max("n_tokens").alias("largest"))
    most = spark.createDataFrame([(r.run_id, r.max_repeats) for r in configured], "run_id int, reps int")
    often = mixed.groupBy("run_id", "source").agg(F.max("n_copies").alias("often"))
    shares = mixing.source_shares(mixed, configured, rates).join(largest, ["run_id", "source"], "left").join(often, ["run_id", "source"], "left").join(most, "run_id")
    due = F.col("times_read") * F.col("available_tokens")
    return shares.select(
        "run_id", "source", F.round("target_tokens", 3).alias("target_tokens"), "available_tokens", F.round("times_read", 9).alias("times_read"), (F.col("actual_tokens") <= due + 1e-3).alias("within_target"),
        (F.col("actual_tokens") > due - F.coalesce("largest", F.lit(1)) - 1e-3).alias("within_one_document"), (F.coalesce("often", F.lit(0)) <= F.col("reps")).alias("within_repeats"),
    )


@query
def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces and tokens of each run, and whether its containers keep their bounds: none too full, each document whole or cut at the capacity, numbered from 0."""
    sized, configured = _sized(spark, folder)
    packed = cut(packing.pack(sized, configured))
    sizes = spark.createDataFrame([(r.run_id, r.context_size) for r in configured], "run_id int, capacity int")
    bins = packed.groupBy("run_id", "container").agg(F.sum("n_tokens").alias("held"), F.max("fill_tokens").alias("fill"))
    bins = bins.join(F.broadcast(sizes), "run_id").groupBy("run_id").agg(F.bool_and(F.expr("held <= capacity and held = fill")).alias("within_capacity"), (F.max("container") + 1 == F.count("*")).alias("numbered"))
    docs = packed.groupBy("run_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n")).join(F.broadcast(sizes), "run_id").join(sized.select("doc_id", F.col("n_tokens").alias("size")), "doc_id")
    docs = docs.groupBy("run_id").agg(F.sum("pieces").alias("n_pieces"), F.sum("n").alias("tokens"), F.bool_and(F.expr("n = size and pieces = (n - 1) div capacity + 1")).alias("whole"))
    return docs.join(bins, "run_id").select("run_id", "n_pieces", "tokens", "within_capacity", "whole", "numbered")


@query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document or piece of each run, and its fill."""
    return packing.pack(*_sized(spark, folder))


@query
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and share of filled space of each run."""
    sized, configured = _sized(spark, folder)
    return packing.fill_report(packing.pack(sized, configured), configured)


def _models(spark: SparkSession, folder: str) -> tuple[lexicon.Lexicon, dict[str, list[str]], dict[str, list[str]]]:
    """The lexicon, labelled texts and word lists."""
    listed = lexicon.listed_words(table(spark, folder, "common_words"))
    words = lexicon.read_lexicon(listed, table(spark, folder, "languages"))
    return words, lexicon.labelled_texts(*(table(spark, folder, t) for t in ("heldout_items", "std_items", "parallel_items"))), listed


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    words, texts, _ = _models(spark, folder)
    return cut(pages.profile_documents(corpus(spark, folder), words, pages.prose_profiles(texts, words)))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of at least min_doc_chars of run 1 of which less than half is prose, keyword pages included."""
    least = next((r.min_doc_chars for r in runs.read_runs(table(spark, folder, "pretrain_runs")) if r.run_id == 1), None) or 0
    profiles = _profiles(spark, folder)
    spam = pages.keyword_pages(profiles).where("is_keyword_page").select("doc_id", F.lit(True).alias("spam"))
    long_ones = profiles.where(F.col("n_code_points") >= least).join(spam, "doc_id", "left")
    return long_ones.where("spam or 2 * prose_chars < n_chars_dense or n_chars_dense = 0").select("doc_id").distinct()


@query
def p3_text_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, ratios and the nearest structural profile of each document of at least min_doc_chars of run 1."""
    least = next((r.min_doc_chars for r in runs.read_runs(table(spark, folder, "pretrain_runs")) if r.run_id == 1), None) or 0
    return _profiles(spark, folder).where(F.col("n_code_points") >= least).drop("spectrum", "held", "words_lang", "n_marks")


@query
def p3_line_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Length and share of lines that end in punctuation of each document of at least min_doc_chars of run 1."""
    return p3_text_statistics(spark, folder).select("doc_id", "n_code_points", F.round("line_end_punct", 9).alias("line_end_punct"))


@query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are mostly repeated keywords, links, hashtags or product labels."""
    return pages.keyword_pages(_profiles(spark, folder)).where("is_keyword_page").select("doc_id").distinct()


@query
def p8_rank_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """The rank-frequency curve and keyword share of each document with text."""
    return pages.keyword_pages(_profiles(spark, folder))


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.find_leaks(corpus(spark, folder), table(spark, folder, "heldout_items"))


@query
def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with the number of documents that hold a passage of it."""
    items = table(spark, folder, "heldout_items")
    found = leaks.find_leaks(corpus(spark, folder), items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "task", "lang", "split").distinct().join(found, "item_id")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The three evaluation tables under one schema."""
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("tab"), "rec_id", "split", "task", F.col(text).alias("text"))
        for name, text in (("std_items", "question"), ("parallel_items", "question"), ("xlsum_items", "text"))
    ]
    return spread(parts[0].unionByName(parts[1]).unionByName(parts[2]), "rec_id")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training record and a record of another split with the same text, exactly or nearly."""
    pairs = overlaps.cross_split_pairs(_records(spark, folder))
    return pairs.select(F.least("id_train", "id_eval").alias("id_a"), F.greatest("id_train", "id_eval").alias("id_b")).distinct()


@query
def p4_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping records and pairs by table, split and task, with their mean overlap fraction."""
    return overlaps.reports(*overlaps.cross_split_classes(_records(spark, folder)))


@query
def p4_record_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each evaluation record that stands in the training split, by content-defined chunks."""
    return overlaps.chunk_overlaps(_records(spark, folder))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with the languages of prose, its labels and whether the document is a keyword page."""
    words, texts, listed = _models(spark, folder)
    trees = contexts.ContextTrees(texts, listed, words.langs)
    docs = corpus(spark, folder)
    profiles = cut(pages.profile_documents(docs, words, pages.prose_profiles(texts, words), trees))
    spam = pages.keyword_pages(profiles).where("is_keyword_page").select("doc_id", F.lit(True).alias("is_keyword_page"))
    labels = docs.select("doc_id", label_key("lang").alias("key")).join(F.broadcast(language_names(table(spark, folder, "languages"))), "key", "left")
    found = profiles.select("doc_id", "n_code_points", F.expr("n_chars_dense > 0 and 2 * prose_chars >= n_chars_dense").alias("is_prose"), "main_lang", "confidence", "line_langs").join(labels.select("doc_id", F.col("lang").alias("label")), "doc_id")
    return found.join(spam, "doc_id", "left").withColumn("is_keyword_page", F.coalesce("is_keyword_page", F.lit(False)))


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Prose whose label is missing or wrong or that mixes languages: its main language (line 0) and, if mixed, those of its lines."""
    prose = _languages(spark, folder).where("is_prose and main_lang is not null and n_code_points >= 20 and not is_keyword_page")
    prose = prose.withColumn("mixed", F.exists("line_langs", lambda x: x["lang"] != F.col("main_lang")))
    cases = prose.where("mixed or label is null or label != main_lang")
    rows = F.concat(F.array(F.struct(F.lit(0).alias("line_no"), F.col("main_lang").alias("lang"))), F.when(F.col("mixed"), F.col("line_langs")).otherwise(F.array().cast("array<struct<line_no: int, lang: string>>")))
    return cases.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.line_no", "x.lang").distinct()


@query
def p5_document_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The main language of each document with confidence, beside the language its label names; null where a text has no words."""
    return _languages(spark, folder).select("doc_id", "label", "is_prose", "main_lang", "confidence", F.array_size(F.array_distinct(F.transform("line_langs", lambda x: x["lang"]))).alias("n_langs"))
