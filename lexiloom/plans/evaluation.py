"""Queries of metrics over evaluation tables; titles stand for outputs and summaries for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import metrics, prompts, scoring, words
from lexiloom.plans import oracles as O
from lexiloom.plans.catalogue import _TASK, _XL, _docs, _titles_and_summaries
from lexiloom.plans.registry import query
from lexiloom.tables import cut, table

# BLEU


def _bleu_sql(n: int, by: str = "") -> str:
    gram = f"unnest(CASE WHEN len({{0}}) < {n} THEN [] ELSE list_transform(range(1, len({{0}}) - {n} + 2), lambda i: array_to_string({{0}}[i:i + {n - 1}], ' ')) END)"
    count = f"SELECT {by}id, g, count(*) AS n FROM (SELECT {by}id, {{1}} AS g FROM w) GROUP BY ALL"
    keys = "a.id = b.id AND a.g = b.g"
    group = f"GROUP BY a.{by.rstrip(', ')}" if by else ""
    return (
        f"SELECT {'a.' + by if by else ''}{n} AS n, coalesce(sum(least(a.n, coalesce(b.n, 0))), 0)::BIGINT AS matched, coalesce(sum(a.n), 0)::BIGINT AS total FROM ({count.format(0, gram.format('h'))}) a "
        f"LEFT JOIN ({count.format(0, gram.format('r'))}) b ON {keys} {group}"
    )


_BLEU = f"WITH {_XL}, w AS MATERIALIZED (SELECT id, {O.bleu_words('title')} AS h, {O.bleu_words('summary')} AS r FROM (SELECT id, coalesce(title, '') AS title, coalesce(summary, '') AS summary FROM x))"
_SMOOTHED = "CASE WHEN matched > 0 THEN ln(matched / total) ELSE -ln(pow(2, sum((matched = 0)::INT) OVER ({0}ORDER BY n)) * total) END"


@query(f"{_BLEU} " + " UNION ALL ".join(_bleu_sql(n) for n in range(1, 5)))
def bleu_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Clipped matches of n-grams of titles in summaries."""
    return metrics.bleu_counts(_titles_and_summaries(spark, folder))


@query(
    f"{_BLEU}, c AS ({' UNION ALL '.join(_bleu_sql(n) for n in range(1, 5))}), s AS (SELECT *, {_SMOOTHED.format('')} AS x FROM c), l AS (SELECT coalesce(sum(len(h)), 0)::BIGINT AS hyp_len, coalesce(sum(len(r)), 0)::BIGINT AS ref_len FROM w) "
    "SELECT hyp_len, ref_len, round(CASE WHEN (SELECT max(matched) > 0 AND min(total) > 0 FROM c) THEN 100 * exp((SELECT avg(x) FROM s) + CASE WHEN hyp_len >= ref_len THEN 0 ELSE 1 - ref_len / hyp_len END) ELSE 0.0 END, 9) AS bleu FROM l"
)
def corpus_bleu(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU of titles against summaries."""
    return metrics.bleu(_titles_and_summaries(spark, folder)).withColumn("bleu", F.round("bleu", 9))


_BLEU_BY = (
    "WITH x AS (SELECT DISTINCT rec_id AS id, target_lang AS lang, coalesce(answer[1], '') AS a FROM parallel_items WHERE target_lang IS NOT NULL), "
    f"w AS MATERIALIZED (SELECT id, lang, {O.bleu_words('h', chr(39) + 'zh' + chr(39) + ' = lang')} AS h, {O.bleu_words('a', chr(39) + 'zh' + chr(39) + ' = lang')} AS r FROM (SELECT *, replace(substr(a, 1, 3 * length(a) // 4), '.', ',') AS h FROM x))"
)


@query(
    f"{_BLEU_BY}, c AS ({' UNION ALL '.join(_bleu_sql(n, 'lang, ') for n in range(1, 5))}), s AS (SELECT *, {_SMOOTHED.format('PARTITION BY lang ')} AS x FROM c), "
    "l AS (SELECT lang, coalesce(sum(len(h)), 0)::BIGINT AS hyp_len, coalesce(sum(len(r)), 0)::BIGINT AS ref_len FROM w GROUP BY lang), m AS (SELECT lang, avg(x) AS x FROM s GROUP BY lang HAVING count(*) = 4 AND max(matched) > 0) "
    "SELECT lang, hyp_len, ref_len, round(CASE WHEN x IS NOT NULL THEN 100 * exp(x + CASE WHEN hyp_len >= ref_len THEN 0 ELSE 1 - ref_len / hyp_len END) ELSE 0.0 END, 9) AS bleu FROM l LEFT JOIN m USING (lang)"
)
def bleu_by_target(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU by target language of translations that break off and have commas for stops; Chinese is split into characters."""
    rows = table(spark, folder, "parallel_items").where("target_lang is not null").select(F.col("rec_id").alias("id"), F.col("target_lang").alias("lang"), F.coalesce(F.get("answer", F.lit(0)), F.lit("")).alias("reference")).distinct()
    rows = rows.withColumn("hypothesis", F.replace(F.expr("substring(reference, 1, cast(3 * length(reference) div 4 as int))"), F.lit("."), F.lit(",")))
    return metrics.bleu(rows, "lang", chinese=F.col("lang") == "zh").withColumn("bleu", F.round("bleu", 9))


# ROUGE

_ROUGE_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def _rouge_sql(n: int) -> str:
    gram = f"CASE WHEN len({{0}}) < {n} THEN [] ELSE list_transform(range(1, len({{0}}) - {n} + 2), lambda i: array_to_string({{0}}[i:i + {n - 1}], ' ')) END"
    return (
        f"WITH {_XL}, w AS (SELECT id, {_ROUGE_WORDS.format('title')} AS h, {_ROUGE_WORDS.format('summary')} AS r FROM x), g AS MATERIALIZED (SELECT id, {gram.format('h')} AS h, {gram.format('r')} AS r FROM w), "
        "a AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(h) AS t FROM g) GROUP BY ALL), b AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(r) AS t FROM g) GROUP BY ALL), "
        "s AS (SELECT a.id, sum(least(a.n, b.n)) AS same FROM a JOIN b ON a.id = b.id AND a.t = b.t GROUP BY a.id) SELECT g.id, round(coalesce(2.0 * same / (len(h) + len(r)), 0.0), 9) AS f FROM g LEFT JOIN s USING (id)"
    )


@query(_rouge_sql(1))
def rouge_1(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-1 of titles against summaries, words as they are."""
    return metrics.rouge_n(_titles_and_summaries(spark, folder), 1).select("id", F.round("f", 9).alias("f"))


@query(_rouge_sql(2))
def rouge_2(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-2 of titles against summaries, words as they are."""
    return metrics.rouge_n(_titles_and_summaries(spark, folder), 2).select("id", F.round("f", 9).alias("f"))


#: Longest common subsequence as a fold over the words of one text; an entry of a row is the greatest of the old one and of one more than the entry before a match.
_LCS = (
    "list_reduce(list_prepend({'w': '', 'row': list_transform(range(len(r)), lambda j: 0)}, list_transform(h, lambda w: {'w': w, 'row': []::INT[]})), "
    "lambda acc, x: {'w': '', 'row': list_transform(range(1, len(r) + 1), lambda j: greatest(acc.row[j], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: r[k] = x.w), lambda k: coalesce(acc.row[k - 1], 0) + 1)), 0))::INT)}).row"
)


@query(
    f"WITH {_XL}, w AS MATERIALIZED (SELECT id, {_ROUGE_WORDS.format('title')} AS h, {_ROUGE_WORDS.format('summary')} AS r FROM x), l AS (SELECT id, len(h) + len(r) AS n, CASE WHEN len(h) > 0 AND len(r) > 0 THEN {_LCS}[-1] ELSE 0 END AS same FROM w) "
    "SELECT id, CASE WHEN same > 0 THEN round(2.0 * same / n, 9) ELSE 0.0 END::DOUBLE AS f FROM l"
)
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-L of titles against summaries, words as they are."""
    return metrics.rouge(_titles_and_summaries(spark, folder), stemmed=False).select("id", F.round("rougeL", 9).alias("f"))


@query()
def rouge_scores(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-1, -2, -L and -Lsum of titles against summaries, words stemmed."""
    return metrics.rouge(_titles_and_summaries(spark, folder))


@query()
def rouge_report(spark: SparkSession, folder: str) -> DataFrame:
    """Means of the four stemmed scores over all examples."""
    return metrics.corpus_rouge(_titles_and_summaries(spark, folder))


# Choices

#: Costs of texts by the word model, in millionths, and of the sequences of each question.
_COSTS = (
    f"WITH {O.ALL_WORDS}, t AS (SELECT ln(sum(freq) + count(*)) AS z FROM words), e AS MATERIALIZED (SELECT DISTINCT {_TASK} AS task, rec_id AS id, coalesce(question, '') AS q, choices, answer AS gold, context FROM std_items), "
    "x AS (SELECT *, unnest(list_concat([{'k': -1, 't': ''}], list_transform(coalesce(choices, []), lambda c, k: {'k': k - 1, 't': c}))) AS x FROM e), "
    "f AS MATERIALIZED (SELECT task, id, x.k::INT AS choice, trim(CASE WHEN context IS NULL THEN '' ELSE context || chr(10) END || CASE WHEN task = 'obqa' THEN 'Question: ' || q || ' ' || x.t ELSE 'Question: ' || q || ' Answer: ' || x.t END) AS full_text, "
    "trim('Answer: ' || x.t) AS answer, length(x.t) AS n_chars, gold FROM x), texts AS (SELECT full_text AS text FROM f UNION SELECT answer FROM f WHERE choice >= 0), "
    f"costs AS MATERIALIZED (SELECT text, sum(round(1000000 * (z - ln(coalesce(freq, 0) + 1)))::BIGINT)::BIGINT AS cost FROM (SELECT text, unnest({O.WORDS_OF}) AS word FROM texts) LEFT JOIN words USING (word), t GROUP BY text), "
    "p AS (SELECT task, id, cost AS prompt_ce FROM f JOIN costs ON full_text = text WHERE choice = -1), "
    "s AS MATERIALIZED (SELECT f.task, f.id, choice, a.cost AS full_ce, b.cost AS answer_ce, prompt_ce, n_chars, gold FROM f JOIN costs a ON full_text = a.text JOIN costs b ON answer = b.text JOIN p ON f.task = p.task AND f.id = p.id WHERE choice >= 0), "
    "best AS (SELECT task, id, any_value(gold) AS gold, min(row(full_ce, choice)) AS u, min(row((full_ce - prompt_ce) / n_chars, choice)) FILTER (n_chars > 0) AS l, min(row(full_ce - answer_ce, choice)) AS p FROM s GROUP BY task, id), "
    "g AS (SELECT task, count(*) AS n_examples, avg((u[2] = gold)::INT) AS unnormalized, avg(coalesce((l[2] = gold)::INT, 0)) AS length_normalized, avg((p[2] = gold)::INT) AS prob_normalized FROM best GROUP BY task)"
)
_KINDS = ("unnormalized", "length_normalized", "prob_normalized")
_ROUNDED = ", ".join(f"round({k}, 9) AS {k}" for k in _KINDS)


def _choice_scores(spark: SparkSession, folder: str) -> DataFrame:
    scorer = scoring.word_scorer(cut(words.word_frequencies(_docs(spark, folder))), prompts.format_words())
    rows = table(spark, folder, "std_items").select(F.expr(_TASK).alias("task"), F.col("rec_id").alias("id"), "question", "choices", F.col("answer").alias("gold"), "context")
    # One shuffle for this and for all that goes by question.
    rows = rows.repartition("task", "id").distinct()
    return scoring.choice_scores(rows, scorer)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"{_COSTS} SELECT task, id, choice, full_ce, answer_ce, prompt_ce, n_chars::INT AS n_chars, gold FROM s")
def choice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Costs of each choice's sequences under a word model of the documents."""
    return _choice_scores(spark, folder)


@query(f"{_COSTS} SELECT sum(n_examples)::BIGINT AS n_examples, " + ", ".join(f"round(sum({k} * n_examples) / sum(n_examples), 9) AS {k}" for k in _KINDS) + " FROM g")
def mcq_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of choices scored by a word model of the documents, under three normalizations."""
    by_task = metrics.choice_accuracy(_choice_scores(spark, folder), "task")  # an id may be in several tasks
    n = F.sum("n_examples")
    return _rounded(by_task.agg(n.alias("n_examples"), *((F.sum(F.col(k) * F.col("n_examples")) / n).alias(k) for k in _KINDS)), *_KINDS)


@query(f"{_COSTS} SELECT task, n_examples, {_ROUNDED} FROM g")
def mcq_by_task(spark: SparkSession, folder: str) -> DataFrame:
    """The same accuracies by task."""
    return _rounded(metrics.choice_accuracy(_choice_scores(spark, folder), "task"), *_KINDS)


@query(f"{_COSTS} SELECT count(*) AS n_topics, {', '.join(f'round(avg({k}), 9) AS {k}' for k in _KINDS)} FROM g")
def mcq_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Unweighted means of the accuracies of tasks."""
    return _rounded(metrics.macro_average(metrics.choice_accuracy(_choice_scores(spark, folder), "task"), *_KINDS), *_KINDS)


@query(f"{_COSTS}, m AS (SELECT task, id, any_value(gold) AS gold, min(row(answer_ce, choice)) AS b FROM s GROUP BY task, id) SELECT task, count(*) AS n_examples, round(avg((b[2] = gold)::INT), 9) AS acc FROM m GROUP BY task")
def letter_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy by task of the letter of greatest logit, the word model's log probability of a choice."""
    logits = _choice_scores(spark, folder).select("task", "id", "choice", (-F.col("answer_ce")).alias("logit"), "gold")
    return _rounded(metrics.letter_accuracy(logits, "task"), "acc")


# Outputs


@query("SELECT DISTINCT rec_id, trim(split_part(text, chr(10), 1)) AS line, trim(split_part(text, chr(10) || chr(10), 1)) AS paragraph FROM xlsum_items WHERE text IS NOT NULL")
def output_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts cut as outputs are: the first line and the first paragraph."""
    rows = table(spark, folder, "xlsum_items").where("text is not null")
    return rows.select("rec_id", metrics.first_line("text").alias("line"), metrics.first_paragraph("text").alias("paragraph")).distinct()
