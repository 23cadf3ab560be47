"""All queries of the core with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.functions.text import clean_source, label_key, to_bytes_alphabet
from lexiloom.operators import batches, bpe, documents, masks, metrics, modular, prompts, reports, sampling, unigram, vocab, words
from lexiloom.operators.order import block_of, rank_from_zero
from lexiloom.plans import oracles as O
from lexiloom.plans.registry import query
from lexiloom.streaming.batches import tumbling_counts
from lexiloom.tables import corpus, cut, table

#: Parameters of the catalogue's queries.
WORLD, MERGES, EXTENSION, MASK, N_TARGET, BATCH, CONTEXT = 8, 256, 64, 600, 64 * 129, 64, 128
#: Merges of ``bpe_model``; tokens of each subtokenizer and tokens found for each language of ``sequential_bpe``.
MODEL_MERGES, SUBTOKENIZER, LANGUAGE_EXTENSION = 1000, 320, 96


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder)


def _byte_words(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    return words.byte_words(words.word_frequencies(_docs(spark, folder), *by))


def _merges(spark: SparkSession, folder: str) -> list[bpe.Merge]:
    return _model(spark, folder).merges


def _model(spark: SparkSession, folder: str) -> bpe.BpeModel:
    return bpe.read_model(spark, table(spark, folder, "tok_vocab"), table(spark, folder, "tok_merges"))


# Documents


@query(
    f"SELECT lang, count(*) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, coalesce(sum(strlen(text)), 0)::BIGINT AS n_bytes, "
    f"coalesce(sum(len({O.WORDS_OF})), 0)::BIGINT AS n_words FROM documents GROUP BY lang"
)
def doc_stats_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, characters, bytes and words by language label."""
    return documents.statistics(_docs(spark, folder), "lang")


@query("SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) BETWEEN 200 AND 4000")
def docs_length_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of 200 to 4000 characters."""
    return documents.length_filter(_docs(spark, folder), 200, 4000).select("doc_id", F.length("text").alias("n"))


@query(
    "SELECT doc_id, line_no::INT AS line_no, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) "
    f"WHERE regexp_replace(line, '[{O.WHITE}]+', '', 'g') <> ''"
)
def nonblank_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by line, blank ones left out."""
    return documents.nonblank_lines(_docs(spark, folder))


@query(
    "WITH l AS (SELECT doc_id, line_no, line, trim(line) = '' AS blank FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))), "
    "s AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no), TRUE) THEN 1 ELSE 0 END AS start FROM l), "
    "p AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM s) "
    "SELECT doc_id AS source, paragraph, string_agg(line, chr(10) ORDER BY line_no) AS text FROM p WHERE paragraph > 0 GROUP BY doc_id, paragraph"
)
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document joined up to the next blank line."""
    lines = _docs(spark, folder).select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return documents.paragraphs(lines)


@query(f"SELECT {O.SOURCE} AS source, file_id, line_id, (((line_id % {WORLD}) + {WORLD}) % {WORLD})::INT AS rank FROM documents")
def shard_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The rank that reads each line."""
    return documents.shards(_docs(spark, folder).withColumn("source", clean_source("source")), WORLD)


_POSITIONS = (
    f"SELECT rank, source, row_number() OVER (PARTITION BY rank, source ORDER BY wrap, file_id, line_id, doc_id) - 1 AS pos, wrap, file_id, line_id, doc_id FROM "
    f"(SELECT (((line_id % 4) + 4) % 4)::INT AS rank, coalesce({O.SOURCE}, '') AS source, wrap::INT AS wrap, file_id, line_id, doc_id FROM documents, (SELECT range AS wrap FROM range(2)))"
)


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).withColumn("source", F.coalesce(clean_source("source"), F.lit("")))
    return documents.all_positions(docs, 4, 2)


@query(_POSITIONS)
def stream_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which each of four ranks reads each source twice."""
    return _positions(spark, folder)


@query(f"SELECT * FROM ({_POSITIONS}) WHERE (wrap, file_id, line_id) >= (1, 1, 5)")
def reader_seek(spark: SparkSession, folder: str) -> DataFrame:
    """What the readers still read from line 5 of file 1 of the second pass on."""
    return documents.seek(_positions(spark, folder), 1, 1, 5)


@query(f"SELECT rank, source, m.wrap, m.file_id, m.line_id FROM (SELECT rank, source, min({{'wrap': wrap, 'file_id': file_id, 'line_id': line_id}}) AS m FROM ({_POSITIONS}) WHERE (wrap, file_id, line_id) >= (0, 2, 0) GROUP BY ALL)")
def reader_heads(spark: SparkSession, folder: str) -> DataFrame:
    """The address that each reader reads next from file 2 on."""
    return documents.heads(documents.seek(_positions(spark, folder), 0, 2, 0), "rank", "source")


@query(
    "SELECT line, count(*) AS weight FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"WHERE regexp_replace(line, '[{O.WHITE}]+', '', 'g') <> '' GROUP BY line"
)
def dedup_sentences_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct lines with the number of times they occur."""
    return documents.sentence_weights(_docs(spark, folder))


def _interleaved_sql(docs: str, weight: str, seed: int) -> str:
    """CTEs up to ``placed``: documents ``docs`` of each source after exponential waits at the rate ``weight``."""
    u = f"(('0x' || substr(md5('{seed}/' || source || '/' || nth), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
    return (
        f"WITH d AS ({docs}), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY file_id, line_id, doc_id) - 1 AS nth, dense_rank() OVER (ORDER BY source) AS k FROM d), "
        f"t AS MATERIALIZED (SELECT *, sum(-ln({u}) / {weight}) OVER (PARTITION BY source ORDER BY nth ROWS UNBOUNDED PRECEDING) AS arrival FROM n), placed AS (SELECT *, row_number() OVER (ORDER BY arrival, source) - 1 AS pos FROM t)"
    )


@query(f"{_interleaved_sql(f'SELECT coalesce({O.SOURCE}, {chr(39)}none{chr(39)}) AS source, file_id, line_id, doc_id FROM documents', 'k', 7)} SELECT doc_id, source, pos FROM placed")
def interleaved(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all sources in the order of a weighted interleaving."""
    docs = _docs(spark, folder).withColumn("source", F.coalesce(clean_source("source"), F.lit("none"))).drop("text")
    names = sorted(r.source for r in docs.select("source").distinct().collect())
    return documents.interleave(docs, {x: 1.0 + k for k, x in enumerate(names)}, 7).select("doc_id", "source", "pos")


_SELECTED = f"SELECT coalesce({O.SOURCE}, 'none') AS source, file_id, line_id, doc_id FROM documents WHERE length(text) BETWEEN 1 AND 2000"


@query(f"{_interleaved_sql(_SELECTED, '1.0', 11)} SELECT doc_id, source, pos FROM placed WHERE pos < 500")
def selected_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 texts of at most 2000 characters that a uniform interleaving of the sources selects for re-estimation."""
    docs = unigram.usable_sentences(_docs(spark, folder), 2000).select(F.coalesce(clean_source("source"), F.lit("none")).alias("source"), "file_id", "line_id", "doc_id")
    return documents.select_texts(docs, 500, 11).select("doc_id", "source", "pos")


@query(
    "WITH l AS (SELECT run_id, weights, unnest(map_keys(sources)) AS source FROM pretrain_runs), w AS (SELECT run_id, source, coalesce(weights[source], 1.0) AS w FROM l) "
    "SELECT run_id, source, CASE WHEN sum(w) OVER (PARTITION BY run_id) > 0 THEN w / sum(w) OVER (PARTITION BY run_id) ELSE 0.0 END AS share FROM w"
)
def mixture_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The normalized weight of each source of each run."""
    return sampling.normalized_weights(table(spark, folder, "pretrain_runs"))


# Words and byte pairs


@query(f"WITH {O.WORDS} SELECT lang, word, freq FROM words")
def word_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each pre-token by language label."""
    return words.word_frequencies(_docs(spark, folder), "lang")


@query(f"{O.byte_words(O.WORDS, 'lang, freq')} SELECT lang, symbol, sum(freq)::BIGINT AS freq FROM (SELECT lang, freq, unnest({O.SYMBOLS}) AS symbol FROM bw) GROUP BY ALL")
def byte_symbol_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of each byte symbol by language label."""
    return words.symbol_frequencies(_byte_words(spark, folder, "lang"), "lang")


@query(f"{O.byte_words(O.WORDS, 'lang, freq')} {O.pairs('bw', 'lang')}")
def pair_freq(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of neighbouring byte symbols by language label."""
    return words.pair_frequencies(_byte_words(spark, folder, "lang"), "lang")


@query(f"{O.byte_words(O.WORDS, 'lang, freq')} SELECT lang, split[2:-2] AS symbol, sum(freq)::BIGINT AS freq FROM bw WHERE len({O.SYMBOLS}) = 1 GROUP BY ALL")
def unigram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Words of one symbol by language label."""
    return words.unigram_candidates(_byte_words(spark, folder, "lang"), "lang")


@query(
    f"{O.byte_words(O.WORDS, 'lang, freq')}, p AS ({O.pairs('bw', 'lang')}) "
    "SELECT lang, \"left\", \"right\", freq FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, \"left\", \"right\") AS k FROM p) WHERE k = 1"
)
def top_pair_per_lang(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent pair of each language label."""
    return words.top_pairs(words.pair_frequencies(_byte_words(spark, folder, "lang"), "lang"), "lang")


def _trained(spark: SparkSession, folder: str) -> bpe.BpeModel:
    return bpe.train(_docs(spark, folder), len(bpe.base_vocabulary()) + MERGES)


@query(f"{O.bpe_merges(MERGES)} " + " UNION ALL ".join(f'SELECT {k} AS merge_no, "left" AS a, "right" AS b FROM m{k}' for k in range(MERGES)))
def bpe_merges(spark: SparkSession, folder: str) -> DataFrame:
    """The first merges of BPE trained from scratch on all documents."""
    return spark.createDataFrame([(k, *m) for k, m in enumerate(_trained(spark, folder).merges)], "merge_no int, a string, b string")


@query(f"{O.bpe_merges(MERGES)} SELECT id::INT AS token_id, token AS piece FROM v{MERGES} UNION ALL SELECT * FROM (VALUES (0, '<s>'), (1, '</s>'), (2, '<pad>'), (3, '<unk>'))")
def bpe_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary of BPE trained from scratch on all documents."""
    return spark.createDataFrame([(i, t) for t, i in _trained(spark, folder).vocab.items()], "token_id int, piece string")


@query()
def bpe_model(spark: SparkSession, folder: str) -> DataFrame:
    """The first thousand merges of BPE trained from scratch on all documents."""
    model = bpe.train(_docs(spark, folder), len(bpe.base_vocabulary()) + MODEL_MERGES)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(model.merges)], "merge_no int, a string, b string")


def _units(spark: SparkSession, units: list[bpe.Unit]) -> DataFrame:
    return spark.createDataFrame([(k, "".join(u), len(u)) for k, u in enumerate(units)], "ord int, piece string, parts int")


_UNITS_SQL = " UNION ALL ".join(f'SELECT {k} AS ord, "left" || "right" AS piece, CASE "right" WHEN \'\' THEN 1 ELSE 2 END AS parts FROM m{k}' for k in range(EXTENSION))


@query(f"{O.continued_bpe(EXTENSION)} {_UNITS_SQL}")
def continued_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The first tokens found when training goes on over the project's tokenizer."""
    return _units(spark, bpe.continue_training(_docs(spark, folder), _model(spark, folder), EXTENSION))


@query(f"{O.continued_bpe(EXTENSION, 7)} {_UNITS_SQL}")
def continued_bpe_short(spark: SparkSession, folder: str) -> DataFrame:
    """The same with tokens of at most 7 bytes."""
    return _units(spark, bpe.continue_training(_docs(spark, folder), _model(spark, folder), EXTENSION, max_token_length=7))


@query()
def sequential_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Subtokenizers of all languages, in order of their codes: the first one from scratch, each other one on top of the model so far."""
    known = cut(_docs(spark, folder).withColumn("key", label_key("lang")).drop("lang").join(F.broadcast(_languages(spark, folder)), "key").select("lang", "text"))
    langs = sorted(r.lang for r in table(spark, folder, "languages").select("lang").distinct().collect())
    steps = bpe.train_sequential([(x, known.where(F.col("lang") == x)) for x in langs], len(bpe.base_vocabulary()) + SUBTOKENIZER, LANGUAGE_EXTENSION)
    ids = steps[-1].model.vocab
    return spark.createDataFrame([(s.lang, t, i, ids[t]) for s in steps for t, i in s.extracted.vocab.items()], "lang string, piece string, sub_id int, token_id int")


@query(f"{O.encoded(O.WORDS, 'lang, freq')} SELECT lang, sum(freq * n_tok)::BIGINT AS n_tokens FROM enc GROUP BY lang")
def bpe_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens under the project's tokenizer by language label."""
    return bpe.token_totals(words.word_frequencies(_docs(spark, folder), "lang"), _merges(spark, folder), "lang")


@query(
    f"{O.encoded(O.ALL_WORDS, 'freq')}, c AS (SELECT piece, sum(freq)::BIGINT AS n FROM (SELECT freq, unnest(string_split(done[2:-2], chr(2) || chr(1))) AS piece FROM enc) GROUP BY piece) "
    "SELECT token_id, piece, coalesce(n, 0) AS n FROM tok_vocab LEFT JOIN c USING (piece)"
)
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every token of the vocabulary, zeros included."""
    return bpe.token_counts(words.word_frequencies(_docs(spark, folder)), _merges(spark, folder), table(spark, folder, "tok_vocab").select("token_id", "piece"))


def _nsl_sql() -> str:
    ours = O.encoded(O.WORDS, "lang, freq")
    theirs = """,
ruleset2 AS MATERIALIZED (SELECT list({'p': chr(1) || a || chr(2) || chr(1) || b || chr(2), 'r': chr(1) || a || b || chr(2)} ORDER BY merge_no) AS rules FROM tok_merges WHERE merge_no < 1000),
folded2 AS MATERIALIZED (SELECT split, list_reduce(list_prepend({'p': '', 'r': split}, rules), lambda acc, m: {'p': '', 'r': replace(acc.r, m.p, m.r)}).r AS done2 FROM distinct_splits, ruleset2)
SELECT lang, sum(freq * n_tok)::BIGINT AS n_tokens, sum(freq * (len(done2) - len(replace(done2, chr(1), ''))))::BIGINT AS n_tokens_ref,
  sum(freq * n_tok) / sum(freq * (len(done2) - len(replace(done2, chr(1), '')))) AS nsl FROM enc JOIN folded2 USING (split) WHERE lang IS NOT NULL GROUP BY lang"""
    return ours + theirs


@query(_nsl_sql())
def nsl_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized sequence length by language label: the project's tokenizer against its first thousand merges."""
    merges = _merges(spark, folder)
    return bpe.nsl(words.word_frequencies(_docs(spark, folder).where("lang is not null"), "lang"), merges, merges[:1000], "lang")


# Vocabularies


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    """(key, lang): lower-case codes and names of languages."""
    rows = table(spark, folder, "languages").select("lang", F.explode(F.array("lang", "iso3", "lang_name")).alias("key"))
    return rows.select(F.lower("key").alias("key"), "lang").distinct()


def _word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """(lang, position, own_id, piece): the word list of each language as a vocabulary."""
    rows = table(spark, folder, "common_words").select("lang", F.col("word").alias("piece")).distinct()
    return rows.withColumn("position", F.dense_rank().over(Window.orderBy("lang"))).withColumn("own_id", F.row_number().over(Window.partitionBy("lang").orderBy("piece")))


_LISTS = (
    "lists AS MATERIALIZED (SELECT lang, word AS piece, dense_rank() OVER (ORDER BY lang) AS position, row_number() OVER (PARTITION BY lang ORDER BY word) AS own_id FROM (SELECT DISTINCT lang, word FROM common_words)), "
    "merged AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY position, own_id) - 1)::INT AS token_id, piece FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY position, own_id) AS k FROM lists) WHERE k = 1)"
)


@query(f"WITH {_LISTS} SELECT token_id, piece FROM merged")
def vocab_union(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the languages' vocabularies, numbered by first occurrence."""
    return vocab.union(_word_lists(spark, folder))


@query(f"WITH {_LISTS} SELECT DISTINCT lang, token_id FROM lists JOIN merged USING (piece)")
def lang_to_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each language's pieces in the union."""
    lists = _word_lists(spark, folder)
    return vocab.language_ids(lists, vocab.union(lists))


def _source_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder).select(F.coalesce(clean_source("source"), F.lit("none")).alias("lang"), "text")
    return bpe.token_counts(words.word_frequencies(docs, "lang"), _merges(spark, folder), table(spark, folder, "tok_vocab").select("token_id", "piece"), "lang")


_SOURCE_WORDS = f"words AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT coalesce({O.SOURCE}, 'none') AS lang, unnest({O.WORDS_OF}) AS word FROM documents) GROUP BY ALL)"
_MASK_SQL = (
    f"{O.encoded(_SOURCE_WORDS, 'lang, freq')}, c AS (SELECT lang, piece, sum(freq)::BIGINT AS n FROM (SELECT lang, freq, unnest(string_split(done[2:-2], chr(2) || chr(1))) AS piece FROM enc) GROUP BY ALL), "
    "counts AS MATERIALIZED (SELECT g.lang, v.token_id, v.is_special, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM words) g, tok_vocab v LEFT JOIN c ON c.lang = g.lang AND c.piece = v.piece), "
    f"mask AS MATERIALIZED (SELECT lang, token_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token_id) AS k FROM counts WHERE NOT is_special) WHERE k <= greatest(0, {MASK} - (SELECT count(*) FROM tok_vocab WHERE is_special)) "
    "UNION ALL SELECT lang, token_id FROM counts WHERE is_special)"
)


def _mask(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.common_mask(_source_counts(spark, folder), table(spark, folder, "tok_vocab"), MASK)


@query(f"{_MASK_SQL} SELECT lang, token_id FROM mask")
def mask_common_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Special tokens and the most frequent others of each source."""
    return _mask(spark, folder)


@query(f"{_MASK_SQL} SELECT DISTINCT token_id FROM (SELECT token_id FROM mask WHERE lang IN ('news_feed', 'wiki_dump') UNION ALL SELECT token_id FROM tok_vocab WHERE is_special)")
def mask_union_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The mask of a subtokenizer of two sources; an unknown one adds nothing."""
    return vocab.subtokenizer_mask(_mask(spark, folder), table(spark, folder, "tok_vocab"), "wiki_dump,news_feed,unknown")


@query(f"{_MASK_SQL} SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY token_id) - 1)::INT AS sub_id, token_id AS global_id FROM mask")
def subtok_id_map(spark: SparkSession, folder: str) -> DataFrame:
    """Ids inside of each source's subtokenizer."""
    return vocab.id_map(_mask(spark, folder), "lang")


@query(
    f"{_MASK_SQL}, m AS (SELECT row_number() OVER (ORDER BY token_id) - 1 AS sub_id, token_id FROM mask WHERE lang = 'news_feed') "
    "SELECT v.token_id AS global_id, coalesce(sub_id, -1)::INT AS sub_id FROM tok_vocab v LEFT JOIN m USING (token_id)"
)
def dense_id_map(spark: SparkSession, folder: str) -> DataFrame:
    """Id inside of one subtokenizer for every global id, -1 for holes."""
    mapping = vocab.id_map(_mask(spark, folder).where("lang = 'news_feed'"))
    return vocab.dense_map(mapping, table(spark, folder, "tok_vocab").count())


@query(
    f"{_MASK_SQL}, p AS (SELECT piece FROM mask JOIN tok_vocab USING (token_id) WHERE lang = 'news_feed') SELECT (row_number() OVER (ORDER BY merge_no) - 1)::INT AS merge_no, a, b FROM tok_merges "
    "WHERE a IN (FROM p) AND b IN (FROM p) AND a || b IN (FROM p)"
)
def subtok_merges(spark: SparkSession, folder: str) -> DataFrame:
    """Merges that one subtokenizer keeps."""
    tokens = table(spark, folder, "tok_vocab")
    kept = _mask(spark, folder).where("lang = 'news_feed'").join(tokens, "token_id").select("piece")
    return vocab.restrict_merges(table(spark, folder, "tok_merges"), kept)


@query(
    f"WITH {O.ALPHABET}, t AS (SELECT lang, word, {O.AS_BYTES} AS piece FROM (SELECT DISTINCT lang, word FROM common_words), alphabet), o AS (SELECT piece, min((lang, word)) AS ord FROM t GROUP BY piece) "
    "SELECT (row_number() OVER (ORDER BY ord) - 1 + (SELECT count(*) FROM tok_vocab))::INT AS token_id, piece FROM o WHERE piece NOT IN (SELECT piece FROM tok_vocab)"
)
def vocab_new_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the word lists that the vocabulary lacks, numbered after it."""
    rows = table(spark, folder, "common_words").select("lang", "word", to_bytes_alphabet("word").alias("piece"))
    return vocab.new_tokens(rows.groupBy("piece").agg(F.min(F.struct("lang", "word")).alias("ord")), table(spark, folder, "tok_vocab"))


@query(
    f"WITH {_LISTS}, ids AS (SELECT lang, token_id FROM lists JOIN tok_vocab v USING (piece)) SELECT 'duplicate_id' AS rule, count(*) AS n FROM (SELECT token_id FROM tok_vocab GROUP BY 1 HAVING count(*) > 1) "
    "UNION ALL SELECT 'duplicate_piece', count(*) FROM (SELECT piece FROM tok_vocab GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'id_out_of_range', count(*) FROM tok_vocab WHERE token_id < 0 OR token_id >= (SELECT count(*) FROM tok_vocab) "
    "UNION ALL SELECT 'language_id_unknown', count(*) FROM ids WHERE token_id NOT IN (SELECT token_id FROM tok_vocab) "
    "UNION ALL SELECT 'merge_not_buildable', count(*) FROM (SELECT DISTINCT merge_no, p FROM (SELECT merge_no, unnest([a, b, a || b]) AS p FROM tok_merges) WHERE p NOT IN (SELECT piece FROM tok_vocab))"
)
def validate_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of the rules of a tokenizer directory."""
    tokens = table(spark, folder, "tok_vocab")
    return vocab.validate(tokens, table(spark, folder, "tok_merges"), vocab.monolingual_mask(_word_lists(spark, folder), tokens))


@query("SELECT token_id, piece FROM tok_vocab WHERE piece NOT IN (SELECT a || b FROM tok_merges)")
def underived_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that no merge builds."""
    return vocab.underived(table(spark, folder, "tok_vocab"), table(spark, folder, "tok_merges"))


@query("SELECT token_id, piece IN ('<s>', '</s>', '<pad>', '<unk>') OR regexp_matches(piece, '^<0x[0-9A-Fa-f]{2}>$') AS special FROM tok_vocab")
def special_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Which tokens are special."""
    return table(spark, folder, "tok_vocab").select("token_id", vocab.is_special("piece").alias("special"))


# Unigram models


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all('{unigram.META}' || replace(text, ' ', '{unigram.META}'), '{unigram.WORDS}')) AS word FROM documents) GROUP BY word")
def unigram_words(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of words as unigram training splits them."""
    return _docs(spark, folder).select(F.explode(unigram.pretokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


#: Longest sentence, and rounds of ``em_scores``.
SENTENCE, ROUNDS = 512, 3


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(sent_id, sentence, weight): different lines of all documents that can be used, with the number of times they occur."""
    lines = documents.sentence_weights(_docs(spark, folder)).select(F.col("line").alias("text"), "weight")
    return cut(unigram.usable_sentences(lines, SENTENCE).select(F.col("text").alias("sent_id"), "sentence", "weight"))


def _pieces(sentences: DataFrame, lists: DataFrame) -> DataFrame:
    """Single characters of the sentences and the words of the word lists, bare and with a blank mark."""
    letters = sentences.select(F.explode(F.array_distinct(F.split("sentence", ""))).alias("piece")).where("piece != ''")
    listed = lists.select("piece").union(lists.select(F.concat(F.lit(unigram.META), "piece").alias("piece")))
    return letters.union(listed).distinct()


_SENTENCES = (
    "s AS MATERIALIZED (SELECT line AS sent_id, '▁' || replace(line, ' ', '▁') AS sentence, count(*) AS weight FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"WHERE regexp_replace(line, '[{O.WHITE}]+', '', 'g') <> '' AND length(line) <= {SENTENCE} GROUP BY line), "
    "pieces AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(sentence, '(?s).')) AS piece FROM s UNION SELECT word FROM common_words UNION SELECT '▁' || word FROM common_words)"
)
_LATTICE = (
    f"{_SENTENCES}, sizes AS (SELECT DISTINCT length(piece) AS n FROM pieces), edges AS MATERIALIZED (SELECT sent_id, i, i + n AS j, piece FROM (SELECT sent_id, i, n, sentence[i + 1:i + n] AS p FROM (SELECT sent_id, sentence, unnest(range(length(sentence))) AS i FROM s), sizes "
    "WHERE i + n <= length(sentence)) JOIN pieces ON piece = p)"
)


@query(f"WITH {_LATTICE} SELECT sent_id, i::INT AS i, j::INT AS j, piece FROM edges")
def unigram_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece at every place of the lines."""
    sentences = _sentences(spark, folder)
    return unigram.lattice(sentences, cut(_pieces(sentences, _word_lists(spark, folder))))


def _round_sql(k: int) -> str:
    """CTEs of one round over scores ``p{k}``: forward and backward sums as folds over positions, expected counts ``c{k}``, likelihood ``z{k}``, scores ``p{k + 1}``."""
    fold = (
        "list_reduce(list_prepend({{'a': [0.0::DOUBLE], 'e': []::STRUCT(o BIGINT, p DOUBLE)[]}}, list({{'a': []::DOUBLE[], 'e': e}} ORDER BY {at})), "
        "lambda acc, x: {{'a': list_append(acc.a, acc.a[-1] + ln(list_sum(list_transform(x.e, lambda u: exp(acc.a[u.o + 1] - acc.a[-1] + u.p))))), 'e': x.e}}).a"
    )
    return (
        f"x{k} AS MATERIALIZED (SELECT sent_id, length(sentence) AS n, weight, i, j, piece, p FROM edges JOIN p{k} USING (piece) JOIN s USING (sent_id)), "
        f"f{k} AS MATERIALIZED (SELECT sent_id, {fold.format(at='j')} AS alpha FROM (SELECT sent_id, j, list({{'o': i, 'p': p}}) AS e FROM x{k} GROUP BY ALL) GROUP BY sent_id), "
        f"b{k} AS MATERIALIZED (SELECT sent_id, {fold.format(at='i DESC')} AS beta FROM (SELECT sent_id, i, list({{'o': n - j, 'p': p}}) AS e FROM x{k} GROUP BY ALL) GROUP BY sent_id), "
        f"c{k} AS MATERIALIZED (SELECT piece, sum(weight * exp(alpha[i + 1] + p + beta[n - j + 1] - alpha[-1])) AS c FROM x{k} JOIN f{k} USING (sent_id) JOIN b{k} USING (sent_id) GROUP BY piece), "
        f"z{k} AS (SELECT sum(weight * alpha[-1]) AS z FROM f{k} JOIN s USING (sent_id)), "
        f"p{k + 1} AS MATERIALIZED (SELECT piece, ln(1 + coalesce(c, 0)) - ln(1 + (SELECT sum(c) FROM c{k})) AS p FROM pieces LEFT JOIN c{k} USING (piece))"
    )


_EM = f"WITH {_LATTICE}, p0 AS MATERIALIZED (SELECT piece, -ln((SELECT count(*) FROM pieces)) AS p FROM pieces)"


def _piece_list(sentences: DataFrame, lists: DataFrame) -> list[str]:
    return sorted(r.piece for r in _pieces(sentences, lists).collect())  # a vocabulary


@query(f"{_EM}, {_round_sql(0)} SELECT piece, round(c, 2) AS n FROM c0 UNION ALL SELECT NULL, round(z, 2) FROM z0")
def em_estep(spark: SparkSession, folder: str) -> DataFrame:
    """Expected counts of pieces in the lines under equal scores; the null piece has the log-likelihood."""
    sentences = _sentences(spark, folder)
    scores = unigram.start_scores(_piece_list(sentences, _word_lists(spark, folder)))
    return unigram.e_step(sentences, scores).select("piece", F.round("n", 2).alias("n"))


@query(f"{_EM}, {', '.join(map(_round_sql, range(ROUNDS)))} SELECT piece, round(p, 6) AS score FROM p{ROUNDS}")
def em_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of pieces after three rounds of expectation-maximization over the lines."""
    sentences = _sentences(spark, folder)
    logp, _ = unigram.fit(sentences, _piece_list(sentences, _word_lists(spark, folder)), ROUNDS, 0.0)
    return spark.createDataFrame([(p, round(x, 6)) for p, x in logp.items()], "piece string, score double")


@query(f"{_EM}, {', '.join(map(_round_sql, range(ROUNDS)))} " + " UNION ALL ".join(f'SELECT {k} AS "round", round(z, 2) AS log_likelihood FROM z{k}' for k in range(ROUNDS)))
def em_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihood of the lines in each of three rounds."""
    sentences = _sentences(spark, folder)
    _, history = unigram.fit(sentences, _piece_list(sentences, _word_lists(spark, folder)), ROUNDS, 0.0)
    return spark.createDataFrame([(k, round(z, 2)) for k, z in enumerate(history)], "round int, log_likelihood double")


#: Re-estimation as it is timed: pieces, sentences selected from the sources, rounds.
EM_PIECES, EM_SENTENCES, EM_ROUNDS = 400_000, 10_000, 50


@query()
def em_reestimated(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of up to 400,000 pieces after at most 50 rounds over 10,000 lines that a uniform interleaving of the sources selects."""
    docs = _docs(spark, folder)
    lines = documents.nonblank_lines(docs).join(docs.select("doc_id", F.coalesce(clean_source("source"), F.lit("none")).alias("source"), "file_id", "line_id"), "doc_id")
    # A line's address: its document's place, then its number.
    lines = unigram.usable_sentences(lines.withColumnRenamed("line", "text"), SENTENCE).withColumn("line_id", F.col("line_id") * 1_000_000 + F.col("line_no"))
    chosen = documents.select_texts(lines, EM_SENTENCES, 11).withColumn("weight", F.lit(1.0))
    pieces = unigram.seed_pieces(words.word_frequencies(docs), EM_PIECES)
    letters = {r.piece for r in chosen.select(F.explode(F.array_distinct(F.split("sentence", ""))).alias("piece")).where("piece != ''").distinct().collect()}
    logp, _ = unigram.fit(chosen, sorted(letters.union(pieces)), EM_ROUNDS)
    return spark.createDataFrame(list(logp.items()), "piece string, score double")


@query()
def viterbi_segment(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest pieces of each line under scores fitted to them."""
    sentences = _sentences(spark, folder)
    logp, _ = unigram.fit(sentences, _piece_list(sentences, _word_lists(spark, folder)), 2)
    numbered = sentences.select(F.xxhash64("sent_id").alias("sent_id"), "sentence")
    return unigram.segment(numbered, logp).select("sent_id", F.array_join("pieces", " ").alias("pieces"))


@query()
def unigram_model(spark: SparkSession, folder: str) -> DataFrame:
    """A unigram vocabulary of 1,000 pieces trained on all documents, with byte pieces."""
    logp = unigram.train(words.word_frequencies(_docs(spark, folder)), 1000)
    return spark.createDataFrame(unigram.with_bytes(logp), "token_id int, piece string, score double")


# Batches


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source in reading order, two buffers a source; a token is a word here."""
    docs = _docs(spark, folder).select(
        F.coalesce(clean_source("source"), F.lit("none")).alias("lang"), "doc_id", "file_id", "line_id", F.size(words.pretokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    placed = rank_from_zero(docs.withColumn("block", block_of("line_id")), ["lang"], ["file_id", "block"], ["line_id", "doc_id"], "pos")
    return placed.select("lang", "pos", "doc_id", "n_tokens", "n_bytes").withColumn("subtok", F.when(F.col("pos") % 3 == 0, F.lit("all")).otherwise(F.col("lang")))


def _stream_sql(n_tokens: str = f"coalesce(len({O.WORDS_OF}), 0)", docs: str = "documents") -> str:
    """CTEs up to ``factors``: buffers of two a source, filled in reading order and cut into batches; ``n_tokens`` counts those of a document."""
    return (
        f"st AS MATERIALIZED (SELECT *, CASE WHEN pos % 3 = 0 THEN 'all' ELSE lang END AS subtok FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY file_id, line_id, doc_id) - 1 AS pos, doc_id, n_tokens, n_bytes "
        f"FROM (SELECT coalesce({O.SOURCE}, 'none') AS lang, doc_id, file_id, line_id, {n_tokens} AS n_tokens, coalesce(strlen(text), 0) AS n_bytes FROM {docs}))), "
        "ends AS (SELECT *, stop - n_tokens AS start FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY lang, subtok ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM st WHERE n_tokens > 0)), "
        f"ex AS (SELECT *, unnest(range(start // {N_TARGET}, (stop - 1) // {N_TARGET} + 1)) AS b FROM ends), "
        f"gr AS (SELECT *, greatest(0, b * {N_TARGET} - start) AS first, least(stop, (b + 1) * {N_TARGET}) - greatest(start, b * {N_TARGET}) AS grab FROM ex), "
        f"parts AS MATERIALIZED (SELECT lang, subtok, b, pos, doc_id, first, grab, n_bytes * grab / n_tokens AS share_bytes FROM (SELECT *, sum(grab) OVER (PARTITION BY lang, subtok, b) AS filled FROM gr) WHERE filled = {N_TARGET}), "
        "factors AS MATERIALIZED (SELECT lang, subtok, b, sum(grab)::BIGINT AS n_tokens, count(*) AS n_docs, max(pos) AS ready_pos, CASE WHEN sum(share_bytes) > 0 THEN sum(grab) / sum(share_bytes) / ln(2) ELSE 0.0 END AS c_bpb FROM parts GROUP BY ALL)"
    )


_STREAM = _stream_sql()


@query(f"WITH {_STREAM} SELECT lang, subtok, b, pos, doc_id, first, grab, round(share_bytes, 6) AS share_bytes FROM parts")
def pack_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each document in each full batch of its buffer."""
    return batches.spans(_stream(spark, folder), N_TARGET).withColumn("share_bytes", F.round("share_bytes", 6))


@query(f"WITH {_STREAM} SELECT lang, subtok, b, n_tokens, n_docs, round(c_bpb, 9) AS c_bpb FROM factors")
def batch_bpb(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens over bytes of each batch."""
    return batches.batch_factors(batches.spans(_stream(spark, folder), N_TARGET)).select("lang", "subtok", "b", "n_tokens", "n_docs", F.round("c_bpb", 9).alias("c_bpb"))


@query(f"WITH {_STREAM} SELECT lang, subtok, b, (row_number() OVER (PARTITION BY lang ORDER BY ready_pos, b) - 1)::INT AS nth FROM factors")
def batch_emission_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which batches of a source come out."""
    return batches.emission_order(batches.batch_factors(batches.spans(_stream(spark, folder), N_TARGET))).select("lang", "subtok", "b", "nth")


@query()
def batch_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of each step, sources drawn by their number of batches; as many steps as there are batches."""
    factors = cut(batches.batch_factors(batches.spans(_stream(spark, folder), N_TARGET)))
    names = {r.lang: float(r.n) for r in factors.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return batches.scheduled(factors, sampling.language_schedule(spark, names, int(sum(names.values())), 41)) if names else factors.withColumn("step", F.lit(0))


@query(
    f"WITH {_STREAM}, used AS (SELECT lang, subtok, pos, sum(grab)::BIGINT AS used FROM parts WHERE b < 1 GROUP BY ALL), l AS (SELECT lang, subtok, max(pos) AS last_pos, arg_max(used, pos) AS last_n_tokens FROM used GROUP BY ALL), "
    "a AS (SELECT lang, subtok, min(pos) AS anchor_pos FROM st LEFT JOIN used USING (lang, subtok, pos) WHERE n_tokens > 0 AND coalesce(used, 0) < n_tokens GROUP BY ALL) "
    "SELECT lang, subtok, last_pos, last_n_tokens, anchor_pos FROM a FULL JOIN l USING (lang, subtok)"
)
def snapshot_state(spark: SparkSession, folder: str) -> DataFrame:
    """Where each buffer stands after its first batch."""
    stream = _stream(spark, folder)
    parts = batches.spans(stream, N_TARGET)
    return batches.snapshot(stream, parts, parts.select("lang", "subtok").distinct().withColumn("n_batches", F.lit(1)))


@query()
def subtokenizer_draws(spark: SparkSession, folder: str) -> DataFrame:
    """The subtokenizer of each document, drawn from its source's chain."""
    stream = _stream(spark, folder).drop("subtok")
    names = sorted(r.lang for r in stream.select("lang").distinct().collect())
    table_ = sampling.SamplingConfig(sampling.Strategy.UNIFORM, 0.5, 4, 1).table(spark, names, 41).collect()
    choices = {x: ([r.subtok for r in table_ if r.lang == x], [r.p for r in table_ if r.lang == x]) for x in names}
    return sampling.draw_subtokenizers(stream, choices, 41).select("lang", "pos", "doc_id", "subtok")


# Metrics


_XL = "x AS MATERIALIZED (SELECT DISTINCT rec_id AS id, title, summary FROM xlsum_items)"


def _titles_and_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "xlsum_items").select(F.col("rec_id").alias("id"), F.coalesce("title", F.lit("")).alias("hypothesis"), F.coalesce("summary", F.lit("")).alias("reference")).distinct()


@query(f"SELECT DISTINCT rec_id, array_to_string({O.answer_words('question')}, ' ') AS normal FROM std_items WHERE question IS NOT NULL")
def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as answers are compared."""
    return table(spark, folder, "std_items").where("question is not null").select("rec_id", metrics.normalize_answer("question").alias("normal")).distinct()


@query(
    f"WITH {_XL}, p AS (SELECT id, {O.answer_words('title')} AS p, {O.answer_words('summary')} AS g FROM x WHERE title IS NOT NULL AND summary IS NOT NULL), "
    "c AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(p) AS w FROM p) GROUP BY ALL), d AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(g) AS w FROM p) GROUP BY ALL), "
    "s AS (SELECT c.id, sum(least(c.n, d.n)) AS same FROM c JOIN d ON c.id = d.id AND c.w = d.w GROUP BY c.id) "
    "SELECT p.id, round(coalesce(2.0 * same / (len(p) + len(g)), 0.0), 9) AS f1 FROM p LEFT JOIN s USING (id)"
)
def answer_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Word F1 of titles against summaries."""
    rows = table(spark, folder, "xlsum_items").where("title is not null and summary is not null").select(F.col("rec_id").alias("id"), F.col("title").alias("prediction"), F.array("summary").alias("golds")).distinct()
    return metrics.token_f1(rows).select("id", F.round("f1", 9).alias("f1"))


@query(
    f"WITH q AS (SELECT DISTINCT rec_id, question, choices FROM std_items WHERE question IS NOT NULL AND choices IS NOT NULL) SELECT rec_id, "
    f"list_contains(list_transform(choices, lambda c: array_to_string({O.answer_words('c')}, ' ')), array_to_string({O.answer_words('choices[1]')}, ' '))::INT::DOUBLE AS em FROM q WHERE len(choices) > 0"
)
def answer_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the first choice is among the choices after normalization."""
    rows = table(spark, folder, "std_items").where("question is not null and size(choices) > 0").select("rec_id", "question", "choices").distinct()
    return rows.select("rec_id", metrics.exact_match(F.col("choices")[0], "choices").alias("em"))


def _rates_sql() -> str:
    warm = "CASE WHEN s < 500 THEN 0.0005 * s / 500 WHEN s < {0} THEN 0.0005 ELSE {1} END"
    done = "least(1.0, (s - {0}) / {1})"
    linear = warm.format(4000, f"0.00005 + 0.00045 * (1 - {done.format(4000, 1000)})")
    cosine = warm.format(500, f"0.00005 + 0.00045 * (1 + cos(pi() * {done.format(500, 4500)})) / 2")
    root = warm.format(4000, f"0.00005 + 0.00045 * (1 - sqrt(greatest(0.0, {done.format(4000, 1000)})))")
    return " UNION ALL ".join(f"SELECT '{name}' AS shape, range AS step, round({sql.replace('s <', 'range <').replace('* s /', '* range /').replace('(s -', '(range -')}, 12) AS lr FROM range(5000)" for name, sql in (("linear", linear), ("cosine", cosine), ("1-sqrt", root)))


@query(_rates_sql())
def lr_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Learning rates of three schedules over 5000 steps."""
    shapes = {"linear": (4000, 1000), "cosine": (500, 4500), "1-sqrt": (4000, 1000)}
    parts = [metrics.learning_rates(spark, 5000, 0.0005, 500, start, length, 0.1, shape).select(F.lit(shape).alias("shape"), "step", F.round("lr", 12).alias("lr")) for shape, (start, length) in shapes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "SELECT \"window\", CASE WHEN g = 1 THEN '*' ELSE lang END AS lang, n, round(mean, 9) AS mean FROM (SELECT \"window\", lang, grouping(lang) AS g, count(v) AS n, avg(v) AS mean FROM "
    "(SELECT step // 100 AS \"window\", coalesce(lang, '') AS lang, c_bpb AS v FROM batch_docs) GROUP BY GROUPING SETS ((\"window\", lang), (\"window\"))) WHERE n > 0"
)
def loss_by_lang_window(spark: SparkSession, folder: str) -> DataFrame:
    """Mean bits-per-byte factor for each hundred steps, by language and overall."""
    return metrics.window_means(table(spark, folder, "batch_docs"), "step", "c_bpb", 100).withColumn("mean", F.round("mean", 9))


@query(
    "WITH e AS MATERIALIZED (SELECT DISTINCT task, rec_id AS id, split = 'train' AS is_shot, question, CASE WHEN answer BETWEEN 0 AND len(choices) - 1 THEN choices[answer + 1] END AS answer, context FROM std_items WHERE task IS NOT NULL AND split IS NOT NULL), "
    "t AS (SELECT *, (CASE WHEN context IS NULL THEN '' ELSE context || chr(10) END) || 'Question: ' || coalesce(question, '') || ' Answer: ' AS q FROM e), "
    "h AS (SELECT task, string_agg(q || coalesce(answer, ''), chr(10) ORDER BY id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY id) AS k FROM t WHERE is_shot) WHERE k <= 2 GROUP BY task) "
    "SELECT task, id, 'Questions and answers.' || chr(10) || coalesce(s, '') || chr(10) || rtrim(q) AS prompt FROM t LEFT JOIN h USING (task) WHERE NOT is_shot"
)
def prompt_fewshot(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with two solved examples of the same task."""
    items = table(spark, folder, "std_items").where("task is not null and split is not null")
    answer = F.when((F.col("answer") >= 0) & (F.col("answer") < F.size("choices")), F.get("choices", F.col("answer")))
    rows = items.select("task", F.col("rec_id").alias("id"), (F.col("split") == "train").alias("is_shot"), "question", answer.alias("answer"), "context").distinct()
    return metrics.few_shot_prompts(rows, 2, "Questions and answers.", "Question: {q} Answer: {a}", "task")


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and type; an extra on event time."""
    return tumbling_counts(table(spark, folder, "events"), 60).withColumn("total", F.round("total", 4))


# Prompts and edges of models


_TASK = "CASE task WHEN 'std_yesno' THEN 'boolq' WHEN 'std_science' THEN 'sciq' ELSE 'obqa' END"


@query(
    "WITH e AS (SELECT DISTINCT rec_id AS id, question, choices, context FROM std_items WHERE question IS NOT NULL AND len(choices) > 0) SELECT id, CASE WHEN context IS NULL THEN '' ELSE context || chr(10) END || question || chr(10) || "
    "array_to_string(list_transform(choices[1:8], lambda c, k: 'ABCDEFGH'[k] || '. ' || c), chr(10)) || chr(10) || 'Answer:' AS prompt FROM e"
)
def letter_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with lettered choices."""
    rows = table(spark, folder, "std_items").where("question is not null and size(choices) > 0").select(F.col("rec_id").alias("id"), "question", "choices", "context").distinct()
    return rows.select("id", prompts.letter_prompt(F.col("question"), F.col("choices"), F.col("context")).alias("prompt"))


@query(
    f"WITH e AS MATERIALIZED (SELECT DISTINCT {_TASK} AS task, rec_id AS id, coalesce(question, '') AS q, choices, answer AS gold, context FROM std_items), "
    "x AS (SELECT *, unnest(list_concat([{'k': -1, 't': ''}], list_transform(coalesce(choices, []), lambda c, k: {'k': k - 1, 't': c}))) AS x FROM e) "
    "SELECT task, id, x.k::INT AS choice, trim(CASE WHEN context IS NULL THEN '' ELSE context || chr(10) END || CASE WHEN task = 'obqa' THEN 'Question: ' || q || ' ' || x.t ELSE 'Question: ' || q || ' Answer: ' || x.t END) AS \"full\", "
    "trim('Answer: ' || x.t) AS answer, length(x.t)::INT AS n_chars, gold FROM x"
)
def cloze_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """What a scorer has to score of each question."""
    rows = table(spark, folder, "std_items").select(F.expr(_TASK).alias("task"), F.col("rec_id").alias("id"), "question", "choices", F.col("answer").alias("gold"), "context").distinct()
    return prompts.cloze_sequences(rows)


@query(
    "WITH e AS MATERIALIZED (SELECT DISTINCT rec_id AS id, split = 'train' AS shot, 'en: ' || coalesce(question, '') || ' out:' AS line, coalesce(answer[1], '') AS a FROM parallel_items WHERE split IS NOT NULL), "
    "h AS (SELECT string_agg(line || ' ' || a, chr(10) ORDER BY id) AS s FROM (SELECT * FROM e WHERE shot ORDER BY id LIMIT 3)) SELECT id, s || chr(10) || line AS prompt FROM e, h WHERE NOT shot"
)
def translation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Translation prompts with three shots."""
    rows = table(spark, folder, "parallel_items").where("split is not null").select(F.col("rec_id").alias("id"), (F.col("split") == "train").alias("is_shot"), "question", "answer").distinct()
    return prompts.translation_prompts(rows, 3, "en", "out")


@query(
    "WITH e AS MATERIALIZED (SELECT DISTINCT rec_id AS id, split = 'train' AS shot, 'Text: ' || coalesce(text, '') || chr(10) || 'Summary: ' AS line, coalesce(summary, '') AS a FROM xlsum_items WHERE split IS NOT NULL), "
    "h AS (SELECT string_agg(rtrim(line || a), chr(10) || chr(10) ORDER BY id) AS s FROM (SELECT * FROM e WHERE shot ORDER BY id LIMIT 2)) SELECT id, s || chr(10) || chr(10) || rtrim(line) AS prompt FROM e, h WHERE NOT shot"
)
def summary_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Summarization prompts with two shots."""
    rows = table(spark, folder, "xlsum_items").where("split is not null").select(F.col("rec_id").alias("id"), (F.col("split") == "train").alias("is_shot"), F.col("text").alias("source"), "summary").distinct()
    return prompts.summary_prompts(rows, 2, "Text", "Summary")


@query(
    f"WITH {_LISTS} SELECT DISTINCT lang, token_id FROM (SELECT lang, v.token_id FROM lists JOIN tok_vocab v USING (piece) UNION ALL SELECT l.lang, v.token_id FROM (SELECT DISTINCT lang FROM lists) l, tok_vocab v WHERE v.is_special)"
)
def mask_own_vocabularies(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens each language sees by its own vocabulary."""
    lists = _word_lists(spark, folder)
    langs = sorted(r.lang for r in table(spark, folder, "languages").collect())
    return masks.language_masks(masks.Extraction.MERGED_UNNORM, table(spark, folder, "tok_vocab"), langs, own_vocabs=lists.select("lang", "piece"))


@query(f"{_MASK_SQL}, m AS (SELECT token_id FROM mask WHERE lang = 'news_feed') SELECT token_id, CASE WHEN token_id IN (FROM m) THEN 0.0::DOUBLE ELSE '-inf'::DOUBLE END AS add FROM tok_vocab")
def logit_mask(spark: SparkSession, folder: str) -> DataFrame:
    """0 for tokens one subtokenizer sees and minus infinity for the others."""
    return masks.logit_mask(_mask(spark, folder).where("lang = 'news_feed'"), table(spark, folder, "tok_vocab").count())
