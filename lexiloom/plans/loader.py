"""Queries of tokens as a loader delivers them: ids, restricted ids, batches of inputs and targets, rows for timing, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import batches, modular, reports, vocab
from lexiloom.plans import oracles as O
from lexiloom.plans.catalogue import BATCH, CONTEXT, N_TARGET, _docs, _MASK_SQL, _mask, _model, _stream, _stream_sql
from lexiloom.plans.registry import query
from lexiloom.tables import cut, table

#: Tokens that a text is cut to, and the length that items are filled up to.
BUDGET, PADDED = 64, 48


def _shown(ids: str | Column) -> Column:
    """Ids as one string, so that results compare on every engine."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def ids_sql(docs: str, rules: str = "tok_merges", tokens: str = "tok_vocab", before: str = "") -> str:
    """CTEs up to ``ids`` (doc_id, ids): global token ids of the texts of ``docs`` (doc_id, text) without begin and end, by folding the merges ``rules`` in order.

    Pieces that ``tokens`` lacks are unknown; ``before`` are CTEs that come first.
    """
    words = f"{before}d AS MATERIALIZED ({docs}), each AS MATERIALIZED (SELECT doc_id, unnest(range(len(ws))) AS k, unnest(ws) AS word FROM (SELECT doc_id, {O.WORDS_OF} AS ws FROM d)), words AS MATERIALIZED (SELECT DISTINCT word, 1 AS freq FROM each)"
    return (
        O.encoded(words, "word, freq", rules)
        + """, pieces AS (SELECT word, unnest(range(len(p))) AS nth, unnest(p) AS piece FROM (SELECT word, string_split(done[2:-2], chr(2) || chr(1)) AS p FROM enc)),
wids AS MATERIALIZED (SELECT word, list(coalesce(token_id, (SELECT token_id FROM tok_vocab WHERE piece = '<unk>')) ORDER BY nth) AS i FROM pieces LEFT JOIN """
        + tokens
        + """ USING (piece) GROUP BY word),
ids AS MATERIALIZED (SELECT d.doc_id, coalesce(flatten(list(i ORDER BY k) FILTER (i IS NOT NULL)), []::INT[]) AS ids FROM d LEFT JOIN each USING (doc_id) LEFT JOIN wids USING (word) GROUP BY d.doc_id)"""
    )


_BOUNDED = "list_concat(list_concat([(SELECT token_id FROM tok_vocab WHERE piece = '<s>')], ids), [(SELECT token_id FROM tok_vocab WHERE piece = '</s>')])"
_DOC_IDS = ids_sql("SELECT doc_id, text FROM documents")


def _tokenizer(spark: SparkSession, folder: str) -> modular.ModularTokenizer:
    return modular.ModularTokenizer(_model(spark, folder), {})


@query(f"{_DOC_IDS} SELECT doc_id, len(ids)::INT + 2 AS n, array_to_string({_BOUNDED}, ' ') AS ids FROM ids")
def encoded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document with begin and end."""
    tokens = _tokenizer(spark, folder).encode(_docs(spark, folder).select("doc_id", "text"))
    return tokens.select("doc_id", F.size("tokens").alias("n"), _shown("tokens").alias("ids"))


@query(f"{_DOC_IDS} SELECT doc_id, array_to_string(ids[1:{BUDGET}], ' ') AS ids FROM ids")
def truncated_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The first tokens of each document, within a budget."""
    tokens = _tokenizer(spark, folder).truncate(_docs(spark, folder).select("doc_id", "text"), BUDGET)
    return tokens.select("doc_id", _shown("tokens").alias("ids"))


@query("SELECT count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_other FROM documents")
def encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text comes back from its tokens, and those for which it doesn't."""
    docs = _docs(spark, folder).select("doc_id", "text")
    tokenizer = _tokenizer(spark, folder)
    back = tokenizer.decode(tokenizer.encode(docs)).withColumnRenamed("text", "decoded")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return docs.join(back, "doc_id").agg(F.count("*").alias("n_docs"), F.count(F.when(same, 1)).alias("n_equal"), F.count(F.when(~same, 1)).alias("n_other"))


_SUB = (
    f"p AS MATERIALIZED ({_MASK_SQL} SELECT token_id, piece, row_number() OVER (ORDER BY token_id) - 1 AS sub_id FROM mask JOIN tok_vocab USING (token_id) WHERE lang = 'news_feed'), "
    "rules2 AS (SELECT m.* FROM tok_merges m WHERE a IN (SELECT piece FROM p) AND b IN (SELECT piece FROM p) AND a || b IN (SELECT piece FROM p)), "
)


def _sub_tokens(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tokens of the evaluation texts by one source's subtokenizer in global ids, the source's mask)."""
    mask = cut(_mask(spark, folder).where("lang = 'news_feed'"))
    tokenizer = modular.ModularTokenizer(_model(spark, folder), {"news_feed": {r.token_id for r in mask.collect()}})
    texts = table(spark, folder, "heldout_items").select(F.col("item_id").alias("doc_id"), "text")
    return tokenizer.encode(texts, "news_feed", bos=False, eos=False), mask


@query(
    f"{ids_sql('SELECT item_id AS doc_id, text FROM heldout_items', 'rules2', 'p', _SUB)}, each_id AS (SELECT doc_id, unnest(range(len(ids))) AS k, unnest(ids) AS token_id FROM ids), "
    "s AS (SELECT doc_id, string_agg(sub_id::VARCHAR, ' ' ORDER BY k) AS sub_ids FROM each_id JOIN p USING (token_id) GROUP BY doc_id) SELECT doc_id, coalesce(sub_ids, '') AS sub_ids, array_to_string(ids, ' ') AS ids, TRUE AS same FROM ids LEFT JOIN s USING (doc_id)"
)
def subtokenizer_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation texts in the ids of one source's subtokenizer and, translated, in global ids; both are the same tokens."""
    tokens, mask = _sub_tokens(spark, folder)
    mapping = cut(vocab.id_map(mask.select("token_id")))
    inner = modular.global_to_sub(tokens, mapping)
    again = modular.sub_to_global(inner, mapping).withColumnRenamed("tokens", "again")
    return tokens.join(inner.withColumnRenamed("tokens", "sub"), "doc_id").join(again, "doc_id").select("doc_id", _shown("sub").alias("sub_ids"), _shown("tokens").alias("ids"), (F.col("tokens") == F.col("again")).alias("same"))


_TOKEN_STREAM = f"{_DOC_IDS}, tok AS MATERIALIZED (SELECT doc_id, {_BOUNDED} AS toks FROM ids), {_stream_sql('len(toks)', 'documents JOIN tok USING (doc_id)')}"


@query(
    f"{_TOKEN_STREAM}, flat AS (SELECT lang, subtok, b, flatten(list(toks[first + 1:first + grab] ORDER BY pos)) AS f FROM parts JOIN tok USING (doc_id) GROUP BY ALL), r AS (SELECT *, unnest(range({BATCH})) AS row FROM flat) "
    f"SELECT lang, subtok, b, row::INT AS row, array_to_string(f[row * {CONTEXT + 1} + 1:row * {CONTEXT + 1} + {CONTEXT}], ' ') AS x, array_to_string(f[row * {CONTEXT + 1} + 2:(row + 1) * {CONTEXT + 1}], ' ') AS y FROM r"
)
def batch_xy(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of inputs and targets of all full batches, in tokens of the project's tokenizer."""
    tokens = cut(_tokenizer(spark, folder).encode(_docs(spark, folder)))
    stream = _stream(spark, folder).drop("n_tokens").join(tokens.select("doc_id", F.size("tokens").cast("long").alias("n_tokens")), "doc_id")
    rows = batches.batch_rows(batches.spans(stream, N_TARGET), tokens, BATCH, CONTEXT)
    return rows.select("lang", "subtok", "b", "row", _shown("x").alias("x"), _shown("y").alias("y"))


@query(
    f"{ids_sql('SELECT item_id AS doc_id, text FROM heldout_items')}, s AS (SELECT flatten(list(ids ORDER BY doc_id)) AS f FROM ids), n AS (SELECT f, greatest(len(f) // 8192, 1) * 8 AS lines FROM s), r AS (SELECT f, unnest(range(lines)) AS line FROM n) "
    "SELECT (line // 8)::BIGINT AS batch, line % 8 AS row, array_to_string(list_resize(f[line * 1024 + 1:(line + 1) * 1024], 1024, 0), ' ') AS tokens FROM r"
)
def latency_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The token stream of the evaluation texts in batches for timing."""
    texts = table(spark, folder, "heldout_items").select(F.col("item_id").alias("doc_id"), "text")
    rows = reports.latency_batches(_tokenizer(spark, folder).encode(texts, bos=False, eos=False), 8, 1024)
    return rows.select("batch", "row", _shown("tokens").alias("tokens"))


_ITEM_IDS = ids_sql("SELECT item_id AS doc_id, text FROM heldout_items")
_FILL = f"list_resize([]::INT[], {PADDED} - least(len(ids), {PADDED}), 0)"


@query(f"{_ITEM_IDS} SELECT doc_id, array_to_string(list_concat(ids[1:{PADDED}], {_FILL}), ' ') AS on_the_right, array_to_string(list_concat({_FILL}, ids[1:{PADDED}]), ' ') AS on_the_left FROM ids")
def padded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of the evaluation texts filled up on either side to one length."""
    texts = table(spark, folder, "heldout_items").select(F.col("item_id").alias("doc_id"), "text")
    tokens = _tokenizer(spark, folder).encode(texts, bos=False, eos=False)
    return tokens.select("doc_id", _shown(batches.padded(F.col("tokens"), PADDED, 0)).alias("on_the_right"), _shown(batches.padded(F.col("tokens"), PADDED, 0, left=True)).alias("on_the_left"))


@query(f"{_ITEM_IDS} SELECT ((row_number() OVER (ORDER BY doc_id) - 1) // 16)::BIGINT AS batch, doc_id, ((max(len(ids)) OVER () + 63) // 64 * 64)::INT AS padded FROM ids")
def item_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation texts in batches of 16, with the length in tokens that all would be filled up to."""
    texts = table(spark, folder, "heldout_items").select(F.col("item_id").alias("doc_id"), "text")
    tokens = cut(_tokenizer(spark, folder).encode(texts, bos=False, eos=False))
    padded = tokens.agg(reports.padded_length("tokens", 64)).first()[0]
    return batches.numbered_batches(tokens.select("doc_id"), "doc_id", 16).withColumn("padded", F.lit(padded))


_USED = "used AS (SELECT lang, subtok, pos, sum(grab)::BIGINT AS used FROM parts WHERE b < 1 GROUP BY ALL), l AS (SELECT lang, subtok, max(pos) AS last_pos, arg_max(used, pos) AS last_n_tokens FROM used GROUP BY ALL)"


@query(
    f"WITH {_stream_sql()}, {_USED} SELECT s.lang, s.subtok, s.pos, s.doc_id, (CASE WHEN s.pos = last_pos THEN last_n_tokens ELSE 0 END)::BIGINT AS used FROM st s LEFT JOIN l ON l.lang = s.lang AND l.subtok = s.subtok "
    "WHERE (last_pos IS NULL OR s.pos >= last_pos) AND (CASE WHEN s.pos = last_pos THEN last_n_tokens ELSE 0 END) < n_tokens"
)
def restored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the stream when it is resumed after the first batch of each buffer; a snapshot that doesn't fit raises ValueError."""
    stream = cut(_stream(spark, folder))
    parts = batches.spans(stream, N_TARGET)
    state = cut(batches.snapshot(stream, parts, parts.select("lang", "subtok").distinct().withColumn("n_batches", F.lit(1))))
    facts = {"world_size": 1, "rank": 0, "seed": 41}
    if faults := batches.restore_faults(stream.where("n_tokens > 0"), state, facts, facts):
        raise ValueError("; ".join(faults))
    return batches.restore(stream, state).select("lang", "subtok", "pos", "doc_id", F.col("used").cast("long").alias("used"))


_PARTS = "SELECT DISTINCT rec_id AS doc_id, {0} AS text FROM parallel_items WHERE rec_id IS NOT NULL"


@query(
    f"WITH q AS MATERIALIZED ({ids_sql(_PARTS.format(chr(39) + 'en: ' + chr(39) + ' || coalesce(question, ' + chr(39) * 2 + ')'))} SELECT doc_id, ids FROM ids), "
    f"a AS MATERIALIZED ({ids_sql(_PARTS.format(chr(39) + ' out: ' + chr(39) + ' || coalesce(answer[1], ' + chr(39) * 2 + ')'), 'rules2', 'p', _SUB)} SELECT doc_id, ids FROM ids) "
    "SELECT doc_id, array_to_string(list_concat([(SELECT token_id FROM tok_vocab WHERE piece = '<s>')], list_concat(q.ids, a.ids)), ' ') AS ids FROM q JOIN a USING (doc_id)"
)
def token_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of translations whose questions are read with the whole vocabulary and whose answers with one source's subtokenizer."""
    items = table(spark, folder, "parallel_items").where("rec_id is not null").select("rec_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce(F.get("answer", F.lit(0)), F.lit("")).alias("a")).distinct()
    sides = F.array(F.struct(F.lit(0).alias("k"), F.lit("q").alias("side"), F.concat(F.lit("en: "), "q").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("a").alias("side"), F.concat(F.lit(" out: "), "a").alias("text")))
    parts = items.select(F.col("rec_id").alias("doc_id"), F.explode(sides).alias("x")).select("doc_id", "x.k", "x.side", "x.text")
    mask = _mask(spark, folder).where("lang = 'news_feed'")
    tokenizer = modular.ModularTokenizer(_model(spark, folder), {"news_feed": {r.token_id for r in mask.collect()}})
    return tokenizer.encode_parts(parts, {"q": None, "a": "news_feed"}).select("doc_id", _shown("tokens").alias("ids"))
