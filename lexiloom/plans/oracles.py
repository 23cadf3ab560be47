"""DuckDB SQL of the core queries. Patterns and the byte alphabet are written as rules, as in the operators."""

from __future__ import annotations

from lexiloom.functions.text import PRETOKEN, WHITE
from lexiloom.operators.metrics import BLEU_SPLIT, BLEU_UNDONE, CHINESE

#: Words of a text, and words by raw language label.
WORDS_OF = f"regexp_extract_all(text, '{PRETOKEN}')"
WORDS = f"words AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest({WORDS_OF}) AS word FROM documents) GROUP BY ALL)"
ALL_WORDS = f"words AS MATERIALIZED (SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS_OF}) AS word FROM documents) GROUP BY ALL)"
SOURCE = "nullif(replace(lower(trim(source)), '-', '_'), '')"
#: Byte alphabet: bytes that are printable stand for themselves, the others for the next code points from 256.
ALPHABET = """bytes AS MATERIALIZED (
  SELECT b, CASE WHEN shown THEN b ELSE 255 + sum((NOT shown)::INT) OVER (ORDER BY b) END::INT AS cp
  FROM (SELECT range::INT AS b, (range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range BETWEEN 174 AND 255) AS shown FROM range(256))),
alphabet AS MATERIALIZED (
  SELECT string_agg(chr(b), '' ORDER BY b) FILTER (b > 0 AND b <> cp) AS hidden, string_agg(chr(cp), '' ORDER BY b) FILTER (b > 0 AND b <> cp) AS shown FROM bytes)"""
AS_BYTES = "translate(array_to_string(list_transform(range(strlen(word)), lambda i: chr(('0x' || substr(hex(word), 2 * i + 1, 2))::INT)), ''), hidden, shown)"
SPLIT = f"regexp_replace({AS_BYTES}, '(?s)(.)', chr(1) || '\\1' || chr(2), 'g')"
SYMBOLS = "string_split(split[2:-2], chr(2) || chr(1))"


def byte_words(words: str, columns: str) -> str:
    """CTEs up to ``bw``: words with their marked byte symbols."""
    return f"WITH {words},\n{ALPHABET},\nbw AS MATERIALIZED (SELECT {columns}, {SPLIT} AS split FROM words, alphabet)"


def pairs(source: str, by: str = "") -> str:
    """A query for neighbouring symbols of ``source`` with frequencies."""
    cols = f"{by}, " if by else ""
    return (
        f"SELECT {cols}p[1] AS \"left\", p[2] AS \"right\", sum(freq)::BIGINT AS freq FROM (SELECT {cols}freq, unnest(list_transform(range(1, len(s)), lambda i: [s[i], s[i + 1]])) AS p "
        f"FROM (SELECT {cols}freq, {SYMBOLS} AS s FROM {source})) GROUP BY ALL"
    )


def bpe_merges(k: int) -> str:
    """CTEs m0 .. m(k-1), one row each, the merges of BPE from scratch."""
    steps = [byte_words(ALL_WORDS, "freq"), "w0 AS MATERIALIZED (SELECT freq, split FROM bw)", "v0 AS MATERIALIZED (SELECT chr(cp) AS token, 3 + row_number() OVER (ORDER BY cp) AS id FROM bytes)"]
    for i in range(k):
        steps.append(
            f"m{i} AS MATERIALIZED (SELECT \"left\", \"right\" FROM ({pairs(f'w{i}')}) p JOIN v{i} x ON x.token = \"left\" JOIN v{i} y ON y.token = \"right\" ORDER BY freq DESC, x.id, y.id LIMIT 1)"
        )
        steps.append(
            f"w{i + 1} AS MATERIALIZED (SELECT freq, replace(split, chr(1) || \"left\" || chr(2) || chr(1) || \"right\" || chr(2), chr(1) || \"left\" || \"right\" || chr(2)) AS split FROM w{i}, m{i})"
        )
        steps.append(f"v{i + 1} AS MATERIALIZED (SELECT * FROM v{i} UNION ALL SELECT \"left\" || \"right\", (SELECT max(id) + 1 FROM v{i}) FROM m{i} WHERE \"left\" || \"right\" NOT IN (SELECT token FROM v{i}))")
    return ",\n".join(steps)


def encoded(words: str, columns: str, rules: str = "tok_merges", least: str = "TRUE") -> str:
    """CTEs up to ``enc``: words with the number of their tokens and the marked tokens, by folding all merges in order."""
    fold = "list_reduce(list_prepend({'p': '', 'r': split}, rules), lambda acc, m: {'p': '', 'r': replace(acc.r, m.p, m.r)}).r"
    return (
        byte_words(words, columns)
        + f""",
ruleset AS MATERIALIZED (SELECT list({{'p': chr(1) || a || chr(2) || chr(1) || b || chr(2), 'r': chr(1) || a || b || chr(2)}} ORDER BY merge_no) AS rules FROM {rules} WHERE {least}),
distinct_splits AS MATERIALIZED (SELECT DISTINCT split FROM bw),
folded AS MATERIALIZED (SELECT split, {fold} AS done FROM distinct_splits, ruleset),
enc AS MATERIALIZED (SELECT bw.*, done, len(done) - len(replace(done, chr(1), '')) AS n_tok FROM bw JOIN folded USING (split))"""
    )


def answer_words(c: str) -> str:
    """Words of an answer without punctuation and articles."""
    bare = f"translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
    return f"list_filter(string_split(trim(regexp_replace({bare}, '[{WHITE}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def bleu_words(c: str, chinese: str | None = None) -> str:
    """Lower-case words by the 13a tokenizer, or its Chinese variant where ``chinese`` holds."""
    undone = f"lower({c})"
    for old, new in BLEU_UNDONE:
        undone = f"replace({undone}, '{old}', '{new}')".replace("\n", "' || chr(10) || '")
    if chinese is not None:
        undone = f"CASE WHEN {chinese} THEN regexp_replace(trim(lower({c})), '([{CHINESE}])', ' \\1 ', 'g') ELSE {undone} END"
    out = f"(' ' || {undone} || ' ')"
    for pattern, new in BLEU_SPLIT:
        sql = new.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{sql}', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({out}, '[{WHITE}]+', ' ', 'g')), ' '), lambda w: w <> '')"


def continued_bpe(k: int, longest: int | None = None) -> str:
    """CTEs m0 .. m(k-1), the candidates taken when training goes on over the tok_merges tokenizer; single symbols have an empty right part.

    Tokens of more than ``longest`` symbols are no candidates.
    """
    allowed = "TRUE" if longest is None else f'length("left" || "right") <= {longest}'
    steps = [
        encoded(ALL_WORDS, "freq"),
        "w0 AS MATERIALIZED (SELECT done AS split, sum(freq)::BIGINT AS freq FROM enc GROUP BY done)",
        f"u AS MATERIALIZED (SELECT split[2:-2] AS \"left\", '' AS \"right\", sum(freq)::BIGINT AS freq FROM w0 WHERE len({SYMBOLS}) = 1 GROUP BY ALL)",
    ]
    for i in range(k):
        taken = "".join(f' AND "left" NOT IN (SELECT "left" FROM m{j} WHERE "right" = \'\')' for j in range(i))
        steps.append(f"m{i} AS MATERIALIZED (SELECT \"left\", \"right\" FROM ({pairs(f'w{i}')} UNION ALL SELECT \"left\", \"right\", freq FROM u WHERE TRUE{taken}) WHERE {allowed} ORDER BY freq DESC, \"left\", \"right\" LIMIT 1)")
        merged = "replace(split, chr(1) || \"left\" || chr(2) || chr(1) || \"right\" || chr(2), chr(1) || \"left\" || \"right\" || chr(2))"
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT freq, CASE WHEN \"right\" = '' THEN split ELSE {merged} END AS split FROM w{i}, m{i})")
    return ",\n".join(steps)
