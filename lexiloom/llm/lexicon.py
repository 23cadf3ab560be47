"""Function words and language profiles, learned from the small labelled tables."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labelled texts of one language that models are fitted on, at most; taken in order of id.
TEXTS_A_LANGUAGE = 300
#: Most rows of the word list and of the table of languages; fixed tables (checked).
MAX_WORDS, MAX_LANGUAGES = 1_000_000, 10_000
#: Most entries of a worker's word cache; it is emptied when full.
CACHE_WORDS = 500_000


def _mark_ranges() -> str:
    """Regex ranges of the combining marks below U+20000."""
    marks = [c for c in range(0x20000) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c in marks if unicodedata.category(chr(c - 1))[0] != "M"]
    ends = [c for c in marks if unicodedata.category(chr(c + 1))[0] != "M"]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: A word: letters, marks and digits. It also takes underscores, so :func:`words_of` blanks them first.
_WORD = re.compile(rf"[\w{_mark_ranges()}]+")
_ACCENTS = re.compile("[̀-ͯ]+")
_HAN = re.compile("[㐀-鿿]+")
#: Token classes of a line: function word, other word, capitalised word, number, single letter, symbols, link.
CLASSES = FUNCTION, LOWER, CAPITAL, NUMBER, SINGLE, SYMBOL, LINK = range(7)


def words_of(text: str) -> list[str]:
    """The words of a text, as written."""
    return _WORD.findall(text.replace("_", " ") if "_" in text else text)


def fold(word: str) -> str:
    """A word without case and accents."""
    word = word.lower()
    return word if word.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFKD", word))


@dataclass
class Lexicon:
    """Function words by language, with the class of each word seen so far.

    A class code is the number of the class; for function words the bits above the third hold the languages.
    """

    langs: list[str]
    masks: dict[str, int]
    phrases: list[str]
    cache: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> tuple:
        return self.langs, self.masks, self.phrases

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.masks, self.phrases = state
        self.cache = {}
        self.phrase = re.compile("|".join(map(re.escape, sorted(self.phrases, key=len, reverse=True))) or "(?!)")
        self.unspaced = self.langs.index("zh") if "zh" in self.langs else -1

    def code(self, word: str) -> int:
        """The class code of one word."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        folded = fold(word)
        if any(c.isdigit() for c in word):
            code = NUMBER
        elif len(folded) < 2:
            code = SINGLE
        elif mask := self.masks.get(folded, 0):
            code = FUNCTION | mask << 3
        elif word[0].isupper() and not word.isupper():
            code = CAPITAL
        else:
            code = LOWER
        self.cache[word] = code
        return code

    def codes(self, words: list[str]) -> list[int]:
        """Class codes of words."""
        out = list(map(self.cache.get, words))
        if None in out:
            out = [self.code(w) if c is None else c for w, c in zip(words, out)]
        return out


def listed_words(common_words: DataFrame) -> dict[str, list[str]]:
    """The word list of each language on the driver. Null words are left out; a list of more than ``MAX_WORDS`` rows raises ValueError."""
    rows = common_words.where("lang is not null and word is not null").select("lang", "word").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError("the word list is too long")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.lang, []).append(r.word)
    return out


def read_lexicon(listed: dict[str, list[str]], languages: DataFrame) -> Lexicon:
    """The lexicon of the word lists. More than ``MAX_LANGUAGES`` languages raise ValueError."""
    langs = sorted({r.lang for r in languages.where("lang is not null").select("lang").limit(MAX_LANGUAGES + 1).collect()})
    if len(langs) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    masks: dict[str, int] = {}
    phrases = []
    for k, lang in enumerate(langs):
        for entry in listed.get(lang, []):
            if _HAN.search(entry):
                phrases.append(entry)
            for word in words_of(entry):
                masks[fold(word)] = masks.get(fold(word), 0) | 1 << k
    lexicon = Lexicon(langs, masks, phrases)
    lexicon.__setstate__(lexicon.__getstate__())
    return lexicon


def labelled_texts(heldout: DataFrame, std: DataFrame, parallel: DataFrame, per_lang: int = TEXTS_A_LANGUAGE) -> dict[str, list[str]]:
    """Natural prose with a trusted label: evaluation texts, questions and translations, at most ``per_lang`` a language."""
    parts = [
        heldout.select("lang", "text", F.col("item_id").alias("id")),
        std.select("lang", F.col("question").alias("text"), F.col("rec_id").alias("id")),
        parallel.select(F.col("target_lang").alias("lang"), F.explode("answer").alias("text"), F.col("rec_id").alias("id")),
    ]
    out: dict[str, list[str]] = {}
    for part in parts:
        first = Window.partitionBy("lang").orderBy("id", "text")
        rows = part.where(F.length("text") >= 40).where("lang is not null").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang)
        for r in sorted(rows.collect(), key=lambda r: (r.lang, r.n)):
            if len(out.setdefault(r.lang, [])) < per_lang:
                out[r.lang].append(r.text)
    return out
