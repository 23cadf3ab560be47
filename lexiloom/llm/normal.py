"""Texts apart from their form: words without case, accents, invisible characters, markup and punctuation."""

from __future__ import annotations

import html
import re

import xxhash

from lexiloom.llm.lexicon import CACHE_WORDS, fold, words_of

_INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|font|small|big|sup|sub|mark|code|tt)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")


def plain(text: str) -> str:
    """``text`` without markup, entities and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _INVISIBLE.sub("", text)


class WordHashes:
    """63-bit hashes of folded words, kept for the words seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _add(self, word: str) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        value = xxhash.xxh64_intdigest(fold(word)) >> 1
        self.known[word] = value
        return value

    def of(self, words: list[str]) -> list[int]:
        """Hashes of words."""
        out = list(map(self.known.get, words))
        if None in out:
            out = [self._add(w) if h is None else h for w, h in zip(words, out)]
        return out

    def of_text(self, text: str | None) -> list[int]:
        """Hashes of the words of a text; none of a null text."""
        return self.of(words_of(plain(text))) if text else []
