"""Languages of texts by prediction by partial matching (problem 5).

For each language a tree of byte contexts of up to ``ORDER`` bytes holds frozen counts from labelled texts. A byte costs
-log2 of its share in the longest context that has it; each longer context without it costs an escape (method C: the share of its
different bytes among all counts and different bytes). Contexts begin at the word's own boundary, so the exact code length of a
word depends on the word alone and is computed once for each word that a worker meets, for all languages at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from lexiloom.llm.lexicon import fold, words_of

#: Longest context in bytes.
ORDER = 5
#: Weight of each word of the word lists in the counts of its language.
LISTED = 20
#: Most words that a worker keeps with their code lengths.
KEPT_WORDS = 200_000
_HAN = re.compile("[㐀-鿿]")


class ContextTrees:
    """Code lengths (bits) of words under each language."""

    def __init__(self, texts: dict[str, list[str]], listed: dict[str, list[str]], langs: list[str]):
        self.langs = langs
        counts: list[dict[bytes, Counter[int]]] = []
        for lang in langs:
            words = Counter(units(" ".join(listed.get(lang, []))))
            for word in words:
                words[word] = LISTED
            for text in texts.get(lang, []):
                words.update(units(text))
            tree: dict[bytes, Counter[int]] = {}
            for word, n in words.items():
                code = _bytes(word)
                for i in range(1, len(code)):
                    for k in range(min(i, ORDER) + 1):
                        tree.setdefault(code[i - k : i], Counter())[code[i]] += n
            counts.append(tree)
        self._freeze(counts)

    def _freeze(self, counts: list[dict[bytes, Counter[int]]]) -> None:
        """Rows of code lengths for each context with a next byte, and of escapes for each context."""
        n = len(self.langs)
        nodes: dict[bytes, list[tuple[int, Counter[int]]]] = {}
        for k, tree in enumerate(counts):
            for context, following in tree.items():
                nodes.setdefault(context, []).append((k, following))
        rows: list[np.ndarray] = [np.full(n, 8.0)]  # order -1: any byte
        self.symbols: dict[bytes, int] = {}
        self.escapes: dict[bytes, int] = {}
        for context in sorted(nodes, key=len):
            escape = np.zeros(n)
            totals = {}
            for k, following in nodes[context]:
                total, kinds = following.total(), len(following)
                escape[k] = -math.log2(kinds / (total + kinds))
                totals[k] = total + kinds
            self.escapes[context] = len(rows)
            rows.append(escape)
            for symbol in sorted({s for _, following in nodes[context] for s in following}):
                shorter = rows[self._symbol(context[1:], symbol)] if context else rows[0]
                row = escape + shorter
                if context:
                    row = row + self._skipped(context[1:], symbol, rows)
                for k, following in nodes[context]:
                    if symbol in following:
                        row[k] = -math.log2(following[symbol] / totals[k])
                self.symbols[context + bytes([symbol])] = len(rows)
                rows.append(row)
        self.table = np.array(rows, np.float32)
        self.reset()

    def _symbol(self, context: bytes, symbol: int) -> int:
        """Row of the longest context, from ``context`` on, in which some language has the byte; 0 if none has."""
        while True:
            row = self.symbols.get(context + bytes([symbol]))
            if row is not None:
                return row
            if not context:
                return 0
            context = context[1:]

    def _skipped(self, context: bytes, symbol: int, rows: list[np.ndarray]) -> np.ndarray:
        """Escapes of the contexts that :meth:`_symbol` passes over."""
        out = np.zeros(len(self.langs))
        while context + bytes([symbol]) not in self.symbols:
            if context in self.escapes:
                out = out + rows[self.escapes[context]]
            if not context:
                break
            context = context[1:]
        return out

    def reset(self) -> None:
        """Forget the words met."""
        self.rows: dict[str, int] = {}
        self.known = np.zeros((1024, len(self.langs)), np.float32)

    def __getstate__(self) -> tuple:
        return self.langs, self.symbols, self.escapes, self.table

    def __setstate__(self, state: tuple) -> None:
        self.langs, self.symbols, self.escapes, self.table = state
        self.reset()

    def word_bits(self, word: str) -> np.ndarray:
        """Code length of one word under each language."""
        code, picked = _bytes(word), []
        symbols, escapes = self.symbols, self.escapes
        for i in range(1, len(code)):
            for k in range(min(i, ORDER), -1, -1):
                row = symbols.get(code[i - k : i + 1])
                if row is not None:
                    picked.append(row)
                    break
                escape = escapes.get(code[i - k : i])
                if escape is not None:
                    picked.append(escape)
            else:
                picked.append(0)
        return self.table[picked].sum(0)

    def _add(self, word: str) -> int:
        if len(self.rows) >= len(self.known):
            grown = np.zeros((2 * len(self.known), len(self.langs)), np.float32)
            grown[: len(self.known)] = self.known
            self.known = grown
        row = len(self.rows)
        self.known[row] = self.word_bits(word)
        self.rows[word] = row
        return row

    def word_rows(self, words: list[str]) -> np.ndarray:
        """A row for each word, its code length under each language."""
        if len(self.rows) > KEPT_WORDS:
            self.reset()
        rows = list(map(self.rows.get, words))
        if None in rows:
            rows = [self.rows[w] if r is None and w in self.rows else self._add(w) if r is None else r for w, r in zip(words, rows)]
        return self.known[rows]

    def bits(self, words: list[str]) -> np.ndarray:
        """Code length of words under each language."""
        return self.word_rows(words).sum(0)


def _bytes(word: str) -> bytes:
    return b" " + fold(word).encode("utf-8", "replace") + b" "


def units(text: str, words: list[str] | None = None) -> list[str]:
    """The words of a text, or ``words`` if they are known; where it has no blanks, its single characters."""
    words = words_of(text) if words is None else words
    if text.isascii() or not _HAN.search(text):
        return words
    out = []
    for word in words:
        if _HAN.match(word):
            out += word
        else:
            out.append(word)
    return out


#: A sentence of less is not told apart from the text around it: words (characters where there are no blanks), bits ahead of the next language.
SENTENCE_WORDS, SENTENCE_BITS = 5, 20.0
_SENTENCE = re.compile(r"[^.!?…।。！？]+[.!?…।。！？]*[\"”'»’)\]]*")
_QUOTE = re.compile(r"[“«„][^“”«»„]{25,}[”»“]")
_TERMINATED = tuple(".!?…।。！？")
_CLOSING = "\"”'»’)] \r\t"


def sentences(lines: list[tuple[int, str]]) -> list[tuple[int, str, bool]]:
    """(line, text, full) of the sentences of a document; a sentence over two lines gives a part in each, neither full.

    ``lines`` are (number, cleaned text) of the lines that hold prose. Where most lines end inside of sentences the text is
    hard-wrapped; where there are no ends of sentences at all, each line is one.
    """
    ends = [t.rstrip(_CLOSING).endswith(_TERMINATED) for _, t in lines]
    marks = sum(t.count(m) for _, t in lines for m in _TERMINATED)
    wrapped = len(lines) > 2 and sum(ends) < 0.5 * len(lines) and marks > 0.3 * len(lines)
    out: list[tuple[int, str, bool]] = []
    open_before = False
    for (number, text), ended in zip(lines, ends):
        parts = []
        for chunk in _split_quotes(text):
            parts += [p for p in _SENTENCE.findall(chunk) if not p.isspace()]
        for k, part in enumerate(parts):
            full = True
            if wrapped and (k == 0 and open_before or k == len(parts) - 1 and not ended):
                full = False
            out.append((number, part, full))
        open_before = wrapped and not ended
    return out


def _split_quotes(text: str) -> list[str]:
    """``text`` cut around quotations that are long enough to be sentences."""
    out, at = [], 0
    for m in _QUOTE.finditer(text):
        if len(m.group().split()) >= SENTENCE_WORDS or _HAN.search(m.group()):
            out += [text[at : m.start()], m.group()]
            at = m.end()
    return [x for x in [*out, text[at:]] if x]


def greatest_gain(bits: np.ndarray, whole: int) -> float:
    """The most that any run of words is shorter under another language than under ``whole``."""
    ahead = np.zeros((len(bits) + 1, bits.shape[1]))
    np.cumsum(bits[:, whole : whole + 1] - bits, axis=0, out=ahead[1:])
    return float((ahead - np.minimum.accumulate(ahead, axis=0)).max())


def document_languages(lines: list[tuple[int, str, list[str]]], trees: ContextTrees) -> tuple[int, float, list[tuple[int, int]]]:
    """(main language or -1, confidence, (line, language) of the full sentences) of the lines (number, text, words) of a document.

    The confidence is the share of the text's probability that the main language has among all languages, a byte of text
    taken for a 64th so that long texts don't all have 1.0, times its share of the characters. Where no run of words can
    make a sentence of another language, the text isn't cut into sentences and no lines are given.
    """
    words = [w for _, text, found in lines for w in units(text, found)]
    if not words:
        return -1, 0.0, []
    each = trees.word_rows(words)
    total = each.sum(0, dtype=float)
    whole = int(total.argmin())
    spread = np.exp2(-(total - total.min()) / 64)
    confidence = float(spread[whole] / spread.sum())
    if greatest_gain(each, whole) < SENTENCE_BITS:
        return whole, confidence, []
    parts = [(number, len(text), full, words) for number, text, full in sentences([x[:2] for x in lines]) if (words := units(text))]
    if not parts:
        return whole, confidence, []
    n_words = np.array([len(words) for *_, words in parts])
    bits = np.add.reduceat(trees.word_rows([w for *_, words in parts for w in words]), np.cumsum(n_words) - n_words, axis=0)
    lang = bits.argmin(1)
    sure = (n_words >= SENTENCE_WORDS) & (bits[:, whole] - bits.min(1) >= SENTENCE_BITS)
    lang = np.where(sure, lang, whole)
    chars = np.bincount(lang, weights=[size for _, size, *_ in parts], minlength=len(trees.langs))
    main = int(chars.argmax())
    confidence *= float(chars[main] / chars.sum())
    kept = {(number, k) for (number, _, full, _), k, n in zip(parts, lang.tolist(), n_words.tolist()) if full and n >= SENTENCE_WORDS}
    return main, confidence, sorted(kept | _short_lines(parts, lang.tolist(), n_words.tolist(), main, {number for number, _ in kept}))


def _short_lines(parts: list[tuple], lang: list[int], n_words: list[int], main: int, told: set[int]) -> set[tuple[int, int]]:
    """(line, language) of lines whose full sentences are all short: that of the longer sentences around them if these agree, else the main one."""
    out, before, following = set(), None, None
    after = [None] * len(parts)
    for i in range(len(parts) - 1, -1, -1):
        after[i] = following
        following = lang[i] if n_words[i] >= SENTENCE_WORDS else following
    for i, (number, _, full, _) in enumerate(parts):
        if n_words[i] >= SENTENCE_WORDS:
            before = lang[i]
        elif full and number not in told:
            near = {x for x in (before, after[i]) if x is not None}
            out.add((number, near.pop() if len(near) == 1 else main))
    return out
