"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) with the later departures that ROUGE packages use.

These are: irregular forms; words of two letters stay; "ies" and "ied" after one letter keep the e; y after a vowel, or after a
single letter, stays; bli, alli, fulli and logi in step 2; and a vowel with a consonant counts as a short end.
"""

from __future__ import annotations

import re

#: Fixed values: (ending, replacement) of steps 2 and 3, and the endings of step 4, as in the paper and its departures.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Stems of irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """V for vowels and C for consonants; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "V" if c in "aeiou" or c == "y" and out[-1:] == "C" else "C"
    return out


def _measure(word: str) -> int:
    return len(re.findall("V+C+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "C"


def _short_end(word: str) -> bool:
    shape = _shape(word)
    return shape == "VC" or shape[-3:] == "CVC" and word[-1] not in "wxy"


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base + "l" if end == "logi" else base) == 0:
                return word
            return _swap(base + new, rules) if end == "alli" else base + new
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
        return _finish(word)
    cut = ""
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif word.endswith("ed") and "V" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "V" in _shape(word[:-3]):
        cut = word[:-3]
    if cut:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _double(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _short_end(cut):
            cut += "e"
        word = cut
    return _finish(word)


def _finish(word: str) -> str:
    """Steps 1c to 5."""
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "C":
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2), STEP_3)
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
