"""Column expressions on text: pre-tokenization, byte alphabet, label clean-up.

All of them are built-in expressions, so they stay inside code generation. A null text gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, written out so that every regex engine reads the same set.
WHITE = r"\t-\r\x{85}\p{Z}"
#: Fixed value: the mark-aware split of the byte-level tokenizers (letters keep their marks).
PRETOKEN = rf" ?[\p{{L}}\p{{M}}]+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next unused code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_ALPHABET = byte_alphabet()
_HIDDEN = "".join(chr(b) for b in range(256) if _ALPHABET[b] != chr(b))
_SHOWN = "".join(_ALPHABET[ord(c)] for c in _HIDDEN)


def pretokens(text: Column | str) -> Column:
    """The words of a text; joined together they give the text back."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def to_bytes_alphabet(word: Column | str) -> Column:
    """UTF-8 bytes of a word, each shown as one character of the byte alphabet."""
    word = F.col(word) if isinstance(word, str) else word
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, _HIDDEN, _SHOWN)


def py_to_bytes_alphabet(word: str) -> str:
    """Same as :func:`to_bytes_alphabet` for a Python string."""
    return "".join([_ALPHABET[b] for b in word.encode("utf-8", "replace")])


def clean_source(source: Column | str) -> Column:
    """A source name without case, surrounding blanks and hyphens; null and blank become null."""
    source = F.col(source) if isinstance(source, str) else source
    return F.nullif(F.replace(F.lower(F.trim(source)), F.lit("-"), F.lit("_")), F.lit(""))


def label_key(label: Column | str) -> Column:
    """First part of a language label, lower case: ' en', 'en_EN', 'EN-001' give 'en'; blank gives null."""
    label = F.col(label) if isinstance(label, str) else label
    return F.nullif(F.split_part(F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)), F.lit(""))
