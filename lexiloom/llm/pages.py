"""Structure of documents: natural prose, lists, tables, code, links, junk, keyword pages (problems 3 and 8).

Each line is a distribution over classes of tokens (function words, other words, capitalised words, numbers, single letters,
symbols, links). It gets the nearest of a set of profiles by Jensen-Shannon divergence: a prose profile of its language, fitted on
labelled texts, or one of the structural profiles. A document is as much prose as its lines are, by characters.

Keyword pages are found by rank-frequency curves: SQL windows rank the content words of each page, a line is fitted to
log count over log rank, and the page is compared with prose of its language at comparable length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiloom.llm.contexts import ContextTrees, document_languages
from lexiloom.llm.lexicon import CAPITAL, CLASSES, FUNCTION, LINK, LOWER, NUMBER, SINGLE, SYMBOL, Lexicon, fold, words_of

#: Shares of token classes in lines that aren't prose, in the order of ``CLASSES`` (parameters of the operator).
STRUCTURES: dict[str, tuple[float, ...]] = {
    "list": (0.00, 0.68, 0.25, 0.02, 0.02, 0.03, 0.00),
    "names": (0.00, 0.20, 0.72, 0.02, 0.04, 0.02, 0.00),
    "entries": (0.00, 0.40, 0.22, 0.30, 0.03, 0.05, 0.00),
    "table": (0.00, 0.20, 0.12, 0.48, 0.02, 0.18, 0.00),
    "code": (0.00, 0.42, 0.08, 0.12, 0.03, 0.35, 0.00),
    "encoded": (0.00, 0.25, 0.30, 0.30, 0.05, 0.10, 0.00),
    "symbols": (0.02, 0.08, 0.02, 0.05, 0.33, 0.50, 0.00),
    "links": (0.02, 0.20, 0.10, 0.05, 0.02, 0.11, 0.50),
}
#: Prose of a language without labelled texts.
DEFAULT_PROSE = (0.48, 0.38, 0.07, 0.03, 0.02, 0.02, 0.00)
#: Documents that a worker profiles at once.
BLOCK = 400

_ANCHOR = re.compile(r"<a\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"]+")
_LINK_MARK = "\x01"
_SYMBOLS = re.compile(r"[^\w\s.,!?;:'\"()“”‘’«»„।。，、！？：；\-–—\x01̀-ͯऀ-෿​-‏]+|[.,;:'\"()!?\-]{2,}")
_HASHTAG = re.compile(r"#\w[^\s#]*")
_PRODUCT = re.compile(r"\b[A-Z]{2,6}-\d{3,}\b|\b\d+[.,]\d\d ?(?:EUR|USD|GBP|CHF|SEK|PLN|RUB|INR|CNY|[€$£])|[€$£] ?\d+[.,]\d\d")
_CODE = re.compile(r"\w\(|[{}]|\s[-+*/!<>=]?=\s|=>|->|::|</")
_SPEAKER = re.compile(r"\s*[^\s:]{1,40}(?: [^\s:]{1,40})?:\s")
_HAN_FROM = "\u3400"
_HAN_CHARS = re.compile("[㐀-鿿]")
_PUNCT_END = tuple(".!?;:…।。！？”\"»'")
_SEGMENTS = re.compile(r"[.!?。！？।|/·;,、，•\t\n]+|\s[-–—»>*+]+\s|#")


def clean_line(line: str) -> str:
    """A line without entities and markup; each link is one mark."""
    if "&" in line:
        line = html.unescape(line)
    if "<" in line:
        line = _TAG.sub("", _ANCHOR.sub(f" {_LINK_MARK} ", line))
    if "://" in line or "www." in line:
        line = _URL.sub(f" {_LINK_MARK} ", line)
    return line


def line_counts(line: str, lexicon: Lexicon) -> tuple[list[int], int, list[str], list[int], int, int]:
    """(tokens of each class, best language or -1, words, their codes, words in any word list, words) of a cleaned line.

    In text without blanks two characters count as a word, and those in listed phrases as listed.
    """
    words = words_of(line)
    codes = lexicon.codes(words)
    counts = [0] * len(CLASSES)
    votes: dict[int, int] = {}
    by_code = Counter(codes)
    for code, n in by_code.items():
        if code < 8 and code != FUNCTION:
            counts[code] += n
        else:
            votes[code >> 3] = votes.get(code >> 3, 0) + n
    lang, best = -1, 0
    if votes:
        tally: dict[int, int] = {}
        for mask, n in votes.items():
            k = 0
            while mask:
                if mask & 1:
                    tally[k] = tally.get(k, 0) + n
                mask >>= 1
                k += 1
        lang, best = max(tally.items(), key=lambda x: (x[1], -x[0]))
        counts[FUNCTION] = best
        counts[LOWER] += sum(votes.values()) - best
    listed, n_words = sum(votes.values()), len(words)
    if by_code.get(SINGLE):
        listed += sum([fold(w) in lexicon.masks for w, c in zip(words, codes) if c == SINGLE])
    if not line.isascii() and lexicon.unspaced >= 0 and (han := len(_HAN_CHARS.findall(line))) > 0.3 * len(line.replace(" ", "")):
        covered = sum(map(len, lexicon.phrase.findall(line)))
        # Unspaced text: two characters count as a word.
        counts[FUNCTION], counts[LOWER], lang = covered // 2, (han - covered) // 2, lexicon.unspaced
        spaced = [c for w, c in zip(words, codes) if not _HAN_CHARS.search(w)]
        listed, n_words = covered // 2 + sum([c > 7 for c in spaced]), han // 2 + len(spaced)
    counts[SYMBOL] = len(_SYMBOLS.findall(line))
    counts[LINK] = line.count(_LINK_MARK)
    return counts, lang, words, codes, listed, n_words


def prose_profiles(texts: dict[str, list[str]], lexicon: Lexicon) -> np.ndarray:
    """A profile for each language of the lexicon and, last, the default one."""
    out = np.array([DEFAULT_PROSE] * (len(lexicon.langs) + 1))
    for k, lang in enumerate(lexicon.langs):
        total = np.zeros(len(CLASSES))
        for text in texts.get(lang, []):
            for line in text.split("\n"):
                total += line_counts(clean_line(line), lexicon)[0]
        if total.sum() > 200:
            out[k] = total / total.sum()
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of ``p`` from the distribution(s) ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return (a + b) / 2


class Profiler:
    """Profiles documents; ``names[0]`` is prose."""

    def __init__(self, lexicon: Lexicon, prose: np.ndarray):
        self.lexicon, self.prose = lexicon, prose
        self.names = ["prose", *STRUCTURES]
        self.shapes = np.array(list(STRUCTURES.values()))

    def classify(self, counts: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Index of the nearest profile of each line; -1 for lines without tokens."""
        total = counts.sum(1, keepdims=True)
        p = counts / np.maximum(total, 1)
        far = np.stack([divergence(p, self.prose[langs]), *(divergence(p, s) for s in self.shapes)], axis=1)
        near = far.argmin(1)
        near[total[:, 0] == 0] = -1
        return near

    def lines(self, texts: list[str]) -> tuple[list[int], list[str], list[str], np.ndarray, np.ndarray, np.ndarray, list, list[int]]:
        """(document, raw line, cleaned line, classes, languages, profile, (words, codes, listed words, all words), number) of each line that isn't blank."""
        owner, raw, cleaned, counts, langs, tokens, numbers = [], [], [], [], [], [], []
        for i, text in enumerate(texts):
            for number, line in enumerate(text.split("\n"), 1):
                if not line or line.isspace():
                    continue
                numbers.append(number)
                c = clean_line(line)
                n, lang, *found = line_counts(c, self.lexicon)
                owner.append(i)
                raw.append(line)
                cleaned.append(c)
                counts.append(n)
                langs.append(lang)
                tokens.append(tuple(found))
        matrix, lang = np.array(counts, float).reshape(-1, len(CLASSES)), np.array(langs, int)
        near = self.classify(matrix, lang)
        # A line of a few words doesn't tell; it goes with the line before it.
        for j in np.flatnonzero((matrix[:, FUNCTION : SINGLE + 1].sum(1) < 4) & (near > 0) & (matrix[:, LINK] == 0)):
            if j and owner[j - 1] == owner[j] and near[j - 1] == 0 and not raw[j - 1].rstrip().endswith(_PUNCT_END) and len(raw[j - 1]) > 30:
                near[j] = 0
        return owner, raw, cleaned, matrix, lang, near, tokens, numbers


def content_units(text: str, lexicon: Lexicon) -> list[str]:
    """What counts as a word on a rank-frequency curve: words, or pairs of characters where a text has no blanks."""
    words = words_of(text)
    if text.isascii() or not _HAN_CHARS.search(text):
        return [w.lower() for w in words]
    out = []
    for word in words:
        if word[0] < _HAN_FROM:
            out.append(word.lower())
        else:
            for run in lexicon.phrase.sub(" ", word).split():
                out += [run[k : k + 2] for k in range(max(1, len(run) - 1))]
    return out


def list_marks(raw: str, counts: np.ndarray) -> int:
    """Links, hashtags or product labels of a line that isn't prose, where it is an entry of a list of those; else 0."""
    if counts[LINK]:
        return int(counts[LINK])
    if "#" in raw:
        tags = _HASHTAG.findall(raw)
        if len("".join(tags)) > 0.5 * len(raw.replace(" ", "")):
            return len(tags)
    return 0 if "=" in raw or "{" in raw else len(_PRODUCT.findall(raw))


def profile_block(ids: list[int], texts: list[str], profiler: Profiler, trees: ContextTrees | None = None) -> list[tuple]:
    """A row of :data:`PROFILE` for each document; with ``trees`` also its languages: of its lines of prose, or of all lines if those are less than half."""
    owner, raw, cleaned, counts, langs, near, tokens, numbers = profiler.lines(texts)
    bounds = np.searchsorted(np.array(owner, int), np.arange(len(texts) + 1))
    unspaced = profiler.lexicon.unspaced if profiler.lexicon.unspaced >= 0 else None
    units = counts[:, FUNCTION : SINGLE + 1].sum(1)
    out = []
    for i, (doc_id, text) in enumerate(zip(ids, texts)):
        a, b = bounds[i], bounds[i + 1]
        size = [len(raw[j]) - raw[j].count(" ") for j in range(a, b)]
        whole = sum(size)
        by_shape = [0] * len(profiler.names)
        listed, marks, ends, n_words, letters, odd, common, spoken = 0, 0, 0, 0, 0, 0, 0, 0
        by_lang: Counter[int] = Counter()
        by_words: Counter[int] = Counter()
        content: Counter[str] = Counter()
        seen: set[str] = set()
        parts: list[int] = []
        for j in range(a, b):
            words, codes, in_lists, of_line = tokens[j]
            n_words += len(words)
            common += in_lists
            spoken += of_line
            letters += sum(map(len, words))
            ends += raw[j].rstrip().endswith(_PUNCT_END)
            shape = near[j]
            if shape < 0:
                shape = profiler.names.index("symbols")
            by_shape[shape] += size[j - a]
            if langs[j] >= 0:
                by_words[int(langs[j])] += size[j - a]
            if shape == 0:
                by_lang[int(langs[j])] += size[j - a]
                if raw[j] in seen:  # refrains
                    continue
                seen.add(raw[j])
            elif in_line := list_marks(raw[j], counts[j]):
                listed += size[j - a]
                marks += in_line
                continue
            if counts[j][NUMBER] > 0.25 * len(words) or shape and _CODE.search(cleaned[j]):
                continue
            skip = 0
            if shape == 0 and (speaker := _SPEAKER.match(cleaned[j])):
                skip = len(words_of(speaker.group()))
            if langs[j] == unspaced:
                content.update(content_units(cleaned[j], profiler.lexicon))
            else:
                content.update([w.lower() for w, c in zip(words[skip:], codes[skip:]) if (c == LOWER or c == CAPITAL) and len(w) > 2])
            parts.append(j)
        spectrum = Counter(content.values())
        held: Counter[tuple[int, bool]] = Counter()
        most = max(spectrum, default=0)
        # Inside of sentences a keyword occurs more than LEAST times, so most short pages of prose end here.
        if most >= LEAST and (most > LEAST or any(near[j] for j in parts)):
            for j in parts:
                for part in _SEGMENTS.split(cleaned[j]):
                    if part and not part.isspace():
                        top = max([content.get(w, 0) for w in content_units(part, profiler.lexicon)], default=0)
                        if top >= 2:
                            held[top, bool(near[j] == 0)] += len(part) - part.count(" ")
        n_tokens = int(counts[a:b].sum())
        odd = int(counts[a:b, SYMBOL].sum())
        lang = max(by_lang.items(), key=lambda x: x[1])[0] if by_lang else -1
        words_lang = lang if lang >= 0 else max(by_words.items(), key=lambda x: x[1])[0] if by_words else -1
        main, confidence, segments = -1, 0.0, []
        if trees is not None and whole:
            is_prose = 2 * by_shape[0] >= whole
            main, confidence, segments = document_languages([(numbers[j], cleaned[j], tokens[j][0]) for j in range(a, b) if near[j] == 0 or not is_prose], trees)
        out.append((
            doc_id, len(text), n_words, letters / n_words if n_words else 0.0, odd / n_tokens if n_tokens else 0.0, ends / (b - a) if b > a else 0.0,
            common / max(1, spoken), int(units[a:b].sum()), whole, by_shape[0], listed, marks, profiler.names[max(range(len(by_shape)), key=lambda k: by_shape[k])] if whole else "empty",
            profiler.lexicon.langs[lang] if lang >= 0 else None, profiler.lexicon.langs[words_lang] if words_lang >= 0 else None, trees.langs[main] if main >= 0 else None, confidence, sorted(spectrum.items(), reverse=True), [(n, p, chars) for (n, p), chars in sorted(held.items(), reverse=True)],
            [(number, trees.langs[k]) for number, k in segments],
        ))
    return out


#: One row a document. ``common_word_share``: share of its words that stand in the word list of any language; ``words_lang``: the language of its prose or, without prose, of all its lines; ``spectrum``: how many content words occur how often; ``held``: characters of segments by their most frequent word.
PROFILE = pa.schema([
    ("doc_id", pa.int64()), ("n_code_points", pa.int32()), ("n_words", pa.int32()), ("mean_word_len", pa.float64()), ("symbol_ratio", pa.float64()),
    ("line_end_punct", pa.float64()), ("common_word_share", pa.float64()), ("n_units", pa.int32()), ("n_chars_dense", pa.int32()), ("prose_chars", pa.int32()), ("listed_chars", pa.int32()), ("n_marks", pa.int32()),
    ("structure", pa.string()), ("prose_lang", pa.string()), ("words_lang", pa.string()), ("main_lang", pa.string()), ("confidence", pa.float64()),
    ("spectrum", pa.list_(pa.struct([("n", pa.int32()), ("words", pa.int32())]))), ("held", pa.list_(pa.struct([("n", pa.int32()), ("prose", pa.bool_()), ("chars", pa.int32())]))),
    ("line_langs", pa.list_(pa.struct([("line_no", pa.int32()), ("lang", pa.string())]))),
])
_DDL = (
    "doc_id long, n_code_points int, n_words int, mean_word_len double, symbol_ratio double, line_end_punct double, common_word_share double, n_units int, n_chars_dense int, "
    "prose_chars int, listed_chars int, n_marks int, structure string, prose_lang string, words_lang string, main_lang string, confidence double, "
    "spectrum array<struct<n: int, words: int>>, held array<struct<n: int, prose: boolean, chars: int>>, line_langs array<struct<line_no: int, lang: string>>"
)


def _structs(lists: tuple, kind: pa.DataType) -> pa.ListArray:
    """Lists of tuples as an array of lists of structs."""
    flat = [x for part in lists for x in part]
    fields = list(kind.value_type)
    columns = list(zip(*flat)) or [()] * len(fields)
    offsets = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields))


def profile_documents(docs: DataFrame, lexicon: Lexicon, prose: np.ndarray, trees: ContextTrees | None = None) -> DataFrame:
    """(doc_id, text, ...) -> :data:`PROFILE`, a row for each doc_id that isn't null; a null text counts as empty.

    Languages are filled in only with ``trees``, and only for documents with words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, prose, trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *models, contexts = shared.value
        profiler = Profiler(*models)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = profile_block(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()], profiler, contexts)
                cols = list(zip(*rows))
                arrays = [pa.array(c, f.type) for c, f in zip(cols[:17], list(PROFILE)[:17])]
                arrays += [_structs(c, f.type) for c, f in zip(cols[17:], list(PROFILE)[17:])]
                yield pa.RecordBatch.from_arrays(arrays, schema=PROFILE)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _DDL)


def rank_frequency(profiles: DataFrame) -> DataFrame:
    """(doc_id, top, slope, residual): the rank-frequency curve of the content words of each page.

    Words of one count are one point with their number as weight, at the mean of their ranks. ``slope`` is that of the weighted
    least-squares line through log count over log rank, ``residual`` the largest distance of log count from it. Pages with
    content words of one count only have slope 0.
    """
    points = profiles.select("doc_id", F.explode("spectrum").alias("p")).select("doc_id", "p.n", "p.words")
    upto = Window.partitionBy("doc_id").orderBy(F.desc("n"))
    points = points.withColumn("x", F.log(F.sum("words").over(upto) - (F.col("words") - 1) / 2)).withColumn("y", F.log("n"))
    page = Window.partitionBy("doc_id")
    weight = F.sum("words").over(page)
    points = points.withColumn("mx", F.sum(F.expr("words * x")).over(page) / weight).withColumn("my", F.sum(F.expr("words * y")).over(page) / weight)
    spread = F.sum(F.expr("words * (x - mx) * (x - mx)")).over(page)
    points = points.withColumn("slope", F.when(spread > 1e-12, F.sum(F.expr("words * (x - mx) * (y - my)")).over(page) / spread).otherwise(F.lit(0.0)))
    off = F.abs(F.expr("y - my - slope * (x - mx)"))
    return points.groupBy("doc_id").agg(F.max("n").alias("top"), F.first("slope").alias("slope"), F.max(off).alias("residual"))


#: A page's most frequent content word, slope or residual is extreme beyond this multiple of what 95 of 100 prose pages of like length reach.
EXTREME = 1.5
#: Least number of occurrences that can make a keyword.
LEAST = 3
#: Share of a page's words from which its most frequent content word rules it.
RULING = 0.1
#: The same for words inside of sentences.
RULING_SENTENCES = 0.06
#: Prose pages of a language and length that make a reference of their own.
LEAST_PAGES = 20


def keyword_pages(profiles: DataFrame) -> DataFrame:
    """(doc_id, top, slope, residual, prose_top, spam_share, is_keyword_page) for each document with text.

    ``profiles`` has to be written already. Keywords are the content words that occur more often than ``EXTREME`` times what prose of
    the language at comparable length (powers of two of the words) reaches. Where the curve is flatter than that of such prose by ``EXTREME``,
    words that occur at least half as often as the most frequent one are keywords too (in sentences, more than that); where it is steeper or
    further from its line, words of lists that occur more often than in prose. Links, hashtags and product labels in lists count like a word of
their own: beyond ``EXTREME`` times as many as such prose has, their lines are held by keywords as well. The page is one if what keywords hold
is more than half of its characters.
    """
    curves = rank_frequency(profiles)
    pages = profiles.where("n_chars_dense > 0").join(curves, "doc_id", "left").withColumn("length_class", F.floor(F.log2(F.col("n_units") + 1)).cast("int"))
    prose = pages.where("prose_chars > 0.8 * n_chars_dense and top is not null")
    reached = [("top", "top", 0.95), ("marks", "n_marks", 0.95), ("steep", "slope", 0.05), ("flat", "slope", 0.95), ("off", "residual", 0.95)]
    # Only pages that repeat words have a curve to compare.
    measure = lambda c: F.col(c) if c in ("top", "n_marks") else F.when(F.col("top") >= LEAST, F.col(c))
    limits = lambda of: [F.percentile_approx(measure(c), share).alias(f"{of}_{name}") for name, c, share in reached]
    near_own = prose.groupBy(F.col("prose_lang").alias("words_lang"), "length_class").agg(F.count("*").alias("pages"), F.count(measure("slope")).alias("curved"), *limits("own"))
    near_any = prose.groupBy("length_class").agg(*limits("any"))
    # References: at most languages x 31 rows.
    pages = pages.join(F.broadcast(near_own), ["words_lang", "length_class"], "left").join(F.broadcast(near_any), "length_class", "left")
    own = lambda name, n: F.coalesce(F.when(F.col(n) >= LEAST_PAGES, F.col(f"own_{name}")), f"any_{name}")
    pages = pages.withColumn("prose_top", F.coalesce(own("top", "pages"), F.lit(2)))
    pages = pages.withColumn("prose_marks", F.coalesce(own("marks", "pages"), F.lit(0)))
    pages = pages.withColumns({name: own(name, "curved") for name in ("steep", "flat", "off")})
    pages = pages.withColumn("least", F.greatest(F.lit(LEAST), F.ceil(F.col("prose_top") * EXTREME)).cast("int"))
    # On a page that one word rules, other repeated words of its lists are keywords as well; in sentences a keyword has to rule.
    ruled = F.expr(f"top >= least and top >= {RULING} * n_units")
    is_flat = F.expr(f"top >= {LEAST} and slope > flat / {EXTREME}")
    is_off = F.expr(f"top >= {LEAST} and (slope < steep * {EXTREME} or residual > off * {EXTREME})")
    plateau = F.when(is_flat, F.greatest(F.lit(LEAST), F.ceil(F.col("top") / 2)))
    peak = F.when(is_off, F.greatest(F.lit(LEAST), F.col("prose_top") + 1))
    pages = pages.withColumn("in_lists", F.when(ruled, F.lit(2)).otherwise(F.least("least", plateau, peak)))
    in_sentences = F.greatest(F.lit(LEAST + 1), "least", F.ceil(F.col("n_units") * RULING_SENTENCES))
    pages = pages.withColumn("in_sentences", F.least(in_sentences, plateau + 1))
    kept = F.expr("aggregate(filter(held, x -> x.n >= if(x.prose, in_sentences, in_lists)), 0, (acc, x) -> acc + x.chars)")
    marked = F.when(F.col("n_marks") > EXTREME * F.col("prose_marks"), F.col("listed_chars")).otherwise(F.lit(0))
    pages = pages.withColumn("spam_share", (marked + kept) / F.col("n_chars_dense"))
    return pages.select("doc_id", "top", "slope", "residual", "prose_top", "spam_share", (F.col("spam_share") > 0.5).alias("is_keyword_page"))
