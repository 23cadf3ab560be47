"""Tokenizer folders: writing, reading with detection of the kind, checks, merging of monolingual unigram models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lexiloom.operators.bpe import BpeModel, Step
from lexiloom.operators.vocab import validate
from lexiloom.sources.files import exists, is_file, read_json, write_json

#: Names of model files, the first one present counts, and of the language ids beside them.
MODEL_NAMES, LANG_IDS = ("tokenizer.model", "tokenizer.json"), "lang_to_ids.json"
#: Fixed value: most entries of a vocabulary or merge table on the driver.
MOST = 5_000_000


@dataclass
class Loaded:
    """A model as it was found: ``kind`` is bpe or unigram, ``scores`` (piece, score) by id for unigram, ``lang_ids`` if recorded."""

    kind: str
    bpe: BpeModel | None = None
    scores: list[tuple[str, float]] = field(default_factory=list)
    lang_ids: dict[str, list[int]] | None = None

    @property
    def pieces(self) -> list[str]:
        """Pieces by id."""
        return [p for p, _ in self.scores] if self.bpe is None else sorted(self.bpe.vocab, key=self.bpe.vocab.__getitem__)

    def table(self, spark: SparkSession) -> DataFrame:
        """(token_id, piece, score); scores of BPE are null."""
        rows = [(k, p, x) for k, (p, x) in enumerate(self.scores)] if self.bpe is None else [(i, t, None) for t, i in self.bpe.vocab.items()]
        return spark.createDataFrame(rows, "token_id int, piece string, score double")


def global_path(folder: str) -> str:
    """The model file of a folder that is written here."""
    return f"{folder}/{MODEL_NAMES[1]}"


def lang_ids_path(folder: str) -> str:
    """The file of language ids of a folder."""
    return f"{folder}/{LANG_IDS}"


def find_model(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """(model file, file of language ids or None) of a model file or a folder. Raises FileNotFoundError."""
    if is_file(spark, path):
        beside = lang_ids_path(path.rsplit("/", 1)[0])
        return path, beside if is_file(spark, beside) else None
    for name in MODEL_NAMES:
        if is_file(spark, f"{path}/{name}"):
            return f"{path}/{name}", lang_ids_path(path) if is_file(spark, lang_ids_path(path)) else None
    raise FileNotFoundError(f"no {' or '.join(MODEL_NAMES)} in {path}")


def load_model(spark: SparkSession, path: str) -> Loaded:
    """The model of a file or folder; its kind is read from the file. Raises ValueError for other kinds."""
    file, ids = find_model(spark, path)
    lang_ids = read_json(spark, ids) if ids else None
    if file.endswith(".model"):
        try:
            from sentencepiece import SentencePieceProcessor
        except ImportError as e:
            raise ValueError(f"{file} needs the sentencepiece package") from e
        model = SentencePieceProcessor(model_file=file)
        return Loaded("unigram", scores=[(model.IdToPiece(i), model.GetScore(i)) for i in range(model.vocab_size())], lang_ids=lang_ids)
    model = read_json(spark, file)["model"]
    if model["type"] == "BPE":
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return Loaded("bpe", BpeModel(dict(model["vocab"]), merges), lang_ids=lang_ids)
    if model["type"] == "Unigram":
        return Loaded("unigram", scores=[(p, x) for p, x in model["vocab"]], lang_ids=lang_ids)
    raise ValueError(f"{file}: unknown kind of model {model['type']!r}")


def _bpe_file(model: BpeModel) -> dict:
    return {"model": {"type": "BPE", "vocab": model.vocab, "merges": [list(m) for m in model.merges]}}


def extracted_path(folder: str, lang: str) -> str:
    """The model file of a language's subtokenizer."""
    return f"{folder}/extracted/{lang}/{MODEL_NAMES[1]}"


def write_bpe(spark: SparkSession, model: BpeModel, lang_ids: Mapping[str, Sequence[int]], folder: str, extracted: Mapping[str, BpeModel] | None = None) -> None:
    """A BPE folder: the model file, the language ids and the subtokenizers of languages."""
    write_json(spark, _bpe_file(model), global_path(folder))
    write_json(spark, {x: list(ids) for x, ids in lang_ids.items()}, lang_ids_path(folder))
    for lang, sub in (extracted or {}).items():
        write_json(spark, _bpe_file(sub), extracted_path(folder, lang))


def write_unigram(spark: SparkSession, scores: Sequence[tuple[str, float]], lang_ids: Mapping[str, Sequence[int]], folder: str) -> None:
    """A unigram folder: the model file, pieces by id with scores, and the language ids."""
    write_json(spark, {"model": {"type": "Unigram", "unk_id": 0, "vocab": [list(r) for r in scores], "byte_fallback": any(p == "<0x00>" for p, _ in scores)}}, global_path(folder))
    write_json(spark, {x: list(ids) for x, ids in lang_ids.items()}, lang_ids_path(folder))


def replaced(loaded: Loaded, vocab: Mapping[str, int], merges: Sequence[tuple[str, str]]) -> Loaded:
    """A BPE model with another vocabulary and other merges."""
    if loaded.bpe is None:
        raise ValueError("only BPE models have merges")
    return Loaded("bpe", BpeModel(dict(vocab), list(merges)), lang_ids=loaded.lang_ids)


def faults(spark: SparkSession, folder: str, langs: Sequence[str] | None = None) -> DataFrame:
    """(rule, n): violations of each rule of a folder, for BPE those of merges too. Raises FileNotFoundError for missing files, KeyError for missing languages."""
    loaded = load_model(spark, folder)
    if loaded.lang_ids is None:
        raise FileNotFoundError(lang_ids_path(folder))
    if missing := [x for x in langs or () if x not in loaded.lang_ids]:
        raise KeyError(f"no ids of {missing}")
    mine = [x for x in loaded.lang_ids if langs is None or x in langs]
    ids = [(x, i) for x in mine for i in loaded.lang_ids[x]]
    subs = [(x, t) for x in mine if is_file(spark, extracted_path(folder, x)) for t in load_model(spark, extracted_path(folder, x)).pieces]
    merges = [(k, *m) for k, m in enumerate(loaded.bpe.merges)] if loaded.bpe else []
    tables = (merges, "merge_no int, a string, b string"), (ids, "lang string, token_id int"), (subs, "lang string, piece string")
    return validate(loaded.table(spark).select("token_id", "piece"), *(spark.createDataFrame(rows, schema) for rows, schema in tables))


def check(spark: SparkSession, folder: str, langs: Sequence[str] | None = None) -> None:
    """Raises ValueError with the rules that a folder breaks."""
    broken = {r.rule: r.n for r in faults(spark, folder, langs).collect() if r.n}
    if broken:
        raise ValueError(f"{folder}: {broken}")


def merge_unigram(spark: SparkSession, paths: Sequence[str], langs: Sequence[str], folder: str) -> Loaded:
    """The union of monolingual unigram models, written to ``folder`` with the ids of each language's pieces and checked.

    The first model that has a piece gives its place and score. Raises ValueError if models and languages differ in number or a model isn't unigram.
    """
    if len(paths) != len(langs):
        raise ValueError("as many models as languages are needed")
    models = [load_model(spark, p) for p in paths]
    if any(m.kind != "unigram" for m in models):
        raise ValueError("only unigram models can be merged")
    scores: dict[str, float] = {}
    for model in models:
        for piece, score in model.scores:
            scores.setdefault(piece, score)
    place = {p: k for k, p in enumerate(scores)}
    write_unigram(spark, list(scores.items()), {x: [place[p] for p in m.pieces] for x, m in zip(langs, models)}, folder)
    check(spark, folder, langs)
    return load_model(spark, folder)


def write_steps(spark: SparkSession, steps: Sequence[Step], folder: str) -> None:
    """The folder of a sequential training: the global model with the ids of each language's subtokenizer, and what each step made.

    ``sequential/step_K_LANG``, ``extracted/step_K_LANG`` and ``added/step_K_LANG`` hold the model after the step, its subtokenizer and what it found.
    """
    last = steps[-1].model
    for k, step in enumerate(steps):
        for name, model in (("sequential", step.model), ("extracted", step.extracted)):
            write_json(spark, _bpe_file(model), f"{folder}/{name}/step_{k}_{step.lang}/{MODEL_NAMES[1]}")
        if step.units:
            write_json(spark, ["".join(u) for u in step.units], f"{folder}/added/step_{k}_{step.lang}/vocab.json", ascii_only=True)
            write_json(spark, [" ".join(u) for u in step.units], f"{folder}/added/step_{k}_{step.lang}/merges.json", ascii_only=True)
    write_bpe(spark, last, {s.lang: [last.vocab[t] for t in s.extracted.vocab] for s in steps}, folder, {s.lang: s.extracted for s in steps})


__all__ = ["Loaded", "check", "exists", "faults", "find_model", "global_path", "lang_ids_path", "load_model", "merge_unigram", "replaced", "write_bpe", "write_steps", "write_unigram"]
