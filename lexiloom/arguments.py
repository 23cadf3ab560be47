"""What each command needs, as dataclasses: names of fields are the keys of configuration files and options."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from lexiloom.config import names


@dataclass
class Arguments:
    """Fields without a default in ``REQUIRED`` have to be given."""

    output_dir: str | None = None

    REQUIRED = ("output_dir",)

    def missing(self) -> list[str]:
        """Required fields that aren't given."""
        return [f for f in self.REQUIRED if getattr(self, f) in (None, "", [])]


@dataclass
class TrainBpe(Arguments):
    """Byte-pair encoding from scratch."""

    input_path: str | None = None
    vocab_size: int = 24_000
    text_field: str | None = None
    max_docs: int = -1

    REQUIRED = ("output_dir", "input_path")


@dataclass
class TrainSequential(Arguments):
    """A byte-pair tokenizer language by language; paths and languages go together, by commas or as lists."""

    input_paths: str | list[str] | None = None
    langs: str | list[str] | None = None
    vocab_size: int = 24_000
    extension_size: int | None = None
    max_token_length: int | None = None
    max_sentences: int | None = None
    text_field: str | None = None
    save_steps: bool = True

    REQUIRED = ("output_dir", "input_paths", "langs")

    def pairs(self) -> list[tuple[str, str]]:
        """(language, path) in order. Raises ValueError if they differ in number."""
        langs, paths = names(self.langs), names(self.input_paths)
        if len(langs) != len(paths):
            raise ValueError("as many paths as languages are needed")
        return list(zip(langs, paths))


@dataclass
class TrainUnigram(Arguments):
    """A unigram vocabulary from scratch."""

    input_path: str | None = None
    vocab_size: int = 24_000
    rounds: int = 2
    text_field: str | None = None
    max_docs: int = -1

    REQUIRED = ("output_dir", "input_path")


@dataclass
class Merge(Arguments):
    """The union of monolingual unigram models."""

    model_paths: str | list[str] | None = None
    langs: str | list[str] | None = None

    REQUIRED = ("output_dir", "model_paths", "langs")


@dataclass
class Reestimate(Arguments):
    """New scores of a unigram model by expectation-maximization."""

    model_path: str | None = None
    input_paths: str | list[str] | None = None
    max_iters: int = 50
    tolerance: float = 1e-4
    n_sentences: int = 10_000
    max_sentence_length: int = 512
    text_field: str | None = None
    seed: int = 1234

    REQUIRED = ("output_dir", "model_path", "input_paths")


@dataclass
class Count(Arguments):
    """Counts of every token of a tokenizer in a corpus."""

    model_path: str | None = None
    input_path: str | None = None
    lang: str | None = None
    text_field: str | None = None

    REQUIRED = ("output_dir", "model_path", "input_path", "lang")


@dataclass
class Nsl(Arguments):
    """Normalized sequence length against reference tokenizers, one for each language."""

    model_path: str | None = None
    input_paths: str | list[str] | None = None
    reference_paths: str | list[str] | None = None
    langs: str | list[str] | None = None
    text_field: str | None = None

    REQUIRED = ("output_dir", "model_path", "input_paths", "reference_paths", "langs")


@dataclass
class TokenizerSettings:
    """A tokenizer as others use it: where its model is, its languages, and how languages and subtokenizers are found."""

    path: str | None = None
    langs: str | list[str] | None = None
    extraction: str = "none"
    size: int | None = None
    pad_multiple: int | None = None

    def as_dict(self) -> dict[str, object]:
        """The settings as a mapping."""
        return dataclasses.asdict(self)
