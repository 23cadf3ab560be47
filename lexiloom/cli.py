"""Commands: ``python -m lexiloom.cli COMMAND [config=FILE] [key=value ...]``.

Settings come from YAML or JSON files and options, the later ones stronger. A command writes into ``output_dir``.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import arguments as A
from lexiloom import config
from lexiloom.operators import bpe, documents, unigram, vocab, words
from lexiloom.sources import models, sinks, text

log = logging.getLogger("lexiloom")


def set_up_logging(level: int = logging.INFO) -> None:
    """Log lines with time, level and name, once."""
    if not logging.getLogger().handlers:
        logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", datefmt="%Y-%m-%d %H:%M:%S")


def settings(options: Sequence[str]) -> dict[str, Any]:
    """Settings of files (``config=``) and options on top of each other."""
    given = config.from_dotted(options)
    parts = [layer for path in config.names(given.pop(config.INCLUDE, None)) for layer in config.layers(path)]
    return config.merge([*parts, given])


def _docs(spark: SparkSession, path: str, field: str | None, most: int = -1) -> DataFrame:
    return text.documents(spark, path, field, most)


def train_bpe(spark: SparkSession, a: A.TrainBpe) -> bpe.BpeModel:
    """Train and write a byte-pair model; its one language has no name."""
    model = bpe.train(_docs(spark, a.input_path, a.text_field, a.max_docs), a.vocab_size)
    models.write_bpe(spark, model, {}, a.output_dir)
    return model


def train_sequential(spark: SparkSession, a: A.TrainSequential) -> list[bpe.Step]:
    """Train language by language, write the folder and check it."""
    steps = bpe.train_sequential([(x, _docs(spark, p, a.text_field)) for x, p in a.pairs()], a.vocab_size, a.extension_size, a.max_token_length, a.max_sentences)
    if a.save_steps:
        models.write_steps(spark, steps, a.output_dir)
    else:
        last = steps[-1].model
        models.write_bpe(spark, last, {s.lang: [last.vocab[t] for t in s.extracted.vocab] for s in steps}, a.output_dir, {s.lang: s.extracted for s in steps})
    models.check(spark, a.output_dir)
    return steps


def train_unigram(spark: SparkSession, a: A.TrainUnigram) -> list[tuple[int, str, float]]:
    """Train a unigram vocabulary and write it with byte pieces."""
    rows = unigram.with_bytes(unigram.train(words.word_frequencies(_docs(spark, a.input_path, a.text_field, a.max_docs)), a.vocab_size, a.rounds))
    models.write_unigram(spark, [(p, x) for _, p, x in rows], {}, a.output_dir)
    return rows


def merge(spark: SparkSession, a: A.Merge) -> models.Loaded:
    """Merge monolingual unigram models into one folder."""
    return models.merge_unigram(spark, config.names(a.model_paths), config.names(a.langs), a.output_dir)


def reestimate(spark: SparkSession, a: A.Reestimate) -> list[float]:
    """New scores from sentences that a uniform interleaving of the sources selects; the log-likelihood of each round."""
    loaded = models.load_model(spark, a.model_path)
    parts = [_docs(spark, p, a.text_field).withColumn("source", F.lit(p)) for p in config.names(a.input_paths)]
    texts = parts[0]
    for part in parts[1:]:
        texts = texts.unionByName(part)
    texts = unigram.usable_sentences(texts.withColumn("doc_id", F.col("line_id")), a.max_sentence_length)
    chosen = documents.select_texts(texts, a.n_sentences, a.seed).withColumn("weight", F.lit(1.0))
    scored = [(p, x) for p, x in loaded.scores]
    fixed = {p for p, in spark.createDataFrame([(p,) for p, _ in scored], "piece string").where(vocab.is_special("piece", unused=True)).collect()}
    logp, history = unigram.fit(chosen, [p for p, _ in scored if p not in fixed], a.max_iters, a.tolerance)
    models.write_unigram(spark, [(p, x if p in fixed else logp.get(p, x)) for p, x in scored], loaded.lang_ids or {}, a.output_dir)
    return history


def count(spark: SparkSession, a: A.Count) -> DataFrame:
    """(lang, token_id, piece, n) of every token of a byte-pair model, written as Parquet."""
    loaded = models.load_model(spark, a.model_path)
    if loaded.bpe is None:
        raise ValueError("tokens are counted for byte-pair models")
    counts = bpe.token_counts(words.word_frequencies(_docs(spark, a.input_path, a.text_field)), loaded.bpe.merges, loaded.table(spark).select("token_id", "piece"))
    counts.select(F.lit(a.lang).alias("lang"), "token_id", "piece", "n").write.mode("overwrite").parquet(f"{a.output_dir}/{a.lang}")
    return spark.read.parquet(f"{a.output_dir}/{a.lang}")


def nsl(spark: SparkSession, a: A.Nsl) -> DataFrame:
    """(lang, n_tokens, n_tokens_ref, nsl), also written as one JSON file."""
    langs, paths, references = (config.names(x) for x in (a.langs, a.input_paths, a.reference_paths))
    if not len(langs) == len(paths) == len(references):
        raise ValueError("each language needs a path and a reference")
    ours, out = models.load_model(spark, a.model_path).bpe, None
    for lang, path, reference in zip(langs, paths, references):
        counted = words.word_frequencies(_docs(spark, path, a.text_field).withColumn("lang", F.lit(lang)), "lang")
        part = bpe.nsl(counted, ours.merges, models.load_model(spark, reference).bpe.merges, "lang")
        out = part if out is None else out.unionByName(part)
    sinks.write_nsl(out, f"{a.output_dir}/nsl.json")
    return out


COMMANDS: dict[str, tuple[type, Callable]] = {
    "train-bpe": (A.TrainBpe, train_bpe), "train-sequential": (A.TrainSequential, train_sequential), "train-unigram": (A.TrainUnigram, train_unigram), "merge": (A.Merge, merge),
    "reestimate": (A.Reestimate, reestimate), "count": (A.Count, count), "nsl": (A.Nsl, nsl),
}


def run(spark: SparkSession, command: str, options: Sequence[str]) -> Any:
    """The result of a command. Raises ValueError for unknown commands and keys and for missing settings."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}; there are {', '.join(COMMANDS)}")
    schema, function = COMMANDS[command]
    given = config.parse(schema, settings(options))
    if missing := given.missing():
        raise ValueError(f"{command} needs {', '.join(missing)}")
    log.info("%s: %s", command, given)
    return function(spark, given)


def main(argv: Sequence[str]) -> int:
    """Run one command in a session of its own."""
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    from lexiloom.plans.registry import ship

    set_up_logging()
    spark = SparkSession.builder.appName("lexiloom").getOrCreate()
    try:
        ship(spark)
        run(spark, argv[0], argv[1:])
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
