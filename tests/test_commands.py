import json

import pytest
from pyspark.sql import functions as F

from lexiloom import arguments, cli
from lexiloom.operators import bpe, metrics, modular
from lexiloom.operators.documents import uniform
from lexiloom.sources import files, models
from tests.conftest import rows


def corpus(tmp_path, name, *texts):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps({"text": t}) for t in texts))
    return str(path)


def test_settings_come_from_files_and_options(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("vocab_size: 300\ntext_field: text\n")
    got = cli.settings([f"config={tmp_path}/base.yaml", "vocab_size=262", "input_path=x"])
    assert got == {"vocab_size": 262, "text_field": "text", "input_path": "x"}
    for command, options in (("nope", []), ("train-bpe", ["output_dir=x"]), ("train-bpe", ["other=1"])):
        with pytest.raises(ValueError):
            cli.run(spark, command, options)
    with pytest.raises(ValueError):
        arguments.TrainSequential(langs="a,b", input_paths="x").pairs()
    assert arguments.TokenizerSettings("p").as_dict()["extraction"] == "none" and cli.main([]) == 0


def test_byte_pair_commands(spark, tmp_path):
    en, fr = corpus(tmp_path, "en.jsonl", "the the then", "the cat"), corpus(tmp_path, "fr.jsonl", "le les les", "la")
    out = lambda name: f"output_dir={tmp_path}/{name}"
    size = len(bpe.base_vocabulary()) + 3
    model = cli.run(spark, "train-bpe", [f"input_path={en}", out("b"), "text_field=text", f"vocab_size={size}"])
    assert models.load_model(spark, f"{tmp_path}/b").bpe == model and len(model.merges) == 3
    steps = cli.run(spark, "train-sequential", [f"input_paths={en},{fr}", "langs=en,fr", out("s"), "text_field=text", f"vocab_size={size}", "extension_size=4"])
    loaded = models.load_model(spark, f"{tmp_path}/s")
    assert loaded.bpe == steps[-1].model and set(loaded.lang_ids) == {"en", "fr"} and files.is_file(spark, f"{tmp_path}/s/added/step_1_fr/merges.json")
    counts = {r.piece: r.n for r in cli.run(spark, "count", [f"input_path={en}", f"model_path={tmp_path}/b", out("c"), "lang=en", "text_field=text"]).collect()}
    assert sum(n * len(p) for p, n in counts.items()) == len("the the thenthe cat")
    got = cli.run(spark, "nsl", [f"model_path={tmp_path}/s", f"input_paths={en},{fr}", f"reference_paths={tmp_path}/b,{tmp_path}/b", "langs=en,fr", out("n"), "text_field=text"])
    assert {r.lang for r in got.collect()} == {"en", "fr"} and files.read_json(spark, f"{tmp_path}/n/nsl.json")["en"]["nsl"] <= 1.0


def test_unigram_commands(spark, tmp_path):
    en, fr = corpus(tmp_path, "en.jsonl", *["low lower lowest new newest"] * 5), corpus(tmp_path, "fr.jsonl", *["le les la lune"] * 5)
    out = lambda name: f"output_dir={tmp_path}/{name}"
    for lang, path in (("en", en), ("fr", fr)):
        cli.run(spark, "train-unigram", [f"input_path={path}", out(lang), "text_field=text", "vocab_size=24"])
    merged = cli.run(spark, "merge", [f"model_paths={tmp_path}/en,{tmp_path}/fr", "langs=en,fr", out("m")])
    assert merged.pieces[:2] == ["<unk>", "<s>"] and len(set(merged.pieces)) == len(merged.pieces)
    history = cli.run(spark, "reestimate", [f"model_path={tmp_path}/m", f"input_paths={en},{fr}", out("r"), "text_field=text", "max_iters=3", "n_sentences=8"])
    again = models.load_model(spark, f"{tmp_path}/r")
    assert len(history) <= 3 and again.pieces == merged.pieces and again.lang_ids == merged.lang_ids
    assert again.scores[:260] == merged.scores[:260] and again.scores != merged.scores


def test_parts_under_different_subtokenizers(spark):
    model = bpe.BpeModel()
    model.add("a", "b")
    t = modular.ModularTokenizer(model, {"x": {model.vocab["a"], model.vocab["b"]}})
    parts = spark.createDataFrame([(1, 1, "a", "ab"), (1, 0, "q", "ab"), (2, 0, "q", "")], "doc_id long, k int, side string, text string")
    v = model.vocab
    assert rows(t.encode_parts(parts, {"q": None, "a": "x"})) == [(1, [v["<s>"], v["ab"], v["a"], v["b"]]), (2, [v["<s>"]])]
    cut = t.truncate(spark.createDataFrame([(1, "abab"), (2, None)], "doc_id long, text string"), 1)
    assert rows(cut) == [(1, [v["ab"]], "ab"), (2, [], "")]
    mapping = spark.createDataFrame([(0, v["ab"])], "sub_id int, global_id int")
    assert rows(modular.global_to_sub(cut.select("doc_id", "tokens"), mapping)) == [(1, [0]), (2, [])]


def test_top_n_draws(spark):
    logits = spark.createDataFrame([(k, t, float(-t)) for k in range(2000) for t in range(4)], "id long, token_id int, logit double")
    drawn = metrics.top_n_choice(logits, 2, 1.0, uniform(F.lit(1), F.col("id"), F.col("token_id")), "id")
    share = drawn.where("token_id = 0").count() / 2000
    assert drawn.where("token_id > 1").count() == 0 and abs(share - 1 / (1 + 2.718281828**-1)) < 0.03
    assert metrics.top_n_choice(logits, 3, 0.0, F.lit(0.5), "id").where("token_id != 0").count() == 0
