from lexiloom.operators import documents as D
from lexiloom.sources import files, models, sinks, tasks, text
from lexiloom.operators.bpe import BpeModel
from tests.conftest import rows
import json

import pytest
import zstandard
from pyspark.sql import functions as F

SCHEMA = "doc_id long, lang string, source string, file_id int, line_id long, text string"
DOCS = [(1, "en", "a", 0, 0, "x\n\n  \ny"), (2, None, "a", 0, 1, None), (3, "en", "b", 1, 5, ""), (4, "fr", "b", 0, 4, "é")]


def test_lines_and_statistics(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    assert rows(D.nonblank_lines(docs)) == [(1, 1, "x"), (1, 4, "y"), (4, 1, "é")]
    assert rows(D.statistics(docs)) == [("en", 2, 7, 7, 3), ("fr", 1, 1, 2, 1), (None, 1, 0, 0, 0)]
    assert rows(D.length_filter(docs, 1, 5).select("doc_id")) == [(4,)]
    assert rows(D.sentence_weights(docs)) == [("x", 1), ("y", 1), ("é", 1)]
    assert D.statistics(docs.where("false")).count() == 0


def test_shards_and_cycling(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    assert rows(D.shards(docs, 4).select("line_id", "rank")) == [(0, 0), (1, 1), (4, 0), (5, 1)]
    assert rows(D.stream_positions(docs, 1, 4, 2)) == [("a", 0, 0, 0, 1, 2), ("a", 1, 1, 0, 1, 2), ("b", 0, 0, 1, 5, 3), ("b", 1, 1, 1, 5, 3)]


def test_paragraphs(spark):
    lines = spark.createDataFrame([("s", k, v) for k, v in enumerate(["", "a", "b", " ", "", "c"])], "source string, line_no int, line string")
    assert rows(D.paragraphs(lines)) == [("s", 1, "a\nb\n \n"), ("s", 2, "c")]


def test_paragraphs_over_blocks(spark, monkeypatch):
    from lexiloom.operators import order

    monkeypatch.setattr(order, "BLOCK", 3)
    test_paragraphs(spark)
    lines = spark.createDataFrame([(None, k, "x" if k % 7 else "") for k in range(30)], "source string, line_no int, line string")
    assert [len(r.text.split("\n")) for r in D.paragraphs(lines).orderBy("paragraph").collect()] == [7, 7, 7, 7, 1]


def test_interleaving_reads_every_document_once(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    for got in (D.interleave_exactly(docs, ["a", "b"], [0.9, 0.1], 3), D.interleave(docs, {"a": 0.9, "b": 0.1}, 3)):
        got = rows(got.select("pos", "source", "doc_id"))
        assert [p for p, *_ in got] == [0, 1, 2, 3] and [d for _, s, d in got if s == "b"] == [4, 3]
    assert D.pick_sequence([0, 2], None, 1) == [1, 1]
    with pytest.raises(ValueError):
        D.interleave(docs, {"a": 0.0})


def test_interleaving_draws_by_weight_and_needs_no_order_of_partitions(spark):
    docs = spark.createDataFrame([(k, "a" if k < 3000 else "b", 0, k) for k in range(6000)], "doc_id long, source string, file_id int, line_id long")
    got = [rows(D.interleave(docs.repartition(n), {"a": 3.0, "b": 1.0}, 5).select("pos", "source", "doc_id")) for n in (1, 7)]
    assert got[0] == got[1]
    first = sorted(got[0])[:2000]
    assert abs(sum(s == "a" for _, s, _ in first) / 2000 - 0.75) < 0.04
    for s in "ab":
        order = [d for _, x, d in sorted(got[0]) if x == s]
        assert order == sorted(order) and len(order) == 3000
    assert D.select_texts(docs, 10, 5).count() == 10


def test_readers_seek(spark):
    docs = spark.createDataFrame([(k, "a", k // 3, k % 3) for k in range(6)], "doc_id long, source string, file_id int, line_id long")
    places = D.all_positions(docs, 2, 2)
    assert {r.doc_id for r in places.where("rank = 1").collect()} == {1, 4} and places.count() == 12
    assert rows(D.seek(places, 1, 1, 1).select("doc_id")) == [(4,), (5,)]
    assert rows(D.heads(D.seek(places, 0, 1, 1), "rank")) == [(0, 0, 1, 2), (1, 0, 1, 1)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("one\n\n two \n")
    (tmp_path / "a.txt.zst").write_bytes(zstandard.compress(b"three\n"))
    (tmp_path / "sub").mkdir()
    assert [f.rsplit("/", 1)[1] for f in text.source_files(spark, str(tmp_path))] == ["a.txt.zst", "b.txt"]
    assert rows(text.documents(spark, str(tmp_path))) == [(0, 0, "one"), (0, 2, " two "), (1, 0, "three")]
    assert text.documents(spark, str(tmp_path), max_docs=1).collect()[0].text == "one"
    with pytest.raises(FileNotFoundError):
        text.source_files(spark, str(tmp_path / "sub"))
    lines = tmp_path / "sub" / "c.jsonl"
    lines.write_text('{"text": "x\\ny"}\n\n{"other": 1}\n')
    assert rows(text.documents(spark, str(lines), "text")) == [(0, 0, "x\ny")]
    assert rows(text.pretraining_documents(spark, str(tmp_path / "sub"))) == [(0, 0, "x\ny")]
    (tmp_path / "bad").write_text('{"text": "x"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        text.documents(spark, str(tmp_path / "bad"), "text").collect()
    (tmp_path / "v").write_text(" p \n\nq\n")
    assert rows(text.vocabulary_file(spark, str(tmp_path / "v"))) == [("p",), ("q",)]


def test_task_sources(spark, tmp_path):
    def jsonl(name, *items):
        p = tmp_path / name
        p.write_text("\n".join(map(json.dumps, items)))
        return str(p)

    assert rows(tasks.multiple_choice(spark, jsonl("a", {"question": "q", "choices": ["x", "y"], "answer": 1}))) == [("q", ["x", "y"], 1, None)]
    nested = {"question": {"stem": "s", "choices": [{"label": "A", "text": "1"}, {"label": "A", "text": "2"}]}, "answerKey": "A"}
    assert rows(tasks.labelled_choices(spark, jsonl("b", nested, nested | {"answerKey": "Z"}))) == [("s", ["1", "2"], 1, None)]
    assert rows(tasks.endings(spark, jsonl("c", {"ctx": "c", "endings": ["e"], "label": "0", "activity_label": "L"}, {"ctx": "d", "endings": ["e"], "label": 0})))[0][0] == "L: c"
    assert rows(tasks.two_contexts(spark, jsonl("d", {"ctx": ["a", "b"], "end": "e", "label": 1}))) == [("e", ["a", "b"], 1, None)]
    (tmp_path / "dev").mkdir()
    (tmp_path / "dev" / "maths_dev.csv").write_text('"a, ""b""",1,2,3,4,C\n')
    assert rows(tasks.topic_csv(spark, str(tmp_path), "dev")) == [("maths", 'a, "b"', ["1", "2", "3", "4"], 2)]
    left = spark.createDataFrame([(0, "q", ["a"]), (1, "r", ["b"])], "line_id long, question string, answer array<string>")
    right = spark.createDataFrame([(0, "q", ["z"])], "line_id long, question string, answer array<string>")
    assert rows(tasks.parallel(left, reverse=True).select("question", "answer")) == [("a", ["q"]), ("b", ["r"])]
    assert rows(tasks.parallel(left, right).select("question", "answer")) == [("a", ["z"])]
    with pytest.raises(ValueError):
        tasks.parallel(left, right.withColumn("question", right.answer[0]))
    assert rows(tasks.summaries(spark, jsonl("e", {"title": "t", "text": "x", "summary": "s"}), title="title")) == [("t\nx", "s")]


def test_tokenizer_folders(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    model = BpeModel()
    model.add("a", "b")
    models.write_bpe(spark, model, {"en": [4, 5], "fr": [6, 7]}, folder("t"))
    models.check(spark, folder("t"), ["en"])
    loaded = models.load_model(spark, folder("t"))
    assert loaded.kind == "bpe" and loaded.bpe == model and loaded.lang_ids == {"en": [4, 5], "fr": [6, 7]}
    assert models.load_model(spark, folder("t/tokenizer.json")).lang_ids == loaded.lang_ids and loaded.table(spark).count() == len(model.vocab)
    assert models.replaced(loaded, {"a": 0}, []).pieces == ["a"]
    with pytest.raises(KeyError):
        models.check(spark, folder("t"), ["xx"])
    models.write_bpe(spark, BpeModel(dict(model.vocab), [("a", "missing")]), {"en": [10**6], "fr": [1, 2]}, folder("u"), {"fr": BpeModel({"a": 0, "b": 1, "zz": 2}, [])})
    broken = {r.rule: r.n for r in models.faults(spark, folder("u")).collect() if r.n}
    assert broken == {"language_id_unknown": 1, "merge_not_buildable": 2, "extracted_unknown": 1, "extracted_size": 1}
    with pytest.raises(ValueError):
        models.check(spark, folder("u"))
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, folder("nothing"))
    files.write_json(spark, {"model": {"type": "WordPiece"}}, folder("w/tokenizer.json"))
    with pytest.raises(ValueError):
        models.load_model(spark, folder("w"))


def test_unigram_folders_are_merged(spark, tmp_path):
    folder = lambda name: str(tmp_path / name)
    models.write_unigram(spark, [("<unk>", 0.0), ("a", -1.0), ("é", -2.0)], {"en": [0, 1, 2]}, folder("en"))
    models.write_unigram(spark, [("<unk>", 0.0), ("b", -1.0), ("a", -9.0)], {"fr": [0, 1, 2]}, folder("fr"))
    merged = models.merge_unigram(spark, [folder("en"), folder("fr")], ["en", "fr"], folder("both"))
    assert merged.scores == [("<unk>", 0.0), ("a", -1.0), ("é", -2.0), ("b", -1.0)] and merged.lang_ids == {"en": [0, 1, 2], "fr": [0, 3, 1]}
    with pytest.raises(ValueError):
        models.merge_unigram(spark, [folder("en")], ["en", "fr"], folder("x"))
    with pytest.raises(ValueError):
        models.replaced(merged, {}, [])


def test_sinks(spark, tmp_path):
    sinks.append_metrics(spark.createDataFrame([(1.5,)], "loss double"), {"run": "r"}, str(tmp_path / "m"))
    sinks.append_metrics(spark.createDataFrame([(2.5,)], "loss double"), {"run": "r"}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    sinks.write_scores({"a": -1.0}, 3, spark, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().iter == 3
    counts = spark.createDataFrame([(1, 7, 2), (2, None, None), (3, 7, 1), (3, 8, 1), (4, 9, 5)], "doc_id long, token_id int, n long")
    assert rows(sinks.count_snapshots(counts, 2)) == [(0, 2, 7, 2), (1, 4, 7, 3), (1, 4, 8, 1), (1, 4, 9, 5)]
    assert sinks.count_snapshots(counts.where("false"), 2).count() == 0
    files.write_json(spark, {"k": "é"}, str(tmp_path / "j" / "a.json"), ascii_only=True)
    assert files.read_bytes(spark, str(tmp_path / "j" / "a.json")) == b'{\n    "k": "\\u00e9"\n}' and files.read_json(spark, str(tmp_path / "j" / "a.json")) == {"k": "é"}
    files.write_single(spark.range(5).select(F.col("id").cast("string")).orderBy(F.desc("id")), str(tmp_path / "one.txt"))
    assert files.read_bytes(spark, str(tmp_path / "one.txt")) == b"4\n3\n2\n1\n0\n"
    with pytest.raises(FileNotFoundError):
        files.read_bytes(spark, str(tmp_path / "none"))
