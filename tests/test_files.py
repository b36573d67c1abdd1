"""Readers and writers of questions, answers and scores."""

import json

from folioscope.operators import evaluation
from folioscope.sources import files


def test_samples_fall_back(spark, tmp_path):
    rows = [{"id": "a", "supporting_doc_ids": ["x"]}, {"id": "b", "filtered_supporting_doc_ids": ["y", "z"]}, {"id": "c", "question": "ü"}]
    (tmp_path / "s.json").write_text(json.dumps(rows, ensure_ascii=False, indent=2))
    assert {r.id: r.supporting_doc_ids for r in files.read_samples(spark, str(tmp_path / "s.json")).collect()} == {"a": ["x"], "b": ["y", "z"], "c": []}
    (tmp_path / "t.json").write_text('[{"id": "a"}]')
    assert files.read_samples(spark, str(tmp_path / "t.json")).first().supporting_doc_ids == []


def test_folder(spark, tmp_path):
    for name in ("b", "a", "_skip", "c"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"doc_id": name}, indent=2))
    read = lambda **k: sorted(r.doc_id for r in files.read_folder(spark, str(tmp_path), "doc_id string", **k).collect())
    assert read() == ["a", "b", "c"] and read(limit=2) == ["a", "b"]


def test_last_score_of_a_question_counts(spark, tmp_path):
    lines = [json.dumps({"qid": f"q{i % 50}", "em": i, "anls": 0.5}) for i in range(500)]
    (tmp_path / "s.jsonl").write_text("\n".join(lines[:250]) + "\n\n  \n" + "\n".join(lines[250:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert {r.qid: r.em for r in files.read_scores(spark, str(tmp_path / "s.jsonl")).collect()} == {f"q{i}": 450.0 + i for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_written_results(spark, tmp_path):
    made = spark.createDataFrame([("1", "The cat", "cat!"), ("2", "cat", "cart"), ("3", None, "dog"), ("4", None, "")], "id string, prediction string, gold string")
    files.write_scores(made, str(tmp_path / "a"))
    a = files.read_scores(spark, str(tmp_path / "a"))
    assert {r.qid: (r.em, r.anls) for r in a.collect()} == {"1": (1, 1), "2": (0, 0.75), "3": (0, 0), "4": (1, 1)}
    name = files.write_predictions(made, str(tmp_path / "out"), agent="plain", dataset="d", variant="")
    assert name == "plain_d" and files.read_json(spark, str(tmp_path / "out/metrics/experiment=plain_d")).first().em == 0.5
    files.write_flips(a, files.score(made.withColumn("prediction", made["gold"])), str(tmp_path / "flips"))
    assert sorted((r.qid, r.flip) for r in spark.read.option("header", True).csv(str(tmp_path / "flips")).collect()) == [("2", "won"), ("3", "won")]


def test_undone(spark, tmp_path):
    ids = spark.range(5)
    assert files.undone(ids, str(tmp_path / "t"), "id").count() == 5
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert sorted(r.id for r in files.undone(ids, str(tmp_path / "t"), "id").collect()) == [3, 4]


def test_prompt(spark):
    made = spark.createDataFrame([("{b}", None)], "a string, b string").select(files.prompt("Q: {x}, {y}; {z} {\n}", x="a", y="b").alias("p"))
    assert made.first().p == "Q: {b}, ; {z} {\n}"


def test_stars(spark):
    made = spark.createDataFrame([(0.0005,), (0.001,), (0.01,), (0.05,)], "p double")
    assert [r[0] for r in made.select(evaluation.stars(made["p"])).collect()] == ["***", "**", "*", "(n.s.)"]
