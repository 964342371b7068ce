import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from passagemill.functions import models as M
from passagemill.sources import identity as I
from passagemill.sources import inputs as N
from passagemill.sources import sinks as K
from passagemill.sources.files import exists, tree_bytes
from passagemill.streaming.upsert import hourly_arrivals, passage_stream, upsert_texts


def test_datasets_and_fixtures(spark, tmp_path):
    (tmp_path / "questions.json").write_text(json.dumps([{"question": "q0", "answer": "a"}, {"id": "x", "question": "q1", "evidence": ["e"]}]))
    (tmp_path / "chunks.json").write_text(json.dumps(["T\nbody", "é"]))
    questions, passages = N.read_dataset(spark, str(tmp_path))
    assert [r.question_id for r in questions.collect()] == ["0", "x"]
    assert [r.passage for r in passages.collect()] == ["0:T\nbody", "1:é"]
    N.check_package(passages, questions)
    with pytest.raises(N.PackageError):
        N.check_package(passages.unionByName(passages))
    (tmp_path / "fixture.json").write_text(json.dumps({"passages": ["a", "b"], "question": "q", "expected_answer": "x"}, indent=1))
    assert [r.passage for r in N.read_fixture(spark, str(tmp_path / "fixture.json")).collect()] == ["0:a", "1:b"]
    assert N.concat_chunks([passages, passages]).select("dataset_no", "passage_idx").distinct().count() == 4
    assert {r.name for r in N.file_hashes(spark, str(tmp_path)).collect()} >= {"questions.json", "chunks.json"}


def test_usage_and_pending(spark, tmp_path):
    log = tmp_path / "usage.jsonl"
    assert N.usage_totals(spark, str(log)).first().total_tokens == 0
    log.write_text('{"model":"m","usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}}\n{"model":"m","usage":null}\n')
    assert N.usage_totals(spark, str(log)).first().total_tokens == 5
    assert N.usage_totals(spark, log.as_uri()).first().total_tokens == 5
    before, after = N.usage_totals(spark, str(tmp_path / "none")), N.usage_totals(spark, log.as_uri())
    assert N.usage_increment(before, after).first().prompt_tokens == 3 and N.usage_increment(after, after).first().total_tokens == 0
    assert tree_bytes(spark, tmp_path.as_uri()) >= log.stat().st_size
    items, done = spark.range(4), spark.createDataFrame([(0, True), (1, False)], "id bigint, whole boolean")
    assert sorted(r.id for r in N.pending(items, done, "id", F.col("whole")).collect()) == [1, 2, 3]


def test_stores_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "hash_id string, n int")
    store = str(tmp_path / "store")
    assert K.append_missing(rows, store, "hash_id") == 2 and K.append_missing(rows, store, "hash_id") == 0
    with pytest.raises(AnalysisException):
        K.write_new(rows, store)
    K.write_csv_report(spark.createDataFrame([("x,y", None), ('q"', "1")], "task string, value string"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text(encoding="utf-8") == '﻿task,value\n"x,y",\n"q""",1\n'
    K.write_json_report(rows, (tmp_path / "r.json").as_uri())
    K.write_json_report(rows, str(tmp_path / "r.json"))
    for _ in range(2):
        K.write_extraction(rows, rows.limit(1), (tmp_path / "extraction").as_uri())
    assert spark.read.parquet(str(tmp_path / "extraction/sentence_entities")).count() == 1
    assert len(json.loads((tmp_path / "r.json").read_text())) == 3
    nodes = spark.createDataFrame([("n1", 'a<&"'), ("n2", None)], "node_id string, content string")
    K.write_graph(nodes, spark.createDataFrame([("n1", "n2", 0.5)], "src string, dst string, weight double"), str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    parts = [tmp_path / "g/0-head", *sorted((tmp_path / "g/1-nodes").glob("*.txt")), *sorted((tmp_path / "g/2-edges").glob("*.txt")), tmp_path / "g/3-tail"]
    document = ET.fromstring("".join(p.read_text() for p in parts))
    assert len(document[2].findall("{*}node")) == 2 and len(document[2].findall("{*}edge")) == 1


def test_identities(spark, tmp_path):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "passage_idx bigint, passage string")
    b = spark.createDataFrame([(0, "y"), (1, "x")], "passage_idx bigint, passage string")
    mark = lambda x: I.table_fingerprint(x, "passage_idx", "passage")
    assert mark(a) == mark(a.repartition(3)) != mark(b)
    assert mark(a.filter("false")) != mark(a)
    one = I.graph_stages("c", "q", "e", "m", {"k": 5})
    two = I.graph_stages("c", "q", "e", "m2", {"k": 5})
    assert one["extraction"].mark == two["extraction"].mark and one["graph"].mark == two["graph"].mark and one["ranking"].mark != two["ranking"].mark
    assert I.Stage("a", {"k": 1}).mark != I.Stage("a", {"k": "1"}).mark != I.Stage("a", {"k": True}).mark
    phrases = I.phrase_stages("c", "q", "e", "m", "v", {})
    other = I.phrase_stages("c2", "q", "e", "m", "v", {})
    assert phrases["asked_names"].mark == other["asked_names"].mark and phrases["triples"].mark != other["triples"].mark
    for path in (str(tmp_path / "run"), (tmp_path / "run2").as_uri()):
        assert I.take(spark, path, one) and not I.take(spark, path, one)
        with pytest.raises(I.RunConflict):
            I.take(spark, path, two)
    folder, done = I.place_of(spark, str(tmp_path), one["graph"])
    assert not done and folder.endswith(one["graph"].mark)
    a.write.parquet(folder)
    assert I.place_of(spark, tmp_path.as_uri(), one["graph"])[1]


def test_folders_are_used_again(spark, tmp_path):
    root = tmp_path.as_uri() + "/cache"
    one, two = (I.graph_stages("c", "q", "e", m, {"k": 5}) for m in ("m", "m2"))
    assert I.settle(spark, root, {"extraction": one["extraction"]}) == (root, "new")
    assert I.settle(spark, root, one) == (root, "upgraded") and I.settle(spark, root, one) == (root, "same")
    spark.range(3).write.parquet(f"{root}/extraction")
    folder, how = I.settle(spark, root, two)
    assert how == "variant" and folder != root and spark.read.parquet(f"{folder}/extraction").count() == 3
    assert I.settle(spark, root, two) == (folder, "same")
    different = I.graph_stages("c2", "q", "e", "m", {"k": 5})
    folder, _ = I.settle(spark, root, different)
    assert not exists(spark, f"{folder}/extraction")


def _fails_once(calls={}):  # noqa: B006
    def model(prompt):
        calls[prompt] = calls.get(prompt, 0) + 1
        if prompt == "bad" or (prompt == "flaky" and calls[prompt] == 1):
            raise TimeoutError("no reply")
        return f"Answer: {prompt}"

    return model


def test_model_calls_fail_alone(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None), (4, "flaky")], "id bigint, prompt string").coalesce(1)
    got = {r.id: r for r in M.generate(prompts, _fails_once(), "id").collect()}
    assert got[1].reply == "Answer: good" and got[4].reply == "Answer: flaky"
    assert got[2].reply == M.REJECTED and got[2].error_type == "TimeoutError" and got[3].reply is None
    guarded = M.generate(prompts, M.no_model, "id").filter("id = 1").first()
    assert guarded.error_type == "ModelCalled"


def test_encoders_and_extractors(spark):
    texts = spark.createDataFrame([("h1", "the mill"), ("h2", "!"), ("h1", "the mill")], "hash_id string, text string")
    vectors = {r.hash_id: r.v for r in texts.select("hash_id", M.hashed_embedding(F.col("text")).alias("v")).collect()}
    assert abs(sum(x * x for x in vectors["h1"]) - 1) < 1e-9 and vectors["h2"] is None
    fresh = M.encode(texts, texts.filter("hash_id = 'h2'"), lambda ts: [[float(len(t))] for t in ts]).collect()
    assert [(r.hash_id, list(r.embedding)) for r in fresh] == [("h1", [8.0])]
    found = M.extract(texts, lambda t: [(t, "mill", "FAC"), (t, "two", "CARDINAL")], "hash_id").collect()
    assert {r.entity for r in found} == {"mill"}
    reply = spark.createDataFrame([('{"triples": [["a","is","b"], ["x","y"], ["p","","q"]]}',), ("no",)], "r string")
    assert [r.t for r in reply.select(M.parse_triples(F.col("r")).alias("t")).collect()] == [[["a", "is", "b"]], []]


def test_streams_take_each_text_once(spark, tmp_path):
    rows = spark.createDataFrame([("c", "0:a", "2025-01-01 00:10:00"), ("c", "0:a", "2025-01-01 00:20:00"), ("c", None, "2025-01-01 05:00:00"), ("d", "1:b", "2025-01-01 00:30:00")], "corpus_id string, passage string, at string").select("corpus_id", "passage", F.to_timestamp("at").alias("loaded_at"))
    folder, store, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))
    rows.write.parquet(folder)
    schema = "corpus_id string, passage string, loaded_at timestamp"
    upsert_texts(passage_stream(spark, folder, schema), store, marks).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    rows.limit(1).unionByName(spark.createDataFrame([("e", "2:c", None)], schema)).write.mode("append").parquet(folder)
    upsert_texts(passage_stream(spark, folder, schema), store, marks).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["0:a", "1:b", "2:c"]
    hourly_arrivals(passage_stream(spark, folder, schema)).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] >= 5


def test_packages_are_written_once_and_checked(spark, tmp_path):
    from passagemill.sources import packages as P

    questions = spark.createDataFrame([("a", "q?")], "id string, question string")
    passages = spark.createDataFrame([(0, "0:a mill"), (1, None)], "passage_idx bigint, passage string")
    facts = dict(source_dataset="d", seed=1, question_ids=["a"], source_question_indices=[0], source_questions_mark="x", source_chunks_mark="y", corpus_scope="full")
    manifest = P.manifest_of(questions, passages, **facts)
    assert manifest["statistics"] == {"question_count": 1, "passage_count": 2, "character_count": 8, "word_count": 2}
    folder = (tmp_path / "p").as_uri()
    with pytest.raises(N.PackageError):
        P.open_package(spark, folder)
    assert P.save_package(spark, folder, questions, passages, manifest) and not P.save_package(spark, folder, questions, passages, manifest)
    with pytest.raises(N.PackageError, match="seed"):
        P.save_package(spark, folder, questions, passages, {**manifest, "seed": 2})
    found = P.open_package(spark, folder)
    assert found[0].count() == 1 and found[2]["corpus_scope"] == "full"
    passages.limit(1).write.mode("append").parquet(f"{folder}/passages")
    with pytest.raises(N.PackageError):
        P.open_package(spark, folder)
