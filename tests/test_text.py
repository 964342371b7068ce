import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import judging as J
from passagemill.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, needle, n", [("aaaa", "aa", 2), ("Ann in Annapolis", "Ann", 2), ("abc", "x", 0), ("abc", "", 0), ("", "a", 0)])
def test_occurrences(spark, text, needle, n):
    assert one(spark, X.occurrences(F.col("t"), F.col("e")), t=text, e=needle) == n


@pytest.mark.parametrize("given, plain", [("The U.S.A.!", "usa"), (None, ""), ("a the an", ""), ("Año  nuevo", "año nuevo"), ("Athens and the sea", "athens and sea"), ("a\tB\nc", "b c")])
def test_normalize_answer(spark, given, plain):
    assert one(spark, X.normalize_answer(F.col("s")), s=given) == plain


@pytest.mark.parametrize("prediction, gold, hit", [("It was Germany.", "germany", 1), ("German", "Germany", 0), ("anything", "The", 1), ("x", " ", 0), (None, "x", 0), ("x", None, 0)])
def test_contain_match(spark, prediction, gold, hit):
    assert one(spark, X.contain_match(F.col("p"), F.col("g")), p=prediction, g=gold) == hit


@pytest.mark.parametrize("reply, between, after, stripped", [
    ("no marker ", "no marker ", "no marker ", "no marker"), ("T Answer: x ", "x", "x", "x"), ("Answer: a Answer: b", "a", "a Answer: b", "a Answer: b"), (None, None, None, None)])
def test_extract_answer(spark, reply, between, after, stripped):
    assert [one(spark, X.extract_answer(F.col("r"), m), r=reply) for m in ("between", "after", "stripped")] == [between, after, stripped]


def test_judge_replies(spark):
    r = F.col("r")
    assert one(spark, X.verdict(r), r=" Correct\n") == 1.0 and one(spark, X.verdict(r), r="correct.") == 0.0
    assert one(spark, J.rating(J.reply_object(r)), r='```json\n{"score": 2}\n```') == 2.0
    assert one(spark, J.rating(J.reply_object(r)), r='x {"rating": "1.5"} y') == 1.5
    assert one(spark, J.rating(J.reply_object(r)), r='{"score": 3}') is None and one(spark, J.rating(J.reply_object(r)), r="none") is None


def test_parts_of_passages(spark):
    title, body = X.title_and_body(F.col("p"))
    assert one(spark, title, p="T\nb\nc") == "T" and one(spark, body, p="T\nb\nc") == "b\nc"
    assert one(spark, title, p="abc") == "" and one(spark, body, p="abc") == "abc"
    assert one(spark, X.leading_index(F.col("p")), p=" 12:x") == 12 and one(spark, X.leading_index(F.col("p")), p="x:1") is None
    assert one(spark, X.namespace_of(X.content_id("passage", F.col("p"))), p="é") == "passage"
    assert one(spark, X.word_count(F.col("p")), p=" a  b\nc ") == 3 and one(spark, X.word_count(F.col("p")), p=None) == 0
    assert one(spark, X.value_slug(F.lit(0.4)), p="") == "0p4"


def test_prompts_and_attributes(spark):
    rows = spark.createDataFrame([(["a", "b"], "q?")], "p array<string>, q string")
    assert rows.select(X.prompt(F.col("p"), F.col("q")).alias("x")).first().x == "a\nb\nQuestion: q?\n Thought: "
    assert rows.select(X.judge_context(F.col("p")).alias("x")).first().x == "a\nb"
    q = F.lit("In what year?")
    assert rows.select(X.asks_attribute(q, ["year"]).alias("x")).first().x
    assert rows.select(X.attribute_overlap(q, F.lit("the year 9"), ["year", "town"]).alias("x")).first().x == 1


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.norm(F.col("a")).alias("n"), V.unit(F.col("a")).alias("u"), V.min_max(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("m")).first()
    assert (got.d, got.n, got.m) == (3.0, 5.0, 1.0) and got.u == [0.6, 0.8]


def _judged(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_replies_of_judges(spark):
    obj = J.reply_object(F.col("r"))
    for reply, want in (('{"a": 1}', '{"a":1}'), ('```json\n{"a": 1}\n```', '{"a":1}'), ('so {"a": {"b": 2}} it is', '{"a":{"b":2}}'), ("[1]", "{}"), ("12", "{}"), ("{'a': 1}", "{}"), ("x } {", "{}"), (None, "{}"), ("", "{}")):
        assert _judged(spark, F.to_json(obj), r=reply) == want, reply
    assert _judged(spark, J.rating(obj), r='{"score": null, "rating": 1}') is None
    assert _judged(spark, J.rating(obj), r='{"score": 0, "rating": 2}') == 0.0


def test_valid_classifications(spark):
    found = J.valid_classifications(J.reply_object(F.col("r")), F.col("e"))
    items = [
        {"statement": "s1", "reason": "r", "attributed": 1}, {"statement": "s1", "reason": "again", "attributed": 0}, {"statement": "foreign", "reason": "r", "attributed": 1},
        {"statement": "s2", "attributed": 1}, {"statement": "s2", "reason": None, "attributed": 2}, "text", {"statement": "s3", "reason": "r", "attributed": "1"},
        {"statement": "s2", "reason": None, "attributed": True}, {"statement": "s3", "reason": "r", "attributed": 0.0},
    ]
    import json

    got = _judged(spark, found, r=json.dumps({"classifications": items}), e=["s1", "s2", "s3", "s4"])
    assert [(x.statement, x.reason, x.attributed) for x in got] == [("s1", "r", 1), ("s2", "None", 1), ("s3", "r", 0)]
    for reply in ('{"classifications": []}', '{"classifications": {"statement": "s1"}}', "{}", "no", '{"classifications": [{"statement": "x", "reason": "", "attributed": 1}]}'):
        assert _judged(spark, found, r=reply, e=["s1"]) is None
    assert _judged(spark, J.missing_statements(found, F.col("e")), r='{"classifications": [{"statement": "s2", "reason": "", "attributed": 1}]}', e=["s1", "s2", "s3"]) == ["s1", "s3"]


def test_single_classification(spark):
    one_ = J.single_classification(J.reply_object(F.col("r")), F.lit("s"))
    for reply, want in (
        ('{"attributed": 1, "reason": "r"}', ("s", "r", 1)), ('{"classifications": [{"attributed": 0, "reason": "r"}]}', ("s", "r", 0)),
        ('{"classifications": [{"attributed": 0, "reason": "r"}, {"attributed": 0, "reason": "r"}]}', None), ('{"classifications": []}', None), ('{"attributed": 3, "reason": "r"}', None), ('{"attributed": 1}', None), ("no", None),
    ):
        got = _judged(spark, one_, r=reply)
        assert (tuple(got) if got else None) == want, reply


def test_evaluations(spark):
    rows = [(1, [2.0, 1.0], [("a", "r", 1), ("b", "r", 0)], ["a", "b"]), (2, [None, 1.0], None, ["a"]), (3, [2.0, 2.0], [("a", "r", 1)], ["a", "b"]), (4, [None, None], None, [])]
    df = spark.createDataFrame(rows, f"id int, ratings array<double>, found array<{J.CLASSIFICATION}>, e array<string>")
    got = {r.id: tuple(r)[1:] for r in df.select("id", *J.evaluation(F.col("ratings"), F.col("found"), F.col("e"))).collect()}
    assert got == {1: (0.75, 0.5, 2, 2, 2, True), 2: (0.5, None, 1, 0, 1, False), 3: (1.0, 1.0, 2, 1, 2, False), 4: (None, None, 0, 0, 0, False)}


def test_gold_fields_and_small_scalars(spark):
    results = spark.createDataFrame([("a", "q1"), ("b", "other"), ("c", "q3")], "id string, question string")
    asked = spark.createDataFrame([("a", "q1", "g"), ("b", "q2", "h")], "id string, question string, gold string")
    assert sorted(map(tuple, J.gold_mismatches(results, asked, ["id"]).collect())) == [("b", "other text"), ("c", "no question")]
    assert J.attach_gold(results.drop("question"), asked, ["id"]).count() == 2
    row = spark.range(1).select(X.document_text(F.lit("T"), F.array(F.lit("a. "), F.lit("b."))).alias("d"), X.document_text(F.lit(None).cast("string"), F.array(F.lit("a"))).alias("e"), X.seconds_each(F.lit(6.0), F.lit(3)).alias("s"), X.seconds_each(F.lit(6.0), F.lit(0)).alias("z"), X.seconds_per_million(F.lit(2.0), F.lit(500000)).alias("m")).first()
    assert tuple(row) == ("T\na. b.", "\na", 2.0, None, 4.0)
