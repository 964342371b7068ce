"""Judges' replies about retrieved contexts: what is valid in them, and the scores made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFICATION = "struct<statement:string,reason:string,attributed:int>"


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def reply_object(reply: Column) -> Column:
    """The JSON object in a judge's reply, as a variant: code fences aside, the whole reply, else what stands from the
    first to the last brace, if it parses to an object. Anything else is an empty object."""
    bare = F.btrim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"```(json)?", ""), F.lit(" \t\r\n"))
    whole, part = F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(\{[\s\S]*\})", 1))
    return F.when(_is_object(whole), whole).when(_is_object(part), part).otherwise(F.parse_json(F.lit("{}")))


def _kind(value: Column, path: str) -> Column:
    """The type of what stands at a path: null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def rating(value: Column) -> Column:
    """``score``, or ``rating`` where there is no score, if it is a number from 0 to 2, written as a number or in quotes."""
    key = lambda name: F.try_variant_get(value, f"$.{name}", "double")
    given = F.when(_kind(value, "$.score").isNotNull(), key("score")).otherwise(key("rating"))
    return F.when((given >= 0) & (given <= 2), given)


def _attributed(item: Column) -> Column:
    """0 or 1 where an item says so by a number or a truth value; texts don't count."""
    kind = _kind(item, "$.attributed")
    number = F.when(kind != "STRING", F.try_variant_get(item, "$.attributed", "double"))
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def _text(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "string")


def valid_classifications(value: Column, evidence: Column) -> Column:
    """Classifications of a reply that are objects with statement, reason and 0 or 1, and whose statement is word for
    word one of the reference evidence; of several of one statement the first. Null where none is left."""
    items = F.try_variant_get(value, "$.classifications", "array<variant>")
    fields = F.transform(
        F.filter(items, lambda x: _is_object(x) & _attributed(x).isNotNull() & _kind(x, "$.statement").isNotNull() & _kind(x, "$.reason").isNotNull()),
        lambda x: F.struct(_text(x, "$.statement").alias("statement"), F.coalesce(_text(x, "$.reason"), F.lit("None")).alias("reason"), _attributed(x).alias("attributed")),
    )
    kept = F.filter(fields, lambda x: F.array_contains(evidence, x["statement"]))
    none = F.array().cast(f"array<{CLASSIFICATION}>")
    again = lambda seen, x: F.exists(seen, lambda s: s["statement"] == x["statement"])
    first = F.aggregate(kept, none, lambda seen, x: F.when(again(seen, x), seen).otherwise(F.concat(seen, F.array(x).cast(f"array<{CLASSIFICATION}>"))))
    return F.nullif(first, none)


def single_classification(value: Column, statement: Column) -> Column:
    """The classification in a reply about one statement: the only member of its list, or the reply itself. Else null."""
    items = F.try_variant_get(value, "$.classifications", "array<variant>")
    listed = _kind(value, "$.classifications").isNotNull()
    item = F.when(listed & (F.size(items) == 1), F.element_at(items, 1)).when(~listed, value)
    good = _is_object(item) & _attributed(item).isNotNull() & _kind(item, "$.reason").isNotNull()
    return F.when(good, F.struct(statement.alias("statement"), F.coalesce(_text(item, "$.reason"), F.lit("None")).alias("reason"), _attributed(item).alias("attributed")))


def missing_statements(classified: Column, evidence: Column) -> Column:
    """Evidence without a classification, in order: what is to be asked about once more."""
    known = F.transform(F.coalesce(classified, F.array().cast(f"array<{CLASSIFICATION}>")), lambda x: x["statement"])
    return F.filter(evidence, lambda e: ~F.array_contains(known, e))


def evaluation(ratings: Column, classified: Column, evidence: Column) -> list[Column]:
    """context_relevance, evidence_recall (null where nothing is known), what they are made from, and whether all is there.

    Relevance is the mean of valid ratings over 2, recall the share of classified evidence that is attributed. An
    evaluation is complete with two ratings and a classification of each piece of evidence.
    """
    given = F.filter(ratings, lambda r: r.isNotNull() & ~F.isnan(r))
    found = F.coalesce(classified, F.array().cast(f"array<{CLASSIFICATION}>"))
    n_ratings, n_found = F.size(given), F.size(found)
    total = F.aggregate(given, F.lit(0.0), lambda s, r: s + r / 2)
    attributed = F.aggregate(found, F.lit(0), lambda s, x: s + x["attributed"])
    return [
        F.when(n_ratings > 0, total / n_ratings).alias("context_relevance"),
        F.when(n_found > 0, attributed / n_found).alias("evidence_recall"),
        F.size(evidence).alias("n_reference"),
        n_found.alias("n_classified"),
        n_ratings.alias("n_ratings"),
        ((n_ratings == 2) & (n_found > 0) & (n_found == F.size(evidence))).alias("complete"),
    ]


def attach_gold(results: DataFrame, questions: DataFrame, key: list[str]) -> DataFrame:
    """Results with the fields of their questions, by key: each question of the results once on either side of a join."""
    return results.join(questions, key)


def gold_mismatches(results: DataFrame, questions: DataFrame, key: list[str], text: str = "question") -> DataFrame:
    """Keys of results without a question, or whose question text is another one: none if results fit their questions."""
    asked = questions.select(*key, F.col(text).alias("_asked"), F.lit(True).alias("_known"))
    both = results.select(*key, F.col(text).alias("_said")).join(asked, key, "left")
    reason = F.when(F.col("_known").isNull(), "no question").when(~F.col("_said").eqNullSafe(F.col("_asked")), "other text")
    return both.select(*key, reason.alias("reason")).filter(F.col("reason").isNotNull())


def default_judge(context: Column, evidence: Column) -> Column:
    """A judge without a model: evidence that stands in the context is attributed. Replies as models do, fenced and in prose."""
    items = F.transform(evidence, lambda e: F.struct(e.alias("statement"), F.lit("by wording").alias("reason"), F.contains(context, e).cast("int").alias("attributed")))
    return F.concat(F.lit("Here is my judgement:\n```json\n"), F.to_json(F.struct(items.alias("classifications"))), F.lit("\n```"))


def default_relevance(context: Column, gold: Column, name: str) -> Column:
    """2 where the gold answer stands in the context, 1 where the context has any text, else 0; as a reply."""
    score = F.when(F.contains(F.lower(context), F.lower(gold)), 2).when(F.length(context) > 0, 1).otherwise(0)
    return F.concat(F.lit(f'{{"{name}": "'), score.cast("string"), F.lit('"}'))
