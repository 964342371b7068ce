"""Input packages: building, checking and comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import chunk_of, word_count
from passagemill.operators.ordered import by_digest, positions
from passagemill.operators.sampling import seeded_key


def document_places(corpus_rows: DataFrame) -> DataFrame:
    """Each distinct chunk and place it comes from: text_sha256, corpus_id, passage_idx. A place is a row, so a chunk may have any number."""
    return corpus_rows.select(F.sha2(chunk_of(F.col("text")).cast("binary"), 256).alias("text_sha256"), "corpus_id", "passage_idx").distinct()


def documents_with_locations(corpus_rows: DataFrame) -> DataFrame:
    """Each distinct chunk once, with the number of its places and packages and the first place: what adds up before the shuffle."""
    first = F.min(F.struct("corpus_id", "passage_idx")).alias("first")
    places = document_places(corpus_rows).groupBy("text_sha256", "corpus_id").agg(F.count("*").alias("n"), F.min("passage_idx").alias("passage_idx"))
    found = places.groupBy("text_sha256").agg(F.sum("n").alias("n_locations"), F.count("*").alias("n_packages"), first)
    return found.select("text_sha256", "n_locations", "n_packages", F.col("first.corpus_id").alias("first_corpus"), F.col("first.passage_idx").alias("first_idx"))


def constructed_package(required: DataFrame, candidates: DataFrame, n_distractors: int, seed: str) -> DataFrame:
    """Required passages of each package and n seeded distractors from the rest, shuffled and numbered from 0.

    ``required``: corpus_id, passage_id. Columns out: corpus_id, passage_id, role, position.
    """
    need = required.select("corpus_id", "passage_id").distinct().withColumn("role", F.lit("required"))
    rest = candidates.join(need, ["corpus_id", "passage_id"], "left_anti").withColumn("sample_key", seeded_key(seed, F.col("passage_id")))
    best = Window.partitionBy("corpus_id").orderBy("sample_key", "passage_id")
    extra = rest.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n_distractors).select("corpus_id", "passage_id", F.lit("distractor").alias("role"))
    both = need.unionByName(extra).withColumn("shuffle_key", seeded_key(f"{seed}:shuffle", F.col("passage_id")))
    placed = positions(both, ["corpus_id"], ["shuffle_key", "passage_id"], by_digest("shuffle_key"))
    return placed.select("corpus_id", "passage_id", "role", "position")


def question_positions(needs: DataFrame, placed: DataFrame) -> DataFrame:
    """Where the passages that a question needs stand in the constructed package: needs (corpus_id, passage_id, ...) with position."""
    return needs.join(placed.select("corpus_id", "passage_id", "position"), ["corpus_id", "passage_id"])


def package_statistics(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages by role, signs and words of each constructed package."""
    rows = placed.join(texts.select("corpus_id", "passage_id", "text"), ["corpus_id", "passage_id"])
    return rows.groupBy("corpus_id").agg(
        F.count_if(F.col("role") == "required").alias("n_required"),
        F.count_if(F.col("role") != "required").alias("n_distractors"),
        F.count("*").alias("n_passages"),
        F.sum(F.length("text").cast("bigint")).alias("n_chars"),
        F.sum(word_count(F.col("text"))).alias("n_words"),
    )


def support_passages(fragments: DataFrame, corpus_rows: DataFrame) -> DataFrame:
    """Passages that hold a stated fragment in lower case: fragments with passage_idx, passage_id and n_matches.

    ``fragments``: corpus_id, fragment and what names it. They are a stated set, far fewer than the passages, and meet
    the passages of their package; blank ones stand nowhere. A fragment supports a case only where n_matches is 1;
    without a match it has one row with n_matches 0.
    """
    keys = fragments.columns
    wanted = fragments.distinct().withColumn("low", F.lower("fragment"))
    texts = corpus_rows.select("corpus_id", "passage_id", "passage_idx", F.lower("text").alias("text"))
    held = wanted.filter(F.trim("low") != "").join(texts, "corpus_id").filter(F.contains("text", "low")).select(*keys, "passage_id", "passage_idx")
    n = held.groupBy(*keys).agg(F.count("*").alias("n_matches"))
    return wanted.select(*keys).join(n, keys, "left").join(held, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def case_packages(support: DataFrame, corpus_rows: DataFrame, n_distractors: int, seed: str) -> DataFrame:
    """For each case its support passages and n seeded distractors of the package, by their original numbers.

    ``support``: question_no, corpus_id, passage_id. Columns out: question_no, corpus_id, passage_id, passage_idx, role.
    A distractor is seeded by the package, not the case: the first n + (supports of the case) are looked at, which
    leaves n after the supports are taken out.
    """
    own = support.select("question_no", "corpus_id", "passage_id").distinct()
    size = own.groupBy("question_no", "corpus_id").agg(F.count("*").alias("n_support"))
    most = size.agg(F.max("n_support")).first()[0] or 0
    order = Window.partitionBy("corpus_id").orderBy("sample_key", "passage_id")
    keyed = corpus_rows.select("corpus_id", "passage_id", seeded_key(seed, F.col("passage_id")).alias("sample_key"))
    first = keyed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n_distractors + most)
    other = size.join(first, "corpus_id").join(own, ["question_no", "corpus_id", "passage_id"], "left_anti")
    place = Window.partitionBy("question_no", "corpus_id").orderBy("sample_key", "passage_id")
    drawn = other.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n_distractors).select("question_no", "corpus_id", "passage_id", F.lit("distractor").alias("role"))
    both = own.withColumn("role", F.lit("support")).unionByName(drawn)
    return both.join(corpus_rows.select("corpus_id", "passage_id", "passage_idx"), ["corpus_id", "passage_id"]).select("question_no", "corpus_id", "passage_id", "passage_idx", "role")


def verify(packages: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """Counts that a package states beside those found: corpus_id, stated and found numbers, and whether they agree."""
    stated = packages.groupBy("corpus_id").agg(F.max("passage_count").alias("stated_passages"), F.max("question_count").alias("stated_questions"))
    p = passages.select("corpus_id", "passage_idx").distinct().groupBy("corpus_id").agg(F.count("*").alias("found_passages"))
    q = questions.select("corpus_id", "question_no").distinct().groupBy("corpus_id").agg(F.count("*").alias("found_questions"))
    joined = stated.join(p, "corpus_id", "left").join(q, "corpus_id", "left").fillna(0, ["found_passages", "found_questions"])
    agree = (F.col("stated_passages") == F.col("found_passages")) & (F.col("stated_questions") == F.col("found_questions"))
    return joined.withColumn("agrees", F.coalesce(agree, F.lit(False)))


def new_texts(known: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Arriving rows whose content isn't known yet, each content once."""
    return arriving.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")
