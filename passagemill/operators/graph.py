"""The entity and passage graph of each package, and ranks on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import content_id, leading_index
from passagemill.operators.ordered import by_number, followers
from passagemill.session import cut


def entity_edges(mentions: DataFrame) -> DataFrame:
    """corpus_id, src (passage), dst (entity), weight: an entity's share of the passage's mentions; a passage's sum to 1."""
    total = mentions.groupBy("corpus_id", "passage_id").agg(F.sum("n").alias("total"))
    return (
        mentions.join(total, ["corpus_id", "passage_id"])
        .filter(F.col("total") > 0)
        .select("corpus_id", F.col("passage_id").alias("src"), content_id("entity", F.col("entity")).alias("dst"), (F.col("n") / F.col("total")).alias("weight"))
    )


def adjacent_edges(corpus_rows: DataFrame) -> DataFrame:
    """Passages next to each other by leading number, gaps aside, with weight 1. Passages without a number have none."""
    placed = corpus_rows.withColumn("idx", leading_index(F.col("text"))).filter(F.col("idx").isNotNull())
    pairs = followers(placed, ["corpus_id"], ["idx", "passage_id"], by_number("idx"), "passage_id", "dst")
    return pairs.filter(F.col("dst").isNotNull()).select("corpus_id", F.col("passage_id").alias("src"), "dst", F.lit(1.0).alias("weight"))


def vertices(corpus_rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """corpus_id, node_id, kind, content."""
    entities = mentions.select("corpus_id", "entity").distinct().select("corpus_id", content_id("entity", F.col("entity")).alias("node_id"), F.lit("entity").alias("kind"), F.col("entity").alias("content"))
    return entities.unionByName(corpus_rows.select("corpus_id", F.col("passage_id").alias("node_id"), F.lit("passage").alias("kind"), F.col("text").alias("content")))


def edges_at(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges (corpus_id, src, dst, ...) with a focus node (question_no, corpus_id, node_id) at either end, each once a question.

    Two joins on a key each instead of one on either key, which no engine can hash.
    """
    at = lambda end: edges.join(focus.withColumnRenamed("node_id", end), ["corpus_id", end])
    columns = ["question_no", *edges.columns]
    return at("src").select(*columns).unionByName(at("dst").select(*columns)).distinct()


def transitions(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the share of the start's strength: corpus_id, u, v, p. Self loops are dropped."""
    kept = edges.filter(F.col("src") != F.col("dst"))
    both = kept.select("corpus_id", F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionByName(
        kept.select("corpus_id", F.col("dst").alias("u"), F.col("src").alias("v"), "weight")
    )
    merged = both.groupBy("corpus_id", "u", "v").agg(F.sum("weight").alias("w"))
    strength = merged.groupBy("corpus_id", "u").agg(F.sum("w").alias("s"))
    return merged.join(strength, ["corpus_id", "u"]).select("corpus_id", "u", "v", (F.col("w") / F.col("s")).alias("p"))


def reset_vector(weights: DataFrame) -> DataFrame:
    """Node weights per question (question_no, corpus_id, node_id, w), NaN and negatives as 0, scaled to sum 1."""
    clean = F.when(F.isnan("w") | (F.col("w") < 0) | F.col("w").isNull(), 0.0).otherwise(F.col("w"))
    summed = weights.select("question_no", "corpus_id", "node_id", clean.alias("w")).groupBy("question_no", "corpus_id", "node_id").agg(F.sum("w").alias("w"))
    total = summed.groupBy("question_no").agg(F.sum("w").alias("total"))
    return summed.join(total, "question_no").filter((F.col("total") > 0) & (F.col("w") > 0)).select("question_no", "corpus_id", F.col("node_id").alias("n"), (F.col("w") / F.col("total")).alias("r"))


def personalized_pagerank(steps: DataFrame, reset: DataFrame, damping: float = 0.5, iterations: int = 20, cut_every: int = 5) -> DataFrame:
    """Ranks of all questions at once: question_no, corpus_id, n, x after ``iterations`` of x' = d P x + (1 - d) r.

    The error is at most damping ** iterations, 1e-6 by default. Each step is one join with the transitions on
    (corpus_id, node) and one aggregation. The transitions are partitioned for that join once, before the first step;
    lineage is cut every few steps by a checkpoint in the shared folder. Mass at nodes without edges is lost.
    """
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = cut(steps.select("corpus_id", F.col("u").alias("n"), "v", "p").repartition(parts, "corpus_id", "n"))
    reset = cut(reset)
    base = reset.select("question_no", "corpus_id", "n", (F.col("r") * (1 - damping)).alias("x"))
    x = reset.select("question_no", "corpus_id", "n", F.col("r").alias("x"))
    for i in range(1, iterations + 1):
        moved = x.join(steps, ["corpus_id", "n"]).select("question_no", "corpus_id", F.col("v").alias("n"), (F.col("x") * F.col("p") * damping).alias("x"))
        x = moved.unionByName(base).groupBy("question_no", "corpus_id", "n").agg(F.sum("x").alias("x"))
        if i % cut_every == 0 and i < iterations:
            x = cut(x)
    return x


def top_passages(scores: DataFrame, k: int = 5) -> DataFrame:
    """The k best passages of each question by score, ties by id: question_no, passage_id, score, rank."""
    best = Window.partitionBy("question_no").orderBy(F.desc("score"), "passage_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("question_no", "passage_id", "score", "rank")
