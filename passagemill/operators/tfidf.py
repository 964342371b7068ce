"""TF-IDF over word unigrams and bigrams, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions.text import fold
from passagemill.session import cut

# English words that carry no topic.
STOP_WORDS = tuple("""
a about above across after again against all almost along already also although always am among an and another any are around as at
back be became because become been before behind being below between both but by
can cannot could did do does done down during each either else enough even ever every
few first for from further get give go had has have he hence her here hers him his how however
i if in indeed into is it its itself just last least less made many may me might mine more most much must my
neither never next no nobody none nor not nothing now of off often on once one only onto or other others our out over own
per perhaps please put rather same see seem several she should since so some such
than that the their them then there these they this those though through thus to together too toward two
under until up upon us very was we well were what when where whether which while who whole whom whose why will with within without would yet you your
""".split())
WORDS = r"[\p{L}\p{M}\p{N}_]{2,}"


def terms_of(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of at least two letters, marks or figures of any script in lower case without stop words, and pairs of neighbours among those."""
    words = F.filter(F.regexp_extract_all(fold(text), F.lit(WORDS), F.lit(0)), lambda w: ~w.isin(*stop_words))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
    return F.concat(words, pairs)


def weights(texts: DataFrame, key: list[str], scope: list[str]) -> DataFrame:
    """scope, key, term, w: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each text's vector of length 1.

    Document frequencies are counted within each scope. Texts without terms have no rows.
    """
    tf = cut(texts.select(*scope, *key, F.explode(terms_of(F.col("text"))).alias("term")).groupBy(*scope, *key, "term").agg(F.count("*").alias("tf")))
    n = texts.groupBy(*scope).agg(F.count("*").alias("n_texts"))
    df = tf.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    idf = df.join(n, scope).select(*scope, "term", (F.log((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, [*scope, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*scope, *key)))  # a text's terms, no more
    return raw.select(*scope, *key, "term", (F.col("w") / length).alias("w"), "idf")


def query_weights(queries: DataFrame, idf: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """The same for queries, with the frequencies of the texts; terms that no text has are left out."""
    tf = queries.select(*scope, key, F.explode(terms_of(F.col("question"))).alias("term")).groupBy(*scope, key, "term").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, [*scope, "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    length = raw.groupBy(*scope, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, [*scope, key]).select(*scope, key, "term", (F.col("w") / F.col("length")).alias("w"))
