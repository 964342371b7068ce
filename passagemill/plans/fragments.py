"""SQL of the relations that many checks share, as WITH clauses. It states the same relations as the operators do."""

# What the operators take for names and tokens, stated once more for the checks.
NAME_PATTERN = "[A-Z][a-z]+ [A-Z][a-z]+"
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
_UPPER = "".join(chr(c) for c in [*range(65, 592), *range(880, 1328)] if chr(c).lower() != chr(c) and len(chr(c).lower()) == 1)
_LOWER = "".join(c.lower() for c in _UPPER)


def folded(text: str) -> str:
    """Latin, Greek and Cyrillic capitals made small, sign by sign."""
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def tokens(text: str) -> str:
    """Words of four letters or more where there are spaces, and pairs of signs in scripts without."""
    words = f"regexp_extract_all(regexp_replace({folded(text)}, '[{UNSPACED}]+', ' ', 'g'), '[\\p{{L}}\\p{{M}}]{{4,}}')"
    runs = f"regexp_extract_all({text}, '[{UNSPACED}]{{2,}}')"
    return f"list_distinct(list_concat({words}, flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"


CORPUS = """
corpus AS (
  SELECT corpus_id, passage_id, min(passage_idx) AS passage_idx, min(passage) AS text
  FROM passages WHERE passage IS NOT NULL GROUP BY 1, 2)
"""
MENTIONS = f"""
found AS (SELECT corpus_id, passage_id, text, unnest(list_distinct(regexp_extract_all(text, '{NAME_PATTERN}'))) AS entity FROM corpus),
mention AS (
  SELECT corpus_id, passage_id, entity, CAST((length(text) - length(replace(text, entity, ''))) / length(entity) AS BIGINT) AS n FROM found)
"""
SENTENCES = f"""
sentence AS (
  SELECT DISTINCT corpus_id, 'sentence-' || md5(s) AS sentence_id, s AS sentence FROM (
    SELECT corpus_id, trim(unnest(string_split_regex(regexp_replace(text, '^\\d+:', ''), '[.!?]+\\s+|\\n+')), E' \\t\\r\\n') AS s FROM corpus)
  WHERE s <> ''),
smention AS (SELECT corpus_id, sentence_id, unnest(list_distinct(regexp_extract_all(sentence, '{NAME_PATTERN}'))) AS entity FROM sentence)
"""
QUESTIONS = f"""
asked AS (
  SELECT question_no, min(corpus_id) AS corpus_id, min(question) AS question
  FROM questions WHERE question_no % 100 = 0 AND question IS NOT NULL GROUP BY 1),
asked_entity AS (
  SELECT DISTINCT question_no, corpus_id, lower(e) AS entity
  FROM (SELECT question_no, corpus_id, unnest(regexp_extract_all(question, '{NAME_PATTERN}')) AS e FROM asked))
"""
EDGES = """
edge AS (
  SELECT corpus_id, passage_id AS src, 'entity-' || md5(entity) AS dst, n / sum(n) OVER (PARTITION BY corpus_id, passage_id) AS weight, 'mention' AS kind FROM mention),
numbered AS (
  SELECT corpus_id, passage_id, CAST(nullif(regexp_extract(trim(text, E' \\t\\r\\n'), '^(\\d+):', 1), '') AS BIGINT) AS idx FROM corpus),
adjacent AS (
  SELECT corpus_id, src, dst, CAST(1 AS DOUBLE) AS weight, 'adjacent' AS kind FROM (
    SELECT corpus_id, passage_id AS src, lead(passage_id) OVER (PARTITION BY corpus_id ORDER BY idx, passage_id) AS dst
    FROM numbered WHERE idx IS NOT NULL) WHERE dst IS NOT NULL)
"""
SEEDS = """
entity_word AS (
  SELECT corpus_id, entity, len(w) AS ne, unnest(w) AS gram FROM (
    SELECT corpus_id, entity, list_distinct(list_transform(range(1, greatest(length(entity) - 2, 1) + 1), lambda i: substr(lower(entity), i, 3))) AS w
    FROM (SELECT DISTINCT corpus_id, entity FROM mention))),
asked_word AS (
  SELECT question_no, corpus_id, entity AS asked, len(w) AS nq, unnest(w) AS gram FROM (
    SELECT *, list_distinct(list_transform(range(1, greatest(length(entity) - 2, 1) + 1), lambda i: substr(entity, i, 3))) AS w FROM asked_entity)),
seed AS (
  SELECT question_no, corpus_id, asked, entity, score FROM (
    SELECT *, row_number() OVER (PARTITION BY question_no, corpus_id, asked ORDER BY score DESC, entity) AS nth FROM (
      SELECT question_no, corpus_id, asked, entity, count(*) / sqrt(CAST(nq * ne AS DOUBLE)) AS score
      FROM asked_word JOIN entity_word USING (corpus_id, gram) GROUP BY question_no, corpus_id, asked, entity, nq, ne))
  WHERE nth = 1),
start AS (SELECT question_no, corpus_id, entity, max(score) AS score FROM seed GROUP BY 1, 2, 3)
"""


def similarity(name: str, texts: str, key: str, text: str) -> str:
    """Token-set cosines between the stated questions and texts of their package."""
    return f"""
{name} AS (
  SELECT question_no, corpus_id, {key}, count(*) / sqrt(CAST(nq * np AS DOUBLE)) AS sim FROM (
    SELECT question_no, corpus_id, len(t) AS nq, unnest(t) AS token FROM (SELECT question_no, corpus_id, {tokens("question")} AS t FROM asked)) q
  JOIN (
    SELECT corpus_id, {key}, len(t) AS np, unnest(t) AS token FROM (SELECT corpus_id, {key}, {tokens(text)} AS t FROM {texts})) p
  USING (corpus_id, token) GROUP BY question_no, corpus_id, {key}, nq, np)
"""


def propagation(least: float = 0.05, top: int = 3, rounds: int = 2) -> str:
    """The rounds of set-based propagation, one after another: total(score) and active(score, tier)."""
    parts = ["total0 AS (SELECT * FROM start)", "frontier0 AS (SELECT * FROM start)", "active0 AS (SELECT *, 0 AS tier FROM start)",
             "used0 AS (SELECT question_no, sentence_id FROM ssim WHERE false)"]
    for t in range(1, rounds + 1):
        o = t - 1
        parts += [
            f"""reach{t} AS (
  SELECT f.question_no, f.corpus_id, f.entity, m.sentence_id, f.score, coalesce(s.sim, 0) AS sim
  FROM frontier{o} f JOIN smention m ON f.corpus_id = m.corpus_id AND f.entity = m.entity
  LEFT JOIN ssim s ON s.question_no = f.question_no AND s.corpus_id = f.corpus_id AND s.sentence_id = m.sentence_id
  WHERE f.score >= {least} AND f.score > 0
    AND NOT EXISTS (SELECT 1 FROM used{o} u WHERE u.question_no = f.question_no AND u.sentence_id = m.sentence_id))""",
            f"""pick{t} AS (
  SELECT question_no, corpus_id, sentence_id, sum(score) * max(sim) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY question_no, entity ORDER BY sim DESC, sentence_id) AS nth FROM reach{t})
  GROUP BY 1, 2, 3 HAVING min(nth) <= {top})""",
            f"used{t} AS (SELECT * FROM used{o} UNION ALL SELECT question_no, sentence_id FROM pick{t})",
            f"""gain{t} AS (
  SELECT p.question_no, p.corpus_id, m.entity, sum(p.w) AS score FROM pick{t} p JOIN smention m ON p.corpus_id = m.corpus_id AND p.sentence_id = m.sentence_id
  WHERE p.w > 0 GROUP BY 1, 2, 3)""",
            f"total{t} AS (SELECT question_no, corpus_id, entity, sum(score) AS score FROM (SELECT * FROM total{o} UNION ALL SELECT * FROM gain{t}) GROUP BY 1, 2, 3)",
            f"""active{t} AS (
  SELECT * FROM active{o} a WHERE NOT EXISTS (SELECT 1 FROM gain{t} g WHERE g.question_no = a.question_no AND g.entity = a.entity AND g.score >= {least})
  UNION ALL SELECT question_no, corpus_id, entity, score, {t} AS tier FROM gain{t} WHERE score >= {least})""",
            f"frontier{t} AS (SELECT * FROM gain{t} WHERE score > 0)",
        ]
    return ",\n".join(parts) + f",\ntotal AS (SELECT * FROM total{rounds}), active AS (SELECT * FROM active{rounds})"


def priors(ratio: float = 2.0, weight: float = 0.05) -> str:
    return f"""
every AS (
  SELECT a.question_no, a.corpus_id, c.passage_id, c.text, coalesce(s.sim, 0) AS sim
  FROM asked a JOIN corpus c USING (corpus_id) LEFT JOIN psim s ON s.question_no = a.question_no AND s.corpus_id = a.corpus_id AND s.passage_id = c.passage_id),
bonus AS (
  SELECT question_no, passage_id, sum(score * ln(1 + n) / greatest(tier, 1)) AS bonus FROM (
    SELECT e.question_no, e.passage_id, a.score, a.tier, (length(e.text) - length(replace(lower(e.text), lower(a.entity), ''))) / length(a.entity) AS n
    FROM every e JOIN active a ON a.question_no = e.question_no AND contains(lower(e.text), lower(a.entity))) GROUP BY 1, 2),
prior AS (
  SELECT question_no, corpus_id, passage_id, sim,
         ({ratio} * CASE WHEN high > low THEN (sim - low) / (high - low) ELSE 1 END + ln(1 + coalesce(bonus, 0))) * {weight} AS prior
  FROM (SELECT *, min(sim) OVER (PARTITION BY question_no) AS low, max(sim) OVER (PARTITION BY question_no) AS high FROM every)
  LEFT JOIN bonus USING (question_no, passage_id))
"""


def pagerank(entity_weights: str, damping: float = 0.5, iterations: int = 20) -> str:
    """``rank``: PageRank mass of all nodes, reset to ``entity_weights`` and the passage priors of seeded questions."""
    return f"""
both_ways AS (
  SELECT corpus_id, src AS u, dst AS v, weight FROM edge UNION ALL SELECT corpus_id, dst, src, weight FROM edge
  UNION ALL SELECT corpus_id, src, dst, weight FROM adjacent UNION ALL SELECT corpus_id, dst, src, weight FROM adjacent),
tr AS (
  SELECT corpus_id, u, v, w / sum(w) OVER (PARTITION BY corpus_id, u) AS p FROM (
    SELECT corpus_id, u, v, sum(weight) AS w FROM both_ways WHERE u <> v GROUP BY 1, 2, 3)),
weighted AS (
  SELECT question_no, corpus_id, 'entity-' || md5(entity) AS n, score AS w FROM {entity_weights}
  UNION ALL SELECT question_no, corpus_id, passage_id, prior FROM prior WHERE question_no IN (SELECT question_no FROM seed)),
rs AS (
  SELECT question_no, corpus_id, n, w / sum(w) OVER (PARTITION BY question_no) AS r FROM (
    SELECT question_no, corpus_id, n, sum(greatest(w, 0)) AS w FROM weighted GROUP BY 1, 2, 3) WHERE w > 0),
x AS (
  SELECT 0 AS it, question_no, corpus_id, n, CAST(r AS DOUBLE) AS x FROM rs
  UNION ALL
  SELECT it + 1, question_no, corpus_id, n, sum(x) FROM (
    SELECT x.it, x.question_no, x.corpus_id, tr.v AS n, x.x * tr.p * {damping} AS x FROM x JOIN tr ON x.corpus_id = tr.corpus_id AND x.n = tr.u WHERE x.it < {iterations}
    UNION ALL
    SELECT d.it, rs.question_no, rs.corpus_id, rs.n, rs.r * {1 - damping} FROM (SELECT DISTINCT it FROM x WHERE it < {iterations}) d, rs)
  GROUP BY it, question_no, corpus_id, n),
rank AS (SELECT question_no, n AS passage_id, x AS score FROM x WHERE it = {iterations} AND n LIKE 'passage-%')
"""


def clauses(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip() for p in parts)
