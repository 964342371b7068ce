"""SQL for the queries of this subpackage that SQL can express."""

QUESTIONS = r"""
questions_once AS (
  SELECT corpus_id, lower(trim(coalesce(id, CAST(source_index AS VARCHAR)), E' \t\r\n ')) AS question_key,
         min(nullif(regexp_replace(lower(question_type), '[\s _-]+', '', 'g'), '')) AS type_key,
         min(batch_no) AS first_batch, min(question_no) AS question_no
  FROM questions GROUP BY 1, 2)
"""

QUOTAS = QUESTIONS + r""",
typed AS (SELECT corpus_id, type_key, count(*) AS n FROM questions_once WHERE type_key IS NOT NULL GROUP BY 1, 2),
sizes AS (SELECT corpus_id, arg_max(sample_count, coalesce(prepared_at, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS sample_count FROM package GROUP BY 1),
target AS (
  SELECT t.corpus_id, t.question_type, regexp_replace(lower(t.question_type), '[\s _-]+', '', 'g') AS type_key, coalesce(t.target_share, 0) AS share,
         coalesce(t.min_count, 0) AS min_count, s.sample_count FROM sample_targets t LEFT JOIN sizes s USING (corpus_id)),
have AS (
  SELECT t.*, coalesce(q.n, 0) AS available, least(t.min_count, coalesce(q.n, 0)) AS least,
         greatest(CAST(round(share * sample_count) AS BIGINT), min_count) AS wanted
  FROM target t LEFT JOIN typed q USING (corpus_id, type_key)),
-- at each level of the fill where some type joins or stops: how much of the sample is filled
events AS (
  SELECT corpus_id, least / share AS level FROM have WHERE share > 0 UNION SELECT corpus_id, available / share FROM have WHERE share > 0),
filled AS (
  SELECT e.corpus_id, e.level, h.sample_count, sum(CASE WHEN h.share > 0 THEN least(greatest(e.level * h.share, h.least), h.available) ELSE h.least END) AS amount
  FROM events e JOIN have h USING (corpus_id) GROUP BY 1, 2, 3),
near AS (
  SELECT corpus_id, max(struct_pack(level := level, amount := amount)) FILTER (WHERE amount < sample_count - 1e-9) AS low,
         min(struct_pack(level := level, amount := amount)) FILTER (WHERE amount >= sample_count - 1e-9) AS high, any_value(sample_count) AS sample_count
  FROM filled GROUP BY 1),
full_level AS (
  SELECT corpus_id, high IS NOT NULL AS enough, CASE WHEN low IS NULL THEN high.level
    ELSE low.level + (sample_count - low.amount) / (high.amount - low.amount) * (high.level - low.level) END AS level FROM near),
exact AS (
  SELECT h.*, CAST(CASE WHEN share > 0 AND coalesce(enough, false) THEN least(greatest(level * share, least), available) WHEN share > 0 THEN available ELSE least END AS DOUBLE) AS x
  FROM have h LEFT JOIN full_level USING (corpus_id)),
ranked AS (
  SELECT *, floor(x + 1e-9) AS base, sum(x) OVER (PARTITION BY corpus_id) AS total, sum(floor(x + 1e-9)) OVER (PARTITION BY corpus_id) AS given,
         row_number() OVER (PARTITION BY corpus_id ORDER BY round(x - floor(x + 1e-9), 9) DESC, type_key) AS nth, sum(least) OVER (PARTITION BY corpus_id) AS minima
  FROM exact),
quotas AS (
  SELECT corpus_id, type_key, question_type, share AS target_share, min_count, sample_count, available, wanted,
         CAST(CASE WHEN sample_count IS NULL THEN 0 ELSE base + CASE WHEN nth <= round(total) - given THEN 1 ELSE 0 END END AS BIGINT) AS quota,
         greatest(wanted - available, 0) AS missing, minima > sample_count AS minima_exceed FROM ranked)
"""

SQL = {
    "p4_quotas": f"WITH {QUOTAS} SELECT * EXCLUDE (type_key) FROM quotas",
    "p4_sample": f"""
WITH {QUOTAS},
keyed AS (
  SELECT q.corpus_id, s.question_type, s.quota, q.type_key, q.question_key, q.question_no,
         CAST(CAST('0x' || substr(md5(concat_ws(chr(1), 'quota', q.corpus_id, q.question_key)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS random_key
  FROM questions_once q JOIN quotas s USING (corpus_id, type_key))
SELECT corpus_id, question_type, question_key, question_no, random_key FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus_id, type_key ORDER BY random_key, question_key) AS nth FROM keyed) WHERE nth <= quota
""",
    "p4_found": f"""
WITH {QUESTIONS},
typed AS (SELECT corpus_id, type_key, count(*) AS n FROM questions_once WHERE type_key IS NOT NULL GROUP BY 1, 2),
sizes AS (SELECT corpus_id, arg_max(sample_count, coalesce(prepared_at, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS sample_count FROM package GROUP BY 1)
SELECT t.corpus_id, t.question_type
FROM sample_targets t JOIN sizes s USING (corpus_id)
LEFT JOIN typed q ON q.corpus_id = t.corpus_id AND q.type_key = regexp_replace(lower(t.question_type), '[\\s _-]+', '', 'g')
WHERE coalesce(q.n, 0) < greatest(coalesce(t.min_count, 0), round(coalesce(t.target_share, 0) * s.sample_count))
""",
    "p5_stable_sample": f"""
WITH {QUESTIONS},
drawn AS (
  SELECT s.spec_id, q.corpus_id, q.question_key, q.question_no, q.first_batch, s.sample_rate,
         CAST(CAST('0x' || substr(md5(concat_ws(chr(1), CAST(s.seed AS VARCHAR), q.corpus_id, q.question_key)), 1, 13) AS BIGINT) AS DOUBLE)
           / 4503599627370496.0 AS unit
  FROM questions_once q, sample_specs s)
SELECT spec_id, corpus_id, question_key, question_no, first_batch, unit FROM drawn WHERE unit < sample_rate
""",
}
