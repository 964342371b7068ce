from collections import Counter

from passagemill.llm import bounded
from passagemill.llm.bounded import bounded_sample


def test_every_label_is_bounded_and_the_sample_repeats(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 50 = 0 then 'rare' when id % 7 = 0 then null else 'common' end as kind", "1 as _hash")
    got = bounded_sample(rows, "kind", "id", 150, "s").collect()
    assert Counter(r.kind for r in got) == {"common": 150, "rare": 100}
    again = bounded_sample(rows.repartition(9), "kind", "id", 150, "s").collect()
    assert {r.id for r in got} == {r.id for r in again}
    assert bounded_sample(rows.filter("false"), "kind", "id", 5, "s").count() == 0
    assert bounded.SPARE > 1
