import random

from pyspark.sql import functions as F

from passagemill.operators import ordered as O


def test_ranges_give_what_one_window_would(spark):
    rng = random.Random(1)
    data = [("a" if rng.random() < 0.8 else "b", rng.randrange(30_000), f"k{i}", rng.randrange(5)) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, n bigint, k string, v int")
    want = {g: sorted((n, k, v) for h, n, k, v in data if h == g) for g in "ab"}
    placed = O.positions(rows, ["g"], ["n", "k"], O.by_number("n")).collect()
    assert {(r.g, r.k): r.position for r in placed} == {(g, k): i for g in "ab" for i, (_, k, _) in enumerate(want[g])}
    summed = {(r.g, r.k): (r.s, r.s_all) for r in O.running_sum(rows, ["g"], ["n", "k"], O.by_number("n"), "v", "s").collect()}
    for g in "ab":
        upto = 0
        for _, k, v in want[g]:
            upto += v
            assert summed[g, k] == (upto, sum(x[2] for x in want[g]))
    after = {(r.g, r.k): r.next for r in O.followers(rows, ["g"], ["n", "k"], O.by_number("n"), "k", "next").collect()}
    for g in "ab":
        names = [k for _, k, _ in want[g]]
        assert [after[g, k] for k in names] == [*names[1:], None]
    keyed = rows.withColumn("d", F.md5(F.col("k").cast("binary")))
    got = [r.d for r in O.positions(keyed, [], ["d"], O.by_digest("d")).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 400
