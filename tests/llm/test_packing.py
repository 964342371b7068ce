import random
from collections import Counter, defaultdict

import numpy as np

from passagemill.llm.packing import enumerate_patterns, fit_counts, pack, plan_containers
from passagemill.llm.vocab import batch_encoder


def test_patterns_fill_the_capacity():
    sizes = np.array([1, 3, 7, 20, 33])
    for p in enumerate_patterns(sizes, np.array([9.0, 5, 4, 3, 2]), 64):
        assert sum(s * m for s, m in p) == 64 and len(p) <= 3


def test_least_squares_finds_an_exact_mixture():
    patterns = [((6, 1), (4, 1)), ((5, 2),), ((4, 1), (3, 2))]
    sizes = np.array([3, 4, 5, 6])
    weights = np.array([20.0, 30, 40, 20])
    times = fit_counts(patterns, sizes, weights, 2000)
    assert np.allclose(times, [20, 20, 10], atol=0.2)


def test_plans_use_every_document_once():
    rng = random.Random(3)
    for _ in range(20):
        capacity = rng.randrange(5, 200)
        histogram = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 500)))
        used = Counter()
        bins = 0
        for pattern, times in plan_containers(dict(histogram), capacity):
            assert sum(s * m for s, m in pattern) <= capacity and times > 0
            bins += times
            for s, m in pattern:
                used[s] += m * times
        assert used == histogram
        need = sum(s * n for s, n in histogram.items()) / capacity
        assert bins <= 1.7 * need + 1
    assert plan_containers({}, 10) == []


def test_documents_are_placed_whole(spark):
    rng = random.Random(4)
    texts = [None, "", " ".join(["mill"] * 700), *[" ".join(["river"] * rng.randrange(1, 60)) for _ in range(200)], *["same words here"] * 150]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    containers = spark.createDataFrame([("small", "byte_bpe_50k", 64), ("large", "piece_bpe_32k", 512)], "container_kind string, tokenizer string, capacity_tokens bigint")
    rows = pack(docs, containers).collect()
    for kind, name, capacity in (("small", "byte_bpe_50k", 64), ("large", "piece_bpe_32k", 512)):
        sizes = [len(x) for x in batch_encoder(name)([t or "" for t in texts])]
        held, parts = Counter(), defaultdict(list)
        for r in rows:
            if r.container_kind == kind:
                parts[r.doc_id].append(r)
                if r.container_no is not None:
                    held[r.container_no] += r.n_tokens
        assert max(held.values()) <= capacity and set(held) == set(range(len(held)))
        assert sum(sizes) / (len(held) * capacity) > 0.9
        for i, size in enumerate(sizes):
            own = sorted(parts[i], key=lambda r: r.part_no)
            assert sum(r.n_tokens for r in own) == size
            assert len(own) == max(1, -(-size // capacity))
            assert [r.start_token for r in own] == [k * capacity for k in range(len(own))]
            assert (own[0].container_no is None) == (size == 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    containers = spark.createDataFrame([("k", "byte_bpe_50k", 8)], "container_kind string, tokenizer string, capacity_tokens bigint")
    assert pack(docs.filter("false"), containers).count() == 0
    assert pack(docs, containers.filter("false")).count() == 0
