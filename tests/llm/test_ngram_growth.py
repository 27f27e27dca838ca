"""The n-gram join makes no rows by the square of a group of near copies: of links only those between components go on, and of two groups the smaller one is expanded first."""

import random

from helixspark.llm import ngram_join


def test_links_are_joined_by_component(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        x = list(base)
        for _ in range(draw.randint(1, 3)):
            x[draw.randrange(60)] = f"v{draw.randrange(500)}"
        texts.append(" ".join(x))
    got, plain = [], ngram_join.components

    def counted(edges):
        got.append([tuple(r) for r in edges.collect()])
        return plain(edges)

    monkeypatch.setattr(ngram_join, "components", counted)
    ngram_join.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 80).collect()
    # Once nodes are joined, only their component's smallest node occurs in later calls.
    joined: set[int] = set()
    for edges in got:
        ends = {x for e in edges for x in e}
        assert edges and not ends & joined
        parent = {x: x for x in ends}
        for a, b in edges * len(ends):
            parent[a] = parent[b] = min(parent[a], parent[b])
        joined |= {x for x in ends if parent[x] != x}
    assert len(got) > 1


def test_smaller_group_comes_first(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    groups = spark.createDataFrame([(1, 10, 500), (2, 20, 1), (3, 30, 40)], "lead long, main long, size long")
    assert sorted(map(tuple, ngram_join.smaller_first(pairs, groups).collect())) == [(2, 1, 20, 10), (2, 3, 20, 30), (3, 1, 30, 10)]
