"""Components of few edges come from the driver, of many from shuffles: both are the same, and few edges take few steps."""

import random

import pytest

from helixspark.llm import line_dedup, ngram_join


def graphs():
    rng = random.Random(5)
    yield "none", []
    yield "loops", [(3, 3), (4, 4)]
    yield "chain", [(k, k + 1) for k in range(40)]
    yield "comb", [(100 + k, (k * 37) % 60) for k in range(60)] + [(60, 5), (5, 60), (5, 60)]
    yield "random", [(rng.randrange(400) * 1_000_003, rng.randrange(400) * 1_000_003) for _ in range(230)]


def classes(edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("few", [0, 10_000])
@pytest.mark.parametrize("edges", [g for _, g in graphs()], ids=[n for n, _ in graphs()])
def test_same_components(spark, edges, few):
    got = ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint"), few).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(classes(edges).items())


def crowd(n):
    """Lines that share segments, some within two edits of each other."""
    rng = random.Random(9)
    heads = ["the same beginning of every line here, ", "the same beginning of every row there, "]
    lines = [heads[k % 2] + "".join(rng.choice("abcdefgh ") for _ in range(9)) + " and an end" for k in range(n)]
    return lines + [x.replace("beginning", "beginnnig") for x in lines[::5]]


def test_few_edges_take_few_steps(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(crowd(90))), "doc_id bigint, text string")
    made, rounds = [], []
    stored, components = ngram_join.stored, line_dedup.components
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: made.append(name) or stored(df, name))
    monkeypatch.setattr(line_dedup, "components", lambda edges: rounds.append(0) or components(edges))

    def run():
        made.clear(), rounds.clear()
        return sorted(map(tuple, line_dedup.dedup_lines(docs).collect())), len(made), len(rounds)

    got, steps, found = run()
    assert any(t == "" for _, t in got)
    # A round without new links finds no components again, and each time takes one stored table.
    assert steps == found < 2 + line_dedup.ROUNDS
    monkeypatch.setattr(ngram_join, "FEW", 0)
    want, steps, found = run()
    assert got == want and steps > found
