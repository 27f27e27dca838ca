"""The last phase of the n-gram join: no hub finds a link, buckets are in parts and heads don't hold the whole prefix."""

import random

from helixspark.llm import ngram_join


def test_last_phase_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "HEADS", 1)
    monkeypatch.setattr(ngram_join, "PART", 4)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [base, ["other", "words", "only"]]
    for _ in range(40):
        x = list(base)
        for _ in range(draw.randint(1, 3)):
            x[draw.randrange(60)] = f"v{draw.randrange(500)}"
        texts.append(x)
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    sets = [{tuple(x[k : k + 3]) for k in range(len(x) - 2)} for x in texts]
    component = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(component)) and len(set(component)) > 2
