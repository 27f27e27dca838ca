"""Each operator against brute force, other libraries or exact round trips, on small tables with every odd case."""

import hashlib
import html
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixspark.llm import bpe, html_extraction, line_dedup, media, mixing, ngram_join, token_counts, top_k, toxicity, warc
from helixspark.llm._common import shingles, words

TEXTS = [(1, "The cat sat.\n\n on  the mat"), (2, None), (3, ""), (4, "x" * 70_000), (5, "Ünïcode  é \x1c\x85 　 don't 12,5 🙂🙂"), (None, "no id"), (1, "The cat sat.\n\n on  the mat")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a column that clashes with results."""
    return spark.createDataFrame([(*x, 7) for x in TEXTS], "doc_id long, text string, n_tokens int").withColumn("score", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_words():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbé \t\n.") for _ in range(rng.randrange(60))).encode() for _ in range(300)]
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t)
    found = [re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    h, where, a, b = words(texts)
    assert [lower(texts[w])[i:j] for w, i, j in zip(where, a, b, strict=True)] == [x for f in found for x in f]
    assert len(set(h.tolist())) == len({x for f in found for x in f})
    sets = [{tuple(f[k : k + 3]) for k in range(len(f) - 2)} if len(f) > 2 else ({tuple(f)} if f else set()) for f in found]
    assert [len(x) for x in shingles(texts, 3)] == [len(s) for s in sets]


def test_media(odd, empty):
    rows = media.media_columns(odd).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = next((t or "").encode() for i, t in TEXTS if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        want = media.pad(text)
        assert media.from_wav(bytes(r.media)) == want and len(want) % 64 == 0 < len(want)
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]), hashlib.sha256(bytes(r.media)).hexdigest())
        assert r.n_pairs == len(r.fingerprint)
    tone = (128 + 100 * np.sin(np.arange(8000) * 2 * np.pi * 32 / 256)).astype(np.uint8).tobytes()
    assert {int(x) >> 16 & 0xFFFF for x in media.fingerprint(tone)} >= {32}
    assert media.media_columns(empty).count() == 0


def components(links, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join(spark, empty):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(160):
        x = list(base) if i % 3 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(6)):
            x[rng.randrange(len(x))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(x)))
    rows += [(500 + i, t.upper()) for i, t in rows[:20]] + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (None, rows[0][1]), (5, rows[5][1])]
    sets = {i: set(shingles([(t or "").encode()], 3)[0].tolist()) for i, t in rows}
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = components(links, ids)
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)), 3, 90).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want.get(r.doc_id)) for r in got)
    assert ngram_join.near_copies(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 6)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(30)] + [(2000, None), (2001, [float("nan")] * 6), (2002, [None] * 6), (2003, [1.0]), (None, v[0].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in top_k.top_k(df, df.where("vec_id % 50 = 0"), 5, tree=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if i is not None and i < 2000}
    for q in [i for i in good if i % 50 == 0]:
        best = sorted((-int(good[q] @ x), i) for i, x in good.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert top_k.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tree_skips():
    rng = np.random.default_rng(2)
    x = (np.repeat(rng.normal(size=(20, 3)) * 2000, 200, axis=0) + rng.normal(size=(4000, 3)) * 20).astype(np.int64)
    bound = float((x * x).sum(1).max())
    tree = top_k.Tree(np.arange(4000), x, bound)
    far = int((x * x).sum(1).argmax())
    found, computed = top_k.search(tree.pages, x[far], far, 5, bound)
    scores = sorted(((int(a), -i) for i, a in enumerate(x @ x[far]) if i != far), reverse=True)[:5]
    assert computed < 2500 and sorted(found, reverse=True) == scores


def test_toxicity(spark, odd, empty):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        parts = [" ".join(rng.choice("the of and that with from this".split()) for _ in range(6)) for _ in range(5)]
        if bad:
            parts[rng.randrange(5)] += " you " + rng.choice(["grumble", "snark"])
        rows.append((i, ". ".join(parts) + ".", int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.where("doc_id < 400"))
    out = {r.doc_id: r for r in toxicity.score(df.where("doc_id >= 400"), model).collect()}
    assert np.mean([out[i].predicted == y for i, _, y in rows[400:]]) > 0.98
    r = next(r for r in out.values() if r.predicted)
    assert re.search("grumble|snark", rows[r.doc_id][1].encode()[r.sentences[0].start : r.sentences[0].end].decode())
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model, located=False).collect()}
    assert scores[3] == 0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(empty, toxicity.fit(df.limit(0)), located=False).count() == 0
    assert spark.range(1).select(F.lit(12).alias("doc_id")).select(toxicity.held_out()).first()[0] == (zlib.crc32(b"12") % 4 == 2)


def test_mixing(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(("alpha beta gamma", "delta eps zeta")[i % 3 == 0].split()) for _ in range(rng.randrange(1, 30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, {"quality0_toxic0": 0.5, "quality1_toxic0": 0.5}).toPandas()
    p = np.stack(got.domain_posterior) * got.n_words.to_numpy()[:, None] * got.rate.to_numpy()[:, None]
    assert np.allclose(p.sum(0) / p.sum(), 0.5, atol=1e-4) and (got.rate >= 0).all()
    assert abs(p.sum() - got.n_words.sum()) < 1e-3 * p.sum()
    again = mixing.mixed_rows(docs, labels, {"quality0_toxic0": 0.5, "quality1_toxic0": 0.5})
    assert again.select("doc_id").distinct().count() == 300 and again.count() > 300 and again.columns == docs.columns
    assert mixing.mix(odd, labels).count() == len(TEXTS) and mixing.mix(empty, labels).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/é", "p" * 2000), (9, "http://b/", "p" * 2000), (2, None, None), (3, "u", "short"), (4, "u", "short"), (5, "u", "\x1f\x8b\x08 " + "q" * 300_000), (9, "http://b/", "p" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages.repartition(2), path)
    for split in (97, 8 << 20):
        got = warc.read_warc(spark, path, split).collect()
        assert Counter(r.page_id for r in got) == Counter(i for i, _, _ in rows)
        for r in got:
            text = next((t or "").encode() for i, _, t in rows if i == r.page_id)
            assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha1(text).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", 9) if r.page_id == 1 else ("response", None))
            assert r.payload is None or bytes(r.payload) == text
    warc.write_warc(pages.limit(0), path + "0")
    assert warc.read_warc(spark, path + "0").count() == 0


def test_tokens(odd, empty):
    import tiktoken

    path, pattern = bpe.vocabulary(None)
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={}).encode_ordinary
    want = Counter((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS for ids in [encode(t or "")])
    got = bpe.bpe(odd).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    lengths = sorted(len(encode(t or "")) for _, t in TEXTS)
    hist = token_counts.length_histogram(token_counts.token_lengths(odd))
    for r in hist.collect():
        assert r.n_docs == lengths.count(r.length) and r.tokens_from == sum(x for x in lengths if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in lengths) and r.quantile == pytest.approx(sum(x <= r.length for x in lengths) / len(lengths))
    for r in token_counts.at_limits(hist, [0, 5, 10**6]).collect():
        assert (r.total_tokens, r.truncated_total) == (sum(lengths), sum(min(x, r.context_limit) for x in lengths))
    assert token_counts.quantile(hist, 0.5).first()[0] == lengths[(len(lengths) - 1) // 2]
    assert bpe.bpe(empty).count() == 0 and token_counts.length_histogram(token_counts.token_lengths(empty)).count() == 0


def test_codec_random():
    import tiktoken

    path, pattern = bpe.vocabulary(None)
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={}).encode_ordinary
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t'sX1,.é\x1c\x85　") for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 3000, "".join(rng.choice("abcdef") for _ in range(800))]
    c = bpe.codec(path, pattern)
    got = c.encode(texts)
    assert [b"".join(x) for x in got] == [array("I", encode(t)).tobytes() for t in texts]
    assert [x.decode() for x in c.decode([np.frombuffer(b"".join(x), "<u4") for x in got])] == texts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i : i + rng.randrange(2)] = rng.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("direct", [32, 2])
def test_line_dedup(spark, monkeypatch, direct):
    monkeypatch.setattr(line_dedup, "DIRECT", direct)
    monkeypatch.setattr(line_dedup, "HUBS", 2)
    rng = random.Random(6)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(40)) + "x" * 8 for _ in range(8)]
    docs = [(d, "\n".join(edited(rng, rng.choice(bases), rng.randrange(4)) if rng.random() < 0.7 else "short" for _ in range(rng.randrange(5)))) for d in range(70)]
    docs += [(500, None), (501, ""), (None, bases[0]), (502, "y" * 60 + "\r\n" + "y" * 60 + "\nend")]
    lines = [(d, i, x.strip(" \t\r")) for d, t in docs if t is not None and d is not None for i, x in enumerate(t.split("\n")) if len(x.strip(" \t\r")) >= 30]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i][2]) - len(lines[j][2])) <= 2 and edits(lines[i][2], lines[j][2]) <= 2]
    want = {}
    for i, c in components(links, range(len(lines))).items():
        if c != i:
            want.setdefault(lines[i][0], []).append(lines[i][1])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    assert {r.doc_id: r.dropped for r in line_dedup.dropped_lines(df).collect()} == want
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(out) == len(docs) and out[500].text is None and out[502].text == "y" * 60 + "\r\nend" and out[502].n_chars == 65
    for d, t in docs:
        if t is not None:
            assert out[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ()))


def test_html(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>no</article>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; &quo</h1><p><b>One<br>two  {0}<p>three<form><p>mail?</form><aside>more</aside><section class="comments"><p>me too</section></article><footer>&copy; x</footer>'
    rows = [(i, f"http://H.example/{i}", page.format(i)) for i in range(4)] + [(10, "http://alone/", "<body><p>plain <i>te</i>xt</p><div class=sidebar>s</div>"), (11, None, None), (12, "x", "just text &lt;"), (0, "http://H.example/0", page.format(0))]
    got = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit(1))).collect()}
    assert got[2].text == "Head & &quo One two 2 three" and got[2].n_chars == 27
    assert (got[10].text, got[11].text, got[12].text) == ("plain text", "", "just text <")
    assert html.unescape("&lt;") == "<"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    said = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(said)] + [(100, said[3] + " end", "en", "s", 9), (101, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(range(40)) <= set(out) and 100 not in set(out) and len(corpus_pipeline.STAGES) == 5
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
