"""Cases that a review found: large components, foreign archives, limits between lengths, rows that share an id."""

import base64
import gzip
import hashlib

import numpy as np

from helixspark.llm import line_dedup, token_counts, top_k, toxicity, warc


def test_large_components(spark):
    rows = [(0, [1.0e7, 1.0]), (50, [0.9e7, -1.0]), (1, [-1.0e7, 2.0]), (2, [1.0, 1.0e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]


def test_foreign_records(spark, tmp_path):
    def one(kind, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", "warc-record-id: <urn:uuid:1>", "WARC-Target-URI: http://é/", *more, f"Content-Length: {len(block)}"])
        return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    body = b"<p>x</p>"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = [one("warcinfo", b"software: x\r\n"), one("response", b"HTTP/1.1 200 OK\r\nServer: y\r\n\r\n" + body), one("response", body, "WARC-Payload-Digest: " + digest), one("request", b"GET / HTTP/1.1\r\n\r\n")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(records))
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got] == [(None, 8, hashlib.sha1(body).hexdigest(), body)] * 2


def test_limits(spark):
    lengths = [3, 3, 0, 9, 20]
    hist = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    for r in token_counts.at_limits(hist, [0, 1, 3, 5, 20, 99]).collect():
        assert (r.total_tokens, r.truncated_total, r.n_truncated) == (35, sum(min(x, r.context_limit) for x in lengths), sum(x > r.context_limit for x in lengths))
    assert token_counts.at_limits(hist.limit(0), [4]).first().truncated_total == 0


def test_rows_that_share_an_id(spark):
    a, b = "a" * 40, "once " * 10
    df = spark.createDataFrame([(1, a + "\n" + a), (1, b + "\n" + a), (0, a), (7, None)], "doc_id long, text string").selectExpr("*", "1 as dropped", "2 as u", "3 as kept")
    out = line_dedup.dedup_lines(df, short=True)
    assert out.columns == df.columns and sorted(r.text or "" for r in out.collect()) == sorted(["", b, a, ""])
    assert line_dedup.dedup_lines(df.limit(0), short=True).count() == 0


def test_no_labels(spark):
    long = spark.createDataFrame([(1, "a b. " * 5000)], "doc_id long, text string")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    r = toxicity.score(long, model).first()
    assert r.score < 1e-9 and r.predicted == 0 and r.sentences == []
